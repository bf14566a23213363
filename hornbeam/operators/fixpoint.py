"""Semi-naive evaluation: rounds of plans over what the last round found."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EvaluationError
from ..functions.values import MARK, SQL, cell
from ..plans.strata import dependencies, strongly_connected
from ..plans.terms import Literal, Rule, Signature
from ..plans.typing import Types
from ..sources.scratch import LOCAL_ROWS, Stored, store
from .body import UNIT, Compiler


@contextmanager
def evaluation_errors():
    """Spark's errors at run time as this package's."""
    try:
        yield
    except PySparkException as e:
        text = str(e)
        if MARK in text:
            raise EvaluationError(text.split(MARK, 1)[1].split("SQLSTATE")[0].split("\n")[0].strip()) from e
        if "DIVIDE_BY_ZERO" in text or "REMAINDER_BY_ZERO" in text:
            raise EvaluationError("division by zero") from e
        if "OVERFLOW" in text:
            raise EvaluationError("an integer does not fit in 64 bits") from e
        raise


def schema_of(signature: Signature, types: Types) -> T.StructType:
    kinds = [t or "str" for t in types.get(signature, [None] * signature[1])]
    if not kinds:
        return T._parse_datatype_string(f"{UNIT} int")
    return T._parse_datatype_string(", ".join(f"c{k} {SQL[t]}" for k, t in enumerate(kinds)))


def minus(left: DataFrame, right: DataFrame, how: str = "left_anti") -> DataFrame:
    """Rows of ``left`` that are not in ``right`` (or, ``left_semi``, that are); by explicit column equality."""
    other = right.toDF(*[f"r_{c}" for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in left.columns])
    return left.join(other, on, how)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.union(b), parts)


class Database:
    """Predicates and their tables under one typing; the base of every evaluation."""

    def __init__(self, spark: SparkSession, types: Types):
        self.spark, self.types = spark, types
        self.tables: dict[Signature, Stored] = {}

    def copy(self) -> Database:
        out = Database(self.spark, self.types)
        out.tables = dict(self.tables)
        return out

    def empty(self, signature: Signature) -> Stored:
        schema = schema_of(signature, self.types)
        return Stored(self.spark, schema, self.spark.createDataFrame([], schema).toArrow(), [], 0)

    def stored(self, signature: Signature) -> Stored:
        if signature not in self.tables:
            self.tables[signature] = self.empty(signature)
        return self.tables[signature]

    def df(self, signature: Signature) -> DataFrame:
        return self.stored(signature).df

    def total(self) -> int:
        """Stored tuples; registered tables are read where they lie and not counted."""
        return sum(t.count for t in self.tables.values() if not t.registered)

    def without(self, signature: Signature, gone: Stored) -> Stored:
        """The table of a predicate without some of its rows."""
        table = self.stored(signature)
        if table.registered:
            return Stored.view(self.spark, minus(table.df, gone.df))
        return self.store([minus(table.df, gone.df)], None, bool(table.paths))

    def rows(self, signature: Signature, tuples: Iterable[tuple]) -> DataFrame:
        """Ground tuples as one local relation."""
        kinds = [t or "str" for t in self.types.get(signature, [None] * signature[1])]
        tuples = list(tuples)
        if any(isinstance(v, int) and not -(1 << 63) <= v < 1 << 63 for row in tuples for v in row):
            raise EvaluationError("an integer does not fit in 64 bits")
        data = [tuple(cell(v, t) for v, t in zip(row, kinds)) if kinds else (0,) for row in tuples]
        return self.spark.createDataFrame(data, schema_of(signature, self.types))

    def compiler(self) -> Compiler:
        return Compiler(self.spark, self.df, self.types)

    def store(self, parts: list[DataFrame], without: Stored | None = None, large: bool = False) -> Stored:
        """The distinct rows of some plans, without those that a table has already."""
        new = union_all(parts).distinct()
        if without is None or (not without.registered and not without.count):
            return store(new, large)
        if without.registered:
            return store(minus(new, without.df), large)
        if without.count > 20 * LOCAL_ROWS and not large:
            # few candidates against a large table: look them up where it lies instead of shuffling it
            found = store(new)
            if found.paths:
                return store(minus(found.df, without.df), True)
            seen = minus(without.df, F.broadcast(found.df), "left_semi")
            return store(minus(found.df, seen))
        return store(minus(new, without.df), large)


class Rounds:
    """One group of rules that is evaluated to its fixpoint; ``commit`` sees every round's new rows."""

    def __init__(self, db: Database, max_iterations: int, commit: Callable[[dict[Signature, Stored]], None]):
        self.db, self.max_iterations, self.commit = db, max_iterations, commit
        self.iterations = 0

    def take(self, new: dict[Signature, Stored]) -> dict[Signature, Stored]:
        delta = {s: t for s, t in new.items() if t.count}
        for signature, table in delta.items():
            self.db.tables[signature] = self.db.stored(signature).union(table)
        self.commit(delta)
        return delta

    def first(self, rules: list[Rule], own: set[Signature], seeds: dict[Signature, list[DataFrame]]) -> dict[Signature, Stored]:
        """Facts, registered tables and rules that read nothing of the group itself."""
        parts: dict[Signature, list[DataFrame]] = defaultdict(list)
        facts: dict[Signature, list[tuple]] = defaultdict(list)
        compiler = self.db.compiler()
        for rule in rules:
            if rule.is_fact:
                facts[rule.head.signature].append(tuple(t.value for t in rule.head.terms))
            elif not any(isinstance(x, Literal) and not x.negated and x.atom.signature in own for x in rule.body):
                parts[rule.head.signature].append(compiler.heads(rule.head, rule.body))
        for signature, tuples in facts.items():
            parts[signature].append(self.db.rows(signature, tuples))
        for signature, dfs in seeds.items():
            parts[signature] += dfs
        big = {s for s in seeds}
        return {s: self.db.store(p, self.db.tables.get(s), s in big and len(p) == 1) for s, p in parts.items()}

    def run(self, rules: list[Rule], own: set[Signature], seeds: dict[Signature, list[DataFrame]]) -> int:
        self.iterations = 1
        delta = self.take(self.first(rules, own, seeds))
        return self.loop(rules, own, delta)

    def loop(self, rules: list[Rule], own: set[Signature], delta: dict[Signature, Stored]) -> int:
        """Fire the rules that read the group, once for each atom that the last round changed."""
        steps = [(r, k, x.atom.signature) for r in rules for k, x in enumerate(r.body) if isinstance(x, Literal) and not x.negated and x.atom.signature in own]
        while delta and steps:
            if self.iterations >= self.max_iterations:
                raise EvaluationError(f"fixpoint not reached after {self.max_iterations} iterations")
            self.iterations += 1
            parts: dict[Signature, list[DataFrame]] = defaultdict(list)
            compiler, large = self.db.compiler(), {}
            for rule, k, read in steps:
                if read in delta:
                    parts[rule.head.signature].append(compiler.heads(rule.head, rule.body, {k: delta[read].df}))
                    large[rule.head.signature] = large.get(rule.head.signature, False) or bool(delta[read].paths)
            delta = self.take({s: self.db.store(p, self.db.tables.get(s), large[s]) for s, p in parts.items()})
        return self.iterations


def groups(rules: list[Rule], strata: list[set[Signature]], lockstep: bool) -> list[tuple[list[Rule], set[Signature]]]:
    """What is evaluated together, in order: components of the dependency graph or, in lock-step, whole strata."""
    by_head: dict[Signature, list[Rule]] = defaultdict(list)
    for rule in rules:
        by_head[rule.head.signature].append(rule)
    parts = strata if lockstep else [set(c) for c in strongly_connected(dependencies(rules))]
    return [([r for r in rules if r.head.signature in part] if len(part) > 1 else by_head[next(iter(part))], part) for part in parts]
