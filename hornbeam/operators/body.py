"""A rule's body as a DataFrame plan: a fold over its literals.

The state is a frame, a DataFrame whose columns are the variables bound so far. An
atom joins, a negated atom anti-joins, a comparison filters, an assignment adds a
column, and an aggregate groups a plan of its own and joins back. Only variables
that something later needs are kept, and an atom that binds none of those is a
semi-join. Every instance of a table gets fresh column names.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SafetyError
from ..functions.values import SQL, Value, arithmetic, compare, constant, exact_quotient, fail, negative
from ..plans.safety import ordered
from ..plans.terms import Aggregate, Assign, Atom, BodyLiteral, Compare, Const, Expr, Literal, Signature, UnaryOp, Var, names_in
from ..plans.typing import Types, divides_exactly

_serial = itertools.count()
UNIT = "_unit"


def fresh() -> str:
    return f"x{next(_serial)}"


@dataclass
class Frame:
    df: DataFrame | None
    vars: dict[str, tuple[str, str]]

    def value(self, name: str) -> Value:
        col, kind = self.vars[name]
        return Value(F.col(col), kind)

    def keep(self, names: Iterable[str]) -> Frame:
        wanted = {n: v for n, v in self.vars.items() if n in set(names)}
        if self.df is None:
            return self
        cols = list(dict.fromkeys(c for c, _ in wanted.values()))
        return Frame(self.df.select(*cols) if cols else self.df.select(F.lit(0).alias(fresh())), wanted)


def all_of(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for k, c in enumerate(conditions):
        out = c if not k else out & c
    return out


class Compiler:
    """Builds plans over ``table(signature)``; ``types`` gives the columns' static types."""

    def __init__(self, spark: SparkSession, table: Callable[[Signature], DataFrame], types: Types):
        self.spark, self.table, self.types = spark, table, types

    def unit(self, frame: Frame) -> Frame:
        if frame.df is None:
            frame.df = self.spark.range(1).select(F.lit(0).alias(fresh()))
        return frame

    def expression(self, e: Expr, frame: Frame) -> Value:
        match e:
            case Var(name=name):
                return frame.value(name)
            case Const(value=value):
                return constant(value)
            case UnaryOp(operand=inner):
                return negative(self.expression(inner, frame))
        if divides_exactly(e):
            whole, rest = self.expression(e.left.left, frame), self.expression(e.left, frame)
            if whole.type == "int":
                return exact_quotient(rest, e.right.value)
        return arithmetic(e.op, self.expression(e.left, frame), self.expression(e.right, frame))

    def instance(self, atom: Atom, df: DataFrame) -> tuple[DataFrame, dict[str, Value], list[str]]:
        """The table under fresh names, constants and repeated variables applied; a column for each variable."""
        names = [fresh() for _ in df.columns]
        df, found, filters = df.toDF(*names), {}, []
        for term, name, kind in zip(atom.terms, names, self.kinds(atom.signature)):
            value = Value(F.col(name), kind)
            if isinstance(term, Const):
                filters.append(compare("=", value, constant(term.value)))
            elif term.name in found:
                filters.append(compare("=", found[term.name], value))
            else:
                found[term.name] = value
        return (df.where(all_of(filters)) if filters else df), found, names

    def kinds(self, signature: Signature) -> list[str]:
        return [t or "str" for t in self.types.get(signature, [None] * signature[1])]

    def atom(self, atom: Atom, frame: Frame, needed: set[str], df: DataFrame) -> Frame:
        df, found, names = self.instance(atom, df)
        new = {n: v for n, v in found.items() if n not in frame.vars}
        kept = {n: v for n, v in new.items() if n in needed}
        column = {n: names[next(k for k, t in enumerate(atom.terms) if isinstance(t, Var) and t.name == n)] for n in kept}
        add = {n: (column[n], v.type) for n, v in kept.items()}
        if frame.df is None:
            cols = [c for c, _ in add.values()]
            return Frame(df.select(*cols) if cols else df.select(F.lit(0).alias(fresh())).limit(1), add)
        on = [compare("=", frame.value(n), v) for n, v in found.items() if n in frame.vars]
        if not kept:
            return Frame(frame.df.join(df, all_of(on), "left_semi"), frame.vars)
        shared = [v for n, v in found.items() if n in frame.vars]
        df = df.select(*dict.fromkeys([c for c, _ in add.values()]), *[v.col for v in shared])
        if not on:  # all rows meet: each different one once, as nothing counts how often a row is there
            return Frame(frame.keep(frame.vars).df.distinct().crossJoin(df.distinct()), frame.vars | add)
        return Frame(frame.df.join(df, all_of(on), "inner"), frame.vars | add)

    def absent(self, atom: Atom, frame: Frame) -> Frame:
        frame = self.unit(frame)
        named = Atom(atom.pred, atom.terms)
        df, found, _ = self.instance(named, self.table(atom.signature))
        on = [compare("=", frame.value(n), v) for n, v in found.items() if n in frame.vars]
        cols = [v.col for n, v in found.items() if n in frame.vars]
        df = df.select(*cols) if cols else df.select(F.lit(0).alias(fresh()))
        return Frame(frame.df.join(df, all_of(on), "left_anti"), frame.vars)

    def where(self, frame: Frame, condition: Column) -> Frame:
        frame = self.unit(frame)
        return Frame(frame.df.where(condition), frame.vars)

    def bind(self, frame: Frame, name: str, value: Value) -> Frame:
        frame, col = self.unit(frame), fresh()
        return Frame(frame.df.withColumn(col, value.col), frame.vars | {name: (col, value.type)})

    def settle(self, frame: Frame, target: Var | Const, value: Value) -> Frame:
        """Bind a free variable; compare with a bound one or a constant."""
        if isinstance(target, Var) and target.name not in frame.vars:
            return self.bind(frame, target.name, value)
        return self.where(frame, compare("=", self.expression(target, frame), value))

    def assign(self, literal: Assign, frame: Frame) -> Frame:
        e = literal.expr
        if isinstance(e, Var) and e.name not in frame.vars:
            return self.bind(frame, e.name, self.expression(literal.var, frame))
        return self.settle(frame, literal.var, self.expression(e, frame))

    def aggregate(self, a: Aggregate, frame: Frame) -> Frame:
        inside = names_in((a.expr, *a.body))
        keys = [n for n in frame.vars if n in inside]
        local = inside - set(keys)
        try:  # a body that needs nothing from outside is grouped once, for all keys together
            body, bound = ordered(a.body)
            alone = set(keys) | names_in(a.expr) <= bound
        except SafetyError:
            alone = False
        if alone:
            inner = self.body(body, Frame(None, {}), set(keys) | local)
        else:
            seed = frame.keep(keys)
            seed.df = self.unit(seed).df.distinct()
            inner = self.body(a.body, seed, set(keys) | local)
        inner = self.unit(inner.keep(set(keys) | local))
        rows = inner.df.distinct()
        value = self.expression(a.expr, inner) if a.expr is not None else None
        out, n = fresh(), fresh()
        if a.op == "count":
            folded, kind = F.count(F.lit(1)), "int"
        elif a.op in ("min", "max"):
            folded, kind = getattr(F, a.op)(value.col), value.type
        else:
            if value.type in ("str", "any"):
                value = arithmetic("-", value, constant(0)) if value.type == "any" else Value(fail(f"{a.op} needs numbers", "num"), "num")
            kind = value.type
            folded = F.sum(value.col)
            if a.op == "avg":
                folded, kind = F.sum(value.col).cast("double") / F.count(F.lit(1)), "rat" if kind in ("int", "rat") else "num"
        groups = [(fresh(), inner.value(k)) for k in keys]
        by = rows.groupBy(*[v.col.alias(c) for c, v in groups]).agg(folded.alias(out), F.count(F.lit(1)).alias(n))
        if a.op not in ("count", "sum"):
            by = by.where(F.col(n) > 0)
        by = by.drop(n)
        frame = self.unit(frame)
        on = [compare("=", frame.value(k), Value(F.col(c), v.type)) for k, (c, v) in zip(keys, groups)]
        total = a.op in ("count", "sum")
        joined = frame.df.join(by, all_of(on), "left" if total else "inner") if on else frame.df.crossJoin(by)
        result = F.coalesce(F.col(out), F.lit(0).cast(SQL[kind])) if total else F.col(out)
        joined = joined.drop(*[c for c, _ in groups])
        return self.settle(Frame(joined, frame.vars), a.var, Value(result, kind))

    def body(self, body: Iterable[BodyLiteral], frame: Frame, out: set[str], instead: Mapping[int, DataFrame] | None = None) -> Frame:
        """The frame after an ordered body; ``instead`` replaces the table of the literal at a position."""
        body, instead = list(body), instead or {}
        later: list[set[str]] = [set(out)]
        for literal in reversed(body):
            later.append(later[-1] | names_in(literal))
        later = later[::-1][1:]
        for k, literal in enumerate(body):
            match literal:
                case Literal(atom=atom, negated=negated):
                    if k in instead or not negated:
                        df = instead[k] if k in instead else self.table(atom.signature)
                        frame = self.atom(atom, frame, later[k], df)
                    else:
                        frame = self.absent(atom, frame)
                case Compare(op=op, left=left, right=right):
                    frame = self.where(frame, compare(op, self.expression(left, frame), self.expression(right, frame)))
                case Assign():
                    frame = self.assign(literal, frame)
                case Aggregate():
                    frame = self.aggregate(literal, frame)
            if frame.df is not None and set(frame.vars) - later[k]:
                frame = frame.keep(later[k])
        return frame

    def heads(self, head: Atom, body: Iterable[BodyLiteral], instead: Mapping[int, DataFrame] | None = None) -> DataFrame:
        """Rows of the head, not yet distinct, in the columns of its predicate."""
        frame = self.unit(self.body(body, Frame(None, {}), names_in(head), instead))
        if not head.terms:
            return frame.df.select(F.lit(0).alias(UNIT))
        values = [self.expression(t, frame) for t in head.terms]
        return frame.df.select(*[v.to(kind).alias(f"c{k}") for k, (v, kind) in enumerate(zip(values, self.kinds(head.signature)))])
