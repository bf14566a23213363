"""Why a fact holds: a proof tree found backwards, one small plan per node.

Every round of the evaluation has a number, and a fact of round g can only rest on
facts of earlier rounds. A step backwards therefore reads rounds below its fact's
own; the search descends and ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import functions as F

from ..errors import DeductiveError
from ..functions.values import plain
from ..plans.terms import Aggregate, Assign, Atom, BinOp, Compare, Const, Literal, Rule, Signature, UnaryOp, Var, variables_in
from .body import Compiler, Frame


@dataclass(frozen=True)
class Condition:
    """A literal that held without deriving anything, with the rule's values in place."""

    literal: Any
    note: str = ""

    def __str__(self) -> str:
        return f"{self.literal}   {self.note}" if self.note else str(self.literal)


@dataclass(frozen=True)
class Derivation:
    """A fact, the rule that derived it, and why that rule's literals hold."""

    atom: Atom
    rule: Rule
    binding: dict = field(default_factory=dict, repr=False)
    premises: tuple[Derivation | Condition, ...] = ()

    @property
    def is_fact(self) -> bool:
        return self.rule.is_fact

    @property
    def depth(self) -> int:
        if self.is_fact:
            return 0
        deepest: dict[int, int] = {}
        for node in reversed(list(self.walk())):
            if isinstance(node, Derivation):
                below = [deepest[id(p)] for p in node.premises if isinstance(p, Derivation)]
                deepest[id(node)] = 0 if node.is_fact else 1 + max(below, default=0)
        return deepest[id(self)]

    def walk(self) -> Iterator[Derivation | Condition]:
        """Every node, parents before children."""
        todo: list[Derivation | Condition] = [self]
        while todo:
            node = todo.pop()
            yield node
            if isinstance(node, Derivation):
                todo += reversed(node.premises)

    def support(self) -> list[Atom]:
        """The base facts below, sorted."""
        return sorted({n.atom for n in self.walk() if isinstance(n, Derivation) and n.is_fact}, key=str)

    def rules_used(self) -> list[Rule]:
        used = {(n.rule.line, str(n.rule)): n.rule for n in self.walk() if isinstance(n, Derivation) and not n.is_fact}
        return [used[k] for k in sorted(used)]

    def to_dict(self) -> dict:
        if self.is_fact:
            return {"fact": str(self.atom)}
        below = [p.to_dict() if isinstance(p, Derivation) else {"condition": str(p.literal), "note": p.note} for p in self.premises]
        return {"fact": str(self.atom), "rule": str(self.rule), "line": self.rule.line, "premises": below}

    def __str__(self) -> str:
        lines, todo = [], [(self, "", "")]
        while todo:
            node, lead, indent = todo.pop()
            derived = isinstance(node, Derivation)
            lines.append(lead + (f"{node.atom}   by  {node.rule}" if derived and not node.is_fact else str(node.atom) if derived else str(node)))
            below = node.premises if derived else ()
            for k in range(len(below) - 1, -1, -1):
                last = k == len(below) - 1
                todo.append((below[k], indent + ("└─ " if last else "├─ "), indent + ("   " if last else "│  ")))
        return "\n".join(lines)


def replaced(node: Any, values: dict[str, Any]) -> Any:
    """The node with values for variables; anonymous ones and an aggregate's own stay."""
    match node:
        case Var(name=name, anonymous=False) if name in values:
            return Const(values[name])
        case BinOp(op=op, left=a, right=b) | Compare(op=op, left=a, right=b):
            return type(node)(op, replaced(a, values), replaced(b, values))
        case UnaryOp(op=op, operand=inner):
            return UnaryOp(op, replaced(inner, values))
        case Atom(pred=pred, terms=terms):
            return Atom(pred, tuple(replaced(t, values) for t in terms))
        case Literal(atom=atom, negated=negated):
            return Literal(replaced(atom, values), negated)
        case Assign(var=var, expr=expr):
            return Assign(replaced(var, values), replaced(expr, values))
        case Aggregate():
            return Aggregate(replaced(node.var, values), node.op, node.expr, tuple(replaced(x, values) for x in node.body))
    return node


def keys_replaced(node: Any, values: dict[str, Any]) -> Any:
    """Like ``replaced``, with an aggregate's expression as well, so that the body can be evaluated."""
    if isinstance(node, Aggregate):
        return Aggregate(replaced(node.var, values), node.op, replaced(node.expr, values), tuple(keys_replaced(x, values) for x in node.body))
    return replaced(node, values)


class Prover:
    """``rounds[signature]``: (number, table) of every round that added to a predicate."""

    def __init__(self, db, rules: list[Rule], rounds: dict[Signature, list], given):
        self.db, self.rules, self.rounds, self.given = db, rules, rounds, given

    def tracked(self, signature: Signature, below: int):
        parts = [t.df.withColumn("_round", F.lit(g).cast("bigint")) for g, t in self.rounds.get(signature, []) if g < below]
        if not parts:
            return self.db.df(signature).limit(0).withColumn("_round", F.lit(0).cast("bigint"))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def round_of(self, signature: Signature, row: tuple) -> int | None:
        if signature not in self.db.tables:
            return None
        names = [f"a{k}" for k in range(signature[1])] or ["unit"]
        df = self.tracked(signature, 1 << 60).toDF(*names, "r")
        compiler = Compiler(self.db.spark, lambda _: df, {(signature[0], signature[1] + 1): [*compiler_kinds(self.db, signature), "int"]})
        atom = Atom(signature[0], (*map(Const, row), Var("round")))
        if not signature[1]:
            first = df.select("r").limit(1).collect()
            return first[0][0] if first else None
        frame = compiler.body([Literal(atom)], Frame(None, {}), {"round"})
        found = frame.df.agg(F.min(frame.value("round").col)).collect()[0][0]
        return found

    def prove(self, atom: Atom) -> Derivation | None:
        row = tuple(t.value for t in atom.terms)
        limit = self.round_of(atom.signature, row)
        if limit is None:
            return None
        # nodes are built bottom-up from a stack, so a long proof needs no deep recursion
        todo: list = [("open", atom.signature, row, limit)]
        done: list[Derivation] = []
        while todo:
            step = todo.pop()
            if step[0] == "close":
                _, signature, row, rule, values, shape = step
                premises = []
                for literal in reversed(shape):
                    premises.append(done.pop() if literal is None else literal)
                done.append(Derivation(self.atom_of(signature, row), rule, values, tuple(reversed(premises))))
                continue
            _, signature, row, limit = step
            rule, values, premises = self.step(signature, row, limit)
            shape = [None if isinstance(p, tuple) else p for p in premises]
            todo.append(("close", signature, row, rule, values, shape))
            todo += [("open", *p) for p in reversed(premises) if isinstance(p, tuple)]
        return done[0]

    @staticmethod
    def atom_of(signature: Signature, row: tuple) -> Atom:
        return Atom(signature[0], tuple(map(Const, row)))

    def step(self, signature: Signature, row: tuple, limit: int) -> tuple[Rule, dict, list]:
        """The first rule in order, facts before others, and its smallest premises from rounds below ``limit``."""
        mine = [r for r in self.rules if r.head.signature == signature]
        for rule in mine:
            if rule.is_fact and tuple(t.value for t in rule.head.terms) == row:
                return rule, {}, []
        if self.given(signature, row):
            return Rule(self.atom_of(signature, row)), {}, []
        for rule in mine:
            values: dict[str, Any] = {}
            fits = bool(rule.body)
            for term, value in zip(rule.head.terms, row):
                fits &= term.value == value if isinstance(term, Const) else values.setdefault(term.name, value) == value
            if fits and (found := self.solve(rule, values, limit)):
                return rule, *found
        raise DeductiveError(f"internal error: no rule derives {self.atom_of(signature, row)}")

    def solve(self, rule: Rule, values: dict[str, Any], limit: int) -> tuple[dict, list] | None:
        body, places, tables, kinds = [], [], {}, dict(self.db.types)
        for k, x in enumerate(rule.body):
            if isinstance(x, Literal) and not x.negated:
                terms = [Var(f"#any{k}.{j}") if isinstance(t, Var) and t.anonymous else replaced(t, values) for j, t in enumerate(x.atom.terms)]
                name = f"#tracked{k}"
                signature = x.atom.signature
                tables[(name, len(terms) + 1)] = self.tracked(signature, limit) if terms else self.tracked(signature, limit).select("_round")
                kinds[(name, len(terms) + 1)] = [*compiler_kinds(self.db, signature), "int"]
                body.append(Literal(Atom(name, (*terms, Var(f"#round{k}")))))
                places.append((k, signature, terms))
            else:
                body.append(keys_replaced(x, values))
        compiler = Compiler(self.db.spark, lambda s: tables[s] if s in tables else self.db.df(s), kinds)
        free = {v.name for x in body for v in (variables_in(x.var) if isinstance(x, Aggregate) else variables_in(x)) if not v.anonymous}
        frame = compiler.unit(compiler.body(body, Frame(None, {}), free))
        order = [frame.value(t.name).col for _, _, terms in places for t in terms if isinstance(t, Var)]
        rows = (frame.df.orderBy(*order) if order else frame.df).limit(1).collect()
        if not rows:
            return None
        found = {n: plain(rows[0][c], t) for n, (c, t) in frame.vars.items()}
        solution = values | {n: v for n, v in found.items() if not n.startswith("#")}
        at = {k: (signature, tuple(t.value if isinstance(t, Const) else found[t.name] for t in terms), found[f"#round{k}"]) for k, signature, terms in places}
        out = []
        for k, x in enumerate(rule.body):
            if k in at:
                out.append(at[k])
            else:
                out.append(Condition(replaced(x, solution), "(no such fact)" if isinstance(x, Literal) else ""))
        return solution, out


def compiler_kinds(db, signature: Signature) -> list[str]:
    return [t or "str" for t in db.types.get(signature, [None] * signature[1])]
