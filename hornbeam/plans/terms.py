"""Programs as trees: terms, literals, rules, queries, and how they print."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

Signature = tuple[str, int]
_BARE = re.compile(r"[a-z][A-Za-z0-9_]*\Z")
_ESCAPED = str.maketrans({"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r"})


def format_value(value: Any) -> str:
    """A value as the language writes it; text that is no bare symbol is quoted."""
    match value:
        case bool():
            return str(value).lower()
        case str():
            return value if _BARE.match(value) else f'"{value.translate(_ESCAPED)}"'
        case float():
            return repr(value)
    return str(value)


def order_key(value: Any) -> tuple:
    """The total order: every number before every string."""
    return (0, value, "") if isinstance(value, (int, float)) else (1, 0, str(value))


@dataclass(frozen=True)
class Var:
    name: str
    anonymous: bool = False

    def __str__(self) -> str:
        return "_" if self.anonymous else self.name


@dataclass(frozen=True)
class Const:
    value: Any

    def __str__(self) -> str:
        return format_value(self.value)


@dataclass(frozen=True)
class BinOp:
    op: str
    left: Expr
    right: Expr

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class UnaryOp:
    op: str
    operand: Expr

    def __str__(self) -> str:
        return f"{self.op}{self.operand}"


Expr = Var | Const | BinOp | UnaryOp


@dataclass(frozen=True)
class Atom:
    pred: str
    terms: tuple[Var | Const, ...] = ()

    @property
    def arity(self) -> int:
        return len(self.terms)

    @property
    def signature(self) -> Signature:
        return self.pred, len(self.terms)

    def __str__(self) -> str:
        return f"{self.pred}({', '.join(map(str, self.terms))})" if self.terms else self.pred


@dataclass(frozen=True)
class Literal:
    atom: Atom
    negated: bool = False

    def __str__(self) -> str:
        return f"not {self.atom}" if self.negated else str(self.atom)


@dataclass(frozen=True)
class Compare:
    op: str
    left: Expr
    right: Expr

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


@dataclass(frozen=True)
class Assign:
    var: Var | Const
    expr: Expr

    def __str__(self) -> str:
        return f"{self.var} = {self.expr}"


@dataclass(frozen=True)
class Aggregate:
    var: Var | Const
    op: str
    expr: Expr | None
    body: tuple[BodyLiteral, ...]

    def __str__(self) -> str:
        of = f" {self.expr}" if self.expr is not None else ""
        return f"{self.var} = {self.op}{of} {{ {joined(self.body)} }}"


BodyLiteral = Literal | Compare | Assign | Aggregate


def joined(body: Iterable[BodyLiteral]) -> str:
    return ", ".join(map(str, body))


@dataclass(frozen=True)
class Rule:
    """A rule, or a fact if its body is empty. ``source`` is the rule as written, where this one is reordered."""

    head: Atom
    body: tuple[BodyLiteral, ...] = ()
    line: int = 0

    @property
    def is_fact(self) -> bool:
        return not self.body

    def __str__(self) -> str:
        return f"{self.head} :- {joined(self.body)}." if self.body else f"{self.head}."


@dataclass(frozen=True)
class Query:
    body: tuple[BodyLiteral, ...]
    line: int = 0

    def __str__(self) -> str:
        return f"?- {joined(self.body)}."


@dataclass
class Program:
    rules: list[Rule] = field(default_factory=list)
    queries: list[Query] = field(default_factory=list)

    def __str__(self) -> str:
        return "\n".join(map(str, [*self.rules, *self.queries]))


def variables_in(node: Any) -> Iterator[Var]:
    """Every variable of an expression, atom, literal or body, left to right, aggregates' bodies included."""
    match node:
        case Var():
            yield node
        case BinOp():
            yield from variables_in(node.left)
            yield from variables_in(node.right)
        case UnaryOp():
            yield from variables_in(node.operand)
        case Atom():
            yield from variables_in(node.terms)
        case Literal():
            yield from variables_in(node.atom)
        case Compare():
            yield from variables_in((node.left, node.right))
        case Assign():
            yield from variables_in((node.var, node.expr))
        case Aggregate():
            yield from variables_in((node.var, node.expr, *node.body))
        case tuple() | list():
            for part in node:
                yield from variables_in(part)


def names_in(node: Any) -> set[str]:
    return {v.name for v in variables_in(node)}


def answer_variables(body: Iterable[BodyLiteral]) -> list[str]:
    """Named variables of a query in order of appearance; those local to an aggregate are no answers."""
    body = tuple(body)
    visible = {v.name for x in body for v in variables_in((x.var,) if isinstance(x, Aggregate) else x)}
    found = (v.name for v in variables_in(body) if not v.anonymous and v.name in visible)
    return list(dict.fromkeys(found))


def reads(body: Iterable[BodyLiteral]) -> Iterator[tuple[Signature, bool]]:
    """(signature, strictly): the predicates a body reads; negation and aggregates need them complete."""
    for literal in body:
        if isinstance(literal, Literal):
            yield literal.atom.signature, literal.negated
        elif isinstance(literal, Aggregate):
            for signature, _ in reads(literal.body):
                yield signature, True
