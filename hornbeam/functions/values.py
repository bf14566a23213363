"""Values in columns: static types, the total order, comparisons and arithmetic.

A column holds integers (``int``, BIGINT), quotients of integers (``rat``, DOUBLE, whole
ones print as integers), other numbers (``num``, DOUBLE), text (``str``), or a mix of
numbers and text (``any``). The mix is a struct whose fields compare in the
language's order: kind first, every number before every text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EvaluationError

MIX = "struct<k:tinyint,n:double,s:string>"
SQL = {"int": "bigint", "rat": "double", "num": "double", "str": "string", "any": MIX}
_LADDER = ("int", "rat", "num")
#: Marks messages of this package inside Spark's errors.
MARK = "hornbeam: "


def join(a: str | None, b: str | None) -> str | None:
    """The least type that holds values of both."""
    if a is None or b is None or a == b:
        return a or b
    if a in _LADDER and b in _LADDER:
        return max(a, b, key=_LADDER.index)
    return "any"


def type_of(value: Any) -> str:
    if isinstance(value, (bool, str)):
        return "str"
    return "int" if isinstance(value, int) else "num"


def type_of_column(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "int"
    return "num" if isinstance(kind, T.NumericType) else "str"


@dataclass(frozen=True)
class Value:
    """A column and its static type."""

    col: Column
    type: str

    def to(self, type_: str) -> Column:
        if self.type == type_ or {self.type, type_} == {"rat", "num"}:
            return self.col
        if type_ == "any":
            if self.type == "str":
                return F.struct(F.lit(1).cast("tinyint").alias("k"), F.lit(0.0).alias("n"), self.col.alias("s"))
            return F.struct(F.lit(0).cast("tinyint").alias("k"), self.col.cast("double").alias("n"), F.lit("").alias("s"))
        return self.col.cast(SQL[type_])


def constant(value: Any) -> Value:
    if isinstance(value, bool):
        value = str(value).lower()
    if isinstance(value, int) and not -(1 << 63) <= value < 1 << 63:
        raise EvaluationError(f"the integer {value} does not fit in 64 bits")
    kind = type_of(value)
    return Value(F.lit(value).cast(SQL[kind]), kind)


def plain(raw: Any, type_: str) -> Any:
    """What a collected cell is as a value of the language."""
    if type_ == "any":
        return raw["s"] if raw["k"] else plain(raw["n"], "rat")
    if type_ == "rat" and raw is not None and raw == raw and abs(raw) != float("inf") and raw == int(raw):
        return int(raw)
    return raw


def cell(value: Any, type_: str) -> Any:
    """A value as it is stored in a column of this type."""
    if isinstance(value, bool):
        value = str(value).lower()
    if type_ == "any":
        return {"k": 1, "n": 0.0, "s": value} if isinstance(value, str) else {"k": 0, "n": float(value), "s": ""}
    return float(value) if type_ in ("rat", "num") else value


def as_text(mixed: Column) -> Column:
    """A mixed column as text, whole numbers without a point."""
    n = mixed["n"]
    number = F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string"))
    return F.when(mixed["k"] == 1, mixed["s"]).otherwise(number)


def _numeric(t: str) -> bool:
    return t in _LADDER


_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def compare(op: str, a: Value, b: Value) -> Column:
    """A comparison under the total order; between a number and a text it is known beforehand."""
    if _numeric(a.type) and b.type == "str":
        return F.lit(op in ("!=", "<", "<="))
    if a.type == "str" and _numeric(b.type):
        return F.lit(op in ("!=", ">", ">="))
    common = join(a.type, b.type) or "str"
    return _COMPARE[op](a.to(common), b.to(common))


def fail(message: str, type_: str) -> Column:
    return F.raise_error(F.lit(MARK + message)).cast(SQL[type_])


def _number(v: Value, op: str) -> Value:
    """The value as a number; anything else is an error when a row gets there."""
    if _numeric(v.type):
        return v
    wrong = f"operator '{op}' needs a number but got "
    if v.type == "str":
        return Value(F.raise_error(F.concat(F.lit(MARK + wrong), F.coalesce(v.col, F.lit("null")))).cast("double"), "num")
    return Value(F.when(v.col["k"] == 0, v.col["n"]).otherwise(F.raise_error(F.concat(F.lit(MARK + wrong), v.col["s"])).cast("double")), "rat")


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if op == "+":
        if a.type == b.type == "str":
            return Value(F.concat(a.col, b.col), "str")
        if "any" in (a.type, b.type):
            x, y = a.to("any"), b.to("any")
            text = F.struct(F.lit(1).cast("tinyint").alias("k"), F.lit(0.0).alias("n"), F.concat(x["s"], y["s"]).alias("s"))
            number = F.struct(F.lit(0).cast("tinyint").alias("k"), (x["n"] + y["n"]).alias("n"), F.lit("").alias("s"))
            both = F.when((x["k"] == 1) & (y["k"] == 1), text).when((x["k"] == 0) & (y["k"] == 0), number)
            return Value(both.otherwise(fail("operator '+' needs two numbers or two strings", "any")), "any")
    a, b = _number(a, op), _number(b, op)
    kind = join(a.type, b.type) or "num"
    x, y = a.to(kind), b.to(kind)
    if op == "+":
        return Value(x + y, kind)
    if op == "-":
        return Value(x - y, kind)
    if op == "*":
        return Value(x * y, kind)
    if op == "/":
        kind = "rat" if kind == "int" else kind
        return Value(F.when(y == 0, fail("division by zero", "rat")).otherwise(x.cast("double") / y.cast("double")), kind)
    rest = x % y  # of the dividend's sign in Spark, of the divisor's here
    floor = F.when((rest != 0) & ((rest < 0) != (y < 0)), rest + y).otherwise(rest)
    return Value(F.when(y == 0, fail("division by zero", kind)).otherwise(floor), kind)


def exact_quotient(a: Value, by: int) -> Value:
    """a / by for an integer column known to be a multiple of ``by``."""
    return Value(F.call_function("div", a.col, F.lit(by).cast("bigint")), "int")


def negative(a: Value) -> Value:
    a = _number(a, "-")
    return Value(-a.col, a.type)
