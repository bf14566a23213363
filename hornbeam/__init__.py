"""Deductive queries on Spark: facts, rules and queries, evaluated as DataFrame plans."""

from .engine import Engine, QueryResult, Relation, solve
from .errors import DeductiveError, EvaluationError, ParseError, SafetyError, StratificationError
from .operators.maintenance import Delta
from .operators.proofs import Condition, Derivation
from .plans.parser import parse
from .plans.terms import Aggregate, Assign, Atom, BinOp, Compare, Const, Literal, Program, Query, Rule, UnaryOp, Var, format_value

__version__ = "0.1.0"
__all__ = [
    "Aggregate", "Assign", "Atom", "BinOp", "Compare", "Condition", "Const", "DeductiveError", "Delta", "Derivation", "Engine",
    "EvaluationError", "Literal", "ParseError", "Program", "Query", "QueryResult", "Relation", "Rule", "SafetyError",
    "StratificationError", "UnaryOp", "Var", "__version__", "format_value", "parse", "solve",
]
