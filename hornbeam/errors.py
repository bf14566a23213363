"""What can go wrong, from reading a program to evaluating it."""

from __future__ import annotations


class DeductiveError(Exception):
    """Any error of this package."""


class ParseError(DeductiveError):
    """The text is no program; says where."""

    def __init__(self, message: str, line: int = 0, col: int = 0, source_name: str | None = None):
        self.message, self.line, self.col, self.source_name = message, line, col, source_name
        place = f"{source_name or '<input>'}:{line}:{col}" if line else source_name or "<input>"
        super().__init__(f"{place}: {message}")


class SafetyError(DeductiveError):
    """A variable would range over infinitely many values."""


class StratificationError(DeductiveError):
    """A predicate depends on its own negation or aggregate."""


class EvaluationError(DeductiveError):
    """A value has the wrong type, a division is by zero, or a guard stopped the evaluation."""
