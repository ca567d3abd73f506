"""Errors of the SQL dialect. Engine.execute turns each into a message with its prefix."""


class LoomError(Exception):
    prefix = "Error"


class ParseError(LoomError):
    prefix = "Parse error"


class PlanError(LoomError):
    """A name or an operation that has no meaning on the tables at hand."""

    prefix = "Plan error"


class ExecutionError(LoomError):
    prefix = "Execution error"
