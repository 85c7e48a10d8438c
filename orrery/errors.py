"""Errors of the engine, over Spark's own analysis errors."""


class EngineError(Exception):
    """Base of all."""


class SqlError(EngineError):
    """The text isn't accepted."""


class PlanError(EngineError):
    """A name or a shape of a plan is wrong."""


class TypeMismatch(EngineError):
    """Operands don't fit together."""


class Unsupported(EngineError):
    """Known, but not offered."""


class CapExceeded(EngineError):
    """A safety cap was reached."""
