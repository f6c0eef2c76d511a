"""Errors of this engine."""


class EngineError(ValueError):
    """The base of all."""


class ParseError(EngineError):
    """A statement or filter can't be read."""


class QueryError(EngineError):
    """A statement can't be run: unknown variables, too many hops."""


class NodeNotFound(EngineError):
    pass


class NodeExists(EngineError):
    pass


class DimensionMismatch(EngineError):
    pass


class InvalidVector(EngineError):
    pass


class PayloadTooLarge(EngineError):
    pass


class CorruptedFile(EngineError):
    """A stored version is missing or can't be read."""


class InvalidInput(EngineError):
    pass
