"""What can go wrong in building or running a query."""


class EngineError(Exception):
    """Base of all errors of the engine."""


class InvalidQueryError(EngineError, ValueError):
    """An argument that no query can have, such as a chunk size of 0."""


class IteratorExhaustedError(EngineError):
    """A source that can be read once is read again."""


class ExecutionError(EngineError):
    """A query failed while it ran."""


class InvalidStateError(EngineError):
    """An operator that the query's state doesn't allow (in strict mode), or that a stream can't have."""


class TypeMismatchError(EngineError, TypeError):
    """An argument of a kind that the operator doesn't take."""
