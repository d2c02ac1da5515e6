"""What retrieval refuses."""


class RetrievalError(ValueError):
    """Base of the errors of this package."""


class EmptyQuery(RetrievalError):
    """A query has no terms."""


class EmptyIndex(RetrievalError):
    """The index has no documents."""


class InvalidParameter(RetrievalError):
    """A parameter is out of range."""


class DimensionMismatch(RetrievalError):
    """A vector has another length than the index."""
