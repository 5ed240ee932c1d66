"""What can go wrong."""


class GraphmillError(Exception):
    """Base of all errors raised here."""


class ParseError(GraphmillError):
    """The query text is not a valid expression."""


class EvaluationError(GraphmillError):
    """The expression is well formed but means nothing."""


class NotFound(GraphmillError):
    """No row with this key."""


class AlreadyExists(GraphmillError):
    """A row with this key exists."""


class ShelfError(GraphmillError):
    """A shelf is not connected, or already is."""


class ModelUnavailable(GraphmillError):
    """No embedding model is configured."""


class ValidationError(GraphmillError):
    """An argument is out of range."""


class ConfigurationError(GraphmillError):
    """A setting that a cluster needs is missing."""
