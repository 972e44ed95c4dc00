"""Errors raised on the driver; inside plans a failure becomes a status and error column."""


class DocloomError(Exception):
    """Base of the library's errors."""


class ConfigError(DocloomError):
    """A setting is missing or out of range."""


class ParserNotFoundError(DocloomError):
    """No parser is registered, or its library isn't installed."""


class ParseError(DocloomError):
    """A file could not be read as what its extension says."""


class ChunkingError(DocloomError):
    """Chunk parameters are invalid."""


class EmbeddingError(DocloomError):
    """Vectors are missing, too many or of the wrong length."""


class FormatError(DocloomError):
    """A model's reply is not a valid format result."""


class StorageError(DocloomError):
    """The index can't be read or written."""
