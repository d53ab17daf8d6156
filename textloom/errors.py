"""Typed errors raised by the library."""


class TextloomError(Exception):
    """Base class of all library errors."""


class EmptyCorpusError(TextloomError):
    """An ingest or preview input holds no documents."""


class SetNotFoundError(TextloomError):
    """The catalogue has no live entry for a set id."""


class DocumentNotFoundError(TextloomError):
    """Documents were asked for that the corpus does not hold."""


class UnknownEmbedderError(TextloomError):
    """No embedder is registered under a name."""


class IdentityError(TextloomError):
    """Documents are identified in another way than those of the set."""


class DimensionError(TextloomError):
    """A vector does not have the declared number of dimensions."""
