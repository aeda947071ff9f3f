"""Errors that queries raise while their plan is built."""


class QueryError(ValueError):
    """A request that cannot be planned."""


class InvalidTimeRange(QueryError):
    """The start of a range lies after its end."""


class SeriesNotFound(QueryError):
    """A strict request names a series without points."""


class CodecError(ValueError):
    """Bytes that no encoder wrote, or values that the format has no room for."""
