"""Error classes raised before any Spark job is planned."""


class ReactorLakeError(Exception):
    """Base class."""


class ValidationError(ReactorLakeError):
    """Bad arguments: unknown dataset, bad dates, bad paging values."""


class DataNotFoundError(ReactorLakeError):
    """A dataset, table or snapshot does not exist."""


class ProcessingError(ReactorLakeError):
    """A dataset exists but could not be read or written."""
