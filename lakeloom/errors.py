"""Errors of the catalog."""


class CatalogError(Exception):
    """Any failure of a catalog operation."""


class InvalidArgument(CatalogError, ValueError):
    pass


class NotFound(CatalogError):
    pass


class AlreadyExists(CatalogError):
    pass


class NotEmpty(CatalogError):
    pass


class SealFailure(CatalogError):
    """A file that was to be created exists already."""


class ReadFailure(CatalogError):
    pass


class TransactionClosed(CatalogError):
    pass


class NothingToCommit(CatalogError):
    pass


class CommitConflict(CatalogError):
    """A committed change can't be reconciled with this transaction's."""


class AttemptsExhausted(CatalogError):
    pass


class Expired(CatalogError):
    """The transaction outlived its time to live."""
