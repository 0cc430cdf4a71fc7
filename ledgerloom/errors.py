"""Errors that callers can tell apart."""


class LedgerError(Exception):
    """Anything wrong with the transaction ledger."""


class LedgerNotFoundError(LedgerError):
    """The ledger's files are not there, or hold no row."""


class LedgerSchemaError(LedgerError):
    """The ledger lacks columns or can't be parsed."""


class AccountsError(Exception):
    """Anything wrong with the account dimension."""


class AccountsNotFoundError(AccountsError):
    """The dimension's files are not there, or hold no row."""


class AccountsSchemaError(AccountsError):
    """The dimension lacks columns or can't be parsed."""


class DuplicateAccountKeyError(AccountsError):
    """A join would multiply transactions, as an account key stands twice."""


class SplitError(Exception):
    """A split is empty, holds no positive, or overlaps a later one."""


class TuningError(Exception):
    """Tuning settings are missing or malformed."""


class RowCountError(Exception):
    """A step that has to keep every row has lost or multiplied some."""


class ModelUnavailableError(Exception):
    """A model can't be fitted here, as a library that it needs isn't installed."""


class NoRunError(Exception):
    """The run store has no run that may be chosen."""
