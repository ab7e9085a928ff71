"""Errors that name the user's mistake; everything else is a bug."""


class LedgerError(Exception):
    """Base of all."""


class ConfigError(LedgerError):
    """A rule set or option that doesn't make sense."""


class IngestError(LedgerError):
    """A file that can't be read as what it is said to be."""


class ReportError(LedgerError):
    """A report that can't be built from what is there."""
