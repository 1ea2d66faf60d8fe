"""Errors that callers may want to tell apart."""


class TidemarkError(Exception):
    """The base of all errors of this library."""


class MissingMetricConfig(TidemarkError):
    """No configuration, exact or by prefix, holds for the metric."""


class AccessError(TidemarkError):
    """The metric's mode doesn't allow the operation."""


class DuplicateMetric(TidemarkError):
    """The metric is in the catalog already."""


class OutOfOrder(TidemarkError, ValueError):
    """A point's time is 0, or not after that of the point before it."""


class FormatError(TidemarkError):
    """A binary file isn't what its preamble should say."""
