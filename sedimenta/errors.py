"""Everything that the key/value engine raises."""

from __future__ import annotations


class StoreError(Exception):
    """Base of all errors of the engine."""


class OptionsError(StoreError):
    """The options break one or more rules; ``problems`` names every one of them."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


class EmptyKeyError(StoreError, ValueError):
    """A key is missing or empty."""


class EmptyValueError(StoreError, ValueError):
    """A value is missing or empty; only a delete leaves a key without a value."""


class KeyTooLargeError(StoreError, ValueError):
    """A key is longer than the options allow."""


class ValueTooLargeError(StoreError, ValueError):
    """A value is longer than the options allow."""


class BadRangeError(StoreError, ValueError):
    """The start of a range must come before its end."""


class ClosedError(StoreError):
    """The table was closed; it takes no more mutations."""


class NotPositionedError(StoreError):
    """A cursor was read before it was moved to its first row."""


class ExhaustedError(StoreError):
    """A cursor was moved or read past its end, or after it was closed."""


class NoSuchLevelError(StoreError, IndexError):
    """There is no level of that number."""


class SnapshotError(StoreError):
    """A snapshot file can't be read."""


class ConflictError(StoreError):
    """Another writer published the version that this one was about to publish."""
