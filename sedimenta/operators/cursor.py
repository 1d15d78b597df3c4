"""Row-by-row reading of an ordered result on the driver."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row

from ..errors import ExhaustedError, NotPositionedError


class Cursor:
    """``next`` moves, ``get`` reads; partitions are fetched one at a time, as they are needed."""

    def __init__(self, df: DataFrame | None):
        self._rows: Iterator[Row] | None = df.toLocalIterator() if df is not None else iter(())
        self._at: Row | None = None

    def next(self) -> bool:
        """Moves to the next row; False at the end, and ever after."""
        if self._rows is None:
            raise ExhaustedError("the cursor was closed")
        self._at = next(self._rows, None)
        if self._at is None:
            self._rows = iter(())
            self._ended = True
        return self._at is not None

    def get(self) -> Row:
        if self._rows is None or getattr(self, "_ended", False):
            raise ExhaustedError("the cursor is past its end")
        if self._at is None:
            raise NotPositionedError("the cursor must be moved to a row first")
        return self._at

    def close(self) -> None:
        self._rows = self._at = None

    def __iter__(self) -> Iterator[Row]:
        while self._rows is not None and self.next():
            yield self.get()
