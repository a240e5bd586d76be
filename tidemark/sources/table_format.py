"""What the control layer needs of a table; any format that has it can be a source or sink."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame

OFFSET = "_offset"
#: Stored names that begin so are places in a source's history, not positions.
MARKER = "marker:"


@runtime_checkable
class TableFormat(Protocol):
    """A table as a log: rows with a growing int64 offset, and commits that carry
    the positions of named readers with the data."""

    def read_since(self, offset: int | None, hi: int | None = None) -> tuple[DataFrame, int | None]:
        """Rows with ``offset < _offset <= hi``, and the greatest offset among them (else ``offset``)."""

    def read_all(self) -> DataFrame: ...

    def earliest_offset(self) -> int | None: ...

    def latest_offset(self) -> int | None: ...

    def append(self, data: DataFrame, offsets: dict[str, int] | None = None) -> None:
        """Add rows and positions in one atomic commit."""

    def upsert(self, data: DataFrame, keys: list[str], offsets: dict[str, int] | None = None) -> None: ...

    def read_offsets(self) -> dict[str, int]: ...

    def marker(self) -> int | None:
        """A place in the commit history."""

    def changes_since(self, marker: int | None) -> tuple[list[str], int | None]:
        """Commits after ``marker`` that changed rows in place, and the new marker."""


class CommitConflict(Exception):
    """Another writer published this version first; the commit may be tried again."""


class StaleWriter(Exception):
    """Another writer of this name has moved its position since this one read it."""
