"""A named cursor over a table's offsets."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark.sources.table_format import MARKER, TableFormat
from tidemark.streaming.checkpoint import START

log = logging.getLogger("tidemark")


@dataclass
class Batch:
    """Rows after a position, offsets included, and the greatest offset among them."""

    data: DataFrame
    offset: int

    def arrow(self):
        return self.data.toArrow()

    def pandas(self):
        return self.data.toPandas()

    @property
    def num_rows(self) -> int:
        return self.data.count()


class Consumer:
    """``poll`` gives what came since the position, ``commit`` moves it there and stores it.

    ``start`` counts only where nothing is stored: ``earliest``, ``latest`` (of now; an empty source:
    everything) or the offset to start after. ``on_change`` tells what to do when the source changed rows that
    a cursor over offsets cannot see: ``warn`` once for each change found, raise (``error``), or ``ignore``. The place
    in the history up to which changes were seen is stored with the position,
    so changes between two processes are found.
    """

    def __init__(self, source: TableFormat, name: str, checkpoint, start: str | int = "latest", delivery: str = "exactly_once", on_change: str = "warn"):
        if on_change not in ("warn", "error", "ignore"):
            raise ValueError(f"on_change must be warn, error or ignore, not {on_change!r}")
        self.source, self.name, self.checkpoint, self.on_change = source, name, checkpoint, on_change
        stored = checkpoint.get(name)
        self._offset = self._resolve(start) if stored is None else stored if stored > START else None
        self._pending: int | None = None
        seen = checkpoint.get(self.marker_name) if stored is not None else None
        self._marker = source.marker() if seen is None else seen
        if stored is None and start == "latest" and self._offset is not None:
            self.save()  # what was the latest when this name first read

    @property
    def marker_name(self) -> str:
        return f"{MARKER}{self.name}"

    def _resolve(self, start: str | int) -> int | None:
        if start == "earliest":
            return None
        if start == "latest":
            return self.source.latest_offset()
        if isinstance(start, int) and not isinstance(start, bool):
            return start
        raise ValueError(f"start must be earliest, latest or an offset, not {start!r}")

    def _check(self) -> None:
        if self.on_change == "ignore":
            return
        ops, self._marker = self.source.changes_since(self._marker)
        if not ops:
            return
        said = f"{self.name}: the source changed rows in place ({', '.join(sorted(set(ops)))}); a cursor over offsets cannot capture that. Reprocess with reset(), or read the changes with read_changes()"
        if self.on_change == "error":
            raise RuntimeError(said)
        log.warning(said)

    def poll(self) -> Batch | None:
        """All rows after the position, or None. The position stays until :meth:`commit`."""
        self._check()
        data, top = self.source.read_since(self._offset)
        if top is None or top == self._offset:
            return None
        self._pending = top
        return Batch(data, top)

    def commit(self) -> None:
        if self._pending is not None:
            self._offset, self._pending = self._pending, None
            self.save()

    def save(self) -> None:
        """Store the position and the marker as they are, together where the store can."""
        if hasattr(self.checkpoint, "set_all"):
            self.checkpoint.set_all(self.stored(self._offset))
        else:
            self.checkpoint.set(self.name, self._offset)

    def stored(self, offset: int | None) -> dict[str, int]:
        """What a commit of the sink has to carry for this consumer to be at ``offset``."""
        return {self.name: offset} | ({} if self._marker is None else {self.marker_name: self._marker})

    def position(self) -> int | None:
        return self._offset

    def lag(self) -> int:
        """How far the source's newest offset is ahead; 0 for an empty source."""
        latest = self.source.latest_offset()
        return 0 if latest is None else max(0, latest - (START if self._offset is None else self._offset))

    def seek(self, offset: int | None) -> None:
        """Go to a position, in memory only."""
        self._offset, self._pending = offset, None

    def reset(self) -> None:
        self.seek(None)
