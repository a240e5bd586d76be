"""Where the positions of named readers are kept."""

from __future__ import annotations

import json
import threading

from pyspark.sql import SparkSession

from tidemark.sources.log_store import store_for
from tidemark.sources.table_format import MARKER, TableFormat

#: The position before the first row; "never committed" is None.
START = -1


class JsonCheckpointStore:
    """Positions in one JSON file. A crash between a write of rows and of its position repeats the rows.

    The path may be a URI of any file system of ``spark``.
    """

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.store, self.path = store_for(spark, path)
        self._lock = threading.Lock()

    def _load(self) -> dict[str, int]:
        data = self.store.read(self.path)
        return {} if data is None else json.loads(data)

    def get(self, name: str) -> int | None:
        return self._load().get(name)

    def set(self, name: str, offset: int | None) -> None:
        self.set_all({name: offset})

    def set_all(self, offsets: dict[str, int | None]) -> None:
        with self._lock:
            data = self._load() | {k: START if v is None else v for k, v in offsets.items()}
            self.store.replace(self.path, json.dumps(data).encode())


class SinkCheckpointStore:
    """Positions in the sink's commits, where an append puts them with its rows."""

    def __init__(self, sink: TableFormat):
        self.sink = sink

    def get(self, name: str) -> int | None:
        if name.startswith(MARKER):
            return self.sink.read_markers().get(name) if hasattr(self.sink, "read_markers") else None
        return self.sink.read_offsets().get(name)

    def set(self, name: str, offset: int | None) -> None:
        self.set_all({name: offset})

    def set_all(self, offsets: dict[str, int | None]) -> None:
        self.sink.commit_offsets({k: START if v is None else v for k, v in offsets.items()})
