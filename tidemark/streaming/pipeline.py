"""Sessions, table handles and models: source table in, transform, sink table out."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.operators.latest import dedup_latest, row_wise
from tidemark.sources.adapters import DeltaFormat, IcebergFormat
from tidemark.sources.log_table import ANY, LogTable
from tidemark.sources.table_format import OFFSET, TableFormat
from tidemark.streaming.checkpoint import JsonCheckpointStore, SinkCheckpointStore
from tidemark.streaming.consumer import Consumer


def frame(spark: SparkSession, data: Any) -> DataFrame:
    """A DataFrame of a DataFrame, an Arrow table or a pandas frame."""
    return data if isinstance(data, DataFrame) else spark.createDataFrame(data)


class TableHandle:
    """A table by name, its offsets out of sight."""

    def __init__(self, session: Session, identifier: str):
        self.session, self.identifier = session, identifier

    @property
    def format(self) -> TableFormat:
        return self.session.source(self.identifier)

    def source(self) -> TableFormat:
        return self.format

    def write(self, data: Any) -> TableHandle:
        """Append rows; the first ones make the table, with an offset column in front."""
        self.format.append(frame(self.session.spark, data))
        return self

    def read(self) -> DataFrame:
        table = self.format
        return table.read() if hasattr(table, "read") else table.read_all().drop(OFFSET)


class Pipeline:
    """Moves what is new in a source through a transform into a sink.

    ``append`` adds the transform's rows; ``upsert`` keeps the last of each ``key`` in a batch and merges by
    key. With positions in the sink, rows and position are one commit, and the commit expects the position that
    the batch began at, so two runs of one name cannot both write it. ``order_by`` names the column that
    tells rows of one key apart in time; without it an upsert's transform must be made of projections and filters
    of its input, since it is then the source's order that counts, and the batch is sorted by offset.
    """

    def __init__(self, source: TableFormat, sink: TableFormat, transform: Callable[[DataFrame], Any], name: str, start: str | int = "latest",
                 checkpoint=None, mode: str = "append", key: str | list[str] | None = None, on_change: str = "warn", order_by: str | None = None):
        if mode not in ("append", "upsert"):
            raise ValueError(f"mode must be append or upsert, not {mode!r}")
        keys = [key] if isinstance(key, str) else list(key or [])
        if mode == "upsert" and not keys:
            raise ValueError("mode upsert requires key: a column or a list of columns")
        self.source, self.sink, self.transform, self.name = source, sink, transform, name
        self.mode, self.keys, self.order_by = mode, keys, order_by
        self.in_sink = checkpoint is None
        self.consumer = Consumer(source, name, SinkCheckpointStore(sink) if self.in_sink else checkpoint, start=start, on_change=on_change)

    def _rows(self, batch: DataFrame) -> DataFrame:
        ordered = batch.orderBy(OFFSET) if self.mode == "upsert" and self.order_by is None else batch
        given = ordered.drop(OFFSET)
        out = frame(batch.sparkSession, self.transform(given))
        if self.mode == "upsert":
            if self.order_by is None and not row_wise(given, out):
                raise ValueError(f"{self.name}: the transform is more than projections and filters, so the last row of a key cannot be told; give order_by")
            out = dedup_latest(out, self.keys, self.order_by)
        return out

    def step(self) -> int:
        """One batch; the number of source rows read, 0 if nothing is new."""
        before = self.consumer.position()
        batch = self.consumer.poll()
        if batch is None:
            return 0
        n = self.source.count_since(before, batch.offset) if hasattr(self.source, "count_since") else batch.num_rows
        few = hasattr(self.source, "small") and self.source.small(before, batch.offset)
        rows = self._rows(batch.data.coalesce(1) if few else batch.data)  # a small batch is one task and one file
        stored = self.sink.read_offsets().get(self.name) if self.in_sink else None
        own = stored is None or stored == before or (before is None and stored < 0)
        offsets = self.consumer.stored(batch.offset) if self.in_sink else None
        # A position that seek() moved is written over whatever the sink has.
        expect = {self.name: stored if own else ANY} if self.in_sink else None
        if self.mode == "upsert":
            self.sink.upsert(rows, self.keys, offsets, expect)
        else:
            self.sink.append(rows, offsets, expect)
        self.consumer.seek(batch.offset)
        if not self.in_sink:
            self.consumer.save()
        return n

    def run(self, once: bool = False, idle_sleep: float = 1.0, max_batches: int | None = None) -> int:
        """Steps until stopped, or one, or ``max_batches`` that had rows; rows read in all."""
        total = batches = 0
        while True:
            n = self.step()
            total, batches = total + n, batches + (n > 0)
            if once or (max_batches and batches >= max_batches):
                return total
            if not n:
                time.sleep(idle_sleep)


class Model:
    """A registered pipeline."""

    def __init__(self, pipeline: Pipeline, source: str, sink: str):
        self.pipeline, self.source, self.sink, self.name = pipeline, source, sink, pipeline.name

    def run(self, **how) -> int:
        return self.pipeline.run(**how)

    def step(self) -> int:
        return self.pipeline.step()

    def position(self) -> int | None:
        return self.pipeline.consumer.position()

    def lag(self) -> int:
        return self.pipeline.consumer.lag()

    def seek(self, offset: int | None) -> None:
        self.pipeline.consumer.seek(offset)

    def reset(self) -> None:
        self.pipeline.consumer.reset()


class Session:
    """A warehouse, where positions are kept, and the models defined so far."""

    def __init__(self, spark: SparkSession, resolve: Callable[[str], TableFormat], checkpoint=None):
        self.spark, self._open, self.checkpoint = spark, resolve, checkpoint
        self.models: dict[str, Model] = {}
        self._tables: dict[str, TableFormat] = {}

    def source(self, table: str | TableFormat) -> TableFormat:
        """The table of a name; a table stays itself."""
        if not isinstance(table, str):
            return table
        if table not in self._tables:
            self._tables[table] = self._open(table)
        return self._tables[table]

    def table(self, identifier: str) -> TableHandle:
        return TableHandle(self, identifier)

    def write(self, identifier: str, data: Any) -> TableHandle:
        return self.table(identifier).write(data)

    def exists(self, identifier: str) -> bool:
        return self.source(identifier).exists()

    def create(self, identifier: str, schema: T.StructType | str) -> TableFormat:
        """An empty table with these columns; put ``_offset long`` among them to have offsets."""
        if isinstance(schema, str):
            schema = self.spark.createDataFrame([], schema).schema
        table = self.source(identifier)
        table.create(schema)
        return table

    def model(self, source: str | TableFormat, sink: str | TableFormat, start: str | int = "latest", mode: str = "append", key=None, on_change: str = "warn", order_by: str | None = None, name: str | None = None):
        """Decorator: the function, from the batch's columns to the sink's, becomes a model of its name."""

        def made(transform: Callable[[DataFrame], Any]) -> Model:
            p = Pipeline(self.source(source), self.source(sink), transform, name or transform.__name__, start, self.checkpoint, mode, key, on_change, order_by)
            self.models[p.name] = Model(p, str(source), str(sink))
            return self.models[p.name]

        return made

    def ordered(self) -> list[Model]:
        """Models so that each comes after those that write its source; else as defined."""
        left, out = list(self.models.values()), []
        while left:
            ready = next((m for m in left if not any(o is not m and o.sink == m.source for o in left)), left[0])
            left.remove(ready)
            out.append(ready)
        return out

    def run_all(self, once: bool = True, idle_sleep: float = 1.0) -> int:
        """A batch of each model, or rounds of them until stopped; rows read."""
        total = 0
        while True:
            n = sum(m.step() for m in self.ordered())
            total += n
            if once:
                return total
            if not n:
                time.sleep(idle_sleep)


def table_path(warehouse: str, identifier: str) -> str:
    """``a.b`` is the folder a/b of the warehouse; a name without a dot is in ``default``."""
    space, _, name = identifier.rpartition(".")
    return "/".join([warehouse.rstrip("/"), *(space or "default").split("."), name])


def connect(spark: SparkSession, warehouse: str, uri: str | None = None, checkpoint: str = "sink", name: str | None = None, format: str = "log", catalog: str | None = None, **options) -> Session:
    """Open a warehouse.

    ``format``: ``log`` (this library's own tables), ``delta`` (paths, needs Spark's Delta package) or ``iceberg``
    (tables of the Spark catalog ``name``; ``catalog`` is its type, ``uri`` its address). ``options`` become options
    of the reader and writer, or of the catalog. ``checkpoint``: ``sink`` or ``json`` (a file in the warehouse, or the path given after ``json:``).
    """
    if format == "log":
        resolve = lambda i: LogTable(spark, table_path(warehouse, i))
    elif format == "delta":
        resolve = lambda i: DeltaFormat(spark, table_path(warehouse, i), **options)
    elif format == "iceberg":
        name = name or "tidemark"
        prefix = f"spark.sql.catalog.{name}"
        spark.conf.set(prefix, "org.apache.iceberg.spark.SparkCatalog")
        for k, v in {"type": {None: "hadoop", "sql": "jdbc"}.get(catalog, catalog), "warehouse": warehouse, "uri": uri, **options}.items():
            if v is not None:
                spark.conf.set(f"{prefix}.{k}", v)
        resolve = lambda i: IcebergFormat(spark, f"{name}.{i if '.' in i else 'default.' + i}")
    else:
        raise ValueError(f"format must be log, delta or iceberg, not {format!r}")
    return Session(spark, resolve, _store(spark, checkpoint, warehouse))


def _store(spark: SparkSession, checkpoint: str, warehouse: str):
    if checkpoint == "sink":
        return None
    kind, _, path = checkpoint.partition(":")
    if kind != "json":
        raise ValueError(f"checkpoint must be sink or json, not {checkpoint!r}")
    return JsonCheckpointStore(path or f"{warehouse.rstrip('/')}/checkpoints.json", spark)


def session(spark: SparkSession, resolve: Callable[[str], TableFormat] | str, checkpoint: str | JsonCheckpointStore = "checkpoints.json", checkpoint_mode: str = "json") -> Session:
    """A session over tables of your own: ``resolve`` opens a name, or is a warehouse folder."""
    if isinstance(resolve, str):
        base = resolve
        resolve = lambda i: LogTable(spark, table_path(base, i))
    if checkpoint_mode not in ("json", "sink"):
        raise ValueError(f"checkpoint_mode must be json or sink, not {checkpoint_mode!r}")
    store = None if checkpoint_mode == "sink" else JsonCheckpointStore(checkpoint, spark) if isinstance(checkpoint, str) else checkpoint
    return Session(spark, resolve, store)
