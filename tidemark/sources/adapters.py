"""Tables of other formats, where Spark has their packages.

They need jars that are not part of Spark; making one without them raises. Neither could be run where this was
written: what is tested is the part that they share, over a stand-in for a table, and each says so when it is made.

Both read ranges by a filter on the offset column that the format prunes files by, and put positions into the
commit's own metadata. A write looks at the positions it expects, mints from the greatest offset, and is made so that a
commit in between is a conflict; it is then tried again with new offsets.
"""

from __future__ import annotations

import json
import logging
import re
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.log_table import ANY, retrying
from tidemark.sources.table_format import OFFSET, CommitConflict, StaleWriter

PREFIX = "tidemark.offset."
log = logging.getLogger("tidemark")
#: Names of the errors by which the formats tell that another commit came first.
CONFLICTS = re.compile(r"Concurrent\w*Exception|CommitFailedException|ValidationException|MetadataChanged|ProtocolChanged")
#: A session's settings for one commit are set and unset under this.
_SETTINGS = threading.RLock()


class _SparkTable:
    """What the formats share."""

    def __init__(self, spark: SparkSession, offset_column: str):
        self.spark, self.offset_column = spark, offset_column
        log.warning("%s has not been run against its format's package", type(self).__name__)

    def _commit(self, data: DataFrame, expect: dict | None, write: Callable[[DataFrame, int | None], bool | None]) -> None:
        """Check, mint, write; all of it again if another commit came in between, which ``write`` tells by False or its error."""

        def attempt() -> None:
            have = self.read_offsets() if expect else {}
            for name, want in (expect or {}).items():
                if want is not ANY and have.get(name) != want:
                    raise StaleWriter(f"{name!r} is at {have.get(name)}, not at {want}: another writer has committed")
            base = self.latest_offset()
            try:
                landed = write(self._minted(data, base), base)
            except Exception as e:
                if CONFLICTS.search(f"{type(e).__name__} {e}"):
                    raise CommitConflict(str(e)) from e
                raise
            if landed is False:
                raise CommitConflict("rows beyond the last known offset are there already")

        retrying(attempt)

    def read_since(self, offset: int | None, hi: int | None = None) -> tuple[DataFrame, int | None]:
        rows = self.read_all()
        c = F.col(self.offset_column)
        rows = rows.where(c > (-1 if offset is None else offset))
        rows = rows if hi is None else rows.where(c <= hi)
        top = rows.agg(F.max(c)).first()[0]
        return rows, offset if top is None else top

    def _bound(self, f) -> int | None:
        return self.read_all().agg(f(self.offset_column)).first()[0] if self.exists() else None

    def earliest_offset(self) -> int | None:
        return self._bound(F.min)

    def latest_offset(self) -> int | None:
        return self._bound(F.max)

    def _minted(self, data: DataFrame, base: int | None) -> DataFrame:
        if self.offset_column in data.columns or (self.exists() and self.offset_column not in self.read_all().columns):
            return data
        ids = data.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
        counts = ids.groupBy("_part").count()
        before = counts.withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count")).drop("count")
        place = F.col("_id").bitwiseAND((1 << 33) - 1) + F.col("_before") + (0 if base is None else base + 1)
        minted = ids.join(F.broadcast(before), "_part")  # a row for each partition of the batch
        return minted.select(place.cast("long").alias(self.offset_column), *data.columns)

    def _merge(self, target: str, rows: DataFrame, on: str, matched: str = "") -> int:
        """Merge rows into a table; how many were inserted."""
        view = f"_tidemark_{threading.get_ident()}"
        rows.createOrReplaceTempView(view)
        try:
            done = self.spark.sql(f"MERGE INTO {target} t USING {view} s ON {on} {matched} WHEN NOT MATCHED THEN INSERT *").collect()
            return done[0]["num_inserted_rows"] if done and "num_inserted_rows" in done[0] else -1
        finally:
            self.spark.catalog.dropTempView(view)

    def _on(self, keys: list[str]) -> str:
        return " AND ".join(f"t.`{k}` = s.`{k}`" for k in keys)


class DeltaFormat(_SparkTable):
    """A Delta table at a path; positions are in the commits' user metadata."""

    def __init__(self, spark: SparkSession, path: str, offset_column: str = OFFSET, **options):
        super().__init__(spark, offset_column)
        try:
            spark.sparkContext._jvm.java.lang.Class.forName("io.delta.tables.DeltaTable", False, spark.sparkContext._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        except Exception as e:
            raise ImportError("this session has no Delta package; start it with io.delta:delta-spark") from e
        self.path, self.options = path, options

    def exists(self) -> bool:
        return bool(self.spark._jvm.io.delta.tables.DeltaTable.isDeltaTable(self.spark._jsparkSession, self.path))

    def create(self, schema: T.StructType) -> None:
        if not self.exists():
            self.spark.createDataFrame([], schema).write.format("delta").options(**self.options).save(self.path)

    def read_all(self) -> DataFrame:
        return self.spark.read.format("delta").options(**self.options).load(self.path) if self.exists() else self.spark.createDataFrame([], T.StructType([]))

    def _noting(self, offsets: dict[str, int] | None, work: Callable[[], object]):
        """Run a commit that carries positions; the setting is the session's, so it holds for this commit alone."""
        key = "spark.databricks.delta.commitInfo.userMetadata"
        with _SETTINGS:
            self.spark.conf.set(key, json.dumps({PREFIX + k: str(v) for k, v in (offsets or {}).items()}))
            try:
                return work()
            finally:
                self.spark.conf.unset(key)

    def append(self, data: DataFrame, offsets: dict[str, int] | None = None, expect: dict | None = None) -> None:
        def write(rows: DataFrame, base: int | None):
            if not self.exists():
                return self._noting(offsets, lambda: rows.write.format("delta").options(**self.options).mode("error").save(self.path))
            if self.offset_column not in rows.columns or self.offset_column in data.columns:
                return self._noting(offsets, lambda: rows.write.format("delta").options(**self.options).mode("append").save(self.path))
            # Delta lets plain appends pass each other. A merge that reads what lies beyond the base does not: rows that
            # are there keep its own out, and rows that come meanwhile are a conflict.
            beyond = f"t.`{self.offset_column}` > {-1 if base is None else base}"
            n = self._noting(offsets, lambda: self._merge(f"delta.`{self.path}`", rows, beyond))
            return False if n == 0 and rows.limit(1).count() else None

        self._commit(data, expect, write)

    def upsert(self, data: DataFrame, keys: list[str], offsets: dict[str, int] | None = None, expect: dict | None = None) -> None:
        if not self.exists():
            return self.append(data, offsets, expect)
        change = "WHEN MATCHED THEN UPDATE SET *"
        self._commit(data.drop(self.offset_column), expect, lambda rows, _: self._noting(offsets, lambda: self._merge(f"delta.`{self.path}`", rows, self._on(keys), change)) and None)

    def commit_offsets(self, offsets: dict[str, int], expect: dict | None = None) -> None:
        rows = self.read_all().limit(0)
        self._commit(rows, expect, lambda *_: self._noting(offsets, lambda: rows.write.format("delta").mode("append").save(self.path)))

    def _history(self) -> list:
        return self.spark.sql(f"DESCRIBE HISTORY delta.`{self.path}`").collect() if self.exists() else []

    def read_offsets(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for h in self._history():
            for k, v in json.loads(h["userMetadata"] or "{}").items():
                if k.startswith(PREFIX):
                    out.setdefault(k.removeprefix(PREFIX), int(v))
        return out

    def marker(self) -> int | None:
        return max((h["version"] for h in self._history()), default=None)

    def changes_since(self, marker: int | None) -> tuple[list[str], int | None]:
        new = [h for h in self._history() if marker is None or h["version"] > marker]
        removed = lambda h: int((h["operationMetrics"] or {}).get("numRemovedFiles", 0)) > 0
        ops = ["overwrite" if h["operation"] == "WRITE" else h["operation"].lower() for h in new
               if h["operation"] in ("DELETE", "UPDATE", "MERGE") or (h["operation"] == "WRITE" and removed(h))]
        return ops, self.marker()


class IcebergFormat(_SparkTable):
    """A table of an Iceberg catalog that Spark knows; positions are in the snapshots' summaries."""

    def __init__(self, spark: SparkSession, name: str, offset_column: str = OFFSET):
        super().__init__(spark, offset_column)
        self.name, self.since = name, None

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def create(self, schema: T.StructType) -> None:
        if not self.exists():
            self.spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {self.name.rpartition('.')[0]}")
            self.spark.createDataFrame([], schema).writeTo(self.name).using("iceberg").create()

    def read_all(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, data: DataFrame, offsets: dict[str, int] | None = None, expect: dict | None = None) -> None:
        def write(rows: DataFrame, base: int | None) -> None:
            if not self.exists():
                self.create(rows.schema)
            writer = rows.select(*self.read_all().columns).writeTo(self.name)
            for k, v in (offsets or {}).items():
                writer = writer.option(f"snapshot-property.{PREFIX}{k}", str(v))
            if self.since is None or self.offset_column not in rows.columns or self.offset_column in data.columns:
                return writer.append()
            # Replaces what lies beyond the base, which is nothing: a commit since the snapshot that the base was read at is a conflict.
            writer = writer.option("isolation-level", "serializable").option("validate-from-snapshot-id", str(self.since))
            return writer.overwrite(F.col(self.offset_column) > (-1 if base is None else base))

        self._commit(data, expect, write)

    def latest_offset(self) -> int | None:
        self.since = self.marker()  # before the offset is read
        return super().latest_offset()

    def upsert(self, data: DataFrame, keys: list[str], offsets: dict[str, int] | None = None, expect: dict | None = None) -> None:
        """A merge, then the positions in a commit of their own: a crash in between repeats a merge, which changes nothing."""
        if not self.exists():
            return self.append(data, offsets, expect)
        change = "WHEN MATCHED THEN UPDATE SET *"
        self._commit(data.drop(self.offset_column), expect, lambda rows, _: self._merge(self.name, rows, self._on(keys), change) and None)
        if offsets:
            self.commit_offsets(offsets, expect)

    def commit_offsets(self, offsets: dict[str, int], expect: dict | None = None) -> None:
        self.append(self.read_all().limit(0), offsets, expect)

    def _snapshots(self) -> list:
        return self.spark.sql(f"SELECT snapshot_id, operation, summary FROM {self.name}.snapshots ORDER BY committed_at").collect() if self.exists() else []

    def read_offsets(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for s in self._snapshots():
            out |= {k.removeprefix(PREFIX): int(v) for k, v in s["summary"].items() if k.startswith(PREFIX)}
        return out

    def marker(self) -> int | None:
        found = self._snapshots()
        return found[-1]["snapshot_id"] if found else None

    def changes_since(self, marker: int | None) -> tuple[list[str], int | None]:
        found = self._snapshots()
        at = next((k + 1 for k, s in enumerate(found) if s["snapshot_id"] == marker), 0)
        return [s["operation"] for s in found[at:] if s["operation"] in ("overwrite", "delete")], self.marker()
