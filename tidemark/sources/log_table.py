"""A commit log over Parquet files, read and written as DataFrames.

``<path>/_log/<version>.json`` lists the files that a commit adds and removes, its kind
and the positions of named readers. A version is published by put-if-absent, so a
commit is whole or absent, and data files that no version names are never read.

Offsets are virtual where the engine mints them: a file's entry has its first offset,
and a row's offset is that plus the row's index in the file. An append
writes its rows once, in one job, and a lost race rewrites the JSON alone. Files whose rows bring their own
offsets, or were rewritten, keep them in a column. Either way an entry has
the least and greatest offset, so a range read opens only files that can match.

Scale. The log is folded once and then extended; a whole state is written beside it every ``CHECKPOINT`` versions, and more
rarely where there are many files, so that what is written for states stays in proportion to the commits. Row counts come from the footers on the driver, or by a job when
there are many files or another store. Upserts, deletes and updates rewrite the files that hold a touched
row and no others; an upsert looks for them only in files whose least and greatest key, which the log has, meet those of
its batch.
"""

from __future__ import annotations

import json
import random
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.log_store import local_path, store_for
from tidemark.sources.table_format import MARKER, OFFSET, CommitConflict, StaleWriter

CHECKPOINT = 20
#: Files for each of which a state waits a version longer.
FILES_A_VERSION = 100
#: Changes in place that a state remembers; older ones are read from the log again.
OPS = 256
TRIES = 8
#: Files whose footers the driver reads itself; files whose first offsets go into the plan as a literal, and are broadcast.
FOOTERS = 1000
LITERAL_FILES = 8
BROADCAST_FILES = 50_000
#: Bytes, before compression, that one task may have to itself.
ONE_TASK = 16 << 20
#: Commits that change rows that a reader may have passed.
CHANGING = ("upsert", "overwrite", "delete", "update")
ANY = object()


@dataclass
class State:
    """What the log says up to ``version``."""

    version: int = -1
    schema: str | None = None
    files: dict[str, dict] = field(default_factory=dict)
    offsets: dict[str, int] = field(default_factory=dict)
    #: The greatest offset ever given; it stays when its row goes.
    high: int = -1
    #: The last changes in place, and the version up to which they were dropped.
    ops: list[tuple[int, str]] = field(default_factory=list)
    ops_after: int = -1

    def take(self, c: dict) -> None:
        self.version = c["version"]
        self.schema = c.get("schema") or self.schema
        for p in c["remove"]:
            self.files.pop(p, None)
        for f in c["add"]:
            self.files[f["path"]] = f
            self.high = max(self.high, f["max"] if f["max"] is not None else -1)
        self.offsets |= c["offsets"]
        if c["op"] in CHANGING:
            self.ops.append((c["version"], c["op"]))
            if len(self.ops) > OPS:
                self.ops_after = self.ops.pop(0)[0]


def retrying(attempt: Callable[[], None], tries: int = TRIES) -> None:
    """Run a commit until it wins its race; waits double, up to two seconds, with jitter."""
    for k in range(tries):
        try:
            return attempt()
        except CommitConflict:
            if k == tries - 1:
                raise
            time.sleep(min(2.0, 0.05 * 2**k) * (0.5 + random.random()))


def _bounds(meta: pq.FileMetaData, column: str) -> tuple | None:
    """A column's least and greatest value by a file's footer; None where it does not say, or not in whole numbers or strings."""
    at = next((i for i in range(meta.num_columns) if meta.schema.column(i).path == column), None)
    if at is None or not meta.num_row_groups:
        return None
    stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
    if not all(x is not None and x.has_min_max and type(x.min) in (int, str) for x in stats):
        return None
    return min(x.min for x in stats), max(x.max for x in stats)


def _meet(one: dict, others: list[dict]) -> bool:
    """Whether a file may hold a key of one of the others, by their ranges."""
    have = one.get("keys", {})
    apart = lambda o: any(have[k][0] > hi or have[k][1] < lo for k, (lo, hi) in o.get("keys", {}).items() if k in have)
    return not all(apart(o) for o in others)


class LogTable:
    """A table in a folder; see the module. ``offset_column`` is how readers see offsets."""

    def __init__(self, spark: SparkSession, path: str, offset_column: str = OFFSET):
        self.spark, self.path, self.offset_column = spark, path.rstrip("/"), offset_column
        self.store, self.root = store_for(spark, self.path)
        self._state = State()
        #: The newest version known to have a whole state.
        self._saved = 0
        self._lock = threading.RLock()

    def __repr__(self) -> str:
        return f"LogTable({self.path!r})"

    # The log.

    def _entry(self, version: int) -> str:
        return f"{self.root}/_log/{version:020d}.json"

    def state(self, version: int | None = None) -> State:
        """The newest state, or that of a version."""
        if version is None:
            with self._lock:
                self._extend(self._state)
                return self._state
        old = State()
        self._extend(old, version)
        if old.version != version:
            raise ValueError(f"{self.path} has no version {version}")
        return old

    def _extend(self, state: State, until: int | None = None) -> None:
        if state.version < 0:
            names = [n for n in self.store.names(f"{self.root}/_log") if n.endswith(".state")]
            good = [n for n in names if until is None or int(n[:20]) <= until]
            if good and (data := self.store.read(f"{self.root}/_log/{good[-1]}")):
                state.__dict__.update(json.loads(data))
                state.ops = [tuple(x) for x in state.ops]
                self._saved = max(self._saved, state.version)
        while until is None or state.version < until:
            data = self.store.read(self._entry(state.version + 1))
            if data is None:
                return
            state.take(json.loads(data))

    def exists(self) -> bool:
        """Whether the table has columns; positions may be there before."""
        return self.state().schema is not None

    @property
    def schema(self) -> T.StructType | None:
        """The table's columns, the offset column among them if it has one."""
        found = self.state().schema
        return None if found is None else T.StructType.fromJson(json.loads(found))

    def has_offsets(self) -> bool:
        return self.schema is None or self.offset_column in self.schema.names

    def _publish(self, op: str, add=(), remove=(), offsets=None, schema=None, expect=None) -> None:
        """One try at the next version. ``expect``: the positions that named readers must still have."""
        with self._lock:
            self._publish_next(op, add, remove, offsets or {}, schema, expect or {})

    def _publish_next(self, op: str, add, remove, offsets: dict, schema: str | None, expect: dict) -> None:
        state = self.state()
        for name, want in expect.items():
            if want is not ANY and state.offsets.get(name) != want:
                raise StaleWriter(f"{name!r} is at {state.offsets.get(name)} in {self.path}, not at {want}: another writer has committed")
        base, entries = state.high + 1, []
        for f in add:
            if f["physical"]:
                entries.append(f)
            else:
                entries.append({**f, "min": base, "max": base + f["rows"] - 1})
                base += f["rows"]
        gone = [p for p in remove if p not in state.files]
        if gone:
            raise CommitConflict(f"{gone[0]} was replaced meanwhile")
        commit = {"version": state.version + 1, "ts": time.time(), "op": op, "add": entries, "remove": list(remove), "offsets": offsets}
        if schema is not None:
            commit["schema"] = schema
        if not self.store.put_if_absent(self._entry(commit["version"]), json.dumps(commit).encode()):
            raise CommitConflict(f"version {commit['version']} of {self.path} is taken")
        state.take(commit)
        if state.version - self._saved >= max(CHECKPOINT, len(state.files) // FILES_A_VERSION):
            self._saved = state.version
            self.store.put_if_absent(f"{self.root}/_log/{state.version:020d}.state", json.dumps(state.__dict__).encode())

    def create(self, schema: T.StructType) -> LogTable:
        """An empty table with these columns. Does nothing to a table that exists."""
        loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])

        def attempt() -> None:
            if not self.exists():
                self._publish("create", schema=loose.json())

        retrying(attempt)
        return self

    # Writing.

    def _shaped(self, data: DataFrame) -> tuple[DataFrame, bool]:
        """The rows in the table's column order, and whether they bring offsets."""
        schema = self.schema
        if schema is None:
            loose = [T.StructField(f.name, f.dataType, True) for f in data.schema.fields]
            if self.offset_column not in data.columns:
                loose.insert(0, T.StructField(self.offset_column, T.LongType(), True))
            self.create(T.StructType(loose))
            schema = self.schema
        physical = self.offset_column in data.columns
        want = [f for f in schema.fields if f.name != self.offset_column or physical]
        extra, missing = set(data.columns) - {f.name for f in want}, {f.name for f in want} - set(data.columns)
        if extra or missing:
            raise ValueError(f"columns of {self.path} differ: missing {sorted(missing)}, unknown {sorted(extra)}")
        have = {f.name: f.dataType for f in data.schema.fields}
        return data.select(*(data[f.name] if have[f.name] == f.dataType else data[f.name].cast(f.dataType).alias(f.name) for f in want)), physical

    def _write(self, data: DataFrame, physical: bool, keys: list[str] = ()) -> list[dict]:
        """Write rows under a name of their own; their entries, in row order, with the ranges of ``keys`` where the driver can tell."""
        folder = f"data/{uuid.uuid4().hex}"
        data.write.parquet(f"{self.path}/{folder}")
        local = local_path(f"{self.path}/{folder}")
        names = [n for n in self.store.names(local or f"{self.path}/{folder}") if n.endswith(".parquet")]
        with_offsets = physical and self.has_offsets()
        entries = []
        if local and len(names) <= FOOTERS:
            for name in names:
                meta = pq.read_metadata(f"{local}/{name}")
                low, high = _bounds(meta, self.offset_column) if with_offsets and meta.num_rows else (None, None)
                ranges = {k: found for k in keys if (found := _bounds(meta, k)) is not None}
                size = sum(meta.row_group(g).total_byte_size for g in range(meta.num_row_groups))
                entries.append({"path": f"{folder}/{name}", "rows": meta.num_rows, "bytes": size, "min": low, "max": high, "physical": physical, **({"keys": ranges} if ranges else {})})
        else:
            found = self.spark.read.parquet(f"{self.path}/{folder}").groupBy(F.col("_metadata.file_name").alias("name"))
            off = F.col(self.offset_column) if with_offsets else F.lit(None).cast("long")
            for r in found.agg(F.count(F.lit(1)).alias("n"), F.min(off).alias("low"), F.max(off).alias("high")).orderBy("name").collect():
                entries.append({"path": f"{folder}/{r.name}", "rows": r.n, "min": r.low, "max": r.high, "physical": physical})
        return [e for e in entries if e["rows"]]

    def append(self, data: DataFrame, offsets: dict[str, int] | None = None, expect: dict | None = None) -> int:
        """Add rows and positions in one commit; the number of rows.

        Rows without the offset column get the next offsets, in the order of the partitions
        and of the rows in them. A table made without that column takes rows as they are.
        """
        data, physical = self._shaped(data)
        plain = not self.has_offsets()
        files = self._write(data, physical or plain)
        retrying(lambda: self._publish("append", files, offsets=offsets, expect=expect))
        return sum(f["rows"] for f in files)

    def commit_offsets(self, offsets: dict[str, int], expect: dict | None = None) -> None:
        """Positions alone; no data file."""
        retrying(lambda: self._publish("offset", offsets=offsets, expect=expect))

    def overwrite(self, data: DataFrame, offsets: dict[str, int] | None = None, expect: dict | None = None) -> None:
        """Replace all rows, and set positions, in one commit."""
        data, physical = self._shaped(data)
        files = self._write(data, physical or not self.has_offsets())
        retrying(lambda: self._publish("overwrite", files, list(self.state().files), offsets, expect=expect))

    def _touched(self, rows: DataFrame) -> list[str]:
        """Files with a row of ``rows``, which come from :meth:`_scan` with their file's name."""
        names = {r[0] for r in rows.select("_file").distinct().collect()}
        return [p for p in self.state().files if p.rsplit("/", 1)[1] in names]

    def _rewritten(self, paths: list[str], keep: Callable[[DataFrame], DataFrame], keys: list[str] = ()) -> list[dict]:
        if not paths:
            return []
        rows = keep(self._scan(paths, with_offset=True))
        return self._write(rows.select(*self.schema.names), True, keys)

    def upsert(self, data: DataFrame, keys: list[str], offsets: dict[str, int] | None = None, expect: dict | None = None) -> None:
        """Rows of ``data`` replace those with equal keys, others are added; all get new offsets.

        A key with a null equals nothing, so such a row is added. ``data`` has one row for each
        key (see :func:`tidemark.operators.latest.dedup_latest`).
        """
        if self.offset_column in data.columns:
            data = data.drop(self.offset_column)
        data, _ = self._shaped(data)
        new = self._write(data, not self.has_offsets(), keys)
        source = self._parquet([f["path"] for f in new], with_offset=False) if new else None
        wanted = None if source is None else source.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
        on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]

        def attempt() -> None:
            near = [p for p, f in self.state().files.items() if _meet(f, new)]
            touched = self._touched(self._scan(near, file_name=True).select(*keys, "_file").join(wanted, on, "left_semi")) if near else []
            kept = self._rewritten(touched, lambda rows: rows.join(wanted, on, "left_anti"), keys)
            self._publish("upsert" if touched else "append", [*kept, *new], touched, offsets, expect=expect)

        retrying(attempt)

    def _change(self, op: str, condition: Column | str, change: Callable[[DataFrame, Column], DataFrame]) -> None:
        condition = F.expr(condition) if isinstance(condition, str) else condition

        def attempt() -> None:
            touched = self._touched(self._scan(list(self.state().files), with_offset=True, file_name=True).where(condition)) if self.state().files else []
            if touched:
                kept = self._rewritten(touched, lambda rows: change(rows, condition))
                self._publish(op, kept, touched)

        retrying(attempt)

    def delete(self, condition: Column | str) -> None:
        """Remove the rows that a condition holds for."""
        self._change("delete", condition, lambda rows, c: rows.where(~F.coalesce(c, F.lit(False))))

    def update(self, condition: Column | str, values: dict[str, Column]) -> None:
        """Set columns of the rows that a condition holds for; their offsets stay."""
        self._change("update", condition, lambda rows, c: rows.withColumns({k: F.when(c, v).otherwise(F.col(k)) for k, v in values.items()}))

    def compact(self, files: int = 1) -> None:
        """Rewrite the rows into fewer files, in order of offset. No row changes."""

        def attempt() -> None:
            paths = list(self.state().files)
            if len(paths) > files:
                rows = self._scan(paths, with_offset=True)
                rows = rows.repartitionByRange(files, self.offset_column).sortWithinPartitions(self.offset_column) if self.has_offsets() else rows.coalesce(files)
                self._publish("replace", self._write(rows.select(*self.schema.names), True), paths)

        retrying(attempt)

    # Reading.

    def _columns(self, with_offset: bool) -> T.StructType:
        return T.StructType([f for f in self.schema.fields if with_offset or f.name != self.offset_column])

    def _parquet(self, paths: list[str], with_offset: bool, file_name: bool = False) -> DataFrame:
        rows = self.spark.read.schema(self._columns(with_offset)).parquet(*(f"{self.path}/{p}" for p in paths))
        return rows.withColumn("_file", F.col("_metadata.file_name")) if file_name else rows

    def _scan(self, paths: list[str], with_offset: bool = False, file_name: bool = False, state: State | None = None) -> DataFrame:
        """The rows of some files; offsets only where asked for, since they cost an expression."""
        state = state or self.state()
        with_offset = with_offset and self.has_offsets()
        schema = self._columns(with_offset)
        physical = [p for p in paths if state.files[p]["physical"]]
        virtual = [p for p in paths if not state.files[p]["physical"]]
        parts = []
        if physical:
            parts.append(self._parquet(physical, with_offset, file_name))
        if virtual and not with_offset:
            parts.append(self._parquet(virtual, False, file_name))
        elif virtual:
            bases = {p.rsplit("/", 1)[1]: state.files[p]["min"] for p in virtual}
            rows = self._parquet(virtual, False).withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
            if len(bases) == 1:
                first = F.lit(next(iter(bases.values())))
            elif len(bases) <= LITERAL_FILES:
                first = F.create_map(*(F.lit(x) for kv in bases.items() for x in kv))[F.col("_file")]
            else:
                named = self.spark.createDataFrame(list(bases.items()), "_name string, _base long")
                # A row of some 100 bytes for each file.
                named = F.broadcast(named) if len(bases) <= BROADCAST_FILES else named
                rows, first = rows.join(named, F.col("_file") == F.col("_name")), F.col("_base")
            rows = rows.withColumn(self.offset_column, (first + F.col("_row")).cast("long"))
            parts.append(rows.select(*schema.names, *(["_file"] if file_name else [])))
        if not parts:
            empty = T.StructType([*schema.fields, *([T.StructField("_file", T.StringType())] if file_name else [])])
            return self.spark.createDataFrame([], empty)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def read_all(self, version: int | None = None) -> DataFrame:
        """All rows, offsets included, now or as of a version. A table that isn't there has no columns."""
        if self.schema is None:
            return self.spark.createDataFrame([], T.StructType([]))
        state = self.state(version)
        return self._scan(list(state.files), with_offset=True, state=state)

    def read(self) -> DataFrame:
        """All rows without offsets."""
        return self.read_all() if self.schema is None else self._scan(list(self.state().files))

    def _need_offsets(self) -> None:
        if not self.has_offsets():
            raise ValueError(f"{self.path} has no column {self.offset_column}; read it with read_all()")

    def _range(self, lo: int | None, hi: int | None) -> tuple[list[str], list[str]]:
        """Files inside a range of offsets, and files that only overlap it."""
        lo, hi = -1 if lo is None else lo, float("inf") if hi is None else hi
        inside, partly = [], []
        for p, f in self.state().files.items():
            if f["max"] is None or f["max"] <= lo or f["min"] > hi:
                continue
            (inside if f["min"] > lo and f["max"] <= hi else partly).append(p)
        return inside, partly

    def read_since(self, offset: int | None, hi: int | None = None) -> tuple[DataFrame, int | None]:
        """Rows with ``offset < _offset <= hi`` and the greatest offset among them, or ``offset``."""
        self._need_offsets()
        if self.schema is None:
            return self.read_all(), offset
        inside, partly = self._range(offset, hi)
        rows = self._scan([*inside, *partly], with_offset=True)
        if partly:
            c = F.col(self.offset_column)
            rows = rows.where((c > F.lit(-1 if offset is None else offset)) & (c <= F.lit(hi) if hi is not None else F.lit(True)))
        return rows, self._greatest(offset, hi, inside, partly)

    def _greatest(self, lo: int | None, hi: int | None, inside: list[str], partly: list[str]) -> int | None:
        files = self.state().files
        tops = [files[p]["max"] for p in inside]
        for p in partly:
            f = files[p]
            if hi is None or f["max"] <= hi:
                tops.append(f["max"])
            elif not f["physical"]:
                tops.append(hi)
            else:  # offsets of its own may have gaps
                c = F.col(self.offset_column)
                tops.append(self._scan([p], with_offset=True).where((c > (-1 if lo is None else lo)) & (c <= hi)).agg(F.max(c)).first()[0])
        return max((t for t in tops if t is not None), default=lo)

    def count_since(self, lo: int | None, hi: int | None = None) -> int:
        """Number of rows that :meth:`read_since` returns; from the log where it can tell."""
        inside, partly = self._range(lo, hi)
        files = self.state().files
        n = sum(files[p]["rows"] for p in inside)
        for p in partly:
            f = files[p]
            if f["physical"]:
                c = F.col(self.offset_column)
                n += self._scan([p], with_offset=True).where((c > (-1 if lo is None else lo)) & (c <= (f["max"] if hi is None else hi))).count()
            else:
                n += min(f["max"], f["max"] if hi is None else hi) - max(f["min"] - 1, -1 if lo is None else lo)
        return n

    def small(self, lo: int | None = None, hi: int | None = None) -> bool:
        """Whether the files of a range are known to have no more than one task may have to itself."""
        files = self.state().files
        inside, partly = self._range(lo, hi) if self.has_offsets() else (list(files), [])
        sizes = [files[p].get("bytes") for p in [*inside, *partly]]
        return None not in sizes and sum(sizes) <= ONE_TASK

    def earliest_offset(self) -> int | None:
        self._need_offsets()
        return min((f["min"] for f in self.state().files.values()), default=None)

    def latest_offset(self) -> int | None:
        """The greatest offset among the rows; it falls when that row is deleted."""
        self._need_offsets()
        return max((f["max"] for f in self.state().files.values()), default=None)

    def high_water(self) -> int:
        """The greatest offset ever given, -1 if none; it never falls."""
        return self.state().high

    def read_offsets(self) -> dict[str, int]:
        return {k: v for k, v in self.state().offsets.items() if not k.startswith(MARKER)}

    def read_markers(self) -> dict[str, int]:
        """Places in sources' histories that readers stored beside their positions."""
        return {k: v for k, v in self.state().offsets.items() if k.startswith(MARKER)}

    # History.

    def marker(self) -> int | None:
        v = self.state().version
        return None if v < 0 else v

    def changes_since(self, marker: int | None) -> tuple[list[str], int | None]:
        state, after = self.state(), -1 if marker is None else marker
        older = (json.loads(self.store.read(self._entry(v))) for v in range(after + 1, state.ops_after + 1))
        ops = [c["op"] for c in older if c["op"] in CHANGING]
        return ops + [op for v, op in state.ops if v > after], self.marker()

    def read_changes(self, since: int, keys: list[str], until: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, int]:
        """(inserts, updates, deletes, version): what turns version ``since`` into ``until``, by key.

        Only files that the two versions don't share are read. Keys must be unique and not null.
        """
        new = self.state() if until is None else self.state(until)
        old = self.state(since)
        names = [n for n in self.schema.names if n != self.offset_column]
        before = self._scan([p for p in old.files if p not in new.files], state=old).select(names)
        after = self._scan([p for p in new.files if p not in old.files], state=new).select(names)
        a = before.select(F.struct(*names).alias("old"), *(F.col(k).alias(f"_a{i}") for i, k in enumerate(keys)))
        b = after.select(F.struct(*names).alias("new"), *(F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)))
        both = a.join(b, [F.col(f"_a{i}") == F.col(f"_b{i}") for i in range(len(keys))], "full")
        inserts = both.where("old is null").select("new.*")
        deletes = both.where("new is null").select("old.*")
        updates = both.where(F.col("old").isNotNull() & F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))).select("new.*")
        return inserts, updates, deletes, new.version
