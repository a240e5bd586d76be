"""Token counts as a delta-maintained rollup.

Totals by source, language and tokenizer version are sums, so they are never recomputed:
a batch of changes has a sign for each document's count (an insert +1, a
delete -1, a revision both: the old count out and the new one in), is summed by
group, and its few sums are written as one small table. A batch is committed by an entry in a
log, whose numbers are taken by put-if-absent, and by a mark, put likewise, that says which entry counts for the batch's
id. A batch that is sent again, by a retry or another driver, finds the mark or adds an entry that does not count; a mark that a
lost driver did not write is written by the next reader. Totals are the last compaction and the entries after it.
:meth:`Rollup.compact` adds these entries to it, and a commit does so every ``EVERY`` entries, so neither readers nor
compactions ever go back over what is compacted.

Scale. Counting has no shuffle; sums are combined before theirs, so a
source with a third of all rows is a row for each task.

Cases. A null text has no tokens but is a document. Null sources and languages are groups.
Equal rows count each. A batch without rows commits its id alone. Ids of documents
matter only to :func:`changes`, where a null id matches nothing: it is a delete and an insert.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tokens import default_path, encode
from tidemark.sources.log_store import store_for

GROUP = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_bytes")
EVERY = 64


def _counted(path: str, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(3)
            tokens = [len(encode(t.as_py(), path, added)) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(tokens, pa.int64()), b.column(4)], ["id", "source", "lang", "n_tokens", "n_bytes"])

    return run


def count_tokens(
    docs: DataFrame, version: str = "byte_bpe_50k", tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", added: bool = False
) -> DataFrame:
    """Each row's (id, source, lang, tokenizer, n_tokens, n_bytes), with no special tokens.

    ``tokenizer`` is the path of a byte-level BPE file, ``version`` the name its counts go by;
    ``added``: its added tokens in a text are one token each.
    """
    rows = docs.select(
        F.col(doc_id).alias("id"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_counted(tokenizer or default_path(), added), f"id {kind}, source string, lang string, n_tokens long, n_bytes long")
    return found.withColumn("tokenizer", F.lit(version))


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Counts as inserts (+1) or deletes (-1)."""
    return counts.withColumn("sign", F.lit(sign))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """What turns the counts ``old`` into ``new``: both need one row for each id and tokenizer.

    Documents with equal counts and groups cancel and are left out.
    """
    columns = ["id", *GROUP, "n_tokens", "n_bytes"]
    a, b = (x.select(F.struct(*columns).alias("row"), F.col("id").alias("k_id"), F.col("tokenizer").alias("k_tok")) for x in (old, new))
    a, b = a.withColumnsRenamed({c: f"a_{c}" for c in a.columns}), b.withColumnsRenamed({c: f"b_{c}" for c in b.columns})
    both = a.join(b, (F.col("a_k_id") == F.col("b_k_id")) & F.col("a_k_tok").eqNullSafe(F.col("b_k_tok")), "full")
    moved = both.where(~F.col("a_row").eqNullSafe(F.col("b_row")))
    out = F.explode(F.array(F.struct(F.col("a_row").alias("row"), F.lit(-1).alias("sign")), F.struct(F.col("b_row").alias("row"), F.lit(1).alias("sign"))))
    return moved.select(out.alias("x")).where("x.row is not null").select("x.row.*", "x.sign")


class Rollup:
    """Totals in a folder that every driver and executor can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.store, self.root = store_for(spark, self.folder)

    def _owner(self, batch: str, number: int | None = None) -> int | None:
        """The entry that counts for a batch; ``number`` does if none is marked yet."""
        path = f"{self.root}/batches/{hashlib.sha256(batch.encode()).hexdigest()}"
        if number is not None:
            self.store.put_if_absent(path, str(number).encode())
        found = self.store.read(path)
        return None if found is None else int(found)

    def _whole(self) -> tuple[int, str | None]:
        """The last entry of the newest compaction and its sums."""
        names = self.store.names(f"{self.root}/compact")
        if not names:
            return -1, None
        found = json.loads(self.store.read(f"{self.root}/compact/{names[-1]}"))
        return found["upto"], found["data"]

    def _entries(self, after: int) -> tuple[list[dict], int]:
        """The entries after one that count, and the number of the last."""
        out, n = [], after + 1
        while (data := self.store.read(f"{self.root}/log/{n:020d}.json")) is not None:
            entry = json.loads(data)
            if self._owner(entry["batch"], n) == n:
                out.append(entry)
            n += 1
        return out, n - 1

    def committed(self, batch: str) -> bool:
        if self._owner(batch) is None:
            self._entries(self._whole()[0])  # marks what a lost driver has not
        return self._owner(batch) is not None

    def commit(self, batch: str, rows: DataFrame | Callable[[], DataFrame]) -> bool:
        """Apply a batch of signed counts once; False if its id is committed already.

        ``rows`` may be a function, which is not called for a batch that is committed.
        """
        if self.committed(batch):
            return False
        rows = rows() if callable(rows) else rows
        sums = rows.groupBy(*GROUP).agg(
            F.sum("sign").cast("long").alias("n_docs"), *(F.sum(F.col(c) * F.col("sign")).cast("long").alias(c) for c in SUMS[1:])
        )
        data = f"sums/{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.folder}/{data}")
        entry = json.dumps({"batch": batch, "data": data}).encode()
        start = self._whole()[0]
        n = self._entries(start)[1] + 1
        while not self.store.put_if_absent(f"{self.root}/log/{n:020d}.json", entry):
            n += 1
        counts = self._owner(batch, n) == n
        if n - start >= EVERY:
            self.compact()
        return counts

    def _sums(self, paths: list[str]) -> DataFrame:
        schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_bytes long"
        rows = self.spark.read.schema(schema).parquet(*(f"{self.folder}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], schema)
        return rows.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in SUMS)).where("n_docs <> 0 or n_tokens <> 0 or n_bytes <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens, n_bytes) of the groups that have documents or tokens left."""
        upto, data = self._whole()
        return self._sums([*([data] if data else []), *(e["data"] for e in self._entries(upto)[0])])

    def compact(self) -> None:
        """Add the entries since the last compaction to it as one table; readers see one or the other."""
        upto, old = self._whole()
        entries, last = self._entries(upto)
        if last > upto:
            data = f"sums/{uuid.uuid4().hex}"
            self._sums([*([old] if old else []), *(e["data"] for e in entries)]).coalesce(1).write.parquet(f"{self.folder}/{data}")
            self.store.put_if_absent(f"{self.root}/compact/{last:020d}.json", json.dumps({"upto": last, "data": data}).encode())
