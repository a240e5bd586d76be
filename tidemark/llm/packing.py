"""Best-fit packing of token sequences, planned over a histogram of lengths.

Documents are tokenised and ended, and only those longer than a sequence are cut:
all pieces but the first are whole sequences. The plan needs no document: from the
number of pieces of each length, best fit in order of falling length fills
sequences, and sequences filled alike are one run with a count. Pieces then take
planned slots by their rank within their length.

Scale. The driver gets at most ``capacity`` counts and makes runs, whose number
depends on ``capacity`` alone; that bounds what is sent to the executors. Ranks
are counted in hashed buckets of bounded size whose offsets are prefix sums,
so that a length that a third of all pieces have is not ordered in one task. The prefix sums of one length are one task's: a
row for each 50,000 pieces, which is a million rows at 5 * 10 ** 10 pieces.

Cases. A null text is empty, and an empty document is its end token alone. Equal
rows are packed each; rows that share an id are told apart by their text.
Other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize
from tidemark.llm.tokens import default_path, encode

CAPACITY = 1024
END = 2
#: Pieces in a bucket, about.
BUCKET = 50_000


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots: (length, first rank, sequences, pieces in each, first sequence, offset).

    Longest first; a piece goes to the sequence with the least room that is
    enough. ``room`` has the runs of sequences that are alike, by their room.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    slots, sequences = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            fit = next((r for r in rooms if r >= length), None)
            if fit is None:
                fit, each = capacity, capacity // length
                first, have = sequences, -(-todo // each)
                sequences += have
            else:
                each = fit // length
                first, have = room[fit].pop()
                if not room[fit]:
                    del room[fit]
                    rooms.remove(fit)
            full = min(have, todo // each)
            if full:
                slots.append((length, rank, full, each, first, capacity - fit))
                rank += full * each
                todo -= full * each
                put(fit - each * length, first, full)
                first, have = first + full, have - full
            if have and todo:  # one sequence gets what is left
                slots.append((length, rank, 1, todo, first, capacity - fit))
                put(fit - todo * length, first, 1)
                todo, first, have = 0, first + 1, have - 1
            put(fit, first, have)
    return slots


def _cut(path: str, capacity: int, end: int, with_ids: bool, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                row, out, ids = [], [], []
                for k, text in enumerate(part.column(2)):
                    tokens = encode(text.as_py(), path, added)
                    tokens.append(end)
                    for n, (start, length) in enumerate(pieces_of(len(tokens), capacity)):
                        own = tokens[start : start + length]
                        row.append(k)
                        out.append((n, start, length, zlib.crc32(array("I", own).tobytes())))
                        if with_ids:
                            ids.append(own)
                if not row:
                    continue
                take, (n, start, length, crc) = pa.array(row), zip(*out, strict=True)
                columns = [part.column(0).take(take), part.column(1).take(take), pa.array(n, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "text_hash", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _placed(slots: list[tuple[int, int, int, int, int, int]]):
    """Looks up each piece's slot: slots are in order of length and first rank."""
    table = np.array(sorted(slots), np.int64).reshape(-1, 6)
    key = table[:, 0] * (1 << 48) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy()
            slot = table[np.searchsorted(key, length * (1 << 48) + rank, "right") - 1] if len(table) else np.zeros((0, 6), np.int64)
            within = rank - slot[:, 1]
            sequence = slot[:, 4] + within // np.maximum(slot[:, 3], 1)
            offset = slot[:, 5] + within % np.maximum(slot[:, 3], 1) * length
            names = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None,
    capacity: int = CAPACITY, end: int = END, with_ids: bool = False, bucket: int = BUCKET, added: bool = False,
) -> DataFrame:
    """A row per piece: where it is in its document, and its sequence and offset there.

    ``with_ids`` adds the piece's token ids as ``ids``. ``tokenizer`` is the path of a
    byte-level BPE file that every executor can read; ``added``: its added tokens in a text are their ids.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(doc_id).alias("id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    kind = keyed.schema["id"].dataType.simpleString()
    schema = f"id {kind}, text_hash long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = materialize(keyed.mapInArrow(_cut(tokenizer or default_path(), capacity, end, with_ids, added), schema), "pieces")
    n = pieces.count()
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "text_hash", "piece"), F.lit(max(1, -(-n // bucket)))))
    counts = spread.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    plan = best_fit({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    offsets = counts.select(F.col("length").alias("o_length"), F.col("bucket").alias("o_bucket"), before.alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("id", "text_hash", "piece")
    ranked = (
        spread.withColumn("local", F.row_number().over(order) - 1)
        .join(offsets, (F.col("length") == F.col("o_length")) & (F.col("bucket") == F.col("o_bucket")))
        .withColumn("rank", (F.col("before") + F.col("local")).cast("long"))
        .select(*pieces.columns, "rank")
    )
    out = ranked.mapInArrow(_placed(plan), schema + ", sequence_id long, offset long")
    return out.drop("text_hash").withColumnRenamed("id", doc_id)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, segments) from the rows of ``pack(..., with_ids=True)``.

    ``segments`` has the lengths of the sequence's pieces in order.
    """
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda p: F.size(p["ids"])).alias("segments")
    )
