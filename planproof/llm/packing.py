"""Best-fit packing planned over the histogram of lengths.

Documents become token pieces of at most `capacity` ids. Best-fit decreasing runs on the driver over the
counts of each length (at most `capacity` of them, whatever the input), so the plan is a short list of
slots: of the pieces of a length, those with rank from a to b take offset o of sequences s, s + 1, ....
The pieces then take their slots by their rank within their length. Ranks are dealt over buckets of
doc_id, so that a common length is no group of its own: a rank is the rank in the bucket plus the count of
the buckets before.

Defined cases: a null or empty text is its closing id alone; a very long text is as many pieces as it needs; a null doc_id is packed like any other;
repeated rows are packed once each; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planproof.llm.common import prepare, scoped, stored, text_chunks
from planproof.llm.tokens import default_path, word_ids

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Token pieces of each document: ids and the closing id; of a longer one the first piece is the shorter."""
    prepare(docs.sparkSession)
    path = tokenizer or default_path()

    def run(batches):
        words = word_ids(path)
        close = end_id.to_bytes(4, "little")
        for c in text_chunks(batches):
            out: list[tuple] = []
            for doc, text in zip(c.column("doc_id").to_pylist(), c.column("text").to_pylist()):
                raw = words.text(text) + close
                n, a, k = len(raw) // 4, 0, 0
                step = n % capacity or capacity
                while a < n:
                    out.append((doc, k, a, step, zlib.crc32(raw[4 * a : 4 * (a + step)])))
                    a, k, step = a + step, k + 1, capacity
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best-fit decreasing over counts. Slots (length, first rank, first sequence, offset), sorted, and the number
    of sequences; a slot lasts to the next one's first rank. Sequences filled alike are one group."""
    slots: list[tuple[int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # free room: (first sequence, how many)
    rooms: list[int] = []  # sorted free rooms that have a group
    made = 0

    def put(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in groups:
                groups[room] = []
                rooms.insert(int(np.searchsorted(rooms, room)), room)
            groups[room].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def fill(first: int, many: int, copies: int, room: int) -> None:
            nonlocal rank, left
            for j in range(copies):
                slots.append((length, rank, first, capacity - room + j * length))
                rank += many
            left -= many * copies
            put(room - copies * length, first, many)

        while left:
            at = int(np.searchsorted(rooms, length))
            if at < len(rooms):
                room = rooms[at]
                first, many = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room, first = capacity, made
                many = -(-left // (capacity // length))
                made += many
            fit = room // length
            full = min(many, left // fit)
            if full:
                fill(first, full, fit, room)
            if full < many and left:
                fill(first + full, 1, left, room)
                full += 1
            put(room, first + full, many - full)
    return sorted(slots), made


def best_fit(parts: DataFrame, capacity: int = CAPACITY, per_bucket: int = 20_000) -> DataFrame:
    """parts (doc_id, piece, start, length, ...; lengths 1 to capacity) with sequence_id and offset."""
    prepare(parts.sparkSession)
    counts = {int(r[0]): int(r[1]) for r in parts.groupBy("length").count().collect()}
    slots, _ = plan(counts, capacity)
    length, rank, seq, off = (np.array([s[i] for s in slots] or [0], np.int64) for i in range(4))
    buckets = max(256, sum(counts.values()) // per_bucket)
    cols = parts.columns
    dealt = parts.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    ranked = dealt.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    base = dealt.groupBy("length", "_bucket").count().select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    whole = ranked.join(base, ["length", "_bucket"]).select(*cols, (F.col("_rank") + F.col("_base")).cast("long").alias("_rank"))
    span = int(max(counts.values(), default=0)) + 1
    key = length * span + rank

    def run(batches):
        for c in batches:
            size = c.column("length").to_numpy(zero_copy_only=False)
            mine = c.column("_rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, size * span + mine, side="right") - 1
            arrays = [c.column(c.schema.get_field_index(n)) for n in cols]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(seq[at] + mine - rank[at]), pa.array(off[at])], [*cols, "sequence_id", "offset"])

    kinds = ", ".join(f"{n} {t}" for n, t in parts.dtypes)
    return whole.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


@scoped
def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    return best_fit(stored(pieces(docs, capacity, tokenizer, end_id), "pieces"), capacity)
