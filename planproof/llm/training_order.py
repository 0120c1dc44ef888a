"""Training-order materialisation: fixed-length token sequences in a keyed global order, as fixed-stride shards.

Documents are tokenised once; the ids of each input partition, a closing id after each document, are cut into
sequences of `length` ids (the last one of a partition is padded with the closing id), and stored. The stored table
fixes their numbers 0 to N - 1: by partition, then by place. A Feistel network over the next even power of two
permutes those numbers under a key; a value from N on is sent through again (cycle-walking) until it is below N,
which is a permutation of 0 to N - 1 without a table. Slot s lies in shard s // per_shard at byte
(s mod per_shard) * length * 2, ids are 16-bit little-endian. A reader resumes at any slot by arithmetic.

The shuffle is a range partition by slot, each range one shard: as slots are a permutation, the ranges are known without
sampling and equal in size whatever the input's skew. A shard is written by one task to a name of the attempt's own and
then renamed, so a lost or doubled task leaves whole shards. As the stored table and the shuffle hold all ids, sequences
travel in a code of frequent ids first, compressed with a dictionary, both learnt from SAMPLE documents; those change
sizes alone.

Defined cases: null and empty texts are their closing id; very long texts run over as many sequences as they need; null ids
stay null; repeated rows are written each; an empty table gives no shards and an empty result; extra columns are
left out; a vocabulary of more than 65,536 ids is refused.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planproof.llm.common import file_system, prepare, scoped, shared_path, stored, text_chunks
from planproof.llm.textblock import mix
from planproof.llm.tokens import default_path, word_ids

LENGTH = 2048
PER_SHARD = 2048
KEY = 20240611
ROUNDS = 6
#: Documents, and characters of each, that the code and its dictionary are learnt from. They change sizes alone.
SAMPLE, SAMPLE_CHARS, DICT_BYTES, LEVEL = 300, 20_000, 112 << 10, 3
#: Ids of one byte in the code; the next 31 * 256 have two, the others three.
ONE = 224


def feistel(x: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The places of the numbers x, all below n, in the keyed permutation of 0 to n - 1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = x.astype(np.uint64)
    todo = np.arange(out.size)
    while todo.size:
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


class Code:
    """Sequences of 16-bit ids as bytes: first a byte for each id, then the second bytes, then the ids of three bytes."""

    def __init__(self, sample: bytes, length: int):
        seen = np.bincount(np.frombuffer(sample, "<u2"), minlength=1 << 16)
        self.ids = np.argsort(-seen, kind="stable")
        self.rank = np.empty(1 << 16, np.int64)
        self.rank[self.ids] = np.arange(1 << 16)
        parts = [self.planes(sample[a : a + 2 * length]) for a in range(0, len(sample), 2 * length)]
        try:
            self.raw = zstandard.train_dictionary(DICT_BYTES, [p for p in parts if len(p) > 8]).as_bytes()
        except zstandard.ZstdError:  # too little to learn from
            self.raw = b""

    def planes(self, ids: bytes) -> bytes:
        r = self.rank[np.frombuffer(ids, "<u2")]
        two, three = (r >= ONE) & (r < ONE + 31 * 256), r >= ONE + 31 * 256
        lead = np.where(two, ONE + ((r - ONE) >> 8), np.where(three, 255, r)).astype(np.uint8)
        return lead.tobytes() + ((r[two] - ONE) & 255).astype(np.uint8).tobytes() + r[three].astype("<u2").tobytes()

    def ids_of(self, planes: bytes, n: int) -> bytes:
        b = np.frombuffer(planes, np.uint8)
        r = b[:n].astype(np.int64)
        three = np.flatnonzero(r == 255)
        two = np.flatnonzero((r >= ONE) & (r < 255))
        r[two] = ONE + ((r[two] - ONE) << 8) + b[n : n + two.size]
        r[three] = np.frombuffer(planes[n + two.size :], "<u2")
        return self.ids[r].astype("<u2").tobytes()

    def packer(self):
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(self.raw)).compress
        return lambda ids: pack(self.planes(ids))

    def unpacker(self, n: int):
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(self.raw)).decompress
        return lambda x: self.ids_of(unpack(x), n)


def learnt(docs: DataFrame, length: int, tokenizer: str) -> Code:
    words = word_ids(tokenizer, "H")
    texts = docs.where("text is not null").select(F.left("text", F.lit(SAMPLE_CHARS))).limit(SAMPLE).collect()
    return Code(b"".join(words.text(r[0]) for r in texts), length)


SEQUENCES = "part int, place long, ids binary, n_ids int, spans array<struct<doc_id:long,start:long,length:int,at:int>>"


def sequences(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, end_id: int = 0, code: Code | None = None) -> DataFrame:
    """Compressed sequences of each input partition with the spans (doc_id, start in the document, length, place) they hold."""
    prepare(docs.sparkSession)
    path = tokenizer or default_path()
    code = code or Code(b"", length)
    span = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("at", pa.int32())]))
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int32(), span)

    def run(batches):
        from pyspark import TaskContext

        pack = code.packer()
        part, words = TaskContext.get().partitionId(), word_ids(path, "H")
        close = end_id.to_bytes(2, "little")
        size, place = 2 * length, 0
        buffer, spans, done = bytearray(), [], []

        def flush():
            nonlocal done
            cols = list(zip(*done))
            done = []
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds)], ["part", "place", "ids", "n_ids", "spans"])

        for c in text_chunks(batches):
            for doc, text in zip(c.column("doc_id").to_pylist(), c.column("text").to_pylist()):
                raw = memoryview(words.text(text) + close)
                start = 0
                while start < len(raw):
                    take = min(size - len(buffer), len(raw) - start)
                    spans.append({"doc_id": doc, "start": start // 2, "length": take // 2, "at": len(buffer) // 2})
                    buffer += raw[start : start + take]
                    start += take
                    if len(buffer) == size:
                        done.append((part, place, pack(bytes(buffer)), length, spans))
                        buffer, spans, place = bytearray(), [], place + 1
            if len(done) >= 256:
                yield flush()
        if buffer:
            done.append((part, place, pack(bytes(buffer) + close * ((size - len(buffer)) // 2)), len(buffer) // 2, spans))
        if done:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, SEQUENCES)


def _write(fs: pafs.FileSystem, path: str, data: list[bytes]) -> None:
    mine = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(mine) as out:
        for x in data:
            out.write(x)
    fs.move(mine, path)


def materialise(docs: DataFrame, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, tokenizer: str | None = None) -> DataFrame:
    """Writes the shards to folder (a URI all nodes reach) and returns, per span of a document, where it was written:
    doc_id, start, length, slot, shard, offset (ids, in the shard), ids_crc32 (of the ids read back from the shard)."""
    spark = prepare(docs.sparkSession)
    code = learnt(docs, length, tokenizer or default_path())
    seqs = stored(sequences(docs, length, tokenizer, code=code), "sequences")
    sizes = seqs.groupBy("part").count()
    # One row a task, not a document: the counts of the tasks before each.
    totals = {r[0]: r[1] for r in sizes.collect()}
    parts = sorted(totals)
    starts = np.cumsum([0, *(totals[p] for p in parts)])
    n = int(starts[-1])
    base = dict(zip(parts, starts.tolist()))
    stride = 2 * length

    def place(batches):
        for c in batches:
            number = np.array([base[p] for p in c.column("part").to_pylist()], np.int64) + c.column("place").to_numpy(zero_copy_only=False)
            slot = feistel(number, n, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot // per_shard), pa.array(slot), c.column("ids"), c.column("spans")], ["shard", "slot", "ids", "spans"])

    kind = seqs.schema["spans"].dataType.simpleString()
    placed = seqs.mapInArrow(place, f"shard long, slot long, ids binary, spans {kind}")
    shards = max(1, -(-n // per_shard))
    ordered = placed.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("slot")
    out = "doc_id long, start long, length int, slot long, shard long, offset long, ids_crc32 long"
    names = ["doc_id", "start", "length", "slot", "shard", "offset", "ids_crc32"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

    def write(batches):
        fs, top = file_system(folder)
        fs.create_dir(top, recursive=True)

        def close(shard, rows):
            path = f"{top}/shard-{shard:08d}.bin"
            _write(fs, path, [r[1] for r in rows])
            found = []
            with fs.open_input_stream(path) as f:
                for slot, _, spans in rows:
                    raw = f.read(stride)
                    at = (slot - shard * per_shard) * length
                    found += [(s["doc_id"], s["start"], s["length"], slot, shard, at + s["at"], zlib.crc32(raw[2 * s["at"] : 2 * (s["at"] + s["length"])])) for s in spans]
            cols = list(zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds)], names)

        unpack = code.unpacker(length)
        shard, rows = None, []
        for c in batches:
            for s, slot, ids, spans in zip(*(c.column(x).to_pylist() for x in ("shard", "slot", "ids", "spans"))):
                if s != shard and rows:
                    yield close(shard, rows)
                    rows = []
                shard = s
                rows.append((slot, unpack(ids), spans))
        if rows:
            yield close(shard, rows)

    return ordered.mapInArrow(write, out)


def read_slots(folder: str, first: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD):
    """Sequences first, first + 1, ... in training order, as arrays of ids: a sequential read that resumes anywhere."""
    fs, top = file_system(folder)
    stride = 2 * length
    while count > 0:
        shard, at = divmod(first, per_shard)
        path = f"{top}/shard-{shard:08d}.bin"
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return
        with fs.open_input_file(path) as f:
            f.seek(at * stride)
            raw = f.read(stride * min(count, per_shard - at))
        got = np.frombuffer(raw, "<u2").reshape(-1, length)
        if not len(got):
            return
        yield from got
        first, count = first + len(got), count - len(got)


@scoped
def materialised(docs: DataFrame, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """materialise() into a new folder of the shared storage; the result is stored, so shards are written once, and stay."""
    return materialise(docs, shared_path(docs.sparkSession, "shards"), length, per_shard, key)
