"""Benchmark decontamination by templates.

Texts become token sequences in which numbers, units after numbers and (in a second reading) names are typed
placeholders. Windows of eight tokens are hashed; windows of documents that may be in the benchmark (a bitmap sized by the
benchmark says so) are joined by hash with the benchmark's. Slots must be consistent over all that a document and an item
share in a reading, wherever it lies in the document: a slot value of the item always stands for the same value in the
document. Where it has several there, it stands for itself if that is one of them, else for the one in most
windows; only windows that contradict this are dropped, so those with the item's own values always count.
A document is contaminated by an item if consistent windows cover half of the item's windows (all, or the template
ones), or if they agree on 13 tokens in a row. Changed numbers, units or names are `reparameterised`.

Reading 0 keeps names as lower-cased words; reading 1 masks capitalised words, a run of them as one. A template window
needs five plain words at least (a shorter item three fifths), so placeholders alone match nothing. Windows of reading 0
with fewer are hashed by their tokens as they stand and match verbatim only. Coverage is the
greater of the shares of all windows and of the template windows.

Defined cases: null and empty texts, null ids and items of fewer than five tokens match nothing; items of five to
seven tokens are one window; very long texts are read whole, and a passage that stands in one many times counts once;
repeated rows of documents give one pair; of slot values in equally many windows the lowest hash stands; an empty table on
either side gives an empty result; extra columns are ignored by `pairs` and kept by `clean`.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planproof.llm.bagminhash import picked
from planproof.llm.common import blocks_of, prepare, scoped, stored, text_chunks
from planproof.llm.textblock import MULT, joined, mix, run_hashes

WINDOW = 8
SHORTEST = 5
PLAIN = 5
COVER = 0.5
RUN = 13
#: Least and most slots of the bitmap, which has 16 for each benchmark window; most is also the most numbers that come to the
#: driver, and 8 MB a task. A benchmark too large for it lets more windows through; the join decides all the same.
BITMAP_LEAST, BITMAP_MOST = 1 << 22, 1 << 26
#: Benchmark windows up to this many are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000
# Units that may follow a number.
UNITS = (
    "km m cm mm mi mile miles ft feet foot in inch inches yd yards kg g mg lb lbs pound pounds oz ounces ton tons l ml liter liters litre litres gallon gallons cup cups "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh degrees degree percent dollars dollar euros euro cents cent usd eur "
    "watt watts volt volts hz khz mhz kb mb gb tb"
).split()
NUMBER, UNIT, NAME, RAW = (MULT[i] for i in (40, 41, 42, 43))
_CLASS = np.zeros(256, np.int8)
_CLASS[[*range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_ENDS = np.zeros(256, np.int8)
_ENDS[[ord(c) for c in ".!?:\n"]] = 1
ROWS = "id long, reading int, size int, pos int, hash long, template boolean, slots array<long>"
MATCHED = "doc_id long, item_id long, reading int, size int, n int, n_template int, run int, changed boolean"


def _lowered(b: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case; no byte moves."""
    low = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
    after = np.concatenate([[False], b[:-1] == 0xC3]) if b.size else np.zeros(0, bool)
    return np.where(after & (b >= 0x80) & (b <= 0x9E) & (b != 0x97), b + 32, low).astype(np.uint8)


_UNIT_HASHES = np.sort(run_hashes(np.frombuffer("".join(UNITS).encode(), np.uint8), np.cumsum([0, *map(len, UNITS[:-1])]), np.cumsum([len(u) for u in UNITS])))


class Tokens:
    """doc, code (hash of the canonical token), value (hash of the raw token), plain (no placeholder), per reading."""

    def __init__(self, texts: pa.Array):
        b, self.offset = joined(texts, lower=False)
        self.docs = len(self.offset) - 1
        low = _lowered(b)
        cls = _CLASS[b]
        if b.size > 2:
            inner = np.flatnonzero(((b[1:-1] == 46) | (b[1:-1] == 44)) & (cls[:-2] == 2) & (cls[2:] == 2)) + 1
            cls[inner] = 2
        before = np.concatenate([[np.int8(0)], cls[:-1]]) if b.size else cls
        after = np.concatenate([cls[1:], [np.int8(0)]]) if b.size else cls
        start, end = np.flatnonzero((cls > 0) & (cls != before)), np.flatnonzero((cls > 0) & (cls != after)) + 1
        doc = np.searchsorted(self.offset, start, side="right") - 1
        value = run_hashes(low, start, end)
        number = cls[start] == 2
        second = b[np.minimum(start + 1, b.size - 1)] if b.size else b
        capital = ((b[start] >= 65) & (b[start] <= 90)) | ((b[start] == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        follows = np.concatenate([[False], number[:-1] & (doc[1:] == doc[:-1])]) if start.size else number
        at = np.minimum(np.searchsorted(_UNIT_HASHES, value), _UNIT_HASHES.size - 1)
        unit = follows & (_UNIT_HASHES[at] == value)
        plain = ~(number | unit)
        code = np.where(number, NUMBER, np.where(unit, UNIT, value))
        name = capital & plain
        head = ~name
        if start.size:
            head |= np.concatenate([[True], ~(name[:-1] & (doc[1:] == doc[:-1]))])
        masked = np.where(name, NAME, code)
        whole = np.add.reduceat(value, np.flatnonzero(head)) if start.size else value
        self.readings = ((doc, code, value, plain), (doc[head], masked[head], whole, (plain & ~name)[head]))

    def windows(self, reading: int, size: int, whole: bool = False):
        """(first token, its position in the text, hash, template) of each window of `size` tokens; those with too few
        plain words are no templates: reading 0 has them by the hash of their raw tokens, reading 1 not at all.
        whole: of texts of just that many tokens."""
        doc, code, value, plain = self.readings[reading]
        n = np.bincount(doc, minlength=self.docs) if doc.size else np.zeros(self.docs, np.int64)
        first = np.cumsum(n) - n
        if doc.size < size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        k = doc.size - size + 1
        h, good = np.zeros(k, np.uint64), np.zeros(k, np.int64)
        for i in range(size):
            h += code[i : i + k] * MULT[i]
            good += plain[i : i + k]
        least = PLAIN if size == WINDOW else -(-3 * size // 5)
        template = good >= least
        ok = (doc[:k] == doc[size - 1 :]) & (template | (reading == 0))
        if whole:
            ok &= n[doc[:k]] == size
        raw = np.flatnonzero(ok & ~template)
        h[raw] = sum((value[raw + i] * MULT[i] for i in range(size)), np.zeros(raw.size, np.uint64)) ^ RAW
        i = np.flatnonzero(ok)
        return i, i - first[doc[i]], mix(h[i] ^ np.uint64(size * 2 + reading)), template[i]

    def slots(self, reading: int, i: int, size: int) -> list[int]:
        _, _, value, plain = self.readings[reading]
        at = i + np.flatnonzero(~plain[i : i + size])
        return value[at].view(np.int64).tolist()


def _rows(c: pa.RecordBatch, key: str, sizes, whole: bool, bitmap: np.ndarray | None) -> pa.RecordBatch:
    t = Tokens(c.column("text"))
    ids = c.column(key).to_pylist()
    cols: list[list] = [[] for _ in range(7)]
    for reading in (0, 1):
        doc = t.readings[reading][0]
        for size in sizes:
            i, pos, h, template = t.windows(reading, size, whole and size < WINDOW)
            if bitmap is not None:
                slot = (h & np.uint64(bitmap.size * 8 - 1)).astype(np.int64)
                may = (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
                i, pos, h, template = i[may], pos[may], h[may], template[may]
            for a, p, x, m in zip(i.tolist(), pos.tolist(), h.view(np.int64).tolist(), template.tolist()):
                if ids[doc[a]] is not None:
                    # what matches verbatim has no slots to compare
                    for col, v in zip(cols, (ids[doc[a]], reading, size, p, x, m, t.slots(reading, a, size) if m else [])):
                        col.append(v)
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds)], ["id", "reading", "size", "pos", "hash", "template", "slots"])


def windows(rows: DataFrame, key: str, sizes, whole: bool, bitmap: np.ndarray | None = None) -> DataFrame:
    prepare(rows.sparkSession)

    def run(batches):
        for c in text_chunks(batches):
            yield _rows(c, key, sizes, whole, bitmap)

    return rows.select(key, "text").mapInArrow(run, ROWS)


def consistent(lines: list[list[dict]]) -> list[list[dict]]:
    """The windows (theirs, slots) of all alignments that do not contradict the one map from values to values."""
    stands: dict[int, Counter] = {}
    pairs = [[set(zip(w["theirs"], w["slots"])) for w in line] for line in lines]
    for p in (p for line in pairs for p in line):
        alone = len({a for a, _ in p}) == len(p)
        for a, b in p:
            stands.setdefault(a, Counter())[b] += alone
    chosen = {a: a if a in n else max(n, key=lambda b: (n[b], -b)) for a, n in stands.items()}
    return [[w for w, p in zip(line, of) if all(chosen[a] == b for a, b in p)] for line, of in zip(lines, pairs)]


def longest(line: list[dict], size: int) -> int:
    """Tokens of the longest run of windows that follow each other in the item (nth) and touch (at)."""
    most = begin = 0
    before = None
    for w in sorted(line, key=lambda w: w["at"]):
        if before is None or w["nth"] - before["nth"] > 1 or w["at"] - before["at"] > size:
            begin = w["at"]
        most, before = max(most, w["at"] - begin + size), w
    return most


def _matched(batches):
    for c in batches:
        rows = []
        for *key, lines in zip(*(x.to_pylist() for x in c.columns)):
            kept = consistent(lines)
            at = {w["at"] for line in kept for w in line}
            if at:
                template = {w["at"] for line in kept for w in line if w["template"]}
                run = max(longest(line, key[-1]) for line in kept)
                changed = all(any(w["theirs"] != w["slots"] for w in line) for line, some in zip(lines, kept) if some)
                rows.append((*key, len(at), len(template), run, changed))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows) if rows else [()] * 8, kinds)], [f.split()[0] for f in MATCHED.split(", ")])


@scoped
def pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, coverage, longest_run, reparameterised of each contaminated document and item."""
    items = windows(benchmark, "item_id", range(SHORTEST, WINDOW + 1), True).dropDuplicates(["id", "reading", "size", "pos", "hash"])
    items = stored(items.withColumn("nth", F.dense_rank().over(W.partitionBy("id", "reading", "size").orderBy("pos"))), "items")
    many = items.count()
    room = min(BITMAP_MOST, max(BITMAP_LEAST, 1 << (16 * many).bit_length()))
    slots = blocks_of(items.select(F.col("hash").bitwiseAND(F.lit(room - 1)).cast("int").alias("slot")).distinct())["slot"].to_numpy()
    bitmap = np.zeros(room >> 3, np.uint8)
    np.bitwise_or.at(bitmap, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())
    found = stored(windows(docs, "doc_id", sizes, False, bitmap), "found")
    # One row a hash: a window that many documents share is then a hot key on the documents' side alone, which the
    # skew join splits; its items are unfolded where it lies.
    key = ["reading", "size", "hash", "template"]
    side = items.groupBy(*key).agg(F.collect_list(F.struct(F.col("id").alias("item_id"), F.col("pos").alias("at"), "nth", F.col("slots").alias("theirs"))).alias("hits"))
    side = F.broadcast(side) if many <= BROADCAST_ROWS else side
    met = found.join(side, key).select(F.col("id").alias("doc_id"), "reading", "size", "template", "pos", "slots", F.inline("hits"))
    key = ["doc_id", "item_id", "reading", "size"]
    line = F.sort_array(F.collect_set(F.struct("at", "nth", "theirs", "slots", "template")))
    lines = met.groupBy(*key, (F.col("pos") - F.col("at")).alias("shift")).agg(line.alias("line")).groupBy(*key).agg(F.collect_set("line").alias("lines"))
    total = items.groupBy(F.col("id").alias("item_id"), "reading", "size").agg(F.count("*").alias("of"), F.count_if("template").alias("of_template"))
    share = F.greatest(F.col("n") / F.col("of"), F.when(F.col("of_template") > 0, F.col("n_template") / F.col("of_template")))
    scored = lines.mapInArrow(_matched, MATCHED).join(total, ["item_id", "reading", "size"]).withColumn("coverage", share)
    hit = scored.where((F.col("coverage") >= COVER) | (F.col("run") >= RUN))
    return hit.groupBy("doc_id", "item_id").agg(F.max("n").alias("n_windows"), F.round(F.max("coverage"), 6).alias("coverage"), F.max("run").alias("longest_run"), F.min("changed").alias("reparameterised"))


@scoped
def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return pairs(docs, benchmark).select("doc_id").distinct()


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated documents, all columns as they are."""
    gone = leaks(docs, benchmark)
    return picked(docs, gone, gone.count(), "left_anti")
