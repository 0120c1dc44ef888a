"""Near-duplicates by BagMinHash: weighted minwise signatures, banding, exact multiset overlap.

A text is the multiset of its five-word shingles. The weight axis of a shingle is cut into [0, 1), [1, 2),
[2, 4), [4, 8), ...; each interval has a Poisson process of its own whose rate is its length in each of `m`
components. A point of [2^k, 2^(k+1)) is placed by k further random bits (the halvings of the interval), and
counts if it lies below the shingle's count. A component's signature is its earliest point, so two texts
agree in it with probability sum(min) / sum(max), their weighted Jaccard similarity. A text of total weight W
needs the points before (ln m + x) / W alone: about m ln m of them, however long the text is.

Texts that are the same words are one class, whose lowest doc_id stands for it. Representatives that share a
band are candidates. Links are tested exactly (multiset overlap of whole texts, similarity >= 0.8) without
making all pairs of a bucket; what is moved and compared are shingle hashes, made once for each candidate:

1. Each member is tested with its bucket's lowest id. A pair within one component cannot change the components, so
   it needs no test from there on; buckets of one component are done.
2. Of the texts left, one goes out if more than a fifth of its shingles are in no text of another component: it cannot
   overlap any of those by enough. That is repeated while it helps, as each text that goes takes its shingles along.
3. What still stands in a bucket with another component is compared in blocks. Texts of one size class (sizes within a
   factor of 1.25) are dealt to blocks; a task holds two blocks of the same or of neighbouring classes, as others cannot be near,
   gets all overlaps between them as one matrix product, and returns a spanning set of links between components.

Defined cases: null and empty texts, and null ids, are near nothing and are classes of their own; a text of one to
four words is one shingle; very long texts are read whole, and cost memory by their length alone; rows that share a doc_id
are one document; the lowest doc_id of a group stands for it; an empty table gives an empty result; extra columns are
ignored by `groups` and kept by `keep_one`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planproof.llm.common import prepare, scoped, stored, text_chunks
from planproof.llm.textblock import MULT, Words, mix, multisets, shingles

M = 128
BANDS = 32
SIZE = 5
LEAST = 0.8
#: Ids up to this many are broadcast to pick rows of a large table; more are joined by shuffle.
BROADCAST_ROWS = 2_000_000
#: Texts of a bucket and size class, and shingles of them, in a block; a task holds two blocks.
BLOCK, BLOCK_SHINGLES = 1024, 500_000
_STEP, _COMPONENT, _PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def signatures(doc: np.ndarray, h: np.ndarray, count: np.ndarray, docs: int, m: int = M, x: float = 4.0) -> np.ndarray:
    """(docs, m) ids of the earliest points; rows of texts without shingles are 0."""
    total = np.bincount(doc, weights=count, minlength=docs)
    levels = 1 + np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
    e = np.repeat(np.arange(doc.size), levels)
    level = np.arange(e.size) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, np.int64(1) << np.maximum(level - 1, 0))
    rate = m * np.maximum(low, 1).astype(np.float64)
    bits = np.maximum(level - 1, 0).astype(np.uint64)
    owner, weight = doc[e], count[e]
    with np.errstate(divide="ignore"):
        bound = ((np.log(m) + x) / total)[owner] if e.size else np.zeros(0)
    key = mix(h[e] * MULT[60] + level.astype(np.uint64) * MULT[61])
    t, made = np.zeros(e.size), 0
    found: list[tuple] = []
    while key.size:
        # Points are numbered, so one step makes many of them for each of the few intervals that still need points.
        many = int(min(512, max(1, 65536 // key.size)))
        s = mix(key[:, None] + np.arange(made + 1, made + many + 1, dtype=np.uint64) * _STEP)
        gap = -np.log(((s >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / rate[:, None]
        gap[:, 0] += t
        at = np.cumsum(gap, axis=1)
        i, j = np.nonzero(at < bound[:, None])
        s, near = s[i, j], at[i, j]
        place = low[i]
        halved = bits[i]
        if halved.any():
            place = place + np.where(halved > 0, mix(s ^ _PLACE) >> (np.uint64(64) - np.maximum(halved, np.uint64(1))), np.uint64(0)).astype(np.int64)
        hit = place < weight[i]
        found.append((owner[i][hit] * m + (mix(s[hit] ^ _COMPONENT) % np.uint64(m)).astype(np.int64), near[hit], s[hit]))
        on = at[:, -1] < bound
        t, made = at[on, -1], made + many
        key, rate, bound, owner, weight, low, bits = (v[on] for v in (key, rate, bound, owner, weight, low, bits))
    out = np.zeros(docs * m, np.uint64)
    if found:
        slot, at, who = (np.concatenate(v) for v in zip(*found))
        least = np.full(docs * m, np.inf)
        np.minimum.at(least, slot, at)
        first = at == least[slot]
        out[slot[first]] = who[first]
        out = out.reshape(docs, m)
        lacking = np.flatnonzero(np.isinf(least.reshape(docs, m)).any(axis=1) & (total > 0))
        if lacking.size:
            mine = np.isin(doc, lacking)
            again = signatures(np.searchsorted(lacking, doc[mine]), h[mine], count[mine], lacking.size, m, 2 * x + 16)
            out[lacking] = again
    return out.reshape(docs, m)


def bands_of(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(docs, bands) keys; the band's number is part of its key."""
    r = sig.shape[1] // bands
    key = (sig.reshape(len(sig), bands, r) * MULT[:r]).sum(axis=2, dtype=np.uint64)
    return mix(key + np.arange(bands, dtype=np.uint64) * MULT[62]).view(np.int64)


SIGNED = "doc_id long, f1 long, f2 long, size long, bands array<long>"


def signed(docs: DataFrame, bands: int = BANDS) -> DataFrame:
    """Per row: fingerprints of the word sequence, number of shingles, band keys."""
    prepare(docs.sparkSession)

    def run(batches):
        for c in text_chunks(batches):
            w = Words(c.column("text"))
            d, h, n = multisets(*shingles(w, SIZE), w.docs)
            keys = bands_of(signatures(d, h, n, w.docs), bands)
            at = np.arange(w.hash.size) - w.first[w.doc] if w.hash.size else np.zeros(0, np.int64)
            prints = []
            for k in (50, 51):
                p = np.zeros(w.docs, np.uint64)
                np.add.at(p, w.doc, mix(w.hash ^ mix(at.astype(np.uint64) * MULT[k])))
                prints.append(mix(p ^ w.n.astype(np.uint64)).view(np.int64))
            size = np.bincount(d, weights=n, minlength=w.docs).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(w.docs + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([c.column("doc_id").cast(pa.int64()), pa.array(prints[0]), pa.array(prints[1]), pa.array(size), lists], ["doc_id", "f1", "f2", "size", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def packed(h: np.ndarray, count: np.ndarray) -> bytes:
    """A multiset of 48-bit hashes: how many, six bytes each, then place and count of those that stand several times."""
    more = np.flatnonzero(count > 1)
    rest = np.column_stack([more, count[more]]).astype("<u4")
    return np.uint32(h.size).tobytes() + h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() + rest.tobytes()


def unpacked(bags: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bag, hash, count) of all entries of the bags."""
    sizes = np.array([int.from_bytes(x[:4], "little") for x in bags], np.int64)
    raw = np.frombuffer(b"".join(x[4 : 4 + 6 * n] for x, n in zip(bags, sizes.tolist())), np.uint8).reshape(-1, 6)
    wide = np.zeros((raw.shape[0], 8), np.uint8)
    wide[:, :6] = raw
    count = np.ones(raw.shape[0], np.int64)
    first = np.cumsum(sizes) - sizes
    for x, n, at in zip(bags, sizes.tolist(), first.tolist()):
        if len(x) > 4 + 6 * n:
            rest = np.frombuffer(x, "<u4", offset=4 + 6 * n).reshape(-1, 2)
            count[at + rest[:, 0]] = rest[:, 1]
    return np.repeat(np.arange(sizes.size), sizes), wide.view("<u8").ravel().astype(np.uint64), count


def bags(docs: DataFrame) -> DataFrame:
    """doc_id and the multiset of shingles of each text."""

    def run(batches):
        for c in text_chunks(batches):
            w = Words(c.column("text"))
            d, h, n = multisets(*shingles(w, SIZE), w.docs)
            edge = np.searchsorted(d, np.arange(w.docs + 1)).tolist()
            raw = [packed(h[a:b], n[a:b]) for a, b in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays([c.column("doc_id").cast(pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "bag"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, bag binary")


def similarity(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Weighted Jaccard similarity of the multisets a[i] and b[i]; 0 where both are empty."""
    n = len(a)
    d, h, count = unpacked([*a, *b])
    size = np.bincount(d, weights=count, minlength=2 * n)
    key = ((d % max(n, 1)).astype(np.uint64) << np.uint64(48)) | h
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    both = np.bincount((key[same] >> np.uint64(48)).astype(np.int64), weights=np.minimum(count[same], count[same + 1]), minlength=n)
    union = size[:n] + size[n:] - both
    return np.where(union > 0, both / np.maximum(union, 1), 0.0)


def picked(table: DataFrame, ids: DataFrame, rows: int, how: str) -> DataFrame:
    """table's rows whose doc_id is (left_semi) or is not (left_anti) in ids; ids are broadcast up to a checked size."""
    return table.join(F.broadcast(ids) if rows <= BROADCAST_ROWS else ids, "doc_id", how)


def verified(pairs: DataFrame, held: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b, near) of each pair, by the overlap of the whole texts, stored."""
    sides = (held.select(F.col("doc_id").alias(x), F.col("bag").alias(f"{x}_bag")) for x in ("a", "b"))
    both = pairs.join(next(sides), "a").join(next(sides), "b")

    def run(batches):
        for c in text_chunks(batches, "a_bag", "b_bag"):
            near = similarity(c.column("a_bag").to_pylist(), c.column("b_bag").to_pylist()) >= least
            yield pa.RecordBatch.from_arrays([c.column("a"), c.column("b"), pa.array(near)], ["a", "b", "near"])

    return stored(both.select("a", "b", "a_bag", "b_bag").mapInArrow(run, "a long, b long, near boolean"), "tested")


def hopeful(held: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of held (rep, comp, size, bag) that share enough shingles with texts of other components to be near one."""

    def run(batches):
        for c in text_chunks(batches, "bag"):
            d, h, n = unpacked(c.column("bag").to_pylist())
            ids, comp = (c.column(x).to_numpy(zero_copy_only=False)[d] for x in ("rep", "comp"))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids), pa.array(comp), pa.array(n)], ["h", "rep", "comp", "n"])

    many = held.count()
    while many:
        parts = stored(held.select("rep", "comp", "bag").mapInArrow(run, "h long, rep long, comp long, n long"), "parts")
        spread = parts.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("h")
        met = parts.join(spread, "h", "left_semi").groupBy("rep").agg(F.sum("n").alias("met"))
        held = stored(held.join(met, "rep").where(F.col("met") >= least * F.col("size")).drop("met"), "hopeful")
        left = held.count()
        if left > 0.9 * many:
            break
        many = left
    return held


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of the nodes of links (a, b): the lowest id each reaches. A step takes the lowest label along the
    links, then that label's own label; each is a stored table, until nothing changes."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "labels")
    while True:
        reach = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(reach, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("via"))
        target = labels.select(F.col("node").alias("via"), F.col("comp").alias("next"))
        jumped = stored(step.join(target, "via").select("node", "old", F.least("via", "next").alias("comp")), "labels")
        labels = jumped.select("node", "comp")
        if jumped.where("comp <> old").isEmpty():
            return labels


def _mixed(at: DataFrame) -> DataFrame:
    """(band, n, members, weight) of the buckets in which several components stand; of buckets of the same members one."""
    parts = at.groupBy("band", "comp").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("members"), F.sum("size").alias("weight"))
    whole = parts.groupBy("band").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("members").alias("members"), F.sum("weight").alias("weight")).where("parts > 1")
    return stored(whole.groupBy("n", "members", "weight").agg(F.min("band").alias("band")), "mixed")


def overlaps(doc: np.ndarray, h: np.ndarray, count: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sums of the smaller counts of each text of left and each of right. doc: index into both joined; a shingle's counts
    become levels weighted by their steps, so the product of two 0/1 matrices is exact."""
    order = np.lexsort((count, h))
    doc, h, count = doc[order], h[order], count[order]
    level = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (count[1:] != count[:-1])]))
    fresh = np.concatenate([[True], h[level][1:] != h[level][:-1]])
    step = np.where(fresh, count[level], np.diff(count[level], prepend=0))
    of = np.repeat(np.arange(level.size), np.diff(np.append(level, h.size)))  # the level of each entry
    group = np.cumsum(fresh) - 1
    begin = np.flatnonzero(fresh)[group[of]]  # a count holds at all levels up to its own
    many = np.diff(np.append(np.flatnonzero(fresh), level.size))
    seen = np.bincount(group[of], minlength=many.size)
    keep = seen[group[of]] > 1
    doc, of, begin = doc[keep], of[keep], begin[keep]
    reach = of - begin + 1
    row = np.repeat(doc, reach)
    col = np.repeat(begin, reach) + np.arange(int(reach.sum())) - np.repeat(np.cumsum(reach) - reach, reach)
    used, col = np.unique(col, return_inverse=True)
    weight = step[used].astype(np.float64)
    out = np.zeros((left.size, right.size))
    place = np.full(int(max(left.max(initial=-1), right.max(initial=-1))) + 1, -1)
    for a in range(0, used.size, 4096):
        mine = (col >= a) & (col < a + 4096)
        r, c = row[mine], col[mine] - a
        sides = []
        for side in (left, right):
            place[:] = -1
            place[side] = np.arange(side.size)
            x = np.zeros((side.size, min(4096, used.size - a)), np.float64 if weight.sum() > 1 << 24 else np.float32)
            at = place[r]
            x[at[at >= 0], c[at >= 0]] = 1
            sides.append(x)
        out += (sides[0] * weight[a : a + 4096].astype(sides[0].dtype)) @ sides[1].T
    return out


def block_links(table: pa.Table, least: float = LEAST) -> pa.Table:
    """(a, b): components that a near pair of the two blocks joins, as a forest."""
    comp, left, right = (table.column(n).to_numpy() for n in ("comp", "left", "right"))
    d, h, n = unpacked(table.column("bag").to_pylist())
    size = np.bincount(d, weights=n, minlength=table.num_rows)
    left, right = np.flatnonzero(left), np.flatnonzero(right)
    both = overlaps(d, h, n, left, right)
    near = both >= least * (size[left][:, None] + size[right][None, :] - both)
    x, y = np.nonzero(near & (comp[left][:, None] != comp[right][None, :]))
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c] = root.get(root[c], root[c])
        return c

    found = []
    for a, b in zip(comp[left[x]].tolist(), comp[right[y]].tolist()):
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            found.append((min(a, b), max(a, b)))
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def dealt(at: DataFrame, block: int) -> DataFrame:
    """The rows of at (band, rep, comp, size) for each pair of blocks they stand in: band, of, i, j tell the pair, left and
    right its sides. of is the lower size class, or, for pairs of blocks of two classes, that and a half."""
    rung = F.floor(F.log("size") / F.log(F.lit(1 / LEAST))).cast("int")
    at = at.withColumn("rung", rung)
    parts = F.ceil(F.greatest(F.count("*") / block, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    many = at.groupBy("band", "rung").agg(parts.alias("parts"))
    near = many.groupBy("band").agg(F.map_from_entries(F.collect_list(F.struct("rung", "parts"))).alias("parts"))
    at = at.join(near, "band").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")[F.col("rung")]).cast("int"))
    count = lambda step: F.coalesce(F.try_element_at("parts", F.col("rung") + step), F.lit(0))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    mine, rung = F.col("block"), F.col("rung").cast("double")
    same = F.transform(upto(count(0)), lambda o: F.struct(rung.alias("of"), F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j"), (mine <= o).alias("left"), (mine >= o).alias("right")))
    up = F.transform(upto(count(1)), lambda o: F.struct((rung + 0.5).alias("of"), mine.alias("i"), o.alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right")))
    down = F.transform(upto(count(-1)), lambda o: F.struct((rung - 0.5).alias("of"), o.alias("i"), mine.alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right")))
    return at.select("band", "rep", "comp", F.inline(F.concat(same, up, down)))


@scoped
def groups(docs: DataFrame, bands: int = BANDS, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id for each row: the lowest doc_id of its group of near-duplicates."""
    prepare(docs.sparkSession)
    sig = stored(signed(docs, bands), "signed")
    known = sig.where("size > 0 and doc_id is not null")
    classes = stored(known.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")), "classes")
    members = known.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.explode("bands").alias("band"), F.col("doc_id").alias("rep"), "size")
    heads = stored(members.groupBy("band").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last").select("band", "lead"), "heads")
    buckets = stored(members.join(heads, "band"), "buckets")
    ids = stored(buckets.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    held = stored(bags(picked(docs.select("doc_id", "text"), ids, ids.count(), "left_semi")).dropDuplicates(["doc_id"]), "bags")
    tested = verified(buckets.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct(), held, least)
    copies = known.join(classes, ["f1", "f2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    comps = components(copies.union(tested.where("near").select("a", "b")))
    at = buckets.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", "size", F.coalesce("comp", "rep").alias("comp"))
    at = stored(at, "at")
    open_ = stored(at.join(_mixed(at).select("band"), "band", "left_semi"), "open")
    one = open_.groupBy("rep").agg(F.min("comp").alias("comp"), F.min("size").alias("size"))
    left = hopeful(stored(held.withColumnRenamed("doc_id", "rep").join(one, "rep"), "held"), least)
    at = stored(open_.join(left.select("rep"), "rep", "left_semi"), "at")
    sides = dealt(at.join(_mixed(at).select("band"), "band", "left_semi"), block)
    key = ["band", "of", "i", "j"]
    pair = sides.join(left.select("rep", "bag"), "rep").select(*key, "left", "right", "comp", "bag")
    met = stored(pair.groupBy(*key).applyInArrow(lambda t: block_links(t, least), "a long, b long").distinct(), "met")
    if not met.isEmpty():
        # Only components meet here, and a component is a node of its own, so labels stay links.
        comps = components(comps.select(F.col("comp").alias("a"), F.col("node").alias("b")).union(met))
    return sig.select("doc_id").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("comp", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, bands: int = BANDS, least: float = LEAST) -> DataFrame:
    """docs without near-duplicates: the row with the lowest doc_id of each group stays, all columns as they are."""
    marked = marks(docs, bands, least)
    gone, again = (marked.where(F.col("again") == x).select("doc_id") for x in (False, True))
    kept = picked(docs, gone, gone.count(), "left_anti")
    twice = again.count()
    if not twice:
        return kept
    once = picked(kept, again, twice, "left_semi").dropDuplicates(["doc_id"])
    return picked(kept, again, twice, "left_anti").unionByName(once.select(*docs.columns))


@scoped
def marks(docs: DataFrame, bands: int = BANDS, least: float = LEAST) -> DataFrame:
    """doc_id, again: documents that go (false), and those that stay of which there are several rows (true)."""
    found = groups(docs, bands, least).where("doc_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n"))
    return found.where("doc_id <> class_id or n > 1").select("doc_id", (F.col("doc_id") == F.col("class_id")).alias("again"))
