"""Cross-entropy difference of two n-gram models.

The target model counts the documents labelled good, the background model counts all documents. Both are bigram
models with Dirichlet back-off to unigrams; the background's counts are
scaled to the target's number of tokens, so both trust their counts alike. A document's score is its
mean loss a token under the background model less that under the target model: higher is more like the target.
Each document is scored by models that lack its own counts (they are taken off again, exactly), so a score tells what
the other documents say of it and not that a model has seen it.

Counts cover every token of every document, and each n-gram has a count of its own: keys are hashes of 63 bits and
one bit that keeps unigrams and contexts apart from bigrams (of n distinct keys about n^2 / 2^64 pairs collide). Nothing of the model comes to the driver or is
broadcast; what is gathered grows with the corpus:

1. Each task codes its documents in blocks of about BLOCK tokens; the blocks are stored.
2. Each block sends its distinct keys with their counts, cut by ranges of keys, to the parts of the model. There are as
   many parts as the corpus needs, so a part stays at about PART tokens.
3. Each part adds up its keys and answers every block with the sums, in the block's order.
4. Blocks and their answers are joined, and the block's documents are scored, some at a time.

Defined cases: null and empty texts have no tokens and null losses and score; a very long text is a block of its own; null or
repeated labels count as the highest of the id; repeated rows count and score as often as they stand, each without its own
counts alone; null ids are scored and are no targets; without (other) target documents its model is uniform; an
empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planproof.llm.common import prepare, scoped, stored, text_chunks
from planproof.llm.textblock import MULT, Words, mix

#: A word of no document has a count of one among so many.
VOCABULARY = 1 << 20
PRIOR = 200.0
BEGIN = MULT[55]
BLOCK = 1 << 21
PART = 1 << 21
#: Tokens of the documents that are scored at a time (a longer document is scored alone).
SLICE = 1 << 18
#: Target ids up to this many are broadcast, so no text moves; more are joined by shuffle.
BROADCAST_ROWS = 2_000_000
BLOCKS = "block long, ids array<long>, lengths array<int>, target array<boolean>, n long, n_target long, words binary, tokens binary"
SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def packed(a: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def unpacked(raw: bytes, kind) -> np.ndarray:
    b = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(b.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class Block:
    """Documents as word numbers. keys: distinct n-grams, sorted; b and t: their counts in all and in target documents.

    one and two are the places in keys of each word and of each distinct bigram; pair is the number of each token's
    bigram, word and before the words of each distinct bigram."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, target: np.ndarray):
        begin = words.size
        words = np.append(words, BEGIN)
        self.lengths, self.target = lengths, target
        start = (np.cumsum(lengths) - lengths)[lengths > 0]
        before = np.concatenate([[begin], tokens[:-1]]).astype(np.int64)
        before[start] = begin
        pairs, self.pair = np.unique(before * words.size + tokens, return_inverse=True)
        self.before, self.word = pairs // words.size, pairs % words.size
        one = mix(words * MULT[10]) & ~np.uint64(1)
        two = mix(words[self.before] * MULT[11] + words[self.word] * MULT[12]) | np.uint64(1)
        keys = np.concatenate([one, two])
        order = np.argsort(keys)
        place = np.empty(order.size, np.int64)
        place[order] = np.arange(order.size)
        self.keys, self.one, self.two = keys[order], place[: words.size], place[words.size :]
        chosen = np.repeat(target, lengths)
        self.b, self.t = (
            # BEGIN is a context as often as texts begin
            np.concatenate([np.bincount(w, minlength=begin), [n], np.bincount(p, minlength=two.size)])[order]
            for w, n, p in ((tokens, start.size, self.pair), (tokens[chosen], int((target & (lengths > 0)).sum()), self.pair[chosen]))
        )

    @classmethod
    def of(cls, row: dict) -> Block:
        return cls(unpacked(row["words"], np.uint64), unpacked(row["tokens"], np.int32), np.array(row["lengths"], np.int64), np.array(row["target"], bool))

    def losses(self, target: np.ndarray, all_: np.ndarray, target_tokens: int, all_tokens: int) -> np.ndarray:
        """(2, documents) mean losses a token under the target and the background model, given the corpus' counts of the
        keys in their order; each document's own counts are left out."""
        out = np.zeros((2, self.lengths.size))
        ends = np.cumsum(self.lengths)
        cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(SLICE, int(ends[-1]) + SLICE, SLICE)) + 1]).clip(0, ends.size))
        for d, e in zip(cuts, cuts[1:]):
            n = self.lengths[d:e]
            pair = self.pair[ends[d] - n[0] : ends[e - 1]]
            if not pair.size:
                continue
            doc = np.repeat(np.arange(n.size), n)
            word, before = self.word[pair], self.before[pair]
            own = []
            for v in (pair, word):
                key, at, many = np.unique(doc * (int(v.max()) + 1) + v, return_inverse=True, return_counts=True)
                own.append(many[at])
            # a context counts as often as its word, BEGIN once
            begin = before == self.one.size - 1
            at = np.searchsorted(key, np.where(begin, key[0], doc * (int(word.max()) + 1) + before))
            own.append(np.where(begin, 1, many[at]))
            mine = self.target[d:e]
            rest = target_tokens - n * mine, all_tokens - n
            scale = np.where((rest[0] > 0) & (rest[1] > 0), rest[0] / np.maximum(rest[1], 1), 1.0)
            for k, (counts, left, tokens, by) in enumerate(((target, mine[doc], rest[0], None), (all_, 1, rest[1], scale))):
                c2, c1, c0 = (counts[at] - x * left for at, x in zip((self.two[pair], self.one[word], self.one[before]), own))
                if by is not None:
                    c2, c1, c0, tokens = c2 * by[doc], c1 * by[doc], c0 * by[doc], tokens * by
                unigram = (c1 + 1) / (tokens[doc] + VOCABULARY)
                loss = -np.log((c2 + PRIOR * unigram) / (c0 + PRIOR))
                out[k, d:e] = np.bincount(doc, weights=loss, minlength=n.size) / np.maximum(n, 1)
        return out


def _stored_row(number: int, held: list) -> pa.RecordBatch:
    ids, lengths, target, hashes = (np.concatenate(v) if k else sum(v, []) for k, v in enumerate(zip(*held)))
    words, token, n = np.unique(hashes, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")  # frequent words have low numbers, which compress better
    place = np.empty(order.size, np.int32)
    place[order] = np.arange(order.size)
    cols = ([number], [ids], [lengths], [target], [hashes.size], [int(lengths[target].sum())], [packed(words[order])], [packed(place[token])])
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds)], [f.split()[0] for f in BLOCKS.split(", ")])


def blocks(docs: DataFrame, labels: DataFrame, size: int = BLOCK) -> DataFrame:
    """The documents in stored blocks."""
    prepare(docs.sparkSession)
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1").select("doc_id", F.lit(True).alias("target"))
    good = stored(good, "targets")
    side = F.broadcast(good) if good.count() <= BROADCAST_ROWS else good
    marked = docs.select("doc_id", "text").join(side, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))

    def run(batches):
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for c in text_chunks(batches):
            w = Words(c.column("text"))
            held.append((c.column("doc_id").cast(pa.int64()).to_pylist(), w.n.astype(np.int32), c.column("target").to_numpy(zero_copy_only=False).astype(bool), w.hash))
            n += w.hash.size + c.num_rows
            if n >= size:
                yield _stored_row(number, held)
                number, held, n = number + 1, [], 0
        if held:
            yield _stored_row(number, held)

    return stored(marked.mapInArrow(run, BLOCKS), "blocks")


def answers(coded: DataFrame, parts: int) -> DataFrame:
    """(block, part, b, t): the whole corpus' counts of each block's keys, those of a part in one row."""

    def ask(batches):
        cuts = -(np.arange(1, parts, dtype=object) * -(1 << 64) // parts)  # part k has the keys from cut k on
        cuts = np.array([int(x) for x in cuts], np.uint64)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if not row["n"]:
                    continue
                x = Block.of(row)
                edge = [0, *np.searchsorted(x.keys, cuts).tolist(), x.keys.size]
                rows = [
                    (p, row["block"], packed(np.diff(x.keys[i:j], prepend=np.uint64(0))), packed(x.b[i:j]), packed(x.t[i:j]))
                    for p, (i, j) in enumerate(zip(edge, edge[1:])) if i < j
                ]
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], ["part", "block", "keys", "b", "t"])

    def add(rows: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpacked(x.as_py(), np.uint64), dtype=np.uint64) for x in rows.column("keys")]
        edge = np.cumsum([0, *map(len, keys)])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        out = []
        for name in ("b", "t"):
            n = np.concatenate([unpacked(x.as_py(), np.int64) for x in rows.column(name)])
            total = np.bincount(at, weights=n).astype(np.int64)  # exact below 2^53
            out.append(pa.array([packed(total[at[i:j]]) for i, j in zip(edge, edge[1:])], pa.binary()))
        return pa.table([rows.column("block"), rows.column("part"), *out], ["block", "part", "b", "t"])

    asked = coded.select("block", "lengths", "target", "n", "words", "tokens").mapInArrow(ask, "part int, block long, keys binary, b binary, t binary")
    return asked.groupBy("part").applyInArrow(add, "block long, part int, b binary, t binary")


@scoped
def cross_entropy_difference(docs: DataFrame, labels: DataFrame, block: int = BLOCK, part: int = PART) -> DataFrame:
    coded = blocks(docs, labels, block)
    all_tokens, target_tokens = (int(v or 0) for v in coded.agg(F.sum("n"), F.sum("n_target")).first())

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        n = np.array(row["lengths"], np.int64)
        t = b = np.zeros(n.size)
        if row["n"]:
            right = right.sort_by("part")
            counts = (np.concatenate([unpacked(v.as_py(), np.int64) for v in right.column(name)]) for name in ("t", "b"))
            t, b = Block.of(row).losses(*counts, target_tokens, all_tokens)
        cols = [pa.array(np.round(v, 9), mask=n == 0) for v in (t, b, b - t)]
        return pa.table([pa.array(row["ids"], pa.int64()), pa.array(n), *cols], [f.split()[0] for f in SCORES.split(", ")])

    asked = answers(coded, max(1, -(-all_tokens // part)))
    return coded.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(score, SCORES)
