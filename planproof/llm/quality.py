"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled texts. A text is cut into
blocks of fixed size; each block is compressed with either dictionary. What is known of a text is the difference of its
blocks' two compressed sizes and nothing else: the sum of it, normalised by the bytes, and its sign, as the share of the
bytes in blocks that the bad dictionary serves at least as well (both with PRIOR bytes more, as a few bytes say
little). A logistic curve turns them into a probability; it is fitted on labelled texts that no dictionary has seen.
Scoring is one map over the whole texts; the features of a fit are made on the executors too.

Bounds of a fit, all parameters: max_rows labelled rows (half of each kind), of which every second one of a kind
gives `pieces` blocks to its dictionary, spread from its start to its end. So at most max_rows / 2 * pieces * BLOCK
bytes come to the driver, however long the texts are. More pieces cost driver memory and change little.

Defined cases: null and empty texts score as a text whose difference is 0; very long texts are read whole, block by
block; rows repeat as they are; an empty table gives an empty result; without labels of both kinds every score is
the rate of good labels (0.5 if there are none); a null doc_id is scored and not held out. Extra columns of the input are
left out of the result, and kept by `keep_good`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planproof.llm.common import blocks_of, labelled_sample, nullable, prepare, scoped, stored, text_chunks, to_fold

#: Bound of the labelled rows a fit reads, by default; half build dictionaries, half calibrate.
MAX_FIT_ROWS = 6000
DICT_BYTES = 112 << 10
BLOCK = 1024
PRIOR = 256
#: Blocks of a labelled text that its dictionary sees, by default.
PIECES = 4
LEVEL = 3
SCHEMA = "doc_id long, score double, predicted int"


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def features(self, texts: list[bytes]) -> np.ndarray:
        """(difference a byte, share of bytes in blocks whose difference is not positive)."""
        kw = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        sides = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            sides.append(zstandard.ZstdCompressor(dict_data=d, **kw).compress)
        g, b = sides
        out = np.zeros((len(texts), 2))
        for i, x in enumerate(texts):
            gain = poor = 0
            for a in range(0, len(x), BLOCK):
                part = x[a : a + BLOCK]
                more = len(b(part)) - len(g(part))
                gain += more
                poor += len(part) * (more <= 0)
            out[i] = gain / (len(x) + PRIOR), poor / (len(x) + PRIOR)
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.good or not self.bad:
            return np.full(len(texts), self.weights[0])
        z = self.weights[0] + self.features(texts) @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method; the columns are scaled, so the ridge is the same for each."""
    scale = x.std(axis=0)
    scale[scale == 0] = 1
    z = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        s = np.maximum(p * (1 - p), 1e-9)
        g = z.T @ (p - y) / len(y) + ridge * w * (np.arange(len(w)) > 0)
        h = (z * s[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w / np.concatenate([[1.0], scale])


def _blocks(x: bytes, pieces: int = PIECES) -> list[bytes]:
    """Blocks spread over the whole length, so long texts do not rule a dictionary."""
    n = min(pieces, max(1, -(-len(x) // BLOCK)))
    starts = [k * (len(x) - BLOCK) // (n - 1) for k in range(n)] if n > 1 else [0]
    return [p for p in (x[i : i + BLOCK] for i in starts) if len(p) >= 8]


def _dictionary(parts: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their bytes are the dictionary
        return b"".join(parts)[-DICT_BYTES:]


@scoped
def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS, seed: int = 17, pieces: int = PIECES) -> Model:
    """From at most max_rows labelled rows of the fitting folds; kinds are sampled apart, so a rare one counts."""
    prepare(docs.sparkSession)
    rows = stored(labelled_sample(docs, labels, "quality", max_rows // 2, seed), "sample")
    many = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(many) < 2:
        return Model(b"", b"", (float(next(iter(many), 0.5)),))

    def cut(batches):
        for c in text_chunks(batches):
            held = [_blocks(t.encode(), pieces) for t in c.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([c.column("doc_id"), c.column("y"), pa.array(held, pa.list_(pa.binary()))], ["doc_id", "y", "blocks"])

    id_kind = rows.schema["doc_id"].dataType.simpleString()
    seen = blocks_of(rows.where("turn = 1").select("doc_id", "y", "text").mapInArrow(cut, f"doc_id {id_kind}, y int, blocks array<binary>")).sort_by("doc_id")
    kinds = [[b for y, held in zip(seen["y"].to_pylist(), seen["blocks"].to_pylist()) if y == k for b in held] for k in (1, 0)]
    model = Model(*(_dictionary(k) for k in kinds), ())

    def measure(batches):
        for c in text_chunks(batches):
            f = model.features([t.encode() for t in c.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([c.column("doc_id"), c.column("y"), pa.array(np.ascontiguousarray(f[:, 0])), pa.array(np.ascontiguousarray(f[:, 1]))], ["doc_id", "y", "gain", "poor"])

    # With one row of a kind, the dictionaries' own texts calibrate.
    turn = "turn = 0" if min(many.values()) > 1 else "true"
    got = blocks_of(rows.where(turn).select("doc_id", "y", "text").mapInArrow(measure, f"doc_id {id_kind}, y int, gain double, poor double")).sort_by("doc_id")
    w = _logistic(np.column_stack([got["gain"].to_numpy(), got["poor"].to_numpy()]), got["y"].to_numpy())
    model.weights = tuple(float(v) for v in w)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row of docs."""
    prepare(docs.sparkSession)

    def run(batches):
        for c in text_chunks(batches):
            texts = [(t or "").encode() for t in c.column("text").to_pylist()]
            s = model.score(texts)
            yield pa.RecordBatch.from_arrays([c.column("doc_id").cast(pa.int64()), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    out = score(docs, fit(docs, labels, max_rows))
    return out.select("doc_id", F.coalesce(to_fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """The rows of docs that the classifier does not reject, all columns as they are."""
    model = fit(docs, labels, max_rows)
    prepare(docs.sparkSession)

    def run(batches):
        for c in text_chunks(batches):
            s = model.score([(t or "").encode() for t in c.column("text").to_pylist()])
            yield c.filter(pa.array(s >= 0.5))

    return docs.mapInArrow(run, nullable(docs.schema))
