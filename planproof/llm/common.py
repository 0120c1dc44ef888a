"""Helpers shared by the training-data operators: shared storage, Arrow batches, labelled samples."""

from __future__ import annotations

import atexit
import functools
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

_SHIPPED: set[str] = set()
_OWN: dict[str, str] = {}
#: Folders of the innermost scope that is open in this thread.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)
#: Bytes of an Arrow batch, so a batch of long texts is no larger than one of short texts.
BATCH_BYTES = 2 << 20
#: Rows of a slice of a batch, however short its texts are.
SLICE_ROWS = 8192


def prepare(spark: SparkSession) -> SparkSession:
    """Ship this package to the executors once per application and bound the Arrow batches by bytes.

    The bound is read when a result runs, which is after an operator returns, so it stays set; a lower one is kept."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(str(spark.conf.get(name)).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        folder = tempfile.mkdtemp(prefix="planproof-")
        atexit.register(shutil.rmtree, folder, True)
        path = os.path.join(folder, f"planproof_{app}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for base, _, names in os.walk(os.path.join(root, "planproof")):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(base, n)
                        z.write(full, os.path.relpath(full, root))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all nodes share: spark.checkpoint.dir. Where that is unset, an own one if there is one node (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="planproof-shared-")
            atexit.register(shutil.rmtree, _OWN[app], True)
        root = "file://" + _OWN[app]
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/planproof/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: later work survives a lost executor.

    The table lasts as long as the scope it was made in."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    if (scope := _SCOPE.get()) is not None:
        scope.append(path.rpartition("/")[0])
    df.write.parquet(path)
    return spark.read.parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(conf).delete(path, True)


def scoped(f):
    """The operator's result is stored; the tables it stored on the way are removed. An operator within another one
    leaves its result to that one's scope; results of the outermost scope stay until the shared folder is cleared."""

    @functools.wraps(f)
    def run(*args, **kw):
        mine: list[str] = []
        token = _SCOPE.set(mine)
        inside = True
        try:
            out = f(*args, **kw)
            _SCOPE.reset(token)
            inside = False
            return stored(out, f.__name__) if isinstance(out, DataFrame) else out
        finally:
            if inside:
                _SCOPE.reset(token)
            spark = next(a.sparkSession if isinstance(a, DataFrame) else a for a in args if isinstance(a, (DataFrame, SparkSession)))
            for folder in mine:
                remove(spark, folder)

    return run


def nullable(schema: StructType) -> StructType:
    """The same columns, all of which may be null: what a Python step returns is not known to be without nulls."""
    return StructType([StructField(f.name, f.dataType, True, f.metadata) for f in schema.fields])


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI; Hadoop's name of S3 is the same store."""
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_chunks(batches: Iterable[pa.RecordBatch], *columns: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of the columns (text) each; a longer single row is one slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.full(batch.num_rows, limit // SLICE_ROWS, np.int64)
        for name in columns or ("text",):
            many = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0)
            size += many.to_numpy(zero_copy_only=False)
        at = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def to_fold(doc_id) -> F.Column:
    """crc32 of doc_id as text, modulo 3; remainder 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, max_rows: int, seed: int = 17) -> DataFrame:
    """At most max_rows labelled documents of each of the values 0 and 1 for fitting, (doc_id, text, y, turn): those with
    the lowest hash of their id among labelled rows of the fitting folds, dealt to the turns 0 and 1 by that order. An id
    labelled both ways counts as 1. Null ids, null labels and texts are left out; of an id's texts the greatest stays.

    The sampled ids are bounded by max_rows, so they are broadcast; the documents are scanned once.
    """
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & (to_fold(F.col("doc_id")) != 1))
    known = known.groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    order = [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")]
    picked = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(*order).limit(max_rows)
        some = some.withColumn("turn", F.row_number().over(Window.partitionBy("y").orderBy(*order)) % 2)
        picked = some if picked is None else picked.unionAll(some)
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id", "y", "turn").agg(F.max("text").alias("text"))


def blocks_of(rows: DataFrame) -> pa.Table:
    """A bounded result as one Arrow table on the driver."""
    return rows.toArrow()
