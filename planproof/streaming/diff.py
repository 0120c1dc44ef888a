"""Row differences of micro-batches: a stream of head rows compared with a base table as it arrives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from planproof.operators.diff import row_diff


def diff_batches(stream: DataFrame, base: Callable[[DataFrame, int], DataFrame], sink: str, checkpoint: str):
    """Each micro-batch against base(batch, number), appended to the parquet table `sink` as batch, only_head, only_base.
    A replayed batch replaces its own part, so results are exactly once."""

    def each(batch: DataFrame, number: int) -> None:
        row_diff(batch, base(batch, number)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
