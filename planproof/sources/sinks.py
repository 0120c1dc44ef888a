"""Sinks: tables, schemas, summaries, timings."""

from __future__ import annotations

import json
import sys
import time
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def create_schema(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def replace_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").format("parquet")
    (w.partitionBy(*partition_by) if partition_by else w).saveAsTable(name)


def quoted(*parts: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts if p)


def write_json(data: dict, path: str) -> None:
    Path(path).write_text(json.dumps(data, indent=2, default=str) + "\n")


def write_text(text: str, path: str) -> None:
    Path(path).write_text(text)


@contextmanager
def timed(step: str, quiet: bool = False):
    began = time.perf_counter()
    try:
        yield
    finally:
        if not quiet:
            print(f"{step}: {time.perf_counter() - began:.1f} s", file=sys.stderr)


class Comments:
    """Where reports are posted: one comment, found by its marker and replaced. The transport is given (list, create,
    update), so any host can be used."""

    MARKER = "<!-- planproof-report -->"

    def __init__(self, listed, create, update):
        self.listed, self.create, self.update = listed, create, update

    def upsert(self, body: str) -> str:
        text = f"{self.MARKER}\n{body}"
        for c in self.listed():
            if self.MARKER in c["body"]:
                self.update(c["id"], text)
                return "updated"
        self.create(text)
        return "created"
