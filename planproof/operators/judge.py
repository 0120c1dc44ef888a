"""Judging results against the base: what the change answers for."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAILING = ("fail", "error")
#: Parts of an error that differ between two runs of the same thing.
_NOISE = (
    (r"\b(base|head)(?=[._`\"])", "run"), (r"\b(base|head)_", "run_"), (r"`", ""), (r"\(line \d+, pos \d+\)", ""), (r"(?m)^\s*\^+\s*$", ""), (r"(?s)== SQL.*$", ""), (r"\d+(\.\d+)? ?(ms|s|seconds)\b", ""), (r"#\d+L?", ""), (r"(/[\w.-]+)+/", ""), (r"\s+", " "),
)


def normalised(message: str | None) -> str:
    """An error without schema names, carets, timings, expression ids and folders."""
    out = message or ""
    for pattern, to in _NOISE:
        out = re.sub(pattern, to, out)
    return out.strip()


def normalised_column(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for pattern, to in _NOISE:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def judged(head: DataFrame, base: DataFrame) -> DataFrame:
    """test, preexisting, counts. Both sides: test, status, failures, message. A failure is preexisting if the base had
    the same status with as many failing rows (or more), or the same error."""
    b = base.select("test", F.col("status").alias("bs"), F.col("failures").alias("bf"), F.col("message").alias("bm"))
    j = head.join(b, "test", "left")
    failing = F.col("status").isin(*FAILING)
    as_many = F.coalesce(F.col("failures") <= F.col("bf"), F.lit(True))
    same = F.when(F.col("status") == "fail", as_many).otherwise(normalised_column(F.col("message")) == normalised_column(F.col("bm")))
    pre = failing & F.coalesce((F.col("status") == F.col("bs")) & same, F.lit(False))
    return j.select("test", pre.alias("preexisting"), (failing & ~pre).alias("counts"))


@dataclass
class Result:
    """One node's result. condition: Spark's error class, which is steadier than a message."""

    name: str
    status: str
    failures: int | None = None
    message: str = ""
    condition: str | None = None
    parameters: dict = field(default_factory=dict)


def same_error(a: Result, b: Result) -> bool:
    if a.condition and b.condition and a.condition != b.condition:
        return False
    return normalised(a.message) == normalised(b.message)


def preexisting(head: Result, base: Result | None) -> bool:
    if base is None or head.status not in FAILING or head.status != base.status:
        return False
    if head.status == "error":
        return same_error(head, base)
    return None in (head.failures, base.failures) or head.failures <= base.failures


# Error classes and texts that the made-up data can cause by its shape alone.
DATA_CONDITIONS = ("CAST_INVALID_INPUT", "CANNOT_PARSE_TIMESTAMP", "INVALID_ARRAY_INDEX", "MALFORMED_RECORD_IN_PARSING", "CAST_OVERFLOW")
_DATA_TEXT = re.compile(r"malformed|invalid json|could not (parse|convert)|cannot parse|cannot be cast|conversion error", re.I)
MISSING_FUNCTION = "UNRESOLVED_ROUTINE"


def data_shaped(r: Result) -> bool:
    return r.status == "error" and (any((r.condition or "").startswith(c) for c in DATA_CONDITIONS) or bool(_DATA_TEXT.search(r.message)))


def not_verified(r: Result) -> bool:
    """The engine lacks a function that the model calls: nothing is said about the model."""
    return r.status == "error" and (r.condition or "").startswith(MISSING_FUNCTION)


def broken_on_base(head: Result, base: Result | None, untrusted: set[str]) -> bool:
    return head.status == "error" and head.name not in untrusted and base is not None and base.status == "error" and same_error(head, base)


def model_outcome(head: Result, base: Result | None, *, data: bool, reached: bool, modified: bool) -> tuple[str, bool]:
    """What a model that failed on head counts as, and whether it fails the run.

    data: its error is of the made-up data's making; reached: something it reads, or a test on it, changed; modified:
    it or its fixtures changed."""
    if base is None or base.status != "error" or not same_error(head, base):
        return "failed", True
    if data:
        return ("unverified_broken_on_base", True) if reached else ("fixture_limited", False)
    if not reached:
        return "broken_on_base", False
    return ("failed", True) if modified else ("unverified_broken_on_base", True)


def skipped_outcome(behind: set[str], reached: bool, base_skipped: bool) -> tuple[str, bool]:
    """What a skipped model counts as, from the outcomes of what it stands behind."""
    excusable = {"broken_on_base", "fixture_limited"}
    if behind and behind <= excusable and base_skipped:
        return ("skipped_unchecked", True) if reached else ("skipped_excused", False)
    if behind and behind <= excusable | {"unverified_broken_on_base"}:
        return "skipped_by_unverified", True
    return "skipped", True


def usable_base(base: dict[str, Result], edited: set[str], reshaped: set[str], guessed: set[str], reached: set[str]) -> dict[str, Result]:
    """Base results that say something about head: not of edited tests, of tests over reshaped fixtures, of errors over
    guessed columns, or of errors that the change has reached."""
    drop = lambda n, r: n in edited or n in reshaped or (r.status == "error" and (n in guessed or n in reached))
    return {n: r for n, r in base.items() if not drop(n, r)}


# ------------------------------------------------------------------ verdicts

RANK = ("nothing_changed", "passed", "passed_with_warnings", "failed", "could_not_run")


def verdict(fatal: bool, changed: int, failing: int, warnings: int) -> str:
    if fatal:
        return "could_not_run"
    if failing:
        return "failed"
    if not changed:
        return "nothing_changed"
    return "passed_with_warnings" if warnings else "passed"


def verdicts(runs: DataFrame) -> DataFrame:
    """run, verdict of rows run, fatal, changed, failing, warnings."""
    v = F.when(F.col("fatal"), RANK[4]).when(F.col("failing") > 0, RANK[3]).when(F.col("changed") == 0, RANK[0]).when(F.col("warnings") > 0, RANK[2]).otherwise(RANK[1])
    return runs.select("run", v.alias("verdict"))


def regressions(now: DataFrame, before: DataFrame) -> DataFrame:
    """run, regression: every way in which a run of the suite is worse than its record."""
    j = now.alias("n").join(before.alias("b"), "run")
    rank = F.create_map(*(x for i, r in enumerate(RANK) for x in (F.lit(r), F.lit(i))))
    n, b = lambda c: F.col(f"n.{c}"), lambda c: F.col(f"b.{c}")
    found = F.array_compact(F.array(
        F.when(n("built") < b("built"), "built fell"), F.when(n("failed") > b("failed"), "failed rose"), F.when(n("not_verified") > b("not_verified"), "not_verified rose"),
        F.when(n("no_result") > b("no_result"), "no_result rose"), F.when(b("rename_detected") & ~n("rename_detected"), "rename no longer detected"),
        F.when(rank[n("verdict")] > rank[b("verdict")], "verdict is worse"),
    ))
    return j.select("run", F.explode(found).alias("regression"))
