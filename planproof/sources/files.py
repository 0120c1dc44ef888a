"""Driver-side sources: strict configuration, profiles, seeds, environment names, versions of a folder."""

from __future__ import annotations

import os
import re
import subprocess
import tempfile
from contextlib import contextmanager
from dataclasses import dataclass, field, fields
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from planproof.operators.conventions import Conventions, from_config


class ConfigError(ValueError):
    pass


@dataclass
class Config:
    project_dir: str = "."
    rows: int = 200
    rows_for: dict[str, int] = field(default_factory=dict)
    seed: int = 42
    vars: dict[str, object] = field(default_factory=dict)
    metrics: list[dict] = field(default_factory=list)
    schema_file: str | None = None
    dialect: str | None = None
    dialect_errors: bool = False
    fail_on_error: bool = True
    conventions: Conventions = field(default_factory=lambda: from_config(None))


def load_config(path: str | None) -> Config:
    """Unknown keys and wrong types are errors; a missing file is the defaults."""
    if not path or not os.path.exists(path):
        return Config()
    raw = yaml.safe_load(Path(path).read_text()) or {}
    if not isinstance(raw, dict):
        raise ConfigError("the configuration must be a mapping")
    known = {f.name: f for f in fields(Config)}
    if odd := sorted(set(raw) - set(known)):
        raise ConfigError(f"unknown keys: {', '.join(odd)}")
    kinds = {"rows": int, "seed": int, "rows_for": dict, "vars": dict, "metrics": list, "project_dir": str, "dialect_errors": bool, "fail_on_error": bool}
    for k, v in raw.items():
        if k in kinds and (not isinstance(v, kinds[k]) or (kinds[k] is int and isinstance(v, bool))):
            raise ConfigError(f"`{k}` must be of type {kinds[k].__name__}")
    for i, m in enumerate(raw.get("metrics", [])):
        if not isinstance(m, dict) or not {"name", "model", "sql"} <= set(m):
            raise ConfigError(f"metrics[{i}] needs name, model and sql")
    if any(not isinstance(v, int) or v < 0 for v in raw.get("rows_for", {}).values()):
        raise ConfigError("`rows_for` maps tables to numbers of rows")
    out = Config(**{k: v for k, v in raw.items() if k != "conventions"})
    out.conventions = from_config(raw.get("conventions"))
    return out


# Warehouse adapters and the SQL they speak.
ADAPTERS = {"bigquery": "bigquery", "snowflake": "snowflake", "redshift": "redshift", "postgres": "postgres", "duckdb": "duckdb", "databricks": "databricks", "spark": "spark", "athena": "trino", "trino": "trino", "fabric": "tsql", "sqlserver": "tsql", "clickhouse": "clickhouse"}


def profile_dialect(project_dir: str, profile: str) -> str | None:
    """From the nearest profiles file: beside the project, its parents, then the home folder."""
    here = Path(project_dir).resolve()
    for folder in (here, *here.parents, Path.home() / ".dbt"):
        p = folder / "profiles.yml"
        if p.exists():
            text = re.sub(r"\{\{.*?\}\}", "x", p.read_text())
            raw = (yaml.safe_load(text) or {}).get(profile)
            if isinstance(raw, dict):
                outputs = raw.get("outputs") or {}
                target = outputs.get(raw.get("target")) or next(iter(outputs.values()), {})
                return ADAPTERS.get(str(target.get("type")))
    return None


def env_names(project_dir: str) -> set[str]:
    """Environment variables that the project reads without a default."""
    out = set()
    for p in [*Path(project_dir).rglob("*.sql"), *Path(project_dir).rglob("*.yml")]:
        out |= set(re.findall(r"env_var\(\s*['\"](\w+)['\"]\s*\)", p.read_text(errors="replace")))
    return out


def seed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def git(repo: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True)
    if done.returncode:
        raise ConfigError(f"git {args[0]}: {done.stderr.strip()}")
    return done.stdout


@contextmanager
def worktree(repo: str, ref: str):
    """The repository as it was at ref, in a folder of its own that goes afterwards."""
    with tempfile.TemporaryDirectory(prefix="planproof-base-") as top:
        at = os.path.join(top, "tree")
        git(repo, "worktree", "add", "--detach", at, ref)
        try:
            yield at
        finally:
            git(repo, "worktree", "remove", "--force", at)


def changed_paths(repo: str, ref: str) -> list[str]:
    base = git(repo, "merge-base", ref, "HEAD").strip()
    return sorted({*git(repo, "diff", "--name-only", base).split("\n"), *git(repo, "ls-files", "--others", "--exclude-standard").split("\n")} - {""})


def at_ref(repo: str, ref: str, path: str) -> str | None:
    done = subprocess.run(["git", "-C", repo, "show", f"{ref}:{path}"], capture_output=True, text=True)
    return None if done.returncode else done.stdout
