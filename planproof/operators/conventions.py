"""House rules for models: which rules hold how strictly, and the rules as queries over model metadata.

Settings come from a project's configuration. What they may hold is one table of fields, each with its check; a preset
is a block of the same fields, built in or defined by the project under `presets`, and a project's own fields go over it.
Each rule gives rule, severity, model and message.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR, WARN, OFF = "error", "warn", "off"
# The rules, how strict the house preset is about each, and its name patterns by layer with what they ask for.
HOUSE = {
    "rules": {"naming": ERROR, "layering": ERROR, "description": WARN, "primary_key": ERROR, "column_naming": WARN},
    "layers": {"staging": r"^stg_[a-z0-9]+__[a-z0-9_]+$", "intermediate": r"^int_[a-z0-9_]+__[a-z0-9_]+$", "marts": r"^(dim|fct)_[a-z0-9_]+$"},
    "hints": {"staging": "stg_<source>__<entity>", "intermediate": "int_<entity>__<verb>", "marts": "dim_<entity> or fct_<event>"},
    "source_layer": "staging",
}
RULES = tuple(HOUSE["rules"])
PRESETS: dict[str, dict] = {"house": HOUSE, "none": {**HOUSE, "rules": dict.fromkeys(RULES, OFF)}}


class ConventionError(ValueError):
    pass


@dataclass(frozen=True)
class Conventions:
    rules: Mapping[str, str] = field(default_factory=lambda: dict(HOUSE["rules"]))
    layers: Mapping[str, str] = field(default_factory=lambda: dict(HOUSE["layers"]))
    hints: Mapping[str, str] = field(default_factory=lambda: dict(HOUSE["hints"]))
    source_layer: str | None = HOUSE["source_layer"]

    def severity(self, rule: str) -> str:
        return self.rules.get(rule, OFF)

    def at_most(self, severity: str) -> Conventions:
        """No rule is stricter than this."""
        order = (OFF, WARN, ERROR)
        return replace(self, rules={r: min(s, severity, key=order.index) for r, s in self.rules.items()})


# ------------------------------------------------------------------ settings

Check = Callable[[str, object], object]


def _refuse(path: str, wanted: str, value: object) -> None:
    raise ConventionError(f"{path}: expected {wanted}, found {value!r}")


def _one_of(*allowed: str) -> Check:
    # YAML reads a bare on, off, yes or no as a boolean
    booleans = {True: ERROR, False: OFF}

    def check(path, value):
        v = booleans.get(value, value) if isinstance(value, bool) else value
        v = v.lower() if isinstance(v, str) else v
        if v not in allowed:
            _refuse(path, " or ".join(allowed), value)
        return v

    return check


def _mapping(each: Check, keys: tuple[str, ...] = ()) -> Check:
    def check(path, value):
        if not isinstance(value, dict):
            _refuse(path, "a mapping", value)
        for k in value:
            if keys and k not in keys:
                _refuse(path, f"only {', '.join(keys)}", k)
        return {str(k): each(f"{path}.{k}", v) for k, v in value.items()}

    return check


def _regex(path, value):
    try:
        re.compile(value)
    except (TypeError, re.error):
        _refuse(path, "a regular expression", value)
    return value


def _text(path, value):
    if not isinstance(value, str):
        _refuse(path, "a text", value)
    return value


def _text_or_null(path, value):
    return value if value is None else _text(path, value)


#: What a block of settings may hold. None stands for a field that is not given, but for source_layer.
FIELDS: dict[str, Check] = {
    "rules": _mapping(_one_of(OFF, WARN, ERROR), RULES),
    "layers": _mapping(_regex),
    "hints": _mapping(_text),
    "source_layer": _text_or_null,
}


def _block(path: str, raw: object, more: tuple[str, ...] = ()) -> dict:
    if not isinstance(raw, dict):
        _refuse(path, "a mapping", raw)
    if odd := [k for k in raw if k not in FIELDS and k not in more]:
        _refuse(path, f"only {', '.join([*FIELDS, *more])}", odd[0])
    return {k: check(f"{path}.{k}", raw[k]) for k, check in FIELDS.items() if k in raw and (raw[k] is not None or k == "source_layer")}


def _over(below: Conventions, block: dict) -> Conventions:
    out = replace(below, **{k: v for k, v in block.items() if k != "rules"}, rules={**below.rules, **block.get("rules", {})})
    if "layers" in block and "hints" not in block:  # a hint for another pattern would mislead
        out = replace(out, hints={k: h for k, h in below.hints.items() if block["layers"].get(k) == below.layers.get(k)})
    return out


def from_config(raw: object) -> Conventions:
    """Without a block the house rules advise and fail nothing. With one, its preset (house) holds, then its own fields."""
    if raw is None:
        return Conventions().at_most(WARN)
    own = _block("conventions", raw, ("preset", "presets"))
    presets = PRESETS | _mapping(_block)("conventions.presets", raw.get("presets") or {})
    name = _one_of(*presets)("conventions.preset", raw.get("preset", "house"))
    return _over(_over(Conventions(), presets[name]), own)


# ------------------------------------------------------------------ rules


def _violations(rows: DataFrame, rule: str, severity: str, message) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "model", message.alias("message"))


def _fits(pattern: str, c: Column) -> Column:
    """The pattern from the name's start on; where it ends is the pattern's to say."""
    return c.rlike(f"^(?:{pattern})")


def naming(nodes: DataFrame, layers: Mapping[str, str] | None = None, severity: str = ERROR, hints: Mapping[str, str] | None = None) -> DataFrame:
    """nodes: model, layer, .... A layer without a pattern is free."""
    if layers is None:
        layers, hints = HOUSE["layers"], HOUSE["hints"]
    message = F.lit(None).cast("string")
    for layer, pattern in layers.items():
        wanted = (hints or {}).get(layer) or f"to match {pattern}"
        message = F.when((F.col("layer") == layer) & ~_fits(pattern, F.col("model")), f"a model in `{layer}/` is named {wanted}").otherwise(message)
    rows = nodes.withColumn("m", message).where("m is not null")
    return _violations(rows, "naming", severity, F.col("m"))


def layering(nodes: DataFrame, source_layer: str | None = "staging", severity: str = ERROR) -> DataFrame:
    """The source layer reads exactly one source and no model; other named layers read no source. Models at the root
    are exempt."""
    in_layer = F.col("layer") == F.lit(source_layer)
    count = F.when(in_layer & (F.col("sources") != 1), F.concat(F.lit("reads exactly one source; this one reads "), F.col("sources").cast("string")))
    ref = F.when(in_layer & (F.col("refs") > 0), F.lit("does not read other models; joins belong downstream"))
    deep = F.when(~in_layer & (F.col("layer") != "") & (F.col("sources") > 0), F.concat(F.lit(f"only `{source_layer}/` reads sources")))
    if not source_layer:
        count = ref = deep = F.lit(None).cast("string")
    rows = nodes.withColumn("m", F.explode(F.array_compact(F.array(count, ref, deep))))
    return _violations(rows, "layering", severity, F.col("m"))


def description(nodes: DataFrame, severity: str = WARN) -> DataFrame:
    return _violations(nodes.where(~F.coalesce("described", F.lit(False))), "description", severity, F.lit("has no description"))


def primary_key(nodes: DataFrame, tests: DataFrame, severity: str = ERROR) -> DataFrame:
    """A model needs one column tested both unique and not_null. tests: model, column, test."""
    keyed = tests.groupBy("model", "column").agg(F.collect_set("test").alias("t")).where(F.array_contains("t", "unique") & F.array_contains("t", "not_null")).select("model").distinct()
    return _violations(nodes.join(keyed, "model", "left_anti"), "primary_key", severity, F.lit("no column is tested both unique and not_null"))


def column_naming(columns: DataFrame, severity: str = WARN, layers: Mapping[str, str] | None = None) -> DataFrame:
    """columns: model, column_name, type, and layer if layers are given. snake_case; timestamps end in _at, dates in _date,
    booleans begin with is_ or has_. Models outside the declared layers are free."""
    if layers:
        columns = columns.where(F.col("layer").isin(*layers))
    c, t = F.col("column_name"), F.upper("type")
    message = (
        F.when(~c.rlike("^[a-z][a-z0-9_]*$"), "is not snake_case")
        .when(t.startswith("TIMESTAMP") & ~c.endswith("_at"), "is a timestamp and does not end in _at")
        .when((t == "DATE") & ~c.endswith("_date"), "is a date and does not end in _date")
        .when((t == "BOOLEAN") & ~c.rlike("^(is|has)_"), "is a boolean and does not begin with is_ or has_")
    )
    rows = columns.withColumn("m", message).where("m is not null")
    return rows.select(F.lit("column_naming").alias("rule"), F.lit(severity).alias("severity"), "model", F.concat(F.lit("`"), "column_name", F.lit("` "), F.col("m")).alias("message"), "column_name")
