"""Functions over JSON text. Malformed text gives NULL; `malformed` finds it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CASTS = {"integer": "bigint", "number": "double", "boolean": "boolean", "timestamp": "timestamp_ntz", "date": "date", "string": "string"}


def extract(c: Column, path: str) -> Column:
    """The value at a dotted path as text; `[]` is every element."""
    return F.get_json_object(c, "$" + "".join(f"[*]{p[2:]}" if p.startswith("[]") else f".{p}".replace("[]", "[*]") for p in path.split(".") if p))


def leaf(c: Column, path: str, kind: str) -> Column:
    """The value at a path as its leaf type; NULL if it is no such value."""
    return extract(c, path).try_cast(_CASTS[kind])


def array_length(c: Column, path: str = "") -> Column:
    return F.json_array_length(extract(c, path) if path else c)


def keys(c: Column) -> Column:
    return F.json_object_keys(c)


def malformed(c: Column) -> Column:
    return c.isNotNull() & F.try_parse_json(c).isNull()


def variant(c: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json(c), "$." + path, _CASTS[kind])


def valid(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def exists(c: Column, path: str) -> Column:
    """Whether the path leads to a value, a JSON null included; only a path through `[]` needs a value that is none."""
    found = extract(c, path).isNotNull()
    if "[]" in path or "'" in path:
        return found
    steps = "".join(f"['{p}']" for p in path.split(".") if p)
    return found | F.try_variant_get(F.try_parse_json(c), f"${steps}", "variant").isNotNull()


def type_of(c: Column) -> Column:
    """The type of the whole value, as Spark names variants (BIGINT, STRING, ARRAY<...>, OBJECT<...>)."""
    return F.schema_of_variant(F.try_parse_json(c))
