"""Table definitions as DBML text: a small reader and writer."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class ColumnDef:
    name: str
    type: str
    pk: bool = False
    unique: bool = False
    not_null: bool = False
    note: str = ""


@dataclass
class TableDef:
    name: str
    columns: list[ColumnDef] = field(default_factory=list)
    unique_together: list[tuple[str, ...]] = field(default_factory=list)
    note: str = ""


@dataclass
class Schema:
    tables: dict[str, TableDef] = field(default_factory=dict)
    refs: list[tuple[str, str, str, str]] = field(default_factory=list)  # child, column, parent, column
    enums: dict[str, list[str]] = field(default_factory=dict)


class DbmlError(ValueError):
    pass


def _bare(s: str) -> str:
    return s.strip().strip('"`')


def parse(text: str) -> Schema:
    text = re.sub(r"//[^\n]*|/\*.*?\*/", "", text, flags=re.S)
    out = Schema()
    at = 0
    while m := re.compile(r"\s*(?:(Table|Enum)\s+([\w.\"`]+)[^{\n]*\{|Ref[^:\n]*:\s*([^\n]+)|(\w+)[^{\n]*\{)").match(text, at):
        at = m.end()
        if m[3]:
            out.refs.append(_ref(m[3]))
            continue
        depth, end = 1, at
        while depth:
            if end >= len(text):
                raise DbmlError(f"`{m[2] or m[4]}` is not closed")
            depth += {"{": 1, "}": -1}.get(text[end], 0)
            end += 1
        body, at = text[at : end - 1], end
        if m[1] == "Enum":
            out.enums[_bare(m[2])] = [_bare(x.split("[")[0]) for x in body.split("\n") if x.strip()]
        elif m[1] == "Table":
            name = _bare(m[2].rpartition(".")[2])
            out.tables[name] = _table(name, body, out)
    if text[at:].strip():
        raise DbmlError(f"cannot read: {text[at:].strip().splitlines()[0]}")
    return out


def _ref(text: str) -> tuple[str, str, str, str]:
    m = re.match(r"\s*([\w\"`.]+)\.([\w\"`]+)\s*([<>-])\s*([\w\"`.]+)\.([\w\"`]+)", text)
    if not m:
        raise DbmlError(f"cannot read the reference {text.strip()}")
    a, b = (_bare(m[1]), _bare(m[2])), (_bare(m[4]), _bare(m[5]))
    return (*b, *a) if m[3] == "<" else (*a, *b)


def _table(name: str, body: str, schema: Schema) -> TableDef:
    t = TableDef(name)
    if m := re.search(r"\bindexes\s*\{(.*?)\}", body, re.S):
        for cols, settings in re.findall(r"\(([^)]*)\)\s*\[([^\]]*)\]", m[1]):
            if "unique" in settings or "pk" in settings:
                t.unique_together.append(tuple(_bare(c) for c in cols.split(",")))
        body = body.replace(m[0], "")
    for line in body.split("\n"):
        line = line.strip()
        if m := re.match(r"Note\s*:\s*['\"](.*)['\"]$", line):
            t.note = m[1]
        elif m := re.match(r"([\w]+|\"[^\"]+\")\s+([\w]+(?:\([^)]*\))?)\s*(?:\[(.*)\])?$", line):
            c = ColumnDef(_bare(m[1]), m[2])
            settings = m[3] or ""
            if n := re.search(r"note\s*:\s*(['\"])(.*?)\1", settings):
                c.note = n[2]
                settings = settings.replace(n[0], "")
            words = [w.strip().lower() for w in settings.split(",")]
            c.pk, c.unique, c.not_null = "pk" in words or "primary key" in words, "unique" in words, "not null" in words
            for w in settings.split(","):
                if w.strip().lower().startswith("ref:"):
                    m2 = re.match(r"\s*ref:\s*([<>-])\s*([\w.\"`]+)\.([\w\"`]+)", w, re.I)
                    if m2:
                        schema.refs.append((name, c.name, _bare(m2[2]), _bare(m2[3])))
            t.columns.append(c)
        elif line:
            raise DbmlError(f"cannot read in table {name}: {line}")
    return t


def write(s: Schema) -> str:
    """Enums, tables, references, in their order; notes keep where a column's type comes from."""
    out = []
    for name, values in s.enums.items():
        out += [f"Enum {name} {{", *(f'  "{v}"' for v in values), "}", ""]
    for t in s.tables.values():
        out.append(f"Table {t.name} {{")
        for c in t.columns:
            settings = [w for w, on in (("pk", c.pk), ("unique", c.unique), ("not null", c.not_null)) if on] + ([f"note: '{c.note}'"] if c.note else [])
            out.append(f"  {c.name} {c.type}" + (f" [{', '.join(settings)}]" if settings else ""))
        if t.unique_together:
            out += ["  indexes {", *(f"    ({', '.join(k)}) [unique]" for k in t.unique_together), "  }"]
        if t.note:
            out.append(f"  Note: '{t.note}'")
        out += ["}", ""]
    out += [f"Ref: {a}.{b} > {c}.{d}" for a, b, c, d in s.refs]
    return "\n".join(out).strip() + "\n"
