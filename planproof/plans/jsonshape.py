"""Shapes of JSON columns: path -> leaf type. `a.b[].c`; the whole value is the empty path."""

from __future__ import annotations

import re

# Fixed order: of two leaf types of one path the earlier one stays.
PRECEDENCE = ("integer", "number", "boolean", "timestamp", "date", "string")
Shape = dict[str, str | None]


def stronger(a: str | None, b: str | None) -> str | None:
    known = [x for x in (a, b) if x]
    return min(known, key=PRECEDENCE.index) if known else None


def merged(*shapes: Shape) -> Shape:
    out: Shape = {}
    for s in shapes:
        for path, leaf in s.items():
            out[path] = stronger(out.get(path), leaf)
    return dict(sorted(out.items()))


def of_reads(found: set[tuple[str, str | None]]) -> Shape:
    return merged(*({p: t} for p, t in found))


def leaves(shape: Shape) -> Shape:
    """Paths that no other path goes through."""
    inner = {p for p in shape for q in shape if q != p and (q.startswith(p + ".") or q.startswith(p + "["))}
    return {p: t for p, t in shape.items() if p and p not in inner}


def note(shape: Shape) -> str:
    """`JSON: a.b number, items[].sku string`."""
    return "JSON: " + ", ".join(f"{p or '$'}{f' {t}' if t else ''}" for p, t in sorted(shape.items()))


def parse_note(text: str) -> Shape | None:
    """The shape that a note holds; None for `not JSON`, {} for a note without one."""
    if re.search(r"\bnot JSON\b", text or "", re.I):
        return None
    m = re.search(r"\bJSON:\s*(.+)", text or "")
    out: Shape = {}
    for part in m[1].split(",") if m else []:
        path, _, leaf = part.strip().partition(" ")
        out["" if path == "$" else path] = leaf or None
    return out


def nested(shape: Shape) -> dict:
    """The shape as nested dicts; `[]` is a list's only key."""
    root: dict = {}
    for path, leaf in leaves(shape).items():
        at = root
        steps = [s for part in path.split(".") for s in re.findall(r"\[\]|[^\[\]]+", part)]
        for s in steps[:-1]:
            at = at.setdefault(s, {}) if isinstance(at.get(s, {}), dict) else {}
        at.setdefault(steps[-1], leaf or "string")
    return root
