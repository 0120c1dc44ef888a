"""The part of the template language that SQL models use: calls, set, for, if, macros. Expressions are read with Python's
own parser and only names, constants, lists, calls, attributes of `loop`, comparisons and boolean operators are run."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

_PIECE = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)


class TemplateError(ValueError):
    pass


class _Loop:
    def __init__(self, i: int, n: int):
        self.index, self.index0, self.first, self.last, self.length = i + 1, i, i == 0, i == n - 1, n


_OPS = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.Gt: lambda a, b: a > b, ast.LtE: lambda a, b: a <= b, ast.GtE: lambda a, b: a >= b, ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b}


def evaluate(text: str, names: dict):
    """A `~` joins texts, a `| filter` calls a function of one argument."""
    text, *filters = [p.strip() for p in re.split(r"(?<!\|)\|(?!\|)", text)]

    def run(n):
        if isinstance(n, ast.Expression):
            return run(n.body)
        if isinstance(n, ast.Constant):
            return n.value
        if isinstance(n, (ast.List, ast.Tuple)):
            return [run(x) for x in n.elts]
        if isinstance(n, ast.Dict):
            return {run(k): run(v) for k, v in zip(n.keys, n.values)}
        if isinstance(n, ast.Name):
            if n.id in names:
                return names[n.id]
            if n.id in ("true", "false", "none"):
                return {"true": True, "false": False, "none": None}[n.id]
            raise TemplateError(f"`{n.id}` is not known")
        if isinstance(n, ast.Attribute):
            base = run(n.value)
            if isinstance(base, dict) and n.attr in base:
                return base[n.attr]
            if isinstance(base, _Loop) and hasattr(base, n.attr):
                return getattr(base, n.attr)
            raise TemplateError(f"`{n.attr}` is not evaluated")
        if isinstance(n, ast.Call):
            f = run(n.func)
            if not callable(f):
                raise TemplateError("only functions can be called")
            return f(*(run(a) for a in n.args), **{k.arg: run(k.value) for k in n.keywords})
        if isinstance(n, ast.Compare):
            left = run(n.left)
            for op, right in zip(n.ops, map(run, n.comparators)):
                if type(op) not in _OPS or not _OPS[type(op)](left, right):
                    return False
                left = right
            return True
        if isinstance(n, ast.BoolOp):
            values = (run(v) for v in n.values)
            return all(values) if isinstance(n.op, ast.And) else any(values)
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
            return not run(n.operand)
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return -run(n.operand)
        if isinstance(n, ast.BinOp) and isinstance(n.op, (ast.BitXor, ast.Add)):
            a, b = run(n.left), run(n.right)
            return f"{a}{b}" if isinstance(n.op, ast.BitXor) else a + b
        raise TemplateError(f"`{text}` is not evaluated")

    try:
        value = run(ast.parse(text.replace("~", "^"), mode="eval"))
    except SyntaxError:
        raise TemplateError(f"`{text}` is not evaluated") from None
    for f in filters:
        value = {"upper": lambda v: str(v).upper(), "lower": lambda v: str(v).lower(), "trim": lambda v: str(v).strip(), "int": int, "string": str, "length": len}.get(f, lambda v: v)(value)
    return value


def _parse(pieces: list[str], at: int, until: tuple[str, ...]) -> tuple[list, int]:
    out = []
    while at < len(pieces):
        p = pieces[at]
        if p.startswith("{%"):
            body = p[2:-2].strip("- \n\t")
            word = body.split(None, 1)[0] if body else ""
            if word in until:
                return out, at
            if word in ("if", "for", "macro"):
                parts, cond = [], body
                while True:
                    inner, at = _parse(pieces, at + 1, ("elif", "else", "endif") if word == "if" else (f"end{word}",))
                    parts.append((cond, inner))
                    if at >= len(pieces):
                        raise TemplateError(f"`{word}` is not closed")
                    cond = pieces[at][2:-2].strip("- \n\t")
                    if cond.startswith("end"):
                        break
                out.append((word, parts))
            elif word == "set":
                out.append(("set", body))
            elif word not in ("do", "endif", "endfor", "endmacro", "raw", "endraw", "docs", "enddocs"):
                raise TemplateError(f"`{word}` is not evaluated")
        elif p.startswith("{{"):
            out.append(("value", p[2:-2].strip("- \n\t")))
        elif not p.startswith("{#"):
            out.append(("text", p))
        at += 1
    return out, at


def _run(nodes: list, names: dict) -> str:
    out = []
    for kind, what in nodes:
        if kind == "text":
            out.append(what)
        elif kind == "value":
            v = evaluate(what, names)
            out.append("" if v is None else str(v))
        elif kind == "set":
            m = re.match(r"set\s+(\w+)\s*=\s*(.*)", what, re.S)
            if not m:
                raise TemplateError(f"`{what}` is not evaluated")
            names[m[1]] = evaluate(m[2], names)
        elif kind == "if":
            for cond, inner in what:
                word, _, rest = cond.partition(" ")
                if word == "else" or evaluate(rest, names):
                    out.append(_run(inner, names))
                    break
        elif kind == "for":
            cond, inner = what[0]
            m = re.match(r"for\s+(\w+)\s+in\s+(.*)", cond, re.S)
            if not m:
                raise TemplateError(f"`{cond}` is not evaluated")
            items = list(evaluate(m[2], names))
            for i, x in enumerate(items):
                out.append(_run(inner, {**names, m[1]: x, "loop": _Loop(i, len(items))}))
        elif kind == "macro":
            macro_into(names, what[0])
    return "".join(out)


def macro_into(names: dict, part) -> None:
    head, inner = part
    m = re.match(r"macro\s+(\w+)\s*\((.*)\)", head, re.S)
    if not m:
        raise TemplateError(f"`{head}` is not evaluated")
    args = ast.parse(f"def f({m[2]}): pass").body[0].args
    params = [a.arg for a in args.args]
    defaults = [ast.literal_eval(d) for d in args.defaults]

    def call(*a, **kw):
        values = dict(zip(params[len(params) - len(defaults) :], defaults)) | dict(zip(params, a)) | kw
        if lost := [p for p in params if p not in values]:
            raise TemplateError(f"macro `{m[1]}` lacks {', '.join(lost)}")
        return _run(inner, {**names, **values}).strip()

    names[m[1]] = call


def render(text: str, names: dict[str, object | Callable]) -> str:
    nodes, _ = _parse([p for p in _PIECE.split(text) if p], 0, ())
    return _run(nodes, names)
