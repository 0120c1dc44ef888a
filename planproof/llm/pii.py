"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust their score.

Base kinds are email, ip, card and phone. A base match that passes its validator stays whatever its score.
The method adds spans of further kinds: iban (mod-97), ssn (structure, and words nearby), secret (key-like
strings, with words nearby). Matches of a kind are leftmost and do not overlap; one that fails its validator is
dropped and its text is not searched again; an iban ends at its country's length. Offsets are code points, ends exclusive.

Defined cases: null and empty texts have no spans; very long texts are read whole, in time that grows with their length; null
ids are reported like others; repeated rows are reported alike; an empty table gives an empty result; extra columns are left out
of the report and kept by `mask`.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from planproof.llm.common import nullable, prepare, text_chunks

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "ssn", "secret")
KINDS = BASE + EXTRA
#: Least score of an added span.
LEAST = 0.5
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Runs of digits are taken whole and once (nothing shorter can match), so a long run costs its length.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|[0-9a-f]{32,64}|[A-Za-z0-9_]{2,6}[-_][A-Za-z0-9]{24,64})(?![A-Za-z0-9])")
_DIGITS = re.compile(r"[^0-9]+")
#: Characters of an IBAN by country, without spaces.
IBAN_SIZES = {
    c: n
    for n, names in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in names.split()
}
# Score without context, and words that raise or lower it within WINDOW characters.
START = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.95, "ssn": 0.5, "secret": 0.4}
RAISE = {
    "email": ("mail", "contact"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"), "ssn": ("ssn", "social", "security", "tax"), "secret": ("key", "token", "secret", "password", "akia"),
}
LOWER = {"ip": ("version", "section", "chapter"), "card": ("order", "invoice", "isbn"), "phone": ("version", "score"), "ssn": ("order", "part", "invoice"), "secret": ("sha", "md5", "commit", "checksum")}
WINDOW = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(text: str) -> bool:
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _iban(text: str):
    """Spans of valid matches. A match may hold the words after the number, so it is cut to its country's length if that
    is valid and ends where a group does; the search goes on from there. Else the whole match counts."""
    at = 0
    while m := _IBAN.search(text, at):
        a, at = m.span()
        places = [i for i, c in enumerate(m[0]) if c != " "]
        size = IBAN_SIZES.get(m[0][:2], len(places))
        end = a + places[size - 1] + 1 if size <= len(places) else at
        if (end == at or text[end] == " ") and mod97(text[a:end]):
            at = end
            yield a, end
        elif mod97(m[0]):
            yield a, at


def _emails(text: str):
    """Leftmost matches found from their `@`: the local part is the run before it, behind the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        low = at
        while m and low > last and text[low - 1] in _LOCAL_SET:
            low -= 1
        if m and low < at:
            yield low, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _base(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(d := p.lstrip("0") or "0") <= 3 and int(d) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _DIGITS.sub("", m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m[0])) <= 15]
    return out


def score(kind: str, text: str, start: int, end: int) -> float:
    near = text[max(0, start - WINDOW) : start].lower() + " " + text[end : end + WINDOW].lower()
    words = set(re.findall(r"[a-z0-9]+", near))
    s = START[kind] + 0.3 * any(w in words for w in RAISE.get(kind, ())) - 0.3 * any(w in words for w in LOWER.get(kind, ()))
    return round(min(1.0, max(0.0, s)), 3)


def _extra(text: str) -> list[tuple[str, int, int, float]]:
    out = []
    for a, b in _iban(text):
        if (s := score("iban", text, a, b)) >= LEAST:
            out.append(("iban", a, b, s))
    for kind, pattern in (("ssn", _SSN), ("secret", _SECRET)):
        for m in pattern.finditer(text):
            s = 0.9 if kind == "secret" and m[0].startswith("AKIA") else score(kind, text, *m.span())
            if s >= LEAST and (kind != "secret" or re.search(r"[0-9]", m[0]) or m[0].startswith("AKIA")):
                out.append((kind, *m.span(), s))
    return out


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score), by kind as listed, then start."""
    if not text:
        return []
    return [(k, a, b, score(k, text, a, b)) for k, a, b in _base(text)] + _extra(text)


def _joined(spans) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>"


def report(docs: DataFrame) -> DataFrame:
    """Counts and spans of each whole text, one map."""
    prepare(docs.sparkSession)

    def run(batches):
        kinds = (pa.int64(),) * 4 + (pa.string(), pa.string(), pa.list_(pa.float64()))
        for c in text_chunks(batches):
            rows = []
            for t in c.column("text").to_pylist():
                spans = find(t)
                base = [s for s in spans if s[0] in BASE]
                rows.append((*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), [s[3] for s in spans]))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([c.column("doc_id").cast(pa.int64()), *(pa.array(v, t) for v, t in zip(cols, kinds))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def masked(text: str | None) -> str | None:
    """The text with each span replaced by its kind; of spans that overlap, the first one names the place."""
    spans = sorted((a, b, k) for k, a, b, _ in find(text))
    if not spans:
        return text
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in `text` and `n_chars`, if there, counted again; other columns as they are."""
    prepare(docs.sparkSession)

    def run(batches):
        for c in text_chunks(batches):
            texts = [masked(t) for t in c.column("text").to_pylist()]
            arrays = []
            for f, a in zip(c.schema, c.columns):
                if f.name == "text":
                    a = pa.array(texts, f.type)
                elif f.name == "n_chars":
                    a = pa.array([None if t is None else len(t) for t in texts], f.type)
                arrays.append(a)
            yield pa.RecordBatch.from_arrays(arrays, names=c.schema.names)

    return docs.mapInArrow(run, nullable(docs.schema))
