"""URL filter by a weighted vocabulary and a list of host rules.

An Aho-Corasick automaton finds all terms of the vocabulary in the lower-cased URL in one pass; a hit counts
if no ASCII letter or digit touches it. Each term has a weight, and a URL is rejected once its distinct terms weigh `limit`
together: a term of that weight is strict and rejects alone, of lighter, soft ones several are needed. A rule (host, path)
fits its host and all subdomains if the URL's path starts with the rule's; the longest fitting rule
decides before the vocabulary does.

The vocabulary is a mapping, or a table (term, weight) of at most MOST_TERMS rows, which every task holds; a larger one is
refused. Its terms are lower-cased as URLs are; null or empty terms and weights that are null or not positive are left
out; of a term's several weights the greatest stands. An empty vocabulary rejects nothing.

Defined cases: a null URL or one without `://` has an empty host and path, fits no rule, and is judged by the
vocabulary (null: allow); very long URLs are read whole; of rules of one length the first stands; repeated rows are judged
alike, and null ids are kept; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planproof.llm.common import prepare

# The default vocabulary.
STRICT = ("casino", "porn", "xxx", "viagra", "pills", "adult", "gambling", "escort", "warez", "spam")
SOFT = ("free", "win", "cheap", "bets", "ads", "track", "farm", "bonus", "deal", "click", "promo", "loan")
# Rules as dealt.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: The weight that rejects; strict terms have it, soft ones half of it.
LIMIT = 2.0
VOCABULARY = {**dict.fromkeys(STRICT, LIMIT), **dict.fromkeys(SOFT, LIMIT / 2)}
MOST_TERMS = 200_000
SCHEMA = "page_id long, host string, path string, rule string, verdict string, n_strict int, n_soft int, weight double"
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    m = _PARTS.search(url) if url else None
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


def vocabulary(terms: Mapping[str, float] | DataFrame) -> dict[str, float]:
    """Terms as they are looked up, with their weights."""
    if isinstance(terms, DataFrame):
        usable = terms.select("term", F.col("weight").cast("double").alias("weight")).where("term <> '' and weight > 0")
        rows = [tuple(r) for r in usable.groupBy("term").agg(F.max("weight")).limit(MOST_TERMS + 1).collect()]
    else:
        rows = [(t, float(w)) for t, w in terms.items() if t and w and w > 0]
    if len(rows) > MOST_TERMS:
        raise ValueError(f"the vocabulary has more than {MOST_TERMS:,} terms")
    out: dict[str, float] = {}
    for t, w in rows:
        t = t.translate(_UPPER)
        out[t] = max(w, out.get(t, 0.0))
    return out


class Judge:
    def __init__(self, terms: Mapping[str, float] = VOCABULARY, rules=RULES, limit: float = LIMIT):
        self.limit = limit
        self.machine = ahocorasick.Automaton()
        self.empty = not terms
        for t, w in terms.items():
            self.machine.add_word(t, (t, w))
        self.machine.make_automaton()
        cut = [(v, r, *r.partition("/")[::2]) for v, r in rules]
        self.rules = sorted(((v, r, host, "/" + path) for v, r, host, path in cut), key=lambda x: -len(x[1]))

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        for verdict, text, h, p in self.rules:
            if path.startswith(p) and (host == h or host.endswith("." + h)):
                return text, verdict
        return None, None

    def terms(self, url: str | None) -> tuple[int, int, float]:
        """Distinct strict and soft terms with free edges, and what they weigh together."""
        found = {}
        low = (url or "").translate(_UPPER)
        for end, (t, w) in () if self.empty else self.machine.iter(low):
            a = end - len(t)
            if (a < 0 or low[a] not in _WORD) and (end + 1 == len(low) or low[end + 1] not in _WORD):
                found[t] = w
        strict = sum(w >= self.limit for w in found.values())
        return strict, len(found) - strict, float(sum(sorted(found.values())))

    def __call__(self, url: str | None) -> tuple:
        host, path = split_url(url)
        rule, verdict = self.rule(host, path)
        strict, soft, weight = self.terms(url)
        if verdict is None:
            verdict = "block" if weight >= self.limit else "allow"
        return host, path, rule, verdict, strict, soft, weight


def judge(pages: DataFrame, terms: Mapping[str, float] | DataFrame = VOCABULARY, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft, weight for each row; only two columns are read."""
    prepare(pages.sparkSession)
    words = vocabulary(terms)

    def run(batches):
        call = Judge(words, rules, limit)
        for c in batches:
            rows = [call(u) for u in c.column("url").to_pylist()]
            cols = list(zip(*rows)) or [()] * 7
            kinds = (pa.string(),) * 4 + (pa.int32(),) * 2 + (pa.float64(),)
            yield pa.RecordBatch.from_arrays([c.column("page_id").cast(pa.int64()), *(pa.array(v, t) for v, t in zip(cols, kinds))], ["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "weight"])

    return pages.select("page_id", "url").mapInArrow(run, SCHEMA)


def oracle() -> str:
    """The same judgement in DuckDB's SQL."""
    hit = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::INT"
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
    return f"""
WITH rules(verdict, rule, h, p) AS (VALUES {rows}),
u AS (SELECT row_number() OVER () AS k, page_id, url, translate(coalesce(url, ''), '{up}', '{low}') AS low,
  translate(regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 1), '{up}', '{low}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
t AS (SELECT *, {" + ".join(map(hit, STRICT))} AS n_strict, {" + ".join(map(hit, SOFT))} AS n_soft FROM u),
r AS (SELECT t.k, max_by(rules.rule, length(rules.rule)) AS rule, max_by(rules.verdict, length(rules.rule)) AS verdict FROM t JOIN rules
  ON starts_with(path, p) AND (host = h OR ends_with(host, '.' || h)) GROUP BY t.k)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END) AS verdict,
  n_strict::INT AS n_strict, n_soft::INT AS n_soft, (2 * n_strict + n_soft)::DOUBLE AS weight FROM t LEFT JOIN r USING (k)"""
