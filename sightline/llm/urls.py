"""URL filtering by rules and by a weighted vocabulary.

An Aho-Corasick automaton finds all terms in one pass over an address. A term counts where no letter or
digit stands on either side. One strict term blocks the address, or at least `SOFT_HITS` distinct soft ones whose
weights sum to `SOFT_WEIGHT`. Rules (a host and a path prefix) come first: the longest that fits decides.
The vocabulary is a table of terms, each strict or soft and with a weight; a short one is given here.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

STRICT = ("casino", "escort", "gambling", "hentai", "malware", "nude", "phishing", "poker", "porn", "sex", "torrent", "viagra", "warez", "xxx")
#: Soft terms by weight.
SOFT = {
    1: ("ad", "ads", "banner", "buy", "cart", "cheap", "checkout", "click", "coupon", "deal", "download", "free", "hot", "login", "page", "popup", "promo", "redirect", "ref", "signup", "sponsor", "track", "utm", "win"),
    2: ("adult", "bet", "cam", "dating", "loan"),
}
#: (term, whether it is strict, weight)
TERMS = tuple((t, True, 0) for t in STRICT) + tuple((t, False, w) for w, terms in SOFT.items() for t in terms)
SOFT_HITS = 2
SOFT_WEIGHT = 3
#: Terms that a vocabulary may have: it goes to every worker.
MOST_TERMS = 200_000
#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vocabulary(rows: DataFrame) -> tuple[tuple[str, bool, int], ...]:
    """The terms of a table (term, strict, weight), with A-Z lower-cased. Null and empty terms are left out, a null weight is 1;
    of repeated terms the strict one, then the heaviest counts. A table of more than MOST_TERMS rows is refused."""
    found = rows.select("term", "strict", "weight").filter("term <> ''").limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"a vocabulary has {MOST_TERMS} terms at most")
    best: dict[str, tuple[bool, int]] = {}
    for r in found:
        term = r.term.translate(_LOWER)
        best[term] = max(best.get(term, (False, 0)), (bool(r.strict), 1 if r.weight is None else r.weight))
    return tuple((t, *best[t]) for t in sorted(best))


class Automaton:
    """Aho-Corasick over a set of terms."""

    def __init__(self, terms: tuple[str, ...]) -> None:
        self.goto: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, ...]] = [()]
        for term in terms:
            at = 0
            for ch in term:
                if ch not in self.goto[at]:
                    self.goto[at][ch] = len(self.goto)
                    self.goto.append({})
                    self.ends.append(())
                at = self.goto[at][ch]
            self.ends[at] += (term,)
        self.fail = [0] * len(self.goto)
        queue = deque(self.goto[0].values())
        while queue:
            at = queue.popleft()
            for ch, to in self.goto[at].items():
                back = self.fail[at]
                while back and ch not in self.goto[back]:
                    back = self.fail[back]
                self.fail[to] = self.goto[back].get(ch, 0)
                self.ends[to] += self.ends[self.fail[to]]
                queue.append(to)

    def find(self, text: str) -> set[str]:
        """The terms that stand in the text with no letter a-z or digit next to them."""
        inside = lambda i: 0 <= i < len(text) and (text[i].isascii() and text[i].isalnum())
        found, at = set(), 0
        for i, ch in enumerate(text):
            while at and ch not in self.goto[at]:
                at = self.fail[at]
            at = self.goto[at].get(ch, 0)
            for term in self.ends[at]:
                if not inside(i + 1) and not inside(i - len(term)):
                    found.add(term)
        return found


@functools.lru_cache(maxsize=4)
def automaton_of(terms: tuple[tuple[str, bool, int], ...]) -> Automaton:
    """Built once for each worker and vocabulary."""
    return Automaton(tuple(dict.fromkeys(t for t, _, _ in terms)))


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host is what stands between the first :// and the next /, ? or #, with A-Z
    lower-cased; the path goes on to ? or #. Both are empty for null and for text without ://."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def rule_for(host: str, path: str, by_host: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule whose host is the host or above it and whose path starts the path."""
    labels = host.split(".")
    above = [".".join(labels[i:]) for i in range(len(labels))]
    fit = [(h + p, verdict) for h in above for p, verdict in by_host.get(h, ()) if path.startswith(p)]
    return max(fit, key=lambda x: len(x[0]), default=None)


def judge(
    rows: DataFrame, terms: tuple[tuple[str, bool, int], ...] = TERMS, soft_hits: int = SOFT_HITS, soft_weight: int = SOFT_WEIGHT, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url: str = "url"
) -> DataFrame:
    """id_col, host, path, rule, verdict, strict_hits and soft_hits (distinct terms), and soft_weight (their sum) for each row.

    A null url has empty host and path, no terms, and is allowed. Rows are judged one by one: repeated rows
    get repeated verdicts, no rows give none."""
    slim = rows.select(id_col, url)
    schema = slim.select(id_col).schema.add("host", "string").add("path", "string").add("rule", "string").add("verdict", "string").add("strict_hits", "integer").add("soft_hits", "integer").add("soft_weight", "integer")
    by_host: dict[str, list[tuple[str, str]]] = {}
    for h, p, v in rules:
        by_host.setdefault(h, []).append((p, v))
    hard = frozenset(t for t, strict, _ in terms if strict)
    weights = {t: w for t, strict, w in terms if not strict}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(terms)
        for b in batches:
            out = []
            for u in b.column(1).to_pylist():
                host, path = split_url(u)
                hits = automaton.find((u or "").translate(_LOWER))
                n_hard = len(hits & hard)
                n_soft = len(hits) - n_hard
                weight = sum(weights[t] for t in hits - hard)
                rule = rule_for(host, path, by_host)
                method = "block" if n_hard or (n_soft >= soft_hits and weight >= soft_weight) else "allow"
                out.append((host, path, rule[0] if rule else None, rule[1] if rule else method, n_hard, n_soft, weight))
            cols = [pa.array([o[i] for o in out], pa.string()) for i in range(4)] + [pa.array([o[i] for o in out], pa.int32()) for i in (4, 5, 6)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=schema.names)

    return slim.mapInArrow(run, schema)


def oracle_sql(terms: tuple[tuple[str, bool, int], ...] = TERMS, soft_hits: int = SOFT_HITS, soft_weight: int = SOFT_WEIGHT, rules: tuple[tuple[str, str, str], ...] = RULES) -> str:
    """The same judgement of `pages` in DuckDB SQL."""
    hit = lambda t: f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INT)"
    strict, soft = [t for t, s, _ in terms if s], [(t, w) for t, s, w in terms if not s]
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in ordered)
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH a AS (
        SELECT page_id, translate(coalesce(url, ''), '{up}', '{low}') AS u,
               CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
        FROM pages),
    b AS (
        SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), '{up}', '{low}') AS host,
               regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path,
               CAST({" + ".join(map(hit, strict))} AS INT) AS strict_hits, CAST({" + ".join(hit(t) for t, _ in soft)} AS INT) AS soft_hits,
               CAST({" + ".join(f"{w} * {hit(t)}" for t, w in soft)} AS INT) AS soft_weight
        FROM a),
    c AS (SELECT page_id, host, coalesce(path, '') AS path, {rule} AS rule, strict_hits, soft_hits, soft_weight FROM b)
    SELECT page_id, host, path, rule,
           {verdict} WHEN strict_hits > 0 OR (soft_hits >= {soft_hits} AND soft_weight >= {soft_weight}) THEN 'block' ELSE 'allow' END AS verdict, strict_hits, soft_hits, soft_weight
    FROM c"""
