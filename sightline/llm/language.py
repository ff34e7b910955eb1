"""Language identification by Bayesian evidence fusion.

For each row three kinds of evidence are added up in log space: the text under byte-trigram models, the declared markup
language, and a prior of the host. Host priors come from grouped aggregation over all rows: the text evidence is summed
by host, a host's shares are smoothed towards those of its domain, the domain's towards those of its address suffix, and
the suffix's towards the whole corpus; this is where the suffix counts. P(declared | language) is counted over all rows
likewise. A row's own text is taken out of each of these sums before it is judged (leave one out), so that no evidence
counts twice.

The trigram models are fitted to at most `SAMPLE` labelled rows, shared out evenly over the languages (of each those
with the smallest hashed ids); fitting and scoring read whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.llm.common import cut, small_batches

SAMPLE = 2000
#: Trigrams share this many hashed cells.
CELLS = 1 << 16
#: Text evidence counts as at most so many independent trigrams, as neighbouring ones depend on each other.
WEIGHT = 40.0
#: Pseudo-counts by which a level of the hierarchy leans on the level above.
SMOOTHING = 8.0
#: Rows with a best language below this probability are not identified.
LEAST_PROBABILITY = 0.5

_NOT_WORD = re.compile(r"[\W\d_]+")
_TAGS = re.compile(r"<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", re.I | re.S)


def cells(text: str) -> np.ndarray:
    """The hashed cell of each byte trigram of the lower-cased words of a text, joined by single spaces."""
    words = _NOT_WORD.sub(" ", text).strip().lower()
    if not words:
        return np.zeros(0, np.uint32)
    b = np.frombuffer(f" {words} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    return ((b[:-2] * np.uint32(0x9E3B) + b[1:-1] * np.uint32(0x85EB) + b[2:] * np.uint32(0xC2B3)) * np.uint32(0x9E3779B1)) >> np.uint32(16)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: log P(cell | language), one row for each cell.
    scores: np.ndarray

    def evidence(self, text: str | None) -> list[float] | None:
        """The log likelihood of the text for each language, tempered to WEIGHT trigrams; None if it has no letters."""
        c = cells(text or "")
        if not len(c):
            return None
        total = np.zeros(len(self.languages))
        for i in range(0, len(c), 1 << 18):  # bounded memory for very long texts
            total += self.scores[c[i : i + (1 << 18)]].sum(0, dtype=np.float64)
        total *= min(1.0, WEIGHT / len(c))
        return [round(float(x), 9) for x in total - total.max()]


def visible(html: str | None) -> str:
    return _TAGS.sub(" ", html or "")


def fit(rows: list[tuple[str, str]]) -> Model:
    """rows: (language, text). Without rows the model has the one language 'und'."""
    counts: dict[str, np.ndarray] = {}
    for lang, text in rows:
        counts.setdefault(lang, np.zeros(CELLS, np.int64))
        counts[lang] += np.bincount(cells(text), minlength=CELLS)
    return _model(counts)


def _model(counts: dict[str, np.ndarray], alpha: float = 0.5) -> Model:
    names = tuple(sorted(counts)) or ("und",)
    table = np.stack([counts[x] for x in names], 1) + alpha if counts else np.full((CELLS, 1), alpha)
    return Model(names, np.log(table / table.sum(0)).astype(np.float32))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> Model:
    """The model of at most SAMPLE labelled rows, an equal share of each language and one row at least; repeated
    rows count once. Trigrams are counted where the texts are: the driver gets one number for each language and cell."""
    known = docs.filter(F.col(lang).isNotNull() & (F.trim(lang) != "") & F.col(text).isNotNull())
    # a share is below 1,001 rows, so Spark takes it in each task before it sends rows to the language's one
    share = max(1, SAMPLE // max(2, known.select(lang).distinct().count()))
    # ids first, so that no text is carried to the tasks that merge the lists of the others
    ids = known.select(F.col(id_col).alias("_id"), F.col(lang).alias("_lang"), F.xxhash64(id_col).alias("r"))
    ids = ids.withColumn("k", F.row_number().over(Window.partitionBy("_lang").orderBy("r", "_id"))).filter(F.col("k") <= share).select("_id", "_lang").distinct()
    got = known.join(F.broadcast(ids), F.col(id_col).eqNullSafe(F.col("_id")) & (F.col(lang) == F.col("_lang"))).groupBy("_id", "_lang").agg(F.min(text).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, t in zip(b.column("_lang").to_pylist(), b.column("_text").to_pylist()):
                at, n = np.unique(cells(t), return_counts=True)
                # a text without letters leaves a row of 0, so that its language is known
                at, n = (at, n) if len(at) else (np.zeros(1, np.int64), np.zeros(1, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "cell", "n"])

    counts: dict[str, np.ndarray] = {}
    sums = got.select("_lang", "_text").mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    for name, cell, n in zip(*(c.to_pylist() for c in sums.toArrow().columns)):
        counts.setdefault(name, np.zeros(CELLS, np.int64))[cell] += n
    return _model(counts)


def with_evidence(rows: DataFrame, model: Model, text: str, out: str = "ev", html: bool = False) -> DataFrame:
    """rows and out: the evidence of the whole text for each language, null if it has no letters. Only the texts go to
    Python, and only the evidence comes back."""
    small_batches(rows.sparkSession)

    @F.arrow_udf("array<double>")
    def evidence(texts: pa.Array) -> pa.Array:
        return pa.array([model.evidence(visible(t) if html else t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return rows.withColumn(out, evidence(F.col(text)))


def _normal(ev: Column) -> Column:
    """Log evidence to probabilities."""
    grown = F.transform(ev, lambda x: F.exp(x - F.array_max(ev)))
    return F.transform(grown, lambda x: x / F.aggregate(grown, F.lit(0.0), lambda a, b: a + b))


def fuse(rows: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """rows with keep's columns, ev, declared, host, domain and suffix (any of them null) to keep's columns, language,
    probability, text_language and accepted. rows must be cheap to read again, as cut() leaves them.

    language is the most probable one (ties: first in alphabetical order). A row without letters is decided by what is
    declared and by its host; one that has neither of them is 'und' with probability 0. accepted: the probability is
    LEAST_PROBABILITY at least. text_language is that of the text alone, 'und' without letters. Rows without a host
    get the corpus prior. All sums are combined before they are shuffled, and no group is gathered.
    """
    n = len(model.languages)
    known = list(model.languages)
    small_batches(rows.sparkSession)
    base = rows.withColumn("declared", F.lower(F.substring_index(F.trim("declared"), "-", 1)))
    p = base.filter("ev is not null").withColumn("p", _normal(F.col("ev")))
    micro = lambda i: F.round(F.get("p", F.lit(i)) * 1e6).cast("long")  # noqa: E731  whole numbers: any order gives the same sum
    sums = [F.sum(micro(i)).alias(f"s{i}") for i in range(n)]
    by_host = cut(p.groupBy("host", "domain", "suffix").agg(*sums))
    add = [F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]
    whole = by_host.agg(*add).first()  # n sums
    every = lambda out: F.array(*[F.col(f"s{i}") for i in range(n)]).alias(out)
    domains = by_host.groupBy("domain", "suffix").agg(*add).select(F.col("domain").alias("y_domain"), F.col("suffix").alias("y_suffix"), every("in_domain"))
    suffixes = by_host.groupBy("suffix").agg(*add).select(F.col("suffix").alias("x_suffix"), every("in_suffix"))
    levels = (
        by_host.select("host", "domain", "suffix", every("in_host")).join(domains, F.col("domain").eqNullSafe(F.col("y_domain")) & F.col("suffix").eqNullSafe(F.col("y_suffix")))
        .join(suffixes, F.col("suffix").eqNullSafe(F.col("x_suffix")))
        .select(F.col("host").alias("h_host"), F.col("domain").alias("h_domain"), F.col("suffix").alias("h_suffix"), "in_host", "in_domain", "in_suffix")
    )
    # kept for the languages of the model only, so the table has at most n rows
    tags = p.filter(F.col("declared").isin(known)).groupBy("declared").agg(*sums).select(F.col("declared").alias("d_tag"), every("in_tag"))
    joined = base.join(levels, F.col("host").eqNullSafe(F.col("h_host")) & F.col("domain").eqNullSafe(F.col("h_domain")) & F.col("suffix").eqNullSafe(F.col("h_suffix")), "left").join(F.broadcast(tags), F.col("declared") == F.col("d_tag"), "left")

    whole = np.array([whole[f"s{i}"] or 0 for i in range(n)], np.float64)

    @F.arrow_udf("language string, probability double, text_language string, accepted boolean")
    def decide(ev: pa.Array, host: pa.Array, in_host: pa.Array, in_domain: pa.Array, in_suffix: pa.Array, in_tag: pa.Array) -> pa.Array:
        cols = _decided(_matrix(ev, n), _filled(ev), _filled(host), [np.broadcast_to(whole, (len(ev), n)), *(_matrix(x, n) for x in (in_suffix, in_domain, in_host))], _matrix(in_tag, n), _filled(in_tag), known)
        return pa.StructArray.from_arrays(cols, ["language", "probability", "text_language", "accepted"])

    found = joined.withColumn("_d", decide("ev", "host", "in_host", "in_domain", "in_suffix", "in_tag"))
    return found.select(*keep, "_d.language", "_d.probability", "_d.text_language", "_d.accepted")


def _filled(col: pa.Array) -> np.ndarray:
    return col.is_valid().to_numpy(zero_copy_only=False)


def _matrix(col: pa.Array, n: int) -> np.ndarray:
    """Lists of n numbers as rows; a null list is a row of zeros."""
    out = np.zeros((len(col), n))
    out[_filled(col)] = col.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    return out


def _decided(ev: np.ndarray, lettered: np.ndarray, hosted: np.ndarray, levels: list[np.ndarray], tag: np.ndarray, tagged: np.ndarray, known: list[str]) -> list[pa.Array]:
    """language, probability, text_language and accepted of rows. levels: the sums, in millionths, of the whole corpus and of
    each row's suffix, domain and host; tag: those of what it declares."""
    e = np.exp(ev - ev.max(1, keepdims=True))
    own = np.where(lettered[:, None], np.floor(e / e.sum(1, keepdims=True) * 1e6 + 0.5), 0.0)
    rest = [np.maximum(0.0, x - own) / 1e6 for x in levels]  # what the others say, in rows
    above, priors = np.full_like(ev, 1.0 / len(known)), []
    for c in rest:
        above = (c + SMOOTHING * above) / (c.sum(1, keepdims=True) + SMOOTHING)
        priors.append(above)
    prior = np.where(hosted[:, None], priors[-1], priors[0])
    # log P(declared | language): the tag's sums over the language's total, with one added to each
    declared = np.log((np.maximum(0.0, tag - own) / 1e6 + 1.0) / (rest[0] + len(known) + 1.0))
    total = ev + np.log(prior) + np.where(tagged[:, None], declared, 0.0)
    best = np.exp(total - total.max(1, keepdims=True))
    blank = ~lettered & ~tagged & ~(hosted & (rest[-1].sum(1) > 0))
    probability = np.where(blank, 0.0, np.round(1.0 / best.sum(1), 6))
    names = np.array([*known, "und"], object)
    return [
        pa.array(names[np.where(blank, -1, total.argmax(1))], pa.string()), pa.array(probability), pa.array(names[np.where(lettered, ev.argmax(1), -1)], pa.string()),
        pa.array(~blank & (probability >= LEAST_PROBABILITY)),
    ]


def pages(rows: DataFrame, model: Model) -> DataFrame:
    """pages (page_id, url, html) to page_id, language, probability, text_language, accepted. The declared
    language is the lang attribute of the html element; host, domain (its last two labels) and suffix (the
    last one) come from the url. Null or malformed urls and html give null evidence, not an error."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#:]+)", 1))
    named = rows.withColumn("host", F.nullif(host, F.lit("")))
    labels = F.split("host", r"\.")
    named = named.select(
        "page_id", "html", "host", F.substring_index("host", ".", -2).alias("domain"),
        F.when(F.size(labels) > 1, F.element_at(labels, -1)).alias("suffix"),
        F.nullif(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1), F.lit("")).alias("declared"),
    )
    return fuse(cut(with_evidence(named, model, "html", html=True).drop("html")), model, ("page_id",))


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language is accepted, with the columns of docs. lang counts as declared, and source as the
    host; documents have no address, so they have no suffix. A text without letters (null and empty ones too) has no
    language and is rejected. Rows are judged one by one, so repeated rows and rows that share an id are too.

    Texts are read and written once, with their evidence; host sums come back by a join that need not move the texts.
    """
    row = docs.select(F.struct(*docs.columns).alias("_row"))
    named = with_evidence(row.withColumn("_text", F.col("_row.text")), model, "_text").drop("_text")
    named = cut(named.select("_row", "ev", F.col("_row.lang").alias("declared"), F.col("_row.source").alias("host"), F.col("_row.source").alias("domain"), F.lit(None).cast("string").alias("suffix")), "zstd")
    return fuse(named, model, ("_row", "ev")).filter("accepted and ev is not null").select("_row.*")
