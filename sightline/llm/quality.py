"""Quality rules: base counts of a text, and a linear-chain conditional random field over its lines.

The field labels each line as content or boilerplate; Viterbi decoding gives the best labelling and the
share of words in content lines decides whether a text stays. It is trained here, on a bounded sample of
labelled documents (at most `SAMPLE` of either label, with all their lines): all lines of
a document labelled good count as content, all lines of one labelled bad as boilerplate. Counts and
decoding cover every line of every text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import small_batches

#: Documents of each label that training may read.
SAMPLE = 600
#: Lines of a training sequence; longer texts are cut into several.
CHAIN = 20
#: A text stays if at least this share of its words is in content lines.
LEAST_SHARE = 0.5

SPACES = " \t\n\r\x0b\f"
SYMBOLS = "#*$%&|<>"
FEATURES = 12


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null counts as empty."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    repeat = 0
    if n > 2:
        windows = Counter(zip(words, words[1:], words[2:]))
        if len(windows) < n - 2:
            covered = bytearray(n)
            for i, w in enumerate(zip(words, words[1:], words[2:])):
                if windows[w] > 1:
                    covered[i : i + 3] = b"\x01\x01\x01"
            repeat = sum(covered)
    return n, word_chars, symbols, dup, repeat


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A row of features and the number of words for each line that has a word, in order."""
    rows, sizes, seen = [], [], set()
    for line in (text or "").split("\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        chars = sum(map(len, words))
        counts = Counter(words)
        symbols = sum(map(line.count, SYMBOLS))
        digits = sum(map(line.count, "0123456789"))
        stops = sum(map(line.count, ".!?"))
        rows.append((
            1.0,
            min(1.0, 8.0 * symbols / chars),
            min(1.0, 2.0 * line.count("|") / n),
            min(1.0, 4.0 * digits / chars),
            min(2.0, chars / n / 8.0),
            min(1.0, np.log1p(n) / 5.0),
            1.0 - len(counts) / n,
            max(counts.values()) / n if n > 4 else 0.0,
            float(line in seen),
            float(line.rstrip()[-1:] in (".", "!", "?")),
            min(1.0, 4.0 * stops / n),
            min(1.0, sum(w[:1].isupper() for w in words) / n),
        ))
        sizes.append(n)
        seen.add(line)
    return np.array(rows, np.float64).reshape(-1, FEATURES), np.array(sizes, np.int64)


@dataclass(frozen=True)
class Field:
    """emit: a score of each feature for (boilerplate, content); move: of each pair of neighbouring labels."""

    emit: np.ndarray
    move: np.ndarray

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The best labelling of the lines, 1 for content; the earlier label wins a tie as boilerplate."""
        scores = x @ self.emit
        n = len(scores)
        if not n:
            return np.zeros(0, np.int64)
        back = np.zeros((n, 2), np.int8)
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = scores[0].tolist()
        for t, (s0, s1) in enumerate(scores[1:].tolist(), 1):
            from0, from1 = b + m10 > a + m00, b + m11 > a + m01
            back[t] = from0, from1
            a, b = (b + m10 if from0 else a + m00) + s0, (b + m11 if from1 else a + m01) + s1
        out = np.zeros(n, np.int64)
        out[-1] = b > a
        for t in range(n - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out

    def content_share(self, text: str | None) -> float:
        x, sizes = line_features(text)
        return float((self.viterbi(x) * sizes).sum() / sizes.sum()) if len(sizes) else 0.0


def fit(samples: list[tuple[np.ndarray, int]], rounds: int = 150, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Maximum likelihood of the label sequences by full gradients: forward-backward over all chains at
    once, and Adam steps. samples: (features of the lines, label of all of them). No samples give a field
    that calls everything content."""
    emit, move = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    chains = [(x[i : i + CHAIN], y) for x, y in samples for i in range(0, len(x), CHAIN)]
    if len({y for _, y in chains}) < 2:
        emit[0, 1] = 1.0
        return Field(emit, move)
    n = len(chains)
    x, mask, y = np.zeros((n, CHAIN, FEATURES)), np.zeros((n, CHAIN), bool), np.array([c[1] for c in chains])
    for i, (rows, _) in enumerate(chains):
        x[i, : len(rows)], mask[i, : len(rows)] = rows, True
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    gold = np.eye(2)[y][:, None, :] * mask[..., None]
    pairs = mask[:, 1:]
    m, v = [np.zeros_like(emit), np.zeros_like(move)], [np.zeros_like(emit), np.zeros_like(move)]
    for step in range(1, rounds + 1):
        s = x @ emit
        alpha, beta = np.zeros((n, CHAIN, 2)), np.zeros((n, CHAIN, 2))
        alpha[:, 0] = s[:, 0]
        for t in range(1, CHAIN):
            nxt = np.logaddexp(alpha[:, t - 1, 0, None] + move[0], alpha[:, t - 1, 1, None] + move[1]) + s[:, t]
            alpha[:, t] = np.where(mask[:, t, None], nxt, alpha[:, t - 1])
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        for t in range(CHAIN - 2, -1, -1):
            onward = move[None] + (s[:, t + 1] + beta[:, t + 1])[:, None, :]
            beta[:, t] = np.where(mask[:, t + 1, None], np.logaddexp(onward[..., 0], onward[..., 1]), 0.0)
        p = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
        g_emit = np.einsum("n,ntf,ntk->fk", weight, x, gold - p)
        joint = np.exp(alpha[:, :-1, :, None] + move + (s[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]) * pairs[..., None, None]
        g_move = np.einsum("n,ntij->ij", weight, gold[:, :-1, :, None] * gold[:, 1:, None, :] - joint)
        for i, (w, g) in enumerate(((emit, g_emit - decay * emit), (move, g_move - decay * move))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            w += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Field(emit, move)


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """The field, fitted to the labelled documents of each label with the smallest hashed ids. A document that is labelled both
    good and bad counts as bad."""
    rank = F.xxhash64("doc_id")
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = [known.filter(F.col("quality") == q).orderBy(rank, "doc_id").limit(SAMPLE) for q in (0, 1)]
    picked = F.broadcast(some[0].union(some[1]))  # at most 2 * SAMPLE rows of 12 bytes

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [line_features(t)[0] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("quality"), pa.array([r.astype("<f4").tobytes() for r in rows], pa.binary())], names=["doc_id", "quality", "x"]
            )

    got = docs.select("doc_id", "text").join(picked, "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    # one row for each sampled id: a repeated id must not widen the sample
    found = got.mapInArrow(features, "doc_id long, quality int, x binary").groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("s")).collect()
    rows = sorted((r.doc_id, r.s.quality, bytes(r.s.x)) for r in found)
    return fit([(np.frombuffer(x, "<f4").reshape(-1, FEATURES).astype(float), q) for _, q, x in rows if x])


def judge(docs: DataFrame, field: Field, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, the base counts, base_failed, content_share and kept for each whole text.

    A null text counts as empty: no words, base_failed, not kept. Rows are judged one by one, so repeated
    rows get repeated verdicts and an empty table gives an empty one."""
    small_batches(docs.sparkSession)
    slim = docs.select(*keep, F.col("text").alias("_text"))
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = slim.drop("_text").schema
    for c in longs:
        schema = schema.add(c, "long")
    schema = schema.add("base_failed", "boolean").add("content_share", "double").add("kept", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, failed, shares, kept = [], [], [], []
            for t in b.column("_text").to_pylist():
                c = base_counts(t)
                counts.append(c)
                failed.append(base_fails(c[0], c[4]))
                shares.append(round(field.content_share(t), 6))
                kept.append(not failed[-1] and shares[-1] >= LEAST_SHARE)
            cols = [b.column(c) for c in keep] + [pa.array([c[i] for c in counts], pa.int64()) for i in range(5)]
            cols += [pa.array(failed, pa.bool_()), pa.array(shares, pa.float64()), pa.array(kept, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return slim.mapInArrow(run, schema)


def keep_good(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs: one pass, no shuffle. Only the texts go to Python, and
    only verdicts come back. A null text counts as empty and goes."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        counts = ((t, base_counts(t)) for t in texts.to_pylist())
        return pa.array([not base_fails(c[0], c[4]) and round(field.content_share(t), 6) >= LEAST_SHARE for t, c in counts], pa.bool_())

    return docs.filter(good(F.col("text")))
