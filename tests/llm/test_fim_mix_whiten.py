"""Whitening, fill-in-middle and mixing against plain versions, with odd rows."""

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import fim, mixing, queries, whitening

SF = "/root/testdata/sf0.001"
VEC = "vec_id long, embedding array<float>, id string, x int"


def plain_whitening(vectors):
    """Exact sums and covariance in fractions, then eigh."""
    x = [[int(np.floor(1024.0 * c)) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    c = [[n * r[j] - s[j] for j in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in c), n**3)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    return n, [sum(v * v for v in r) for r in c], (np.array(c, dtype=float) / n) @ u / np.sqrt(e), e / np.trace(cov)


def test_whitening_matches_exact_covariance(spark):
    r = np.random.default_rng(1)
    good = (r.normal(size=(300, 6)) * [5, 3, 2, 1, 0.5, 0.2] + 7).astype(np.float32).tolist()
    good += [good[0], good[0]]
    bad = [None, [], [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1.0, 2.0]]
    rows = [(i if i % 50 else None, v, "clash", 1) for i, v in enumerate(good)] + [(1000 + i, v, None, None) for i, v in enumerate(bad)]
    got = whitening.whiten(spark.createDataFrame(rows, VEC).repartition(3)).collect()
    n, deviation, white, explained = plain_whitening(good)
    assert len(got) == n * 6 and {x.n for x in got} == {n} and {x.component for x in got} == set(range(1, 7))
    assert len({x.identity_error for x in got}) == 1 and got[0].identity_error < 1e-9
    signs = {}
    for x in got:
        assert x.vec_id is None or x.vec_id < 1000
        assert x.explained == pytest.approx(explained[x.component - 1], rel=1e-9)
        if x.vec_id is not None:
            assert x.deviation == deviation[x.vec_id]
            w = white[x.vec_id, x.component - 1]
            sign = signs.setdefault(x.component, 1 if abs(w - x.whitened) < 1e-6 else -1)
            assert x.whitened == pytest.approx(sign * w, abs=1e-8)


def test_whitening_of_few_and_equal_rows(spark):
    assert whitening.whiten(spark.createDataFrame([], VEC)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, None, None)], VEC)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], None, 1)] * 3, VEC)).collect()
    assert len(same) == 6 and all(x.whitened is None and x.explained is None and x.identity_error is None and x.deviation == 0 for x in same)
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i], None, 1) for i in range(5)], VEC)).collect()
    assert all((x.whitened is None) == (x.component == 2) for x in line) and line[0].identity_error < 1e-9


def test_whitening_query_is_whole(spark):
    got = queries.op11_whitening(spark, SF)
    src = [x.embedding for x in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    n, deviation, white, explained = plain_whitening(src)
    rows = got.orderBy("vec_id", "component").collect()
    assert len(rows) == 8 * n and [x.deviation for x in rows[::8]] == deviation
    mine = np.array([x.whitened for x in rows]).reshape(n, 8)
    assert np.abs(np.abs(mine) - np.abs(white[:, :8])).max() < 1e-6
    assert np.abs(np.cov(mine.T, bias=True) - np.eye(8)).max() < 1e-9 and rows[0].identity_error < 1e-9


def plain_fim(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h, n = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)], len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), out


def test_ropes_split_anywhere():
    r = random.Random(5)
    for text in ("", "a", "ab cd", "<", "é\n" * 700, "x" * 5000, "".join(r.choice(["ab", "Z", " ", "\n", "<S", "ß", "😀", "9"]) for _ in range(3000))):
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        whole = fim.rope(text)
        assert (whole.units, whole.chars, str(whole)) == (len(units), len(text), text)
        for at in {0, len(units), *(r.randrange(len(units) + 1) for _ in range(40))}:
            a, b = fim.split(whole, at)
            assert (str(a), str(b)) == ("".join(units[:at]), "".join(units[at:])) and (a.units, b.units) == (at, len(units) - at)
            assert fim.rank_at(whole, a.chars) == at


def test_fim_matches_plain_strings(spark):
    r = random.Random(6)
    texts = [None, "", " ", "one <S> two", "<P", "<" * 300, "end<S", "word " * 100_000, "é😀ab\r\n\x00c"] + ["".join(r.choice(["ab ", "c", "<", "M>", "S", "\n", "ß"]) for _ in range(r.randrange(900))) for _ in range(120)]
    rows = [(i, t, "clash", "psm") for i, t in enumerate(texts)] + [(None, "no id at all", None, None), (5, "again", None, None), (5, "again", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, form string").repartition(3)
    both = fim.restore(fim.transform(docs)).collect()
    want = sorted(((i, *plain_fim(i, t or ""), t or "") for i, t, _, _ in rows), key=str)
    assert sorted(((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output, x.restored) for x in both), key=str) == want
    assert {x.form for x in both} == {"plain", "psm", "spm"}
    assert fim.round_trip(docs.filter("false")).count() == 0


def test_fim_query_is_whole(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {x.doc_id: x for x in queries.op12_fim(spark, SF).collect()}
    src = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(src)
    for d in src:
        n, form, p, m, out = plain_fim(d.doc_id, d.text or "")
        x = got[d.doc_id]
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output_sha256, x.restored_sha256) == (n, form, p, m, sha(out), sha(d.text or ""))


def plain_targets(sizes):
    """Targets by resharing what is above the caps, round by round."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, out, todo = Fraction(sum(sizes.values())), {}, set(order)
    while todo:
        level = left / sum(weight[s] for s in todo)
        above = {s for s in todo if level * weight[s] > 3 * sizes[s]}
        for s in above or todo:
            out[s] = Fraction(3 * sizes[s]) if above else level * weight[s]
        if not above:
            break
        left -= sum(out[s] for s in above)
        todo -= above
    return out


def test_mixing_comes_near_its_targets(spark):
    r = random.Random(7)
    words = lambda n: " \n".join("w" for _ in range(n))
    rows = [(i, words(r.randrange(60)), "hot", 1) for i in range(900)] + [(2000 + i, words(r.randrange(300)), r.choice(["b", "é", "zz", None, "￿", "😀"]), 2) for i in range(300)]
    rows += [(3000, words(9000), "long", 1), (3001, words(3), "long", 1), (3002, words(40), "small", 1), (None, words(70), "b", None), (4007, "same row", "b", None), (4007, "same row", "b", None), (4008, None, "hot", 1), (4009, "", "empty", 1), (4010, " \t", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(5)
    got = mixing.taken(docs).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.size) for x in got) == sorted((i is None, i or 0, len((t or "").split())) for i, t, _, _ in rows)
    source, sizes = {i: s for i, _, s, _ in rows}, {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    aims, took = plain_targets(sizes), dict.fromkeys(sizes, 0)
    for x in got:
        s = source[x.doc_id]
        assert x.source_size == sizes[s] and x.target == pytest.approx(float(aims[s]), rel=1e-12) and 0 <= x.taken <= 3 * x.size
        took[s] += x.taken
    assert sum(took.values()) == sum(sizes.values())
    assert all(abs(took[s] - aims[s]) <= mixing.PACKET for s in sizes)
    again = mixing.taken(docs.repartition(3)).collect()
    key = lambda x: (x.doc_id is None, x.doc_id or 0, x.size, x.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_mix_is_in_order_of_finish(spark):
    docs = spark.createDataFrame([(i, "a b c " * (1 + i % 7), f"s{i % 4}") for i in range(200)], "doc_id long, text string, source string")
    rows = mixing.sized(docs)
    served = mixing.mix(rows, mixing.targets(rows)).orderBy("position").collect()
    assert [x.position for x in served] == [sum(y.words for y in served[:i]) for i in range(len(served))]
    assert [x.finish for x in served] == sorted(x.finish for x in served)
    empty = docs.filter("false")
    assert mixing.taken(empty).count() == 0 and mixing.taken(docs.withColumn("text", F.lit(None).cast("string"))).filter("taken = 0 and target = 0").count() == 200
