"""The pipeline as a whole against plain Python versions of its five stages, on a small corpus."""

import math
import random
import re
from itertools import product

import pytest

import corpus_pipeline
from sightline.llm import language, packing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LINE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SYLLABLES = {"en": "the ing and ation ough wh sh ly", "de": "ein sch ung der ich keit zw aus", "fr": "eau que les tion oi ais ph ou"}


def edits(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def roots(items, linked):
    """The least index of each item's group, by all pairs."""
    root = list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            if root[i] != root[j] and linked(items[i], items[j]):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return root


def corpus():
    """Rows of documents and labels: three languages, clean and boilerplate documents, copies, near copies, lines that
    many documents share (some of them with a word changed), texts without words, and a text of three languages."""
    r = random.Random(11)
    word = lambda lang: "".join(r.choice(SYLLABLES[lang].split()) for _ in range(r.randrange(2, 5)))
    sentence = lambda lang, n: " ".join([word(lang).capitalize(), *(word(lang) for _ in range(n - 1))]) + "."
    docs = []
    shared = {lang: sentence(lang, 20) for lang in SYLLABLES}
    for i in range(36):
        lang = list(SYLLABLES)[i % 3]
        if i % 4 == 3:
            lines = [f"| {word(lang)} {r.randrange(999)} | <{word(lang)}> # {r.randrange(999)} &" for _ in range(12)]
        else:
            lines = [sentence(lang, r.randrange(12, 24)) for _ in range(r.randrange(4, 6))]
            if i % 5 == 0:
                ws = shared[lang].split()
                ws[r.randrange(1, 19)] = word(lang)
                lines.insert(r.randrange(len(lines)), " ".join(ws))
        docs.append(("\n".join(lines), lang, f"site{i % 6}", int(i % 4 != 3)))
    clean = [d for d in docs if d[3]]
    for d in clean[:3]:
        docs.append(d)  # equal
        docs.append((d[0].replace("\n", "\n\n") + "\n?!", *d[1:]))  # equal lines
    for d in clean[3:6]:
        # alike as a whole, while most of its lines are apart: the words run on in lines of another length
        ws = d[0].split()
        docs.append(("\n".join(" ".join(ws[k : k + 7]) for k in range(0, len(ws), 7)), *d[1:]))
    mixed = "\n".join(sentence(lang, 9) for lang in SYLLABLES for _ in range(3))
    docs += [(mixed, None, None, 1), (None, "en", "site1", 1), ("", None, "site1", 0), ("12 34\n" * 40, "de", None, 0), (sentence("fr", 30), "fr", "site2", 1)]
    order = list(range(len(docs)))
    r.shuffle(order)
    rows = [(100 + 3 * i, *docs[k][:3], len(docs[k][0]) if docs[k][0] is not None else None) for i, k in enumerate(order)]
    return rows, [(row[0], docs[k][3], 0) for row, k in zip(rows, order)]


def identified(rows, model):
    """Rows whose best language has a probability of a half at least; all others tell of a row's source and declared language."""
    n = len(model.languages)
    ev = [model.evidence(x[1]) for x in rows]
    norm = lambda v: [math.exp(x - max(v)) / sum(math.exp(y - max(v)) for y in v) for x in v]
    own = [[round(x * 1e6) / 1e6 for x in norm(v)] if v else None for v in ev]
    out = []
    for i, x in enumerate(rows):
        if not ev[i]:
            continue
        rest = lambda match: [sum(own[j][k] for j, y in enumerate(rows) if j != i and own[j] and match(y)) for k in range(n)]  # noqa: B023, E731
        share = lambda c, above: [(v + 8.0 * a) / (sum(c) + 8.0) for v, a in zip(c, above)]
        whole, source = rest(lambda y: True), rest(lambda y: y[3] == x[3])  # noqa: B023
        at = share(whole, [1 / n] * n)
        if x[3] is not None:
            # no address: the suffix is that of all rows, domain and host are the source
            at = share(source, share(source, share(rest(lambda y: True), at)))
        total = [math.log(p) + e for p, e in zip(at, ev[i])]
        if x[2] in model.languages:
            tag = rest(lambda y: y[2] == x[2])  # noqa: B023
            total = [t + math.log((a + 1.0) / (b + n + 1.0)) for t, a, b in zip(total, tag, whole)]
        best = max(norm(total))
        assert abs(best - 0.5) > 1e-4  # no tie with the limit in this corpus
        if best >= 0.5:
            out.append(x)
    return out


def good(rows, field):
    """Rows that pass the base rules and have half of their words in content lines, by all labellings of the lines."""
    out = []
    for x in rows:
        ws = WORD.findall(x[1])
        seen, again = {}, set()
        for i in range(len(ws) - 2):
            first = seen.setdefault(tuple(ws[i : i + 3]), i)
            if first != i:
                again |= {first, first + 1, first + 2, i, i + 1, i + 2}
        if len(ws) < 50 or len(again) * 100 > 50 * len(ws):
            continue
        features, sizes = quality.line_features(x[1])
        scores = features @ field.emit
        value = lambda ys: sum(s[y] for s, y in zip(scores, ys)) + sum(field.move[a, b] for a, b in zip(ys, ys[1:]))  # noqa: B023, E731
        best = max(product((0, 1), repeat=len(sizes)), key=value)
        if sum(n for n, y in zip(sizes, best) if y) * 2 >= sum(sizes):
            out.append(x)
    return out


def fewer_lines(rows):
    """The first line of each group of similar lines stays, and every line without words."""
    lines = [(i, at, LINE_WORD.findall(line.lower())) for i, x in enumerate(rows) for at, line in enumerate(x[1].split("\n"))]
    worded = [x for x in lines if x[2]]
    root = roots([x[2] for x in worded], lambda a, b: abs(len(a) - len(b)) * 5 <= max(len(a), len(b)) and edits(a, b) * 5 <= max(len(a), len(b)))
    lost = {worded[k][:2] for k, top in enumerate(root) if k != top}
    return [(x[0], "\n".join(t for at, t in enumerate(x[1].split("\n")) if (i, at) not in lost), *x[2:]) for i, x in enumerate(rows)]


def one_of_each(rows):
    def shingles(text):
        ws = WORD.findall(text.lower())
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}

    root = roots([shingles(x[1]) for x in rows], lambda a, b: len(a & b) * 5 >= len(a | b) * 4)
    return [x for k, x in enumerate(rows) if root[k] == k]


def least_padding(lengths, buckets):
    """The least total padding of at most `buckets` buckets, by the plain recurrence."""
    tops = sorted(set(lengths))
    pad = lambda lo, hi: sum(hi - n for n in lengths if lo < n <= hi)
    best = [pad(0, t) for t in tops]
    for _ in range(min(buckets, len(tops)) - 1):
        best = [min([best[j], *(best[i] + pad(tops[i], tops[j]) for i in range(j))]) for j in range(len(tops))]
    return best[-1]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows, labels = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_run_against_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows, _ = corpus()
    left = [rows]
    left.append(identified(rows, language.train(docs)))
    left.append(good(left[-1], quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))))
    left.append(fewer_lines(left[-1]))
    left.append(one_of_each(left[-1]))
    # each stage has something to do
    assert [len(x) for x in left][0] > len(left[1]) > len(left[2]) > len(left[4]) > 0
    assert any(a[1] != b[1] for a, b in zip(left[2], left[3]))

    stages, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:4]:
        stages = stage(spark, stages, folder)
        stages.write.parquet(f"{folder}/after_{name}")
        stages = spark.read.parquet(f"{folder}/after_{name}")
        seen.append({x.doc_id: x.text for x in stages.collect()})
    for (name, _), got, want in zip(corpus_pipeline.STAGES, seen, left[1:]):
        assert got == {x[0]: x[1] for x in want}, name

    out = corpus_pipeline.run(spark, folder).collect()
    lengths = {x[0]: len(WORD.findall(x[1])) + 1 for x in left[-1]}
    assert {x.doc_id: x.length for x in out} == lengths and len(out) == len(lengths)
    assert sum(x.padding for x in out) == least_padding(list(lengths.values()), packing.BUCKETS)
    bounds = sorted({x.bound for x in out})
    assert len(bounds) <= packing.BUCKETS
    assert all(x.bound == min(b for b in bounds if b >= x.length) and x.padding == x.bound - x.length for x in out)
    assert len({(x.bucket, x.batch, x.slot) for x in out}) == len(out)
    assert all(x.bound * (x.slot + 1) <= max(packing.BUDGET, x.bound) for x in out)
