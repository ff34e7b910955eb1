"""Each operator against a brute-force version, a round trip or held-out labels, with odd rows."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sightline.llm import bpe, chat, fingerprints, language, lines, packing, quality, queries, simhash, urls, warc
from sightline.llm.common import cut

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, rid int, ds string, _t string, host string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(n))


def odd_docs(spark, empty=False):
    """Nulls in any column, empty and long texts, repeated rows, equal ids, near copies, clashing names."""
    r = random.Random(1)
    base = [prose(r, 70) + "\n" + prose(r, 40) for _ in range(6)]
    texts = [None, "", " \n ", *base, base[0], base[0] + " x1", base[1].replace("alpha", "beta", 1), prose(r, 20_000), "<a> " * 60, "\n".join([base[2].split("\n")[0]] * 3)]
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, len(t) if t else None, i, "d", "t", None) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (3, "other text under a known id " + prose(r, 60), "en", "s", 9, 1, None, None, "h"), (None, prose(r, 55), None, None, None, None, None, None, None)]
    return spark.createDataFrame([] if empty else rows, DOC).repartition(3)


def groups_of(keys, linked):
    par = list(range(len(keys)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if linked(keys[i], keys[j]):
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(keys))]


def test_fingerprints(spark):
    docs = odd_docs(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    src = sorted(docs.select("doc_id", "text").collect(), reverse=True, key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs).collect()}
    sets = lambda t: {x for x in t.split("\n") if x.strip(" ")}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, r in enumerate(src):
        t, nxt = r.text or "", src[(i + 1) % len(src)].text or ""
        k = len(t) // 2
        edited = t[: len(t) - k] + nxt[:k]
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert g.near_edited == pytest.approx(like(sets(t), sets(edited))) and g.near_next == pytest.approx(like(sets(t), sets(nxt)))
    same = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint_edits(spark.createDataFrame([(1, 'a\nb'), (2, 'c'), (3, 'a\nb')], 'doc_id long, text string')).collect()}
    assert same[1] == same[3] != same[2]
    assert fingerprints.fingerprint_edits(odd_docs(spark, True)).count() == 0
    assert fingerprints.fingerprint_edits(odd_docs(spark)).count() == odd_docs(spark).count()


def test_sketches_peel(spark):
    r = random.Random(2)
    rows = []
    for n in (0, 1, 3, 6, 40, 300):
        a, b = {r.getrandbits(62) for _ in range(n)}, {r.getrandbits(62) for _ in range(n // 2)}
        both = [r.getrandbits(62) for _ in range(20)]
        rows.append((list(a) + both, list(b) + both))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>").withColumns({f"{c}_sketch": fingerprints.sketch(F.col(c)) for c in "ab"})
    df = df.withColumn("direct", fingerprints.peel(fingerprints.subtract(F.col("a_sketch"), F.col("b_sketch"))))
    got = fingerprints.compared(df, {"found": ("a", "b")}).collect()
    for x in got:
        assert {(f.k, f.c) for f in x.found} == {(k, 1) for k in set(x.a) - set(x.b)} | {(k, -1) for k in set(x.b) - set(x.a)}
    assert got[2].direct is not None and got[5].direct is None  # small differences peel at once, large ones need a retry
    assert got[2].found_tries == 1 and 2 <= got[5].found_tries < 8


def test_large_differences_peel(spark):
    r = random.Random(3)
    new = lambda n: [r.getrandbits(63) - 2**62 for _ in range(n)]
    both = new(500)
    rows = [(new(2000) + both, new(2000) + both), (new(3000), []), (both, both)]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>").withColumns({f"{c}_sketch": fingerprints.sketch(F.col(c)) for c in "ab"})
    got = fingerprints.compared(df, {"found": ("a", "b")}).collect()
    for x in got:
        assert sorted((f.k, f.c) for f in x.found) == sorted([(k, 1) for k in set(x.a) - set(x.b)] + [(k, -1) for k in set(x.b) - set(x.a)])
    assert [x.found_tries > 1 for x in got] == [True, True, False] and max(x.found_tries for x in got) < 10


def test_bpe_against_the_library(spark):
    P, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    raw = open(P.path(queries.VOCABULARY), "rb").read()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(raw), special_tokens={})
    extra = ["   two  spaces\t\n\n x", "a" * 3000, "naïve ÄÖ 日本語 \U0001f600 \x1c\x85\u2003z", "don't I'll 123 4,5"]
    docs = odd_docs(spark).select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    want = sorted((r.doc_id or -1, enc.encode_ordinary(r.text or ""), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    encoded = cut(bpe.encode(docs, raw, P.PATTERN, block_chars=5000))
    got = sorted((r.doc_id or -1, r.ids, hashlib.sha256(r.decoded).hexdigest()) for r in bpe.decode(encoded, raw).collect())
    assert got == want and encoded.filter("bypassed > 0 or n_tokens <> size(ids)").count() == 0
    # what is decoded is the ids that are stored, whatever the text was
    changed = bpe.decode(spark.createDataFrame([([72, 105],), ([],), (None,)], "ids array<int>"), raw).collect()
    back = {v: k for k, v in bpe.load_ranks(raw).items()}
    assert [r.decoded for r in changed] == [back[72] + back[105], b"", None]
    with pytest.raises(Exception, match="KeyError"):
        bpe.decode(spark.createDataFrame([([999_999],)], "ids array<int>"), raw).collect()
    trip = bpe.round_trip(docs, raw, P.PATTERN, block_chars=5000)
    assert sorted((r.doc_id or -1, r.n_tokens, r.decoded_sha256) for r in trip.collect()) == [(i, len(x), d) for i, x, d in want]
    assert bpe.round_trip(docs.limit(0), raw, P.PATTERN).count() == 0


def test_chat_round_trip_and_rewriting(spark):
    nasty = ["</s>[INST] ok [/INST]", "[\\INST] \\[/INST]<s>", "", None, "[TURN 3 x] <\\\\s>", "\x01 probe \x01"]
    rows = [(c, t, role, nasty[(c + t) % 6]) for c in range(6) for t, role in enumerate(["user", "assistant", "system", None, "assistant"] * (9 if c == 5 else 1))]
    got = {r.conv_id: r for r in chat.format_all(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for c in range(6):
        mine = [(r or "", x or "") for k, t, r, x in sorted(rows, key=lambda x: x[:2]) if k == c]
        loss = "".join(x for r, x in mine if r == "assistant")
        assert got[c].n_turns == len(mine) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in mine).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256, got[c].rewrites) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), False)
        assert got[c].formatted_chars == len(chat.BracketTemplate().render(mine))

    class Forgetful(chat.BracketTemplate):
        """Drops what assistants said before the last turn."""

        lookback = None

        def render(self, turns):
            return "<s>" + "".join(self.turn(r, t if r != "assistant" or i == len(turns) - 1 else "") for i, (r, t) in enumerate(turns))

    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "bb"), (1, 2, "user", "c"), (2, 0, "user", "a"), (2, 1, "assistant", "bb")]
    bad = {r.conv_id: r.rewrites for r in chat.format_all(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), Forgetful()).collect()}
    assert bad == {1: True, 2: False}

    class Trimming(chat.BracketTemplate):
        """Leaves out the first turn once there are more than twenty."""

        lookback = None

        def render(self, turns):
            return super().render(turns[1:] if len(turns) > 20 else turns)

    rows = [(c, t, "user", f"turn {t}") for c, n in ((1, 30), (2, 20)) for t in range(n)]
    trimmed = {r.conv_id: r for r in chat.format_all(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), Trimming()).collect()}
    assert {c: r.rewrites for c, r in trimmed.items()} == {1: True, 2: False} and trimmed[1].turns_sha256 is None
    assert trimmed[1].formatted_chars == len(Trimming().render([r[2:] for r in rows if r[0] == 1]))
    assert trimmed[2].turns_sha256 == chat.format_all(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).filter("conv_id = 2").first().turns_sha256
    # real outputs: the spans put together are the rendered conversation, and what the mask covers is the text
    out = chat.spans(spark.createDataFrame(rows[30:], "conv_id long, turn long, role string, text string")).orderBy("n").collect()
    assert "".join(r.span for r in out) == chat.BracketTemplate().render([r[2:] for r in rows if r[0] == 2])
    assert [r.span[r.text_start : r.text_end] for r in out] == [r[3] for r in rows[30:]]
    assert chat.format_all(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    with pytest.raises(Exception, match="look-back"):
        Trimming.lookback = 25
        chat.format_all(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), Trimming()).collect()


def test_packing_is_optimal_and_whole(spark):
    r = random.Random(4)
    tops = sorted(r.sample(range(1, 20_000), 9))
    counts = [r.randrange(1, 9) for _ in tops]
    cost = lambda bounds: sum(c * min(b for b in bounds if b >= t) for t, c in zip(tops, counts))
    from itertools import combinations

    for k in (1, 2, 3, 4):
        best = min(cost([*c, tops[-1]]) for n in range(k) for c in combinations(tops[:-1], n))
        assert cost(packing.boundaries(tops, counts, k)) == best
    for _ in range(40):  # long lengths with ties, against the plain recursion
        tops = sorted(r.sample(range(1, r.choice([30, 3000])), 25))
        counts = [r.choice([1, 1, 2, 500]) for _ in tops]
        c = np.concatenate([[0], np.cumsum(counts)])
        best = [t * m for t, m in zip(tops, c[1:])]
        for k in range(1, 8):
            assert cost(packing.boundaries(tops, counts, k)) == best[-1] and len(packing.boundaries(tops, counts, k)) <= k
            best = [min([best[j], *(best[i] + tops[j] * (c[j + 1] - c[i + 1]) for i in range(j))]) for j in range(len(tops))]
    got = packing.pack(odd_docs(spark), buckets=3, budget=400).collect()
    assert len(got) == odd_docs(spark).count() and packing.pack(odd_docs(spark, True)).count() == 0
    fill = {}
    for x in got:
        assert x.length <= x.bound and x.padding == x.bound - x.length
        fill.setdefault((x.bucket, x.batch), []).append(x.slot)
    for (b, _), slots in fill.items():
        bound = next(x.bound for x in got if x.bucket == b)
        assert sorted(slots) == list(range(len(slots))) and (len(slots) == 1 or len(slots) * bound <= 400)
    w = {r.doc_id: r.length for r in got if r.doc_id is not None and r.doc_id != 3}
    for r in odd_docs(spark).filter("doc_id <> 3").collect():
        assert w[r.doc_id] == len((r.text or "").encode().split()) + 1


def test_warc_round_trip(spark):
    html = [None, "", "x" * 500, "é" * 90_000, "x" * 500, "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n0\r\n\r\n", "é" * 90_000, None]
    rows = [(i, "http://a/" + str(i) + "\r\nX: y", h, "z") for i, h in enumerate(html)] + [(2, "u", "x" * 500, "z"), (None, None, "solo", None)]
    got = sorted(map(tuple, warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, sha string")).collect()), key=str)
    first = {}
    for i, _, h, _ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(h or "", i)
    want = []
    for i, _, h, _ in rows:
        b, f = (h or "").encode(), first[h or ""]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if f == i else "revisit", None if f == i else f))
    assert got == sorted(want, key=str)
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc")
    with pytest.raises(ValueError):
        list(warc.parse(warc.record({"WARC-Type": "response"}, b"abcdef")[:-6]))


def test_simhash_components(spark):
    docs = odd_docs(spark)
    src = docs.select("doc_id", "text").collect()
    fps = [simhash.fingerprint(r.text, 3) for r in src]
    roots = groups_of(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for r, root in zip(src, roots):
        least[root] = min((x for x in (least.get(root), r.doc_id) if x is not None), default=None)
    want = sorted(((r.doc_id, f"{f:016x}", least[root]) for r, f, root in zip(src, fps, roots)), key=str)
    got = simhash.near_groups(simhash.with_fingerprint(docs)).select("doc_id", simhash.hex16(), "component_id").collect()
    assert sorted(map(tuple, got), key=str) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and len({simhash.fingerprint(r.text, 5) for r in kept.collect()}) == kept.count()
    assert simhash.keep_one(odd_docs(spark, True)).count() == 0


def test_bit_sliced_kernel():
    rng = np.random.default_rng(1)
    f = np.unique(np.repeat(rng.integers(0, 2**63, 9, dtype=np.uint64), 30) ^ (np.uint64(1) << rng.integers(0, 64, 270).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 270).astype(np.uint64)))
    for radius in (0, 1, 3, 6):
        want = groups_of(f.tolist(), lambda a, b: (a ^ b).bit_count() <= radius)
        assert simhash.group_links(f, np.array([0]), np.array([len(f)]), radius).tolist() == want


def brute_lines(rows, known=()):
    """rows (doc_id, text) with distinct ids: the lines that stay, by the docstring's rules. The pairs in known are
    alike; they are too long to compare here."""
    norm = lambda x: re.sub(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ", x.lower()).strip(" ")
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        for k, x in enumerate((t or "").split("\n")):
            if norm(x):
                first.setdefault(norm(x), ((i is None, i), k))

    def lev(a, b):
        if frozenset((" ".join(a), " ".join(b))) in known:
            return 1
        if abs(len(a) - len(b)) > 9999:
            return abs(len(a) - len(b))
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1]

    ns = sorted(first, key=first.get)
    alike = lambda a, b: lev(a.split(" "), b.split(" ")) <= int(max(len(a.split(" ")), len(b.split(" "))) * 0.2 + 1e-9)
    roots = groups_of(ns, alike)
    kept = {first[n] for n, r, i in zip(ns, roots, range(len(ns))) if r == i}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not norm(x) or ((i is None, i), k) in kept) for i, t in rows}


def test_lines_against_brute_force(spark):
    r = random.Random(8)
    long = [prose(r, 40) for _ in range(4)]
    texts = ["\n".join([r.choice(long), prose(r, 5), "***", r.choice(long).replace("alpha", "Alpha,", 2), r.choice(long) + " and so on"]) for _ in range(9)] + [None, "", "---\n\n"]
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, kept string, n_lines int").repartition(3)
    got = lines.dedup(docs)
    assert {x.doc_id: x.text for x in got.collect()} == brute_lines(list(enumerate(texts)))
    # lines of one bag of words: links that don't go through the first line count too
    some = prose(r, 10).split(" ")
    shuffled = [" ".join(r.sample(some, 10)) for _ in range(4)]
    swapped = [" ".join([*x.split(" ")[1::-1], *x.split(" ")[2:]]) for x in shuffled]
    own = [x + y for x in (*shuffled, *swapped) for y in ("", " " + some[0])] + [" ".join(some * 1700), " ".join([*some * 1700, "end"])]
    r.shuffle(own)
    bags = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    assert {x.doc_id: x.text for x in lines.dedup(bags).collect()} == brute_lines(list(enumerate(own)), {frozenset(own[i] for i in range(len(own)) if len(own[i]) > 9999)})
    odd = lines.dedup(odd_docs(spark))
    assert odd.count() == odd_docs(spark).count() and set(odd_docs(spark).columns) < set(odd.columns)
    assert lines.dedup(odd_docs(spark, True)).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs.filter("doc_id % 2 = 0"))
    named = docs.filter("doc_id % 2 = 1").select("doc_id", "lang", "text", F.lit(None).cast("string").alias("declared"), *[F.lit(None).cast("string").alias(c) for c in ("host", "domain", "suffix")])
    out = language.fuse(cut(language.with_evidence(named, model, "text").drop("text")), model, ("doc_id",)).join(docs, "doc_id")
    assert out.filter("language = lang").count() >= 0.9 * out.count()
    kept = language.keep_identified(odd_docs(spark), model)
    assert kept.columns == odd_docs(spark).columns and kept.filter("text is null or trim(text) = ''").count() == 0
    pages = spark.createDataFrame([(1, None, None), (2, "nonsense", ""), (3, "http://h.de/x", "<html lang=de><p>und die der das ist nicht</p>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in language.pages(pages, model).collect()}
    assert (got[1].language, got[1].accepted, got[2].language) == ("und", False, "und") and got[3].language == "de"
    assert language.pages(pages.limit(0), model).count() == 0


def test_host_priors_decide_weak_texts(spark):
    model = language.fit([("de", "und der die das nicht " * 20), ("en", "and the of that with " * 20)])
    rows = [(i, "and the of that with the", None, "h", "d", "s") for i in range(40)] + [(99, "zzzz", None, "h", "d", "s")]
    got = language.fuse(cut(language.with_evidence(spark.createDataFrame(rows, "id long, text string, declared string, host string, domain string, suffix string"), model, "text")), model, ("id",))
    assert got.filter("id = 99").first().language == "en"


def test_language_against_plain_python(spark):
    """The fused probabilities, with each row's own text left out of its priors; rows without letters too."""
    import math

    model = language.fit([("de", "und der die das nicht " * 20), ("en", "and the of that with " * 20)])
    r = random.Random(3)
    hosts = [("a.x.de", "x.de", "de"), ("b.x.de", "x.de", "de"), ("c.y.uk", "y.uk", "uk"), (None, None, None)]
    texts = ["und der", "the of that", "12", "", None, "nicht das und die der", "zz"]
    rows = [(i, r.choice(texts), r.choice(["de", "EN-us", "fr", None]), *r.choice(hosts)) for i in range(60)] + [(60, None, None, None, None, None), (61, "12", "de", "solo.de", "solo.de", "de")]
    ev = {x[0]: model.evidence(x[1]) for x in rows}
    norm = lambda v: [math.exp(x - max(v)) / sum(math.exp(y - max(v)) for y in v) for x in v]
    own = {i: [round(x * 1e6) / 1e6 for x in norm(v)] if v else [0.0, 0.0] for i, v in ev.items()}
    tag = lambda x: (x[2] or "").lower().split("-")[0]
    want = {}
    for x in rows:
        rest = lambda match: [sum(own[y[0]][k] for y in rows if y[0] != x[0] and ev[y[0]] and match(y)) for k in (0, 1)]  # noqa: B023, E731
        share = lambda c, above: [(v + 8.0 * a) / (sum(c) + 8.0) for v, a in zip(c, above)]
        at = share(rest(lambda y: True), [0.5, 0.5])
        if x[3] is not None:
            for level in (5, 4, 3):
                at = share(rest(lambda y: y[level:] == x[level:]), at)  # noqa: B023
        total = [math.log(v) + e for v, e in zip(at, ev[x[0]] or [0.0, 0.0])]
        if tag(x) in ("de", "en") and any(tag(y) == tag(x) and ev[y[0]] for y in rows):
            t, w = rest(lambda y: tag(y) == tag(x)), rest(lambda y: True)  # noqa: B023
            total = [v + math.log((a + 1.0) / (b + 3.0)) for v, a, b in zip(total, t, w)]
        want[x[0]] = norm(total)
    got = {x.id: x for x in language.fuse(cut(language.with_evidence(spark.createDataFrame(rows, "id long, text string, declared string, host string, domain string, suffix string"), model, "text")), model, ("id",)).collect()}
    assert (got[60].language, got[60].probability, got[60].accepted) == ("und", 0.0, False)
    assert (got[61].language, got[61].accepted, got[61].text_language) == ("de", True, "und")  # declared decides without letters
    for i in range(60):
        if got[i].language != "und":
            assert got[i].probability == pytest.approx(max(want[i]), abs=2e-6) and got[i].language == ("de", "en")[want[i].index(max(want[i]))]


def test_urls(spark):
    odd = ["http://www.Example.com/en/a?b", "https://m.example.com/en/x", "http://a.com", "http://b.com/", "nohost", None, "http://x.org/porn", "http://x.org/pornography", "http://x.org/ads?ref=1&utm=2", "http://x.org/bads?ref=1&utm=2", "http://net/fr/#q", "http://é.org/sexé"]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(list(enumerate(odd)), "page_id long, url string")).collect()}
    assert [got[i].verdict for i in range(12)] == ["allow", "block", "allow", "allow", "allow", "allow", "block", "allow", "block", "allow", "block", "block"]
    assert [got[i].rule for i in (0, 1, 2, 3, 10)] == ["www.example.com/en/", "example.com/en/", None, "com/", "net/fr/"]
    assert (got[4].host, got[4].path, got[5].host) == ("", "", "") and (got[0].host, got[0].path) == ("www.example.com", "/en/a")
    terms = ("ab", "abc", "b", "bc-d")
    auto = urls.Automaton(terms)
    r = random.Random(6)
    for _ in range(300):
        t = "".join(r.choice("abcd-.") for _ in range(12))
        assert auto.find(t) == {x for x in terms if re.search(f"(?<![a-z0-9]){re.escape(x)}(?![a-z0-9])", t)}


def test_url_vocabulary(spark):
    rows = [("Foo", False, 1), ("foo", True, None), ("", True, 1), (None, False, 1), ("bar", False, 2), ("bar", False, 5), ("qux", False, None)]
    terms = urls.vocabulary(spark.createDataFrame(rows, "term string, strict boolean, weight int"))
    assert terms == (("bar", False, 5), ("foo", True, 1), ("qux", False, 1))
    odd = ["http://x.org/bar/bar", "http://x.org/bar/qux", "http://x.org/FOO", "http://x.org/food"]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(list(enumerate(odd)), "page_id long, url string"), terms).collect()}
    assert [(got[i].verdict, got[i].soft_hits, got[i].soft_weight) for i in range(4)] == [("allow", 1, 5), ("block", 2, 6), ("block", 0, 0), ("allow", 0, 0)]
    many = tuple((f"w{i}x{i * 7 % 1009}", False, 1) for i in range(100_000))  # a vocabulary of its real size
    one = urls.judge(spark.createDataFrame([(1, "http://x.org/w5x35-w6x42/w99999x" + str(99999 * 7 % 1009))], "page_id long, url string"), many).first()
    assert (one.verdict, one.soft_hits) == ("block", 3)


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    field = quality.train(docs.filter("doc_id % 2 = 0"), labels)
    held = quality.judge(docs.filter("doc_id % 2 = 1"), field).join(labels, "doc_id").filter("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in held) >= 0.9 * len(held)
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):  # Viterbi against all labellings
        x, f = rng.normal(size=(n, quality.FEATURES)), quality.Field(rng.normal(size=(quality.FEATURES, 2)), rng.normal(size=(2, 2)))
        s = x @ f.emit
        score = lambda y: sum(s[i, v] for i, v in enumerate(y)) + sum(f.move[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        every = [[k >> i & 1 for i in range(n)] for k in range(1 << n)]
        assert score(f.viterbi(x).tolist()) == pytest.approx(max(map(score, every)))
    assert quality.base_counts("a b c a b c\n\nx\nx\n# x") == (10, 10, 1, 1, 6)
    assert quality.base_counts(None) == (0, 0, 0, 0, 0)
    got = quality.judge(odd_docs(spark), field)
    assert got.count() == odd_docs(spark).count() and got.filter("n_words < 50 and not base_failed").count() == 0
    assert quality.keep_good(odd_docs(spark), field).columns == odd_docs(spark).columns
    assert quality.judge(odd_docs(spark, True), field).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = cut(stage(spark, docs, SF))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        before, n, docs = n, out.count(), out
        assert 0 < n <= before
    assert {"doc_id", "bucket", "batch"} <= set(docs.columns)


def test_op9_has_sql():
    assert set(queries.oracle_sql()) == {"op9_urls"} and len(queries.queries()) == 11
