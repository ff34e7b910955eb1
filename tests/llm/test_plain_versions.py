"""Fingerprints of op6 and base counts of op10 against second, plain implementations."""

import random
import re

import pytest
import xxhash

from sightline.llm import chat, quality, queries, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode("utf-8"), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines, repeated, covered = text.split("\n"), 0, set()
    for i, line in enumerate(lines):
        repeated += bool(WORD.search(line)) and line in lines[:i]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    places = {}
    for i, w in enumerate(windows):
        places.setdefault(w, []).append(i)
    for at in places.values():
        if len(at) > 1:
            covered.update(p + j for p in at for j in range(3))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def odd_texts():
    r = random.Random(13)
    texts = [None, "", " ", "\n\n", "one", "One TWO", "a b c", "a b c a b c", "É é ÀB x\x1cy\x85z", "x\x0by\x0cz\rq", "same line\nsame line\n \nsame line ", "<#> $% | & *\n", "İ K ſ"]
    return texts + ["".join(r.choice(["ab ", "AB ", "c\n", "é ", "<", "\t", "|x ", "word word "]) for _ in range(r.randrange(300))) for _ in range(150)]


def test_fingerprints(spark):
    texts = odd_texts()
    for k in (3, 5):
        assert [simhash.fingerprint(t, k) for t in texts] == [plain_fingerprint(t, k) for t in texts]
    src = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op6_simhash(spark, SF).collect()}
    fps = {i: plain_fingerprint(t, 3) for i, t in src.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    root = {i: i for i in src}
    for a in sorted(src):
        for b in sorted(src):
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3 and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    assert {i: r.component_id for i, r in got.items()} == root


def test_base_counts(spark):
    for t in odd_texts():
        assert quality.base_counts(t) == plain_counts(t), t
    src = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op10_quality(spark, SF).collect():
        n, chars, symbols, dup, repeat = plain_counts(src[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.base_failed and r.kept)


def test_conflicting_labels_do_not_depend_on_order(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 30, "x") for i in range(30)], "doc_id long, text string, source string")
    labels = [(i, i % 2) for i in range(30)] + [(i, 1 - i % 2) for i in range(10)]
    fields = [quality.train(docs, spark.createDataFrame(rows, "doc_id long, quality int").repartition(n)) for rows, n in ((labels, 1), (labels[::-1], 4))]
    assert (fields[0].emit == fields[1].emit).all() and (fields[0].move == fields[1].move).all()


def test_a_declared_look_back_is_held_against_whole_prefixes():
    """This template numbers its turns but says that a turn stands alone: the spans would not be its output."""

    class Numbered(chat.BracketTemplate):
        def render(self, turns):
            return "".join(f"{i} {self.turn(*t)}" for i, t in enumerate(turns))

    now = chat._Open(1, Numbered())
    with pytest.raises(ValueError, match="another one in conversation 1"):
        for i in range(3):
            now.add("user", f"text {i}")
        now.check()
    fine = chat._Open(2, chat.BracketTemplate())
    for i in range(9):
        fine.add("user" if i % 2 == 0 else "assistant", f"[INST] {i}")
    fine.check()
    assert fine.spans == [fine.template.render(fine.turns)]
