"""Texts that are split piece by piece have the words that the pattern finds in them whole."""

import hashlib
import random

import pyarrow as pa
import pytest

from sightline.llm import bpe, queries

PARTS = [" ", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", "　", "\xa0", "a", "b", "\xe9", "1", "٣", "'", "'s", ".", "!", "日", "\U0001f600", "́"]


def texts(n):
    r = random.Random(1)
    return ["", " ", " x", "x ", *["".join(r.choice(PARTS) for _ in range(r.randrange(14))) for _ in range(n)]]


def test_pieces_have_the_words_of_whole_texts():
    P, regex = pytest.importorskip("public_tokenizers"), pytest.importorskip("regex")
    some_odd = [t if i % 9 == 0 else regex.sub(r" +(?=\s|$)", "", t) for i, t in enumerate(texts(20_000))]
    for some in ([], [""], [" "], texts(20_000), some_odd):
        number, places, lo, hi, words = bpe._pieces(pa.array(some, pa.large_string()), P.PATTERN, True)
        names = list(number)
        got = [[names[w] for i in p.tolist() for w in words[lo[i] : hi[i]]] for p in places]
        assert got == [regex.findall(P.PATTERN, t) for t in some]


def test_a_piece_is_split_once():
    """500 texts of the same 40 words: the pattern is run over some hundreds of characters, not over all."""
    P = pytest.importorskip("public_tokenizers")
    r = random.Random(2)
    some = [" ".join(f"w{r.randrange(40)}" for _ in range(200)) for _ in range(500)]
    _, places, lo, _, words = bpe._pieces(pa.array(some, pa.large_string()), P.PATTERN, True)
    assert sum(map(len, places)) == 500 * 200 and len(lo) <= 80 and len(words) <= 160


def test_round_trip_by_pieces(spark):
    P, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    raw = open(P.path(queries.VOCABULARY), "rb").read()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(raw), special_tokens={})
    rows = [(i, t) for i, t in enumerate([None, *texts(300)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    trip = bpe.round_trip(docs, raw, P.PATTERN, block_chars=500, spaced=True)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {i: (len(ids := enc.encode_ordinary(t or "")), sha(",".join(map(str, ids))), sha(t or ""), 0) for i, t in rows}
    assert {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256, x.bypassed) for x in trip.collect()} == want
