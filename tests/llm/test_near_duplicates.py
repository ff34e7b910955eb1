"""Near-duplicate documents against true five-word Jaccard similarity."""

import random

from sightline.llm import simhash


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_every_pair_of_the_similarity_is_linked(spark):
    r = random.Random(11)
    texts = [None, "", " \n", "one two", "one two", "One  two"]
    for _ in range(12):
        base = [f"w{r.randrange(5000)}" for _ in range(300)]
        texts.append(" ".join(base))
        for k in (1, 3, 5, 6, 7, 8):  # Jaccard from about 0.97 to 0.76
            copy = list(base)
            for at in r.sample(range(300), k):
                copy[at] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(copy))
    r.shuffle(texts)
    ids = [None if i == 5 else i for i in range(len(texts))]
    ss = [sets(t) for t in texts]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, i))
    root = {i: i for i in order}
    for a, i in enumerate(order):
        for j in order[:a]:
            if len(ss[i] & ss[j]) * 5 >= len(ss[i] | ss[j]) * 4 and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]), key=order.index)
                root = {k: lo if v == hi else v for k, v in root.items()}
    rows = [(d, t, "x") for d, t in zip(ids, texts)]
    docs = spark.createDataFrame([*rows, rows[7]], "doc_id long, text string, kept string").repartition(3)
    got = [x.doc_id for x in simhash.keep_one(docs).collect()]
    assert sorted(got, key=str) == sorted((ids[i] for i, v in root.items() if i == v), key=str)


def test_simhashes_link_first(spark, monkeypatch):
    """The stage hands the pairs of the bit-sliced comparison to the lossless filter: all within three bits hang together."""
    r = random.Random(4)
    prints = [r.getrandbits(62) for _ in range(40)]
    prints += [p ^ (1 << r.randrange(62)) ^ (1 << r.randrange(62)) for p in prints[:20]] + prints[:5]
    frame = spark.createDataFrame(list(enumerate(prints)), "node long, fp long")
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if x == hi else x for x in root]
    found = {x.node: x.root for x in simhash.components(simhash.likely_pairs(frame)).collect()}
    assert [found.get(i, i) for i in range(len(prints))] == root
    given, real = [], simhash.linked_groups
    monkeypatch.setattr(simhash, "linked_groups", lambda *a: given.append(a[5].count()) or real(*a))
    base = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(base[:-1])), (3, " ".join(reversed(base)))], "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.keep_one(docs).collect()) == [1, 3] and given == [1]


def test_a_passage_of_many_texts_makes_no_pairs(spark, monkeypatch):
    """Texts that are not alike share a passage: its shingles come last in prefixes, so that no part has all the texts."""
    parts, real = [], simhash.linked_groups
    monkeypatch.setattr(simhash, "linked_groups", lambda rows, *a: parts.extend(x["count"] for x in rows.groupBy("part").count().collect()) or real(rows, *a))
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join([*passage, *[f"w{i}x{k}" for k in range(60)]])) for i in range(300)]
    near = [(1000 + i, t.replace(f"w{i}x9", "other")) for i, t in rows[:5]]
    docs = spark.createDataFrame([*rows, *near], "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.keep_one(docs).collect()) == list(range(300))
    assert max(parts) < 50
