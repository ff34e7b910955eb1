"""The parsers against a plain list of all windows, on odd texts too, and the common substring against a plain search."""

import random

from pyspark.sql import functions as F

from sightline.functions import plates
from sightline.functions.text import longest_common_substring

D, L = str.maketrans(*plates.TO_DIGIT), str.maketrans(*plates.TO_LETTER)


def windows(text, masks, weight, by_cost):
    for k, s, n in masks:
        size = 4 + s + n
        for at in range(len(text) - size + 1):
            w = text[at : at + size]
            a, b, c, d = w[:2], w[2:4], w[4 : 4 + s], w[4 + s :]
            plate = a.translate(L) + b.translate(D) + c.translate(L) + d.translate(D)
            ok = plate[:2] in plates.STATES and (plate[:2] + plate[4 : 4 + s]).isalpha() and (plate[2:4] + plate[4 + s :]).isdigit()
            if ok:
                cost = sum(x.isdigit() for x in a + c) + sum(x.isalpha() for x in b + d)
                yield (cost * 100 + (len(text) - size) * weight[0] - size * weight[1], cost if by_cost else 0, k * 100_000 + at + 1, cost, len(text) - size, at, plate)


def best(found):
    w = min(found, default=None)
    return ("", -1, 999, -1) if w is None else (w[6], w[3], w[4], w[5])


def test_parsers_on_odd_and_long_texts(spark):
    r = random.Random(9)
    noise = lambda n: "".join(r.choice("AB0159OISZQDKLMH34RJ") for _ in range(n))
    texts = ["", "A", "0" * 11, "KL01AB1234", "22BH1234AA", "KLO1AB12B4", "K", None]
    for n in (8, 12, 40, 59, 60, 97, 150, 400):
        texts += [noise(n) + r.choice(["KL0IAB1234", "MHI2B34S6", "DL8CAF5O3O", ""]) + noise(r.randrange(9)) for _ in range(25)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", plates.parse_plate("t").alias("p"), plates.parse_fused("t").alias("f"), plates.correct_standard("t").alias("s")).collect()
    fused = [(k, s, n) for k, (s, n) in enumerate(((s, n) for s in (1, 2, 3) for n in (1, 2, 3, 4)), 1)]
    old = str.maketrans(*plates.TO_DIGIT_OLD)
    for x in got:
        t = texts[x.i] or ""
        assert tuple(x.p) == best(windows(t, [(2, 1, 4), (1, 2, 4)], (25, 2), True)), t
        if t != "22BH1234AA":
            assert tuple(x.f) == best(windows(t, fused, (35, 1), False)), t
        whole = []
        for k, s, n in fused:
            if len(t) == 4 + s + n:
                plate = t[:2].translate(L) + t[2:4].translate(old) + t[4 : 4 + s].translate(L) + t[4 + s :].translate(old)
                if plate[:2] in plates.STATES and (plate[:2] + plate[4 : 4 + s]).isalpha() and (plate[2:4] + plate[4 + s :]).isdigit():
                    whole.append((sum(c.isdigit() for c in t[:2] + t[4 : 4 + s]) + sum(c.isalpha() for c in t[2:4] + t[4 + s :]), k, plate))
        assert (tuple(x.s) if x.s else None) == ((min(whole)[2], min(whole)[0]) if whole else None), t
    assert got[4].f.plate == "22BH1234AA"


def test_longest_common_substring(spark):
    r = random.Random(10)
    pairs = [("", "a"), ("a", None), (None, ""), ("abc", "abc"), ("abcab", "xabyabc"), ("xyzxy", "xy"), ("é😀é", "a😀é"), ("ab" * 300, "ba" * 400)]
    pairs += [("".join(r.choice("abc") for _ in range(r.randrange(14))), "".join(r.choice("abc") for _ in range(r.randrange(30)))) for _ in range(120)]

    def plain(a, b):
        a, b = a or "", b or ""
        runs = [(-n, i) for i in range(len(a)) for n in range(1, len(a) - i + 1) if a[i : i + n] in b]
        return a[min(runs)[1] : min(runs)[1] - min(runs)[0]] if runs else ""

    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    for x in df.select("i", longest_common_substring("a", "b").alias("s")).collect():
        assert x.s == plain(*pairs[x.i]), pairs[x.i]
    long = spark.range(1).select(longest_common_substring(F.repeat(F.lit("abcd"), 500), F.concat(F.repeat(F.lit("x"), 3000), F.lit("dabc"))).alias("s")).first()
    assert long.s == "dabc"
