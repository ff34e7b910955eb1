"""Image kernels against slow versions that go pixel by pixel, and the curve of thresholds against a plain one."""

import random

import numpy as np
import pytest

from sightline.operators import evaluate, variants

SHAPES = [(8, 8), (1, 1), (5, 17), (24, 40, 3), (1, 9, 3), (33, 2)]


def image(shape, seed):
    r = np.random.default_rng(seed)
    kind = seed % 3
    if kind == 0:
        return r.integers(0, 256, shape, dtype=np.uint8)
    if kind == 1:
        return np.full(shape, 77, dtype=np.uint8)
    return np.clip(r.normal(120, 12, shape), 0, 255).astype(np.uint8)


def cubic(t):
    t, a = abs(t), -0.75
    return (a + 2) * t**3 - (a + 3) * t**2 + 1 if t <= 1 else a * (t**3 - 5 * t**2 + 8 * t - 4) if t < 2 else 0.0


def slow_enlarged(img, scale):
    h, w = img.shape[:2]
    planes = img.reshape(h, w, -1)
    out = np.zeros((int(h * scale + 0.5), int(w * scale + 0.5), planes.shape[2]), dtype=np.uint8)

    def taps(at, size):
        x = (at + 0.5) / scale - 0.5
        base = int(np.floor(x))
        ws = [int(np.rint(cubic(x - base + 1 - k) * 2048)) for k in range(4)]
        ws[1] += 2048 - sum(ws)
        return [(min(max(base + k - 1, 0), size - 1), ws[k]) for k in range(4)]

    for y in range(out.shape[0]):
        for x in range(out.shape[1]):
            for c in range(out.shape[2]):
                v = sum(wy * sum(wx * int(planes[i, j, c]) for j, wx in taps(x, w)) for i, wy in taps(y, h))
                out[y, x, c] = min(255, max(0, (v + (1 << 21)) >> 22))
    return out.reshape(*out.shape[:2], *img.shape[2:])


def mirrored(i, n):
    while n > 1 and not 0 <= i < n:
        i = -i if i < 0 else 2 * (n - 1) - i
    return i if n > 1 else 0


def slow_equalised(g):
    h, w = g.shape
    th, tw = -(-h // 8), -(-w // 8)
    area, tables = th * tw, {}
    for a in range(8):
        for b in range(8):
            hist = [0] * 256
            for y in range(a * th, a * th + th):
                for x in range(b * tw, b * tw + tw):
                    hist[g[mirrored(y, h), mirrored(x, w)]] += 1
            most, spare = max(1, int(2.0 * area / 256)), 0
            for i in range(256):
                if hist[i] > most:
                    spare, hist[i] = spare + hist[i] - most, most
            hist = [v + spare // 256 for v in hist]
            rest = spare % 256
            step, i = max(256 // max(rest, 1), 1), 0
            while i < 256 and rest > 0:
                hist[i], rest, i = hist[i] + 1, rest - 1, i + step
            total, table = 0, []
            for v in hist:
                total += v
                table.append(min(255, (total * 510 + area) // (2 * area)))
            tables[a, b] = table
    out = np.zeros_like(g)
    hold = lambda i: min(7, max(0, i))
    for y in range(h):
        for x in range(w):
            fy, fx = 2 * y - th, 2 * x - tw
            a, b = fy // (2 * th), fx // (2 * tw)
            v = 0
            for i, wy in ((a, 2 * th - (fy - a * 2 * th)), (a + 1, fy - a * 2 * th)):
                for j, wx in ((b, 2 * tw - (fx - b * 2 * tw)), (b + 1, fx - b * 2 * tw)):
                    v += wy * wx * tables[hold(i), hold(j)][g[y, x]]
            out[y, x] = (2 * v + 4 * area) // (8 * area)
    return out


def slow_sharpened(img):
    h, w = img.shape[:2]
    planes = img.reshape(h, w, -1).astype(int)
    out = np.zeros(planes.shape, dtype=np.uint8)
    for y in range(h):
        for x in range(w):
            for c in range(planes.shape[2]):
                at = lambda i, j: planes[mirrored(i, h), mirrored(j, w), c]  # noqa: B023, E731
                out[y, x, c] = min(255, max(0, 5 * at(y, x) - at(y - 1, x) - at(y + 1, x) - at(y, x - 1) - at(y, x + 1)))
    return out.reshape(img.shape)


def slow_otsu(g):
    v, best, top = g.ravel().astype(float), 0, 0.0
    for level in range(256):
        a, b = v[v <= level], v[v > level]
        if len(a) and len(b):
            s = len(a) * len(b) * (a.mean() - b.mean()) ** 2
            if s > top * (1 + 1e-12):
                best, top = level, s
    return best


@pytest.mark.parametrize("seed", range(12))
def test_kernels(seed):
    img = image(SHAPES[seed % len(SHAPES)], seed)
    assert (variants.enlarged(img, 3.0) == slow_enlarged(img, 3.0)).all()
    assert (variants.enlarged(img, 2.37) == slow_enlarged(img, 2.37)).all()
    assert (variants.sharpened(img) == slow_sharpened(img)).all()
    g = variants.gray(img)
    assert (variants.equalised(g) == slow_equalised(g)).all() and variants.otsu(g) == slow_otsu(g)


def test_sets_of_variants(spark):
    img = image((10, 14, 3), 3)
    rows = [(1, 14, 10, 3, img.tobytes()), (2, 9, 9, 1, b"short"), (3, 9, 9, 1, None), (4, 200, 1, 1, bytes(range(200)))]
    df = spark.createDataFrame(rows, "id long, width int, height int, channels int, content binary")
    got = {(r.id, r.variant): r for r in variants.variants(df).collect()}
    assert {k for k in got if k[0] == 1} == {(1, v) for v in ("upscaled", "clahe", "sharpened", "threshold")} and {k[0] for k in got} == {1, 4}
    big = slow_enlarged(img, 3.0)
    # the rescue stage sharpens the enlarged image, and takes its threshold from its gray
    assert bytes(got[1, "sharpened"].content) == slow_sharpened(big).tobytes() and got[1, "sharpened"].channels == 3
    gray = variants.gray(big)
    assert bytes(got[1, "threshold"].content) == np.where(gray > slow_otsu(gray), 255, 0).astype(np.uint8).tobytes()
    fit = {(r.id, r.variant): r for r in variants.variants(df, "consensus").collect()}
    wide = slow_enlarged(img, 6.0)
    even = slow_equalised(variants.gray(wide))
    # the consensus stage sharpens the equalised gray
    assert bytes(fit[1, "sharpened"].content) == slow_sharpened(even).tobytes() and fit[4, "gray"].width == 400
    assert {r.variant for r in variants.variants(df, "two_line").collect()} == {"original", "upscaled", "clahe", "sharpened", "threshold"}
    assert variants.variants(df.filter("false")).count() == 0


def test_curve_and_its_point(spark):
    r = random.Random(8)
    rows = [(r.choice([None, *[k / 40 for k in range(41)]]), r.choice([0, 0, 1, None])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "score double, truth int")
    total = sum(t == 1 for _, t in rows)
    want = []
    for x in sorted({s for s, _ in rows if s is not None}, reverse=True):
        tp = sum(s is not None and s >= x and t == 1 for s, t in rows)
        fp = sum(s is not None and s >= x and t != 1 for s, t in rows)
        want.append((x, tp, fp, total - tp))
    points = evaluate.curve(df)
    assert sorted(((p.threshold, p.tp, p.fp, p.fn) for p in points.collect()), reverse=True) == want
    at = evaluate.curve_point(points, 0.9).first()
    ok = [p for p in points.collect() if p.recall >= 0.9]
    top = max(p.f1 for p in ok)
    near = [p for p in ok if np.isclose(p.f1, top)]
    assert (at.threshold, at.f1) == max(((p.threshold, p.f1) for p in near), key=lambda x: (next(p.precision for p in near if p.threshold == x[0]), -x[0]))
    assert evaluate.curve_point(points, 2.0).first().reason.startswith("highest F1; no")
    assert evaluate.curve_point(evaluate.curve(df.filter("false")), 0.5).count() == 0


def test_close_points_go_by_precision(spark):
    df = spark.createDataFrame([(0.1, 0.5, 0.8, 0.9), (0.2, 0.7, 0.8 - 1e-7, 0.9), (0.3, 0.9, 0.79, 0.9), (0.4, 1.0, 0.99, 0.1)], "threshold double, precision double, f1 double, recall double")
    assert evaluate.curve_point(df, 0.5).first().threshold == 0.2


def test_upper_medians_gather_no_group(spark):
    df = spark.createDataFrame([(i % 3, float(i * 7919 % 1000)) for i in range(5000)], "g int, v double")
    found = evaluate.upper_medians(df, "g", "v")
    assert "collect_list" not in found._jdf.queryExecution().toString()
    assert {r.g: r.v for r in found.collect()} == {g: sorted(float(i * 7919 % 1000) for i in range(5000) if i % 3 == g)[len(range(g, 5000, 3)) // 2] for g in range(3)}
