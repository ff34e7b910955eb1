"""Preprocessing variants of images, as kernels over whole arrays: cubic enlargement, tiled histogram equalisation with
clipping, sharpening and Otsu's threshold. Grey levels are whole numbers throughout, so every kernel is exact.

An image is an array of height x width (gray) or height x width x 3 (blue, green, red) bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Bits of the fixed-point weights of the cubic kernel, and its free parameter.
BITS, CUBIC = 11, -0.75
CLIP, TILES = 2.0, 8
#: An image of a batch is enlarged up to 36-fold and gives up to five variants.
IMAGES = 16
OUT = "id long, variant string, width int, height int, channels int, content binary"


def _weights(size: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of the enlarged positions the four source positions (edges repeat) and their weights."""
    out = int(np.floor(size * scale + 0.5))
    x = (np.arange(out) + 0.5) / scale - 0.5
    base = np.floor(x).astype(np.int64)
    t = (x - base)[:, None] + np.array([1.0, 0.0, -1.0, -2.0])
    d = np.abs(t)
    near = (CUBIC + 2) * d**3 - (CUBIC + 3) * d**2 + 1
    far = CUBIC * (d**3 - 5 * d**2 + 8 * d - 4)
    w = np.rint(np.where(d <= 1, near, far) * (1 << BITS)).astype(np.int64)
    w[:, 1] += (1 << BITS) - w.sum(1)  # weights add up to one
    return np.clip(base[:, None] + np.arange(-1, 3), 0, size - 1), w


def enlarged(image: np.ndarray, scale: float) -> np.ndarray:
    """Cubic enlargement in fixed point, rounded once."""
    (ys, wy), (xs, wx) = _weights(image.shape[0], scale), _weights(image.shape[1], scale)
    planes = image.reshape(*image.shape[:2], -1).astype(np.int64)
    across = np.einsum("hokc,ok->hoc", planes[:, xs], wx)
    down = np.einsum("okwc,ok->owc", across[ys], wy)
    half = 1 << (2 * BITS - 1)
    return np.clip((down + half) >> (2 * BITS), 0, 255).astype(np.uint8).reshape(len(ys), len(xs), *image.shape[2:])


def gray(image: np.ndarray) -> np.ndarray:
    """0.114 blue + 0.587 green + 0.299 red, in 14 bits, rounded."""
    if image.ndim == 2:
        return image
    b, g, r = np.moveaxis(image.astype(np.int64), 2, 0)
    return ((1868 * b + 9617 * g + 4899 * r + (1 << 13)) >> 14).astype(np.uint8)


def equalised(g: np.ndarray, clip: float = CLIP, tiles: int = TILES) -> np.ndarray:
    """Equalisation of each of tiles x tiles tiles (the image is mirrored at the right and the bottom where it doesn't divide
    evenly), blended linearly between the four nearest tile centres. A histogram bin above clip times the mean goes down to
    that, and what is cut is spread evenly over all levels, the rest at even distances."""
    h, w = g.shape
    pads = [-h % tiles, -w % tiles]
    # mirrored without the edge, as often as it takes
    whole = np.pad(g, [(0, pads[0]), (0, pads[1])], mode="reflect") if any(pads) else g
    th, tw = whole.shape[0] // tiles, whole.shape[1] // tiles
    area = th * tw
    blocks = whole.reshape(tiles, th, tiles, tw).swapaxes(1, 2).reshape(tiles * tiles, area).astype(np.int64)
    hist = np.bincount((blocks + 256 * np.arange(tiles * tiles)[:, None]).ravel(), minlength=256 * tiles * tiles).reshape(-1, 256)
    most = max(1, int(clip * area / 256))
    cut = np.maximum(hist - most, 0).sum(1)
    hist = np.minimum(hist, most) + (cut // 256)[:, None]
    rest = cut % 256
    step = np.maximum(256 // np.maximum(rest, 1), 1)
    level = np.arange(256)
    hist += (level % step[:, None] == 0) & (level // step[:, None] < rest[:, None])
    table = ((hist.cumsum(1) * 510 + area) // (2 * area)).clip(0, 255).reshape(tiles, tiles, 256)
    # positions in halves of a tile: exact weights over 2 * th and 2 * tw
    y, x = 2 * np.arange(h) - th, 2 * np.arange(w) - tw
    y1, x1 = y // (2 * th), x // (2 * tw)
    fy, fx = (y - y1 * 2 * th)[:, None], (x - x1 * 2 * tw)[None, :]
    at = lambda i: np.clip(i, 0, tiles - 1)
    corner = lambda i, j: table[at(y1 + i)[:, None], at(x1 + j)[None, :], g]
    top = corner(0, 0) * (2 * tw - fx) + corner(0, 1) * fx
    bottom = corner(1, 0) * (2 * tw - fx) + corner(1, 1) * fx
    return ((2 * (top * (2 * th - fy) + bottom * fy) + 4 * area) // (8 * area)).astype(np.uint8)


def sharpened(image: np.ndarray) -> np.ndarray:
    """Five times a pixel less its four neighbours (mirrored at the edges, without the edge), within 0 and 255."""
    mode = [(1, 1), (1, 1), *[(0, 0)] * (image.ndim - 2)]
    p = image.astype(np.int64)
    for axis in (0, 1):  # an edge of one pixel has no neighbour to mirror
        one = [m if i == axis else (0, 0) for i, m in enumerate(mode)]
        p = np.pad(p, one, mode="reflect" if image.shape[axis] > 1 else "edge")
    return np.clip(5 * p[1:-1, 1:-1] - p[:-2, 1:-1] - p[2:, 1:-1] - p[1:-1, :-2] - p[1:-1, 2:], 0, 255).astype(np.uint8)


def otsu(g: np.ndarray) -> int:
    """The level of the greatest variance between what is up to it and what is above it, the least one on a tie; 0 if there is
    one level only. Variances are compared as fractions."""
    hist = np.bincount(g.ravel(), minlength=256)
    n, total = int(hist.sum()), int((hist * np.arange(256)).sum())
    below, mass = hist.cumsum().tolist(), (hist * np.arange(256)).cumsum().tolist()
    best, over, under = 0, 0, 1
    for level in range(256):
        q = below[level]
        if 0 < q < n:
            top, bottom = (total * q - n * mass[level]) ** 2, q * (n - q)
            if top * under > over * bottom:
                best, over, under = level, top, bottom
    return best


def binary(g: np.ndarray) -> np.ndarray:
    return np.where(g > otsu(g), 255, 0).astype(np.uint8)


def tripled(image: np.ndarray) -> dict[str, np.ndarray]:
    """Three times the size: enlarged, its gray equalised, the enlarged one sharpened, its gray as black and white."""
    big = enlarged(image, 3.0)
    g = gray(big)
    return {"upscaled": big, "clahe": equalised(g), "sharpened": sharpened(big), "threshold": binary(g)}


def with_original(image: np.ndarray) -> dict[str, np.ndarray]:
    return {"original": image, **tripled(image)}


def fitted(image: np.ndarray, width: int = 360) -> dict[str, np.ndarray]:
    """Enlarged to about `width` pixels, two to six times; sharpening and threshold follow equalisation."""
    big = enlarged(image, max(2.0, min(6.0, width / max(image.shape[1], 1))))
    g = gray(big)
    even = equalised(g)
    return {"original": big, "gray": g, "clahe": even, "sharpened": sharpened(even), "threshold": binary(even)}


#: The sets of variants by name: of the rescue stage, of the two-line stage, and of the consensus stage.
SETS = {"rescue": tripled, "two_line": with_original, "consensus": fitted}


def variants(images: DataFrame, of: str = "rescue") -> DataFrame:
    """images (id, width, height, channels (1 or 3), content: bytes row by row) to id, variant, width, height, channels and
    content, a row for each variant of the set. An image whose content is null, empty or of another size gives no rows.
    A task holds IMAGES images at a time."""
    make = SETS[of]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), IMAGES):
                part, out = b.iloc[lo : lo + IMAGES], []
                for i, w, h, c, content in zip(part["id"], part["width"], part["height"], part["channels"], part["content"]):
                    if content is None or not len(content) or len(content) != w * h * c:
                        continue
                    image = np.frombuffer(content, np.uint8).reshape((h, w) if c == 1 else (h, w, c))
                    for name, made in make(image).items():
                        out.append((i, name, made.shape[1], made.shape[0], 1 if made.ndim == 2 else made.shape[2], np.ascontiguousarray(made).tobytes()))
                yield pd.DataFrame(out, columns=["id", "variant", "width", "height", "channels", "content"])

    return images.select("id", "width", "height", "channels", "content").mapInPandas(work, OUT)
