"""Column functions on boxes and image measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.text import _c


def clamp(x, low, high) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(lit(low), F.least(_c(x), lit(high)))


def coco_to_yolo(w_img, h_img, x, y, w, h) -> Column:
    """xc, yc, w, h as shares of the image; null for boxes without area before or after clipping. A negative
    corner is moved to 0 without making the box smaller; what passes the far side is cut off."""
    w_img, h_img, x, y, w, h = map(_c, (w_img, h_img, x, y, w, h))
    left, top = F.greatest(x, F.lit(0.0)), F.greatest(y, F.lit(0.0))
    cw, ch = F.least(w, w_img - left), F.least(h, h_img - top)
    box = F.struct(((left + cw / 2) / w_img).alias("xc"), ((top + ch / 2) / h_img).alias("yc"), (cw / w_img).alias("w"), (ch / h_img).alias("h"))
    return F.when((w > 0) & (h > 0) & (cw > 0) & (ch > 0), box)


def yolo_to_pixels(box, w_img, h_img) -> Column:
    b, w, h = _c(box), _c(w_img), _c(h_img)
    return F.struct(((b["xc"] - b["w"] / 2) * w).alias("x1"), ((b["yc"] - b["h"] / 2) * h).alias("y1"), ((b["xc"] + b["w"] / 2) * w).alias("x2"), ((b["yc"] + b["h"] / 2) * h).alias("y2"))


def pixels_inside(px, w_img, h_img) -> Column:
    """Cut to whole pixels and clamped to the image."""
    p, w, h = _c(px), _c(w_img), _c(h_img)
    return F.struct(*[clamp(p[k].cast("int"), 0, (side - 1).cast("int")).alias(k) for k, side in (("x1", w), ("y1", h), ("x2", w), ("y2", h))])


def padded(px, w_img, h_img, ratio: float = 0.08) -> Column:
    """A crop's box: padded by a share of its own sides, clamped, whole pixels."""
    p, w, h = _c(px), _c(w_img), _c(h_img)
    px_, py_ = ((p["x2"] - p["x1"]) * ratio).cast("int"), ((p["y2"] - p["y1"]) * ratio).cast("int")
    return F.struct(
        F.greatest(F.lit(0), p["x1"].cast("int") - px_).alias("x1"), F.greatest(F.lit(0), p["y1"].cast("int") - py_).alias("y1"),
        F.least(w.cast("int"), p["x2"].cast("int") + px_).alias("x2"), F.least(h.cast("int"), p["y2"].cast("int") + py_).alias("y2"),
    )


def shifted(inner, outer) -> Column:
    """A box inside another one, in the coordinates of the whole frame."""
    a, b = _c(inner), _c(outer)
    return F.struct((a["x1"] + b["x1"]).alias("x1"), (a["y1"] + b["y1"]).alias("y1"), (a["x2"] + b["x1"]).alias("x2"), (a["y2"] + b["y1"]).alias("y2"))


def area_share(px, w_img, h_img) -> Column:
    p = _c(px)
    area, whole = F.greatest(F.lit(0.0), p["x2"] - p["x1"]) * F.greatest(F.lit(0.0), p["y2"] - p["y1"]), _c(w_img) * _c(h_img)
    return F.when(whole > 0, area / whole).otherwise(0.0)


def big_enough(w, h, least_w: int = 40, least_h: int = 12, aspect: tuple[float, float] = (1.2, 6.5)) -> Column:
    w, h = _c(w), _c(h)
    ratio = w / F.greatest(h, F.lit(1))
    return (w >= least_w) & (h >= least_h) & (ratio >= aspect[0]) & (ratio <= aspect[1])


def tracking_quality(conf, area, sharpness, contrast) -> Column:
    part = lambda x, top: F.least(_c(x) / top, F.lit(1.0))
    return 0.55 * _c(conf) + 0.25 * part(area, 15000.0) + 0.1 * part(sharpness, 500.0) + 0.1 * part(contrast, 70.0)


def benchmark_quality(w, h, sharpness, contrast) -> Column:
    part = lambda x, top: F.least(F.lit(1.0), _c(x) / top)
    return 0.5 * (0.6 * part(w, 180.0) + 0.4 * part(h, 60.0)) + 0.35 * part(sharpness, 800.0) + 0.15 * part(contrast, 60.0)


def crop_name(track, rank, frame, score) -> Column:
    return F.format_string("track_%04d_rank_%d_frame_%05d_score_%.3f.jpg", _c(track), _c(rank), _c(frame), _c(score))


def parse_crop_name(name) -> Column:
    x, p = _c(name), r"track_(\d+)_rank_(\d+)_frame_(\d+)_score_([0-9.]+)\.jpg"
    return F.struct(*[F.regexp_extract(x, p, i).try_cast(t).alias(n) for i, (n, t) in enumerate((("track", "int"), ("rank", "int"), ("frame", "int"), ("score", "double")), 1)])


def yolo_line(box) -> Column:
    b = _c(box)
    return F.format_string("0 %.6f %.6f %.6f %.6f", b["xc"], b["yc"], b["w"], b["h"])
