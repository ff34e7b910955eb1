"""Putting recognised regions in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.text import clean_text
from sightline.plans.lineage import let


def bucket_row(y: Column | str, size: float = 30.0) -> Column:
    """Row of a region by its top, with banker's rounding."""
    return F.bround((F.col(y) if isinstance(y, str) else y) / size).cast("long")


def rows_by_bucket(regions: DataFrame, key: str, size: float = 30.0) -> DataFrame:
    """regions (key, x, y, text, conf): text joined by (row, x), and mean confidence weighted by length."""
    part = F.collect_list(F.struct(bucket_row("y", size).alias("row"), "x", "text"))
    n = F.length("text")
    return regions.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(part), lambda r: r["text"]), "").alias("text"), F.round(F.coalesce(F.sum(F.col("conf") * n) / F.nullif(F.sum(n), F.lit(0)), F.lit(0.0)), 9).alias("confidence")
    )


def cluster_rows(regions: Column, tolerance: Column | None = None) -> Column:
    """An array of (y, x, h, text) regions to rows: in order of y, a region joins the first row whose mean y
    is within max(10, 0.6 median height) (the upper of two middle heights), else opens one. Rows keep their order; regions in a row go by x.
    A fold over one image's regions."""
    by_y = F.array_sort(regions)
    heights = F.array_sort(F.transform(by_y, lambda r: r["h"]))
    n = F.size(heights)
    middle = F.get(heights, F.floor(n / 2).cast("int"))
    tol = F.greatest(F.lit(10.0), 0.6 * middle) if tolerance is None else tolerance
    item = "struct<x:double,text:string>"
    empty = F.array().cast(f"array<struct<sum:double,n:int,items:array<{item}>>>")

    def step(rows: Column, r: Column) -> Column:
        fits = F.transform(rows, lambda row: F.abs(row["sum"] / row["n"] - r["y"]) <= tol)
        at = F.array_position(fits, True)
        one = F.struct(r["x"].cast("double").alias("x"), r["text"].alias("text"))
        opened = F.array(F.struct(r["y"].cast("double").alias("sum"), F.lit(1).alias("n"), F.array(one).alias("items")))
        joined = F.transform(rows, lambda row, i: F.when(i + 1 == at, F.struct((row["sum"] + r["y"]).alias("sum"), (row["n"] + 1).alias("n"), F.concat(row["items"], F.array(one)).alias("items"))).otherwise(row))
        return F.when(at > 0, joined).otherwise(F.concat(rows, opened))

    done = F.aggregate(by_y, empty, step)
    return F.transform(done, lambda row: F.array_join(F.transform(F.array_sort(row["items"]), lambda i: i["text"]), ""))


def reversed_if_better(rows: Column, parse) -> Column:
    """Lines top to bottom, or bottom to top if there are two or more, the first order doesn't parse and
    the other does. parse: Column -> Column, empty where it fails."""
    down, up = F.array_join(rows, ""), F.array_join(F.reverse(rows), "")
    return F.when((F.size(rows) >= 2) & (parse(down) == "") & (parse(up) != ""), up).otherwise(down)


def cluster_lines(regions: Column) -> Column:
    """The second engine's rule, over an array of (y, x, h, text): in order of y, a region joins the first line whose mean y
    is within 0.6 of the larger of its own height and the line's mean height, else opens one. Lines go by
    their mean y in the end; regions in a line by x."""
    item = "struct<x:double,text:string>"
    empty = F.array().cast(f"array<struct<y:double,h:double,n:int,items:array<{item}>>>")

    def step(lines: Column, r: Column) -> Column:
        fits = F.transform(lines, lambda k: F.abs(r["y"] - k["y"] / k["n"]) <= 0.6 * F.greatest(r["h"], k["h"] / k["n"]))
        at = F.array_position(fits, True)
        one = F.struct(r["x"].cast("double").alias("x"), r["text"].alias("text"))
        opened = F.array(F.struct(r["y"].cast("double").alias("y"), r["h"].cast("double").alias("h"), F.lit(1).alias("n"), F.array(one).alias("items")))
        joined = F.transform(lines, lambda k, i: F.when(i + 1 == at, F.struct((k["y"] + r["y"]).alias("y"), (k["h"] + r["h"]).alias("h"), (k["n"] + 1).alias("n"), F.concat(k["items"], F.array(one)).alias("items"))).otherwise(k))
        return F.when(at > 0, joined).otherwise(F.concat(lines, opened))

    done = F.aggregate(F.array_sort(regions), empty, step)
    by_mean = F.array_sort(F.transform(done, lambda k, i: F.struct((k["y"] / k["n"]).alias("m"), i.alias("i"), k["items"].alias("items"))))
    return F.transform(by_mean, lambda k: F.array_join(F.transform(F.array_sort(k["items"]), lambda i: i["text"]), ""))


_RESULT = "rec_texts array<string>, rec_scores array<double>, rec_boxes array<array<double>>"


def result_regions(result: Column | str) -> Column:
    """Regions (place, text, conf, x, y, h) of an engine's JSON result, bare or under "res". A text without a score has
    confidence 0; one without a box lies at (place, 0, place + 1, 1). Heights are 1 at least; blank texts are left out."""
    both = F.from_json(result, f"{_RESULT}, res struct<{_RESULT.replace(' array', ':array')}>")

    def zipped(r: Column) -> Column:
        texts, scores, boxes = (F.coalesce(r["res"][c], F.when(r["res"].isNull(), r[c]), F.array()) for c in ("rec_texts", "rec_scores", "rec_boxes"))

        def region(text: Column, i: Column) -> Column:
            at = i.cast("double")
            box = F.coalesce(F.get(boxes, i), F.array(at, F.lit(0.0), at + 1, F.lit(1.0)))
            return let(box, lambda b: F.struct(
                i.alias("place"), clean_text(text).alias("text"), F.coalesce(F.get(scores, i), F.lit(0.0)).alias("conf"),
                ((F.get(b, F.lit(0)) + F.get(b, F.lit(2))) / 2).alias("x"), ((F.get(b, F.lit(1)) + F.get(b, F.lit(3))) / 2).alias("y"), F.greatest(F.get(b, F.lit(3)) - F.get(b, F.lit(1)), F.lit(1.0)).alias("h"),
            ))

        return F.filter(F.transform(texts, region), lambda x: x["text"] != "")

    return let(both, zipped)


def polygon_region(points: Column) -> Column:
    """(x, y, h) of a polygon of points (x, y): the mean of its corners, and its height, 1 at least."""
    axis = lambda k: F.transform(points, lambda p: p[k])
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    return F.struct(mean(axis("x")).alias("x"), mean(axis("y")).alias("y"), F.greatest(F.array_max(axis("y")) - F.array_min(axis("y")), F.lit(1.0)).alias("h"))


def reading(regions: Column, lines=cluster_rows) -> Column:
    """text, confidence, regions and lines of an array of regions (text, conf, x, y, h): the lines by one of the rules above,
    joined, and the mean confidence weighted by characters (0 without any). Null counts as no regions."""
    found = F.filter(F.coalesce(regions, F.array()), lambda r: F.coalesce(r["text"], F.lit("")) != "")

    def of(rs: Column) -> Column:
        n = F.aggregate(rs, F.lit(0), lambda a, r: a + F.length(r["text"]))
        weighted = F.aggregate(rs, F.lit(0.0), lambda a, r: a + F.coalesce(r["conf"], F.lit(0.0)) * F.length(r["text"]))
        rows = lines(F.transform(rs, lambda r: F.struct(r["y"].alias("y"), r["x"].alias("x"), r["h"].alias("h"), r["text"].alias("text"))))
        return let(rows, lambda ls: F.struct(F.array_join(ls, "").alias("text"), F.when(n > 0, weighted / n).otherwise(0.0).alias("confidence"), F.size(rs).alias("regions"), ls.alias("lines")))

    return let(found, of)


def extract_result(result: Column | str) -> Column:
    """The first engine's reading of its JSON result."""
    return reading(result_regions(result))


def extract_polygons(found: Column | str) -> Column:
    """The second engine's reading of an array of (points, text, conf): polygons become regions, texts are cleaned, and lines go
    by its own rule."""

    def region(r: Column) -> Column:
        return let(polygon_region(r["points"]), lambda p: F.struct(clean_text(r["text"]).alias("text"), r["conf"].alias("conf"), p["x"].alias("x"), p["y"].alias("y"), p["h"].alias("h")))

    return reading(F.transform(F.col(found) if isinstance(found, str) else found, region), cluster_lines)
