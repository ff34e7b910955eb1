"""Sinks: CSV, JSON, text, label files, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.sources.store import written


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, files: int | None = None) -> None:
    """Overwrite a folder of CSV files under a fixed list of columns; columns that are missing are empty,
    nulls too. An empty table still writes its header where files is 1."""
    if columns:
        df = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])
    (df.coalesce(files) if files else df).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_document(row: dict[str, object], path: str, spark: SparkSession) -> None:
    """A summary as one indented JSON document."""
    write_text(spark, json.dumps(row, indent=2, default=str), path)


def report(row: dict[str, object], title: str) -> str:
    """A text report of a summary that has one row."""
    width = max((len(k) for k in row), default=0)
    return "\n".join([title, "=" * len(title), *(f"{k:<{width}} : {v}" for k, v in row.items()), ""])


def dataset_yaml(root: str, splits: dict[str, str], names: list[str]) -> str:
    lines = [f"path: {root}", *(f"{k}: {v}" for k, v in splits.items()), f"nc: {len(names)}", "names:"]
    return "\n".join([*lines, *(f"  {i}: {json.dumps(n)}" for i, n in enumerate(names)), ""])


def write_labels(boxes: DataFrame, path: str, buckets: int = 256) -> DataFrame:
    """boxes (image, box): a file image.txt for each image, with a line of six decimals for each box, in `buckets` folders by
    the hash of the name: name and length of each file. An image's boxes are one cell; a null box makes an empty file."""
    from sightline.functions.geometry import yolo_line

    lines = boxes.groupBy("image").agg(F.array_sort(F.collect_list(F.when(F.col("box").isNotNull(), yolo_line("box")))).alias("lines"))
    name = F.concat(F.lower(F.lpad(F.hex(F.pmod(F.xxhash64("image"), F.lit(buckets))), 4, "0")), F.lit("/"), F.col("image").cast("string"), F.lit(".txt"))
    return written(lines.select(name.alias("name"), F.encode(F.array_join(F.transform("lines", lambda x: F.concat(x, F.lit("\n"))), ""), "UTF-8").alias("content")), path)


def write_by_category(df: DataFrame, path: str, category: str) -> None:
    df.write.mode("overwrite").partitionBy(category).parquet(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
