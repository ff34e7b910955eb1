"""Queries of posted annotations, versioned tables and staged readings."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from sightline.functions import plates
from sightline.operators import annotations, stages
from sightline.plans import views
from sightline.plans.lineage import shared_dir
from sightline.plans.queries import query
from sightline.plans.views import plain, view
from sightline.sources import versions

#: A post of each reading. Orders in progress are no samples.
POSTS = f"""
SELECT id AS sample_id, CASE id % 4 WHEN 0 THEN 'UNREADABLE' WHEN 1 THEN 'NOT_A_PLATE' WHEN 2 THEN 'VERIFIED' ELSE 'OTHER' END AS status, other AS text, id AS ord FROM ({views.READINGS})"""
SAMPLES = "SELECT CAST(o_orderkey AS BIGINT) AS sample_id, o_orderstatus AS benchmark_split FROM {orders} WHERE o_orderstatus <> 'P'"
BOXED = """
SELECT CAST(p_partkey AS BIGINT) AS "index", CASE WHEN p_size = 7 THEN 'other' ELSE p_brand END AS sample_id, p_size % 3 AS n, CAST(p_partkey % 120 AS DOUBLE) / 100 AS xc, CAST(p_partkey % 23 AS DOUBLE) / 23 AS w FROM {part}"""


@query
def posted_readings(spark, d):
    good, bad = annotations.posted_readings(view(spark, d, POSTS), view(spark, d, SAMPLES))
    return good.select("sample_id", "status", "text", "benchmark_split", F.lit("").alias("reason")).union(bad.select("sample_id", "status", "text", F.lit(""), "reason"))


@query
def posted_boxes(spark, d):
    rows = view(spark, d, BOXED.replace('"index"', "index"))
    box = F.struct("xc", F.lit(0.5).alias("yc"), "w", F.lit(0.25).alias("h"))
    posts = rows.select("index", "sample_id", F.array_repeat(box, F.col("n")).alias("boxes"))
    tasks = view(spark, d, "SELECT CAST(p_partkey AS BIGINT) AS index, p_brand AS sample_id, 2 AS expected FROM {part} WHERE p_size <> 3")
    return annotations.posted_boxes(posts, tasks).select("index", "reason")


@query
def annotation_progress(spark, d):
    return annotations.progress(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"), "doc_id")


@query
def versioned_labels(spark, d):
    """Labels, then a correction of the toxic ones and documents that are new to it, each as a version."""
    path, schema = f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}", "doc_id long, quality int"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    first = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    fixed = labels.filter("toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).alias("quality"))
    rest = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(-1).alias("quality"))
    versions.update(spark, path, schema, lambda t: annotations.upsert(t, first, "doc_id"))
    versions.update(spark, path, schema, lambda t: annotations.upsert(t, fixed, "doc_id"))
    versions.update(spark, path, schema, lambda t: annotations.insert_absent(t, rest, "doc_id"))
    every = [versions.read_version(spark, path, schema, v).withColumn("version", F.lit(v)) for v in versions.versions(spark, path)]
    return every[0].union(every[1]).union(every[2])


def _reader(change):
    """A stand-in for a recogniser: it reads what `change` makes of the text."""

    def factory():
        return lambda b: pd.DataFrame({"reading": [change(t or "") for t in b["raw_text"]]})

    return factory


@query
def staged_readings(spark, d):
    rows = view(spark, d, views.OBSERVATIONS).select("ord", "raw_text")
    table = str.maketrans("OISB", "0158")
    steps = [stages.Stage("0deg", _reader(lambda t: t)), stages.Stage("180deg", _reader(lambda t: t[::-1])), stages.Stage("threshold", _reader(lambda t: t[:2] + t[2:4].translate(table) + t[4:6] + t[6:].translate(table)))]
    return stages.staged(rows, "ord", steps, "reading string", plates.valid_format("reading"))


_VALID = f"regexp_full_match(regexp_replace(upper({{}}), '[^A-Z0-9]', '', 'g'), '{plates.STATE}[0-9]{{{{2}}}}[A-Z]{{{{1,3}}}}[0-9]{{{{1,4}}}}|{plates.BH.replace('{', '{{').replace('}', '}}')}')"
_LAST = "substr(raw_text, 1, 2) || translate(substr(raw_text, 3, 2), 'OISB', '0158') || substr(raw_text, 5, 2) || translate(substr(raw_text, 7), 'OISB', '0158')"
ORACLES: dict[str, str] = {
    "posted_readings": f"""WITH p AS (SELECT * REPLACE (regexp_replace(upper(text), '[^A-Z0-9]', '', 'g') AS text) FROM ({plain(POSTS)})), j AS (SELECT p.*, benchmark_split AS b, CASE WHEN s.sample_id IS NULL THEN 'unknown sample_id' WHEN status = 'OTHER' THEN 'invalid status'
        WHEN status = 'VERIFIED' AND length(text) < 5 THEN 'text too short' ELSE '' END AS reason FROM p LEFT JOIN ({plain(SAMPLES)}) s USING (sample_id))
        SELECT sample_id, status, CASE WHEN reason <> '' THEN (SELECT other FROM ({plain(views.READINGS)}) r WHERE r.id = sample_id) WHEN status = 'VERIFIED' THEN text ELSE '' END AS text, CASE WHEN reason = '' THEN b ELSE '' END AS benchmark_split, reason FROM j""",
    "posted_boxes": f"""SELECT b."index", CASE WHEN p_brand IS NULL THEN 'invalid task index' WHEN sample_id <> p_brand THEN 'sample mismatch' WHEN n <> 2 THEN 'expected 2 boxes' WHEN xc > 1 THEN 'outside' WHEN w = 0 THEN 'no area' END AS reason
        FROM ({plain(BOXED)}) b LEFT JOIN (SELECT p_partkey, p_brand FROM part WHERE p_size <> 3) ON p_partkey = b."index\"""",
    "annotation_progress": "SELECT count(*) AS total, count(l.doc_id) AS completed, min(CASE WHEN l.doc_id IS NULL THEN d.doc_id END) AS next FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id",
    "versioned_labels": """WITH a AS (SELECT doc_id, quality::INT AS quality, toxic FROM labels), b AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 0 ELSE quality END AS quality FROM a)
        SELECT doc_id, quality, 0 AS version FROM a UNION ALL SELECT doc_id, quality, 1 FROM b UNION ALL SELECT doc_id, quality, 2 FROM b UNION ALL SELECT doc_id, -1, 2 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "staged_readings": f"""WITH o AS (SELECT ord, raw_text, reverse(raw_text) AS back, {_LAST} AS fixed FROM ({plain(views.OBSERVATIONS)})), v AS (SELECT *, {_VALID.format('raw_text')} AS a, {_VALID.format('back')} AS b, {_VALID.format('fixed')} AS c FROM o)
        SELECT ord, CASE WHEN a THEN raw_text WHEN b THEN back ELSE fixed END AS reading, CASE WHEN a THEN '0deg' WHEN b THEN '180deg' WHEN c THEN 'threshold' ELSE '' END AS stage, CASE WHEN a THEN 1 WHEN b THEN 2 ELSE 3 END AS stages_run FROM v""",
}
