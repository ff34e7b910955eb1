"""Observation-shaped views over the given tables, as SQL that both Spark and the oracle run."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from sightline.functions.plates import STATES

#: Rows of a table that one task sorts or groups at most, on the average.
PART_ROWS = 1 << 19

_K = "((l_orderkey * 7919) % 1000003)"
_PLATE = (
    f"substr('{''.join(STATES)}', CAST(1 + 2 * ({_K} % 37) AS INT), 2) || lpad(CAST({_K} % 100 AS STRING), 2, '0') || chr(CAST(65 + {_K} % 26 AS INT))"
    f" || CASE WHEN {_K} % 2 = 0 THEN chr(CAST(65 + {_K} % 23 AS INT)) ELSE '' END || lpad(CAST({_K} % 10000 AS STRING), 4, '0')"
)
_P = f"({_PLATE})"
OBSERVATIONS = f"""
SELECT CAST(l_orderkey AS BIGINT) AS track_id, CAST(l_linenumber * 7 AS BIGINT) AS frame,
       CAST(((l_orderkey * 100 + l_linenumber) * 1000000 + l_partkey) * 1000 + (l_suppkey * 37 + CAST(l_quantity AS BIGINT) * 13 + CAST(floor(l_extendedprice) AS BIGINT)) % 1000 AS BIGINT) AS ord, {_P} AS truth,
       CASE WHEN l_partkey % 11 = 0 THEN ''
            WHEN l_partkey % 4 = 1 THEN substr({_P}, 1 + CAST(l_partkey % 3 AS INT), 7)
            WHEN l_linenumber % 3 = 0 THEN translate({_P}, '0158', 'OISB')
            WHEN l_partkey % 7 = 0 THEN lower(substr({_P}, 1, 4)) || '-' || substr({_P}, 5)
            WHEN l_partkey % 5 = 0 THEN 'IND' || {_P}
            WHEN l_partkey % 13 = 0 THEN CAST(l_partkey % 100 AS STRING) || 'BH' || lpad(CAST(l_partkey % 10000 AS STRING), 4, '0') || 'AB'
            ELSE {_P} END AS raw_text,
       0.4 + l_discount * 6 AS confidence, l_tax * 10 AS quality, l_discount * 10 AS detection
FROM {{lineitem}}"""
MAPPING = """
SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS track_id, CAST(l_orderkey - l_orderkey % 4 AS BIGINT) AS cluster_id FROM {lineitem} WHERE l_orderkey % 5 <> 0"""
#: Crops of tracks; a digest is shared by the tracks of a small bucket.
CROPS = """
SELECT DISTINCT CAST(user_id AS BIGINT) AS track_id, CAST(floor(value) AS BIGINT) AS frame,
       md5(event_type || '|' || CAST(CAST(floor(user_id / 3.0) AS BIGINT) AS STRING)) AS digest FROM {events}"""
CANDIDATES = """
SELECT CAST(user_id AS BIGINT) AS track_id, CAST(event_id AS BIGINT) AS seq, CAST(floor(event_id / 400.0) AS BIGINT) AS frame, value AS score FROM {events}"""
COUNTS = """
SELECT CAST(d.doc_id AS BIGINT) AS id, d.source AS video, CAST(l.quality + l.toxic AS BIGINT) AS detections, CAST(l.quality + d.doc_id % 2 AS BIGINT) AS visible,
       CAST(CASE WHEN l.quality + l.toxic < l.quality + d.doc_id % 2 THEN l.quality + l.toxic ELSE l.quality + d.doc_id % 2 END AS BIGINT) AS correct
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id"""
READINGS = """
SELECT CAST(o_orderkey AS BIGINT) AS id, regexp_replace(upper(o_orderpriority), '^[0-9]-', '') AS truth,
       CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN 'X' || regexp_replace(upper(o_orderpriority), '^[0-9]-', '') || 'Y'
            WHEN o_orderkey % 3 = 0 THEN reverse(regexp_replace(upper(o_orderpriority), '^[0-9]-', '')) WHEN o_orderkey % 4 = 0 THEN replace(upper(o_orderpriority), 'I', '1')
            ELSE regexp_replace(upper(o_orderpriority), '^[0-9]-', '') END AS pred,
       substr(upper(o_orderpriority), 1, CAST(3 + o_orderkey % 5 AS INT)) AS other FROM {orders}"""
IMAGES = """
SELECT CAST(doc_id AS BIGINT) AS image_id, md5(lower(text)) AS source_id, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split,
       CAST(n_chars AS DOUBLE) AS quality FROM {documents}"""
BOXES = """
SELECT CAST(p_partkey AS BIGINT) AS id, 100.0 + p_size AS w_img, 80.0 + p_size AS h_img, CAST(p_partkey % 120 AS DOUBLE) - 10 AS x, CAST(p_partkey % 90 AS DOUBLE) - 8 AS y,
       CAST(p_partkey % 37 AS DOUBLE) AS w, CAST(p_partkey % 23 AS DOUBLE) AS h FROM {part}"""
REGIONS = """
SELECT CAST(conv_id AS BIGINT) AS image, CAST(turn * 17.5 AS DOUBLE) AS y, CAST(length(text) AS DOUBLE) AS x, text, 1.0 / (1 + turn) AS conf
FROM {conversations} WHERE text IS NOT NULL"""


def _names(sql: str) -> list[str]:
    return [n for _, n, _, _ in string.Formatter().parse(sql) if n]


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in set(_names(sql))})


def parts_of(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Partitions for the rows of a table: what a shuffle has, and more where one would hold over PART_ROWS rows."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").count()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


def plain(sql: str) -> str:
    """The view's SQL over the tables' own names."""
    return sql.format(**{n: n for n in _names(sql)})
