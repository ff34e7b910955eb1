"""A corpus pipeline: each stage works on all that its predecessor kept."""

from __future__ import annotations

import functools
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import language, lines, packing, quality, simhash
from sightline.llm.common import cut, delete, release, scope, table


def _unread(docs: DataFrame, made: list[str]) -> list[str]:
    """The folders in made (each name is its own) that docs doesn't read."""
    read = {unquote(f).split("/")[-2] for f in docs.inputFiles()} if made else set()
    return [p for p in made if p.rstrip("/").rpartition("/")[2] not in read]


class Chain:
    """Stages that are called one by one, each on what its predecessor's rows were written to: files that a stage wrote for its
    own use are read by its result, and go when the next stage of the chain is called. run() has a list of its own."""

    def __init__(self) -> None:
        self.last, self.made = -1, []

    def stage(self, place: int, stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if place == self.last + 1:
                delete(spark, _unread(docs, self.made))
            self.last, self.made = place, []
            release(spark)
            with scope(self.made):
                return stage(spark, docs, sf_dir)

        return run_stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be identified go, and so do texts without letters (null and empty ones too). Repeated rows
    and equal ids are judged one by one; a tie goes to the first language in alphabetical order."""
    return language.keep_identified(docs, language.train(docs))


def check_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or are mostly boilerplate lines, go. The field is fitted to
    labelled documents of the corpus."""
    return quality.keep_good(docs, quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and near-repeated lines go, but for one of each group; n_chars follows the text. A null text stays null, a
    document without lines stays empty; a repeated row keeps none of the lines that its first copy keeps, and ids decide ties."""
    return lines.dedup(docs).withColumn("n_chars", _chars(docs)).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of the smallest id (nulls last, ties by text hash and row).
    Null and blank texts are alike; a repeated row goes."""
    return simhash.keep_one(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get a length bucket and a place in a batch, each row by itself. Null and blank texts have a length of 1 (the end
    mark); ties go by hash. Ids and places only, no texts."""
    return packing.pack(docs)


def _chars(docs: DataFrame):
    from pyspark.sql import functions as F

    return F.length("text").cast(docs.schema["n_chars"].dataType)


_CHAIN = Chain()
_ORDER = [
    ("language", identify_language),
    ("quality", check_quality),
    ("lines", dedup_lines),
    ("near_duplicates", dedup_documents),
    ("packing", pack_documents),
]
STAGES = [(name, _CHAIN.stage(place, stage)) for place, (name, stage) in enumerate(_ORDER)]

#: Trained models and connected components: tests hold each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Between stages the rows are written; then what the stage before has written goes. Only what
    the result itself reads stays (ids and lengths), until the folder in spark.checkpoint.dir is cleared. Results of several
    runs stand side by side."""
    docs, before = table(spark, sf_dir, "documents"), []
    for place, (_, stage) in enumerate(_ORDER):
        made: list[str] = []
        with scope(made):
            docs = stage(spark, docs, sf_dir)
            if place < len(_ORDER) - 1:
                docs = cut(docs)
        gone = _unread(docs, [*before, *made])
        delete(spark, gone)
        before = [p for p in made if p not in gone]
        release(spark)
    return docs
