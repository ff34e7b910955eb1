"""Results of several runs of the pipeline stand side by side, and stages clean up after each other."""

import os

import corpus_pipeline
from sightline.plans.lineage import shared_dir

SF = "/root/testdata/sf0.001"


def left(spark):
    top = shared_dir(spark).removeprefix("file://")
    return {x for x in os.listdir(top) if os.listdir(os.path.join(top, x))}


def test_a_second_run_leaves_the_first_result(spark):
    before = left(spark)
    a = corpus_pipeline.run(spark, SF)
    first = sorted(map(tuple, a.collect()))
    after_one = left(spark)
    b = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, a.collect())) == first == sorted(map(tuple, b.collect()))
    # a run leaves what its result reads, ids and lengths
    assert len(after_one - before) == 1 and len(left(spark) - after_one) == 1


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = left(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert docs.count() == corpus_pipeline.run(spark, SF).count()
    # what the last two stages wrote may stay
    assert len(left(spark) - before) <= 4
