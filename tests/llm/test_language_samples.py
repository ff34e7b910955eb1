"""Corpora of one language and very skewed ones."""

from pyspark.sql import functions as F

from sightline.llm import language

DOC = "doc_id long, text string, lang string, source string"
EN, DE = "and the of that with this from have been which ", "und der die das nicht auch eine wird sind oder "


def test_one_language_is_identified(spark):
    docs = spark.createDataFrame([(i, EN * 3, "en", "s") for i in range(6)] + [(9, "1 2", "en", "s"), (10, None, "en", "s")], DOC)
    model = language.train(docs)
    assert model.languages == ("en",) and model.evidence("1 2") is None
    assert {r.doc_id for r in language.keep_identified(docs, model).collect()} == set(range(6))
    pages = language.pages(spark.createDataFrame([(1, None, EN), (2, None, "")], "page_id long, url string, html string"), model)
    assert {r.page_id: (r.language, r.accepted) for r in pages.collect()} == {1: ("en", True), 2: ("und", False)}


def test_a_rare_language_is_learnt(spark):
    many = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit(EN).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    docs = many.union(spark.createDataFrame([(-1, DE, "de", "t"), (1, DE, "de", "t")], DOC))
    assert language.train(docs).languages == ("de", "en")
    assert language.train(docs).evidence(DE)[0] == 0.0


def test_a_tie_is_not_an_empty_text(spark):
    model = language.fit([("de", EN), ("en", EN)])
    rows = spark.createDataFrame([(1, EN), (2, "")], "id long, text string")
    assert {r.id: r.ev for r in language.with_evidence(rows, model, "text").collect()} == {1: [0.0, 0.0], 2: None}
