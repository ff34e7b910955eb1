"""Comparisons of engines, stages and versions, and the checks that a job must pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import text as tx
from sightline.operators.evidence import is_first

#: Fixed order of the image variants in a choice between equals.
VARIANTS = ("upscaled", "clahe", "sharpened", "threshold")


def engines(a: DataFrame, b: DataFrame, names: tuple[str, str]) -> DataFrame:
    """a (id, truth, pred) and b (id, pred), readings of two engines of the same samples: edits, winner, and
    whether each is exact, contains the truth, or is blank. Samples that only one engine has are left out."""
    rows = a.select("id", "truth", F.col("pred").alias("a_pred")).join(b.select("id", F.col("pred").alias("b_pred")), "id")
    for x in "ab":
        pred = F.col(f"{x}_pred")
        rows = rows.withColumns({f"{x}_edits": F.levenshtein(pred, F.col("truth")), f"{x}_exact": pred == F.col("truth"), f"{x}_contains": tx.contains_truth(f"{x}_pred", "truth"), f"{x}_blank": pred == ""})
    return rows.withColumn("winner", tx.winner("a_edits", "b_edits", names))


def engine_totals(rows: DataFrame, names: tuple[str, str]) -> DataFrame:
    n = lambda c: F.count_if(c)
    sums = {f"{x}_{k}": n(F.col(f"{x}_{k}")) for x in "ab" for k in ("exact", "contains", "blank")}
    wins = {"a_wins": n(F.col("winner") == names[0]), "b_wins": n(F.col("winner") == names[1]), "ties": n(F.col("winner") == "Tie")}
    return rows.agg(F.count("*").alias("n"), *[v.alias(k) for k, v in {**wins, **sums}.items()])


def with_defaults(rows: DataFrame, other: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """All rows, with the columns of other that defaults names, by key; the default where other has no such key."""
    got = rows.join(other.select(key, *defaults), key, "left")
    return got.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def strict_join(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """rows with the columns of other; the job fails at a row whose key other doesn't have. One pass: the
    check is a part of the join's projection."""
    got = rows.join(other.withColumn("_there", F.lit(True)), key, "left")
    checked = F.when(F.col("_there"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"no {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return got.withColumn(key, checked).drop("_there")


def against_truth(truth: DataFrame, ranked: DataFrame, chosen: DataFrame, key: str = "track_id") -> DataFrame:
    """truth (key, truth) with the reading of the first rank, from ranked (key, rank, pred), and the consensus, from
    chosen (key, pred); '' where there is none."""
    first = ranked.join(truth.select(key), key, "left_semi").groupBy(key).agg(F.min_by("pred", "rank").alias("rank1"))
    rows = truth.join(first, key, "left").join(chosen.select(key, F.col("pred").alias("consensus")), key, "left").fillna("", ["rank1", "consensus"])
    return rows.withColumn("rank1_ok", F.col("rank1") == F.col("truth")).withColumn("consensus_ok", F.col("consensus") == F.col("truth"))


def deltas(before: DataFrame, after: DataFrame, key: str = "metric") -> DataFrame:
    """before and after (key, value) of the metrics that both have, and after - before."""
    rows = before.select(key, F.col("value").alias("before")).join(after.select(key, F.col("value").alias("after")), key)
    return rows.withColumn("delta", F.round(F.col("after") - F.col("before"), 9))


@dataclass(frozen=True)
class AblationStage:
    """A stage of a study: reading is its text, latency its milliseconds for a row (null where it was not measured)."""

    name: str
    method: str
    reading: Column
    decision: str
    reason: str = ""
    latency: Column | None = None


def ablation(rows: DataFrame, stages: list[AblationStage], baseline: str, truth: str = "truth") -> DataFrame:
    """A row for each stage: what it is, accuracy, character error rate, blank share and mean latency; the gain in percentage
    points over the baseline stage (the kept engine's raw readings, say, rather than another engine's) and over the stage
    before. One pass over rows."""
    names = [x.name for x in stages]
    base = names.index(baseline)
    t = F.col(truth)
    sums = [F.count("*").alias("n"), F.sum(F.length(t)).alias("chars")]
    for i, x in enumerate(stages):
        took = F.lit(None).cast("double") if x.latency is None else x.latency
        sums += [F.count_if(x.reading == t).alias(f"exact{i}"), F.sum(F.levenshtein(x.reading, t)).alias(f"edits{i}"), F.count_if(x.reading == "").alias(f"blank{i}"), F.avg(took).alias(f"ms{i}")]
    one = rows.agg(*sums)
    accuracy = lambda i: F.try_divide(F.col(f"exact{i}"), F.col("n"))
    cer = lambda i: F.try_divide(F.col(f"edits{i}"), F.col("chars"))
    table = []
    for i, x in enumerate(stages):
        table.append(F.struct(
            F.lit(i).alias("place"), F.lit(x.name).alias("stage"), F.lit(x.method).alias("method"), F.lit(x.decision).alias("decision"), F.lit(x.reason).alias("reason"), F.col("n"), F.col(f"exact{i}").alias("exact"),
            F.round(accuracy(i), 9).alias("accuracy"), F.round(cer(i), 9).alias("cer"), F.round(F.try_divide(F.col(f"blank{i}"), F.col("n")), 9).alias("blank_rate"), F.round(f"ms{i}", 6).alias("latency_ms"),
            F.round(100 * (accuracy(i) - accuracy(base)), 6).alias("gain_pp"), F.round(100 * (cer(base) - cer(i)), 6).alias("cer_reduction_pp"), F.round(100 * (accuracy(i) - accuracy(max(i - 1, 0))), 6).alias("step_pp"),
        ))
    return one.select(F.inline(F.array(*table)))


def stage_row(table: DataFrame, stage: str) -> DataFrame:
    """The row of a stage; it is an error if there is not exactly one."""
    found = table.filter(F.col("stage") == stage)
    if found.limit(2).count() != 1:
        raise ValueError(f"there must be one stage {stage}")
    return found


def cascade(attempts: DataFrame, key: str) -> DataFrame:
    """attempts (key, stage, plate, cost, removed, confidence, tie): the best valid one of the first stage that has
    any, and the number of stages that were needed; plate '' where none is valid. In a stage: lower cost, fewer characters
    removed, higher confidence, lower tie (angle, or place of the variant). A single aggregate: no sort, no join."""
    valid = F.col("plate") != ""
    order = F.struct("stage", "cost", "removed", (-F.col("confidence")).alias("c"), "tie")
    best = F.min_by(F.when(valid, F.struct("plate", "stage", "cost", "tie")), F.when(valid, order))
    rows = attempts.groupBy(key).agg(best.alias("b"), F.max("stage").alias("last"))
    return rows.select(key, F.coalesce("b.plate", F.lit("")).alias("plate"), F.coalesce("b.stage", "last").alias("stage"), "b.cost", "b.tie")


def variant_place(name: Column | str) -> Column:
    """0 for the first of the variants, and so on; after all of them for any other name."""
    at = F.array_position(F.array(*map(F.lit, VARIANTS)), F.col(name) if isinstance(name, str) else name)
    return F.when(at > 0, at - 1).otherwise(len(VARIANTS)).cast("int")


def observations_of(frames: DataFrame, retries: DataFrame, mapping: DataFrame) -> DataFrame:
    """Readings of both sources, with where each is from: frames (track_id, frame, raw) as raw_0deg and retries
    (track_id, frame, variant, raw) as preprocess_<variant>. Blank readings are left out; duplicates stay."""
    one = frames.select("track_id", "frame", F.lit("raw_0deg").alias("source"), tx.clean_text("raw").alias("text"))
    two = retries.select("track_id", "frame", F.concat(F.lit("preprocess_"), F.col("variant")).alias("source"), tx.clean_text("raw").alias("text"))
    rows = one.unionByName(two).filter("text <> ''")
    return rows.join(mapping, "track_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", "track_id"))


def retried_observations(rows: DataFrame, mapping: DataFrame, n: int) -> DataFrame:
    """observations_of() where each reading has its retry beside it: rows (track_id, frame, raw, variant, retry), dealt by cluster
    over n partitions. A reading becomes two rows where they are, so that it is read, joined and shuffled once."""
    placed = rows.join(mapping, "track_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", "track_id")).repartition(n, "cluster_id")
    both = F.array(F.struct(F.lit("raw_0deg").alias("source"), F.col("raw").alias("raw")), F.struct(F.concat(F.lit("preprocess_"), F.col("variant")).alias("source"), F.col("retry").alias("raw")))
    each = placed.select("track_id", "frame", "cluster_id", F.explode(both).alias("x"))
    return each.select("track_id", "frame", "x.source", tx.clean_text("x.raw").alias("text"), "cluster_id").filter("text <> ''")


def source_counts(rows: DataFrame) -> DataFrame:
    """Readings, distinct texts, and distinct frames of tracks for each cluster and source: rows (cluster_id, source, text, track_id,
    frame). Where rows are dealt by cluster nothing is shuffled."""
    marked = rows.withColumn("_x", is_first("cluster_id", "source", "text")).withColumn("_f", is_first("cluster_id", "source", "track_id", "frame"))
    full = F.col("_f") & F.col("track_id").isNotNull() & F.col("frame").isNotNull()
    return marked.groupBy("cluster_id", "source").agg(F.count("*").alias("n"), F.count(F.when(F.col("_x"), F.col("text"))).alias("texts"), F.count(F.when(full, 1)).alias("frames"))


def gate(rows: DataFrame, what: str) -> None:
    """Fails if there is any row; at most five of them are shown."""
    some = rows.limit(5).collect()
    if some:
        raise ValueError(f"{what}: {', '.join(map(str, some))}")


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The keys of both."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def missing_keys(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The rows whose key other doesn't have."""
    return rows.join(other.select(key), key, "left_anti")
