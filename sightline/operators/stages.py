"""Model stages that run on what no stage before has solved."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.plans.lineage import cut

Model = Callable[[pd.DataFrame], pd.DataFrame]


@dataclass(frozen=True)
class Stage:
    """factory() makes the model, once for each task; it gets at most `batch` rows at a time, and gives a row of results for each
    of them, in order. profile: what the stage's executors must have (a GPU, say); None: what the session has."""

    name: str
    factory: Callable[[], Model]
    batch: int = 32
    profile: ResourceProfile | None = None


def _run(batches: Iterator[pd.DataFrame], key: str, stage: Stage) -> Iterator[pd.DataFrame]:
    """The key and results of each batch as one frame: the model's batches are small, and each frame costs Spark the same."""
    model = None
    for b in batches:
        outs = []
        for lo in range(0, len(b), stage.batch):
            part = b.iloc[lo : lo + stage.batch].reset_index(drop=True)
            model = model or stage.factory()
            out = model(part)
            if len(out) != len(part):
                raise ValueError(f"stage {stage.name}: {len(part)} rows in, {len(out)} out")
            outs.append(out)
        if outs:
            yield pd.concat([b[[key]].reset_index(drop=True), pd.concat(outs, ignore_index=True)], axis=1)


def _applied(rows: DataFrame, key: str, stage: Stage, results: str) -> DataFrame:
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, {results}"
    run = lambda batches: _run(batches, key, stage)
    return rows.mapInPandas(run, schema, profile=stage.profile) if stage.profile else rows.mapInPandas(run, schema)


def staged(rows: DataFrame, key: str, stages: list[Stage], results: str, solved: Column) -> DataFrame:
    """key, the results (a schema of columns), stage (the one that solved the row, '' if none did) and stages_run.

    Every stage gets the rows for which `solved` (over the results; null counts as no) has held in no stage before, and no
    other. A row that stays unsolved has the results of the last stage. Results are written after each stage, so a lost
    executor costs tasks of one stage; the rows themselves are never copied. key must be unique and not null.
    """
    todo, done = rows, []
    for at, stage in enumerate(stages, 1):
        ok = F.coalesce(solved, F.lit(False))
        out = cut(_applied(todo, key, stage, results).withColumn("_ok", ok))
        last = at == len(stages)
        done.append((out if last else out.filter("_ok")).withColumn("stage", F.when(F.col("_ok"), stage.name).otherwise("")).withColumn("stages_run", F.lit(at)).drop("_ok"))
        if not last:
            todo = todo.join(out.filter("not _ok").select(key), key, "left_semi")
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole
