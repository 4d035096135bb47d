"""Sinks (S7-S16): partitioned table writes that a retried run repeats without leaving rows twice."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.operators.metrics import concept_pivot, score_by_concept, score_overall, score_pivot


def write_table(df: DataFrame, path: str, partition_by=(), fmt: str = "parquet", mode: str = "overwrite", compression: str | None = None) -> None:
    """One write, partitioned by the loop keys (e.g. ``split``).

    A partitioned overwrite replaces the partitions that ``df`` holds and leaves the others.
    """
    w = df.write.mode(mode).format(fmt)
    if compression:
        w = w.option("compression", compression)
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"')
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    w.save(path)


def write_matches(pairs_with_matches: DataFrame, path: str) -> None:
    """Factual, matched, counterfactual texts and the error, partitioned by explainer,
    concept and direction (the concept is part of the path, so concepts never overwrite, Q14)."""
    d = pairs_with_matches.withColumn("direction", F.concat_ws("_to_", "base_direction", "target_direction"))
    write_table(d, path, ("explainer", "concept", "direction"))


def write_scores(cells: DataFrame, path: str) -> None:
    """``path``/concepts: a row an explainer with the rounded directions and their average (rounded), partitioned by
    split and concept; ``path``/overall: the concepts' averages and their rounded mean, partitioned by split."""
    concepts = score_pivot(cells)
    write_table(concepts.withColumn("average", F.bround("average", 2)), f"{path}/concepts", ("split", "concept"))
    write_table(overall_table(cells), f"{path}/overall", ("split",))


def overall_table(cells: DataFrame) -> DataFrame:
    """A3, A4: (explainer, split, a column a concept, average)."""
    return concept_pivot(score_by_concept(cells)).join(score_overall(score_by_concept(cells)).select(
        "explainer", "split", F.col("score").alias("average")), ["explainer", "split"])


def metrics_long(row_df: DataFrame, id_cols=()) -> DataFrame:
    """One row of named metrics -> (metric, value) rows (unpivot)."""
    value_cols = [c for c in row_df.columns if c not in id_cols]
    return row_df.select(*id_cols, *[F.col(c).cast("double").alias(c) for c in value_cols]).unpivot(
        list(id_cols), value_cols, "metric", "value")


def write_config(spark: SparkSession, config: dict, path: str, run: str) -> None:
    """A run's configuration as JSON text, one row a run."""
    row = spark.createDataFrame([(run, json.dumps(config, sort_keys=True))], "run string, config string")
    write_table(row.coalesce(1), path, ("run",))


def append_metrics(df: DataFrame, path: str, run: str) -> None:
    """(name, value, ...) rows of one run, beside those of other runs; written again they replace themselves."""
    write_table(df.withColumn("run", F.lit(run)), path, ("run",))
