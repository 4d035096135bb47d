"""Score tables (A1-A5, A9, X10, F20 as a key, P2 split as a key).

Engine columns keep full precision. The report view reproduces the explained
pipeline's rounding: each cell rounded half-even to 2, the per-concept ``average``
is the macro mean of the rounded cells (null cells skipped), the overall score is
the mean of concept averages rounded to 2.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.constants import CONCEPTS, DIRECTIONS

CELL_KEYS = ["explainer", "split", "concept", "base_direction", "target_direction"]
DIRECTION_PAIRS = [(b, t) for b in DIRECTIONS for t in DIRECTIONS if b != t]


def direction_label(b: str, t: str) -> str:
    return f"{b}_to_{t}"


def score_cells(errors: DataFrame) -> DataFrame:
    """A1 + A5: per cell the pair count, the count with an error, and the mean error (nulls skipped)."""
    return errors.groupBy(*CELL_KEYS).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_pairs"),
        F.count("icace_error").cast("bigint").alias("n_valid"),
        F.avg("icace_error").alias("icace_error"))


def score_by_concept(cells: DataFrame) -> DataFrame:
    """A2: macro mean over the six rounded direction cells of each concept."""
    return cells.groupBy("explainer", "split", "concept").agg(
        F.avg(F.bround("icace_error", 2)).alias("average"),
        F.count("icace_error").cast("bigint").alias("n_cells"))


def score_overall(by_concept: DataFrame) -> DataFrame:
    """A3: mean over concepts of the concept averages, rounded half-even to 2."""
    return by_concept.groupBy("explainer", "split").agg(
        F.bround(F.avg("average"), 2).alias("score"),
        F.count("average").cast("bigint").alias("n_concepts"))


def score_pivot(cells: DataFrame) -> DataFrame:
    """A4: explainer x direction table per concept (fixed pivot values: no extra pass)."""
    d = cells.withColumn("direction", F.concat_ws("_to_", "base_direction", "target_direction"))
    labels = [direction_label(b, t) for b, t in DIRECTION_PAIRS]
    p = (d.groupBy("explainer", "split", "concept").pivot("direction", labels)
         .agg(F.first(F.bround("icace_error", 2))))
    avg = None
    n = None
    for lab in labels:
        v = F.col(f"`{lab}`")
        avg = F.coalesce(v, F.lit(0.0)) if avg is None else avg + F.coalesce(v, F.lit(0.0))
        n = v.isNotNull().cast("int") if n is None else n + v.isNotNull().cast("int")
    return p.withColumn("average", F.when(n > 0, avg / n))


def concept_pivot(by_concept: DataFrame) -> DataFrame:
    """A4: explainer x concept table of the concept averages (fixed pivot values)."""
    return by_concept.groupBy("explainer", "split").pivot("concept", list(CONCEPTS)).agg(F.first("average"))


def coverage(errors: DataFrame) -> DataFrame:
    """A5: valid vs optional pairs per explainer and the percentage (Q17: non-null errors)."""
    g = errors.groupBy("explainer", "split").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_optional"),
        F.count("icace_error").cast("bigint").alias("n_valid"))
    return g.withColumn("pct_valid", F.when(F.col("n_optional") > 0, 100.0 * F.col("n_valid") / F.col("n_optional")))


def accuracy(df: DataFrame, pred_col: str, label_col: str, by=("split",)) -> DataFrame:
    """A10: share of rows whose predicted class equals the label."""
    return df.groupBy(*by).agg(F.avg((F.col(pred_col) == F.col(label_col)).cast("double")).alias("accuracy"),
                               F.count(F.lit(1)).cast("bigint").alias("n"))
