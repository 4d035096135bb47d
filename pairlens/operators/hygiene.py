"""Generation hygiene funnel."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.constants import CONCEPTS, FAULT_ENDINGS, FAULT_WORDS
from pairlens.functions.labels import concept_value, decode_aspect_prediction

DEDUP_KEYS = ("generation", "base_direction", "target_direction")


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def ok_successful() -> Column:
    """F1 predicate: not failed, generation present and non-empty."""
    return (~F.coalesce(F.col("failed"), F.lit(False))) & F.col("generation").isNotNull() & (F.col("generation") != "")


def ok_changed() -> Column:
    """F2 predicate (null-safe: a null comparison keeps the row, Q1)."""
    return ~F.coalesce(F.col("generation") == F.col("text"), F.lit(False))


def _lowered() -> Column:
    # a null generation is rendered as 'nan' by the explained pipeline and survives (Q12)
    return F.coalesce(F.lower(F.col("generation")), F.lit("nan"))


def _no_fault(tests: list) -> Column:
    return ~F.exists(F.array(_lowered()), lambda low: _any([test(low) for test in tests]))  # lowered once


_WORDS = [lambda low, w=w: low.contains(w) for w in FAULT_WORDS]
_ENDINGS = [lambda low, w=w: low.endswith(w) for w in FAULT_ENDINGS]


def ok_fault_words() -> Column:
    """F3 predicate: no fault word as a lower-cased substring."""
    return _no_fault(_WORDS)


def ok_fault_endings() -> Column:
    """F4 predicate: no fault suffix (untrimmed)."""
    return _no_fault(_ENDINGS)


def drop_unsuccessful(df: DataFrame) -> DataFrame:
    return df.where(ok_successful())


def drop_no_change(df: DataFrame) -> DataFrame:
    return df.where(ok_changed())


def drop_fault_words(df: DataFrame) -> DataFrame:
    return df.where(ok_fault_words())


def drop_fault_endings(df: DataFrame) -> DataFrame:
    return df.where(ok_fault_endings())


def drop_faults(df: DataFrame) -> DataFrame:
    """F3 and F4 at once."""
    return df.where(_no_fault(_ENDINGS + _WORDS))


def hashed_keys(keys=DEDUP_KEYS) -> list[Column]:
    """The keys with the text as its hash, so that no whole text is shuffled; a null stays null."""
    return [F.sha2(k, 256).alias(f"{k}_hash") if k == "generation" else F.col(k) for k in keys]


def first_per_key(df: DataFrame, keys=DEDUP_KEYS, order_col: str = "g_id") -> DataFrame:
    """Keep the first row (by ``order_col``) of each key group; null keys form a group.

    A min-aggregate (map-side partial) plus a semi-join on the unique row id: a hot
    key never lands whole in one task, unlike a row_number window.
    """
    firsts = df.groupBy(*hashed_keys(keys)).agg(F.min(order_col).alias(order_col)).select(order_col)
    return df.join(firsts, order_col, "left_semi")


def decode_predictions(df: DataFrame, fmt: str = "{}_predictions_generation", strict: bool = True) -> DataFrame:
    """decode every concept's prediction column to a label."""
    return df.withColumns({fmt.format(c): decode_aspect_prediction(F.col(fmt.format(c)), strict) for c in CONCEPTS})


def treatment_consistent(fmt: str = "{}_predictions_generation") -> Column:
    """F6 predicate: the predicted label of the intervened concept equals the target direction."""
    return F.col("target_direction") == concept_value(F.col("intervention_aspect"), fmt)


def keep_treatment_consistent(df: DataFrame, fmt: str = "{}_predictions_generation") -> DataFrame:
    return df.where(treatment_consistent(fmt))


def dry_clean(df: DataFrame, order_col: str = "g_id") -> DataFrame:
    """F1 -> F2 -> W1 -> F3 -> F4, in the explained pipeline's order."""
    df = drop_no_change(drop_unsuccessful(df))
    df = first_per_key(df, order_col=order_col)
    return drop_faults(df)


def funnel_counts(df: DataFrame, by: list[str], order_col: str = "g_id") -> DataFrame:
    """Rows left after each stage (F1-F4, W1, F6) and floor-percent dropped by cleaning, in one pass per group.

    W1 is evaluated on the survivors of F1+F2 (as in the sequential funnel).
    """
    staged = df.withColumn("_s2", ok_successful() & ok_changed())
    firsts = (staged.where("_s2").groupBy(*hashed_keys()).agg(F.min(order_col).alias("_first"))
              .select(F.col("_first").alias(order_col), F.lit(True).alias("_is_first")))
    staged = staged.join(firsts, order_col, "left")
    s1 = ok_successful()
    s2 = F.col("_s2")
    s3 = s2 & F.coalesce(F.col("_is_first"), F.lit(False))
    s4 = s3 & ok_fault_words()
    s5 = s4 & ok_fault_endings()
    n0 = F.count(F.lit(1))
    out = staged.groupBy(*by).agg(
        n0.cast("bigint").alias("n_input"),
        F.count_if(s1).cast("bigint").alias("n_after_unsuccessful"),
        F.count_if(s2).cast("bigint").alias("n_after_no_change"),
        F.count_if(s3).cast("bigint").alias("n_after_dedup"),
        F.count_if(s4).cast("bigint").alias("n_after_fault_words"),
        F.count_if(s5).cast("bigint").alias("n_clean"),
        F.count_if(s5 & F.coalesce(treatment_consistent(), F.lit(False))).cast("bigint").alias("n_accepted"),
    )
    return out.withColumn(
        "pct_dropped",
        F.when(F.col("n_input") > 0,
               F.floor(F.lit(100) * (F.col("n_input") - F.col("n_clean")) / F.col("n_input"))).cast("bigint"))
