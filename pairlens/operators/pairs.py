"""Intervention pair mining.

Per original review: (edit, original), (original, edit) and (edit, edit of the same
type) pairs. Instead of a loop over originals, two equi-joins:

* edits JOIN originals ON original_id - linear (one original per id); both
  orientations come from the same joined row via an explode, so no second join.
* edits JOIN edits ON (original_id, edit_type), id <> id - the edit-edit relation.

A hot original_id is a skewed key on the edits side only; AQE's skew-join split
handles it without replicating the big side.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.constants import CONCEPTS
from pairlens.functions.labels import concept_value

PAIR_COLS = ("id", "original_id", "is_original", "edit_type", "description", "review_majority",
             *[f"{c}_aspect_majority" for c in CONCEPTS])
#: What mining itself needs: ids and labels. Texts join where a report shows them.
LABEL_COLS = tuple(c for c in PAIR_COLS if c != "description")


def _side(df: DataFrame, cols, suffix: str):
    return [F.col(f"{c}").alias(f"{c}{suffix}") for c in cols]


def mine_pairs(reviews: DataFrame, keep_cols=PAIR_COLS, carry=("split",), drop_unchanged: bool = True) -> DataFrame:
    """All intervention pairs; F14 annotations; F13 drops pairs whose label did not change."""
    cols = [c for c in keep_cols if c in reviews.columns]
    carry = [c for c in carry if c in reviews.columns]
    base_cols = list(dict.fromkeys([*cols, *carry]))
    r = reviews.select(*base_cols)
    edits = r.where(~F.col("is_original"))
    origs = r.where(F.col("is_original"))

    e = edits.select(F.col("original_id").alias("_oid"), F.struct(*cols).alias("e"), *carry)
    o = origs.select(F.col("original_id").alias("_oid"), F.struct(*cols).alias("o"))
    eo = e.join(o, "_oid")
    both = eo.select(*carry, F.explode(F.array(
        F.struct(F.col("e").alias("b"), F.col("o").alias("k"), F.lit("edit_original").alias("kind")),
        F.struct(F.col("o").alias("b"), F.col("e").alias("k"), F.lit("original_edit").alias("kind")),
    )).alias("p")).select(*carry, "p.b", "p.k", "p.kind")

    eb = edits.select(F.col("original_id").alias("_oid"), F.col("edit_type").alias("_et"), F.struct(*cols).alias("b"), *carry)
    ek = edits.select(F.col("original_id").alias("_oid"), F.col("edit_type").alias("_et"), F.struct(*cols).alias("k"))
    ee = (eb.join(ek, ["_oid", "_et"]).where(F.col("b.id") != F.col("k.id"))
          .select(*carry, "b", "k", F.lit("edit_edit").alias("kind")))

    pairs = both.unionByName(ee)
    flat = pairs.select(*carry, "kind",
                        *[F.col(f"b.{c}").alias(f"{c}_base") for c in cols],
                        *[F.col(f"k.{c}").alias(f"{c}_counterfactual") for c in cols])
    flat = annotate_intervention(flat)
    if drop_unchanged:
        flat = drop_unsuccessful_edits(flat)
    return flat


def annotate_intervention(pairs: DataFrame) -> DataFrame:
    """intervention type = greater edit type (nulls skipped); its label on both sides."""
    it = F.greatest(F.col("edit_type_base"), F.col("edit_type_counterfactual"))
    pairs = pairs.withColumn("intervention_type", it)
    return pairs.withColumns({
        "intervention_aspect_base": concept_value(F.col("intervention_type"), "{}_aspect_majority_base"),
        "intervention_aspect_counterfactual": concept_value(F.col("intervention_type"), "{}_aspect_majority_counterfactual"),
    })


def drop_unsuccessful_edits(pairs: DataFrame) -> DataFrame:
    """drop pairs whose intervened label is equal on both sides (null comparisons keep the pair)."""
    same = F.col("intervention_aspect_base") == F.col("intervention_aspect_counterfactual")
    return pairs.where(~F.coalesce(same, F.lit(False)))


def pair_drop_counts(pairs: DataFrame) -> DataFrame:
    """Per split and kind the mined pairs (before F13), those that F13 drops, and the floor-percent."""
    same = F.count_if(F.col("intervention_aspect_base") == F.col("intervention_aspect_counterfactual"))
    n = F.count(F.lit(1))
    return pairs.groupBy("split", "kind").agg(n.cast("bigint").alias("n_pairs"), same.cast("bigint").alias("n_unchanged"),
                                              F.floor(100 * same / n).cast("bigint").alias("pct_dropped"))


def with_pair_id(pairs: DataFrame) -> DataFrame:
    """Stable pair key from the two review ids."""
    return pairs.withColumn("pair_id", F.concat_ws(":", F.col("id_base").cast("string"),
                                                   F.col("id_counterfactual").cast("string")))


def original_diagnostics(reviews: DataFrame, by=("split",)) -> DataFrame:
    """Per group, originals with >1 row, with no original row, with 2+ original rows."""
    g = reviews.groupBy(*by, "original_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("is_original")).alias("n_orig"))
    return g.groupBy(*by).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_originals"),
        F.count_if(F.col("n_rows") > 1).cast("bigint").alias("n_with_pairs"),
        F.count_if(F.col("n_orig") == 0).cast("bigint").alias("n_without_original"),
        F.count_if(F.col("n_orig") > 1).cast("bigint").alias("n_multi_original"),
        F.sum("n_rows").cast("bigint").alias("n_rows"))
