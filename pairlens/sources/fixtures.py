"""Derived input tables: the explained pipeline's data model built from the given tables.

``documents`` -> reviews (5 documents = one original + four edits), ``embeddings`` ->
stored text vectors, reviews -> machine-written counterfactuals. Whole document texts
are used everywhere (no prefixes). Every table is a lazy DataFrame; nothing is
collected. Row ids are arithmetic (no global row_number), so builds stay parallel.
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.constants import CONCEPTS, DEFAULT_SEED, DIRECTIONS
from pairlens.operators import hygiene
from pairlens.operators.ingest import split_halves
from pairlens.session import cut_lineage, ensure_checkpoint_dir
from pairlens.sources.sinks import write_table
from pairlens.sources.tables import GENERATION_SCHEMA, REVIEW_SCHEMA, read_splits, read_table

#: Folders of stand-in inputs by session, input folder and name.
_STORED: dict[tuple, str] = {}

_FOUR = (*DIRECTIONS, "")  # aspect value wheel incl. "no label"


def _wheel(values, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def reviews(documents: DataFrame) -> DataFrame:
    """Labelled reviews: id, original_id, is_original, edit_type, description, labels, split."""
    d = documents.select(F.col("doc_id").alias("id"), F.col("text").alias("description"))
    oid = F.floor(F.col("id") / 5).cast("bigint")
    pos = F.col("id") % 5
    d = d.withColumns({"oid": oid, "pos": pos})
    d = d.withColumn("edit_type", F.when(F.col("pos") == 0, F.lit(None).cast("string")).otherwise(
        _wheel(CONCEPTS, (F.col("oid") + F.when(F.col("pos") <= 2, 0).otherwise(1)) % 4)))
    aspects = {}
    for ci, c in enumerate(CONCEPTS):
        untouched = (F.col("pos") == 0) | (F.col("edit_type") != c)
        aspects[f"{c}_aspect_majority"] = F.when(untouched, _wheel(_FOUR, (F.col("oid") + ci) % 4)).otherwise(
            _wheel(DIRECTIONS, (F.col("oid") + ci + F.col("pos")) % 3))
    d = d.withColumns(aspects)
    d = d.withColumns({
        "original_id": F.col("oid"),
        "is_original": F.col("pos") == 0,
        "review_majority": F.when(F.col("id") % 11 == 10, F.lit("no majority")).otherwise(
            (F.lit(1) + F.col("id") % 5).cast("string")),
        "split": F.when(F.col("oid") % 5 == 0, "validation").when(F.col("oid") % 5 == 1, "test").otherwise(
            "train_exclusive"),
    })
    return d.select("id", "original_id", "is_original", "edit_type", "description", "review_majority",
                    *[f"{c}_aspect_majority" for c in CONCEPTS], "split")


def generations(revs: DataFrame) -> DataFrame:
    """Counterfactual generations: 4 concepts x 3 targets per original (target = base left out).

    Texts are taken whole from another review; failure, empty, unchanged, junk-suffix
    and wrong-prediction rows are planted so the hygiene funnel has work to do.
    """
    cells = F.explode(F.array(*[
        F.struct(F.lit(ci).alias("ci"), F.lit(c).alias("concept"), F.lit(ti).alias("ti"), F.lit(t).alias("target"))
        for ci, c in enumerate(CONCEPTS) for ti, t in enumerate(DIRECTIONS)]))
    r = revs.where("is_original").select(
        "id", "original_id", "split", F.col("description").alias("text"),
        *[F.col(f"{c}_aspect_majority").alias(f"m{ci}") for ci, c in enumerate(CONCEPTS)]).withColumn("cell", cells)
    r = r.select("*", "cell.*").drop("cell")
    r = r.withColumn("o_id", F.floor((F.col("original_id") + F.col("ci") * 7 + F.col("ti") * 3) / 2).cast("bigint"))
    other = revs.select(F.col("id").alias("o_id"), F.col("description").alias("other"))
    g = r.join(other, "o_id")
    base = F.when(F.col("ci") == 0, F.col("m0")).when(F.col("ci") == 1, F.col("m1")).when(
        F.col("ci") == 2, F.col("m2")).otherwise(F.col("m3"))
    g = g.withColumns({
        "g_id": F.col("id") * 12 + F.col("ci") * 3 + F.col("ti"),
        "failed": (F.col("id") * 12) % 23 == 0,
        "base_direction": base,
    })
    gid = F.col("g_id")
    g = g.withColumn("generation",
                     F.when(gid % 17 == 0, F.lit(None).cast("string"))
                     .when(gid % 19 == 0, F.lit(""))
                     .when(gid % 13 == 0, F.col("text"))
                     .when(gid % 11 == 0, F.concat(F.col("other"), F.lit(" reviewer")))
                     .when(gid % 29 == 0, F.concat(F.col("other"), F.lit(" but")))
                     .otherwise(F.concat(F.col("other"), F.lit("."))))
    preds = {}
    for cj, c in enumerate(CONCEPTS):
        seen = F.coalesce(F.nullif(F.col(f"m{cj}"), F.lit("")), F.lit("unknown"))
        preds[f"{c}_predictions_generation"] = (
            F.when(F.col("ci") == cj, F.when(gid % 7 == 0, F.col("base_direction")).otherwise(F.col("target")))
            .when((gid % 7 == 1) & (F.col("ci") == (cj + 3) % 4), F.lit("unknown"))
            .otherwise(seen))
    g = g.withColumns(preds)
    g = g.where(F.col("base_direction") != F.col("target"))
    return g.select("g_id", "original_id", "split", "text", "failed", F.col("concept").alias("intervention_aspect"),
                    "base_direction", F.col("target").alias("target_direction"),
                    F.col("ti").cast("int").alias("generation_index"), "generation",
                    *[f"{c}_predictions_generation" for c in CONCEPTS])


def full_set(revs: DataFrame, clean_gens: DataFrame, carried=()) -> DataFrame:
    """Sources (generation_index -1) UNION ALL clean generations of all splits; ``rid`` = 2*key + src.
    ``carried``: further columns of both."""
    src = revs.select(
        F.lit(0).alias("src"), F.col("id").alias("k"), "split", "original_id", F.col("description").alias("text"),
        F.lit(-1).alias("generation_index"), F.lit(None).cast("string").alias("intervention_aspect"),
        *[F.coalesce(F.nullif(F.col(f"{c}_aspect_majority"), F.lit("")), F.lit("unknown")).alias(f"{c}_predictions")
          for c in CONCEPTS], *carried)
    gen = clean_gens.select(
        F.lit(1).alias("src"), F.col("g_id").alias("k"), "split", "original_id", F.col("generation").alias("text"),
        "generation_index", "intervention_aspect",
        *[F.col(f"{c}_predictions_generation").alias(f"{c}_predictions") for c in CONCEPTS], *carried)
    u = src.unionByName(gen)
    return u.select((F.col("k") * 2 + F.col("src")).alias("rid"), "*")


#: Stand-in scoring models: each reads another stored vector of the same text.
MODELS = {"base": 0, "shift-7": 7, "shift-31": 31}


def text_vectors(text_ids: DataFrame, embeddings: DataFrame, model: str = "base") -> DataFrame:
    """(text_id, model, vec): the given tables hold no vectors of texts, so text k of a model takes vector
    (k + the model's shift) mod their number."""
    n = embeddings.select(F.count(F.lit(1))).scalar()
    keyed = text_ids.select("text_id", F.pmod(F.col("text_id") + MODELS[model], n).alias("vec_id"))
    return keyed.join(embeddings.select("vec_id", F.col("embedding").alias("vec")), "vec_id").select(
        "text_id", F.lit(model).alias("model"), "vec")


@dataclass
class Fixtures:
    """Lazy derived tables over one scale-factor directory."""

    spark: SparkSession
    sf_dir: str
    seed: int = DEFAULT_SEED
    _cache: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = read_table(self.spark, self.sf_dir, name)
        return self._cache[name]

    def _stored(self, name: str, build, partition_by=()) -> str:
        """Folder of a stand-in input, which would exist before any query: written once a session through the sinks."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORED:
            path = f"{ensure_checkpoint_dir(self.spark)}/inputs-{uuid.uuid4().hex}/{name}"
            write_table(build(), path, partition_by, compression="zstd")
            _STORED[key] = path
        return _STORED[key]

    def _memo(self, key, build):
        if key not in self._cache:
            self._cache[key] = build()
        return self._cache[key]

    @property
    def reviews(self) -> DataFrame:
        return self._memo("fx_reviews", lambda: read_splits(
            self.spark, self._stored("reviews", lambda: reviews(self.table("documents")), ("split",)), REVIEW_SCHEMA))

    @property
    def generations(self) -> DataFrame:
        return self._memo("fx_generations", lambda: read_splits(
            self.spark, self._stored("generations", lambda: generations(self.reviews), ("split",)), GENERATION_SCHEMA))

    @property
    def clean_generations(self) -> DataFrame:
        return self._memo("fx_clean", lambda: hygiene.dry_clean(self.generations))

    @property
    def accepted_generations(self) -> DataFrame:
        """Clean generations that also pass the treatment-consistency filter."""
        return self._memo("fx_accepted", lambda: self._accepted(self.generations))

    @staticmethod
    def _accepted(rows: DataFrame) -> DataFrame:
        return hygiene.keep_treatment_consistent(hygiene.decode_predictions(hygiene.dry_clean(rows), strict=False))

    @property
    def mining_set(self) -> DataFrame:
        """The full set with each text's hash and length in its place, reused by many self-joins:
        materialised once, narrow, with a reliable checkpoint. Texts are hashed where they are read, before
        generations are deduplicated, so that none is shuffled."""
        def build():
            def short(text: str) -> dict:
                return {"text_len": F.char_length(text), "text_hash": F.unhex(F.sha2(text, 256))}

            sources = self.reviews.withColumns(short("description")).withColumn("description", F.col("text_hash"))
            gens = hygiene.dry_clean(self.generations.withColumns(short("generation"))).withColumn("generation", F.col("text_hash"))
            return cut_lineage(full_set(sources, gens, ["text_len"]))
        return self._memo("fx_mining_set", build)

    def vectors(self, model: str = "base") -> DataFrame:
        """Stored vectors of every review and generation (their ids share one space)."""
        def build():
            # the ids alone: generations with their texts are written for those who read them
            ids = self.reviews.select(F.col("id").alias("text_id")).union(generations(self.reviews).select("g_id")).distinct()
            return text_vectors(ids, self.table("embeddings"), model)
        return self._memo(("fx_vectors", model), lambda: self.spark.read.parquet(self._stored(f"vectors-{model}", build)))

    @property
    def full_set(self) -> DataFrame:
        return self._memo("fx_full_set", lambda: full_set(self.reviews, self.clean_generations))

    @property
    def explained_reviews(self) -> DataFrame:
        """Reviews whose pairs are explained (P2: validation and test, ``split`` kept as a key)."""
        return self.reviews.where(F.col("split").isin("validation", "test"))

    @property
    def matching_set(self) -> DataFrame:
        """Candidates: the matching half of train_exclusive, ``{c}_label`` = aspect majority."""
        pool = self.reviews.where(F.col("split") == "train_exclusive").select(
            "id", "original_id", F.col("description").isNotNull().alias("has_text"),
            *[F.col(f"{c}_aspect_majority").alias(f"{c}_label") for c in CONCEPTS],
            *[F.coalesce(F.nullif(F.col(f"{c}_aspect_majority"), F.lit("")), F.lit("unknown")).alias(f"{c}_predictions")
              for c in CONCEPTS])
        return self._memo("fx_matching", lambda: split_halves(pool, self.seed).where("half = 'matching'").drop("half"))

    @property
    def expanded_matching_set(self) -> DataFrame:
        """U4: the matching half (generation_index -1) UNION ALL the accepted generations written from its reviews, with
        ``rid`` = 2 * key + src; a generation's labels are its predictions."""
        src = self.matching_set.select(F.lit(0).alias("src"), F.col("id").alias("k"), "original_id", F.lit(-1).alias("generation_index"), "has_text",
                                       *[f"{c}_{x}" for c in CONCEPTS for x in ("label", "predictions")])
        originals = self.reviews.where((F.col("split") == "train_exclusive") & F.col("is_original")).select("id", "original_id")
        kept = originals.join(self.matching_set.select("id"), "id", "left_semi").select("original_id")
        # whether there is a text is seen where it is read, so that no text is shuffled
        accepted = self._accepted(self.generations.withColumn("has_text", F.col("generation").isNotNull()))
        gen = accepted.join(kept, "original_id", "left_semi").select(
            F.lit(1).alias("src"), F.col("g_id").alias("k"), "original_id", "generation_index", "has_text",
            *[F.col(f"{c}_predictions_generation").alias(f"{c}_{x}") for c in CONCEPTS for x in ("label", "predictions")])
        return src.unionByName(gen).select((F.col("k") * 2 + F.col("src")).alias("rid"), "*")
