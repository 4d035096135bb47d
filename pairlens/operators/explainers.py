"""Explainers (E1-E5) and their per-pair ICaCE errors.

Every explainer answers, for each explained pair (base text, concept, base label ->
target label), "what does the model predict for a substitute text?" and scores the
error ||mean(substitute prediction) - counterfactual prediction||_2, which equals
||explanation - icace|| because the base prediction cancels.

All explainers share one context (``ExplainContext``) holding the explained pairs
with their counterfactual predictions, the candidate (matching) set, generations and
the scorer; each returns rows (explainer, split, pair_id, concept, base_direction,
target_direction, icace_error), null where it found no substitute.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.constants import CONCEPTS, DEFAULT_SEED, DIRECTIONS, run_label
from pairlens.functions.labels import unpivot_concepts
from pairlens.functions.seeded import md5_int
from pairlens.functions.vectors import l2_distance, subtract
from pairlens.operators.pairs import with_pair_id
from pairlens.operators.sampling import seeded_positions
from pairlens.operators.scoring import PROBS, VECTOR, attach_vectors, get_scorer, score_keys
from pairlens.operators.topk import cosine_topk
from pairlens.session import cut_lineage

CELL = ["concept", "base_direction", "target_direction"]
ERR_COLS = ["explainer", "split", "pair_id", *CELL, "icace_error"]


def cell_pairs(pairs: DataFrame) -> DataFrame:
    """F20 as a key: pairs inside the 4 x 6 (concept, base -> target) cells."""
    p = with_pair_id(pairs).select(
        "split", "pair_id", "id_base", "id_counterfactual", "original_id_base",
        F.col("intervention_type").alias("concept"),
        F.col("intervention_aspect_base").alias("base_direction"),
        F.col("intervention_aspect_counterfactual").alias("target_direction"),
        *[F.coalesce(F.nullif(F.col(f"{c}_aspect_majority_base"), F.lit("")), F.lit("unknown")).alias(f"{c}_pred_base")
          for c in CONCEPTS])
    return p.where(F.col("concept").isin(*CONCEPTS) & F.col("base_direction").isin(*DIRECTIONS)
                   & F.col("target_direction").isin(*DIRECTIONS))


def mean_probs(n: int, col: str = PROBS) -> Column:
    return F.array(*[F.avg(F.element_at(F.col(col), i + 1)) for i in range(n)])


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _others(c: str) -> list[str]:
    return [x for x in CONCEPTS if x != c]


@dataclass
class ExplainContext:
    pairs: DataFrame            # mined pairs of the explained splits
    matching_set: DataFrame     # id, has_text, {c}_label, {c}_predictions
    generations: DataFrame | Callable[[], DataFrame]  # accepted generations (g_id, original_id, intervention_aspect, target_direction, ...), or what gives them
    embeddings: DataFrame       # text_id, vec (one model's)
    scorer: str = "linear_head"
    base_predictions: DataFrame | None = None  # id, {c}_prediction: aspect labels a model gives the bases; else their gold labels
    seed: int = DEFAULT_SEED
    materialize: bool = True
    _memo: dict = field(default_factory=dict)

    @property
    def n_labels(self) -> int:
        return get_scorer(self.scorer).n_labels

    def other_model(self, embeddings: DataFrame, scorer: str) -> ExplainContext:
        """The same pairs and candidates, explained for another model; what does not depend on it is written once."""
        kept = {"mined": self.mined, "matching": self.matching, "n_cands": self.n_candidates}
        if embeddings is self.embeddings:
            kept |= {"vectors": self.vectors, "cands": self.candidates}
        return replace(self, embeddings=embeddings, scorer=scorer, _memo=kept)

    @property
    def mined(self) -> DataFrame:
        """Cell pairs (ids and labels), the same for every model."""
        if "mined" not in self._memo:
            p = cell_pairs(self.pairs)
            self._memo["mined"] = cut_lineage(p) if self.materialize else p
        return self._memo["mined"]

    @property
    def vectors(self) -> DataFrame:
        """Vectors of the pairs' texts and the candidates: the table of all texts' vectors is shuffled once, to find these."""
        if "vectors" not in self._memo:
            ids = (self.mined.select(F.explode(F.array("id_base", "id_counterfactual")).alias("text_id"))
                   .union(self.matching.select("id")).distinct())
            v = self.embeddings.select("text_id", VECTOR).join(ids, "text_id", "left_semi")
            self._memo["vectors"] = cut_lineage(v) if self.materialize else v
        return self._memo["vectors"]

    @property
    def cells(self) -> DataFrame:
        """Cell pairs with the counterfactual prediction attached (distinct texts scored once)."""
        if "cells" not in self._memo:
            p = self.mined
            vectors = self._memo.get("vectors", self.embeddings)
            cf = score_keys(p.select(F.col("id_counterfactual").alias("k")), vectors, "k", self.scorer)
            cells = p.join(cf.withColumnRenamed("k", "id_counterfactual")
                           .withColumnRenamed(PROBS, "cf_probs"), "id_counterfactual", "left")
            # compact (ids, labels, probabilities - no texts) and read by every explainer
            # branch: materialise once instead of re-scanning the review table per branch
            self._memo["cells"] = cut_lineage(cells) if self.materialize else cells
        return self._memo["cells"]

    @property
    def matching(self) -> DataFrame:
        """The candidate set: ids and labels, read by every branch, so written once."""
        if "matching" not in self._memo:
            self._memo["matching"] = cut_lineage(self.matching_set) if self.materialize else self.matching_set
        return self._memo["matching"]

    @property
    def candidates(self) -> DataFrame:
        """(cid, concept, label, o1..o3 other predictions, vec) - one row per concept."""
        if "cands" not in self._memo:
            m = self.matching.where("has_text")
            m = attach_vectors(m, self.vectors, "id")
            m = cut_lineage(m) if self.materialize else m  # the search counts, samples and tiles them
            parts = ", ".join(
                f"'{c}', `{c}_label`, " + ", ".join(f"`{o}_predictions`" for o in _others(c)) for c in CONCEPTS)
            self._memo["cands"] = m.selectExpr(
                "id as cid", VECTOR, f"stack({len(CONCEPTS)}, {parts}) as (concept, label, o1, o2, o3)")
        return self._memo["cands"]

    @property
    def n_candidates(self) -> int:
        """Rows of the candidate set: no block of the similarity search has more."""
        if "n_cands" not in self._memo:
            self._memo["n_cands"] = self.matching.count()
        return self._memo["n_cands"]

    def candidate_probs(self) -> DataFrame:
        if "cand_probs" not in self._memo:
            self._memo["cand_probs"] = score_keys(self.matching.select(F.col("id").alias("cid")),
                                                  self.vectors, "cid", self.scorer)
        return self._memo["cand_probs"]

    def base_others(self) -> DataFrame:
        """Cell pairs with the base's predictions of the three non-treated concepts as o1..o3."""
        cells = self.cells
        if self.base_predictions is not None:
            own = self.base_predictions.select(F.col("id").alias("id_base"), *[F.col(f"{c}_prediction").alias(f"{c}_pred_base") for c in CONCEPTS])
            cells = cells.drop(*[f"{c}_pred_base" for c in CONCEPTS]).join(own, "id_base", "left")
        cases = {f"o{i + 1}": F.coalesce(*[F.when(F.col("concept") == c, F.col(f"{_others(c)[i]}_pred_base"))
                                          for c in CONCEPTS]) for i in range(3)}
        return cells.withColumns(cases)


def _finish(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.lit(name).alias("explainer"), "split", "pair_id", *CELL, "icace_error")


@dataclass
class MatchingExplainer:
    """Label-blocked cosine top-k (J6/W2), threshold (F21), approach 1 (A6) or 2."""

    top_k: int = 1
    threshold: float = 0.0
    approach: int = 1
    description: str | None = None

    @property
    def name(self) -> str:
        return self.description or run_label("matching", approach=self.approach, k=self.top_k, over=self.threshold)

    def matches(self, ctx: ExplainContext, k: int | None = None) -> DataFrame:
        """(qid=base id, concept, label=target, rank, cid, sim) for every distinct base/concept/target."""
        cands = ctx.candidates.select("cid", "concept", "label", VECTOR)
        q = ctx.cells.select(F.col("id_base").alias("qid"), "concept",
                             F.col("target_direction").alias("label")).distinct()
        q = attach_vectors(q, ctx.vectors, "qid")
        return cosine_topk(q, cands, k or self.top_k, ["concept", "label"], "qid", "cid", VECTOR, most=ctx.n_candidates)

    def pair_errors(self, ctx: ExplainContext, matches: DataFrame | None = None) -> DataFrame:
        """``matches``: what ``matches(ctx)`` has given, if the caller has it."""
        n = ctx.n_labels
        m = ((self.matches(ctx) if matches is None else matches).where(F.col("sim") > self.threshold)
             .join(ctx.candidate_probs(), "cid"))
        keys = ["qid", "concept", "label"]
        cells = ctx.cells.withColumnRenamed("id_base", "qid").withColumnRenamed("target_direction", "label")
        if self.approach == 1:
            agg = m.groupBy(*keys).agg(mean_probs(n).alias("m_probs"))
            out = cells.join(agg, keys, "left").withColumn("icace_error", l2(F.col("m_probs"), F.col("cf_probs")))
            out = out.withColumnRenamed("label", "target_direction")
        else:
            per = cells.join(m, keys).withColumn("err", l2(F.col(PROBS), F.col("cf_probs")))
            agg = per.groupBy("pair_id").agg(F.avg("err").alias("icace_error"))
            out = ctx.cells.join(agg, "pair_id", "left")
        return _finish(out, self.name)


def topk_sweep(ctx: ExplainContext, max_k: int = 49, threshold: float = 0.0) -> DataFrame:
    """The k = 1..max_k sweep of approach-1 matching from ONE ranking.

    Running sums of the above-threshold match predictions over rank give the top-k mean for every k
    at once; the last match stands for every k beyond it. Every pair has a row for every k, with a null
    error where its block holds no match.
    """
    n = ctx.n_labels
    m = MatchingExplainer(top_k=max_k, threshold=threshold).matches(ctx).join(ctx.candidate_probs(), "cid")
    keys = ["qid", "concept", "label"]
    whole = Window.partitionBy(*keys)
    w = whole.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    above = F.col("sim") > threshold
    run = m.select(*keys, "rank", F.count(F.lit(1)).over(whole).alias("n"),
                   F.sum(above.cast("int")).over(w).alias("n_above"),
                   *[F.sum(F.when(above, F.element_at(F.col(PROBS), i + 1)).otherwise(0.0)).over(w).alias(f"s{i}")
                     for i in range(n)])
    last = F.when(F.col("rank") == F.col("n"), F.lit(max_k)).otherwise(F.col("rank"))
    means = F.when(F.col("n_above") > 0, F.array(*[F.col(f"s{i}") / F.col("n_above") for i in range(n)]))
    # a row a query meets the pairs; the values of k are told apart behind the join, where they are aggregated
    steps = run.groupBy(*keys).agg(F.collect_list(F.struct(F.col("rank").alias("first"), last.alias("last"), means.alias("m_probs"))).alias("steps"))
    cells = ctx.cells.withColumnRenamed("id_base", "qid").withColumnRenamed("target_direction", "label")
    out = cells.join(steps, keys, "left")

    def at(k: Column, probs: Column) -> Column:
        return F.struct(k.cast("int").alias("k"), probs.alias("m_probs"))

    nothing = F.lit(None).cast("array<double>")
    found = F.coalesce(F.flatten(F.transform("steps", lambda s: F.transform(F.sequence(s["first"], s["last"]), lambda k: at(k, s["m_probs"])))),
                       F.array().cast("array<struct<k:int,m_probs:array<double>>>"))
    out = out.withColumn("found", found)
    others = F.array_except(F.sequence(F.lit(1), F.lit(max_k)), F.col("found")["k"])
    out = out.withColumn("at", F.explode(F.concat("found", F.transform(others, lambda k: at(k, nothing))))).select("*", "at.*")
    out = out.withColumn("icace_error", l2(F.col("m_probs"), F.col("cf_probs")))
    return out.withColumnRenamed("label", "target_direction").select("k", "split", "pair_id", *CELL, "icace_error")


def match_report(ctx: ExplainContext, texts: DataFrame, top_k: int = 3, threshold: float = 0.0) -> DataFrame:
    """Per pair the factual text, its matched texts match_1 .. match_k (null beyond the matches), the
    counterfactual text and the approach-1 error. ``texts``: id, description; joined last, once a column."""
    ex = MatchingExplainer(top_k=top_k, threshold=threshold)
    keys = ["qid", "concept", "label"]
    found = ex.matches(ctx)
    found = cut_lineage(found) if ctx.materialize else found  # ids, read for the errors and for the texts
    wide = found.where(F.col("sim") > threshold).groupBy(*keys).agg(
        *[F.max(F.when(F.col("rank") == i, F.col("cid"))).alias(f"cid_{i}") for i in range(1, top_k + 1)])
    out = ex.pair_errors(ctx, found).join(ctx.cells.select("pair_id", "id_base", "id_counterfactual"), "pair_id")
    out = out.join(wide.withColumnsRenamed({"qid": "id_base", "label": "target_direction"}),
                   ["id_base", "concept", "target_direction"], "left")
    shown = {"id_base": "factual", "id_counterfactual": "counterfactual", **{f"cid_{i}": f"match_{i}" for i in range(1, top_k + 1)}}
    for key, name in shown.items():
        out = out.join(texts.select(F.col("id").alias(key), F.col("description").alias(name)), key, "left")
    return out.select(*ERR_COLS, *shown.values())


def icace_vectors(ctx: ExplainContext, top_k: int = 3, threshold: float = 0.0) -> DataFrame:
    """Per pair the ICaCE vector (counterfactual less base prediction), the explanation vector (mean matched
    less base prediction) and the L2 distance of the two."""
    n = ctx.n_labels
    ex = MatchingExplainer(top_k=top_k, threshold=threshold)
    keys = ["qid", "concept", "label"]
    mean = (ex.matches(ctx).where(F.col("sim") > threshold).join(ctx.candidate_probs(), "cid")
            .groupBy(*keys).agg(mean_probs(n).alias("m_probs")))
    base = score_keys(ctx.cells.select(F.col("id_base").alias("qid")), ctx.vectors, "qid", ctx.scorer).withColumnRenamed(PROBS, "b_probs")
    cells = ctx.cells.withColumnsRenamed({"id_base": "qid", "target_direction": "label"})
    out = cells.join(base, "qid", "left").join(mean, keys, "left").withColumns({
        "icace": subtract("cf_probs", "b_probs"), "explanation": subtract("m_probs", "b_probs")})
    out = out.withColumn("icace_error", l2_distance("explanation", "icace")).withColumnRenamed("label", "target_direction")
    return out.select("split", "pair_id", *CELL, "icace", "explanation", "icace_error")


@dataclass
class ApproxExplainer:
    """Candidates with the target label and the base's other three concept predictions
    (J4). ``exact=False``: one seeded random candidate (J9); ``exact=True``: the most
    cosine-similar candidate (J7, tiled top-1)."""

    exact: bool = False

    @property
    def name(self) -> str:
        return run_label("confounder-match", exact=int(self.exact))

    def pair_errors(self, ctx: ExplainContext) -> DataFrame:
        block = ["concept", "label", "o1", "o2", "o3"]
        base = ctx.base_others().withColumnRenamed("target_direction", "label")
        cands = ctx.candidates
        if self.exact:
            q = base.select(F.col("id_base").alias("qid"), *block).distinct()
            q = attach_vectors(q, ctx.vectors, "qid")
            best = cosine_topk(q, cands.select("cid", *block, VECTOR), 1, block, "qid", "cid", VECTOR, most=ctx.n_candidates)
            picked = base.join(best.withColumnRenamed("qid", "id_base"), ["id_base", *block], "left")
        else:
            pos = seeded_positions(cands.select("cid", *block), block, "cid", ctx.seed, salt_chars=2)
            sizes = cands.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"))
            want = base.join(sizes, block, "left").withColumn(
                "_pos", F.pmod(md5_int(ctx.seed, "pair_id"), F.col("_n")))
            picked = want.join(pos.drop("_n"), [*block, "_pos"], "left")
        picked = picked.join(ctx.candidate_probs(), "cid", "left")
        out = picked.withColumn("icace_error", l2(F.col(PROBS), F.col("cf_probs")))
        return _finish(out.withColumnRenamed("label", "target_direction"), self.name)


@dataclass
class GenerativeExplainer:
    """Generations written from the base's original for the same concept and target.
    Approach 1: mean generation prediction (A8). Approach 2: one seeded generation (J10)."""

    approach: int = 1

    @property
    def name(self) -> str:
        return run_label("generative", approach=self.approach)

    def pair_errors(self, ctx: ExplainContext) -> DataFrame:
        n = ctx.n_labels
        key = ["original_id_base", "concept", "target_direction"]
        accepted = ctx.generations() if callable(ctx.generations) else ctx.generations
        g = accepted.where(F.col("generation").isNotNull()).select(
            "g_id", F.col("original_id").alias("original_id_base"),
            F.col("intervention_aspect").alias("concept"), "target_direction")
        # ids and labels of the generations that are left, cleaned once for all that reads them
        g = cut_lineage(g) if ctx.materialize else g
        gp = g.join(score_keys(g.select(F.col("g_id").alias("k")), ctx.embeddings, "k", ctx.scorer)
                    .withColumnRenamed("k", "g_id"), "g_id")
        if self.approach == 1:
            # pre-aggregate per (original, concept, target) before meeting the pairs
            agg = gp.groupBy(*key).agg(mean_probs(n).alias("m_probs"))
            out = ctx.cells.join(agg, key, "left")
        else:
            pos = seeded_positions(gp, key, "g_id", ctx.seed, salt_chars=2)
            sizes = gp.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
            want = ctx.cells.join(sizes, key, "left").withColumn(
                "_pos", F.pmod(md5_int(ctx.seed, "pair_id"), F.col("_n")))
            out = want.join(pos.select(*key, "_pos", F.col(PROBS).alias("m_probs")), [*key, "_pos"], "left")
        out = out.withColumn("icace_error", l2(F.col("m_probs"), F.col("cf_probs")))
        return _finish(out, self.name)


@dataclass
class RandomExplainer:
    """Per cell (split and directions), as many candidates (target label) as pairs, drawn without
    replacement in the cell's own seeded order and zipped with the pairs in seeded order."""

    @property
    def name(self) -> str:
        return run_label("random")

    def pair_errors(self, ctx: ExplainContext) -> DataFrame:
        group = ["split", *CELL]
        cells = seeded_positions(ctx.cells, group, "pair_id", ctx.seed, salt_chars=2)
        drawn = F.broadcast(ctx.cells.select(*group).distinct())  # at most a row a cell and split
        cands = ctx.candidates.select("cid", "concept", F.col("label").alias("target_direction")).join(
            drawn, ["concept", "target_direction"])
        cands = cands.withColumn("draw", F.concat_ws("|", *group, F.col("cid").cast("string")))
        cands = seeded_positions(cands, group, "draw", ctx.seed, salt_chars=2).select("cid", *group, "_pos")
        out = (cells.drop("_n").join(cands, [*group, "_pos"], "left")
               .join(ctx.candidate_probs(), "cid", "left")
               .withColumn("icace_error", l2(F.col(PROBS), F.col("cf_probs"))))
        return _finish(out, self.name)


def union_errors(frames: list[DataFrame]) -> DataFrame:
    """One long table of pair errors for all explainers."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
