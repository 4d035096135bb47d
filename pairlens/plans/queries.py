"""Registered queries: name -> (spark, sf_dir) -> DataFrame, with the oracle SQL beside each.

Outputs are flat (no arrays), doubles rounded to 6 digits and counts BIGINT so the
engine and the oracle compare by value.
"""
from __future__ import annotations

import re
import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.constants import ASPECT_CODE_TO_LABEL, CONCEPTS, DEFAULT_SEED, SCORE_ENCODINGS, run_label
from pairlens.functions.labels import literal_map
from pairlens.functions.vectors import argmax
from pairlens.operators import explainers as X
from pairlens.operators import metrics as M
from pairlens.operators.pairs import LABEL_COLS, mine_pairs, original_diagnostics, pair_drop_counts
from pairlens.operators.scoring import predicted_classes
from pairlens.plans import oracle as O
from pairlens.session import cut_lineage
from pairlens.sources.fixtures import MODELS, Fixtures
from pairlens.sources.sinks import overall_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

FLAGSHIP_K = 3
MATCH_A1 = run_label("matching", approach=1, k=FLAGSHIP_K, over=0)
MATCH_A2 = run_label("matching", approach=2, k=FLAGSHIP_K, over=0)
SAMPLED = run_label("confounder-match", exact=0)
EXACT = run_label("confounder-match", exact=1)
GEN_MEAN = run_label("generative", approach=1)
GEN_ONE = run_label("generative", approach=2)
RANDOM = run_label("random")


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


def context(spark: SparkSession, sf_dir: str, seed: int = DEFAULT_SEED, model: str = "base",
            scorer: str = "linear_head") -> tuple[Fixtures, X.ExplainContext]:
    fx = Fixtures(spark, sf_dir, seed)
    ctx = X.ExplainContext(pairs=mine_pairs(fx.explained_reviews, LABEL_COLS), matching_set=fx.matching_set,
                           generations=lambda: fx.accepted_generations, embeddings=fx.vectors(model), scorer=scorer, seed=seed)
    return fx, ctx


# ---------------------------------------------------------------- phase 1: pairs
@register("pairs_all", O.with_prelude("""
select split, kind, id_base, id_counterfactual, original_id_base, it as intervention_type,
       iab as intervention_aspect_base, iac as intervention_aspect_counterfactual,
       rm_b as review_majority_base, rm_k as review_majority_counterfactual
from pairs"""))
def q_pairs_all(spark, sf_dir):
    p = mine_pairs(Fixtures(spark, sf_dir).reviews, LABEL_COLS)
    return p.select("split", "kind", "id_base", "id_counterfactual", "original_id_base", "intervention_type",
                    "intervention_aspect_base", "intervention_aspect_counterfactual", "review_majority_base",
                    "review_majority_counterfactual")


@register("pairs_by_cell", O.with_prelude("""
select split, it as intervention_type, iab as intervention_aspect_base, iac as intervention_aspect_counterfactual,
       count(*)::bigint as n_pairs
from pairs group by all"""))
def q_pairs_by_cell(spark, sf_dir):
    p = mine_pairs(Fixtures(spark, sf_dir).reviews, LABEL_COLS)
    return p.groupBy("split", "intervention_type", "intervention_aspect_base", "intervention_aspect_counterfactual").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_pairs"))


@register("pairs_diagnostics", O.with_prelude("""
select split, count(*)::bigint as n_originals, count(*) filter (where n_rows > 1)::bigint as n_with_pairs,
       count(*) filter (where n_orig = 0)::bigint as n_without_original,
       count(*) filter (where n_orig > 1)::bigint as n_multi_original, sum(n_rows)::bigint as n_rows
from (select split, original_id, count(*) as n_rows, count(*) filter (where is_original) as n_orig
      from fx_reviews group by split, original_id) g
group by split"""))
def q_pairs_diagnostics(spark, sf_dir):
    return original_diagnostics(Fixtures(spark, sf_dir).reviews)


# ---------------------------------------------------------------- phase 2: flagship
@register("match_topk", O.with_prelude(
    "select qid, concept, label, rank::bigint as rank, cid, round(sim, 6) as sim from ranked",
    O.ranked_matches(FLAGSHIP_K)))
def q_match_topk(spark, sf_dir):
    _, ctx = context(spark, sf_dir)
    m = X.MatchingExplainer(top_k=FLAGSHIP_K).matches(ctx)
    return m.select("qid", "concept", "label", F.col("rank").cast("bigint").alias("rank"), "cid", r6("sim"))


def _matching_a1_sql(k: int, threshold: float, name: str) -> str:
    return O.with_prelude(f"""
select '{name}' as explainer, c.split, c.pair_id, c.concept, c.base_direction, c.target_direction,
       round({O.l2('m.m', 'c.c')}, 6) as icace_error
from cells c left join (
  select r.qid, r.concept, r.label, avg(e.p1) as m1, avg(e.p2) as m2, avg(e.p3) as m3, avg(e.p4) as m4, avg(e.p5) as m5
  from ranked r join emb e on e.vec_id = r.cid % {O.N_EMB} where r.sim > {threshold}
  group by r.qid, r.concept, r.label) m
on m.qid = c.id_base and m.concept = c.concept and m.label = c.target_direction""", O.ranked_matches(k))


def _errors_out(df: DataFrame) -> DataFrame:
    return df.select("explainer", "split", "pair_id", "concept", "base_direction", "target_direction",
                     r6("icace_error"))


@register("icace_matching_a1", _matching_a1_sql(FLAGSHIP_K, 0.0, MATCH_A1))
def q_icace_matching_a1(spark, sf_dir):
    _, ctx = context(spark, sf_dir)
    return _errors_out(X.MatchingExplainer(top_k=FLAGSHIP_K).pair_errors(ctx))


@register("icace_matching_a2", O.with_prelude(f"""
select '{MATCH_A2}' as explainer, c.split, c.pair_id, c.concept, c.base_direction, c.target_direction,
       round(avg({O.l2('e.p', 'c.c')}), 6) as icace_error
from cells c left join ranked r on r.qid = c.id_base and r.concept = c.concept and r.label = c.target_direction
     and r.sim > 0.0
left join emb e on e.vec_id = r.cid % {O.N_EMB}
group by all""", O.ranked_matches(FLAGSHIP_K)))
def q_icace_matching_a2(spark, sf_dir):
    _, ctx = context(spark, sf_dir)
    return _errors_out(X.MatchingExplainer(top_k=FLAGSHIP_K, approach=2).pair_errors(ctx))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs -> label-blocked cosine top-3 -> ICaCE (approach 1) -> 24 cells per split."""
    _, ctx = context(spark, sf_dir)
    cells = M.score_cells(X.MatchingExplainer(top_k=FLAGSHIP_K).pair_errors(ctx))
    return cells.select(*M.CELL_KEYS, "n_pairs", "n_valid", r6("icace_error"))


SCORE_CELLS_SQL = O.with_prelude(f"""
select explainer, split, concept, base_direction, target_direction, count(*)::bigint as n_pairs,
       count(icace_error)::bigint as n_valid, round(avg(icace_error), 6) as icace_error
from (
  select '{MATCH_A1}' as explainer, c.split, c.concept, c.base_direction, c.target_direction,
         {O.l2('m.m', 'c.c')} as icace_error
  from cells c left join (
    select r.qid, r.concept, r.label, avg(e.p1) as m1, avg(e.p2) as m2, avg(e.p3) as m3, avg(e.p4) as m4, avg(e.p5) as m5
    from ranked r join emb e on e.vec_id = r.cid % {O.N_EMB} where r.sim > 0.0 group by r.qid, r.concept, r.label) m
  on m.qid = c.id_base and m.concept = c.concept and m.label = c.target_direction) x
group by all""", O.ranked_matches(FLAGSHIP_K))

register("score_cells", SCORE_CELLS_SQL)(flagship)


def _model_sql(sql: str, shift: int) -> str:
    """The same SQL over another model's vectors."""
    return re.sub(r"(\w+\.\w+) % " + re.escape(O.N_EMB), rf"(\1 + {shift}) % {O.N_EMB}", sql)


#: The second head reads the next five dimensions.
BATCH_SQL = re.sub(r"exp\(4 \* v\[(\d)\]\)", lambda m: f"exp(4 * v[{int(m[1]) + 5}])", SCORE_CELLS_SQL)
RUNS = [(m, m, "linear_head") for m in MODELS] + [("batch", "base", "batch_head")]  # name, vectors, scorer


@register("score_cells_by_model", " union all ".join(
    f"select '{name}' as model, * from ({_model_sql(SCORE_CELLS_SQL, MODELS[vectors]) if scorer == 'linear_head' else BATCH_SQL}) m{i}"
    for i, (name, vectors, scorer) in enumerate(RUNS)))
def q_score_cells_by_model(spark, sf_dir):
    """The flagship's cells for each model to explain: three sets of vectors, two heads. Pairs and candidate ids are the
    same for all, and the matches for all heads over the same vectors, so each is written once (ids and labels)."""
    fx, ctx = context(spark, sf_dir)
    explainer = X.MatchingExplainer(top_k=FLAGSHIP_K)
    known, out = {}, None
    for name, vectors, scorer in RUNS:
        of_vectors, matches = known.get(vectors, (ctx, None))
        ctx = of_vectors.other_model(fx.vectors(vectors), scorer)
        if matches is None:
            matches = cut_lineage(explainer.matches(ctx))
            known[vectors] = ctx, matches
        cells = M.score_cells(explainer.pair_errors(ctx, matches))
        cells = cells.select(F.lit(name).alias("model"), *M.CELL_KEYS, "n_pairs", "n_valid", r6("icace_error"))
        out = cells if out is None else out.unionByName(cells)
    return out


def _class_sql(first: int) -> str:
    best = f"greatest({', '.join(f'u[{first + i}]' for i in range(1, 6))})"
    return "case " + " ".join(f"when v[{first + i}] = {best.replace('u[', 'v[')} then {i - 1}" for i in range(1, 6)) + " end"


@register("scored_classes", O.with_prelude(" union all ".join(
    f"select r.id, '{s}' as scorer, ({_class_sql(first)})::int as class from fx_reviews r "
    f"join (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings) e on e.vec_id = r.id % {O.N_EMB}"
    for s, first in (("linear_head", 0), ("batch_head", 5)))))
def q_scored_classes(spark, sf_dir):
    """The class that each registered head gives each review."""
    fx = Fixtures(spark, sf_dir)
    return predicted_classes(fx.reviews.select("id"), fx.vectors(), "id", ["linear_head", "batch_head"])


_BEST = f"""
bm as (
  select r.qid, r.concept, r.label, avg(e.p1) as m1, avg(e.p2) as m2, avg(e.p3) as m3, avg(e.p4) as m4, avg(e.p5) as m5,
         max(case when r.rank = 1 then r.cid end) as cid1, max(case when r.rank = 2 then r.cid end) as cid2,
         max(case when r.rank = 3 then r.cid end) as cid3
  from ranked r left join emb e on e.vec_id = r.cid % {O.N_EMB} where r.sim > 0.0 group by r.qid, r.concept, r.label)"""


@register("best_match_report", O.with_prelude(f"""
select c.split, c.pair_id, c.concept, c.base_direction, c.target_direction, round({O.l2('m.m', 'c.c')}, 6) as icace_error,
       md5(f.description) as factual, md5(k.description) as counterfactual, md5(t1.description) as match_1,
       md5(t2.description) as match_2, md5(t3.description) as match_3
from cells c join fx_reviews f on f.id = c.id_base join fx_reviews k on k.id = c.id_counterfactual
left join bm m on m.qid = c.id_base and m.concept = c.concept and m.label = c.target_direction
left join fx_reviews t1 on t1.id = m.cid1 left join fx_reviews t2 on t2.id = m.cid2 left join fx_reviews t3 on t3.id = m.cid3""",
    O.ranked_matches(FLAGSHIP_K) + "," + _BEST))
def q_best_match_report(spark, sf_dir):
    """What a user reads: factual, matched and counterfactual text of every pair (as md5 here), with the error."""
    fx, ctx = context(spark, sf_dir)
    # each text is digested where it is read, so that five joins move digests
    r = X.match_report(ctx, fx.reviews.select("id", F.md5("description").alias("description")), FLAGSHIP_K)
    shown = ["factual", "counterfactual", "match_1", "match_2", "match_3"]
    return r.select("split", "pair_id", "concept", "base_direction", "target_direction", r6("icace_error"), *shown)


@register("pair_icace_vectors", O.with_prelude(
    "select c.split, c.pair_id, c.concept, c.base_direction, c.target_direction, "
    + ", ".join(f"round(c.c{i} - b.p{i}, 6) as icace_{i}, round(m.m{i} - b.p{i}, 6) as explanation_{i}" for i in range(1, 6))
    + f", round({O.l2('m.m', 'c.c')}, 6) as icace_error from cells c left join emb b on b.vec_id = c.id_base % {O.N_EMB} "
    "left join bm m on m.qid = c.id_base and m.concept = c.concept and m.label = c.target_direction",
    O.ranked_matches(FLAGSHIP_K) + "," + _BEST))
def q_pair_icace_vectors(spark, sf_dir):
    """Both vectors of every pair, an element a column."""
    _, ctx = context(spark, sf_dir)
    v = X.icace_vectors(ctx, FLAGSHIP_K)
    parts = [F.round(F.element_at(c, i), 6).alias(f"{c}_{i}") for i in range(1, 6) for c in ("icace", "explanation")]
    return v.select("split", "pair_id", "concept", "base_direction", "target_direction", *parts, r6("icace_error"))


# ---------------------------------------------------------------- phase 3: other explainers
# Oracle per-pair error bodies: (explainer, split, pair_id, concept, base_direction, target_direction,
# icace_error) plus the extra CTEs each needs.
_CELL_OUT = "c.split, c.pair_id, c.concept, c.base_direction, c.target_direction"
_OTHERS_SQL = ", ".join(
    "case c.concept " + " ".join(
        f"when '{c}' then c.{[x for x in CONCEPTS if x != c][i]}_pb" for c in CONCEPTS) + f" end as o{i + 1}"
    for i in range(3))
_BLOCK_ON = "s.concept = b.concept and s.label = b.target_direction and s.o1 = b.o1 and s.o2 = b.o2 and s.o3 = b.o3"

ERR_SQL: dict[str, tuple[str, str]] = {
    MATCH_A1: (f"""
select '{MATCH_A1}' as explainer, {_CELL_OUT}, {O.l2('m.m', 'c.c')} as icace_error
from cells c left join (
  select r.qid, r.concept, r.label, avg(e.p1) as m1, avg(e.p2) as m2, avg(e.p3) as m3, avg(e.p4) as m4, avg(e.p5) as m5
  from ranked r join emb e on e.vec_id = r.cid % {O.N_EMB} where r.sim > 0.0 group by r.qid, r.concept, r.label) m
on m.qid = c.id_base and m.concept = c.concept and m.label = c.target_direction""", O.ranked_matches(FLAGSHIP_K)),
    SAMPLED: (f"""
select '{SAMPLED}' as explainer, {_CELL_OUT.replace('c.', 'b.')}, {O.l2('e.p', 'b.c')} as icace_error
from abase b left join (select distinct concept, label, o1, o2, o3, n from apos) s on {_BLOCK_ON}
left join apos p on p.concept = s.concept and p.label = s.label and p.o1 = s.o1 and p.o2 = s.o2 and p.o3 = s.o3
     and p.pos = {O._md5_int('b.pair_id')} % s.n
left join emb e on e.vec_id = p.cid % {O.N_EMB}""", f"""
abase as (select c.*, {_OTHERS_SQL} from cells c),
apos as (select *, row_number() over (partition by concept, label, o1, o2, o3 order by {O._md5('cid')}, cid) - 1 as pos,
                count(*) over (partition by concept, label, o1, o2, o3) as n from cand)"""),
    EXACT: (f"""
select '{EXACT}' as explainer, {_CELL_OUT.replace('c.', 'b.')}, {O.l2('e.p', 'b.c')} as icace_error
from xbase b left join xbest x on x.qid = b.id_base and x.concept = b.concept and x.label = b.target_direction
     and x.o1 = b.o1 and x.o2 = b.o2 and x.o3 = b.o3
left join emb e on e.vec_id = x.cid % {O.N_EMB}""", f"""
xbase as (select c.*, {_OTHERS_SQL} from cells c),
xq as (select distinct id_base as qid, concept, target_direction as label, o1, o2, o3 from xbase),
xbest as (
  select * from (
    select q.*, k.cid, row_number() over (partition by q.qid, q.concept, q.label, q.o1, q.o2, q.o3
                                          order by round(list_dot_product(eq.u, ec.u), 9) desc, k.cid) as rk
    from xq q join cand k on k.concept = q.concept and k.label = q.label and k.o1 = q.o1 and k.o2 = q.o2 and k.o3 = q.o3
    join emb eq on eq.vec_id = q.qid % {O.N_EMB} join emb ec on ec.vec_id = k.cid % {O.N_EMB}) z where rk = 1)"""),
    GEN_MEAN: (f"""
select '{GEN_MEAN}' as explainer, {_CELL_OUT}, {O.l2('m.m', 'c.c')} as icace_error
from cells c left join (
  select g.original_id, g.intervention_aspect, g.target_direction, avg(e.p1) as m1, avg(e.p2) as m2, avg(e.p3) as m3,
         avg(e.p4) as m4, avg(e.p5) as m5
  from fx_accepted g join emb e on e.vec_id = g.g_id % {O.N_EMB} where g.generation is not null group by 1, 2, 3) m
on m.original_id = c.original_id_base and m.intervention_aspect = c.concept and m.target_direction = c.target_direction""",
                   ""),
    GEN_ONE: (f"""
select '{GEN_ONE}' as explainer, {_CELL_OUT}, {O.l2('e.p', 'c.c')} as icace_error
from cells c left join (select distinct original_id, intervention_aspect, target_direction, n from gpos) s
  on s.original_id = c.original_id_base and s.intervention_aspect = c.concept and s.target_direction = c.target_direction
left join gpos g on g.original_id = s.original_id and g.intervention_aspect = s.intervention_aspect
  and g.target_direction = s.target_direction and g.pos = {O._md5_int('c.pair_id')} % s.n
left join emb e on e.vec_id = g.g_id % {O.N_EMB}""", f"""
gpos as (select g_id, original_id, intervention_aspect, target_direction,
                row_number() over (partition by original_id, intervention_aspect, target_direction
                                   order by {O._md5('g_id')}, g_id) - 1 as pos,
                count(*) over (partition by original_id, intervention_aspect, target_direction) as n
         from fx_accepted where generation is not null)"""),
    RANDOM: (f"""
select '{RANDOM}' as explainer, {_CELL_OUT.replace('c.', 'p.')}, {O.l2('e.p', 'p.c')} as icace_error
from ppos p left join rpos r on r.split = p.split and r.concept = p.concept and r.base_direction = p.base_direction
  and r.label = p.target_direction and r.pos = p.pos
left join emb e on e.vec_id = r.cid % {O.N_EMB}""", f"""
ppos as (select c.*, row_number() over (partition by split, concept, base_direction, target_direction
                                        order by {O._md5('pair_id')}, pair_id) - 1 as pos from cells c),
rdraw as (select k.cid, k.concept, k.label, d.split, d.base_direction,
                 concat_ws('|', d.split, k.concept, d.base_direction, k.label, cast(k.cid as varchar)) as draw
          from cand k join (select distinct split, concept, base_direction, target_direction from cells) d
            on d.concept = k.concept and d.target_direction = k.label),
rpos as (select *, row_number() over (partition by split, concept, base_direction, label order by {O._md5('draw')}, draw) - 1 as pos
         from rdraw)"""),
}


def _explainer(name: str):
    return {e.name: e for e in (
        X.MatchingExplainer(top_k=FLAGSHIP_K), X.ApproxExplainer(exact=False), X.ApproxExplainer(exact=True),
        X.GenerativeExplainer(approach=1), X.GenerativeExplainer(approach=2), X.RandomExplainer())}[name]


def _err_oracle(names: list[str]) -> tuple[str, str]:
    body = "\nunion all\n".join(ERR_SQL[n][0] for n in names)
    extras = ",".join(ERR_SQL[n][1] for n in names if ERR_SQL[n][1])
    return body, extras


def _register_explainer(qname: str, ename: str):
    body, extras = _err_oracle([ename])
    sql = O.with_prelude(f"""select explainer, split, pair_id, concept, base_direction, target_direction,
       round(icace_error, 6) as icace_error from ({body}) z""", extras)

    def q(spark, sf_dir):
        _, ctx = context(spark, sf_dir)
        return _errors_out(_explainer(ename).pair_errors(ctx))

    register(qname, sql)(q)


_register_explainer("icace_approx_sample", SAMPLED)
_register_explainer("icace_approx_exact", EXACT)
_register_explainer("icace_generative", GEN_MEAN)
_register_explainer("icace_generative_sampled", GEN_ONE)
_register_explainer("icace_random", RANDOM)

# ---------------------------------------------------------------- phase 4: report tables
REPORT_EXPLAINERS = [MATCH_A1, SAMPLED, GEN_MEAN, RANDOM]


def all_errors(spark, sf_dir) -> DataFrame:
    _, ctx = context(spark, sf_dir)
    return X.union_errors([_explainer(n).pair_errors(ctx) for n in REPORT_EXPLAINERS])


_REP_BODY, _REP_EXTRAS = _err_oracle(REPORT_EXPLAINERS)
_REP_CELLS = f"""
rep_err as ({_REP_BODY}),
rep_cells as (select explainer, split, concept, base_direction, target_direction, count(*) as n_pairs,
                     count(icace_error) as n_valid, avg(icace_error) as icace_error from rep_err group by all),
rep_concept as (select explainer, split, concept, avg(round_even(icace_error, 2)) as average,
                       count(icace_error) as n_cells from rep_cells group by all)"""
_REP_CTES = (_REP_EXTRAS + "," if _REP_EXTRAS else "") + _REP_CELLS


@register("score_by_concept", O.with_prelude(
    "select explainer, split, concept, round(average, 6) as average, n_cells::bigint as n_cells from rep_concept",
    _REP_CTES))
def q_score_by_concept(spark, sf_dir):
    b = M.score_by_concept(M.score_cells(all_errors(spark, sf_dir)))
    return b.select("explainer", "split", "concept", r6("average"), "n_cells")


@register("score_overall", O.with_prelude(
    "select explainer, split, round_even(avg(average), 2) as score, count(average)::bigint as n_concepts "
    "from rep_concept group by all", _REP_CTES))
def q_score_overall(spark, sf_dir):
    return M.score_overall(M.score_by_concept(M.score_cells(all_errors(spark, sf_dir))))


_PIVOT_COLS = [M.direction_label(b, t) for b, t in M.DIRECTION_PAIRS]


@register("score_pivot", O.with_prelude(
    "select explainer, split, concept, "
    + ", ".join(f"max(case when base_direction = '{b}' and target_direction = '{t}' then round_even(icace_error, 2) end)"
                f" as {M.direction_label(b, t)}" for b, t in M.DIRECTION_PAIRS)
    + ", round(avg(round_even(icace_error, 2)), 6) as average from rep_cells group by all", _REP_CTES))
def q_score_pivot(spark, sf_dir):
    p = M.score_pivot(M.score_cells(all_errors(spark, sf_dir)))
    return p.select("explainer", "split", "concept", *[F.col(f"`{c}`") for c in _PIVOT_COLS], r6("average"))


@register("score_table", O.with_prelude(
    "select explainer, split, " + ", ".join(f"round(max(case when concept = '{c}' then average end), 6) as {c}" for c in CONCEPTS)
    + ", round_even(avg(average), 2) as average from rep_concept group by all", _REP_CTES))
def q_score_table(spark, sf_dir):
    """A3/A4: explainers by concepts, with the overall score."""
    t = overall_table(M.score_cells(all_errors(spark, sf_dir)))
    return t.select("explainer", "split", *[r6(c) for c in CONCEPTS], "average")


@register("coverage", O.with_prelude(
    "select explainer, split, count(*)::bigint as n_optional, count(icace_error)::bigint as n_valid, "
    "round(100.0 * count(icace_error) / count(*), 6) as pct_valid from rep_err group by all", _REP_CTES))
def q_coverage(spark, sf_dir):
    c = M.coverage(all_errors(spark, sf_dir))
    return c.select("explainer", "split", "n_optional", "n_valid", r6("pct_valid"))


@register("score_cells_all", O.with_prelude(
    "select explainer, split, concept, base_direction, target_direction, n_pairs::bigint as n_pairs, "
    "n_valid::bigint as n_valid, round(icace_error, 6) as icace_error from rep_cells", _REP_CTES))
def q_score_cells_all(spark, sf_dir):
    c = M.score_cells(all_errors(spark, sf_dir))
    return c.select(*M.CELL_KEYS, "n_pairs", "n_valid", r6("icace_error"))


# ---------------------------------------------------------------- phase 5: generation hygiene
from pairlens.operators import hygiene as H  # noqa: E402
from pairlens.operators import ingest as I  # noqa: E402

_GEN_OUT = ["g_id", "split", "original_id", "intervention_aspect", "base_direction", "target_direction",
            "generation_index"]
_GEN_OUT_SQL = ", ".join(_GEN_OUT) + ", length(generation)::bigint as gen_len, md5(generation) as gen_md5"


def _gen_out(df: DataFrame) -> DataFrame:
    return df.select(*_GEN_OUT, F.length("generation").cast("bigint").alias("gen_len"),
                     F.md5("generation").alias("gen_md5"))


@register("gen_hygiene", O.with_prelude(f"select {_GEN_OUT_SQL} from fx_clean"))
def q_gen_hygiene(spark, sf_dir):
    return _gen_out(Fixtures(spark, sf_dir).clean_generations)


@register("gen_dedup", O.with_prelude(f"""
select {_GEN_OUT_SQL} from (
  select *, row_number() over (partition by generation, base_direction, target_direction order by g_id) as rn
  from fx_generations where {O.F12_SQL}) d where rn = 1"""))
def q_gen_dedup(spark, sf_dir):
    g = Fixtures(spark, sf_dir).generations
    return _gen_out(H.first_per_key(H.drop_no_change(H.drop_unsuccessful(g))))


@register("gen_fault_words", O.with_prelude(
    f"select {_GEN_OUT_SQL} from fx_generations where "
    + O.F3_SQL.replace("lower(generation)", "coalesce(lower(generation), 'nan')")))
def q_gen_fault_words(spark, sf_dir):
    return _gen_out(H.drop_fault_words(Fixtures(spark, sf_dir).generations))


@register("gen_fault_endings", O.with_prelude(
    f"select {_GEN_OUT_SQL} from fx_generations where "
    + O.F4_SQL.replace("lower(generation)", "coalesce(lower(generation), 'nan')")))
def q_gen_fault_endings(spark, sf_dir):
    return _gen_out(H.drop_fault_endings(Fixtures(spark, sf_dir).generations))


@register("gen_treatment_filter", O.with_prelude(
    f"select {_GEN_OUT_SQL}, " + ", ".join(f"{c}_predictions_generation" for c in CONCEPTS) + " from fx_accepted"))
def q_gen_treatment_filter(spark, sf_dir):
    a = Fixtures(spark, sf_dir).accepted_generations
    return a.select(*_GEN_OUT, F.length("generation").cast("bigint").alias("gen_len"),
                    F.md5("generation").alias("gen_md5"), *[f"{c}_predictions_generation" for c in CONCEPTS])


@register("gen_funnel", O.with_prelude(f"""
select split, count(*)::bigint as n_input,
  count(*) filter (where not failed and generation is not null and generation <> '')::bigint as n_after_unsuccessful,
  count(*) filter (where s2)::bigint as n_after_no_change,
  count(*) filter (where s3)::bigint as n_after_dedup,
  count(*) filter (where s3 and {O.F3_SQL})::bigint as n_after_fault_words,
  count(*) filter (where s3 and {O.F3_SQL} and {O.F4_SQL})::bigint as n_clean,
  count(*) filter (where s3 and {O.F3_SQL} and {O.F4_SQL} and target_direction = {O.TREAT_CASE})::bigint as n_accepted,
  case when count(*) > 0 then floor(100 * (count(*) - count(*) filter (where s3 and {O.F3_SQL} and {O.F4_SQL}))
       / count(*))::bigint end as pct_dropped
from (
  select g.*, coalesce(s2, false) as s2, coalesce(s2 and rn = 1, false) as s3
  from fx_generations g left join (
    select g_id, true as s2, row_number() over (partition by generation, base_direction, target_direction order by g_id) as rn
    from fx_generations where {O.F12_SQL}) d using (g_id)) z
group by split"""))
def q_gen_funnel(spark, sf_dir):
    return H.funnel_counts(Fixtures(spark, sf_dir).generations, by=["split"])


# ---------------------------------------------------------------- phase 6: ingest
def _encode_sql(dataset_type: str) -> str:
    enc = " ".join(f"when '{k}' then {v}" for k, v in __import__("pairlens.constants", fromlist=["x"])
                   .SCORE_ENCODINGS[dataset_type].items())
    drop3 = " and review_majority <> '3'" if dataset_type == "2-way" else ""
    return O.with_prelude(f"""
select id, split, cast(case review_majority {enc} end as integer) as review_majority
from fx_reviews where not (split like 'train%' and review_majority = 'no majority'){drop3}""")


for _dt in ("2-way", "3-way", "5-way"):
    def _q(spark, sf_dir, _dt=_dt):
        return I.encode_reviews(Fixtures(spark, sf_dir).reviews, _dt).select("id", "split", "review_majority")
    register(f"encode_{_dt.replace('-', '')}", _encode_sql(_dt))(_q)


@register("aspect_training_set", O.with_prelude(
    " union all ".join(
        f"select id, split, '{c}' as concept, {c}_aspect_majority as aspect_label, "
        f"cast(case {c}_aspect_majority when 'Negative' then 1 when 'Positive' then 2 else 0 end as integer) as label "
        f"from fx_reviews where {c}_aspect_majority in ('Negative', 'Positive', 'unknown')" for c in CONCEPTS)))
def q_aspect_training_set(spark, sf_dir):
    return I.aspect_training_set(Fixtures(spark, sf_dir).reviews).select("id", "split", "concept", "aspect_label",
                                                                         "label")


@register("gen_decoded", O.with_prelude("select g_id, " + ", ".join(
    f"nullif({c}_predictions_generation, '') as {c}_predictions_generation" for c in CONCEPTS) + " from fx_generations"))
def q_gen_decoded(spark, sf_dir):
    """Predictions stored as codes, as text of a number or of a tensor, read back as labels (one without a label has
    no code); an unknown code is an error."""
    code = {label: number for number, label in ASPECT_CODE_TO_LABEL.items()}
    shapes = [lambda x: x, lambda x: F.concat(F.lit("tensor("), x, F.lit(")")), lambda x: F.concat(F.lit(" "), x, F.lit(" "))]
    g = Fixtures(spark, sf_dir).generations
    for i, c in enumerate(CONCEPTS):
        name = f"{c}_predictions_generation"
        number = F.element_at(literal_map(code), F.col(name)).cast("string")
        nth = F.pmod(F.col("g_id") + i, F.lit(3))
        g = g.withColumn(name, F.when(nth == 0, shapes[0](number)).when(nth == 1, shapes[1](number)).otherwise(F.trim(shapes[2](number))))
    return H.decode_predictions(g).select("g_id", *[f"{c}_predictions_generation" for c in CONCEPTS])


@register("aspects_filled", O.with_prelude("select id, split, " + ", ".join(f"coalesce({c}_aspect_majority, '') as {c}_aspect_majority" for c in CONCEPTS)
          + " from (select id, split, review_majority, " + ", ".join(f"nullif({c}_aspect_majority, '') as {c}_aspect_majority" for c in CONCEPTS)
          + " from fx_reviews) r where not (split like 'train%' and review_majority = 'no majority')"))
def q_aspects_filled(spark, sf_dir):
    """missing aspect labels become empty text."""
    raw = Fixtures(spark, sf_dir).reviews.withColumns({f"{c}_aspect_majority": F.nullif(F.col(f"{c}_aspect_majority"), F.lit("")) for c in CONCEPTS})
    return I.encode_reviews(raw, "5-way").select("id", "split", *I.ASPECT_COLS)


@register("sentiment_training_set", O.with_prelude(
    "select md5(description) as text_md5, case review_majority " + " ".join(f"when '{k}' then {v}" for k, v in SCORE_ENCODINGS["2-way"].items())
    + " end as labels from fx_reviews where review_majority not in ('no majority', '3')"))
def q_sentiment_training_set(spark, sf_dir):
    """rows of the sentiment model under the standard names, from a table with others."""
    r = Fixtures(spark, sf_dir).reviews.select(F.col("description").alias("text"), F.col("review_majority").alias("edit_rating"))
    return I.sentiment_training_set(r, "2-way").select(F.md5("description").alias("text_md5"), "labels")


@register("split_halves", O.with_prelude("select id, half from fx_halves"))
def q_split_halves(spark, sf_dir):
    r = Fixtures(spark, sf_dir).reviews.where(F.col("split") == "train_exclusive")
    return I.split_halves(r.select("id"))


@register("full_set", O.with_prelude(
    "select rid, src, k, split, original_id, generation_index, intervention_aspect, "
    + ", ".join(f"{c}_predictions" for c in CONCEPTS)
    + ", length(text)::bigint as text_len, md5(text) as text_md5 from fx_full_set"))
def q_full_set(spark, sf_dir):
    f = Fixtures(spark, sf_dir).full_set
    return f.select("rid", "src", "k", "split", "original_id", "generation_index", "intervention_aspect",
                    *[f"{c}_predictions" for c in CONCEPTS], F.length("text").cast("bigint").alias("text_len"),
                    F.md5("text").alias("text_md5"))


@register("onehot", O.with_prelude(
    "select id, " + ", ".join(
        f"case when rm is null then null when rm = {i} then 1.0 else 0.0 end as oh{i}" for i in range(5))
    + " from (select id, case review_majority "
    + " ".join(f"when '{k}' then {v}" for k, v in {'1': 0, '2': 1, '3': 2, '4': 3, '5': 4}.items())
    + " end as rm from fx_reviews where not (split like 'train%' and review_majority = 'no majority')) z"))
def q_onehot(spark, sf_dir):
    e = I.onehot_scores(I.encode_reviews(Fixtures(spark, sf_dir).reviews, "5-way"))
    return e.select("id", *[F.element_at("review_majority_onehot", i + 1).alias(f"oh{i}") for i in range(5)])


# ---------------------------------------------------------------- phase 7/8: contrastive sets and metrics
from pairlens.operators import contrastive as C  # noqa: E402

GEN_INDEX = "-101"
_QI = ", ".join(str(i) for i in I.parse_generation_index(GEN_INDEX))


def contrastive_parts(spark, sf_dir, seed: int = DEFAULT_SEED):
    fx = Fixtures(spark, sf_dir, seed)
    fs = fx.mining_set
    qs = C.query_rows(fs, GEN_INDEX)
    return fx, fs, qs, C.treatment_members(fs, qs), C.confounder_members(fs, qs)


def kept_samples(spark, sf_dir):
    fx, fs, qs, tcf, ccf = contrastive_parts(spark, sf_dir)
    # narrow relations, each read for the counts and for the samples
    tcf, ccf = cut_lineage(tcf), cut_lineage(ccf)
    kept = cut_lineage(C.kept_queries(C.role_counts(fs, qs, tcf, ccf)).select(*C.QUERY))
    samples = C.sample_members(fs, kept, tcf.join(kept, C.QUERY, "left_semi"), ccf.join(kept, C.QUERY, "left_semi"))
    # <= 20 rows per kept query, read twice by the cosine stage: materialise once
    return fx, fs, cut_lineage(samples)


def _views_sql(name: str, source: str, label: str, extra: str) -> str:
    """One row per row and treatment, with the treatment's label as t and the confounders' as c1 .. c3."""
    return f"{name} as (" + " union all ".join(
        f"select '{t}' as treatment, split, {extra}, {label.format(t)} as t, "
        + ", ".join(f"{label.format(c)} as c{i + 1}" for i, c in enumerate(C.confounders(t))) + f" from {source}" for t in CONCEPTS) + ")"


_CT_CTES = _views_sql("cv", "fx_full_set", "{}_predictions", "rid, k, original_id, text, generation_index, intervention_aspect") + f""",
cq as (select * from cv where generation_index in ({_QI}) and length(text) > 2),
cpair as (
  select q.treatment, q.split, q.rid as q_rid, m.rid as m_rid, q.t as q_t, m.t as m_t, m.intervention_aspect as ia, m.generation_index as gi,
         m.original_id = q.original_id as same_original, coalesce(m.text <> q.text, true) as other_text,
         coalesce(m.c1 = q.c1, false)::int + coalesce(m.c2 = q.c2, false)::int + coalesce(m.c3 = q.c3, false)::int as n_equal
  from cq q join cv m on m.treatment = q.treatment and m.split = q.split and m.rid <> q.rid),
ctcf as (select treatment, split, q_rid, m_rid from cpair
         where same_original and other_text and n_equal = 3 and coalesce(m_t <> q_t, true) and (ia = treatment or gi = -1)),
cccf as (select treatment, split, q_rid, m_rid from cpair
         where same_original and other_text and n_equal = 2 and m_t = q_t and ((ia <> treatment and ia in ({O.CONS})) or gi = -1)),
capp as (select treatment, split, q_rid, m_rid from cpair where not same_original and n_equal = 3),
cneg as (select treatment, split, q_rid, m_rid from cpair where same_original or n_equal < 3),
ccounts as (
  select q.treatment, q.split, q.rid as q_rid, coalesce(t.n, 0)::bigint as n_tcf, coalesce(c.n, 0)::bigint as n_ccf,
         coalesce(a.n, 0)::bigint as n_approx, coalesce(g.n, 0)::bigint as n_negative
  from cq q
  left join (select treatment, q_rid, count(*) as n from ctcf group by all) t on t.treatment = q.treatment and t.q_rid = q.rid
  left join (select treatment, q_rid, count(*) as n from cccf group by all) c on c.treatment = q.treatment and c.q_rid = q.rid
  left join (select treatment, q_rid, count(*) as n from capp group by all) a on a.treatment = q.treatment and a.q_rid = q.rid
  left join (select treatment, q_rid, count(*) as n from cneg group by all) g on g.treatment = q.treatment and g.q_rid = q.rid),
ckept as (select * from ccounts where n_tcf > 0 and n_ccf > 0 and n_approx > 0 and n_negative > 0),
cplace as (select treatment, rid, row_number() over (partition by treatment, split order by c1 nulls first, c2 nulls first, c3 nulls first,
                  {O._md5('original_id')}, original_id, {O._md5('rid')}, rid) as place from cv),
crank as (
  select r.*, row_number() over (partition by r.treatment, r.q_rid, r.role order by p.place) - 1 as r,
         count(*) over (partition by r.treatment, r.q_rid, r.role) as n
  from (select 'approx' as role, * from capp union all select 'negative', * from cneg) r
  join ckept k on k.treatment = r.treatment and k.q_rid = r.q_rid
  join cplace p on p.treatment = r.treatment and p.rid = r.m_rid),
cdraw as (
  select treatment, q_rid, role, unnest(ds) as d, generate_subscripts(ds, 1) - 1 as j from (
    select treatment, q_rid, role, list_reduce(list_prepend([]::bigint[], list_transform(range(least(5, n)), lambda i: [i])), lambda s, x:
      list_append(s, case when list_contains(s, ('0x' || substr(md5('{O.SEED}|' || treatment || '|' || q_rid || '|' || role || '|' || x[1]), 1, 15))::bigint
                                               % (n - least(5, n) + x[1] + 1))
                     then n - least(5, n) + x[1]
                     else ('0x' || substr(md5('{O.SEED}|' || treatment || '|' || q_rid || '|' || role || '|' || x[1]), 1, 15))::bigint
                          % (n - least(5, n) + x[1] + 1) end)) as ds
    from (select distinct treatment, q_rid, role, n from crank) u) z),
csamples as (
  select treatment, split, q_rid, role, m_rid, j from (
    select *, (row_number() over (partition by treatment, q_rid, role order by md5('{O.SEED}|' || treatment || '|' || q_rid || '|' || m_rid), m_rid) - 1)::bigint as j
    from (select 't_cf' as role, * from ctcf union all select 'c_cf', * from cccf) l
    where exists (select 1 from ckept k where k.treatment = l.treatment and k.q_rid = l.q_rid)) s where j < 5
  union all
  select r.treatment, r.split, r.q_rid, r.role, r.m_rid, d.j::bigint from crank r
  join cdraw d on d.treatment = r.treatment and d.q_rid = r.q_rid and d.role = r.role and d.d = r.r),
ccos as (
  select s.*, list_dot_product(eq.u, em.u) as cos from csamples s
  join fx_full_set fq on fq.rid = s.q_rid join fx_full_set fm on fm.rid = s.m_rid
  join emb eq on eq.vec_id = fq.k % {O.N_EMB} join emb em on em.vec_id = fm.k % {O.N_EMB}),
cterms as (
  select treatment, split, q_rid, role, avg(cos) as mean_cos, avg(exp(cos / 1.0)) as term1, avg(exp(cos / 0.1)) as term01
  from ccos group by all),
cpiv as (
  select treatment, split, q_rid, {", ".join(f"max(case when role = '{r}' then term1 end) as {r}_1, max(case when role = '{r}' then term01 end) as {r}_01" for r in C.ROLES)}
  from cterms group by all)"""


def _ct(body: str) -> str:
    return O.with_prelude(body, _CT_CTES)


@register("contrastive_tcf", _ct("select * from ctcf"))
def q_contrastive_tcf(spark, sf_dir):
    return contrastive_parts(spark, sf_dir)[3]


@register("contrastive_ccf", _ct("select * from cccf"))
def q_contrastive_ccf(spark, sf_dir):
    return contrastive_parts(spark, sf_dir)[4]


@register("contrastive_role_counts", _ct("select * from ccounts"))
def q_contrastive_role_counts(spark, sf_dir):
    """J13-J16 sizes of every query, for the four treatments and all splits."""
    _, fs, qs, tcf, ccf = contrastive_parts(spark, sf_dir)
    return C.role_counts(fs, qs, tcf, ccf)


@register("contrastive_kept", _ct("select * from ckept"))
def q_contrastive_kept(spark, sf_dir):
    _, fs, qs, tcf, ccf = contrastive_parts(spark, sf_dir)
    return C.kept_queries(C.role_counts(fs, qs, tcf, ccf))


_NS = "n_tcf", "n_ccf", "n_approx", "n_negative"


@register("contrastive_counts_by_treatment", _ct(
    "select *, count(*) over w::bigint as n_queries, "
    "count(*) filter (where n_tcf > 0 and n_ccf > 0 and n_approx > 0 and n_negative > 0) over w::bigint as n_kept, "
    + ", ".join(f"sum({n}) over w::bigint as all_{n[2:]}" for n in _NS) + " from ccounts window w as (partition by treatment, split)"))
def q_contrastive_counts_by_treatment(spark, sf_dir):
    """J13-J16 sizes of every query for each of the four treatments, with the totals of its treatment and split."""
    counts = cut_lineage(q_contrastive_role_counts(spark, sf_dir))  # read for the rows and for the totals
    all_four = (F.col("n_tcf") > 0) & (F.col("n_ccf") > 0) & (F.col("n_approx") > 0) & (F.col("n_negative") > 0)
    totals = counts.groupBy("treatment", "split").agg(F.count(F.lit(1)).cast("bigint").alias("n_queries"), F.count_if(all_four).cast("bigint").alias("n_kept"),
                                                      *[F.sum(n).alias(f"all_{n[2:]}") for n in _NS])
    return counts.join(F.broadcast(totals), ["treatment", "split"])  # at most four rows a split


@register("contrastive_samples", _ct("select treatment, split, q_rid, role, m_rid, j from csamples"))
def q_contrastive_samples(spark, sf_dir):
    return kept_samples(spark, sf_dir)[2]


def _cosines(spark, sf_dir):
    fx, fs, samples = kept_samples(spark, sf_dir)
    return C.member_cosines(samples, fs, fx.vectors())


@register("role_similarity", _ct(
    "select treatment, split, role, round(avg(mean_cos), 6) as mean_sim, count(*)::bigint as n_queries from cterms group by all"))
def q_role_similarity(spark, sf_dir):
    return C.role_similarity(C.role_terms(_cosines(spark, sf_dir))).select("treatment", "split", "role", r6("mean_sim"), "n_queries")


@register("order_relation", _ct("""
select treatment, split, round(t - a, 6) as differences_positive, round(c - n, 6) as differences_negative,
       round(a - n, 6) as differences_samples, round(t - c, 6) as differences_counterfactuals,
       (t - a > 0 and c - n > 0 and a - n > 0 and t - c > 0)::int as is_order_relation
from (select treatment, split, max(case when role = 't_cf' then m end) as t, max(case when role = 'c_cf' then m end) as c,
             max(case when role = 'approx' then m end) as a, max(case when role = 'negative' then m end) as n
      from (select treatment, split, role, avg(mean_cos) as m from cterms group by all) x group by all) y"""))
def q_order_relation(spark, sf_dir):
    o = C.order_relation(C.role_similarity(C.role_terms(_cosines(spark, sf_dir))))
    return o.select("treatment", "split", *[r6(c) for c in o.columns if c.startswith("differences")], "is_order_relation")


def _v1(s: str, coef: dict) -> str:
    of = {r: f"{float(coef[r])} * coalesce({r}_{s}, 0)" for r in C.ROLES}
    pos = f"({of['t_cf']} + {of['approx']})"
    return f"-ln({pos} / ({pos} + {of['negative']} + {of['c_cf']}))"


def _v0(s: str, coef: dict) -> str:
    names = {"t_cf": f"t_cf_{s}", "c_cf": f"c_cf_{s}", "approx": f"approx_{s}", "negative": f"negative_{s}"}
    return " + ".join(f"{float(coef[n])} * -ln({names[a]} / ({names[a]} + {names[b]}))" for n, a, b in C.V0_TERMS)


@register("contrastive_loss_v1", _ct(f"select treatment, split, q_rid, round({_v1('1', C.V1_SWEEP)}, 6) as loss from cpiv"))
def q_contrastive_loss_v1(spark, sf_dir):
    return C.loss_v1(C.role_terms(_cosines(spark, sf_dir))).select(*C.QUERY, r6("loss"))


@register("contrastive_loss_v0", _ct(f"select treatment, split, q_rid, round({_v0('01', C.V0_SWEEP)}, 6) as loss from cpiv"))
def q_contrastive_loss_v0(spark, sf_dir):
    return C.loss_v0(C.role_terms(_cosines(spark, sf_dir), 0.1), C.V0_SWEEP).select(*C.QUERY, r6("loss"))


@register("contrastive_loss_legacy", _ct("""
select t.treatment, t.split, t.q_rid, t.m_rid, round(-ln((x + a) / (x + a + n + c)), 6) as loss
from (select treatment, split, q_rid, m_rid, exp(cos / 0.1) as x from ccos where role = 't_cf') t
join (select treatment, q_rid, coalesce(sum(exp(cos / 0.1)) filter (where role = 'approx'), 0) as a,
             coalesce(sum(exp(cos / 0.1)) filter (where role = 'negative'), 0) as n,
             coalesce(sum(exp(cos / 0.1)) filter (where role = 'c_cf'), 0) as c from ccos group by all) s
  on s.treatment = t.treatment and s.q_rid = t.q_rid"""))
def q_contrastive_loss_legacy(spark, sf_dir):
    """The sum-mode loss, a row per t_cf member."""
    return C.loss_legacy(_cosines(spark, sf_dir)).select(*C.QUERY, "m_rid", r6("loss"))


@register("contrastive_evaluation", _ct(f"""
select treatment, split, round(avg({_v0('01', C.V0_SWEEP)}), 6) as loss, round(avg({_v0('1', C.V0_FIXED)}), 6) as loss_fixed,
       count(*)::bigint as n_queries from cpiv group by all"""))
def q_contrastive_evaluation(spark, sf_dir):
    """Mean loss of the run's setting, and with temperature and coefficients 1 (Q24)."""
    e = C.evaluation(_cosines(spark, sf_dir), 0, C.V0_SWEEP, 0.1)
    return e.select("treatment", "split", r6("loss"), r6("loss_fixed"), "n_queries")


#: Loss version, name and coefficients of each run of the grid.
SETTINGS = [(1, "swept", C.V1_SWEEP), (1, "counterfactuals x3", {**C.V1_FIXED, "t_cf": 3, "c_cf": 3}), (1, "no approx", {**C.V1_FIXED, "approx": 0}),
            (0, "swept", C.V0_SWEEP), (0, "fixed", C.V0_FIXED)]
TEMPERATURES = {"1": 1.0, "01": 0.1}
_GRID = " union all ".join(
    f"select treatment, split, {v} as loss_version, '{name}' as coefficients, {t}::double as temperature, {(_v1 if v else _v0)(s, coef)} as loss from cpiv"
    for v, name, coef in SETTINGS for s, t in TEMPERATURES.items())


@register("loss_grid", _ct(f"""
select treatment, split, loss_version, coefficients, temperature, round(avg(loss), 6) as mean_loss, count(loss)::bigint as n_queries
from ({_GRID}) g group by all"""))
def q_loss_grid(spark, sf_dir):
    """Every (treatment, loss version, coefficient set, temperature) from one cosine pass."""
    return C.loss_grid(_cosines(spark, sf_dir), list(TEMPERATURES.values()), SETTINGS).withColumn("mean_loss", F.round("mean_loss", 6))


@register("loss_best", _ct(f"""
select treatment, split, loss_version, coefficients, temperature, mean_loss from (
  select *, row_number() over (partition by treatment, split, loss_version order by mean_loss, coefficients, temperature) as nth from (
    select treatment, split, loss_version, coefficients, temperature, round(avg(loss), 6) as mean_loss from ({_GRID}) g group by all) h) b where nth = 1"""))
def q_loss_best(spark, sf_dir):
    """The setting of least mean loss of each version (by name, then the lower temperature, at a tie), by min_by."""
    grid = q_loss_grid(spark, sf_dir)
    run = F.struct("coefficients", "temperature", "mean_loss")
    best = F.min_by(run, F.struct("mean_loss", "coefficients", "temperature")).alias("b")
    return grid.groupBy("treatment", "split", "loss_version").agg(best).select("treatment", "split", "loss_version", "b.*")


EVAL_SPLITS = ("validation", "test")
_EVAL_CTES = _views_sql("ev", f"fx_reviews where split in {EVAL_SPLITS}", "{}_aspect_majority", "id, original_id, description") + f""",
egen as (""" + " union all ".join(
    f"select '{t}' as treatment, g_id, split, original_id, text, intervention_aspect, "
    + ", ".join(f"{c}_predictions_generation as c{i + 1}" for i, c in enumerate(C.confounders(t))) + " from fx_accepted" for t in CONCEPTS) + f"""),
emem as (
  select s.treatment, s.split, s.id, g.g_id, case when g.intervention_aspect = s.treatment then 't_cf' else 'c_cf' end as role
  from ev s join egen g on g.treatment = s.treatment and g.split = s.split and g.original_id = s.original_id and g.text = s.description
  where case when g.intervention_aspect = s.treatment then g.c1 = s.c1 and g.c2 = s.c2 and g.c3 = s.c3 else g.intervention_aspect in ({O.CONS}) end),
eroles as (
  select s.treatment, s.split, s.id, (select count(*) from emem m where m.treatment = s.treatment and m.id = s.id and m.role = 't_cf')::bigint as n_tcf,
    (select count(*) from emem m where m.treatment = s.treatment and m.id = s.id and m.role = 'c_cf')::bigint as n_ccf,
    (select count(*) from ev r where r.treatment = s.treatment and r.split = s.split and r.original_id <> s.original_id
       and r.c1 = s.c1 and r.c2 = s.c2 and r.c3 = s.c3)::bigint as n_approx,
    (select count(*) from ev r where r.treatment = s.treatment and r.split = s.split and r.original_id <> s.original_id
       and not coalesce(r.c1 = s.c1 and r.c2 = s.c2 and r.c3 = s.c3, false))::bigint as n_negative
  from ev s)"""


def _eval_tables(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return tuple(t.where(F.col("split").isin(*EVAL_SPLITS)) for t in (fx.reviews, fx.accepted_generations))


@register("contrastive_eval_members", O.with_prelude("select * from emem", _EVAL_CTES))
def q_contrastive_eval_members(spark, sf_dir):
    """The members of t_cf and c_cf of every source, evaluation variant, four treatments."""
    return C.eval_members(*_eval_tables(spark, sf_dir))


@register("contrastive_eval_roles", O.with_prelude(
    "select * from eroles where n_tcf > 0 and n_ccf > 0 and n_approx > 0 and n_negative > 0", _EVAL_CTES))
def q_contrastive_eval_roles(spark, sf_dir):
    return C.eval_role_counts(*_eval_tables(spark, sf_dir))


# ---------------------------------------------------------------- phase 9: top-k sweep
SWEEP_K = 49


@register("topk_sweep", O.with_prelude(f"""
select k::bigint as k, split, concept, base_direction, target_direction, count(*)::bigint as n_pairs,
       count(err)::bigint as n_valid, round(avg(err), 6) as icace_error
from (
  select kk.k, c.split, c.concept, c.base_direction, c.target_direction, {O.l2('m.m', 'c.c')} as err
  from cells c cross join range(1, {SWEEP_K} + 1) kk(k)
  left join (
    select kk.k, r.qid, r.concept, r.label, avg(e.p1) as m1, avg(e.p2) as m2, avg(e.p3) as m3, avg(e.p4) as m4,
           avg(e.p5) as m5
    from ranked r join emb e on e.vec_id = r.cid % {O.N_EMB} join range(1, {SWEEP_K} + 1) kk(k) on r.rank <= kk.k
    where r.sim > 0.0 group by all) m
  on m.k = kk.k and m.qid = c.id_base and m.concept = c.concept and m.label = c.target_direction) z
group by all""", O.ranked_matches(SWEEP_K)))
def q_topk_sweep(spark, sf_dir):
    """49 matcher runs (k = 1..49) as ONE top-49 ranking plus running means."""
    _, ctx = context(spark, sf_dir)
    e = X.topk_sweep(ctx, SWEEP_K)
    return e.groupBy("k", "split", "concept", "base_direction", "target_direction").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_pairs"), F.count("icace_error").cast("bigint").alias("n_valid"),
        F.round(F.avg("icace_error"), 6).alias("icace_error")).withColumn("k", F.col("k").cast("bigint"))


# ---------------------------------------------------------------- phase 10: model jobs
from pairlens.operators import naive_bayes as NB  # noqa: E402

TRAIN_SPLIT = "train_exclusive"
ASPECTS = {f"{c}_class": 3 for c in CONCEPTS}


def _nb_sql(name: str, source: str, targets: dict[str, int]) -> str:
    """CTE {name}(id, target, class, score): log-scores of every text of {source} (id, description, split, a column a target)."""
    long = " union all ".join(f"select id, split, '{t}' as target, {t} as class from {source}" for t in targets)
    classes = " union all ".join(f"select '{t}' as target, c as class from range({k}) r(c)" for t, k in targets.items())
    return f"""
{name}_words as (
  select id, token, count(*) as n from (
    select id, unnest(regexp_extract_all(lower(description), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as token from {source}) w group by all),
{name}_long as ({long}),
{name}_train as (select * from {name}_long where split = '{TRAIN_SPLIT}' and class is not null),
{name}_classes as ({classes}),
{name}_priors as (
  select c.target, c.class, ln((count(t.id) + 1) / (any_value(a.n) + any_value(a.k))) as prior
  from {name}_classes c
  join (select c.target, count(distinct c.class) as k, (select count(*) from {name}_train t where t.target = c.target) as n from {name}_classes c group by c.target) a
    on a.target = c.target
  left join {name}_train t on t.target = c.target and t.class = c.class group by c.target, c.class),
{name}_counts as (select t.target, t.class, w.token, sum(w.n) as n from {name}_train t join {name}_words w on w.id = t.id group by all),
{name}_sizes as (select target, count(distinct token) as words from {name}_counts group by target),
{name}_totals as (select c.target, c.class, coalesce(sum(x.n), 0) as n from {name}_classes c left join {name}_counts x
                  on x.target = c.target and x.class = c.class group by all),
{name}_p as (
  select v.target, v.token, t.class, ln((coalesce(x.n, 0) + 1) / (t.n + s.words)) as p
  from (select distinct target, token from {name}_counts) v join {name}_totals t on t.target = v.target join {name}_sizes s on s.target = v.target
  left join {name}_counts x on x.target = v.target and x.token = v.token and x.class = t.class),
{name}_sums as (select w.id, p.target, p.class, sum(w.n * p.p) as s from {name}_words w join {name}_p p on p.token = w.token group by all),
{name} as (
  select i.id, r.target, r.class, round(coalesce(s.s, 0) + r.prior, 6) as score
  from (select id from {source}) i cross join {name}_priors r left join {name}_sums s on s.id = i.id and s.target = r.target and s.class = r.class),
{name}_best as (
  select *, row_number() over (partition by id, target order by score desc, class) as nth,
         1 / sum(exp(score - top)) over (partition by id, target) as confidence
  from (select *, max(score) over (partition by id, target) as top from {name}) b)"""


_CLASS = "case {} when 'unknown' then 0 when 'Negative' then 1 when 'Positive' then 2 end"
_ASPECT_CTES = "aset as (select id, split, description, " + ", ".join(
    f"{_CLASS.format(f'{c}_aspect_majority')} as {c}_class" for c in CONCEPTS) + " from fx_reviews)," + _nb_sql("anb", "aset", ASPECTS)
_ASPECT_ROWS = f"""
select l.id, l.split, left(l.target, length(l.target) - 6) as concept, l.class as label, b.class::int as prediction, b.confidence
from anb_long l join anb_best b on b.id = l.id and b.target = l.target and b.nth = 1 where l.class is not null"""


def aspect_predictions(spark, sf_dir) -> DataFrame:
    """The four aspects' classes of every review, learnt from the training split's labels."""
    fx = Fixtures(spark, sf_dir)
    rows = I.aspect_classes(fx.reviews)
    probs = aspect_model(fx).probabilities(rows.select("id", "description"), "id", "description")
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("concept"), F.col(f"{c}_class").alias("label"), F.col(f"{c}_class_probs").alias("aspect_probs"))
                                for c in CONCEPTS])).alias("a")
    long = rows.select("id", "split", *ASPECTS).join(probs, "id").select("id", "split", parts).select("id", "split", "a.*")
    return NB.predicted(long.where("label is not null"), "aspect")


@register("aspect_classifier", O.with_prelude(
    f"select id, split, concept, label, prediction, round(confidence, 4) as confidence from ({_ASPECT_ROWS}) a", _ASPECT_CTES))
def q_aspect_classifier(spark, sf_dir):
    p = aspect_predictions(spark, sf_dir)
    return p.select("id", "split", "concept", "label", "prediction", F.round("confidence", 4).alias("confidence"))


@register("accuracy_by_split", O.with_prelude(
    f"select concept, split, round(avg((label = prediction)::int), 6) as accuracy, count(*)::bigint as n from ({_ASPECT_ROWS}) a group by all", _ASPECT_CTES))
def q_accuracy_by_split(spark, sf_dir):
    """Accuracy of the aspect models per concept and split."""
    return M.accuracy(aspect_predictions(spark, sf_dir), "prediction", "label", by=("concept", "split")).select(
        "concept", "split", F.round("accuracy", 6).alias("accuracy"), "n")


_GEN_CTES = _ASPECT_CTES + """,
gwords as (select id, token, count(*) as n from (
  select g_id as id, unnest(regexp_extract_all(lower(generation), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as token from fx_clean) w group by all),
gsums as (select w.id, p.target, p.class, sum(w.n * p.p) as s from gwords w join anb_p p on p.token = w.token group by all),
gscore as (select i.g_id as id, r.target, r.class, round(coalesce(s.s, 0) + r.prior, 6) as score from fx_clean i cross join anb_priors r
           left join gsums s on s.id = i.g_id and s.target = r.target and s.class = r.class)"""


@register("generation_aspects", O.with_prelude("""
select id as g_id, left(target, length(target) - 6) as concept, case arg_min(class, (-score, class)) when 0 then 'unknown' when 1 then 'Negative' else 'Positive' end as prediction
from gscore group by id, target""", _GEN_CTES))
def q_generation_aspects(spark, sf_dir):
    """The four aspects of every clean generation, by the models learnt from reviews."""
    fx = Fixtures(spark, sf_dir)
    model = aspect_model(fx)
    probs = model.probabilities(fx.clean_generations.select("g_id", F.col("generation").alias("description")), "g_id", "description")
    return aspect_labels(probs, "g_id")


def aspect_model(fx: Fixtures) -> NB.NaiveBayes:
    rows = I.aspect_classes(fx.reviews)
    return NB.train(rows.where(F.col("split") == TRAIN_SPLIT), "id", "description", ASPECTS)


def aspect_labels(probs: DataFrame, key: str) -> DataFrame:
    """(key, concept, prediction): the label of each concept's greatest probability."""
    names = F.array(*[F.lit(ASPECT_CODE_TO_LABEL[i]) for i in range(3)])
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("concept"), F.element_at(names, (argmax(f"{c}_class_probs") + 1).cast("int")).alias("prediction"))
                                for c in CONCEPTS])).alias("a")
    return probs.select(key, parts).select(key, "a.*")


_PREDICTED = ", ".join(f"max(case when b.target = '{c}_class' then case b.class when 0 then 'unknown' when 1 then 'Negative' else 'Positive' end end) as {c}_pb" for c in CONCEPTS)


@register("icace_approx_predicted", O.with_prelude(f"""
select '{EXACT}' as explainer, c.split, c.pair_id, c.concept, c.base_direction, c.target_direction, round({O.l2('e.p', 'c.c')}, 6) as icace_error
from pb c left join (
  select * from (
    select b.id_base as qid, b.concept, b.target_direction as label, k.cid, row_number() over (partition by b.id_base, b.concept, b.target_direction
             order by round(list_dot_product(eq.u, ec.u), 9) desc, k.cid) as rk
    from (select distinct id_base, concept, target_direction, o1, o2, o3 from pb) b
    join cand k on k.concept = b.concept and k.label = b.target_direction and k.o1 = b.o1 and k.o2 = b.o2 and k.o3 = b.o3
    join emb eq on eq.vec_id = b.id_base % {O.N_EMB} join emb ec on ec.vec_id = k.cid % {O.N_EMB}) z where rk = 1) x
  on x.qid = c.id_base and x.concept = c.concept and x.label = c.target_direction
left join emb e on e.vec_id = x.cid % {O.N_EMB}""", _ASPECT_CTES + f""",
plabels as (select b.id, {_PREDICTED} from anb_best b where b.nth = 1 group by b.id),
pb as (select c.*, {_OTHERS_SQL.replace('c.', 'l.').replace('case l.concept', 'case c.concept')} from cells c join plabels l on l.id = c.id_base)"""))
def q_icace_approx_predicted(spark, sf_dir):
    """J4/J7 with the bases' confounders as the aspect models predict them."""
    fx, ctx = context(spark, sf_dir)
    probs = aspect_model(fx).probabilities(fx.explained_reviews.select("id", "description"), "id", "description")
    wide = aspect_labels(probs, "id").groupBy("id").pivot("concept", list(CONCEPTS)).agg(F.first("prediction"))
    # a row of labels a base, read for the queries of the search and for the pairs
    ctx.base_predictions = cut_lineage(wide.withColumnsRenamed({c: f"{c}_prediction" for c in CONCEPTS}))
    return _errors_out(X.ApproxExplainer(exact=True).pair_errors(ctx))


_SCORES = {"score_class": 5}
_SCORE_CTES = f"""
sset as (select id, split, description, case review_majority {" ".join(f"when '{k}' then {v}" for k, v in SCORE_ENCODINGS['5-way'].items())} end as score_class
         from fx_reviews where not (split like 'train%' and review_majority = 'no majority')),""" + _nb_sql("snb", "sset", _SCORES)


@register("sentiment_classifier", O.with_prelude("""
select l.id, l.split, l.class as label, b.class::int as prediction, round(b.confidence, 4) as confidence
from snb_long l join snb_best b on b.id = l.id and b.nth = 1 where l.class is not null""", _SCORE_CTES))
def q_sentiment_classifier(spark, sf_dir):
    """R2: 5-way review-score model; predictions for every encodable review."""
    enc = I.encode_reviews(Fixtures(spark, sf_dir).reviews, "5-way").withColumnRenamed("review_majority", "score_class")
    model = NB.train(enc.where(F.col("split") == TRAIN_SPLIT), "id", "description", _SCORES)
    probs = model.probabilities(enc.select("id", "description"), "id", "description")
    p = NB.predicted(enc.where("score_class is not null").select("id", "split", F.col("score_class").alias("label")).join(probs, "id"), "score_class")
    return p.select("id", "split", "label", "prediction", F.round("confidence", 4).alias("confidence"))


# ---------------------------------------------------------------- phase 11: vectors by version, batches, drop counts
from pairlens.operators.sampling import seeded_positions  # noqa: E402
from pairlens.operators.vector_store import VectorStore  # noqa: E402
from pairlens.session import ensure_checkpoint_dir  # noqa: E402

_CHANGED = "case when id % 3 = 0 then description || ' again' else description end"


@register("vectors_latest", O.with_prelude(f"""
select r.id as text_id, (case when id % 3 = 0 then 2 else 1 end)::int as build, sha256(coalesce({_CHANGED}, '')) as text_hash, round(e.embedding[1]::double, 6) as v1
from fx_reviews r join embeddings e on e.vec_id = (r.id + case when id % 3 = 0 then {MODELS['shift-7']} else 0 end) % {O.N_EMB}"""))
def q_vectors_latest(spark, sf_dir):
    """Two builds of a vector store; the second, of a refreshed model, embeds the changed texts alone."""
    fx = Fixtures(spark, sf_dir)
    first = fx.reviews.select(F.col("id").alias("text_id"), F.col("description").alias("text"))
    second = fx.reviews.select(F.col("id").alias("text_id"), F.expr(_CHANGED).alias("text"))
    store = VectorStore(spark, f"{ensure_checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}")
    for build, texts, vectors in ((1, first, "base"), (2, second, "shift-7")):
        store.refresh(texts, "embedder", build, lambda t, v=vectors: t.select("text_id").join(fx.vectors(v).select("text_id", "vec"), "text_id"))
    return store.latest("embedder").select("text_id", "build", "text_hash", F.round(F.element_at("vec", 1), 6).alias("v1"))


BATCH_TEXTS = 32


@register("batch_order", O.with_prelude(f"""
select split, (nth // {BATCH_TEXTS})::bigint as batch, (nth % {BATCH_TEXTS})::bigint as place, rid from (
  select split, rid, row_number() over (partition by split order by {O._md5('rid')}, rid) - 1 as nth from fx_full_set) b"""))
def q_batch_order(spark, sf_dir):
    """T4: all texts in seeded order, in batches with gapless numbers, for each split."""
    placed = seeded_positions(Fixtures(spark, sf_dir).mining_set.select("split", "rid"), ["split"], "rid", DEFAULT_SEED)
    return placed.select("split", F.floor(F.col("_pos") / BATCH_TEXTS).alias("batch"), F.pmod("_pos", F.lit(BATCH_TEXTS)).alias("place"), "rid")


@register("review_drops", O.with_prelude("""
select split, count(*)::bigint as n_reviews, count(*) filter (where split like 'train%' and review_majority = 'no majority')::bigint as n_no_majority,
  floor(100 * count(*) filter (where split like 'train%' and review_majority = 'no majority') / count(*))::bigint as pct_dropped
from fx_reviews group by split"""))
def q_review_drops(spark, sf_dir):
    """A11 of F7: reviews without a majority that each split loses."""
    return I.drop_counts(Fixtures(spark, sf_dir).reviews)


@register("pair_drops", O.with_prelude("""
select split, kind, count(*)::bigint as n_pairs, count(*) filter (where iab = iac)::bigint as n_unchanged,
  floor(100 * count(*) filter (where iab = iac) / count(*))::bigint as pct_dropped
from (select *, case it """ + " ".join(f"when '{c}' then {c}_b" for c in CONCEPTS) + " end as iab, case it " + " ".join(f"when '{c}' then {c}_k" for c in CONCEPTS)
    + """ end as iac from (select *, coalesce(et_b, et_k) as it from pairs_raw) p0) p1 group by all"""))
def q_pair_drops(spark, sf_dir):
    """A11 of F13: pairs whose intervened label did not change."""
    return pair_drop_counts(mine_pairs(Fixtures(spark, sf_dir).reviews, LABEL_COLS, drop_unchanged=False))


# ---------------------------------------------------------------- phase 12: the expanded candidate set
_X_ID = "cast(2 * c.id_base as varchar) || ':' || cast(2 * c.id_counterfactual as varchar) as pair_id"


@register("matching_set", O.with_prelude(
    "select rid, src, k, original_id, generation_index, " + ", ".join(f"{c}_label, {c}_predictions" for c in CONCEPTS) + " from fx_expanded"))
def q_matching_set(spark, sf_dir):
    """U4: sources of the matching half and the accepted generations of their reviews."""
    return Fixtures(spark, sf_dir).expanded_matching_set.drop("has_text")


def expanded_context(spark, sf_dir) -> X.ExplainContext:
    """The explained pairs against the expanded set. Reviews and generations have ids of their own there: 2 * id and
    2 * id + 1, for pairs and vectors too."""
    fx, ctx = context(spark, sf_dir)
    pairs = ctx.pairs.withColumns({c: F.col(c) * 2 for c in ("id_base", "id_counterfactual")})
    vectors = fx.vectors()
    both = vectors.select(F.explode(F.array(F.col("text_id") * 2, F.col("text_id") * 2 + 1)).alias("text_id"), "vec")
    return X.ExplainContext(pairs=pairs, matching_set=fx.expanded_matching_set.withColumnRenamed("rid", "id"),
                            generations=ctx.generations, embeddings=both, seed=ctx.seed)


@register("icace_matching_expanded", O.with_prelude(f"""
select '{MATCH_A1}' as explainer, c.split, {_X_ID}, c.concept, c.base_direction, c.target_direction, round({O.l2('m.m', 'c.c')}, 6) as icace_error
from cells c left join (
  select r.qid, r.concept, r.label, avg(e.p1) as m1, avg(e.p2) as m2, avg(e.p3) as m3, avg(e.p4) as m4, avg(e.p5) as m5
  from (select *, row_number() over (partition by concept, label, qid order by round(sim, 9) desc, cid) as rank from (
          select q.qid, q.concept, q.label, c.cid, c.k, list_dot_product(eq.u, ec.u) as sim
          from (select distinct id_base as qid, concept, target_direction as label from cells) q
          join xcand c on c.concept = q.concept and c.label = q.label
          join emb eq on eq.vec_id = q.qid % {O.N_EMB} join emb ec on ec.vec_id = c.k % {O.N_EMB}) s) r
  join emb e on e.vec_id = r.k % {O.N_EMB} where r.rank <= {FLAGSHIP_K} and r.sim > 0.0 group by all) m
on m.qid = c.id_base and m.concept = c.concept and m.label = c.target_direction"""))
def q_icace_matching_expanded(spark, sf_dir):
    """E2 over U4: matches may be generations."""
    return _errors_out(X.MatchingExplainer(top_k=FLAGSHIP_K).pair_errors(expanded_context(spark, sf_dir)))


@register("icace_approx_expanded", O.with_prelude(f"""
select '{EXACT}' as explainer, c.split, {_X_ID}, c.concept, c.base_direction, c.target_direction, round({O.l2('e.p', 'c.c')}, 6) as icace_error
from xb c left join (
  select * from (
    select b.id_base as qid, b.concept, b.target_direction as label, k.k, row_number() over (partition by b.id_base, b.concept, b.target_direction, b.o1, b.o2, b.o3
             order by round(list_dot_product(eq.u, ec.u), 9) desc, k.cid) as rk, b.o1, b.o2, b.o3
    from (select distinct id_base, concept, target_direction, o1, o2, o3 from xb) b
    join xcand k on k.concept = b.concept and k.label = b.target_direction and k.o1 = b.o1 and k.o2 = b.o2 and k.o3 = b.o3
    join emb eq on eq.vec_id = b.id_base % {O.N_EMB} join emb ec on ec.vec_id = k.k % {O.N_EMB}) z where rk = 1) x
  on x.qid = c.id_base and x.concept = c.concept and x.label = c.target_direction and x.o1 = c.o1 and x.o2 = c.o2 and x.o3 = c.o3
left join emb e on e.vec_id = x.k % {O.N_EMB}""", f"xb as (select c.*, {_OTHERS_SQL} from cells c)"))
def q_icace_approx_expanded(spark, sf_dir):
    """E3 over U4: the confounder match may be a generation."""
    return _errors_out(X.ApproxExplainer(exact=True).pair_errors(expanded_context(spark, sf_dir)))
