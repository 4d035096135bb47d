"""Contrastive set mining and metrics.

For a query text and a treatment concept T (confounders C = the other three), within one split:

* ``t_cf``  same-original rows whose T prediction differs, that intervene on T or are
  sources, with all confounder predictions equal (J15);
* ``c_cf``  same-original rows with equal T prediction, that intervene on a confounder
  or are sources, with exactly two of three confounders equal (J16);
* ``approx``  rows of OTHER originals with all confounder predictions equal (J13);
* ``negative``  every other row (J14; train variant keeps same-original rows).

``treatment`` and ``split`` are keys of every table, so the four treatments and all splits are
one plan. t_cf / c_cf are within-original equi-joins (keys: original + confounders, or original +
treatment). approx / negative are never materialised: their sizes come from one pass of grouping
sets over the leave-one-out confounder keys, and their <= 5 sampled members from ranks drawn
without replacement (Floyd's method on hashes), found by an equi-join on a place in one order in
which a confounder group, and in it an original, stand together.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.constants import CONCEPTS, DEFAULT_SEED, EXAMPLES_PER_ROLE, ROLES
from pairlens.functions.seeded import distinct_draws, md5_order
from pairlens.functions.vectors import cosine, exp_logit, l2_norm
from pairlens.operators.ingest import parse_generation_index
from pairlens.operators.scoring import VECTOR, attach_vectors
from pairlens.session import cut_lineage

T_CF, C_CF, APPROX, NEGATIVE = ROLES
#: A table of queries or of what belongs to one is keyed by these.
QUERY = ["treatment", "split", "q_rid"]
CONF = ["c1", "c2", "c3"]
#: Slices of a confounder group in the common order: each is sorted by one task.
ORDER_DIGITS = 2


def confounders(treatment: str) -> list[str]:
    return [c for c in CONCEPTS if c != treatment]


def query_rows(full_set: DataFrame, generation_index: str = "-1") -> DataFrame:
    """F17 + X14: queries are rows with a listed generation index and a text longer than 2."""
    idx = parse_generation_index(generation_index)
    size = F.col("text_len") if "text_len" in full_set.columns else F.char_length("text")
    return full_set.where(F.col("generation_index").isin(idx) & (size > 2))


def by_treatment(rows: DataFrame, carried=("text", "intervention_aspect", "generation_index")) -> DataFrame:
    """One row per row and treatment: its prediction as ``t``, the confounders' as ``c1`` .. ``c3`` in the concepts' order."""
    views = F.array(*[F.struct(F.lit(t).alias("treatment"), F.col(f"{t}_predictions").alias("t"),
                               *[F.col(f"{c}_predictions").alias(k) for k, c in zip(CONF, confounders(t))]) for t in CONCEPTS])
    return rows.select("split", "rid", "original_id", *carried, F.explode(views).alias("v")).select("v.*", "split", "rid", "original_id", *carried)


def _sides(members: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    q = by_treatment(queries).select("treatment", "split", F.col("rid").alias("q_rid"), "original_id", F.col("text").alias("q_text"),
                                     F.col("t").alias("q_t"), *[F.col(c).alias(f"q_{c}") for c in CONF])
    m = by_treatment(members).select(F.col("treatment").alias("m_treatment"), F.col("split").alias("m_split"), F.col("rid").alias("m_rid"),
                                     F.col("original_id").alias("m_orig"), F.col("text").alias("m_text"), F.col("t").alias("m_t"),
                                     "intervention_aspect", "generation_index", *[F.col(c).alias(f"m_{c}") for c in CONF])
    return q, m


def _same_original() -> list[Column]:
    return [F.col("treatment") == F.col("m_treatment"), F.col("split") == F.col("m_split"), F.col("original_id") == F.col("m_orig")]


def _not_self() -> Column:
    return (F.col("m_rid") != F.col("q_rid")) & F.coalesce(F.col("m_text") != F.col("q_text"), F.lit(True))


def _is_source() -> Column:
    return F.col("generation_index") == -1


def treatment_members(full_set: DataFrame, queries: DataFrame) -> DataFrame:
    """(treatment, split, q_rid, m_rid) of t_cf; equi-join on original + the three confounder predictions."""
    q, m = _sides(full_set, queries)
    m = m.where((F.col("intervention_aspect") == F.col("m_treatment")) | _is_source())
    j = q.join(m, [*_same_original(), *[F.col(f"q_{c}") == F.col(f"m_{c}") for c in CONF]])
    # Q2: a null treatment prediction counts as different
    differs = F.coalesce(F.col("m_t") != F.col("q_t"), F.lit(True))
    return j.where(_not_self() & differs).select(*QUERY, "m_rid")


def confounder_members(full_set: DataFrame, queries: DataFrame) -> DataFrame:
    """(treatment, split, q_rid, m_rid) of c_cf; equi-join on original + treatment prediction, 2 of 3 confounders equal."""
    q, m = _sides(full_set, queries)
    m = m.where((F.col("intervention_aspect").isin(*CONCEPTS) & (F.col("intervention_aspect") != F.col("m_treatment"))) | _is_source())
    j = q.join(m, [*_same_original(), F.col("q_t") == F.col("m_t")])
    n_eq = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"m_{c}") == F.col(f"q_{c}"), F.lit(False)).cast("int") for c in CONF])
    return j.where(_not_self() & (n_eq == len(CONF) - 1)).select(*QUERY, "m_rid")


def _all_not_null(cols) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def group_sizes(full_set: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes of confounder groups, of originals in them, and of splits, from one scan.

    (treatment, split, c1..c3, n_g), (treatment, split, original_id, c1..c3, n_go) and (split, n_all). Rows are counted by
    all four predictions and the original; grouping sets then leave out one concept (the treatment), with and
    without the original. Groups with a null confounder are left out: they equal nothing.
    """
    preds = [f"{c}_predictions" for c in CONCEPTS]
    cells = full_set.groupBy("split", "original_id", *preds).agg(F.count(F.lit(1)).alias("n"))
    sets = [["split"]] + [["split", *extra, *[f"{c}_predictions" for c in confounders(t)]] for t in CONCEPTS for extra in ([], ["original_id"])]
    out_of = {t: F.grouping(f"{t}_predictions") == 1 for t in CONCEPTS}
    dropped = reduce(lambda a, b: a + b, [F.grouping(p).cast("int") for p in preds])
    treatment = F.when(dropped == 1, reduce(lambda e, t: F.when(out_of[t], F.lit(t)).otherwise(e), reversed(CONCEPTS), F.lit(None).cast("string")))
    sums = cells.groupingSets(sets, "split", "original_id", *preds).agg(
        treatment.alias("treatment"), (F.grouping("original_id") == 0).alias("by_original"), F.sum("n").alias("n"))
    conf = [reduce(lambda e, t: F.when(F.col("treatment") == t, F.col(f"{confounders(t)[i]}_predictions")).otherwise(e), CONCEPTS, F.lit(None).cast("string")).alias(k)
            for i, k in enumerate(CONF)]
    # eight sets over one compact table: written once, as three tables are read from it
    sums = cut_lineage(sums.select("treatment", "split", "original_id", "by_original", *conf, "n"))
    keyed = sums.where(_all_not_null(["treatment", *CONF]))
    return (keyed.where("not by_original").select("treatment", "split", *CONF, F.col("n").alias("n_g")),
            keyed.where("by_original").select("treatment", "split", "original_id", *CONF, F.col("n").alias("n_go")),
            sums.where("treatment is null").select("split", F.col("n").alias("n_all")))


def role_counts(full_set: DataFrame, queries: DataFrame, tcf: DataFrame, ccf: DataFrame) -> DataFrame:
    """Per query: |t_cf|, |c_cf|, |approx| (group counts), |negative| = N - 1 - |approx| of its split (train variant)."""
    groups, originals, splits = group_sizes(full_set)
    q = by_treatment(queries).select("treatment", "split", F.col("rid").alias("q_rid"), "original_id", *CONF)
    q = q.join(groups, ["treatment", "split", *CONF], "left").join(originals, ["treatment", "split", "original_id", *CONF], "left").join(splits, "split")
    for members, name in ((tcf, "n_tcf"), (ccf, "n_ccf")):
        q = q.join(members.groupBy(*QUERY).agg(F.count(F.lit(1)).alias(name)), QUERY, "left")
    n_approx = F.coalesce(F.col("n_g"), F.lit(0)) - F.coalesce(F.col("n_go"), F.lit(0))
    return q.select(*QUERY, F.coalesce("n_tcf", F.lit(0)).cast("bigint").alias("n_tcf"), F.coalesce("n_ccf", F.lit(0)).cast("bigint").alias("n_ccf"),
                    n_approx.cast("bigint").alias("n_approx"), (F.col("n_all") - 1 - n_approx).cast("bigint").alias("n_negative"))


def kept_queries(counts: DataFrame) -> DataFrame:
    """Approach 'all' keeps queries whose four roles are all non-empty."""
    return counts.where((F.col("n_tcf") > 0) & (F.col("n_ccf") > 0) & (F.col("n_approx") > 0)
                        & (F.col("n_negative") > 0))


def _sample_listed(members: DataFrame, role: str, seed: int, n: int) -> DataFrame:
    """The first ``n`` members by a hash of treatment, query and member: every subset of that size is equally likely."""
    w = Window.partitionBy(*QUERY).orderBy(md5_order(seed, "treatment", "q_rid", "m_rid"), "m_rid")
    return (members.withColumn("j", F.row_number().over(w) - 1).where(F.col("j") < n)
            .select(*QUERY, F.lit(role).alias("role"), "m_rid", F.col("j").cast("bigint").alias("j")))


def common_order(rows: DataFrame, seed: int) -> DataFrame:
    """(treatment, split, rid, original_id, c1..c3, place): the rows of each treatment and split from 0 on, ordered by
    confounders (null first), the original's hash, the original, the row's hash, the row.

    Rows are cut into slices by the first digits of the original's hash; a slice's rows are numbered by one task, and
    slices, a few hundred a group of a fixed label domain, by their counts.
    """
    hashed = rows.withColumns({"oh": md5_order(seed, "original_id"), "rh": md5_order(seed, "rid")})  # once for the four treatments
    d = by_treatment(hashed, ("oh", "rh")).select("treatment", "split", "rid", "original_id", *CONF, "oh", "rh")
    d = d.withColumn("slice", F.substr("oh", F.lit(1), F.lit(ORDER_DIGITS)))
    slices = d.groupBy("treatment", "split", *CONF, "slice").agg(F.count(F.lit(1)).alias("held"))
    ahead = Window.partitionBy("treatment", "split").orderBy(*[F.col(c).asc_nulls_first() for c in CONF], "slice").rowsBetween(Window.unboundedPreceding, -1)
    own = ["treatment", "split", *CONF, "slice"]
    slices = slices.select(*[F.col(c).alias(f"s_{c}") for c in own], F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy(*own).orderBy("oh", "original_id", "rh", "rid")
    placed = d.withColumn("nth", F.row_number().over(inside)).join(slices, [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in own])
    return placed.select("treatment", "split", "rid", "original_id", *CONF, (F.col("ahead") + F.col("nth") - 1).cast("bigint").alias("place"))


def sample_members(full_set: DataFrame, queries: DataFrame, tcf: DataFrame, ccf: DataFrame,
                   seed: int = DEFAULT_SEED, n: int = EXAMPLES_PER_ROLE) -> DataFrame:
    """At most ``n`` members per (query, role), a uniform sample without replacement: (treatment, split, q_rid, role, m_rid, j).

    ``queries``: (treatment, split, q_rid). The approx role is the query's confounder group less its original's stretch
    there, the negative role everything before and behind the group and that stretch less the query; a rank in a
    role is a place in the common order by arithmetic on where group and stretch begin.
    """
    # narrow rows, read for the groups, the originals and the members
    rows = cut_lineage(common_order(full_set, seed))
    keys = ["treatment", "split"]
    groups = rows.groupBy(*keys, *CONF).agg(F.min("place").alias("g_from"), F.count(F.lit(1)).alias("n_g"))
    originals = rows.groupBy(*keys, *CONF, "original_id").agg(F.min("place").alias("o_from"), F.count(F.lit(1)).alias("n_o"))
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_all"))
    q = queries.select(*QUERY).join(rows.withColumnRenamed("rid", "q_rid"), QUERY).join(totals, keys)
    q = q.join(groups, [*keys, *CONF], "left").join(originals, [*keys, *CONF, "original_id"], "left")
    # a query with a null confounder has no approx role: its group and stretch are itself
    keyed = _all_not_null(CONF)
    q = q.select(*QUERY, "n_all", "place", *[F.when(keyed, F.col(c)).otherwise(other).alias(c) for c, other in (
        ("g_from", F.col("place")), ("n_g", F.lit(1)), ("o_from", F.col("place")), ("n_o", F.lit(1)))])
    ranks = [(APPROX, F.col("n_g") - F.col("n_o")), (NEGATIVE, F.col("n_all") - 1 - F.col("n_g") + F.col("n_o"))]
    draws = F.explode(F.array(*[F.struct(F.lit(role).alias("role"), distinct_draws(seed, size, n, "treatment", "q_rid", F.lit(role)).alias("ranks"))
                                for role, size in ranks])).alias("d")
    d = q.select("*", draws).select("*", "d.role", F.posexplode("d.ranks").alias("j", "r")).drop("d")
    r = F.col("r")
    approx = F.col("g_from") + F.when(r < F.col("o_from") - F.col("g_from"), r).otherwise(r + F.col("n_o"))
    inside = F.col("o_from") + r - F.col("g_from")
    negative = (F.when(r < F.col("g_from"), r)
                .when(r < F.col("g_from") + F.col("n_o") - 1, F.when(inside < F.col("place"), inside).otherwise(inside + 1))
                .otherwise(r - F.col("n_o") + 1 + F.col("n_g")))
    d = d.select(*QUERY, "role", F.col("j").cast("bigint").alias("j"), F.when(F.col("role") == APPROX, approx).otherwise(negative).alias("place"))
    drawn = d.join(rows.select(*keys, "place", F.col("rid").alias("m_rid")), [*keys, "place"]).select(*QUERY, "role", "m_rid", "j")
    return _sample_listed(tcf, T_CF, seed, n).unionByName(_sample_listed(ccf, C_CF, seed, n)).unionByName(drawn)


def member_cosines(samples: DataFrame, full_set: DataFrame, embeddings: DataFrame) -> DataFrame:
    """cos(query vector, member vector) per sampled member."""
    ids = samples.select(F.col("q_rid").alias("rid")).union(samples.select(F.col("m_rid").alias("rid"))).distinct()
    keys = full_set.select("rid", "k").join(ids, "rid", "left_semi")
    v = attach_vectors(keys, embeddings, "k")
    v = v.select("rid", F.col(VECTOR).alias("v"), l2_norm(VECTOR).alias("n"))
    qv = v.select(F.col("rid").alias("q_rid"), F.col("v").alias("qv"), F.col("n").alias("qn"))
    mv = v.select(F.col("rid").alias("m_rid"), F.col("v").alias("mv"), F.col("n").alias("mn"))
    s = samples.join(mv, "m_rid").join(qv, "q_rid")  # ends by query, as the terms are summed
    # through a generator, so that it is not computed again for each use
    return s.withColumn("cos", F.explode(F.array(cosine("qv", "mv", "qn", "mn")))).drop("qv", "mv", "qn", "mn")


def role_terms(cos: DataFrame, temperature: float | Column = 1.0, mean_loss: bool = True) -> DataFrame:
    """Per (query, role): mean cosine and mean/sum of exp(cos / T)."""
    agg = F.avg if mean_loss else F.sum
    return cos.groupBy(*QUERY, "role").agg(F.avg("cos").alias("mean_cos"), agg(exp_logit("cos", temperature)).alias("term"))


def _pivot_terms(terms: DataFrame, value: str, keys=tuple(QUERY)) -> DataFrame:
    return terms.groupBy(*keys).agg(*[F.max(F.when(F.col("role") == r, F.col(value))).alias(r) for r in ROLES])


# ---- fixed values: names of the six pairwise terms and the pairs of roles that they weigh ----
V0_TERMS = (("tcf_cfc", T_CF, C_CF), ("tcf_pax", T_CF, APPROX), ("tcf_nax", T_CF, NEGATIVE),
            ("pax_cfc", APPROX, C_CF), ("pax_nax", APPROX, NEGATIVE), ("cfc_nax", C_CF, NEGATIVE))
# ---- fixed values: coefficients of the two published grids ----
V0_SWEEP = {"tcf_cfc": 1, "tcf_pax": 1, "tcf_nax": 0, "pax_nax": 0, "pax_cfc": 1, "cfc_nax": 0}
V1_SWEEP = {T_CF: 1, APPROX: 1, NEGATIVE: 1, C_CF: 1}
# ---- end of fixed values ----
V0_FIXED = {name: 1 for name, _, _ in V0_TERMS}
V1_FIXED = {role: 1 for role in ROLES}


def v1_column(coef: dict | None = None, of: str = "{}") -> Column:
    """A12 over pivoted role terms: -ln(P / (P + N)), P = t_cf + approx, N = negative + c_cf; absent role or coef 0 -> 0 (Q23).
    ``of``: name of a role's column."""
    coef = coef or V1_FIXED

    def term(r):
        return F.lit(0.0) if coef[r] == 0 else F.coalesce(F.lit(float(coef[r])) * F.col(of.format(r)), F.lit(0.0))

    pos = term(T_CF) + term(APPROX)
    return -F.log(pos / (pos + term(NEGATIVE) + term(C_CF)))


def v0_column(coef: dict | None = None, of: str = "{}") -> Column:
    """A13 over pivoted role terms: sum of six weighted -ln(a / (a + b)); an empty role makes the loss null (Q23)."""
    coef = coef or V0_FIXED
    col = {r: F.col(of.format(r)) for r in ROLES}
    return reduce(lambda x, y: x + y, [F.lit(float(coef[name])) * -F.log(col[a] / (col[a] + col[b]))
                                       for name, a, b in V0_TERMS])


def _terms_at(cos: DataFrame, temperatures: list[float]) -> DataFrame:
    """Per query the mean of exp(cos / T) of each role at the i-th temperature as {role}_{i}, from one pass over the cosines."""
    terms = cos.groupBy(*QUERY, "role").agg(*[F.avg(exp_logit("cos", F.lit(float(t)))).alias(f"term_{i}") for i, t in enumerate(temperatures)])
    return terms.groupBy(*QUERY).agg(*[F.max(F.when(F.col("role") == r, F.col(f"term_{i}"))).alias(f"{r}_{i}") for r in ROLES for i in range(len(temperatures))])


def loss_v1(terms: DataFrame, coef: dict | None = None) -> DataFrame:
    return _pivot_terms(terms, "term").select(*QUERY, v1_column(coef).alias("loss"))


def loss_v0(terms: DataFrame, coef: dict | None = None) -> DataFrame:
    return _pivot_terms(terms, "term").select(*QUERY, v0_column(coef).alias("loss"))


def loss_legacy(cos: DataFrame, temperature: float = 0.1, coef: dict | None = None) -> DataFrame:
    """A14 (sum mode): a row per t_cf member, its own logit plus the query's approx sum against the sums of the
    other roles; a coefficient of 0 leaves a role out."""
    coef = coef or V1_FIXED
    own = cos.withColumn("logit", reduce(lambda e, r: F.when(F.col("role") == r, exp_logit("cos", temperature, coef[r])).otherwise(e),
                                         ROLES, F.lit(None).cast("double")))
    whole = Window.partitionBy(*QUERY)
    of = {r: F.coalesce(F.sum(F.when(F.col("role") == r, F.col("logit"))).over(whole), F.lit(0.0)) for r in (APPROX, NEGATIVE, C_CF)}
    rows = own.select(*QUERY, "role", "m_rid", "logit", *[v.alias(f"s_{r}") for r, v in of.items()]).where(F.col("role") == T_CF)
    pos = F.col("logit") + F.col(f"s_{APPROX}")
    return rows.select(*QUERY, "m_rid", (-F.log(pos / (pos + F.col(f"s_{NEGATIVE}") + F.col(f"s_{C_CF}")))).alias("loss"))


def loss_grid(cos: DataFrame, temperatures: list[float], settings: list[tuple[int, str, dict]]) -> DataFrame:
    """Mean loss of each (version, coefficient set) at each temperature, from one pass over the member cosines."""
    wide = _terms_at(cos, temperatures)
    losses = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.lit(version).alias("loss_version"), F.lit(name).alias("coefficients"),
                                          (v1_column if version else v0_column)(coef, f"{{}}_{i}").alias("loss"))
                                 for version, name, coef in settings for i, t in enumerate(temperatures)]))
    rows = wide.select("treatment", "split", losses.alias("l")).select("treatment", "split", "l.*")
    return rows.groupBy("treatment", "split", "loss_version", "coefficients", "temperature").agg(
        F.avg("loss").alias("mean_loss"), F.count("loss").cast("bigint").alias("n_queries"))


def role_similarity(terms: DataFrame) -> DataFrame:
    """Mean over queries of the per-query mean cosine, per role."""
    return terms.groupBy("treatment", "split", "role").agg(F.avg("mean_cos").alias("mean_sim"), F.count(F.lit(1)).cast("bigint").alias("n_queries"))


def evaluation(cos: DataFrame, version: int, coef: dict, temperature: float) -> DataFrame:
    """The mean loss with the run's coefficients and temperature and with all coefficients and the temperature 1."""
    column = v1_column if version else v0_column
    both = _terms_at(cos, [temperature, 1.0]).select("treatment", "split", column(coef, "{}_0").alias("loss"), column(None, "{}_1").alias("loss_fixed"))
    return both.groupBy("treatment", "split").agg(
        F.avg("loss").alias("loss"), F.avg("loss_fixed").alias("loss_fixed"), F.count(F.lit(1)).cast("bigint").alias("n_queries"))


def order_relation(sim: DataFrame) -> DataFrame:
    """Four differences of role means and the all-positive flag."""
    p = _pivot_terms(sim, "mean_sim", ("treatment", "split"))
    d = p.select("treatment", "split", (F.col(T_CF) - F.col(APPROX)).alias("differences_positive"),
                 (F.col(C_CF) - F.col(NEGATIVE)).alias("differences_negative"),
                 (F.col(APPROX) - F.col(NEGATIVE)).alias("differences_samples"),
                 (F.col(T_CF) - F.col(C_CF)).alias("differences_counterfactuals"))
    flag = reduce(lambda a, b: a & b, [F.col(c) > 0 for c in d.columns if c.startswith("differences")])
    return d.withColumn("is_order_relation", flag.cast("int"))


# ---------------------------------------------------------------- evaluation variant
def _eval_sources(sources: DataFrame) -> DataFrame:
    views = F.array(*[F.struct(F.lit(t).alias("treatment"), *[F.col(f"{c}_aspect_majority").alias(k) for k, c in zip(CONF, confounders(t))])
                      for t in CONCEPTS])
    return sources.select("split", "id", "original_id", F.sha2("description", 256).alias("text"), F.explode(views).alias("v")).select(
        "v.*", "split", "id", "original_id", "text")


def eval_members(sources: DataFrame, generations: DataFrame) -> DataFrame:
    """(treatment, split, id, role, g_id) of every source review, evaluation variant (Q9).

    t_cf: generations written from this exact source (same original and text) that intervene on the treatment
    and keep every confounder's predicted label equal to the source's label; c_cf: the other generations of that
    slice that intervene on a confounder. Texts meet as hashes.
    """
    s = _eval_sources(sources)
    g = generations.select(F.col("split").alias("g_split"), F.col("original_id").alias("g_orig"), F.sha2("text", 256).alias("g_text"), "g_id",
                           "intervention_aspect", *[f"{c}_predictions_generation" for c in CONCEPTS])
    j = s.join(g, [F.col("split") == F.col("g_split"), F.col("original_id") == F.col("g_orig"), F.col("text") == F.col("g_text")])
    kept = reduce(lambda e, t: F.when(F.col("treatment") == t, reduce(lambda a, b: a & b, [
        F.coalesce(F.col(f"{c}_predictions_generation") == F.col(k), F.lit(False)) for k, c in zip(CONF, confounders(t))])).otherwise(e),
        CONCEPTS, F.lit(None).cast("boolean"))
    own = F.col("intervention_aspect") == F.col("treatment")
    role = F.when(own & kept, F.lit(T_CF)).when(F.col("intervention_aspect").isin(*CONCEPTS) & ~own, F.lit(C_CF))
    return j.withColumn("role", role).where("role is not null").select("treatment", "split", "id", "role", "g_id")


def eval_role_counts(sources: DataFrame, generations: DataFrame) -> DataFrame:
    """J11-J14, J17, evaluation variant (Q10): sizes of the four roles of each source that has all of them.

    approx: sources of OTHER originals of the split with equal confounder labels; negative: the remaining sources of
    other originals.
    """
    members = eval_members(sources, generations).groupBy("treatment", "split", "id").agg(
        F.count_if(F.col("role") == T_CF).alias("n_tcf"), F.count_if(F.col("role") == C_CF).alias("n_ccf"))
    s = _eval_sources(sources).drop("text")
    cells = s.where(_all_not_null(CONF)).groupBy("treatment", "split", "original_id", *CONF).agg(F.count(F.lit(1)).alias("n_go"))
    groups = cells.groupBy("treatment", "split", *CONF).agg(F.sum("n_go").alias("n_g"))
    per_original = sources.groupBy("split", "original_id").agg(F.count(F.lit(1)).alias("n_o"))
    totals = per_original.groupBy("split").agg(F.sum("n_o").alias("n_all"))
    out = (s.join(members, ["treatment", "split", "id"]).join(groups, ["treatment", "split", *CONF], "left")
           .join(cells, ["treatment", "split", "original_id", *CONF], "left").join(per_original, ["split", "original_id"]).join(totals, "split"))
    n_approx = F.coalesce(F.col("n_g"), F.lit(0)) - F.coalesce(F.col("n_go"), F.lit(0))
    return kept_queries(out.select("treatment", "split", "id", F.col("n_tcf").cast("bigint").alias("n_tcf"), F.col("n_ccf").cast("bigint").alias("n_ccf"),
                                   n_approx.cast("bigint").alias("n_approx"), (F.col("n_all") - F.col("n_o") - n_approx).cast("bigint").alias("n_negative")))

