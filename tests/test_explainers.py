from pyspark.sql import functions as F

from pairlens.operators import explainers as X
from pairlens.operators import metrics as M
from pairlens.operators.pairs import LABEL_COLS, mine_pairs
from pairlens.operators.scoring import linear_head_probs, score_keys
from pairlens.plans.queries import QUERIES, context, expanded_context
from pairlens.sources import fixtures
from pairlens.sources.fixtures import Fixtures
from tests.conftest import SF_SMALL


def test_sweep_equals_direct_runs(spark):
    _, ctx = context(spark, SF_SMALL)
    sweep = {}
    for r in X.topk_sweep(ctx, 49).collect():
        sweep.setdefault(r.k, {})[r.pair_id] = r.icace_error
    assert sorted(sweep) == list(range(1, 50))
    for k in (1, 2, 49):
        direct = {r.pair_id: r.icace_error for r in X.MatchingExplainer(top_k=k).pair_errors(ctx).collect()}
        assert direct.keys() == sweep[k].keys()
        for pair, error in direct.items():
            assert (error is None) == (sweep[k][pair] is None)
            assert error is None or abs(error - sweep[k][pair]) < 1e-9


def test_texts_without_vectors_keep_their_pairs(spark):
    fx = Fixtures(spark, SF_SMALL)
    pairs = mine_pairs(fx.explained_reviews, LABEL_COLS)

    def cells(vectors):
        ctx = X.ExplainContext(pairs=pairs, matching_set=fx.matching_set, generations=fx.accepted_generations, embeddings=vectors)
        return M.score_cells(X.MatchingExplainer(top_k=3).pair_errors(ctx)).agg(F.sum("n_pairs").alias("n"), F.sum("n_valid").alias("v")).first()

    full, part = cells(fx.vectors()), cells(fx.vectors().where("text_id % 5 <> 1"))
    assert part.n == full.n and 0 < part.v < full.v


def test_random_explainer_draws_for_each_cell(spark):
    _, ctx = context(spark, SF_SMALL)
    errors = X.RandomExplainer().pair_errors(ctx)
    assert errors.count() == ctx.cells.count()
    assert errors.select("pair_id", "concept").distinct().count() == errors.count()


def test_sweep_ranks_once(spark):
    _, ctx = context(spark, SF_SMALL)
    plan = X.topk_sweep(ctx, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 1


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_generations_are_cleaned_once(spark):
    """What the explainers read of generations and candidates has been written narrow; no plan cleans texts again."""
    _, ctx = context(spark, SF_SMALL)
    for approach in (1, 2):
        assert "instructor" not in _plan(X.GenerativeExplainer(approach=approach).pair_errors(ctx))
    wide = expanded_context(spark, SF_SMALL)
    assert "instructor" not in _plan(X.MatchingExplainer(top_k=3).pair_errors(wide))


def test_sweep_joins_a_row_a_query(spark):
    """The values of k are told apart behind the join with the pairs, not before it."""
    _, ctx = context(spark, SF_SMALL)
    lines = _plan(X.topk_sweep(ctx, 5)).splitlines()
    first = {word: next(i for i, x in enumerate(lines) if word in x) for word in ("Generate", "Join")}
    assert first["Generate"] < first["Join"]


def test_report_joins_digests(spark):
    lines = _plan(QUERIES["best_match_report"](spark, SF_SMALL)).splitlines()
    first = {word: next(i for i, x in enumerate(lines) if word in x) for word in ("md5(", "Join")}
    assert first["md5("] > first["Join"]
    assert not any("FlatMapCoGroupsInPandas" in x for x in lines)  # one search, written once


def test_models_share_pairs_candidates_and_searches(spark, monkeypatch):
    """a search for each set of vectors, not for each head; the table of all texts' vectors is read to find the needed ones alone."""
    searches, read = [], X.cosine_topk
    monkeypatch.setattr(X, "cosine_topk", lambda q, c, *a, **o: (searches.append((_plan(q), _plan(c))), read(q, c, *a, **o))[1])
    df = QUERIES["score_cells_by_model"](spark, SF_SMALL)
    assert len(searches) == 3
    for plan in (*(p for both in searches for p in both), _plan(df)):
        assert "Relation [" not in plan and "parquet" not in plan


def test_heads_shuffle_the_dimensions_that_they_read(spark):
    v = spark.createDataFrame([(i, [float(i + j) for j in range(64)]) for i in range(4)] + [(4, None)], "text_id long, vec array<float>")
    keys = spark.createDataFrame([(i,) for i in (0, 1, 1, 4, 9)], "k long")
    scored = score_keys(keys, v, "k")
    lines = _plan(scored).splitlines()
    assert next(i for i, x in enumerate(lines) if "slice(" in x) > next(i for i, x in enumerate(lines) if "Join" in x)
    want = {k: r.probs for k, r in zip((0, 1), v.where("text_id < 2").orderBy("text_id").select(linear_head_probs().alias("probs")).collect())}
    assert {r.k: r.probs for r in scored.collect()} == {**want, 4: None, 9: None}


def test_vectors_need_no_texts_of_generations(spark, monkeypatch):
    """ids are enough, so that no generation is written for queries that read none; the rows are those of all reviews and generations."""
    monkeypatch.setattr(fixtures, "_STORED", {})
    fx, ctx = context(spark, SF_SMALL)
    assert ctx.cells.count() and sorted(name for *_, name in fixtures._STORED) == ["reviews", "vectors-base"]
    ids = fx.reviews.select("id").union(fx.generations.select("g_id")).distinct()
    assert ids.count() == fx.vectors().count() == fx.vectors().join(ids, F.col("id") == F.col("text_id"), "left_semi").count()
