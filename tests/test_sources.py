"""Readers with explicit schemas, sinks that may run again, the vector store."""
import json

from pyspark.sql import functions as F

from pairlens.operators import metrics as M
from pairlens.operators.vector_store import VectorStore
from pairlens.sources import sinks
from pairlens.sources import tables as T
from pairlens.sources.fixtures import Fixtures
from tests.conftest import SF_SMALL


def test_broken_rows_keep_their_text(spark, tmp_path):
    folder = tmp_path / "reviews" / "split=test"
    folder.mkdir(parents=True)
    cols = [f.name for f in T.REVIEW_SCHEMA if f.name != "split"]
    good = '1,7,true,,"two\nlines, ""quoted""",4,Positive,,unknown,Negative'
    (folder / "a.csv").write_text(",".join(cols) + "\n" + good + "\nnot a number,x,maybe,food,text,5,,,,\n")
    rows = T.read_splits(spark, str(tmp_path / "reviews"), T.REVIEW_SCHEMA, fmt="csv").collect()
    fine, broken = sorted(rows, key=lambda r: r[T.CORRUPT] is not None)
    assert fine.id == 1 and fine.is_original and fine.description == 'two\nlines, "quoted"' and fine.edit_type is None and fine.split == "test"
    assert broken.id is None and "not a number" in broken[T.CORRUPT]


def test_splits_are_pruned_by_folder(spark):
    fx = Fixtures(spark, SF_SMALL)
    plan = fx.reviews.where(F.col("split") == "test")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "DataFilters: []" in plan


def test_generations_and_corpus(spark, tmp_path):
    fx = Fixtures(spark, SF_SMALL)
    path = str(tmp_path / "g")
    sinks.write_table(fx.generations, path, ("split",))
    got = T.read_generations(spark, path, ("test",))
    want = fx.generations.where("split = 'test' and not failed and generation is not null")
    assert got.count() == want.count() > 0 and got.select("g_id").exceptAll(want.select("g_id")).count() == 0
    corpus = fx.reviews.withColumn("split", F.when(F.col("split") == "test", T.SKIPPED_SPLIT).otherwise(F.col("split")))
    sinks.write_table(corpus, str(tmp_path / "c"), ("split",))
    raw = T.read_corpus(spark, str(tmp_path / "c"))
    assert raw.count() == corpus.where(F.col("split") != T.SKIPPED_SPLIT).count()
    clean = T.read_corpus(spark, str(tmp_path / "c"), "5-way")
    assert dict(clean.dtypes)["review_majority"] == "int" and clean.where("food_aspect_majority is null").count() == 0


def test_sinks_may_run_again(spark, tmp_path):
    p = str(tmp_path / "m")
    a = spark.createDataFrame([("test", "score", 0.5), ("test", "loss", 1.0)], "split string, name string, value double")
    for _ in range(2):
        sinks.append_metrics(a, p, "run-1")
        sinks.append_metrics(a.limit(1), p, "run-2")
    got = spark.read.parquet(p).groupBy("run").count().collect()
    assert {r.run: r["count"] for r in got} == {"run-1": 2, "run-2": 1}
    for k in (1, 1, 2):
        sinks.write_config(spark, {"k": k}, str(tmp_path / "c"), f"run-{k}")
    assert {r.run: json.loads(r.config) for r in spark.read.parquet(str(tmp_path / "c")).collect()} == {"run-1": {"k": 1}, "run-2": {"k": 2}}


def test_score_tables(spark, tmp_path):
    rows = [(e, "test", c, b, t, 1, 1, 0.1 * i + (e == "y")) for e in "xy" for i, c in enumerate(("food", "noise")) for b, t in M.DIRECTION_PAIRS[:5]]
    cells = spark.createDataFrame(rows, "explainer string, split string, concept string, base_direction string, target_direction string, n_pairs long, n_valid long, icace_error double")
    for _ in range(2):
        sinks.write_scores(cells, str(tmp_path / "s"))
    concepts = spark.read.parquet(str(tmp_path / "s" / "concepts"))
    assert {(r.explainer, r.concept): r.average for r in concepts.collect()} == {("x", "food"): 0.0, ("x", "noise"): 0.1, ("y", "food"): 1.0, ("y", "noise"): 1.1}
    assert concepts.where("Negative_to_unknown is null").count() == 0 and concepts.count() == 4
    overall = {r.explainer: (r.food, r.ambiance, r.average) for r in spark.read.parquet(str(tmp_path / "s" / "overall")).collect()}
    assert overall == {"x": (0.0, None, 0.05), "y": (1.0, None, 1.05)}


def test_unchanged_texts_are_not_embedded_again(spark, tmp_path):
    given = []

    def embed(texts):
        given.append(sorted((r.text_id, r.text) for r in texts.collect()))
        return texts.select("text_id", F.array(F.length("text").cast("double"), F.lit(float(len(given)))).alias("vec"))

    def texts(*rows):
        return spark.createDataFrame(rows, "text_id long, text string")

    store = VectorStore(spark, str(tmp_path / "v"))
    store.refresh(texts((1, "a"), (2, "bb"), (3, None)), "m", 1, embed)
    second = texts((1, "a"), (2, "new"), (4, "dddd"))
    for _ in range(2):  # the second time as a retry
        store.refresh(second, "m", 2, embed)
    store.refresh(texts((1, "a")), "other", 2, embed)
    assert given[1:] == [[(2, "new"), (4, "dddd")]] * 2 + [[(1, "a")]] and len(given[0]) == 3
    got = {r.text_id: (r.build, r.vec and r.vec[0]) for r in store.latest("m").collect()}
    assert got == {1: (1, 1.0), 2: (2, 3.0), 3: (1, None), 4: (2, 4.0)}
    assert store.rows().where("model = 'm'").count() == 5
