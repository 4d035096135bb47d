import os
import tempfile

from pyspark.sql import functions as F

from pairlens.operators import hygiene as H
from pairlens.operators import models as MD
from pairlens.sources import sinks
from pairlens.sources.fixtures import Fixtures
from pairlens.streaming.hygiene_stream import start
from tests.conftest import SF_SMALL


def test_stream_matches_batch(spark):
    fx = Fixtures(spark, SF_SMALL)
    gens = fx.generations
    root = tempfile.mkdtemp(prefix="pairlens-stream-")
    src = os.path.join(root, "src")
    gens.orderBy("g_id").coalesce(1).write.parquet(src)  # rows arrive in id order: the first arrival is the first by id
    q = start(spark, src, gens.schema, os.path.join(root, "out"), os.path.join(root, "ckpt"))
    q.awaitTermination(300)
    streamed = spark.read.parquet(os.path.join(root, "out"))
    batch = fx.accepted_generations
    key = ["g_id", "generation", "base_direction", "target_direction"]
    assert streamed.count() == batch.count()
    assert streamed.select(*key).exceptAll(batch.select(*key)).count() == 0


def test_sinks_and_models(spark):
    fx = Fixtures(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="pairlens-sinks-")
    sinks.write_table(fx.reviews.select("id", "split"), os.path.join(root, "reviews"), ("split",))
    assert set(os.listdir(os.path.join(root, "reviews"))) >= {"split=test", "split=validation"}
    long = sinks.metrics_long(spark.createDataFrame([(1.0, 0.5)], "loss double, approx double"))
    assert sorted((r.metric, r.value) for r in long.collect()) == [("approx", 0.5), ("loss", 1.0)]
    models = MD.train_aspect_models(fx.reviews)
    preds = MD.aspect_predictions(fx.reviews, models)
    assert preds.where(F.col("prediction").isNull()).count() == 0
    assert preds.select(F.size("probs").alias("n")).distinct().collect()[0].n == 3
    emb = MD.hashed_embeddings(fx.reviews.select(F.col("description").alias("text")))
    norms = emb.select(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("n")).collect()
    assert all(abs(r.n - 1.0) < 1e-9 for r in norms)
