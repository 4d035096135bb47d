"""Model jobs re-aimed at Spark ML (R1-R4, A10, E6 trained scorer).

The explained pipeline fine-tunes transformers; here the same jobs are distributed
Spark ML pipelines over whole texts: tokenise -> hashed term frequencies -> IDF ->
multinomial logistic regression. Training and scoring are partitioned by Spark; the
probability vector becomes the scorer output (``probs``).
"""
from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.constants import CONCEPTS
from pairlens.operators.ingest import aspect_training_set

NUM_FEATURES = 1 << 16


def text_pipeline(label_col: str = "label", text_col: str = "description", max_iter: int = 30) -> Pipeline:
    """R3 + R1/R2: tokenizer, hashed TF, IDF and a multinomial logistic head."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=r"\W+", toLowercase=True),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=NUM_FEATURES),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol=label_col, family="multinomial", maxIter=max_iter,
                           regParam=0.01, probabilityCol="_prob", predictionCol="_pred", rawPredictionCol="_raw"),
    ])


def _scored(model, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return (out.withColumn("probs", vector_to_array("_prob")).withColumn("prediction", F.col("_pred").cast("int"))
            .drop("_tokens", "_tf", "_features", "_raw", "_prob", "_pred"))


def train_aspect_models(reviews: DataFrame, train_split: str = "train_exclusive") -> dict:
    """One 3-class (unknown 0 / Negative 1 / Positive 2) model per concept."""
    long = aspect_training_set(reviews)
    models = {}
    for c in CONCEPTS:
        train = long.where((F.col("concept") == c) & (F.col("split") == train_split))
        models[c] = text_pipeline().fit(train)
    return models


def aspect_predictions(reviews: DataFrame, models: dict) -> DataFrame:
    """Every concept's predicted label and probabilities for every labelled review."""
    long = aspect_training_set(reviews)
    out = None
    for c, m in models.items():
        s = _scored(m, long.where(F.col("concept") == c))
        out = s if out is None else out.unionByName(s)
    return out


def train_sentiment_model(encoded: DataFrame, train_split: str = "train_exclusive"):
    """R2: n-way review-score model (labels from F9 encoding)."""
    data = encoded.where(F.col("review_majority").isNotNull()).withColumn("label", F.col("review_majority"))
    return text_pipeline().fit(data.where(F.col("split") == train_split))


def sentiment_predictions(model, encoded: DataFrame) -> DataFrame:
    data = encoded.where(F.col("review_majority").isNotNull()).withColumn("label", F.col("review_majority"))
    return _scored(model, data)


def hashed_embeddings(texts: DataFrame, text_col: str = "text", dim: int = 256) -> DataFrame:
    """A unit-length hashed bag-of-words text vector (array<double>) per row."""
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=r"\W+")
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dim)
    norm = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0)
    out = norm.transform(tf.transform(tok.transform(texts)))
    return out.withColumn("vec", vector_to_array("_unit")).drop("_tokens", "_tf", "_unit")
