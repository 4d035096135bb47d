"""Text vectors and scorers.

A scorer maps a table of (key) rows to class probabilities. The registry entry
carries the label count so downstream aggregates know the vector length. ``linear_head`` is
a column expression, ``batch_head`` a model that takes Arrow batches; another model is
one more entry.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Callable

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.functions.vectors import argmax, softmax

# Batch functions run in executors, which need no installed copy: this module travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

VECTOR = "vec"
PROBS = "probs"
#: Texts scored at once.
PREDICT_ROWS = 1024


def attach_vectors(df: DataFrame, embeddings: DataFrame, key_col: str, out_col: str = VECTOR) -> DataFrame:
    """Stored vector of each text from a table (text_id, vec); a text without one gets null.

    Plain left equi-join: at scale the vector table is as large as the text table and this is a
    shuffle join on the text id; AQE broadcasts it only when its measured size is small.
    """
    vecs = embeddings.select(F.col("text_id").alias("_text_id"), F.col("vec").alias(out_col))
    return df.join(vecs, F.col(key_col) == F.col("_text_id"), "left").drop("_text_id")


def linear_head_probs(vec_col: str = VECTOR, n_labels: int = 5, scale: float = 4.0):
    """Softmax of ``scale`` x the first ``n_labels`` vector dimensions; null without a vector."""
    logits = F.array(*[F.lit(scale) * F.element_at(F.col(vec_col), i + 1).cast("double") for i in range(n_labels)])
    return F.when(F.col(vec_col).isNotNull(), softmax(logits))


@dataclass(frozen=True)
class Scorer:
    """One registry entry (name, labels, has vectors, scoring function)."""

    name: str
    n_labels: int
    has_vectors: bool
    score: Callable[[DataFrame, DataFrame, str], DataFrame]  # (texts, embeddings, key) -> + probs


def _linear_head(texts: DataFrame, embeddings: DataFrame, key_col: str, n_labels: int = 5) -> DataFrame:
    # the dimensions that the head reads are cut out before the join, so that no whole vector is shuffled
    read = embeddings.select("text_id", F.slice(VECTOR, 1, n_labels).alias(VECTOR))
    v = attach_vectors(texts, read, key_col)
    return v.withColumn(PROBS, linear_head_probs(n_labels=n_labels)).drop(VECTOR)


class BatchHead:
    """A classifier head over whole batches: softmax of a weight matrix times the vectors. Stands where a model file would
    be loaded; a worker makes it once."""

    def __init__(self, first: int = 5, n_labels: int = 5, scale: float = 4.0):
        self.first, self.n_labels, self.scale = first, n_labels, scale

    def predict(self, vectors: np.ndarray) -> np.ndarray:
        weights = np.zeros((vectors.shape[1], self.n_labels))
        weights[np.arange(self.first, self.first + self.n_labels), np.arange(self.n_labels)] = self.scale
        logits = vectors @ weights
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def batched(make_model: Callable[[], object], name: str, rows: int = PREDICT_ROWS):
    """A mapInArrow function (key, vec) -> (key, probs): batches of vectors through a model kept per worker."""
    def run(batches):
        held = sys.modules.setdefault("_pairlens_models", type(sys)("_pairlens_models")).__dict__
        if name not in held:
            held[name] = make_model()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                some = batch.slice(at, rows)
                vectors = pc.list_flatten(some.column(1)).to_numpy(zero_copy_only=False).astype(np.float64).reshape(some.num_rows, -1)
                probs = held[name].predict(vectors)
                offsets = pa.array(np.arange(some.num_rows + 1, dtype=np.int32) * probs.shape[1])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(offsets, pa.array(probs.ravel()))], [some.schema.names[0], PROBS])
    return run


def _batch_head(texts: DataFrame, embeddings: DataFrame, key_col: str) -> DataFrame:
    """One Arrow batch after another through ``BatchHead``; a text without a vector gets null."""
    v = attach_vectors(texts, embeddings, key_col).select(key_col, VECTOR)
    scored = v.where(F.col(VECTOR).isNotNull()).mapInArrow(batched(BatchHead, "batch_head"), f"{key_col} {dict(v.dtypes)[key_col]}, {PROBS} array<double>")
    return texts.join(scored, key_col, "left")


SCORERS = {"linear_head": Scorer("linear_head", 5, True, _linear_head), "batch_head": Scorer("batch_head", 5, True, _batch_head)}


def get_scorer(name: str) -> Scorer:
    """Lookup by name, unknown name is an error."""
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name!r}; known: {sorted(SCORERS)}")
    return SCORERS[name]


def score_keys(keys: DataFrame, embeddings: DataFrame, key_col: str, scorer: str = "linear_head") -> DataFrame:
    """Score each DISTINCT key once (J18): returns (key, probs)."""
    distinct = keys.select(key_col).distinct()
    return get_scorer(scorer).score(distinct, embeddings, key_col)


def predicted_classes(keys: DataFrame, embeddings: DataFrame, key_col: str, scorers: list[str]) -> DataFrame:
    """(key, scorer, class): each scorer's class of the greatest probability, the first of equal ones."""
    out = [score_keys(keys, embeddings, key_col, s).select(key_col, F.lit(s).alias("scorer"), argmax(PROBS).cast("int").alias("class")) for s in scorers]
    return reduce(DataFrame.unionByName, out)
