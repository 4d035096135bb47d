"""Versioned text vectors with an incremental build.

A folder of (text_id, model, text_hash, build, vec), partitioned by model and build. A build adds vectors
of those texts alone whose hash differs from the latest stored one, or that the model has none of; a
build that is run again replaces its own partition. Readers take the latest version of each text.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.sources.sinks import write_table

SCHEMA = "text_id long, text_hash string, vec array<double>, model string, build int"


class VectorStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """All versions; a store without a build is empty."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def latest(self, model: str, before: int | None = None) -> DataFrame:
        """(text_id, text_hash, build, vec): each text's version of the last build (before ``before``, if given)."""
        rows = self.rows().where(F.col("model") == model)
        rows = rows if before is None else rows.where(F.col("build") < before)
        last = F.max_by(F.struct("text_hash", "build", "vec"), F.col("build")).alias("v")
        return rows.groupBy("text_id").agg(last).select("text_id", "v.*")

    def stale(self, texts: DataFrame, model: str, build: int) -> DataFrame:
        """The rows of ``texts`` (text_id, text) that this build has to embed, with ``text_hash``."""
        hashed = texts.select("text_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
        known = self.latest(model, build).select("text_id", "text_hash")
        return hashed.join(known, ["text_id", "text_hash"], "left_anti")

    def refresh(self, texts: DataFrame, model: str, build: int, embed: Callable[[DataFrame], DataFrame]) -> None:
        """``embed``: (text_id, text) -> (text_id, vec); it is given the stale texts alone."""
        stale = self.stale(texts, model, build)
        rows = embed(stale.select("text_id", "text")).join(stale.select("text_id", "text_hash"), "text_id")
        write_table(rows.select("text_id", "text_hash", F.col("vec").cast("array<double>").alias("vec"), F.lit(model).alias("model"),
                                F.lit(build).alias("build")), self.path, ("model", "build"))
