"""Readers of the input tables (S1-S6), each one DataFrame with a ``split`` column.

Text files are read with an explicit schema; a row that does not fit it keeps its text in ``CORRUPT``
instead of failing the job or vanishing. Folders are partitioned by ``split``, so that a choice of
splits prunes files.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from pairlens.constants import CONCEPTS
from pairlens.operators.ingest import encode_reviews

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Column that holds the text of a row that could not be read.
CORRUPT = "_corrupt"
#: The split that a raw corpus is read without (a fixed value).
SKIPPED_SPLIT = "train_observational"


def _struct(fields: dict) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


REVIEW_SCHEMA = _struct({
    "id": LongType(), "original_id": LongType(), "is_original": BooleanType(), "edit_type": StringType(), "description": StringType(),
    "review_majority": StringType(), **{f"{c}_aspect_majority": StringType() for c in CONCEPTS}, "split": StringType()})
GENERATION_SCHEMA = _struct({
    "g_id": LongType(), "original_id": LongType(), "split": StringType(), "text": StringType(), "failed": BooleanType(),
    "intervention_aspect": StringType(), "base_direction": StringType(), "target_direction": StringType(), "generation_index": IntegerType(),
    "generation": StringType(), **{f"{c}_predictions_generation": StringType() for c in CONCEPTS}})


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; Catalyst prunes columns / pushes filters into the scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_splits(spark: SparkSession, path: str, schema: StructType, splits=None, fmt: str = "parquet") -> DataFrame:
    """A folder partitioned by ``split``, all splits or the given ones (pruned by folder).

    CSV: header, quoted multi-line fields, empty fields null (Q4), and ``CORRUPT`` for broken rows.
    """
    if fmt == "csv":
        reader = (spark.read.schema(StructType([*schema.fields, StructField(CORRUPT, StringType())])).option("header", True).option("multiLine", True)
                  .option("escape", '"').option("nullValue", "").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT))
    else:
        reader = spark.read.schema(schema)
    df = reader.format(fmt).load(path)
    return df if splits is None else df.where(F.col("split").isin(*splits))


def read_generations(spark: SparkSession, path: str, splits=None, fmt: str = "parquet") -> DataFrame:
    """Successful generations with a text. ``path``: the raw or the filtered folder."""
    g = read_splits(spark, path, GENERATION_SCHEMA, splits, fmt)
    return g.where((F.col("failed") == F.lit(False)) & F.col("generation").isNotNull())


def read_corpus(spark: SparkSession, path: str, dataset_type: str | None = None, fmt: str = "parquet") -> DataFrame:
    """The labelled review corpus. Raw (no ``dataset_type``): without the observational training split; else
    cleaned and encoded (F7-F10)."""
    df = read_splits(spark, path, REVIEW_SCHEMA, fmt=fmt)
    return df.where(F.col("split") != SKIPPED_SPLIT) if dataset_type is None else encode_reviews(df, dataset_type)
