"""The corpus pipeline: documents to packed sequences in five stages.

Each stage takes what its predecessor kept and returns the columns of documents; the last returns the
pieces of the packed sequences with their ids. Between stages the rows are written as Parquet, in
``run`` to the folder that ``spark.checkpoint.dir`` names, so a lost executor costs one stage's tasks; a
stage's rows are deleted once the next one's are written, but for those that the result is read from.

Defined cases: a row with a null text, or one without a letter, goes at the first stage; other nulls, in any
column, are carried, and a null source is a source; of rows with a null ``doc_id`` near-duplicates are one
group's like others', and one of each group stays; a document whose rate draws no copy goes at the mixing
stage; repeated rows are one document after near-dedup; an empty table gives an empty result; columns beyond
those of documents are carried to the last stage, whatever their names, which returns its own alone.
"""
from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import op03_secrets, op04_langid, op05_mixing, op09_packing, op10_simhash
from pairlens.llm.common import read, removed, shared_folder, unused


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; ``lang`` stays as given."""
    return op04_langid.accepted(docs, op04_langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest ``doc_id``."""
    return op10_simhash.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind in brackets; ``n_chars`` follows."""
    return op03_secrets.redacted(docs, op03_secrets.train(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated towards square-root shares of their sources, in shuffled order."""
    copy, order = unused(docs.columns, "copy", "mix_key")
    return op05_mixing.replicated(docs, copy=copy, order=order).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids."""
    return op09_packing.pack(docs, public_tokenizers.path(op09_packing.TOKENIZER))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: Trained models, SimHash and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            removed(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
