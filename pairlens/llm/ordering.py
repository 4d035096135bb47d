"""Rows in ascending order of an integer key, then of their texts' hashes, in buckets of bounded size that tasks take one by one."""
from __future__ import annotations

from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a bucket, about, and buckets at most (a few numbers each reach the driver).
BUCKET_ROWS = 4096
MAX_BUCKETS = 16_384
LEAST = -(1 << 63)


def order_key(col: str = "doc_id") -> Column:
    """The key as a long, nulls before all others."""
    return F.coalesce(F.col(col).cast("long"), F.lit(LEAST))


def listed(values: list, at: Column, kind: str) -> Column:
    """The value of a place from 0 on."""
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), at + 1)


def in_buckets(rows: DataFrame, key: str = "key", text: str = "text") -> tuple[DataFrame, int]:
    """``rows`` with ``bucket`` and ``text_hash``, and the number of buckets: they ascend with (key, text_hash).

    Bounds are quantiles of the key. A key that several of them fall on is cut into as many buckets by ranges of the
    text's hash, so one key with a third of all rows is many buckets; only rows equal in key and text stay together.
    """
    keys = rows.select(key)
    wanted = min(MAX_BUCKETS, max(1, keys.count() // BUCKET_ROWS))
    rows = rows.withColumn("text_hash", F.xxhash64(text))
    if wanted == 1:
        return rows.withColumn("bucket", F.lit(0)), 1
    as_double = keys.select(F.col(key).cast("double").alias("d"), key)
    found = Counter(as_double.approxQuantile("d", [i / wanted for i in range(1, wanted)], 0.1 / wanted))
    inner = sorted(found)
    hot = [v for v in inner if found[v] > 1]
    # doubles hold no long exactly beyond 2^53: a value of several keys is not cut, as its keys' order counts
    one = {r["d"]: r["low"] for r in as_double.where(F.col("d").isin(hot)).groupBy("d").agg(F.min(key).alias("low"), F.max(key).alias("high")).collect()
           if r["low"] == r["high"]} if hot else {}
    cuts = [0] + [found[v] if v in one else 0 for v in inner]  # of the key that a range of keys begins with
    first, places = [], 0
    for n in cuts:
        first.append(places)
        places += n + 1
    split = Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol="__key", outputCol="__range")
    rows = split.transform(rows.withColumn("__key", F.col(key).cast("double"))).withColumn("__range", F.col("__range").cast("int"))
    n = listed(cuts, F.col("__range"), "int")
    starts = F.col(key) == listed([LEAST] + [one.get(v, LEAST) for v in inner], F.col("__range"), "long")
    share = F.least(F.floor((F.col("text_hash") / float(1 << 64) + 0.5) * n), n - 1)
    inside = F.when(n == 0, F.lit(0)).when(starts, share).otherwise(n)
    return rows.withColumn("bucket", (listed(first, F.col("__range"), "int") + inside).cast("int")).drop("__key", "__range"), places
