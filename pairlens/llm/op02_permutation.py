"""Nearest neighbours through a permutation index.

Pivots are chosen from a bounded sample of the vectors, each farthest from those before. A vector is represented by its nearest pivots in
order. The rows are dealt into blocks of bounded size, and each block posts its vectors in inverted
files, one a pivot, holding (vector, rank of the pivot). A block of queries meets each block of rows: it
adds up footrule distances (a pivot missing on one side counts as ranked just behind the last) from the
inverted files of the query's pivots, keeps the share of the block's vectors that come first, and
reranks these by exact Euclidean distance on the original vectors. Footrule can't order a crowd of like
vectors, whose members rank the pivots alike, so no vector is left out for its footrule: a matrix product
places all of the block, and those beyond the share that it doesn't place farther than the best found are
reranked too. The best of each block meet in a top-k by query. Queries and rows are both dealt out, so
nothing that grows is broadcast.

Every row is indexed and the neighbours are exact; the pivots and the share reranked (``RERANK``) say how
many vectors are left for the second pass. Tests measure recall against brute force.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor
do those whose length is not the commonest one (the greater at a tie); rows with a null id take no
part; a query's own row and rows with the same id are no candidates, other equal vectors are; ties go
to the smaller id; of rows with one id the vectors count each, the nearest once; fewer candidates
than k give fewer rows; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.llm.common import checkpointed, read

K = 10
QUERY_EVERY = 100
#: Pivots, and how many of them represent a vector.
PIVOTS = 256
PREFIX = 64
#: Rows drawn for each pivot: the bound of the sample.
DRAWN = 8
#: Share of a block's vectors reranked exactly for each query, and their number at least.
RERANK = 0.15
RERANK_LEAST = 512
#: Rows of a block, and queries that meet it at once.
BLOCK_ROWS = 8192
QUERY_ROWS = 1024
#: Queries whose matrix product with a block is held at once.
PRODUCT_ROWS = 128
SEED = 5
NO_ID = np.iinfo(np.int64).max


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, vec): the rows that take part, with double components."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(fine & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("vec") == (sizes[0]["d"] if sizes else 0))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def spread_out(sample: np.ndarray, count: int) -> np.ndarray:
    """Vectors of the sample, each the farthest from those before it: a crowd of like vectors gives few pivots."""
    far = np.full(len(sample), np.inf)
    chosen = []
    while len(chosen) < count and len(sample) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Places of the nearest pivots of each vector, nearest first, ties to the smaller place."""
    return np.argsort(squares(vectors, pivots), axis=1, kind="stable")[:, :prefix].astype(np.int16)


def placed(queries: np.ndarray, vectors: np.ndarray):
    """For each query the squared distances of all vectors less the most that rounding adds."""
    size, eps = (vectors * vectors).sum(axis=1), 4 * (vectors.shape[1] + 4) * np.finfo(np.float64).eps
    for at in range(0, len(queries), PRODUCT_ROWS):
        part = queries[at: at + PRODUCT_ROWS]
        yield from squares(part, vectors) - eps * ((part * part).sum(axis=1)[:, None] + size[None, :])


class InvertedFiles:
    """The pivots' inverted files of one block: for each pivot the vectors that rank it, and the ranks."""

    def __init__(self, ranked: np.ndarray, pivots: int):
        self.rows, self.prefix = ranked.shape
        flat = ranked.ravel()
        order = np.argsort(flat, kind="stable")
        self.row, self.rank = (order // self.prefix).astype(np.int32), (order % self.prefix).astype(np.int32)
        self.start = np.searchsorted(flat[order], np.arange(pivots + 1))

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """Footrule distance of each vector to the query's ranked pivots, less a number equal for all.

        Where both rank a pivot at i and j it adds abs(i - j); else a missing rank counts as the prefix's
        length m. Against all pivots missing, a shared pivot so saves (m - i) + (m - j) - abs(i - j).
        """
        m = self.prefix
        spans = [slice(self.start[p], self.start[p + 1]) for p in query]
        rows = np.concatenate([self.row[s] for s in spans])
        saved = np.concatenate([2 * m - i - self.rank[s] - np.abs(self.rank[s] - i) for i, s in enumerate(spans)])
        return -np.bincount(rows, weights=saved, minlength=self.rows)


def search_block(ids: np.ndarray, vectors: np.ndarray, ranked: np.ndarray, q_ids: np.ndarray, q_vectors: np.ndarray,
                 q_ranked: np.ndarray, pivots: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, distance) of the block's best for each query. ``ids``: a row of ids a vector."""
    files = InvertedFiles(ranked, pivots)
    first = min(len(ids), max(RERANK_LEAST, int(np.ceil(RERANK * len(ids)))))
    sole = np.where(ids[:, 1] == NO_ID, ids[:, 0], NO_ID)  # the id of a vector that has one
    out = []
    for qid, q, perm, least in zip(q_ids, q_vectors, q_ranked, placed(q_vectors, vectors)):
        far = files.footrule(perm)
        near = np.argpartition(far, first - 1)[:first] if first < len(ids) else np.arange(len(ids))
        near = near[sole[near] != qid]  # vectors of the query's own id alone are no candidates, however many
        exact = np.sqrt(((vectors[near] - q) ** 2).sum(axis=1))
        if first < len(ids):
            open_ = ~(least > (np.partition(exact, k - 1)[k - 1] ** 2 if len(exact) >= k else np.inf))
            open_[near] = False
            rest = np.flatnonzero(open_ & (sole != qid))
            near, exact = np.concatenate([near, rest]), np.concatenate([exact, np.sqrt(((vectors[rest] - q) ** 2).sum(axis=1))])
        if len(near) > k:  # each has an id that is not the query's
            close = exact <= np.partition(exact, k - 1)[k - 1]
            near, exact = near[close], exact[close]
        every, far = ids[near].ravel(), np.repeat(exact, ids.shape[1])
        fine = (every != NO_ID) & (every != qid)
        every, far = every[fine], far[fine]
        best = np.lexsort((every, far))[:k]
        out.append((np.full(len(best), qid), every[best], far[best]))
    return tuple(np.concatenate(c) for c in zip(*out))


def search(table: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``."""
    rows = checkpointed(usable(table))
    total = rows.count()
    # a bounded sample: DRAWN x PIVOTS vectors
    sample = rows.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id", "vec").limit(DRAWN * PIVOTS).toArrow()
    pivots = spread_out(np.array(sample.column("vec").to_pylist(), dtype=np.float64), PIVOTS)
    prefix = min(PREFIX, len(pivots))
    blocks = max(1, -(-total // BLOCK_ROWS))
    tiles = max(1, -(-total // (every * QUERY_ROWS)))

    def represent(batches):
        for b in batches:
            v = np.array(b.column(1).to_pylist(), dtype=np.float64).reshape(b.num_rows, -1)
            if b.num_rows:
                ranked = nearest_pivots(v, pivots, prefix)
                yield pa.record_batch([b.column(0), b.column(1), pa.array(list(ranked), pa.list_(pa.int16()))], [b.schema.names[0], "vec", "ranked"])

    # of equal vectors only the k + 1 smallest ids can be among the k nearest of any query
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    smallest = rows.distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1)
    distinct = smallest.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("ids", "vec")
    data = distinct.mapInArrow(represent, "ids array<long>, vec array<double>, ranked array<short>")
    known = rows.where(F.col("vec_id") % every == 0).mapInArrow(represent, "vec_id long, vec array<double>, ranked array<short>")
    dealt = F.xxhash64(F.lit(SEED), "vec")
    data = data.withColumn("block", F.pmod(dealt, F.lit(blocks)).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    queries = known.withColumn("tile", F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(tiles)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def stacked(part: pd.DataFrame):
        if "ids" in part:
            ids = np.full((len(part), k + 1), NO_ID)
            for i, own in enumerate(part["ids"]):
                ids[i, : len(own)] = own
        else:
            ids = part["vec_id"].to_numpy()
        return (ids, np.stack(part["vec"].to_numpy()).astype(np.float64), np.stack(part["ranked"].to_numpy()))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, v, s = search_block(*stacked(left), *stacked(right), len(pivots), k)
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    found = data.groupBy("block", "tile").cogroup(queries.groupBy("block", "tile")).applyInPandas(
        meet, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found of every hundredth vector."""
    return search(read(spark, sf_dir, "embeddings"))
