"""Exact blocked cosine top-k (J6, J7, W2, T1, T2) as a tiled, cogrouped Arrow matmul.

Queries and candidates share block keys (e.g. concept + target label). A block of more than ``tile``
candidates gets an index of tiles of near candidates, and a query visits those tiles alone that
can hold one of its k best (``_pruned_topk``). A tile's rows and the queries that visit it are cut into
parts of at most ``tile`` rows; every (query part, candidate part) cell meets in exactly one cogroup
call. That call multiplies
normalised vectors in single precision, a few queries and candidates at a time, takes the pairs that can be among a query's
k best by more than rounding, and emits its local top-k of these by their cosines in double precision -
never the similarity matrix. Where a query's k-th cosine so far is known, only pairs that reach it
are emitted. A final ``row_number`` over (block, query) merges the partial top-k lists.

Memory per task is bounded by ``tile`` x dim on each side, whatever the block size:
a block holding a third of all rows just becomes more tiles. A call holds both sides as Spark hands them over, and
matrices and unit vectors of PART_ROWS at most. Tables of blocks and tiles are
bounded by the label domains and by MAX_TILES, and are broadcast; they go to Spark as Arrow tables, as a list of rows
would start a second set of Python workers.

Order: rounded similarity (9 digits) descending, then candidate id ascending.
"""
from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from pairlens.constants import NORM_EPS, SIM_DIGITS
from pairlens.session import cut_lineage

# The cogroup function runs in executor Python workers: ship this module's code by value
# so executors do not need the package installed or on their path.
try:  # pragma: no cover - import location differs across pyspark builds
    from pyspark import cloudpickle as _cp
except ImportError:  # pragma: no cover
    import cloudpickle as _cp
_cp.register_pickle_by_value(sys.modules[__name__])

#: Candidates of a tile and queries that meet it at once (each vector is copied once per opposite part), query rows of one
#: matmul, candidates of one, rows normalised at once otherwise, and pairs whose cosines are computed at once.
TILE_ROWS = 65_536
QUERY_ROWS = 131_072
MATMUL_ROWS = 64
PART_ROWS = 8_192
BLOCK_ROWS = 2_048
PAIR_ROWS = 8_192
#: Centres of the candidate index at most, and rows sampled for each.
MAX_TILES = 4096
SAMPLE = 4
#: A tile is left only if its bound stays below the k-th cosine by more than rounding.
BOUND_SLACK = 1e-7


class _Rows:
    """Vectors of one side as they came, and their norms; a few at a time become a matrix."""

    def __init__(self, vectors: pd.Series):
        self.vectors = vectors.to_numpy()
        sizes = np.fromiter(map(len, self.vectors), dtype=np.int64, count=len(self.vectors))
        if sizes.min() != sizes.max():
            raise ValueError(f"vectors of {sizes.min()} to {sizes.max()} elements")
        self.dim = int(sizes[0])
        self.norms = np.empty(len(sizes))
        for at, some, norms in self.slices(PART_ROWS):
            np.maximum(np.sqrt(np.einsum("ij,ij->i", some, some, dtype=np.float64)), NORM_EPS, out=norms)

    @property
    def raw(self) -> np.ndarray:
        return np.concatenate(self.vectors).reshape(-1, self.dim)

    def slices(self, rows: int):
        """(number of the first row, vectors, norms) of at most ``rows`` rows, one after another."""
        for at in range(0, len(self.vectors), rows):
            some = self.vectors[at: at + rows]
            yield at, np.concatenate(some).reshape(len(some), self.dim), self.norms[at: at + rows]


def _unit(raw: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision."""
    return np.divide(raw, norms[:, None], out=np.empty(raw.shape, dtype=np.float32), casting="same_kind")


def _cosines(left: tuple, right: tuple, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Cosines of the given pairs in double precision. Each side: vectors and norms."""
    out = np.empty(len(rows))
    for at in range(0, len(rows), PAIR_ROWS):
        r, c = rows[at: at + PAIR_ROWS], cols[at: at + PAIR_ROWS]
        a, b = left[0][r].astype(np.float64), right[0][c].astype(np.float64)
        a /= left[1][r][:, None]
        b /= right[1][c][:, None]
        out[at: at + PAIR_ROWS] = np.einsum("ij,ij->i", a, b)
    return out


def _best(left: _Rows, right: _Rows, k: int, least: np.ndarray | None, place: np.ndarray | None = None):
    """(row, column, cosine) of each row's k best by rounded cosine, then column, best first; ``least``: only those that reach it.
    ``place``: the columns' order, if it is not their own.

    A product in single precision is off by at most (dim + 4) * 2^-24, so that pairs below the k-th one by more than twice
    that are none of the best. Columns come a part at a time, and have to reach the k-th found in those before.
    """
    slack = np.float32(4 * (left.dim + 4) * 2.0 ** -24)
    none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    found = [none]
    for first, raw, norms in left.slices(BLOCK_ROWS):
        unit = _unit(raw, norms)
        pieces = range(0, len(raw), MATMUL_ROWS)
        best = [none] * len(pieces)
        reach = np.full(len(raw), -2.0) if least is None else least[first: first + len(raw)].copy()
        for start, other, other_norms in right.slices(PART_ROWS):
            columns = _unit(other, other_norms).T
            n = len(other)
            for i, at in enumerate(pieces):  # bounds the similarity matrix held at once
                own, needed = slice(at, at + MATMUL_ROWS), reach[at: at + MATMUL_ROWS]
                sims = unit[own] @ columns
                edge = needed.astype(np.float32)
                if k < n and edge.min(initial=0) <= -2.0:
                    edge = np.maximum(edge, np.partition(sims, n - k, axis=1)[:, n - k])
                rows, cols = np.divmod(np.flatnonzero(sims >= (edge - slack)[:, None]), n)  # np.nonzero takes five times the product's time
                exact = _cosines((raw[own], norms[own]), (other, other_norms), rows, cols)
                enough = np.round(exact, SIM_DIGITS) >= needed[rows]
                rows, cols, exact = (np.concatenate(x) for x in zip(best[i], (rows[enough], cols[enough] + start, exact[enough])))
                rounded = np.round(exact, SIM_DIGITS)
                order = np.lexsort((cols if place is None else place[cols], -rounded, rows))
                rows, cols, exact, rounded = rows[order], cols[order], exact[order], rounded[order]
                rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
                last = rank == k - 1
                needed[rows[last]] = np.maximum(needed[rows[last]], rounded[last])
                best[i] = rows[rank < k], cols[rank < k], exact[rank < k]
        found += [(rows + first + at, cols, exact) for at, (rows, cols, exact) in zip(pieces, best)]
    return tuple(np.concatenate(x) for x in zip(*found))


def _tile_topk_fn(block_cols, q_id, c_id, vec, k):
    def fn(qp: pd.DataFrame, cp: pd.DataFrame) -> pd.DataFrame:
        rows = picked = np.zeros(0, dtype=np.int64)
        sim = np.zeros(0)
        if len(qp) and len(cp):
            place = np.empty(len(cp), dtype=np.int64)
            place[cp[c_id].reset_index(drop=True).sort_values(kind="stable").index] = np.arange(len(cp))
            least = qp["_kth"].fillna(-2.0).to_numpy(dtype=np.float64) if "_kth" in qp.columns else None
            rows, picked, sim = _best(_Rows(qp[vec]), _Rows(cp[vec]), k, least, place)
        some = qp if len(qp) else cp
        out = {c: np.repeat(some[c].to_numpy()[:1], len(rows)) for c in block_cols}
        return pd.DataFrame({**out, q_id: qp[q_id].to_numpy()[rows], c_id: cp[c_id].to_numpy()[picked], "sim": sim})

    return fn


def _tile_parts(q: DataFrame, c: DataFrame, tiles: DataFrame, keys: list[str], q_id: str, c_id: str, vec: str, k: int, schema: StructType) -> DataFrame:
    """Partial top-k lists of all (query part, candidate part) cells of each tile. ``tiles``: keys, ``_qt`` and ``_ct`` parts."""
    tiles = F.broadcast(tiles)
    q2 = (q.join(tiles, keys)
          .withColumn("_qtile", F.pmod(F.xxhash64(q_id), F.col("_qt")).cast("int"))
          .withColumn("_ctile", F.explode(F.sequence(F.lit(0), F.col("_ct") - 1)))
          .drop("_qt", "_ct"))
    c2 = (c.join(tiles, keys)
          .withColumn("_ctile", F.pmod(F.xxhash64(c_id), F.col("_ct")).cast("int"))
          .withColumn("_qtile", F.explode(F.sequence(F.lit(0), F.col("_qt") - 1)))
          .drop("_qt", "_ct"))
    cell = [*keys, "_qtile", "_ctile"]
    return q2.groupBy(*cell).cogroup(c2.groupBy(*cell)).applyInPandas(_tile_topk_fn(keys, q_id, c_id, vec, k), schema)


def _ranked(partial: DataFrame, keys: list[str], q_id: str, c_id: str, k: int) -> DataFrame:
    w = Window.partitionBy(*keys, q_id).orderBy(F.round("sim", SIM_DIGITS).desc(), F.col(c_id))
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine_topk(queries: DataFrame, candidates: DataFrame, k: int, block_cols: list[str],
                q_id: str = "qid", c_id: str = "cid", vec: str = "vec", tile: int = TILE_ROWS, most: int | None = None,
                visits: dict | None = None) -> DataFrame:
    """Top-k candidates per (block, query) by cosine; returns block cols, q_id, c_id, sim, rank.

    Rows without a vector take no part. The block keys are labels of fixed domains, so tables of blocks
    and tile counts have at most their product of rows. ``most``: no block has more candidates, if known.
    Where a block may have more than a tile, a candidate index prunes tiles; the rows are the same.
    ``visits``, if given, receives how many (query, tile) pairs were visited and how many there are.
    """
    q = queries.select(*block_cols, q_id, vec).where(F.col(vec).isNotNull())
    c = candidates.select(*block_cols, c_id, vec).where(F.col(vec).isNotNull())
    if most is None or most > tile:
        return _pruned_topk(q, c, k, block_cols, q_id, c_id, vec, tile, {} if visits is None else visits)
    tiles = q.groupBy(*block_cols).agg(F.ceil(F.count(F.lit(1)) / min(tile, QUERY_ROWS)).cast("int").alias("_qt")).withColumn("_ct", F.lit(1))
    schema = StructType([queries.schema[b] for b in block_cols]
                        + [queries.schema[q_id], candidates.schema[c_id], StructField("sim", DoubleType())])
    return _ranked(_tile_parts(q, c, tiles, block_cols, q_id, c_id, vec, k, schema), block_cols, q_id, c_id, k)


# ---------------------------------------------------------------- candidate index
def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls as unit vectors."""
    m = pc.list_flatten(col).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    return m / np.maximum(np.sqrt((m * m).sum(axis=1)), NORM_EPS)[:, None]


def _few(batches):
    """The batches' rows, at most BLOCK_ROWS at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(at, BLOCK_ROWS)


def _spread(sample: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` rows of the sample, each the farthest from those before (k-centre, greedy)."""
    near, picked = sample @ sample[0], [0]
    while len(picked) < min(n, len(sample)) and near.min() < 1 - 1e-9:
        picked.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[picked[-1]])
    return sample[picked]


def _angles(m: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(m, -1.0, 1.0))


def _by_block(numbers: np.ndarray):
    order = np.argsort(numbers, kind="stable")
    cuts = np.flatnonzero(np.diff(numbers[order])) + 1
    return [(int(numbers[rows[0]]), rows) for rows in np.split(order, cuts) if len(rows)]


def _assign_fn(centres: list[np.ndarray]):
    """Candidates with the tile of their nearest centre and the cosine to it."""
    def run(batches):
        for batch in _few(batches):
            unit, at = _matrix(batch.column(2)), batch.column(0).to_numpy()
            tile, cos = np.zeros(len(at), dtype=np.int32), np.zeros(len(at))
            for b, rows in _by_block(at):
                for own in np.array_split(rows, -(-len(rows) // MATMUL_ROWS)):
                    sims = unit[own] @ centres[b].T
                    tile[own] = sims.argmax(axis=1)
                    cos[own] = sims.max(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tile), pa.array(cos), *batch.columns[1:]], ["_b", "_t", "_cos", *batch.schema.names[1:]])
    return run


def _route_fn(centres: list[np.ndarray], sizes: list[np.ndarray], radii: list[np.ndarray], k: int, rest: bool):
    """Queries with each tile to visit: at first the nearest ones that hold ``k`` candidates, then all others whose bound on
    the cosine reaches the k-th found (column 3, handed on; null where fewer were found)."""
    def run(batches):
        for batch in _few(batches):
            unit, at = _matrix(batch.column(2)), batch.column(0).to_numpy()
            for b, rows in _by_block(at):
                for own in np.array_split(rows, -(-len(rows) // MATMUL_ROWS)):
                    angle = _angles(unit[own] @ centres[b].T)
                    order = np.argsort(angle, axis=1, kind="stable")
                    before = np.cumsum(sizes[b][order], axis=1) - sizes[b][order]
                    first = np.zeros(angle.shape, dtype=bool)
                    np.put_along_axis(first, order, before < k, axis=1)
                    if rest:
                        kth = batch.column(3).to_numpy(zero_copy_only=False)[own]
                        bound = np.cos(np.maximum(0.0, angle - radii[b]))
                        first = ~first & (bound >= np.where(np.isnan(kth), -2.0, kth)[:, None] - BOUND_SLACK)
                    q, t = np.nonzero(first & (sizes[b] > 0))
                    for lo in range(0, len(q), PAIR_ROWS):  # a query's vector goes to many tiles
                        some = batch.take(pa.array(own[q[lo: lo + PAIR_ROWS]]))
                        yield pa.RecordBatch.from_arrays([some.column(0), pa.array(t[lo: lo + PAIR_ROWS].astype(np.int32)), *some.columns[1:]],
                                                         ["_b", "_t", *batch.schema.names[1:]])
    return run


def _pruned_topk(q: DataFrame, c: DataFrame, k: int, block_cols: list[str], q_id: str, c_id: str, vec: str, tile: int, visits: dict) -> DataFrame:
    """Exact top-k through tiles of near candidates (a centre and the widest angle to it each).

    A candidate's cosine is at most cos(angle to the tile's centre - the tile's widest angle). Queries go to
    their nearest tiles first, and then to those whose bound reaches the k-th cosine found; a tile beyond it cannot
    hold a better or an equal one. Centres are spread over a sample of a bounded number of candidates; all
    candidates are in a tile. At most MAX_TILES centres and their sizes reach the driver and the tasks.
    """
    spark = q.sparkSession
    blocks = c.groupBy(*block_cols).agg(F.count(F.lit(1)).alias("_n")).where(reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in block_cols])).toArrow()
    counts = blocks["_n"].to_pylist()
    blocks = blocks.append_column("_b", pa.array(range(len(counts)), pa.int32()))
    names = spark.createDataFrame(blocks)
    qs = cut_lineage(q.join(F.broadcast(names), block_cols).select("_b", q_id, vec))
    asked = {r["_b"]: r["n"] for r in qs.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect()}
    # a block that no query is in is neither indexed nor written
    counts = [n if b in asked else 0 for b, n in enumerate(counts)]
    rows_a_tile = max(tile, -(-sum(counts) // MAX_TILES))
    wanted = [-(-n // rows_a_tile) for n in counts]
    live = blocks.append_column("_m", pa.array(wanted, pa.int64())).filter(pa.array([n > 0 for n in counts], pa.bool_()))
    numbered = c.join(F.broadcast(spark.createDataFrame(live)), block_cols)
    sample = numbered.where(F.pmod(F.xxhash64(c_id), F.col("_n")) < SAMPLE * F.col("_m")).select("_b", vec).toArrow()
    centres = [np.zeros((0, 1))] * len(counts)
    if sample.num_rows:
        unit = _matrix(sample.column(1).combine_chunks())
        for b, rows in _by_block(sample.column(0).to_numpy()):
            centres[b] = _spread(unit[rows], wanted[b])
        dim = unit.shape[1]
        # a block that the sample missed has one tile of any direction
        centres = [x if len(x) else np.eye(1, dim) for x in centres]
    elif counts:
        one = _matrix(c.select(vec).limit(1).toArrow().column(0).combine_chunks())
        centres = [one] * len(counts)
    own = numbered.select("_b", c_id, vec)
    kinds = {f.name: f.dataType.simpleString() for f in c.schema}
    tiled = cut_lineage(own.mapInArrow(_assign_fn(centres), f"_b int, _t int, _cos double, {c_id} {kinds[c_id]}, {vec} {kinds[vec]}"))
    sizes = [np.zeros(len(x), dtype=np.int64) for x in centres]
    radii = [np.zeros(len(x)) for x in centres]
    for r in tiled.groupBy("_b", "_t").agg(F.count(F.lit(1)).alias("n"), F.min("_cos").alias("cos")).collect():
        sizes[r["_b"]][r["_t"]], radii[r["_b"]][r["_t"]] = r["n"], _angles(np.array(r["cos"]))
    tiled = tiled.drop("_cos")
    kind = f"_b int, _t int, {q_id} {dict(q.dtypes)[q_id]}, {vec} {dict(q.dtypes)[vec]}"  # and _kth where it is known
    schema = StructType([StructField("_b", IntegerType()), StructField("_t", IntegerType()), q.schema[q_id], c.schema[c_id], StructField("sim", DoubleType())])

    def search(rows: DataFrame, rest: bool) -> DataFrame:
        routed = rows.mapInArrow(_route_fn(centres, sizes, radii, k, rest), kind + ", _kth double" * rest)
        held = routed.groupBy("_b", "_t").agg(F.count(F.lit(1)).alias("n")).collect()
        visits["visited"] = visits.get("visited", 0) + sum(r["n"] for r in held)
        parts = spark.createDataFrame(pa.table({"_b": pa.array([r["_b"] for r in held], pa.int32()), "_t": pa.array([r["_t"] for r in held], pa.int32()),
                                                "_qt": pa.array([-(-r["n"] // min(tile, QUERY_ROWS)) for r in held], pa.int32()),
                                                "_ct": pa.array([-(-int(sizes[r["_b"]][r["_t"]]) // tile) for r in held], pa.int32())}))
        return _tile_parts(routed, tiled, parts, ["_b", "_t"], q_id, c_id, vec, k, schema).select("_b", q_id, c_id, "sim")

    visits["all"] = sum(n * int((sizes[b] > 0).sum()) for b, n in asked.items())
    found = cut_lineage(_ranked(search(qs, False), ["_b"], q_id, c_id, k))
    kth = found.where(F.col("rank") == k).select("_b", q_id, F.round("sim", SIM_DIGITS).alias("_kth"))
    more = search(qs.join(kth, ["_b", q_id], "left").select("_b", q_id, vec, "_kth"), True)
    out = _ranked(found.drop("rank").unionByName(more), ["_b"], q_id, c_id, k)
    return out.join(F.broadcast(names), "_b").select(*block_cols, q_id, c_id, "sim", "rank")
