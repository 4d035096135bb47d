import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pairlens.operators import topk as T
from pairlens.operators.topk import cosine_topk


def _brute(q, c, k):
    out = {}
    for qb, qid, qv in q:
        cands = []
        for cb, cid, cv in c:
            if cb != qb:
                continue
            nq, nc = max(np.linalg.norm(qv), 1e-12), max(np.linalg.norm(cv), 1e-12)
            cands.append((-round(float(np.dot(qv, cv) / nq / nc), 9), cid))
        out[(qb, qid)] = [cid for _, cid in sorted(cands)[:k]]
    return out


def test_tiled_topk_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    q = [(b, i, rng.normal(size=6).round(1).tolist()) for i, b in enumerate(["x"] * 23 + ["y"] * 9)]
    c = [(b, 100 + i, rng.normal(size=6).round(1).tolist()) for i, b in enumerate(["x"] * 31 + ["y"] * 3 + ["z"] * 4)]
    c.append(("x", 500, c[0][2]))      # exact tie with candidate 100
    c.append(("x", 501, [0.0] * 6))    # zero vector: similarity 0
    qd = spark.createDataFrame(q, "blk string, qid long, vec array<double>")
    cd = spark.createDataFrame(c, "blk string, cid long, vec array<double>")
    for tile in (4, 1024):
        got = cosine_topk(qd, cd, 5, ["blk"], tile=tile).collect()
        res = {}
        for r in sorted(got, key=lambda r: r["rank"]):
            res.setdefault((r.blk, r.qid), []).append(r.cid)
        assert res == _brute(q, c, 5)


def test_k_larger_than_block(spark):
    qd = spark.createDataFrame([("y", 1, [1.0, 0.0])], "blk string, qid long, vec array<double>")
    cd = spark.createDataFrame([("y", 7, [1.0, 1.0]), ("y", 8, [0.0, 1.0])], "blk string, cid long, vec array<double>")
    r = cosine_topk(qd, cd, 10, ["blk"]).orderBy("rank").collect()
    assert [x.cid for x in r] == [7, 8]
    assert abs(r[0].sim - 2 ** -0.5) < 1e-12 and abs(r[1].sim) < 1e-12


def test_index_prunes_tiles_of_clustered_vectors(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(20, 12))
    c = [("x" if i % 5 else "y", i, (centres[i % 20] + 0.05 * rng.normal(size=12)).tolist()) for i in range(3000)]
    c += [("x", 5000 + i, c[1][2]) for i in range(150)]  # a crowd of ties, more than a tile
    q = [("x" if i % 2 else "y", i, (centres[i % 20] + 0.05 * rng.normal(size=12)).tolist()) for i in range(200)] + [("x", 900, [0.0] * 12), ("z", 901, [1.0] * 12)]
    qd = spark.createDataFrame(q, "blk string, qid long, vec array<double>").repartition(3)
    cd = spark.createDataFrame(c, "blk string, cid long, vec array<double>").repartition(3)
    visits = {}
    got = {}
    for r in sorted(cosine_topk(qd, cd, 7, ["blk"], tile=64, visits=visits).collect(), key=lambda r: r["rank"]):
        got.setdefault((r.blk, r.qid), []).append(r.cid)
    want = {k: v for k, v in _brute(q, c, 7).items() if v}
    assert got == want
    assert visits["all"] > 5000 and visits["visited"] < 0.5 * visits["all"]
    plain = {}
    for r in sorted(cosine_topk(qd, cd, 7, ["blk"], most=4000).collect(), key=lambda r: r["rank"]):
        plain.setdefault((r.blk, r.qid), []).append(r.cid)
    assert plain == want


def test_index_of_nothing(spark):
    qd = spark.createDataFrame([("y", 1, [1.0, 0.0])], "blk string, qid long, vec array<double>")
    cd = spark.createDataFrame([("y", 7, [1.0, 1.0]), (None, 8, [0.0, 1.0])], "blk string, cid long, vec array<double>")
    assert cosine_topk(qd, cd.where("false"), 3, ["blk"]).count() == 0
    assert cosine_topk(qd.where("false"), cd, 3, ["blk"]).count() == 0
    assert [r.cid for r in cosine_topk(qd, cd, 3, ["blk"]).collect()] == [7]


def test_known_kth_leaves_pairs_below_it_out(spark):
    rng = np.random.default_rng(5)
    left, right = (T._Rows(pd.Series(list(rng.normal(size=(n, 8)).astype(np.float32)))) for n in (150, 700))
    exact = np.round((left.raw / left.norms[:, None]) @ (right.raw / right.norms[:, None]).T, 9)
    least = np.sort(exact, axis=1)[:, -3]
    least[:2] = -2.0, 1.0  # nothing known; nothing reaches it
    rows, cols, _ = T._best(left, right, 9, least)
    for i in range(len(exact)):
        want = [c for c in np.lexsort((np.arange(exact.shape[1]), -exact[i]))[:9] if exact[i, c] >= least[i]]
        assert cols[rows == i].tolist() == want
    assert np.bincount(rows, minlength=4)[:4].tolist() == [9, 0, 3, 3]


def test_routes_are_cut_into_small_batches(monkeypatch):
    monkeypatch.setattr(T, "PAIR_ROWS", 8)
    v = np.random.default_rng(2).normal(size=(50, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(50, dtype=np.int32)), pa.array(np.arange(50)), pa.array(list(v)), pa.array([None] * 50, pa.float64())],
                                       ["_b", "qid", "vec", "_kth"])
    run = T._route_fn([np.eye(3, 4)], [np.array([5, 5, 5])], [np.array([0.1, 0.1, 0.1])], 5, True)
    out = list(run([batch]))
    assert max(b.num_rows for b in out) <= 8 and sum(b.num_rows for b in out) == 100  # two further tiles each


def test_product_is_a_few_queries_wide(spark):
    """A matrix of cosines held at once is at most 64 x 65,536 numbers of four bytes."""
    assert T.MATMUL_ROWS * T.TILE_ROWS * 4 <= 1 << 24


def _side(key, ids, vectors):
    """Rows of one block as a cogroup's call gets them."""
    return pa.table({"blk": ["x"] * len(ids), key: ids, "vec": pa.array(list(vectors), pa.list_(pa.float32()))}).to_pandas()


def test_parts_of_a_cell_give_the_best_of_all(monkeypatch):
    monkeypatch.setattr(T, "PART_ROWS", 16)
    monkeypatch.setattr(T, "BLOCK_ROWS", 10)
    monkeypatch.setattr(T, "MATMUL_ROWS", 4)
    monkeypatch.setattr(T, "PAIR_ROWS", 8)
    rng = np.random.default_rng(8)
    c = rng.normal(size=(130, 6)).astype(np.float32)
    c[40:110] = c[3]  # ties over several parts
    cid = rng.permutation(130)
    q = np.concatenate([rng.normal(size=(45, 6)), c[3:4]]).astype(np.float32)
    qd, cd = _side("qid", np.arange(46), q), _side("cid", cid, c)
    want = _brute([("x", i, v.astype(float)) for i, v in enumerate(q)], [("x", int(i), v.astype(float)) for i, v in zip(cid, c)], 7)
    for k in (7, 40):
        got = {}
        out = T._tile_topk_fn(["blk"], "qid", "cid", "vec", k)(qd, cd)
        for r in sorted(out.to_dict("records"), key=lambda r: (-round(r["sim"], 9), r["cid"])):
            got.setdefault((r["blk"], r["qid"]), []).append(r["cid"])
        assert {key: ids[:7] for key, ids in got.items()} == want
        assert all(len(ids) == k for ids in got.values())


def test_a_call_copies_no_side():
    """Beside the rows given, a call holds no copy of a side: matrices, unit vectors and cosines are of a few rows."""
    rng = np.random.default_rng(9)
    qd = _side("qid", np.arange(2000), rng.normal(size=(2000, 64)))
    cd = _side("cid", np.arange(60_000), rng.normal(size=(60_000, 64)))
    run = T._tile_topk_fn(["blk"], "qid", "cid", "vec", 3)
    tracemalloc.start()
    try:
        assert len(run(qd, cd)) == 6000
        assert tracemalloc.get_traced_memory()[1] < 60_000 * 64 * 4
    finally:
        tracemalloc.stop()


def test_ragged_vectors_are_an_error():
    with pytest.raises(ValueError, match="3 to 5"):
        T._Rows(pd.Series([np.ones(3), np.ones(5)]))


def test_tables_of_blocks_and_tiles_start_no_python_workers(spark, monkeypatch):
    """A list of rows given to ``createDataFrame`` is read by Python workers of a kind of its own."""
    given, real = [], SparkSession.createDataFrame
    qd = spark.createDataFrame([("y", 1, [1.0, 0.0])], "blk string, qid long, vec array<double>")
    cd = spark.createDataFrame([("y", i, [1.0, float(i)]) for i in range(9)], "blk string, cid long, vec array<double>")
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **o: (given.append(type(data)), real(self, data, *a, **o))[1])
    assert [r.cid for r in cosine_topk(qd, cd, 2, ["blk"], tile=4).orderBy("rank").collect()] == [0, 1]
    assert given and set(given) == {pa.Table}


def test_blocks_without_queries_are_not_written(spark, monkeypatch):
    written, real = [], T.cut_lineage
    monkeypatch.setattr(T, "cut_lineage", lambda df: (written.append(real(df)), written[-1])[1])
    qd = spark.createDataFrame([("y", 1, [1.0, 0.0])], "blk string, qid long, vec array<double>")
    cd = spark.createDataFrame([(b, i, [1.0, float(i)]) for i in range(9) for b in "xyz"], "blk string, cid long, vec array<double>")
    visits = {}
    assert [r.cid for r in cosine_topk(qd, cd, 2, ["blk"], tile=4, visits=visits).orderBy("rank").collect()] == [0, 1]
    assert [df.count() for df in written if "cid" in df.columns and "vec" in df.columns] == [9]
    assert visits["all"] <= 3
