"""op2 (permutation index), op5 (mixing), op7 (k-d shards) and the pipeline."""
import math
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pairlens.llm import op02_permutation as perm
from pairlens.llm import op05_mixing as mix
from pairlens.llm import op07_sharding as kd
from pairlens.llm import op10_simhash as sim
from pairlens.llm.registry import ORACLE, QUERIES
from tests.conftest import SF_SMALL


def brute(rows, k, every):
    out = {}
    for q, v in rows:
        if q % every == 0:
            near = sorted((math.dist(v, w), i) for i, w in rows if i != q)[:k]
            out[q] = near
    return out


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(perm, "BLOCK_ROWS", 400)
    monkeypatch.setattr(perm, "RERANK_LEAST", 100)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(1200, 16))
    v[300:700] = v[299] + 1e-3 * rng.normal(size=(400, 16))  # a crowd
    v[700:760] = v[5]  # equal vectors
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    table = spark.createDataFrame([(i, x, "own") for i, x in rows], "vec_id long, embedding array<double>, block string").repartition(3)
    want = brute(rows, 10, 100)
    got = {}
    for r in sorted(perm.search(table).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    assert set(got) == set(want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    assert got[700] == [(0.0, i) for i in [5, *range(701, 710)]]
    for q, found in got.items():
        assert found == sorted(found)
        assert all(s == pytest.approx(math.dist(v[q], v[i]), abs=1e-12) for s, i in found)


def test_recall_inside_a_crowd_of_a_third(spark):
    """One full block at the production share; queries inside the crowd and outside apart."""
    rng = np.random.default_rng(16)
    n, crowd = perm.BLOCK_ROWS, perm.BLOCK_ROWS // 3
    v = rng.normal(size=(n, 16))
    v[:crowd] = v[0] + 1e-3 * rng.normal(size=(crowd, 16))
    assert perm.RERANK * n < crowd
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = {}
    for r in perm.search(table).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = {True: [], False: []}
    for q in range(0, n, perm.QUERY_EVERY):
        far = ((v - v[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hits[q < crowd].append(len(found[q] & set(np.argsort(far)[:10].tolist())) / 10)
    assert len(hits[True]) == 28 and np.mean(hits[True]) == np.mean(hits[False]) == 1


def test_unfit_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (6, [None, 1.0]), (7, [1.0]), (8, []), (None, [1.0, 1.0]), (9, [0.0, 2.0]), (9, [0.0, 2.0]), (100, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, round(r.score, 9)) for r in perm.search(table).collect()}
    assert got == {(0, 1): (1, 0.0), (0, 2): (100, round(2 ** 0.5, 9)), (0, 3): (9, round(5 ** 0.5, 9)),
                   (100, 1): (9, 1.0), (100, 2): (0, round(2 ** 0.5, 9)), (100, 3): (1, round(2 ** 0.5, 9))}
    assert perm.search(table.where("false")).count() == 0


def test_many_rows_of_the_querys_own_id(spark, monkeypatch):
    monkeypatch.setattr(perm, "BLOCK_ROWS", 60)
    monkeypatch.setattr(perm, "RERANK_LEAST", 12)
    rng = np.random.default_rng(9)
    v = rng.normal(size=(230, 8))
    v[:30] = v[0] + 1e-4 * rng.normal(size=(30, 8))
    ids = [100] * 30 + list(range(101, 301))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in perm.search(table).collect()}
    near = {i: min(math.dist(v[a], x) for a in range(30)) for i, x in zip(ids[30:], v[30:])}
    want = sorted((d, i) for i, d in near.items())[:10]
    assert [got[100, r][0] for r in range(1, 11)] == [i for _, i in want]
    assert all(got[100, r][1] == pytest.approx(d, abs=1e-12) for r, (d, _) in enumerate(want, 1))


def test_footrule_is_the_footrule():
    rng = np.random.default_rng(8)
    ranked = np.array([rng.permutation(12)[:5] for _ in range(40)])
    files = perm.InvertedFiles(ranked, 12)

    def far(a, b):
        a, b = a.tolist(), b.tolist()
        return sum(abs((a.index(p) if p in a else 5) - (b.index(p) if p in b else 5)) for p in set(a + b))

    got = files.footrule(ranked[3])
    want = np.array([far(ranked[3], r) for r in ranked])
    assert len(set((got - want).tolist())) == 1


def plain_poisson(u, mean):
    k, p = 0, math.exp(-mean)
    below = p
    while below < u:
        k += 1
        p *= mean / k
        below += p
    return k


def test_poisson_inversion(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    rows = [(float(u), float(m)) for u, m in zip(rng.random(400), rng.choice([0.0, 0.01, 0.5, 1.3, 7.0, 60.0, 400.0], 400))]
    got = spark.createDataFrame(rows, "u double, m double").withColumn("n", mix.poisson(F.col("u"), F.col("m"))).collect()
    assert all(r.n == plain_poisson(r.u, r.m) for r in got)


def test_mixing_of_edge_rows(edge_docs, edge_rows, no_docs):
    rates = {r.source: r.rate for r in mix.rates(edge_docs).collect()}
    got = Counter((r.doc_id, r.text) for r in mix.replicated(edge_docs).collect())
    want = Counter()
    for r in edge_rows:
        u = (int(__import__("hashlib").md5(f"{mix.SEED}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        want[(r[0], r[1])] += plain_poisson(u, rates[r[3]])
    assert got == +want
    out = mix.replicated(edge_docs, copy="nth", order="place")
    assert out.columns == [*edge_docs.columns, "nth", "place"]
    assert mix.replicated(no_docs).count() == 0


def test_explicit_weights_are_met(spark):
    from pyspark.sql import functions as F

    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"),
                                      F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 1, "b").otherwise("c").alias("source"))
    n = {r["source"]: r["count"] for r in mix.replicated(docs, {"a": 3, "b": 1}).groupBy("source").count().collect()}
    assert "c" not in n and abs(n["a"] - 15_000) < 500 and abs(n["b"] - 5000) < 300


def test_tiny_source_beside_a_huge_one(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.range(2010).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 10, "x").otherwise(F.repeat(F.lit("long "), 2000)).alias("text"),
                                    F.when(F.col("id") < 10, F.lit(None)).otherwise("huge").alias("source"))
    rate = {r.source: r.rate for r in mix.rates(docs).collect()}
    assert rate[None] == pytest.approx((2e7 + 10) / (10 + math.sqrt(10 * 2e7))) and rate[None] > 2 * mix.MAX_RATE
    monkeypatch.setattr(mix, "COPIES_STEP", 100)
    got = mix.replicated(docs).where("source is null").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.countDistinct("copy").alias("copies"), F.max("copy").alias("last")).collect()
    assert len(got) == 10 and all(r.n == r.copies == r.last and abs(r.n - rate[None]) < 6 * math.sqrt(rate[None]) for r in got)
    parts = math.ceil(rate[None] / mix.MAX_RATE)
    for r in got:
        u = [(int(__import__("hashlib").md5(f"{mix.SEED}#{j}:{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52) for j in range(1, parts + 1)]
        assert r.n == sum(plain_poisson(x, rate[None] / parts) for x in u)


def test_large_poisson_counts_have_mean_and_variance(spark):
    from pyspark.sql import functions as F

    n = [r.n for r in spark.range(1000).select(mix.drawn("s", F.col("id"), F.lit(1700.0)).alias("n")).collect()]
    assert abs(np.mean(n) - 1700) < 5 * math.sqrt(1700 / 1000) and 0.8 < np.var(n) / 1700 < 1.25


def test_mixing_is_native(edge_docs):
    plan = mix.replicated(edge_docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))


def test_shards_of_edge_rows(edge_docs, edge_rows, no_docs):
    got = kd.slotted(kd.kd_shards(edge_docs, 5), 5).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in edge_rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {r.shard for r in got} <= set(range(5))
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert kd.slotted(kd.kd_shards(no_docs, 5), 5).count() == 0


def test_shards_are_near_equal(spark, monkeypatch):
    monkeypatch.setattr(kd, "SLOT_ROWS", 100)
    from pyspark.sql import functions as F

    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text")).otherwise(
            F.repeat(F.lit("ab "), (F.col("id") % 50 + 1).cast("int"))).alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"))
    rows = kd.slotted(kd.kd_shards(docs), kd.SHARDS).collect()
    size = Counter()
    for r in rows:
        size[r.shard] += r.size
    assert len(size) == 24 and max(size.values()) <= 1.05 * min(size.values())
    for s in size:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_rows_equal_in_everything_are_parted(spark, monkeypatch):
    """A third of the rows is one row many times: shards stay near equal in bytes, copies are shuffled apart."""
    from pyspark.sql import functions as F

    i = F.col("id")
    docs = spark.range(6000).select(
        F.when(i % 3 == 0, F.lit(5)).otherwise(i).alias("doc_id"), F.when(i % 3 == 0, F.lit("the same text")).otherwise(
            F.repeat(F.lit("ab "), (i % 7 + 1).cast("int"))).alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"))
    monkeypatch.setattr(kd, "SLOT_ROWS", 100)
    rows = kd.slotted(kd.kd_shards(docs), kd.SHARDS).collect()
    size = Counter()
    for r in rows:
        size[r.shard] += r.size
    assert len(rows) == 6000 and len(size) == 24 and max(size.values()) <= 1.05 * min(size.values())
    for s in size:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = Counter(r.p for r in mix.replicated(docs).select(F.spark_partition_id().alias("p")).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(parts.values()) < 1.3 * sum(parts.values()) / 4


def test_registry():
    assert [k for k in QUERIES if k.startswith("op")] == sorted((k for k in QUERIES if k.startswith("op")), key=lambda k: int(k[2:].split("_")[0]))
    assert len(QUERIES) == 14 and "pipeline" in QUERIES and set(ORACLE) <= set(QUERIES)


def test_mixing_equals_its_sql(spark):
    from tools.check_oracle import compare, duck

    assert compare(spark, duck(SF_SMALL), "op5_mixing", SF_SMALL).endswith(" OK")


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    names, was = docs.columns, {r.doc_id: r for r in docs.collect()}
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.collect())
        assert k == 4 or docs.columns == names
    language, deduped, redacted, mixed, packed = kept
    assert len(language) >= 0.98 * len(was)
    ids = {r.doc_id for r in language}
    comp = {r.doc_id: r.component_id for r in sim.near_duplicates(spark.read.parquet(str(tmp_path / "0"))).collect()}
    assert {r.doc_id for r in deduped} == {i for i in ids if comp[i] == i}
    assert {r.doc_id for r in redacted} == {r.doc_id for r in deduped}
    assert all(r.n_chars == len(r.text) for r in redacted)
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in redacted} and len(mixed) > 0.5 * len(redacted)
    tokens = Counter()
    for r in packed:
        tokens[r.doc_id] += r.length
    totals = {r.doc_id: r.doc_tokens for r in packed}
    copies = Counter(r.doc_id for r in mixed)
    assert all(tokens[i] == totals[i] * n for i, n in copies.items()) and set(tokens) == set(copies)
