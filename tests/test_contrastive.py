import random
import re
from collections import Counter, defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from pairlens.constants import CONCEPTS
from pairlens.functions.seeded import distinct_draws
from pairlens.operators import contrastive as C
from pairlens.sources import fixtures
from pairlens.sources.fixtures import Fixtures
from tests.conftest import SF_SMALL


def roles_of(rows):
    """(treatment, q) -> role -> members, by comparing all pairs of rows (dicts)."""
    out = defaultdict(lambda: defaultdict(set))
    for t in CONCEPTS:
        conf = C.confounders(t)
        for q in rows:
            for m in rows:
                if m["rid"] == q["rid"] or m["split"] != q["split"]:
                    continue
                equal = sum(m[f"{c}_predictions"] is not None and m[f"{c}_predictions"] == q[f"{c}_predictions"] for c in conf)
                same = m["original_id"] == q["original_id"]
                own = out[t, q["rid"]]
                own["approx" if not same and equal == 3 else "negative"].add(m["rid"])
                a, b = m[f"{t}_predictions"], q[f"{t}_predictions"]
                other = m["text"] is None or q["text"] is None or m["text"] != q["text"]
                source = m["generation_index"] == -1
                if same and other and equal == 3 and (a is None or b is None or a != b) and (m["intervention_aspect"] == t or source):
                    own["t_cf"].add(m["rid"])
                if same and other and equal == 2 and a is not None and a == b and (m["intervention_aspect"] in conf or source):
                    own["c_cf"].add(m["rid"])
    return out


def table(spark, n=90, seed=1):
    r = random.Random(seed)
    rows = [dict(split=["train", "validation"][i % 7 == 0], rid=i, k=i, original_id=r.choice([0, 0, 0, r.randrange(12)]) * 2 + (i % 7 == 0), text=r.choice(["a", "b", "c", None, f"t{i}"]),
                 text_len=5, generation_index=r.choice([-1, 0, 1, 2]), intervention_aspect=r.choice([*CONCEPTS, None]),
                 **{f"{c}_predictions": r.choice(["Negative", "Positive", "unknown", "unknown", None]) for c in CONCEPTS}) for i in range(n)]
    schema = "split string, rid long, k long, original_id long, text string, text_len int, generation_index int, intervention_aspect string, " + ", ".join(
        f"{c}_predictions string" for c in CONCEPTS)
    return rows, spark.createDataFrame([tuple(x[f.split()[0]] for f in schema.split(", ")) for x in rows], schema)


def test_roles_of_random_rows(spark):
    rows, fs = table(spark)
    want = roles_of(rows)
    tcf, ccf = C.treatment_members(fs, fs), C.confounder_members(fs, fs)
    for role, found in (("t_cf", tcf), ("c_cf", ccf)):
        got = defaultdict(set)
        for r in found.collect():
            got[r.treatment, r.q_rid].add(r.m_rid)
        assert {k: v for k, v in got.items()} == {k: v[role] for k, v in want.items() if v[role]}
    counts = {(r.treatment, r.q_rid): (r.n_tcf, r.n_ccf, r.n_approx, r.n_negative) for r in C.role_counts(fs, fs, tcf, ccf).collect()}
    assert counts == {k: tuple(len(v[x]) for x in ("t_cf", "c_cf", "approx", "negative")) for k, v in want.items()}
    samples = defaultdict(lambda: defaultdict(list))
    queries = C.by_treatment(fs).select("treatment", "split", F.col("rid").alias("q_rid"))
    for r in C.sample_members(fs, queries, tcf, ccf).collect():
        samples[r.treatment, r.q_rid][r.role].append((r.j, r.m_rid))
    for key, of in want.items():
        for role, members in of.items():
            got = samples[key][role]
            ids = {m for _, m in got}
            assert ids <= members and len(ids) == len(got) == min(5, len(members))
            assert sorted(j for j, _ in got) == list(range(len(got)))


def test_samples_are_uniform(spark):
    """Over many queries with one role set, each pair of members is drawn equally often (chi square)."""
    n, m, k = 4000, 7, 3
    draws = spark.range(n).select(distinct_draws(3, F.lit(m), k, "id").alias("d")).collect()
    pairs = Counter(p for r in draws for p in combinations(sorted(r.d), 2))
    assert all(len(set(r.d)) == k and min(r.d) >= 0 and max(r.d) < m for r in draws) and len(pairs) == 21
    want = n * 3 / 21
    assert sum((c - want) ** 2 / want for c in pairs.values()) < 45.3  # 20 degrees of freedom, 0.1 %
    few = spark.range(5).select(distinct_draws(3, F.col("id"), k, "id").alias("d")).collect()
    assert [len(r.d) for r in few] == [0, 1, 2, 3, 3]


def test_sampled_pairs_are_equally_likely(spark):
    """The whole sampler: rows of 1,500 originals in one confounder group, 8 other rows drawn from by each."""
    conf = {f"{c}_predictions": "Positive" for c in CONCEPTS}
    schema = "split string, rid long, original_id long, text string, intervention_aspect string, generation_index int, " + ", ".join(f"{c} string" for c in conf)
    members = [("a", i, i, f"m{i}", None, -1, *conf.values()) for i in range(9)]
    seen = Counter()
    for seed in range(40):
        fs = spark.createDataFrame(members, schema)
        empty = fs.where("false").select(F.lit("food").alias("treatment"), "split", F.col("rid").alias("q_rid"), F.col("rid").alias("m_rid"))
        queries = fs.select(F.lit("food").alias("treatment"), "split", F.col("rid").alias("q_rid"))
        by = defaultdict(set)
        for r in C.sample_members(fs, queries, empty, empty, seed, 2).collect():
            by[r.q_rid].add(r.m_rid)
        for q, own in by.items():
            assert q not in own and len(own) == 2
            seen[tuple(sorted((x - q) % 9 for x in own))] += 1
    want = 40 * 9 / 28
    assert len(seen) == 28 and sum((c - want) ** 2 / want for c in seen.values()) < 55.5  # 27 degrees, 0.1 %


def test_counts_scan_the_mining_set_once(spark):
    _, fs = table(spark)
    plans = []

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    real, C.cut_lineage = C.cut_lineage, cut
    try:
        C.group_sizes(fs)
    finally:
        C.cut_lineage = real
    assert len(plans) == 1 and plans[0].count("Scan") == 1 and "Expand" in plans[0]


def test_role_invariants(spark):
    fs = Fixtures(spark, SF_SMALL).mining_set
    qs = C.query_rows(fs, "-101")
    tcf, ccf = C.treatment_members(fs, qs), C.confounder_members(fs, qs)
    n = {r.split: r["count"] for r in fs.groupBy("split").count().collect()}
    counts = C.role_counts(fs, qs, tcf, ccf).collect()
    assert len(counts) == 4 * qs.count() and all(r.n_approx + r.n_negative == n[r.split] - 1 for r in counts)
    assert tcf.join(ccf, ["treatment", "q_rid", "m_rid"]).count() == 0  # t_cf and c_cf are disjoint


def test_counts_by_treatment_hold_every_query(spark):
    from pairlens.plans.queries import QUERIES

    key = ["treatment", "split", "q_rid"]
    sizes = ["n_tcf", "n_ccf", "n_approx", "n_negative"]
    got = QUERIES["contrastive_counts_by_treatment"](spark, SF_SMALL).collect()
    want = {tuple(r[k] for k in key): tuple(r[n] for n in sizes) for r in QUERIES["contrastive_role_counts"](spark, SF_SMALL).collect()}
    assert len(got) == len(want) and {tuple(r[k] for k in key): tuple(r[n] for n in sizes) for r in got} == want
    for r in got:
        own = [v for k, v in want.items() if k[:2] == (r.treatment, r.split)]
        assert (r.n_queries, r.n_kept) == (len(own), sum(min(v) > 0 for v in own))
        assert (r.all_tcf, r.all_ccf, r.all_approx, r.all_negative) == tuple(map(sum, zip(*own)))


def test_losses_on_hand_made_cosines(spark):
    import math

    cos = {"t_cf": [0.9, 0.5], "approx": [0.3], "negative": [-0.2, 0.1], "c_cf": [0.4]}
    rows = [("food", "a", 1, role, i, float(c)) for role, cs in cos.items() for i, c in enumerate(cs)]
    df = spark.createDataFrame(rows, "treatment string, split string, q_rid long, role string, m_rid long, cos double")
    e = {r: [math.exp(c / 0.1) for c in cs] for r, cs in cos.items()}
    got = {r.m_rid: r.loss for r in C.loss_legacy(df, 0.1).collect()}
    for i in range(2):
        pos = e["t_cf"][i] + sum(e["approx"])
        assert abs(got[i] + math.log(pos / (pos + sum(e["negative"]) + sum(e["c_cf"])))) < 1e-9
    mean = {r: sum(math.exp(c) for c in cs) / len(cs) for r, cs in cos.items()}
    want = -math.log((mean["t_cf"] + mean["approx"]) / sum(mean.values()))
    ev = C.evaluation(df, 1, {**C.V1_FIXED, "approx": 0}, 1.0).first()
    no_approx = -math.log(mean["t_cf"] / (mean["t_cf"] + mean["negative"] + mean["c_cf"]))
    assert abs(ev.loss_fixed - want) < 1e-9 and abs(ev.loss - no_approx) < 1e-9


def test_mining_set_shuffles_no_text(spark, monkeypatch):
    plans = []

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString().splitlines())
        return df

    monkeypatch.setattr(fixtures, "cut_lineage", cut)
    fx = Fixtures(spark, SF_SMALL)
    fx.generations
    key = "spark.sql.autoBroadcastJoinThreshold"
    broadcast = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        fx.mining_set
    finally:
        spark.conf.set(key, broadcast)
    below = [lines[i + 1] for lines in plans for i, x in enumerate(lines) if "Exchange hashpartitioning(g_id" in x]
    assert below and any("text_hash" in x for x in below)
    assert not any(re.search(r"[\[ ](generation|text)#\d+[,\]]", x) for x in below)  # hashed alone


def test_temperatures_share_a_pass(spark):
    df = spark.createDataFrame([("food", "a", 1, "t_cf", 2, 0.5)], "treatment string, split string, q_rid long, role string, m_rid long, cos double")
    for out in (C.evaluation(df, 0, C.V0_SWEEP, 0.1), C.loss_grid(df, [1.0, 0.1], [(1, "x", C.V1_SWEEP)])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LogicalRDD") == 1 and "Join" not in plan
        lines = plan.splitlines()
        assert not any("Generate" in x for x in lines[max(i for i, x in enumerate(lines) if "Aggregate" in x):])


def test_cosines_end_by_query_and_are_computed_once(spark):
    rows, fs = table(spark, 12)
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(12)], "text_id long, vec array<double>")
    samples = spark.createDataFrame([("food", "train", 1, "t_cf", m, 0) for m in range(2, 9)], "treatment string, split string, q_rid long, role string, m_rid long, j long")
    key = "spark.sql.autoBroadcastJoinThreshold"
    broadcast = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        out = C.evaluation(C.member_cosines(samples, fs, vectors), 0, C.V0_SWEEP, 0.1)
        lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set(key, broadcast)
    above = lines[:next(i for i, x in enumerate(lines) if "Join" in x)]
    assert sum("Exchange" in x for x in above) == 1 and any("Generate" in x for x in above)  # for the result alone
