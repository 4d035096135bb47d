import hashlib

from pairlens.operators.sampling import seeded_positions


def test_positions_dense_and_md5_ordered(spark):
    rows = [("a" if i % 3 else "b", i) for i in range(200)] + [(None, 1000 + i) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, id long")
    for salt in (0, 1, 2):
        got = seeded_positions(df, ["g"], "id", 42, salt_chars=salt).collect()
        by = {}
        for r in got:
            by.setdefault(r.g, []).append((r._pos, r.id, r._n))
        for g, items in by.items():
            items.sort()
            assert [p for p, _, _ in items] == list(range(len(items)))
            assert all(n == len(items) for _, _, n in items)
            expect = sorted((hashlib.md5(f"42|{i}".encode()).hexdigest(), i) for _, i, _ in items)
            assert [i for _, i in expect] == [i for _, i, _ in items]
