"""op1 (SpotSigs) and op10 (SimHash) against plain Python."""
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from pairlens.llm import op01_spotsigs as spot
from pairlens.llm import op10_simhash as sim
from pairlens.llm import ordering


def jaccard(a, b):
    a, b = set(a.tolist()), set(b.tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


def test_signatures_are_chains_behind_anchors():
    import zlib

    got = spot.signatures("The green house is near the old river bank")
    want = {xxhash.xxh32_intdigest(s) for s in ("the green house", "is near old", "the old river")}
    assert set(got.tolist()) == want and zlib
    assert len(spot.signatures("")) == 0 and len(spot.signatures("!!")) == 0
    assert len(spot.signatures("green house")) == 1  # no anchor: all words
    assert spot.signatures("the the the a b c").tolist() == spot.signatures("The THE the a b c").tolist()


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.8, 1.0])
def test_pruned_jaccard_and_partitions_lose_no_pair(threshold):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint32)) for _ in range(60)]
    sets += sets[:5]
    for a in sets[:20]:
        for b in sets:
            j = jaccard(a, b)
            assert spot.likeness(a, b, threshold) == (pytest.approx(j) if j >= threshold else 0.0)
    if threshold:
        lows = spot.length_partitions(threshold, 50)
        part = [max(k for k, low in enumerate(lows) if low <= len(x)) for x in sets]
        assert all(abs(part[i] - part[k]) <= 1 for i in range(len(sets)) for k in range(i) if jaccard(sets[i], sets[k]) >= threshold)


def plain_classes(prints, threshold):
    """(class, links) by document from all pairs of distinct sets."""
    sets = {tuple(s) for _, s in prints}
    near = {a: [b for b in sets if a != b and jaccard(np.array(a), np.array(b)) >= threshold and a and b] for a in sets}
    seen, label = {}, {}
    for a in sets:
        if a not in seen:
            group, todo = {a}, [a]
            while todo:
                todo += [b for b in near[todo.pop()] if b not in group and not group.add(b)]
            least = min((i for i, s in prints if tuple(s) in group and i is not None), default=None)
            seen.update(dict.fromkeys(group)), label.update(dict.fromkeys(group, least))
    return Counter((i, label[tuple(s)], len(near[tuple(s)])) for i, s in prints)


@pytest.mark.parametrize("tile, sketch", [(1024, 1 << 20), (3, 64)])
def test_near_duplicates_of_all_documents(spark, edge_docs, edge_rows, no_docs, monkeypatch, tile, sketch):
    monkeypatch.setattr(spot, "TILE_SETS", tile)
    monkeypatch.setattr(spot, "SKETCH", sketch)
    from tests.llm.conftest import sentence

    rows = [(r[0], r[1]) for r in edge_rows]
    for k in range(6):  # near copies: a word changed here and there
        words = sentence(900 + k % 2, 400).split()
        for j in range(12):
            rows.append((1000 + 20 * k + j, " ".join(w if (i + j) % (37 + 5 * j) else f"w{j}" for i, w in enumerate(words))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(map(tuple, spot.near_duplicates(docs).collect()))
    want = plain_classes([(i, spot.signatures(t or "").tolist()) for i, t in rows], spot.THRESHOLD)
    assert got == want and max(n for _, _, n in want) > 5 and len({c for _, c, n in want if n}) > 1
    assert spot.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("rows", [4096, 7])
def test_documents_meet_their_followers(edge_docs, edge_rows, monkeypatch, rows):
    monkeypatch.setattr(ordering, "BUCKET_ROWS", rows)
    got = [tuple(r) for r in spot.compare(edge_docs).collect()]
    assert len(got) == len(edge_rows)
    # rows of one id are ordered by their texts' hash, so compare where ids are single or texts equal
    ids = Counter(r[0] for r in edge_rows)
    order = sorted({(r[0], r[1] or "") for r in edge_rows if r[0] is not None})
    text = {}
    for i, t in order:
        text.setdefault(i, t)
    single = [i for i in sorted(text) if ids[i] == 1]
    by_id = {r[0]: r for r in got}
    for a, b in zip(single, single[1:]):
        if any(a < i < b for i in text):
            continue
        x, y = text[a], text[b]
        half = len(x) // 2
        edited = x[: len(x) - half] + y[:half]
        doc_id, n, sha, print_, edited_print, near, after = by_id[a]
        assert (n, sha) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        f, g, h = map(spot.signatures, (x, edited, y))
        assert (print_, edited_print) == (spot.packed(f), spot.packed(g))
        assert near == pytest.approx(jaccard(f, g)) and after == pytest.approx(jaccard(f, h))


def test_last_document_is_followed_by_the_first(spark):
    df = spark.createDataFrame([(3, "the green house runs"), (9, "of old stones and rivers here"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in spot.compare(df).collect()}
    assert got[9].edited_sha256 == hashlib.sha256(("of old stones and rivers here"[:15] + "the green hous").encode()).hexdigest()
    assert got[5].near_edited == 1.0 and got[5].n_chars == 0
    alone = spot.compare(df.where("doc_id = 3")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_no_rows(no_docs):
    assert spot.compare(no_docs).count() == 0
    assert sim.near_duplicates(no_docs).count() == 0
    assert sim.one_of_each(no_docs).count() == 0


def plain_simhash(text, k=3):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i: i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits):
    u = np.unique(prints)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= bits
    label = np.arange(len(u))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(u))])
        if (new == label).all():
            return {int(a): int(b) for a, b in zip(u, label)}
        label = new


def test_simhash_equals_brute_force(edge_docs, edge_rows):
    prints = [plain_simhash(r[1]) for r in edge_rows]
    group = components(np.array(prints, dtype=np.uint64), sim.MAX_BITS)
    least = {}
    for r, p in zip(edge_rows, prints):
        if r[0] is not None:
            least[group[p]] = min(least.get(group[p], 1 << 62), r[0])
    want = Counter((r[0], p, least.get(group[p])) for r, p in zip(edge_rows, prints))
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in sim.near_duplicates(edge_docs).collect())
    assert got == want


def test_one_document_of_each_group_stays_with_all_columns(edge_docs, edge_rows):
    kept = sim.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    rows = kept.collect()
    group = components(np.array([plain_simhash(r[1]) for r in edge_rows], dtype=np.uint64), sim.MAX_BITS)
    assert len(rows) == len(set(group.values()))
    assert sum(r.doc_id is not None and 200 <= r.doc_id < 230 for r in rows) <= 1


def test_links_across_blocks_are_found(spark, monkeypatch):
    monkeypatch.setattr(sim, "BLOCK_CODES", 40)
    rng = np.random.default_rng(3)
    walk = [rng.integers(0, 1 << 63, 150, dtype=np.uint64)]
    for _ in range(8):
        walk.append(walk[-1][:30] ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)))
    u = np.unique(np.concatenate([*walk, np.arange(50, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(v),) for v in u.view(np.int64)], "fp long").repartition(5)
    roots = {r.u & (1 << 64) - 1: r.v & (1 << 64) - 1 for r in sim.component_roots(sim.stars(df, 2)).collect()}
    got, want = {}, {}
    for code, label in components(u, 2).items():
        want.setdefault(label, set()).add(code)
        got.setdefault(roots.get(code, code), set()).add(code)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_gray_order_and_search():
    codes = np.arange(64, dtype=np.uint64)
    order = codes[np.argsort(sim.gray_rank(codes))]
    assert (np.bitwise_count(order[1:] ^ order[:-1]) == 1).all()
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    near = base[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    index = sim.GrayIndex(*[np.unique(base)[np.argsort(sim.gray_rank(np.unique(base)))]] * 2)
    found = sum(len(r) for r, _ in index.search(near, 2))
    assert found == (np.bitwise_count(near[:, None] ^ base[None, :]) <= 2).sum()


def test_one_id_on_a_third_of_the_rows_is_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 50)
    rows = [(7 if i % 3 == 0 else i, f"text {i}") for i in range(3000)] + [(None, f"null {i}") for i in range(300)]
    rows += [((1 << 60) + i, "near the end of doubles") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("key", ordering.order_key())
    placed, n = ordering.in_buckets(df)
    got = sorted(((r.bucket, r.key, r.text_hash) for r in placed.collect()))
    assert [x[1:] for x in got] == sorted(x[1:] for x in got) and len(got) == len(rows)  # buckets ascend with key and hash
    sizes = Counter(b for b, _, _ in got)
    assert max(sizes) < n and max(c for b, c in sizes.items()) <= 210 and sum(c > 150 for c in sizes.values()) <= 1
    assert len({b for b, key, _ in got if key == 7}) > 10 and len({b for b, key, _ in got if key == ordering.LEAST}) > 2
