"""op12 against a plain Merkle tree, and its SQL."""
import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from pairlens.llm import op12_merkle as mk
from tests.conftest import SF_SMALL


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The last node, and of each leaf the (before, behind) of its ancestors."""
    proofs, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            run = nodes[p - p % 3: p - p % 3 + 3]
            proofs[i].append(("".join(run[:p % 3]), "".join(run[p % 3 + 1:])))
        place = [p // 3 for p in place]
        nodes = [h(*nodes[i: i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], proofs


def plain(rows):
    """Rows are doc_id, text, lang, source, n_chars."""
    by = defaultdict(list)
    for i, text, lang, source, n in rows:
        cut = text if text is None or i is None or zlib.crc32(str(i).encode()) % 2 else text.replace("\n", "")
        by[source].append((i, leaf((i, source, lang, n, text)), leaf((i, source, lang, n, cut))))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
        trees[s] = climb([r[1] for r in by[s]])
    root, above = climb([trees[s][0] for s in order])
    out = Counter()
    for s, up in zip(order, above):
        for (i, own, tampered), path in zip(by[s], trees[s][1]):
            path = path + up
            node = tampered
            for before, behind in path:
                node = h(before, node, behind)
            out[(i, own, trees[s][0], root, h(*(b + a for b, a in path)), node, node == root)] += 1
    return out


def test_manifest_of_edge_rows(spark, edge_docs, edge_rows, no_docs):
    got = mk.manifest(edge_docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain(edge_rows)
    assert Counter(map(tuple, got.collect())) == want
    assert mk.manifest(no_docs).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 83])
def test_trees_of_every_shape(spark, n, monkeypatch):
    monkeypatch.setattr(mk, "BLOCK", 9)  # many windows
    monkeypatch.setattr(mk, "COPIES", 7)
    rows = [(i, f"line {i}\nnext" if i % 3 else "one line", None, "a", i) for i in range(n)]
    rows += [(i, "x\ny", "en", f"s{i}", None) for i in range(n % 5)]
    rows += [(5, "same\ntext", "en", "hot", 9)] * (2 * n)  # one row many times
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = plain(rows)
    assert Counter(map(tuple, mk.manifest(docs).collect())) == want
    assert n < 9 or {r[-1] for r in want} == {True, False}


def test_one_source_alone(spark):
    rows = [(7, "a\nb", "en", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(map(tuple, mk.manifest(docs).collect())) == plain(rows)


def test_manifest_is_native(edge_docs):
    plan = mk.manifest(edge_docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))


def test_manifest_equals_its_sql(spark):
    from tools.check_oracle import compare, duck

    assert compare(spark, duck(SF_SMALL), "op12_merkle", SF_SMALL).endswith(" OK")
