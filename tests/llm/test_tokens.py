"""op6 (Re-Pair), op8 (transducer) and op9 (harmonic packing) against the libraries themselves."""
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from pairlens.llm import op06_repair as rep
from pairlens.llm import op08_transducer as fst
from pairlens.llm import op09_packing as pack
from pairlens.llm import ordering, word_ids

PARTS = [" ", "\n", "a", "b", "é", "É", "1", "2", ".", ",", "'s", "'", " ", "́", "漢", "\t", "  ", "😀", "the", "<|endoftext|>",
         "<s>", "K", "ſ", "İ", "\x01", "Σ", "x y", " é", "가", "1 2", "a.", "b,", "▁", "ing", "tion", "    ", "https://", "ко", "ال"]


@pytest.fixture(scope="module")
def odd_texts():
    r = random.Random(1)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(3000)] + ["", "a" * 3000, " " * 700, "漢字" * 500]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_wise_ids_are_the_librarys(odd_texts, name):
    k = word_ids.load_tokenizer(public_tokenizers.path(name))
    want = [e.ids + [7] for e in k.encode_batch(odd_texts, add_special_tokens=False)]
    store = word_ids.WordStore(500)
    for _ in range(2):  # the second time from the cache
        ids, ends = word_ids.encode_column(k, pa.array(odd_texts), 7, store)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want


def test_transducer_counts_are_the_librarys(odd_texts, monkeypatch):
    machine = fst.Transducer(public_tokenizers.path(fst.MODEL))
    want = [len(x) for x in machine.library.encode(odd_texts, num_threads=1)]
    assert machine.counts(pa.array(odd_texts)).tolist() == want
    monkeypatch.setattr(fst, "CHUNK", 40)  # many state maps to compose
    monkeypatch.setattr(fst, "LEAD", 3)
    assert machine.counts(pa.array(odd_texts)).tolist() == want
    assert machine.counts(pa.array([], pa.string())).tolist() == []


def test_token_counts_of_edge_rows(edge_docs, edge_rows, no_docs):
    path = public_tokenizers.path(fst.MODEL)
    library = fst.Transducer(path).library
    want = Counter((r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "")), n > 50) for r in edge_rows)
    assert Counter(map(tuple, fst.token_counts(edge_docs, path, 50).collect())) == want
    assert fst.token_counts(no_docs, path).count() == 0


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(4)
    ids = np.concatenate([np.tile(rng.integers(0, 50, 9), 400), rng.integers(0, 90, 5000), np.full(999, 7), [3]]).astype(np.uint32)
    rules, lengths, symbols = rep.compress(ids, 100)
    assert len(symbols) < 0.7 * len(ids) and len(rules) and lengths.max() > 16
    left, n = np.unique((symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:], return_counts=True)
    assert (n[left >> np.uint64(32) != left & np.uint64(0xFFFFFFFF)] < rep.FREQUENT).all()  # no pair is frequent any more
    data = rep.encode_shard([1, None, 3], np.array([10, 10, len(ids)]), ids, 100)
    shard = rep.Shard(data)
    assert shard.doc_ids == [1, None, 3] and (shard.ids() == ids).all()
    for _ in range(200):
        a = int(rng.integers(0, len(ids)))
        b = int(rng.integers(a, len(ids) + 1))
        assert (shard.ids(a, b) == ids[a:b]).all()
    empty = rep.Shard(rep.encode_shard([], np.zeros(0, np.int64), np.zeros(0, np.uint32), 100))
    assert len(empty.ids()) == 0


def test_repair_nests_its_rules():
    rng = np.random.default_rng(5)
    copies = np.tile(rng.integers(0, 49_408, 20_000), 100).astype(np.uint32)
    rules, lengths, symbols = rep.compress(copies, 49_408)
    assert len(symbols) + len(rules) < 20_000 + 300 and lengths.max() > 10_000
    data = rep.encode_shard([1], np.array([len(copies)]), copies, 49_408)
    assert (rep.Shard(data).ids() == copies).all() and len(data) < 0.02 * copies.nbytes
    run = np.full(100_003, 7, dtype=np.uint32)
    data = rep.encode_shard([1], np.array([len(run)]), run, 49_408)
    assert (rep.Shard(data).ids() == run).all() and len(data) < 1000
    at, rank = np.arange(3000), np.arange(1, 3001, dtype=np.int32)  # overlapping pairs of ever higher rank
    taken = rep.without_overlaps(at, rank)
    assert not (taken[1:] & taken[:-1]).any() and (taken | np.append(taken[1:], False) | np.append(False, taken[:-1])).all()


def test_values_packed_by_bits():
    rng = np.random.default_rng(6)
    for width in (1, 3, 16, 17, 31, 32):
        values = rng.integers(0, 1 << width, 70_001).astype(np.uint32)
        data = np.frombuffer(rep.packed(values, width), dtype=np.uint8)
        assert len(data) == -(-len(values) * width // 8)
        for lo, hi in ((0, len(values)), (1024, 3000), (65_536, 70_001), (8, 8)):
            assert (rep.unpacked(data, width, lo, hi) == values[lo:hi]).all()


@pytest.mark.parametrize("rows", [4096, 9])
def test_shards_return_every_documents_ids(spark, edge_docs, edge_rows, no_docs, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(ordering, "BUCKET_ROWS", rows)
    path = public_tokenizers.path(rep.TOKENIZER)
    k = word_ids.load_tokenizer(path)

    def ids(text):
        return np.array(k.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")

    rep.write_shards(edge_docs, path, str(tmp_path / "a"))
    got = sorted(map(tuple, rep.read_documents(spark, str(tmp_path / "a")).collect()), key=lambda r: r[1])
    at = 0
    for doc_id, start, n, crc in got:
        assert start == at
        at += n
    assert [r[0] for r in got] == sorted((r[0] for r in edge_rows), key=lambda i: -1 if i is None else i)
    want = Counter((r[0], len(x := ids(r[1])), zlib.crc32(x.tobytes())) for r in edge_rows)
    assert Counter((r[0], r[2], r[3]) for r in got) == want
    rep.write_shards(no_docs, path, str(tmp_path / "b"))
    assert rep.read_documents(spark, str(tmp_path / "b")).count() == 0


def test_packing_covers_every_id_once(edge_docs, edge_rows, no_docs):
    path = public_tokenizers.path(pack.TOKENIZER)
    k = word_ids.load_tokenizer(path)
    want = Counter(tuple(k.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in edge_rows)
    rows = pack.pack(edge_docs, path).collect()
    pieces, used, filled = defaultdict(list), defaultdict(list), 0
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        pieces[r.doc_id].append(r)
        used[r.sequence_id].append(r)
    singles = Counter(r[0] for r in edge_rows)
    for doc_id, own in pieces.items():
        if singles[doc_id] == 1:
            ids = [i for r in sorted(own, key=lambda r: r.start) for i in r.ids]
            assert want[tuple(ids)] and own[0].doc_tokens == len(ids)
    assert sum(map(len, (r.ids for r in rows))) == sum(len(t) * n for t, n in want.items())
    padding = 0
    for own in used.values():
        own.sort(key=lambda r: r.offset)
        size = sum(r.length for r in own)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))] and size <= pack.CAPACITY
        padding += 0 if size & (size - 1) == 0 else pack.CAPACITY - size
        filled += size
        kind = own[0].class_docs
        assert kind == 0 or len(own) == kind  # a class's sequences hold its count of pieces
    assert padding <= 0.05 * filled
    assert pack.pack(no_docs, path).count() == 0
    with pytest.raises(ValueError):
        pack.pack(no_docs, path, capacity=1000)


def test_cut_lengths():
    for n in range(1, 5000, 7):
        parts = pack.cut(n, 1024)
        assert sum(parts) == n and max(parts) <= 1024 and sum(p & (p - 1) != 0 for p in parts) <= 1


def test_atoms_with_a_special_tokens_first_character():
    """Each atom's ids are the library's, whether or not it could begin a special token."""
    import public_tokenizers

    from pairlens.llm import word_ids

    known = word_ids.load_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    first = sorted({s[0] for s in word_ids.special_strings(known)})
    atoms = ["plain", " text", *first, *(f"x{c}y" for c in first), *(f"{c}|" for c in first), "é"]
    for some in (atoms, ["plain", " text"], first, []):
        got = word_ids.encode_atoms(known, some)
        assert {a: np.frombuffer(v, dtype="<u4").tolist() for a, v in got.items()} == {a: known.encode(a, add_special_tokens=False).ids for a in some}
