"""op11: archives written and read back, faults, and its SQL."""
import base64
import gzip
import hashlib
import random
from collections import Counter, defaultdict

import pytest

from pairlens.llm import op11_warc as warc
from tests.conftest import SF_SMALL

SCHEMA = "page_id long, url string, html string, record_id string, kind string, same string"


@pytest.fixture(scope="module")
def page_rows():
    long = "".join(f"<p>ligne {i} é漢😀 WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n</p>" for i in range(900))
    texts = [None, "", "a", "\r\n\r\n", "0\r\n\r\n", "WARC/1.1\r\nWARC-Type: response\r\n\r\n", long, long[:-1], long, "é", "same", "\x00\x1f\x8b"]
    rows = [(i, f"http://x.example/{i} é\n", t) for i, t in enumerate(texts)]
    rows += [(100 + i, None, "same") for i in range(40)] + [(300, "u", "same"), (300, "u", "same"), (300, "t", "same"), (300, None, "same")]
    rows += [(None, "u", "same"), (None, None, "no id"), (None, None, "no id"), (None, None, None)]
    return [(*r, "own", "own", "own") for r in rows]


def plain(rows, revisit_from=0):
    by = defaultdict(list)
    for r in rows:
        by[(r[2] or "").encode()].append((r[0] is not None, r[0] or 0))
    out = Counter()
    for payload, pages in by.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        pages.sort()
        ids = [i if there else None for there, i in pages]
        for k, i in enumerate(ids):
            response = len(payload) < revisit_from or k == len(ids) - 1
            out[(i, len(payload), digest, "response" if response else "revisit", None if response else ids[-1])] += 1
    return out


@pytest.mark.parametrize("segment, chunk, per_file, least", [(32 << 10, 8 << 10, 4096, 0), (700, 64, 3, 0), (1000, 1000, 5, 5)])
def test_pages_come_back(spark, page_rows, tmp_path, segment, chunk, per_file, least):
    pages = spark.createDataFrame(page_rows, SCHEMA).repartition(3)
    warc.write_archives(pages, str(tmp_path / "a"), least, segment, chunk, per_file)
    found = warc.read_archives(spark, str(tmp_path / "a"), payloads=True).persist()
    assert Counter(tuple(r[:5]) for r in warc.resolved(found).collect()) == plain(page_rows, least)
    assert found.where("fault is not null").count() == warc.resolved(found).where("fault is not null").count() == 0
    want = {(r[2] or "").encode() for r in page_rows}
    assert {bytes(r.payload) for r in found.where("kind = 'response'").collect()} == want
    names = [f for f in (tmp_path / "a").iterdir() if f.name.endswith(".gz")]
    kinds = Counter(f[b"warc-type"] for n in names for f, _, _ in warc.parsed(gzip.open(n).read()))
    assert (kinds[b"continuation"] > 0) and kinds[b"revisit"] == sum(r[3] == "revisit" for r in plain(page_rows, least).elements())


def test_empty_table(spark, page_rows, tmp_path):
    pages = spark.createDataFrame(page_rows, SCHEMA).where("false")
    warc.write_archives(pages, str(tmp_path / "a"))
    assert warc.resolved(warc.read_archives(spark, str(tmp_path / "a"))).count() == 0


def parts(n=5, size=50):
    block = bytes(random.Random(3).randrange(256) for _ in range(n * size - 7))
    out = [(k + 1, len(block) if k == n - 1 else None, block[k * size: (k + 1) * size]) for k in range(n)]
    return block, out


def test_segments_in_any_order():
    block, own = parts()
    for seed in range(10):
        mixed = own + own[:2]
        random.Random(seed).shuffle(mixed)
        assert warc.reassembled(mixed) == (block, None)
    for broken in (own[:-1], own[1:], own[:2] + own[3:], own + [(2, None, b"other")], [*own[:-1], (5, 1, own[-1][2])], [(0, None, b"")]):
        assert warc.reassembled(broken)[0] is None


def test_chunks():
    for n in (0, 1, 7, 64, 1000):
        data = bytes(range(256)) * 4
        assert warc.dechunked(warc.chunked(data[:n], 7)) == data[:n]
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for broken in (b"", b"5\r\nabc", b"zz\r\nabc\r\n0\r\n\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(broken)


def test_faults_are_named(spark, tmp_path):
    """Records of several files: a lost segment, a wrong digest, a lost response, a cut file, one id twice."""
    def records(rid, payload, segment=60, **change):
        row = {"kind": "response", "page_id": 1, "url": "u", "sha1": hashlib.sha1((payload or "").encode()).hexdigest(), "refers_to": None, **change}
        return list(warc.written(rid, row["kind"], row["page_id"], row["url"], payload, row["sha1"], row["refers_to"], segment, 16, warc.DATE))

    ids = [f"00000000-0000-0000-0000-00000000000{i}" for i in range(10)]
    good = records(ids[0], "good " * 30)
    lost = records(ids[1], "lost " * 30, page_id=2)
    wrong = records(ids[2], "wrong", 9999, page_id=3, sha1="00" * 20)
    away = records(ids[3], None, 9999, kind="revisit", page_id=4, refers_to=ids[9])
    twice = records(ids[4], "one", 9999, page_id=5) + records(ids[4], "two", 9999, page_id=5)
    short = records(ids[5], "short", 9999, page_id=6)
    files = [good[::2] + lost[:1], good[1::2] + lost[2:] + wrong + away, twice + good]
    (tmp_path / "a").mkdir()
    for k, own in enumerate(files):
        data = b"".join(r + b"\r\n\r\n" for r in own) + (short[0][:-3] if k == 2 else b"")
        # one gzip member a record, one a file, none
        (tmp_path / "a" / f"{k}.warc").write_bytes(data if k == 2 else gzip.compress(data) if k else b"".join(gzip.compress(r + b"\r\n\r\n") for r in own))
    got = {r.page_id: r for r in warc.resolved(warc.read_archives(spark, str(tmp_path / "a"))).collect()}
    assert got[1].payload_bytes == 150 and got[1].fault is None
    assert {i: got[i].fault for i in range(2, 7)} == {2: "segments missing or unequal", 3: "another digest", 4: "no response",
                                                      5: "one id, unequal records", 6: "cut short"}
    assert all(got[i].payload_bytes is None for i in range(2, 7))
    with pytest.raises(ValueError):
        list(warc.parsed(b"<html>no archive\r\n\r\n"))


def test_archives_equal_their_sql(spark):
    from tools.check_oracle import compare, duck

    assert compare(spark, duck(SF_SMALL), "op11_warc", SF_SMALL).endswith(" OK")
