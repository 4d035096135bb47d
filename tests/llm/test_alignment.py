"""op13 against a plain alignment by the libraries, byte by byte."""
import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest

from pairlens.llm import op13_alignment as al

A, B = public_tokenizers.path(al.TOKENIZER_A), public_tokenizers.path(al.TOKENIZER_B)
ODD = ["a▁b", "▁", " ", "  x", "x\n", "a\nb c", "\xa0x", "a \xa0b", "a\n\xa0b", "don't stop!! (now), \"quoted.\" e.g. x=1;", "<|endoftext|> <s>a</s> <0x0A>",
       "漢字 と 仮名 가나다", "é é ﬁ ſ İ", "x\ty", "12 345 6789.0", "tab\r\nline", "😀😀 a😀", "a\x00b", "THE END!!", "###", "a  b   c    d", "-" * 40 + " x"]


@pytest.fixture(scope="module")
def aligner():
    return al.Aligner(A, B)


def plain(aligner, text):
    """(groups, measures, links) from the libraries' ids of the whole text, or None."""
    if not text:
        return None
    want = (" " + text).encode()
    ids = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    ends = []
    for own, table in zip(ids, (aligner.bytes_a, aligner.bytes_b)):
        if b"".join(table[i] for i in own) != want:
            return None
        at, out = 0, []
        for i in own:
            out.append((at, at := at + len(table[i]), i))
        ends.append(out)
    both = sorted({e for _, e, _ in ends[0]} & {e for _, e, _ in ends[1]})
    groups = ["|".join(",".join(str(i) for _, e, i in side if lo < e <= hi) for side in ends) for lo, hi in zip([0, *both], both)]
    links, j = [], 0
    for lo, hi, i in ends[0]:
        while ends[1][j][1] <= lo:
            j += 1
        k = j
        while k < len(ends[1]) and ends[1][k][0] < hi:
            links.append((i, ends[1][k][2]))
            k += 1
    return ";".join(groups), (len(ids[0]), len(ids[1]), len(groups), len(links)), links


def expected(aligner, rows):
    found = [(i, plain(aligner, t)) for i, t in rows]
    count = Counter(p for _, x in found if x for p in set(x[2]))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return Counter((i, *x[1], sum(count[p] == most[p[0]] for p in x[2]), sum(count[p] for p in x[2]), hashlib.sha256(x[0].encode()).hexdigest())
                   if x else (i, 0, 0, 0, 0, 0, 0, "") for i, x in found)


def test_texts_are_aligned_as_by_the_libraries(aligner, edge_rows):
    assert aligner.cuts and len(aligner.tails) > 3
    texts = [t for t in [*ODD, *(r[1] for r in edge_rows)] if t]
    for _ in range(2):  # the second time from the store
        got = aligner.texts(pa.array(texts))
        at = 0
        for k, t in enumerate(texts):
            want = plain(aligner, t)
            n = int(got["n_pairs"][k])
            if want is None:
                assert got["groups"][k] is None and n == 0 and not got["measures"][k].any()
                continue
            assert got["groups"][k].decode() == want[0] and tuple(got["measures"][k].tolist()) == want[1], t
            pairs = Counter({divmod(int(got["table"][p]), 1 << 32): int(m) for p, m in zip(got["pair"][at: at + n], got["times"][at: at + n])})
            assert pairs == Counter(want[2])
            at += n


@pytest.mark.parametrize("slice_text", [8 << 20, 2000])
def test_alignment_of_edge_rows(spark, aligner, edge_docs, edge_rows, no_docs, tmp_path, monkeypatch, slice_text):
    monkeypatch.setattr(al, "SLICE_TEXT", slice_text)
    got = al.alignment(edge_docs, A, B, str(tmp_path / "a"))
    assert got.columns == ["doc_id", *al.MEASURES, "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == expected(aligner, [(r[0], r[1]) for r in edge_rows])
    assert al.alignment(no_docs, A, B, str(tmp_path / "b")).count() == 0


def test_odd_texts_and_a_hot_text(spark, aligner, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(500 + i % 7, "The same text, again and again.") for i in range(300)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter(map(tuple, al.alignment(docs, A, B, str(tmp_path / "a")).collect()))
    assert got == expected(aligner, rows)
    assert spark.read.parquet(str(tmp_path / "a")).selectExpr("sum(texts)").first()[0] == len(ODD) + 1  # each distinct text once
