"""run() of the pipeline against plain Python, row by row and pair by pair."""
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from pairlens.llm import op03_secrets as sec
from pairlens.llm import op04_langid as lid
from pairlens.llm import op05_mixing as mix
from pairlens.llm import op09_packing as pack
from pairlens.llm import op10_simhash as sim
from pairlens.llm.word_ids import load_tokenizer
from tests.conftest import SF_SMALL


def plain_scores(model, text):
    """Log-odds by language: the mean of the windows of 2 to 4 bytes that lie in a word, borders included."""
    table = lid._letters_only()
    data = [32, *(int(table[b]) for b in text.encode()), 32, 32, 32, 32]
    total, count = np.zeros(len(model.langs)), 0
    mask = (1 << 32) - 1
    for p in range(len(text.encode()) + 2):
        h = data[p] * 0x01000193 & mask
        for k in (1, 2, 3):
            if p + k >= len(data):
                break
            h = ((h ^ data[p + k]) * 0x01000193 + k) & mask
            window = data[p: p + k + 1]
            if all(b != 32 for b in window[1:-1]) and (window[0] != 32 or window[-1] != 32):
                mixed = (h ^ (h >> 15)) * 0x2C1B3C6D & mask
                total += model.table[mixed >> (32 - lid.BUCKET_BITS)]
                count += 1
    return (total / max(count, 1) + model.bias) / model.temperature


def accepted(model, text):
    if text is None or not any(map(str.isalpha, text)):
        return False
    if model is None or len(model.langs) < 2:
        return True
    s = np.sort(plain_scores(model, text))
    odds = s[-1] - s[-2] - math.log(sum(math.exp(x - s[-2]) for x in s[:-1]))
    return odds >= model.limits[sum(len(text) >= n for n in lid.JUDGED)] - 1e-9


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) | 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\v", " ").replace(
        "\f", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i: i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def one_of_each(rows):
    """Rows by component of fingerprints within two bits: the smallest id (null last)."""
    prints = sorted({plain_fingerprint(r[1] or "") for r in rows})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for r in rows:
        groups[find(plain_fingerprint(r[1] or ""))].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def poisson(u, mean):
    k, p = 0, math.exp(-mean)
    below = p
    while below < u:
        k += 1
        p *= mean / k
        below += p
    return k


def mixed(rows):
    mass = Counter()
    for r in rows:
        mass[r[3]] += len(r[1] or "")
    weight = {s: math.sqrt(m) for s, m in mass.items()}
    out = Counter()
    for r in rows:
        m = mass[r[3]]
        rate = weight[r[3]] / sum(weight.values()) * sum(mass.values()) / m if m else 1.0
        u = (int(hashlib.md5(f"{mix.SEED}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        out[r[0], r[1]] += poisson(u, rate)
    return +out


@pytest.fixture(scope="module")
def small(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]


@pytest.mark.parametrize("which", ["edge", "small"])
def test_run_equals_plain_python(spark, edge_docs, edge_rows, small, tmp_path, which):
    rows = edge_rows if which == "edge" else small
    if which == "edge":
        edge_docs.write.parquet(str(tmp_path / "documents.parquet"))
        folder = str(tmp_path)
    else:
        folder = SF_SMALL
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = lid.train(docs)
    if model is not None:  # the scores of whole arrays are those of each text for itself
        texts = [r[1] for r in rows if r[1]][:60]
        raw = lid.scores(model, pa.array(texts))
        assert all(np.allclose(raw[i], plain_scores(model, t), atol=1e-4) for i, t in enumerate(texts))
    kept = [r for r in rows if accepted(model, r[1])]
    language = spark.createDataFrame([r[:5] for r in kept], "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(tuple(r[:5]) for r in lid.accepted(docs, model).collect()) == Counter(r[:5] for r in kept)
    kept = one_of_each(kept)
    deduped = sim.one_of_each(language)
    assert Counter(tuple(r) for r in deduped.collect()) == Counter(r[:5] for r in kept)
    secrets = sec.train(deduped)
    kept = [(r[0], sec.masked(r[1], s), r[2], r[3]) for r, s in zip(kept, sec.scan([r[1] for r in kept], secrets))]
    want = mixed(kept)
    tokenizer = load_tokenizer(public_tokenizers.path(pack.TOKENIZER))
    ids = {key: tokenizer.encode(key[1], add_special_tokens=False).ids + [0] for key in want}
    of = defaultdict(list)
    for key in want:
        of[key[0]].append(ids[key])
    got, used = Counter(), defaultdict(list)
    for r in corpus_pipeline.run(spark, folder).collect():
        assert any(list(r.ids) == own[r.start: r.start + r.length] and r.doc_tokens == len(own) for own in of[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        got[r.doc_id] += r.length
        used[r.sequence_id].append(r.length)
    expected = Counter()
    for key, n in want.items():
        expected[key[0]] += n * len(ids[key])
    assert got == expected and max(map(sum, used.values())) <= pack.CAPACITY


def test_run_over_an_empty_table(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and "ids" in got.columns
