"""Language ID: averaged hashed subword embeddings with a linear softmax.

Subwords are hashed runs of 2, 3 and 4 bytes of the lower-cased text inside a word (with its
boundaries; digits and ASCII punctuation count as boundaries). A text's vector is the mean of its
subwords' embeddings; a linear layer and a softmax give languages. Embeddings and layer are trained
by mini-batch stochastic gradient descent in numpy, on passages of a bounded sample of labelled
documents; a temperature fitted on held-back passages calibrates the probabilities, and the
rejection threshold is the smallest confidence (log-odds of the best language) that all but a stated
share of these passages reach, cut to the length of the text: shorter passages have lower ones.
Prediction reads every byte of every text in tasks; only the model travels to them (its size is
buckets x (languages + 1) floats).

Defined cases: a null text, or one without letters, is ``und`` with score 0 and rejected; a null
``lang`` or ``doc_id`` is never learned from; a null ``doc_id`` is not held out; equal texts get equal
predictions; when no labelled row exists, texts with letters are ``und`` with score 0 and not
rejected, as nothing was learned to reject them by; nor are texts with letters shorter than the
shortest calibrated length, or when one language alone is learned; an empty table gives an empty result; other
columns are not read.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import map_slices, read, slices, small_batches, string_bytes, string_offsets, unused

#: Bounds of the labelled sample: documents a language, and documents in all (fewer a language where there are many).
DOCS_PER_LANG = 400
SAMPLE_DOCS = 80_000
#: Code points of the passages that a sampled document gives, each from a place that its hash picks.
PASSAGES = (600, 150, 40)
BUCKET_BITS = 16
DIM = 16
EPOCHS = 6
BATCH = 32
RATE = 2.0
#: Share of held-back passages that the rejection threshold may turn away, and the lengths in code points
#: to which passages are cut for it: a text has the threshold of the longest that it reaches.
REJECTED_SHARE = 0.002
JUDGED = (10, 20, 40, 150, 600)
SEED = 17
#: Text bytes scored at once: their windows take some fifty times as much memory.
STEP_BYTES = 2 << 20
UND = "und"


def _letters_only() -> np.ndarray:
    t = np.full(256, 32, dtype=np.uint8)
    t[128:] = np.arange(128, 256)
    for a, z in ((65, 90), (97, 122)):
        t[a: z + 1] = np.arange(a, z + 1) | 32
    return t


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets + 1 rows (the last for no subword), a column a language
    bias: np.ndarray
    temperature: float
    limits: np.ndarray  # least log-odds accepted: for the shortest texts, then for each length of JUDGED

    @property
    def threshold(self) -> float:
        """The score that texts of any length need."""
        return float(1 / (1 + np.exp(-self.limits.min())))


def subwords(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For each length 2, 3, 4: bucket of each window, whether it lies inside a word, first window of each text."""
    n = len(texts)
    ends = string_offsets(texts)
    size = int(ends[-1])
    data = np.full(size + 2 * n + 4, 32, dtype=np.uint8)  # a blank on each side of a text, and room for the last windows
    place = np.arange(size) + np.repeat(2 * np.arange(n) + 1, np.diff(ends))
    data[place] = _letters_only()[string_bytes(texts)]
    starts = ends[:-1] + 2 * np.arange(n)
    word = data != 32
    b = data.astype(np.uint32)
    total = size + 2 * n
    buckets, inside = [], []
    h = b[:total] * np.uint32(0x01000193)
    ok = np.ones(total, dtype=bool)
    for k in (1, 2, 3):
        h = (h ^ b[k: total + k]) * np.uint32(0x01000193) + np.uint32(k)
        if k > 1:
            ok = ok & word[k - 1: total + k - 1]
        mixed = h ^ (h >> np.uint32(15))
        mixed = mixed * np.uint32(0x2C1B3C6D)
        buckets.append((mixed >> np.uint32(32 - BUCKET_BITS)).astype(np.int32))
        inside.append(ok & (word[:total] | word[k: total + k]))
    return buckets, inside, [starts] * 3


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Calibrated log-odds of each text, a column a language."""
    total = np.zeros((len(texts), len(model.langs)))
    count = np.zeros(len(texts))
    none = len(model.table) - 1
    for bucket, ok, starts in zip(*subwords(texts)):
        bucket[~ok] = none
        for c in range(len(model.langs)):
            total[:, c] += np.add.reduceat(model.table[:, c][bucket].astype(np.float64), starts)
        count += np.add.reduceat(ok.astype(np.float64), starts)
    return (total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def odds(raw: np.ndarray) -> np.ndarray:
    """Log-odds of the best language against all others."""
    if raw.shape[1] < 2:
        return np.full(len(raw), np.inf)
    ordered = np.sort(raw, axis=1)
    rest, second = ordered[:, :-1], ordered[:, -2]
    return ordered[:, -1] - second - np.log(np.exp(rest - second[:, None]).sum(axis=1))


def known(model: Model, texts: pa.Array, raw: np.ndarray) -> np.ndarray:
    """Whether each text's confidence reaches the threshold of its length."""
    reached = np.searchsorted(JUDGED, pc.utf8_length(texts).to_numpy(zero_copy_only=False), side="right")
    return odds(raw) >= model.limits[reached]


def limits(model: Model, passages: list[str]) -> np.ndarray:
    """Thresholds from held-back passages, never falling with the length."""
    out = [-np.inf]
    for size in JUDGED:
        cut = [p[:size] for p in passages if len(p) >= size]
        least = np.quantile(odds(scores(model, pa.array(cut, pa.string()))), REJECTED_SHARE) if cut and len(model.langs) > 1 else -np.inf
        out.append(max(out[-1], least))
    return np.array(out)


def fit(texts: list[str], langs: list[str]) -> Model | None:
    """Trains on labelled passages; one in five is held back for the calibration."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(SEED)
    y = np.array([names.index(v) for v in langs])
    buckets, inside, starts = subwords(pa.array(texts, pa.string()))
    parts = [[b[lo:hi][ok[lo:hi]] for lo, hi in zip(s, [*s[1:], len(b)])] for b, ok, s in zip(buckets, inside, starts)]
    docs = [np.concatenate(p) for p in zip(*parts)]
    rows = rng.permutation([i for i, d in enumerate(docs) if len(d)])
    held, train = rows[4::5], np.delete(rows, np.s_[4::5])
    size = 1 << BUCKET_BITS
    e = rng.uniform(-1 / DIM, 1 / DIM, (size, DIM)).astype(np.float32)
    w = np.zeros((DIM, len(names)), dtype=np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    share = np.bincount(y[train], minlength=len(names)) / max(1, len(train))
    weight = 1 / np.maximum(share * len(names), 1e-3)
    steps = max(1, EPOCHS * -(-len(train) // BATCH))
    step = 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(train), max(1, -(-len(train) // BATCH))):
            if not len(at):
                continue
            rate = RATE * (1 - step / steps)
            step += 1
            n = np.array([len(docs[i]) for i in at])
            ids = np.concatenate([docs[i] for i in at])
            x = np.add.reduceat(e[ids], np.cumsum(n) - n) / n[:, None]
            g = softmax(x @ w + bias)
            g[np.arange(len(at)), y[at]] -= 1
            g *= (weight[y[at]] / len(at))[:, None]
            back = (g @ w.T) / n[:, None]
            w -= (rate * x.T @ g).astype(np.float32)
            bias -= (rate * g.sum(axis=0)).astype(np.float32)
            used, where = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(where, np.repeat(back[:, k], n), len(used)) for k in range(DIM)], axis=1)
            e[used] -= (rate * len(at) * grad).astype(np.float32)
    table = np.vstack([e @ w, np.zeros((1, len(names)), dtype=np.float32)]).astype(np.float32)
    model = Model(names, table, bias.astype(np.float64), 1.0, np.full(len(JUDGED) + 1, -np.inf))
    if len(held):
        raw = scores(model, pa.array([texts[i] for i in held], pa.string()))
        loss = {t: -np.log(np.maximum(softmax(raw / t)[np.arange(len(held)), y[held]], 1e-12)).mean()
                for t in np.geomspace(0.05, 20, 61)}
        model.temperature = float(min(loss, key=loss.get))
        model.limits = limits(model, [texts[i] for i in held])
    return model


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def train(docs: DataFrame) -> Model | None:
    """A model from a bounded sample of the labelled rows whose remainder is not 2."""
    rows = docs.select(F.col("doc_id").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("id")) != 2))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_DOCS).collect()
    if not counts:
        return None
    of, rate = unused(rows.columns, "of", "rate")
    most = max(1, min(DOCS_PER_LANG, SAMPLE_DOCS // len(counts)))
    chances = rows.sparkSession.createDataFrame([(r["lang"], min(1.0, most / r["count"])) for r in counts], f"{of} string, {rate} double")
    # by id and text: rows of one id are picked each for itself, and equal rows count once
    rows = rows.withColumn("picked_by", F.xxhash64(F.lit(SEED), "id", "text"))
    part = F.shiftrightunsigned("picked_by", 11) / F.lit(float(1 << 53))
    picked = rows.join(F.broadcast(chances), F.col("lang") == F.col(of)).where(part < F.col(rate))
    cuts = []
    for size in PASSAGES:
        room = F.greatest(F.lit(1), F.char_length("text") - size + 1)
        cuts.append(F.substring("text", F.pmod(F.xxhash64(F.lit(size), "picked_by"), room).cast("int") + 1, F.lit(size)))
    short = picked.select("lang", "picked_by", F.array(*cuts).alias("cuts")).dropDuplicates(["lang", "picked_by"])
    got = short.orderBy("picked_by", "lang").limit(2 * SAMPLE_DOCS).select("lang", F.explode("cuts").alias("passage")).toArrow()
    return fit(got.column("passage").to_pylist(), got.column("lang").to_pylist())


def has_letters(texts: pa.Array) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    data, ends = string_bytes(texts), string_offsets(texts)
    seen = np.concatenate(([0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))))
    out = seen[ends[1:]] > seen[ends[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(map(str.isalpha, texts[int(i)].as_py()))
    return out


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row."""
    def run(batch):
        texts = batch.column(1)
        letters = has_letters(texts)
        if model is None:
            lang, score, rejected = [UND] * len(texts), np.zeros(len(texts)), ~letters
        else:
            raw = scores(model, texts)
            p = softmax(raw)
            best = p.argmax(axis=1)
            score = np.where(letters, p[np.arange(len(p)), best], 0.0)
            lang = [model.langs[k] if ok else UND for k, ok in zip(best, letters)]
            rejected = ~(letters & known(model, texts, raw))
        return pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_slices(rows, run, "doc_id long, lang_pred string, score double, rejected boolean", limit=STEP_BYTES)


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows, with all their columns, whose text the model doesn't reject."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                texts = part.column(at).fill_null("")
                keep = has_letters(texts)
                if model is not None:
                    keep &= known(model, texts, scores(model, texts))
                yield part.filter(pa.array(keep))

    return small_batches(docs).mapInArrow(run, docs.schema)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = read(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select(
        "doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
