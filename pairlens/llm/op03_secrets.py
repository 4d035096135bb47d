"""Secret scan: fixed patterns, and character Markov models compared by log-likelihood ratio.

Patterns find assignments, access keys and long hexadecimal runs. Two first-order Markov models over
the characters of keys, one of random strings and one of ordinary identifiers, are trained from
labelled samples: random ones are the pattern matches of the table itself and strings drawn from the
usual key alphabets; identifiers are words of the table outside the matches, alone and joined as
names are, and numbers, plain and grouped as dates, card and phone numbers are. Every run of key characters outside the pattern matches is then scored by the mean
log-likelihood ratio a character, over a threshold fitted on held-back identifiers.

Defined cases: a null or empty text has no spans; equal texts get equal spans; a null ``doc_id`` is
carried; an empty table gives an empty result and models of the drawn strings and a few fixed names
alone; other columns are not read. A span is kind:start:end in code points, end exclusive.
"""
from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import map_slices, read, slices, small_batches, text_or_empty

# The pattern of each kind, and the shortest match (of group 2 for assignments) that counts.
ASSIGN = r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
MIN_ASSIGN, MIN_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "markov")

#: Shortest run that the models judge, and the characters of a run.
MIN_RUN = 16
RUN = r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_RUN
ALPHABET = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "+/_-="
#: Strings that random keys are drawn as, besides those found.
DRAWN_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
                   "abcdefghijklmnopqrstuvwxyz0123456789", ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-")
DRAWN_EACH = 400
#: Ordinary numbers in the labelled sample at least (else a tenth of the identifiers).
NUMBERS = 2000
#: Bounds of the labelled sample: expected documents, and code points taken of each from a place its hash picks.
SAMPLE_DOCS = 2000
SAMPLE_CHARS = 1500
#: Pseudo-count of each transition, and how far above the held-back identifiers' largest ratio the threshold lies.
SMOOTHING = 0.5
MARGIN = 0.1
SEED = 23


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, sorted."""
    found = [(m.start(), 0, m.end()) for m in _compiled(ASSIGN).finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _compiled(ACCESS).finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in _compiled(HEX).finditer(text)]
    return sorted(found)


def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def runs(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of key characters outside the pattern matches; a match cuts the run that it lies in."""
    out, at = [], 0
    for start, _, end in [*spans, (len(text), 0, 0)]:
        out += [m.span() for m in _compiled(RUN).finditer(text, at, max(at, start))]
        at = max(at, end)
    return out


@dataclass
class Model:
    ratio: np.ndarray  # log-likelihood ratio of each pair of codes, random over ordinary
    threshold: float


def codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the characters, each string after a start code (0), and where the strings start."""
    table = np.zeros(256, dtype=np.int16)
    table[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, len(ALPHABET) + 1)
    data = table[np.frombuffer(("\0" + "\0".join(strings)).encode("ascii"), np.uint8)]
    n = np.array([len(s) + 1 for s in strings])
    return data, np.cumsum(n) - n


def transitions(strings: list[str]) -> np.ndarray:
    """Counts of each pair of codes."""
    size = len(ALPHABET) + 1
    if not strings:
        return np.zeros((size, size))
    data, _ = codes(strings)
    keep = data[1:] != 0
    return np.bincount(data[:-1][keep].astype(np.int64) * size + data[1:][keep], minlength=size * size).reshape(size, size)


def ratios(model_ratio: np.ndarray, strings: list[str]) -> np.ndarray:
    """Mean log-likelihood ratio a character of each string."""
    if not strings:
        return np.zeros(0)
    data, starts = codes(strings)
    each = np.zeros(len(data))
    each[1:] = np.where(data[1:] != 0, model_ratio[data[:-1], data[1:]], 0.0)
    return np.add.reduceat(each, starts) / np.array([len(s) for s in strings])


def drawn(rng: np.random.Generator) -> list[str]:
    """Random strings over the usual key alphabets."""
    return ["".join(rng.choice(list(a), int(n))) for a in DRAWN_ALPHABETS for n in rng.integers(MIN_RUN, 65, DRAWN_EACH)]


def named(words: list[str], rng: np.random.Generator) -> list[str]:
    """Words as they are, and two to four of them joined as names are."""
    if not words:
        return []
    out = list(words)
    for join in ("_", "-", "/", ""):
        for n, picks in zip(rng.integers(2, 5, len(words) // 4), rng.integers(0, len(words), (len(words) // 4, 4))):
            parts = [words[i] for i in picks[:n]]
            out.append(join.join(parts) if join else "".join(p.capitalize() for p in parts))
    return out


def numbers(rng: np.random.Generator, count: int) -> list[str]:
    """Digit strings, half of them in groups of two to six."""
    out = []
    for i, n in enumerate(rng.integers(4, 25, count)):
        digits = "".join(map(str, rng.integers(0, 10, n)))
        group = int(rng.integers(2, 7))
        out.append("-/"[i % 4 // 2].join(digits[k: k + group] for k in range(0, n, group)) if i % 2 else digits)
    return out


def fit(random: list[str], ordinary: list[str]) -> Model:
    """Both models from labelled strings over the run alphabet; one in five ordinary ones is held back."""
    rng = np.random.default_rng(SEED)
    ordinary = [ordinary[i] for i in rng.permutation(len(ordinary))]
    held, train = ordinary[::5], [s for i, s in enumerate(ordinary) if i % 5]

    def log_rows(c):
        c = c[:, 1:] + SMOOTHING
        return np.log(c / c.sum(axis=1, keepdims=True))

    ratio = np.zeros((len(ALPHABET) + 1, len(ALPHABET) + 1))
    ratio[:, 1:] = log_rows(transitions(random)) - log_rows(transitions(train))
    long = [s for s in held if len(s) >= MIN_RUN]
    most = float(ratios(ratio, long).max()) if long else 0.0
    return Model(ratio, max(0.0, most) + MARGIN)


def train(docs: DataFrame) -> Model:
    """The models from a bounded sample of the rows and the drawn strings."""
    total = docs.count()
    # by id and text: rows of one id are picked each for itself, and equal rows count once
    key = F.xxhash64(F.lit(SEED), "doc_id", "text")
    part = F.shiftrightunsigned(key, 11) / F.lit(float(1 << 53))
    room = F.greatest(F.lit(1), F.char_length("text") - SAMPLE_CHARS + 1)
    passage = F.substring("text", F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id", "text"), room).cast("int") + 1, F.lit(SAMPLE_CHARS))
    rows = (docs.select("doc_id", text_or_empty().alias("text")).where(part < min(1.0, SAMPLE_DOCS / max(1, total)))
            .select(key.alias("key"), passage.alias("passage")).dropDuplicates(["key"]).orderBy("key").limit(2 * SAMPLE_DOCS).toArrow())
    random, words = [], []
    for text in rows.column("passage").to_pylist():
        spans = pattern_spans(text)
        for start, kind, end in spans:
            found = re.search(RUN, text[start:end])
            if found:
                random.append(found[0])
        at = 0
        for start, _, end in [*spans, (len(text), 0, 0)]:
            words += re.findall(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,}(?![A-Za-z0-9+/_=-])", text[at:start])
            at = max(at, end)
    rng = np.random.default_rng(SEED)
    names = ["self", "value", "index", "count", "result", "name", "path", "data"]  # where the table has no words
    ordinary = named(words or names, rng)
    return fit(random + drawn(rng), ordinary + numbers(rng, max(NUMBERS, len(ordinary) // 10)))


def scan(texts: list[str], model: Model) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind, end) of each text: pattern matches, and runs that the models find random."""
    spans = [pattern_spans(t) for t in texts]
    found = [(i, a, b) for i, t in enumerate(texts) for a, b in runs(t, spans[i])]
    over = ratios(model.ratio, [texts[i][a:b] for i, a, b in found]) > model.threshold
    for (i, a, b), ok in zip(found, over):
        if ok:
            spans[i].append((a, 3, b))
    return [sorted(s) for s in spans]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans) of every row's whole text."""
    def run(batch):
        found = scan(batch.column(1).to_pylist(), model)
        counts = [pa.array([sum(k == kind for _, k, _ in s) for s in found], pa.int64()) for kind in range(4)]
        digest = [hashlib.sha256(written([x for x in s if x[1] < 3]).encode()).hexdigest() for s in found]
        return pa.record_batch([batch.column(0), *counts, pa.array(digest, pa.string()), pa.array(map(written, found), pa.string())],
                               ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), run,
                      "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each secret (overlapping ones as one) replaced by its first kind in brackets."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, secrets replaced in ``text``; ``n_chars`` follows where it was right."""
    names = docs.columns
    at = names.index("text")
    size = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            cols = list(batch.columns)
            old = cols[at].to_pylist()
            new = [t if t is None or not s else masked(t, s) for t, s in zip(old, scan([t or "" for t in old], model))]
            cols[at] = pa.array(new, cols[at].type)
            if size is not None:
                known = cols[size].to_pylist()
                cols[size] = pa.array([len(b) if a is not b and n == len(a) else n for a, b, n in zip(old, new, known)], cols[size].type)
            yield pa.record_batch(cols, schema=batch.schema)

    return small_batches(docs).mapInArrow(run, docs.schema)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    docs = read(spark, sf_dir, "documents")
    return secret_spans(docs, train(docs))
