"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints of whole texts are made in tasks. Two fingerprints that differ in at most ``max_bits``
bits agree in one of ``max_bits`` + 1 segments of the bits, so the index is laid out once for each
segment, the bits rotated to lead with it: distinct fingerprints are sorted by Gray rank, in which
those that share a leading segment stand together, and cut into blocks of about equal size by
quantiles of that rank. A block's upper node is the bit pattern that all its fingerprints share
(``bit_and`` / ``bit_or`` aggregates). A fingerprint visits its own block and each later one that its
leading segment reaches into, unless the shared pattern differs in more than ``max_bits`` bits, so
rows grow in proportion to the input. Inside a block the same index goes on: nodes over 16 neighbours
in Gray order hold the bits their members share beyond the parent's, differences add up from the
root, and a whole group is left as soon as they pass ``max_bits``. No link is lost, since a pattern's
difference never exceeds a member's.

Each block returns a star per local component (a fingerprint and its component's smallest), never
all pairs; stars meet in large-star / small-star rounds over checkpoints.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any
other; equal rows share a fingerprint and so a component; a null ``doc_id`` is kept and never is the
smallest (all null: null component); an empty table gives an empty result; other columns of the
input are not read.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import checkpointed, map_slices, read, text_or_empty, unused

SHINGLE_WORDS = 3
MAX_BITS = 2
HASH_SEED = 42
#: Fingerprints of a block at least; and blocks at most, so that the table of upper nodes stays small.
BLOCK_CODES = 16_384
MAX_BLOCKS = 65_536
#: Children of a node, and fingerprints searched for at once.
FANOUT = 16
SEARCH_ROWS = 1024
ALL_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, words_per_shingle: int) -> int:
    """Majority bits of the XXH64 of each word shingle, as a signed 64-bit integer."""
    import xxhash

    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    k = words_per_shingle
    shingles = [b" ".join(words)] if len(words) < k else map(b" ".join, zip(*(words[i:] for i in range(k))))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(s, HASH_SEED) for s in shingles])
    bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(bits)).tobytes(), "big", signed=True)


def hash_of_text() -> Column:
    """Hash of the text, and of whether the id is null."""
    return F.xxhash64(text_or_empty(), F.col("doc_id").isNull())


def id_or_zero(col: str) -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(0))


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, text_hash: bool = False) -> DataFrame:
    """(doc_id, fp), and text_hash if asked for: the fingerprint of each row's whole text as a signed long."""
    def run(batch):
        fp = [fingerprint(t, shingle_words) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(fp, pa.int64()), *batch.columns[2:]], ["doc_id", "fp", *names])

    names = ["text_hash"] if text_hash else []
    own = [F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")]
    return map_slices(docs.select(*own, *[hash_of_text().alias(c) for c in names]), run,
                      ", ".join(f"{c} long" for c in ["doc_id", "fp", *names]))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the reflected Gray sequence."""
    r = codes.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        r = r ^ (r >> np.uint64(s))
    return r


def gray_rank_column(col):
    """The 53 leading bits of the Gray rank of a long column, as a double that holds them exactly."""
    for s in (1, 2, 4, 8, 16, 32):
        col = col.bitwiseXOR(F.shiftrightunsigned(col, s))
    return F.shiftrightunsigned(col, 11).cast("double")


class GrayIndex:
    """Nodes over codes in Gray order; the bottom may be codes (all bits) or patterns with masks."""

    def __init__(self, both: np.ndarray, either: np.ndarray):
        """``both`` / ``either``: AND and OR of the codes below each bottom entry, in Gray order."""
        self.levels = []
        while True:
            self.levels.append((both, ~(both ^ either)))
            if len(both) <= FANOUT:
                break
            cuts = np.arange(0, len(both), FANOUT)
            both, either = np.bitwise_and.reduceat(both, cuts), np.bitwise_or.reduceat(either, cuts)
        self.levels.reverse()

    def search(self, queries: np.ndarray, max_bits: int):
        """Yields (query positions, bottom positions) whose pattern differs in at most ``max_bits`` bits."""
        for at in range(0, len(queries), SEARCH_ROWS):
            q = queries[at: at + SEARCH_ROWS]
            pattern, mask = self.levels[0]
            row = np.repeat(np.arange(len(q)), len(pattern))
            node = np.tile(np.arange(len(pattern)), len(q))
            above = np.zeros(len(row), dtype=np.uint64)
            found = np.zeros(len(row), dtype=np.int64)
            for k, (pattern, mask) in enumerate(self.levels):
                if k:
                    first = node * FANOUT
                    n = np.minimum(first + FANOUT, len(pattern)) - first
                    above = np.repeat(self.levels[k - 1][1][node], n)
                    row, found = np.repeat(row, n), np.repeat(found, n)
                    node = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                own = mask[node] & ~above  # bits that the parent's pattern left open
                found = found + np.bitwise_count((q[row] ^ pattern[node]) & own)
                near = found <= max_bits
                row, node, found = row[near], node[near], found[near]
            yield row + at, node


def connect(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a[i] and b[i]; ``label`` holds a root, the smallest place, for each place."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def block_stars(codes: np.ndarray, own: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, smallest code of its component) among a block's own codes and the visitors', unless alone."""
    codes, at = np.unique(codes, return_index=True)
    own = own[at]
    members = np.flatnonzero(own)
    members = members[np.argsort(gray_rank(codes[members]), kind="stable")]
    index = GrayIndex(codes[members], codes[members])
    label = np.arange(len(codes))
    for row, node in index.search(codes, max_bits):
        to = members[node]
        other = row != to
        connect(label, row[other], to[other])
    size = np.bincount(label, minlength=len(codes))
    some = np.flatnonzero(size[label] > 1)
    return codes[some], codes[label[some]]


def turned(codes: np.ndarray, turn: int, segments: int) -> np.ndarray:
    """The codes' bits rotated so that segment ``turn`` leads."""
    by = 64 * turn // segments
    return (codes << np.uint64(by)) | (codes >> np.uint64(64 - by)) if by else codes


def turned_back(codes: np.ndarray, turn: int, segments: int) -> np.ndarray:
    by = 64 * turn // segments
    return (codes >> np.uint64(by)) | (codes << np.uint64(64 - by)) if by else codes


def stars(distinct: DataFrame, max_bits: int) -> DataFrame:
    """(u, v), v the smaller: fingerprints linked inside a block, as stars. ``distinct``: fp, once each."""
    total = distinct.count()
    blocks = int(min(MAX_BLOCKS, max(1, total // BLOCK_CODES)))
    segments = max_bits + 1
    free = np.uint64((1 << (64 - 64 // segments)) - 1)  # bits behind the leading segment
    turns = range(segments)
    ranks = distinct.select(*[gray_rank_column(F.expr(f"shiftleft(fp, {k}) | shiftrightunsigned(fp, {64 - k})") if k else F.col("fp"))
                              .alias(f"rank{t}") for t in turns for k in [64 * t // segments]])
    share = [i / blocks for i in range(1, blocks)]
    found = ranks.approxQuantile(ranks.columns, share, 0.1 / blocks) if share else [[]] * segments
    bounds = [np.unique(np.array(x, dtype=np.float64)) for x in found]

    def block_of(rank: np.ndarray, turn: int) -> np.ndarray:
        return np.searchsorted(bounds[turn], (rank >> np.uint64(11)).astype(np.float64), side="right")

    def at_home(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for t in turns:
                code = turned(fp, t, segments)
                yield pa.record_batch([pa.array(np.full(len(fp), t), pa.int32()), pa.array(block_of(gray_rank(code), t), pa.int32()),
                                       pa.array(code.view(np.int64))], ["turn", "block", "code"])

    # at most (max_bits + 1) x MAX_BLOCKS rows of a few numbers
    tops = (distinct.mapInArrow(at_home, "turn int, block int, code long").groupBy("turn", "block")
            .agg(F.bit_and("code").alias("both"), F.bit_or("code").alias("either")).collect())
    both = [np.full(len(x) + 1, ALL_ONES) for x in bounds]
    either = [np.zeros(len(x) + 1, dtype=np.uint64) for x in bounds]
    for r in tops:
        both[r["turn"]][r["block"]] = np.int64(r["both"]).view(np.uint64)
        either[r["turn"]][r["block"]] = np.int64(r["either"]).view(np.uint64)

    def routed(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for t in turns:
                code = turned(fp, t, segments)
                rank = gray_rank(code)
                home, last = block_of(rank, t), block_of(rank | free, t)
                n = last - home + 1
                row = np.repeat(np.arange(len(fp)), n)
                to = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - home, n)
                apart = (code[row] ^ both[t][to]) & ~(both[t][to] ^ either[t][to])
                near = np.bitwise_count(apart) <= max_bits
                row, to = row[near], to[near]
                yield pa.record_batch([pa.array(np.full(len(row), t), pa.int32()), pa.array(to, pa.int32()),
                                       pa.array(code[row].view(np.int64)), pa.array(to == home[row])],
                                      ["turn", "block", "code", "own"])

    def linked(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        u, v = block_stars(part["code"].to_numpy().view(np.uint64), part["own"].to_numpy(dtype=bool), max_bits)
        u, v = turned_back(u, int(key[0]), segments), turned_back(v, int(key[0]), segments)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    visits = distinct.mapInArrow(routed, "turn int, block int, code long, own boolean")
    found = visits.groupBy("turn", "block").applyInPandas(linked, "u long, v long").where("u <> v")
    return checkpointed(found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def component_roots(edges: DataFrame) -> DataFrame:
    """(u, v): v the smallest node of u's component, for each u that is not its smallest. ``edges``: u > v.

    Large-star and small-star rounds (Kiveris et al., 2014): in a large star each node sends its greater
    neighbours to the smallest one it knows, in a small star its smaller neighbours and itself. The
    edges stop changing when all are stars. Minima are aggregated before the shuffle, and the join that
    brings them back is one that Spark splits where a node has many neighbours.
    """
    def digest(e):
        return e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()

    last = digest(edges)
    while last["n"]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = checkpointed(large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                             .union(least.select("u", F.col("m").alias("v"))).distinct())
        now = digest(edges)
        if now == last:
            break
        last = now
    return edges


def fingerprint_roots(prints: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root) of each distinct fingerprint: the smallest fingerprint of its component."""
    distinct = checkpointed(prints.select("fp").distinct())
    roots = component_roots(stars(distinct, max_bits))
    return distinct.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): one row per document."""
    prints = checkpointed(fingerprints(docs, shingle_words))
    named = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(fingerprint_roots(prints, max_bits), "fp")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows, with all their columns, of one document of each component: its smallest ``doc_id``
    (null last), of rows that share it the one whose text has the smallest hash, of equal texts one.
    """
    prints = checkpointed(fingerprints(docs, shingle_words, text_hash=True))
    roots = fingerprint_roots(prints, max_bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    keep = prints.groupBy("fp").agg(first.alias("first")).join(roots, "fp").groupBy("root").agg(F.min("first").alias("first"))
    key = unused(docs.columns, "__id", "__hash")
    keep = keep.select(id_or_zero("first.doc_id").alias(key[0]), F.col("first.text_hash").alias(key[1]))
    # the same two keys for the join and for equal rows: the texts are shuffled once
    rows = docs.select("*", id_or_zero("doc_id").alias(key[0]), hash_of_text().alias(key[1]))
    return rows.join(keep, key, "left_semi").dropDuplicates(key).select(*docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(read(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
