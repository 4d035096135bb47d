"""SpotSigs document fingerprints.

An anchor is an occurrence of a common word; its signature is the anchor with the next content words
after it. A text's fingerprint is the set of its signatures as 32-bit hashes, and two fingerprints are
compared by Jaccard similarity. For sets of lengths a <= b it is at most a / b, so sets are put in
partitions by length, only those within reach of the threshold meet, and a comparison ends as soon as
the signatures left cannot reach it: ``near_duplicates`` so finds the classes of all documents.

``compare`` meets given pairs alone and gives their whole likeness, so it prunes nothing. It sets each document beside its edited text (second half taken from the next document in id
order) and beside that next document. Rows travel once, into buckets in id order; the first row of a
bucket also goes to the bucket before it, so that every row meets its follower in one task that streams.

Defined cases: a null or empty text, or one without words, has an empty fingerprint; a text with words
but without anchors, or with nothing after them, has one signature of all its words; two empty
fingerprints have likeness 1, an empty one and another 0; equal texts have equal fingerprints; null
``doc_id`` come before all others, rows with one id in order of their texts' hashes; one row alone is its
own next document; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import checkpointed, read, slices, small_batches, text_or_empty
from pairlens.llm.op10_simhash import component_roots
from pairlens.llm.ordering import in_buckets, listed, order_key

# Common words of English, German, French and Spanish.
ANCHORS = frozenset("""
a an and are as at be by for from in is it of on or that the this to was were with
als auf aus bei das dem den der des die ein eine es im ist mit nach nicht oder und von war wie zu zur
au aux avec ce dans de du elle en est et il la le les ne ou par pas pour que qui se son sur un une
con del el esa ese esta este las lo los no para pero por si su una y
""".split())
#: Content words of a signature; the likeness from which documents are near-duplicates.
CHAIN = 2
THRESHOLD = 0.8
#: Counters of signatures (a power of two), and sets of a posting list that meet in one task.
SKETCH = 1 << 20
TILE_SETS = 1024


def signatures(text: str, chain: int = CHAIN, anchors: frozenset[str] = ANCHORS) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the text's signatures."""
    import xxhash

    words = re.findall(r"\w+", text.lower())
    content, marks = [], []
    for w in words:
        if w in anchors:
            marks.append((w, len(content)))
        else:
            content.append(w)
    full = len(content) - chain
    spots = {(w, *content[k: k + chain]) for w, k in marks if k <= full}
    if not spots and words:
        spots = {tuple(words)}
    digest = xxhash.xxh32_intdigest
    return np.unique(np.array([digest(" ".join(s)) for s in spots], dtype=np.uint32))


def likeness(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 as soon as it cannot reach ``threshold``."""
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 1.0
    if len(a) < threshold * len(b):
        return 0.0
    need = threshold * (len(a) + len(b)) / (1 + threshold)  # common signatures for the threshold
    common, step = 0, max(64, len(a) // 4)
    for at in range(0, len(a), step):
        own = a[at: at + step]
        place = np.minimum(np.searchsorted(b, own), len(b) - 1)
        common += int((b[place] == own).sum())
        if common + len(a) - at - len(own) < need - 1e-9:
            return 0.0
    return common / (len(a) + len(b) - common)


def length_partitions(threshold: float, longest: int) -> list[int]:
    """Lower bounds of partitions by set length, such that a set can only reach the threshold with sets
    of its own partition or one beside it."""
    out, low = [0], 1
    while low <= longest:
        out.append(low)
        low = max(low + 1, int(np.ceil(low / threshold)))
    return out


def packed(sigs: np.ndarray) -> str:
    return base64.b64encode(sigs.astype("<u4").tobytes()).decode()


def fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """(doc_id, fingerprint): base64 of the sorted signatures as little-endian 32-bit integers."""
    def run(batches):
        for batch in batches:
            prints = [packed(signatures(t, chain)) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))).mapInArrow(
        run, "doc_id long, fingerprint string")


def followed(docs: DataFrame) -> DataFrame:
    """(bucket, follower, doc_id, text), each bucket's rows in id order, then, marked, the first row of the
    next bucket (of the first bucket, after the last)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), order_key().alias("key"))
    rows, _ = in_buckets(rows)
    firsts = {r["bucket"]: r["first"] for r in rows.groupBy("bucket").agg(F.min(F.struct("key", "text_hash")).alias("first")).collect()}  # a row a bucket
    there = sorted(firsts)
    most = max(there, default=0) + 1
    before = {b: there[i - 1] for i, b in enumerate(there)}
    at = F.col("bucket")
    leads = ((F.col("key") == listed([firsts[b]["key"] if b in firsts else 0 for b in range(most)], at, "long"))
             & (F.col("text_hash") == listed([firsts[b]["text_hash"] if b in firsts else 0 for b in range(most)], at, "long")))
    own = F.struct("bucket", F.lit(False).alias("follower"))
    more = F.struct(listed([before.get(b, 0) for b in range(most)], at, "int").alias("bucket"), F.lit(True).alias("follower"))
    places = F.explode(F.when(leads, F.array(own, more)).otherwise(F.array(own)))
    rows = rows.withColumn("place", places)
    return (rows.select("place.bucket", "place.follower", "doc_id", "key", "text_hash", "text").repartition(max(1, len(there)), "bucket")
            .sortWithinPartitions("bucket", "follower", "key", "text_hash").select("bucket", "follower", "doc_id", "text"))


def compare(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """One row a document: its fingerprint and its edited text's, and its likeness to that and to the next document."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def row(now, after):
        doc_id, text, sigs = now
        half = len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        new = signatures(edited, chain)
        return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), packed(sigs), packed(new),
                likeness(sigs, new), likeness(sigs, after[2]))

    def run(batches):
        at, last, done = None, None, False  # the open bucket, its last row, whether its follower came
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for bucket, follower, doc_id, text in zip(*(c.to_pylist() for c in part.columns)):
                    if bucket != at:
                        at, last, done = bucket, None, False
                    if done:
                        continue
                    now = (doc_id, text, signatures(text, chain))
                    if last is not None:
                        out.append(row(last, now))
                    last, done = now, follower
                if out:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return small_batches(followed(docs)).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                          "edited_fingerprint string, near_edited double, near_next double")


# ---------------------------------------------------------------- near-duplicates among all documents
def unpacked(sigs: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(sigs), dtype="<u4")


class Prefixes:
    """The signatures of a set that it is posted under: a partner of at least the threshold shares one of the
    rarest, so many that fewer than threshold x size are left. ``seen`` counts signatures by their low bits (too high
    where several share them, never too low); rarer ones come first, then smaller ones."""

    def __init__(self, seen: np.ndarray, threshold: float):
        self.seen, self.threshold = seen, threshold

    def count(self, sigs: np.ndarray) -> np.ndarray:
        return self.seen[sigs & np.uint32(len(self.seen) - 1)]

    def of(self, sigs: np.ndarray) -> np.ndarray:
        order = np.lexsort((sigs, self.count(sigs)))
        return sigs[order][: len(sigs) - int(np.ceil(self.threshold * len(sigs) - 1e-9)) + 1]

    def first_common(self, a: np.ndarray, b: np.ndarray) -> int:
        """The first, in that order, of the signatures that two prefixes share."""
        both = np.intersect1d(a, b)
        return int(both[np.lexsort((both, self.count(both)))[0]])


def cell_links(sig: int, rows: list[tuple[str, bool, np.ndarray]], prefixes: Prefixes, first: list[int],
               second: list[int]) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Links among the sets posted under one signature, each counted where the two share no earlier one: (links by key,
    a tree over each linked group). ``rows``: key, whether the cell is of the set's own partition, its signatures; a pair
    is one place of ``first`` and one of ``second``, or two of ``first`` if both are one list."""
    links, tree, root = {}, [], {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    threshold, own = prefixes.threshold, {i: prefixes.of(rows[i][2]) for i in {*first, *second}}
    by_size = sorted(second, key=lambda j: len(rows[j][2]))
    sizes = [len(rows[j][2]) for j in by_size]
    for i in first:
        key, home, sigs = rows[i]
        reach = slice(bisect_left(sizes, threshold * len(sigs) - 1e-9), bisect_right(sizes, len(sigs) / threshold + 1e-9))
        for j in by_size[reach]:
            other, there, theirs = rows[j]
            if (first is second and key >= other) or not (home or there) or likeness(sigs, theirs, threshold) < threshold:
                continue
            if prefixes.first_common(own[i], own[j]) != sig:
                continue
            links[key], links[other] = links.get(key, 0) + 1, links.get(other, 0) + 1
            a, b = find(key), find(other)
            if a != b:
                root[max(a, b)] = min(a, b)
                tree.append((max(key, other), min(key, other)))
    return links, tree


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, chain: int = CHAIN) -> DataFrame:
    """(doc_id, class_id, links): one row a document. Documents of equal fingerprints are of one class; fingerprints
    of at least the threshold are linked, and ``links`` counts the other fingerprints that a document's is linked to;
    ``class_id`` is the smallest id reachable (null if all are).

    Fingerprints are put in partitions by length and posted under their rarest signatures in their own and the next one;
    a signature that is no other's needs no posting. A posting list of more than ``TILE_SETS`` is cut into tiles, and each pair of
    tiles meets in a task of its own. Tasks return counts and, of a linked group, a tree.
    """
    prints = checkpointed(fingerprints(docs, chain).withColumn("set_key", F.sha2("fingerprint", 256)))
    sets = checkpointed(prints.where("fingerprint <> ''").groupBy("set_key").agg(F.first("fingerprint").alias("fingerprint")))
    counted = sets.mapInArrow(_sketch, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SKETCH rows
    seen = np.zeros(SKETCH, dtype=np.int64)
    seen[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    longest = sets.agg(F.max(F.length("fingerprint"))).first()[0] or 0
    lows = length_partitions(threshold, longest)  # base64 of four bytes a signature: longer than any set
    prefixes = Prefixes(seen, threshold)

    def posted(batches):
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sigs = unpacked(text)
                part = bisect_right(lows, len(sigs)) - 1
                prefix = prefixes.of(sigs)
                for sig in prefix[prefixes.count(prefix) > 1].tolist():
                    out += [(key, part, sig, True), (key, part + 1, sig, False)]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.bool_()]
            cols = zip(*out) if out else [[]] * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], ["set_key", "part", "sig", "home"])

    postings = checkpointed(small_batches(sets).mapInArrow(posted, "set_key string, part int, sig long, home boolean"))
    lists = postings.groupBy("part", "sig").agg(F.count("*").alias("m"), F.count_if("home").alias("homes")).where("m > 1 and homes > 0")
    tiles = F.ceil(F.col("m") / TILE_SETS).cast("int")
    rows = postings.join(lists.select("part", "sig", tiles.alias("tiles")), ["part", "sig"]).withColumn("tile", F.pmod(F.xxhash64("set_key"), F.col("tiles")).cast("int"))
    # a tile meets itself, those behind it as the first and those before it as the second
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cells = cells.select("set_key", "part", "sig", "home", "tile", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"))
    cells = cells.join(sets, "set_key")

    def meet(part: pa.Table) -> pa.Table:
        lo, hi, sig = part.column("lo")[0].as_py(), part.column("hi")[0].as_py(), part.column("sig")[0].as_py()
        own = [(k, h, unpacked(f)) for k, h, f in zip(part.column("set_key").to_pylist(), part.column("home").to_pylist(), part.column("fingerprint").to_pylist())]
        tile = part.column("tile").to_pylist()
        first = [i for i, t in enumerate(tile) if t == lo]
        second = first if lo == hi else [i for i, t in enumerate(tile) if t == hi]
        links, tree = cell_links(sig, own, prefixes, first, second)
        return pa.table({"u": pa.array([*links, *(a for a, _ in tree)], pa.string()), "v": pa.array([None] * len(links) + [b for _, b in tree], pa.string()),
                         "n": pa.array([*links.values()] + [0] * len(tree), pa.int64())})

    met = checkpointed(cells.groupBy("part", "sig", "lo", "hi").applyInArrow(meet, "u string, v string, n long"))
    links = met.where("v is null").groupBy(F.col("u").alias("set_key")).agg(F.sum("n").alias("links"))
    roots = component_roots(checkpointed(met.where("v is not null").select("u", "v").distinct()))
    classes = prints.groupBy("set_key").agg(F.min("doc_id").alias("first")).join(
        roots.select(F.col("u").alias("set_key"), F.col("v").alias("root")), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    least = classes.groupBy("root").agg(F.min("first").alias("class_id"))
    of = classes.join(least, "root").join(links, "set_key", "left").select("set_key", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    return prints.select("doc_id", "set_key").join(of, "set_key").select("doc_id", "class_id", "links")


def _sketch(batches):
    for batch in batches:
        parts = [unpacked(t) for t in batch.column(1).to_pylist()]
        slots, n = np.unique(np.concatenate([np.zeros(0, dtype=np.uint32), *parts]) & np.uint32(SKETCH - 1), return_counts=True)
        yield pa.record_batch([pa.array(slots.astype(np.int32)), pa.array(n.astype(np.int64))], ["slot", "n"])


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likenesses."""
    return compare(read(spark, sf_dir, "documents"))
