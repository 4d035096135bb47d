"""Token ids in shards compressed by Re-Pair, with random access.

Documents go into buckets in ascending id order; a task encodes a bucket's texts and closes a shard when
it holds enough ids. A shard's ids are compressed by rounds: pairs of neighbouring symbols are counted,
the frequent ones become nonterminals, and their occurrences are replaced, of overlapping ones the more
frequent pair's, until no pair is frequent; nonterminals are part of later pairs, so rules nest. The shard
stores the rules, the length that each nonterminal expands to, the symbols, and the id position of every
1024th symbol, so any range of ids is decoded from the symbols that cover it alone.

Shards are written as rows of a Parquet table in the folder that ``spark.checkpoint.dir`` names, through
Spark's writer, and read back through its reader. Layout of a shard, little-endian: ``RPR2``; vocabulary
size, number of rules, bits of a symbol and of an expansion length (uint32); number of symbols, documents,
marks (uint64); rules (2 symbols each); their expansion lengths; marks (uint64); document ids (int64) and
whether each is null (uint8); the documents' ends as id positions (uint64); symbols. Symbols and lengths
are packed by bits, each part filled up to whole bytes.

Defined cases: a null or empty text has the end id alone; null ids come before all others; rows with one
id come in order of their texts' hashes; equal rows are stored each; an empty table gives no shards
and an empty result; other columns are not read.
"""
from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.llm.common import checkpointed, gathered, read, removed, shared_folder, small_batches, text_or_empty, worker_cache
from pairlens.llm.ordering import in_buckets, order_key
from pairlens.llm.word_ids import ENCODE_BYTES, WordStore, encode_column, load_tokenizer, spread

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Ids of a shard, about.
SHARD_IDS = 2 << 20
#: A pair is frequent from so many occurrences in a shard on; a rule is kept if it replaces so many.
FREQUENT = 16
WORTH = 4
#: Hash bits of the first pair counts; sweeps by rank over overlapping occurrences; values packed at once.
HASH_BITS = 20
SWEEPS = 24
PACK_ROWS = 1 << 16
#: Symbols between two marks.
MARK = 1024
HEAD = "<4sIIIIQQQ"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def hashed(keys: np.ndarray) -> np.ndarray:
    return ((keys * MULTIPLIER) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def beside(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values at the place before and at the place behind each of the ascending places; 0 where there is none."""
    near = np.diff(at) == 1
    behind, ahead = np.zeros_like(values), np.zeros_like(values)
    behind[1:], ahead[:-1] = values[:-1] * near, values[1:] * near
    return behind, ahead


def without_overlaps(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the occurrences ``at`` (ascending places of pairs, each with its pair's rank from 1) are replaced: of two
    that overlap the one of the higher rank, of a run of one pair every other one; in the end none is left that could be."""
    taken = np.zeros(len(at), dtype=bool)
    left = np.arange(len(at))
    for sweep in range(SWEEPS + 1):
        if not len(left):
            break
        behind, ahead = beside(at, rank)
        now = (behind < rank) & (ahead < rank)
        same = np.flatnonzero((behind == rank) | (ahead == rank))
        if sweep == SWEEPS:  # long chains of ever higher ranks: from left to right
            place = np.arange(len(at))
            now = (place - np.maximum.accumulate(np.where(behind == 0, place, 0))) % 2 == 0
        elif len(same):  # runs of one pair
            first, last = same[behind[same] != rank[same]], same[ahead[same] != rank[same]]
            wins = (behind[first] < rank[first]) & (ahead[last] < rank[last])
            run = np.searchsorted(first, same, side="right") - 1
            now[same] = wins[run] & ((same - first[run]) % 2 == 0)
        taken[left[now]] = True
        still = ~(now | np.logical_or(*beside(at, now)))
        at, rank, left = at[still], rank[still], left[still]
    return taken


def compress(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules as rows of two symbols, expansion lengths of all symbols, the symbols that are left).

    Nonterminal k is symbol vocabulary + k. After the first round only pairs that hold a nonterminal of the last one
    can have become frequent, so later rounds look at those places alone.
    """
    symbols = ids.astype(np.uint32)
    rules, lengths, fresh = [np.zeros((0, 2), dtype=np.uint32)], np.ones(vocabulary, dtype=np.int64), 0
    while len(symbols) > 1:
        new = symbols >= fresh
        at = np.flatnonzero(new[:-1] | new[1:])
        keys = (symbols[at].astype(np.uint64) << np.uint64(32)) | symbols[at + 1]
        slot = hashed(keys)
        often = (np.bincount(slot, minlength=1 << HASH_BITS) >= FREQUENT)[slot]  # no frequent pair is left out
        at, keys = at[often], keys[often]
        coded = pa.array(keys).dictionary_encode()
        pairs, which = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        n = np.bincount(which, minlength=len(pairs))
        rank = np.empty(len(pairs), dtype=np.int32)
        rank[np.argsort(n, kind="stable")] = np.arange(1, len(pairs) + 1)
        some = (n >= FREQUENT)[which]
        at, which = at[some], which[some]
        taken = without_overlaps(at, rank[which])
        at, which = at[taken], which[taken]
        used = np.bincount(which, minlength=len(pairs)) >= WORTH
        if not used.any():
            break
        at, which = at[used[which]], which[used[which]]
        fresh = len(lengths)
        symbols[at] = (fresh - 1 + np.cumsum(used))[which]
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        made = np.stack([pairs[used] >> np.uint64(32), pairs[used] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        rules.append(made)
        lengths = np.concatenate((lengths, lengths[made[:, 0]] + lengths[made[:, 1]]))
    return np.vstack(rules), lengths, symbols


def bits_of(values: np.ndarray) -> int:
    return max(1, int(values.max(initial=0)).bit_length())


def packed(values: np.ndarray, width: int) -> bytes:
    """The ``width`` low bits of each value, end to end."""
    parts = []
    for at in range(0, len(values), PACK_ROWS):  # whole bytes, as this is a multiple of 8
        some = values[at: at + PACK_ROWS].astype("<u4").view(np.uint8).reshape(-1, 4)
        parts.append(np.packbits(np.unpackbits(some, axis=1, bitorder="little")[:, :width], bitorder="little").tobytes())
    return b"".join(parts)


def unpacked(data: np.ndarray, width: int, start: int, stop: int) -> np.ndarray:
    """Values ``start`` (a multiple of 8) to ``stop`` of packed ones."""
    parts = [np.zeros(0, dtype=np.uint32)]
    for at in range(start, stop, PACK_ROWS):
        n = min(stop - at, PACK_ROWS)
        bits = np.unpackbits(data[at * width // 8: -(-(at + n) * width // 8)], bitorder="little")[: n * width].reshape(n, width)
        wide = np.zeros((n, 32), dtype=np.uint8)
        wide[:, :width] = bits
        parts.append(np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel())
    return np.concatenate(parts)


def encode_shard(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray, vocabulary: int) -> bytes:
    rules, lengths, symbols = compress(ids, vocabulary)
    marks = np.concatenate(([0], np.cumsum(lengths[symbols])[MARK - 1::MARK]))
    own = lengths[vocabulary:]
    width, long = max(1, (vocabulary + len(rules) - 1).bit_length()), bits_of(own)
    return b"".join([
        struct.pack(HEAD, b"RPR2", vocabulary, len(rules), width, long, len(symbols), len(doc_ids), len(marks)),
        packed(rules.ravel(), width), packed(own, long), marks.astype("<u8").tobytes(),
        np.array([0 if i is None else i for i in doc_ids], dtype="<i8").tobytes(),
        np.array([i is None for i in doc_ids], dtype=np.uint8).tobytes(),
        ends.astype("<u8").tobytes(), packed(symbols, width)])


class Shard:
    """A shard's parts, and its ids by range."""

    def __init__(self, data: bytes):
        magic, self.vocabulary, rules, self.width, long, self.n, docs, marks = struct.unpack_from(HEAD, data)
        if magic != b"RPR2":
            raise ValueError("not a shard")
        at = struct.calcsize(HEAD)

        def part(kind, n):
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.rules = unpacked(part(np.uint8, -(-2 * rules * self.width // 8)), self.width, 0, 2 * rules).reshape(-1, 2).astype(np.int64)
        lengths = unpacked(part(np.uint8, -(-rules * long // 8)), long, 0, rules)
        self.lengths = np.concatenate((np.ones(self.vocabulary, dtype=np.int64), lengths))
        self.marks = part("<u8", marks).astype(np.int64)
        ids, null = part("<i8", docs), part(np.uint8, docs)
        self.doc_ids = [None if z else i for i, z in zip(ids.tolist(), null.tolist())]
        self.ends = part("<u8", docs).astype(np.int64)
        self.symbols = part(np.uint8, -(-self.n * self.width // 8))

        out, ends = np.arange(self.vocabulary, self.vocabulary + rules), np.arange(rules + 1)
        while (deep := out >= self.vocabulary).any():  # all rules at once, a step deeper each time
            n = 1 + deep
            place = np.cumsum(n) - n
            wide = np.empty(int(n.sum()), dtype=np.int64)
            wide[place[~deep]] = out[~deep]
            pairs = self.rules[out[deep] - self.vocabulary]
            wide[place[deep]], wide[place[deep] + 1] = pairs[:, 0], pairs[:, 1]
            out, ends = wide, np.append(place, len(wide))[ends]
        #: What each symbol expands to, end to end, and where it begins.
        self.flat = np.concatenate((np.arange(self.vocabulary), out)).astype(np.uint32)
        self.begins = np.concatenate((np.arange(self.vocabulary), self.vocabulary + ends[:-1]))

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.begins[symbols], self.lengths[symbols])]

    def ids(self, start: int | None = None, end: int | None = None) -> np.ndarray:
        """Ids from position start to end, from the symbols that cover them."""
        total = int(self.ends[-1]) if len(self.ends) else 0
        start, end = start or 0, total if end is None else end
        if start >= end:
            return np.zeros(0, dtype=np.uint32)
        mark = int(np.searchsorted(self.marks, start, side="right")) - 1
        stop = int(np.searchsorted(self.marks, end, side="left"))
        run = unpacked(self.symbols, self.width, mark * MARK, stop * MARK if stop < len(self.marks) else self.n)
        places = self.marks[mark] + np.cumsum(self.lengths[run])
        lo, hi = int(np.searchsorted(places, start, side="right")), int(np.searchsorted(places, end, side="left")) + 1
        skip = start - int(places[lo - 1] if lo else self.marks[mark])
        return self.expand(run[lo:hi])[skip: skip + end - start]


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = END_ID) -> None:
    """Shards of all documents in ascending id order: a table of bucket, part, docs, ids, data."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), order_key().alias("key"))
    rows, buckets = in_buckets(rows)
    rows = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "key", "text_hash").select("bucket", "doc_id", "text")

    def run(batches):
        known, words = load_tokenizer(tokenizer), worker_cache(f"words:{tokenizer}", WordStore)
        vocabulary = max(known.get_vocab_size(), (end_id or 0) + 1)
        at, part, held = None, 0, []  # the open shard: bucket, part, (document ids, lengths, ids) of each run of rows

        def close():
            nonlocal held, part
            if held:
                doc_ids = [i for own, _, _ in held for i in own]
                ends = np.cumsum(np.concatenate([n for _, n, _ in held]))
                data = encode_shard(doc_ids, ends, np.concatenate([x for _, _, x in held]), vocabulary)
                yield pa.record_batch([pa.array([at], pa.int32()), pa.array([part], pa.int32()), pa.array([len(doc_ids)], pa.int64()),
                                       pa.array([int(ends[-1])], pa.int64()), pa.array([data], pa.binary())],
                                      ["bucket", "part", "docs", "ids", "data"])
            held, part = [], part + 1

        for some in gathered(batches, "text", ENCODE_BYTES):
            buckets = some.column(0).to_numpy()
            ids, ends = encode_column(known, some.column(2), end_id, words)
            cuts = np.flatnonzero(np.diff(buckets)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(buckets)]):
                if buckets[lo] != at:
                    yield from close()
                    at, part = int(buckets[lo]), 0
                own = some.column(1)[lo:hi].to_pylist()
                held.append((own, np.diff(ends[lo: hi + 1]), ids[ends[lo]: ends[hi]]))
                if sum(len(x) for _, _, x in held) >= SHARD_IDS:
                    yield from close()
        yield from close()

    small_batches(rows).mapInArrow(run, "bucket int, part int, docs long, ids long, data binary").write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the shards of a folder."""
    shards = spark.read.parquet(path)

    def run(batches):
        for batch in batches:
            for bucket, part, data in zip(*(c.to_pylist() for c in batch.columns)):
                shard = Shard(data)
                ids, ends = shard.ids().astype("<u4", copy=False), shard.ends
                starts = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(ids[a:b].data) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(ends)
                yield pa.record_batch([pa.array([bucket] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(shard.doc_ids, pa.int64()),
                                       pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())],
                                      ["bucket", "part", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = shards.select("bucket", "part", "data").mapInArrow(
        run, "bucket int, part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # buckets are bounded in number; the parts of each are summed for themselves
    buckets = shards.groupBy("bucket").agg(F.sum("ids").alias("n"))
    buckets = buckets.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    parts = shards.select("bucket", "part", (F.sum("ids").over(Window.partitionBy("bucket").orderBy("part")) - F.col("ids")).alias("within"))
    first = parts.join(buckets, "bucket").select("bucket", "part", (F.col("before") + F.col("within")).alias("first"))
    return found.join(first, ["bucket", "part"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op6_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as read back from the compressed shards."""
    import public_tokenizers

    path = f"{shared_folder(spark)}/token-shards-{uuid.uuid4().hex}"
    write_shards(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), path)
    found = checkpointed(read_documents(spark, path))
    removed(spark, path)
    return found
