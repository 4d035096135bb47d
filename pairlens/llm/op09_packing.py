"""Harmonic packing of token ids into sequences of a power-of-two capacity.

A document's ids (with the end id) are cut into pieces: full ones of ``capacity`` ids, then halves,
quarters, ... down to a sixteenth as the rest allows, then the rest. A piece of length l is of class
j = capacity // l, and a sequence of class j takes exactly j pieces, so those of halves, quarters and
so on are filled exactly. Each task fills its own sequences; what is left in its open ones at its end
is laid end to end and cut into sequences of powers of two, which need no padding. Nothing is
shuffled, and a task holds less than one open sequence a class (j pieces of its class).

Defined cases: a null or empty text has the end id alone; equal rows are packed each for itself; a
null ``doc_id`` is carried; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import gathered, read, small_batches, text_or_empty, worker_cache
from pairlens.llm.word_ids import ENCODE_BYTES, WordStore, encode_column, load_tokenizer

CAPACITY = 1024
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: The shortest cut piece is this part of the capacity; a shorter rest stays whole.
FINEST_PART = 16
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "class_docs int, ids array<int>")


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids."""
    out = [capacity] * (n // capacity)
    rest, half = n % capacity, capacity // 2
    while rest and half >= max(1, capacity // FINEST_PART):
        if rest >= half:
            out.append(half)
            rest -= half
        half //= 2
    return out + [rest] * bool(rest)


class Packer:
    """Open sequences of one task. Rows: (doc_id, start, ids, doc_tokens, sequence, offset, class)."""

    def __init__(self, task: int, capacity: int):
        self.capacity, self.next, self.open = capacity, task << 40, {}

    def close(self, pieces: list[tuple], kind: int):
        at = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, ids, total, self.next, at, kind
            at += len(ids)
        self.next += 1

    def add(self, doc_id, ids: np.ndarray):
        at = 0
        for length in cut(len(ids), self.capacity):
            kind = self.capacity // length
            piece = (doc_id, at, ids[at: at + length], len(ids))
            at += length
            if kind == 1:
                yield from self.close([piece], kind)
                continue
            held = self.open.setdefault(kind, [])
            held.append((*piece[:2], piece[2].copy(), piece[3]))
            if len(held) == kind:
                yield from self.close(self.open.pop(kind), kind)

    def rest(self):
        """The open sequences' pieces end to end, cut at powers of two."""
        left = [p for kind in sorted(self.open) for p in self.open[kind]]
        self.open = {}
        total = sum(len(p[2]) for p in left)
        while total:
            room = min(self.capacity, 1 << (total.bit_length() - 1))
            total -= room
            taken = []
            while room:
                doc_id, start, ids, n = left.pop(0)
                taken.append((doc_id, start, ids[:room], n))
                if len(ids) > room:
                    left.insert(0, (doc_id, start + room, ids[room:], n))
                room -= len(taken[-1][2])
            yield from self.close(taken, 0)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece, with its ids if asked for. ``tokenizer``: path of a file of the tokenizers library."""
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("the capacity is a power of two")

    def rows(found: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found))
        data = [x.astype("<u4", copy=False).data for x in cols[2]]
        return pa.record_batch([
            pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(map(len, cols[2]), pa.int64()),
            pa.array(map(zlib.crc32, data), pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()),
            pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.int32()),
            pa.array([x.astype(np.int32) for x in cols[2]] if with_ids else [None] * len(found), pa.list_(pa.int32())),
        ], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "class_docs", "ids"])

    def run(batches):
        packer = Packer(TaskContext.get().partitionId(), capacity)
        known = load_tokenizer(tokenizer)
        words = worker_cache(f"words:{tokenizer}", WordStore)
        for part in gathered(batches, "text", ENCODE_BYTES):
            ids, ends = encode_column(known, part.column(1), end_id, words)
            found = []
            for doc_id, lo, hi in zip(part.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                found.extend(packer.add(doc_id, ids[lo:hi]))
            if found:
                yield rows(found)
        if found := list(packer.rest()):
            yield rows(found)

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return small_batches(rows_in).mapInArrow(run, SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids."""
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), with_ids=False).drop("ids")
