"""Cross-tokenizer alignment of whole texts, each distinct text once.

Texts are shuffled by full text, so that a text met many times is tokenised and aligned once and its
multiplicity weights what is counted. Tokenizer A (a file of the tokenizers library) reads a blank and
the text, tokenizer B (a sentencepiece model) the text, to which it adds the blank itself. The tokens of
each are laid on the bytes of blank and text. Places where tokens of both end cut them into groups; an
A token and a B token are linked once where their byte ranges overlap. An id pair's count is the number
of documents that hold it linked.

Texts are cut into atoms that no token of either crosses (see ``word_ids``; for B the vocabulary is
looked at), and an atom's alignment is kept in the worker. Other texts are aligned whole.

Distinct texts are aligned in slices of about 6 MB and written to the folder that
``spark.checkpoint.dir`` names, a row a slice: the texts' measures, their links as places in the slice's
table of id pairs, and that table with the documents that hold each pair. Counts are summed over the
slices' tables, and what the corpus says of a slice's pairs comes back to the slice's row, so neither
documents x pairs nor a table of all pairs is ever sent to one place. Measures are joined to the
document ids by the SHA-256 of the text.

Defined cases: a text that is null, empty, or whose token bytes differ from blank and text (U+2581, for
one) has no tokens: zeros, and an empty ``groups_sha256``; equal texts and repeated rows count each for
itself and have a row each; a null ``doc_id`` is carried; an empty table gives an empty result; other
columns are not read.
"""
from __future__ import annotations

import hashlib
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import checkpointed, gathered, read, removed, shared_folder, small_batches, string_bytes, string_offsets, worker_cache
from pairlens.llm.word_ids import ENDINGS, WordStore, coded_atoms, endings, plain_rows, spread

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
#: Text bytes of a slice, about; atoms whose alignment a worker keeps.
SLICE_TEXT = 6 << 20
KEPT_ATOMS = 200_000
#: What a text, an atom or a slice's row is measured by.
MEASURES = ["n_a", "n_b", "n_groups", "n_links"]
#: The blank that sentencepiece writes as a visible character.
SPACE_MARK = "▁"


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable Latin-1 for itself, the other
    bytes in turn from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class Aligner:
    """Two tokenizers, the bytes of their tokens, and alignments of atoms and texts."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        symbols = byte_of_symbol()
        added = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for piece, i in self.a.get_vocab().items():
            self.bytes_a[i] = added[i] if i in added else bytes(symbols[c] for c in piece)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size_a = np.array(list(map(len, self.bytes_a)), dtype=np.int64)
        self.size_b = np.array(list(map(len, self.bytes_b)), dtype=np.int64)
        # pieces of B that hold a blank behind another character, or a line feed, would cross an atom's end
        own = [p for i, p in enumerate(pieces) if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i)]
        self.cuts = not any(SPACE_MARK in p.lstrip(SPACE_MARK) or "\n" in p for p in own)
        behind = {y for p in own for x, y in zip(p, p[1:]) if x.isascii() and x.isalpha()}
        self.tails = bytes(c for c in endings(self.a) if c in ENDINGS and chr(c) not in behind)
        self.store = WordStore(KEPT_ATOMS)

    def encode_b(self, units: list[str]) -> list[list[int]]:
        """Ids of units; B adds a blank to each, so one that has none stands behind a line feed that is taken off."""
        ids = self.b.encode([u[1:] if u[:1] == " " else "\n" + u for u in units], num_threads=1)
        return [x if u[:1] == " " else x[2:] for u, x in zip(units, ids)]

    def align(self, units: list[str]) -> dict[str, tuple | bool]:
        """Of each unit its groups as text, the measures, and its links as A id x 2^32 + B id; False where token
        bytes differ from the unit's."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        ids_b = self.encode_b(units)
        whole = [u.encode() for u in units]
        fits = [b"".join([self.bytes_a[i] for i in x]) == w == b"".join([self.bytes_b[i] for i in y]) for w, x, y in zip(whole, ids_a, ids_b)]
        out: dict[str, tuple | bool] = {u: False for u, fit in zip(units, fits) if not fit}
        good = [i for i, fit in enumerate(fits) if fit]
        if not good:
            return out
        flat_a, flat_b = (np.concatenate([np.array(x[i], dtype=np.int64) for i in good]) for x in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        ends = np.cumsum([len(whole[i]) for i in good])
        every = np.union1d(end_a, end_b)  # a stretch up to each of these lies in one token of A and one of B
        links = (flat_a[np.searchsorted(end_a, every)] << 32) | flat_b[np.searchsorted(end_b, every)]
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        to_a, to_b = np.searchsorted(end_a, both, side="right"), np.searchsorted(end_b, both, side="right")
        text_a, text_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        at_a, at_b, groups = 0, 0, []
        for x, y in zip(to_a.tolist(), to_b.tolist()):
            groups.append(",".join(text_a[at_a:x]) + "|" + ",".join(text_b[at_b:y]))
            at_a, at_b = x, y
        last = [np.searchsorted(e, ends, side="right").tolist() for e in (end_a, end_b, both, every)]
        before = [[0, *x[:-1]] for x in last]
        for k, i in enumerate(good):
            n = [x[k] - y[k] for x, y in zip(last, before)]
            out[units[i]] = (";".join(groups[before[2][k]: last[2][k]]).encode(), *n, links[before[3][k]: last[3][k]].tobytes())
        return out

    def texts(self, texts: pa.Array) -> dict:
        """Of each text (none null or empty): ``groups``, as bytes, or None for no tokens; the measures; and its
        distinct links: ``n_pairs`` of each text, ``pair`` as places in ``table`` (ascending), ``times``."""
        n = len(texts)
        plain = plain_rows(string_bytes(texts), string_offsets(texts)) if self.cuts else np.zeros(n, dtype=bool)
        blank = pc.binary_join_element_wise(pa.scalar(" "), texts.cast(pa.string()), pa.scalar(""))
        atoms, which, row_ends = coded_atoms(blank.filter(pa.array(plain)), self.tails)
        known = self.store.of(atoms, self.align)
        rest = np.flatnonzero(~plain)
        for i in rest.tolist():  # each a unit for itself, not kept
            text = blank[i].as_py()
            known.append(self.align([text])[text])
        counts = np.ones(n, dtype=np.int64)
        counts[plain] = np.diff(row_ends)
        ends = np.concatenate(([0], np.cumsum(counts)))
        unit = np.empty(int(ends[-1]), dtype=np.int64)
        unit[spread(ends[:-1][plain], counts[plain])] = which
        unit[ends[:-1][~plain]] = len(atoms) + np.arange(len(rest))
        row = np.repeat(np.arange(n), counts)
        broken = np.array([not k for k in known], dtype=bool)
        bad = np.zeros(n, dtype=bool)
        bad[row[broken[unit]]] = True
        sized = np.array([k[1:5] if k else (0, 0, 0, 0) for k in known], dtype=np.int64).reshape(-1, 4)
        sums = np.concatenate((np.zeros((1, 4), dtype=np.int64), np.cumsum(sized[unit], axis=0)))
        measures = np.where(bad[:, None], 0, sums[ends[1:]] - sums[ends[:-1]])
        spell, codes = [k[0] if k else b"" for k in known], unit.tolist()
        groups = [None if b else b";".join([spell[c] for c in codes[lo:hi]]) for b, lo, hi in zip(bad.tolist(), ends[:-1].tolist(), ends[1:].tolist())]
        # links of each text: those of its units, equal ones together
        table, place = np.unique(np.frombuffer(b"".join([k[5] for k in known if k]), dtype=np.int64), return_inverse=True)
        first = np.cumsum(sized[:, 3]) - sized[:, 3]
        good = ~bad[row]
        row, unit = row[good], unit[good]
        size = sized[unit, 3]
        key = np.repeat(row, size) * max(1, len(table)) + place[spread(first[unit], size)]
        key, times = np.unique(key, return_counts=True)
        return {"groups": groups, "measures": measures, "n_pairs": np.bincount(key // max(1, len(table)), minlength=n),
                "pair": key % max(1, len(table)), "times": times, "table": table}


SLICE_SCHEMA = ("slice long, texts long, keys binary, sums binary, measures binary, links binary, pairs array<long>, docs array<long>")


def write_slices(distinct: DataFrame, path_a: str, path_b: str, path: str) -> None:
    """The table of slices of ``distinct``: text, text_key (32 bytes), docs (its number of documents)."""
    def run(batches):
        aligner = worker_cache(f"aligner:{path_a}:{path_b}", lambda: Aligner(path_a, path_b))
        number = TaskContext.get().partitionId() << 32
        for part in gathered(batches, "text", SLICE_TEXT):
            found = aligner.texts(part.column(0))
            docs = part.column(2).to_numpy()
            held = np.bincount(found["pair"], weights=np.repeat(docs, found["n_pairs"]), minlength=len(found["table"])).astype(np.int64)
            used = held > 0
            places = (np.cumsum(used) - 1)[found["pair"]]
            sums = b"".join([b"" if g is None else hashlib.sha256(g).digest() for g in found["groups"]])
            empty = np.array([g is None for g in found["groups"]], dtype=np.uint8)
            links = np.concatenate((found["n_pairs"], places, found["times"])).astype("<u4")
            yield pa.record_batch([
                pa.array([number], pa.int64()), pa.array([part.num_rows], pa.int64()), pa.array([b"".join(part.column(1).to_pylist())], pa.binary()),
                pa.array([empty.tobytes() + sums], pa.binary()), pa.array([found["measures"].astype("<i8").tobytes()], pa.binary()),
                pa.array([pa.compress(links.tobytes(), codec="zstd", asbytes=True) if len(links) else b""], pa.binary()),
                pa.array([found["table"][used]], pa.list_(pa.int64())), pa.array([held[used]], pa.list_(pa.int64())),
            ], ["slice", "texts", "keys", "sums", "measures", "links", "pairs", "docs"])
            number += 1

    small_batches(distinct.select("text", "text_key", "docs")).mapInArrow(run, SLICE_SCHEMA).write.parquet(path)


def pair_counts(slices: DataFrame) -> DataFrame:
    """(pair, count, best): the documents that hold each id pair linked, and whether none of its A id has more."""
    tables = slices.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("p.pairs", "p.docs")
    counts = tables.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("count"))
    a_id = F.shiftright("pair", 32).alias("a_id")
    most = counts.groupBy(a_id).agg(F.max("count").alias("most"))
    return counts.select("*", a_id).join(most, "a_id").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def text_measures(slices: DataFrame) -> DataFrame:
    """(text_key, measures, n_best, count_sum, groups_sha256) of each distinct text."""
    asked = slices.select(F.col("slice").alias("of"), F.posexplode("pairs").alias("place", "pair"))
    told = asked.join(pair_counts(slices), "pair").select("of", "place", "count", "best")

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        """One slice's row, and what is known of its pairs: no more than its bounded text holds."""
        of_count, of_best = np.zeros((2, known.num_rows), dtype=np.int64)
        order = known.column("place").to_numpy()
        of_count[order], of_best[order] = known.column("count").to_numpy(), known.column("best").to_numpy()
        keys, sums, measures, links = (rows.column(c)[0].as_py() for c in ("keys", "sums", "measures", "links"))
        n = len(keys) // 32
        measures = np.frombuffer(measures, dtype="<i8").reshape(n, 4)
        links = np.frombuffer(unpacked(links), dtype="<u4").astype(np.int64)
        pair, times = np.split(links[n:], 2)
        ends = np.concatenate(([0], np.cumsum(links[:n])))
        by_text = [np.diff(np.concatenate(([0], np.cumsum(x[pair] * times)))[ends]) for x in (of_best, of_count)]
        empty = np.frombuffer(sums, dtype=np.uint8, count=n).astype(bool)
        hashes, at = sums[n:].hex(), np.cumsum(~empty) - 1
        shown = ["" if e else hashes[64 * k: 64 * k + 64] for e, k in zip(empty.tolist(), at.tolist())]
        return pa.table({"text_key": pa.array([keys[32 * k: 32 * k + 32] for k in range(n)], pa.binary()),
                         **{c: pa.array(measures[:, k]) for k, c in enumerate(MEASURES)},
                         "n_best": pa.array(by_text[0]), "count_sum": pa.array(by_text[1]), "groups_sha256": pa.array(shown, pa.string())})

    return slices.select("slice", "keys", "sums", "measures", "links").groupBy("slice").cogroup(told.groupBy("of")).applyInArrow(
        run, "text_key binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def unpacked(data: bytes) -> bytes:
    return pa.CompressedInputStream(pa.BufferReader(data), "zstd").read() if data else b""


def alignment(docs: DataFrame, path_a: str, path_b: str, folder: str) -> DataFrame:
    """One row per document: doc_id, its text's measures, and the digest of its groups. ``folder``: an unused one
    that all executors share, for the table of slices."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = F.unhex(F.sha2("text", 256))
    distinct = rows.where("text <> ''").groupBy("text").agg(F.count("*").alias("docs")).select("text", key.alias("text_key"), "docs")
    write_slices(distinct, path_a, path_b, folder)
    # a row a distinct text; after it the folder is read no more
    found = checkpointed(text_measures(docs.sparkSession.read.parquet(folder)))
    joined = rows.select("doc_id", key.alias("text_key")).join(found, "text_key", "left")
    return joined.select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in [*MEASURES, "n_best", "count_sum"]],
                         F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment of a byte-level and a sentencepiece tokenizer."""
    import public_tokenizers

    folder = f"{shared_folder(spark)}/token-links-{uuid.uuid4().hex}"
    found = alignment(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B), folder)
    removed(spark, folder)
    return found
