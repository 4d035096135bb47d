"""Token counts by a tokenizer compiled to a deterministic finite-state transducer.

The tokenizer merges the adjacent pieces of best score, so a text is tokenised as it is exactly if each
two neighbouring tokens, taken alone, are tokenised as those two. The last token of a prefix therefore
follows from the last tokens of the prefixes a piece's length before it. A state holds what of that can
still matter: the longest end of the read text that begins a longer piece, and at each place in it where
a piece may begin the last token and the token count so far, less the present one. The transition on a
character finds the one piece that ends there and fits the token before it, and is annotated with the
change in the token count. States are finite in number and are compiled when first reached; whether two
tokens fit is asked of the library. White space after other characters leads to one state from every
state, as no piece goes on across it.

Texts are cut into chunks that run side by side. A chunk's state map is taken at the state that a short
run over the text before it ends in; the maps are composed from the left, and where the state handed over
is another one, the chunk's map is taken at that too, until all agree. The counts are then summed.

Defined cases: a null or empty text has no tokens; a single very long text is cut like any other; equal
texts get equal counts; a null ``doc_id`` is carried; an empty table gives an empty result; other columns
are not read.
"""
from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import map_slices, read, string_offsets, text_or_empty, worker_cache

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Code points of a chunk, and of the text before it that gives the state to start from.
CHUNK = 512
LEAD = 32
#: Text bytes that run side by side.
SIDE_BYTES = 4 << 20
#: Transitions kept; past it the transducer is compiled anew (about 40 bytes each, and as much again for states).
MAX_TRANSITIONS = 3_000_000
SPACE = "▁"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def fields(message: bytes):
    """(number, value) of each field of an encoded protocol buffer message; groups don't occur."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = message[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(message):
        tag = varint()
        if tag & 7 == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            value, at = message[at: at + size], at + size
        yield tag >> 3, value


def vocabulary(model: bytes) -> dict[str, float]:
    """Score of each ordinary piece of a model file."""
    out = {}
    for number, value in fields(model):
        if number == 1:  # a piece: 1 its text, 2 its score, 3 its kind (1 ordinary)
            piece = dict(fields(value))
            if piece.get(3, 1) == 1:
                out[piece[1].decode()] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            elif piece[3] == 4:
                raise ValueError("the model has user-defined pieces")
    return out


class Transducer:
    """States and transitions, compiled on demand."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            self.pieces = vocabulary(f.read())
        self.begins = {p[:k] for p in self.pieces for k in range(1, len(p))}
        inside = {c for p in self.pieces if len(p) > 1 for c in p}
        if any(c not in self.pieces for c in inside) or any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("not a model whose pieces join single pieces and begin with the space mark")
        # classes: 1 to 4 for characters of so many bytes without a piece, 5 for lone pieces, then the others
        self.symbols = ["", *[None] * 5, *sorted(inside | {SPACE})]
        self.classes = np.empty(0x110000, dtype=np.int32)
        for k, (lo, hi) in enumerate(((0, 0x80), (0x80, 0x800), (0x800, 0x10000), (0x10000, 0x110000)), 1):
            self.classes[lo:hi] = k
        for p in self.pieces:
            if len(p) == 1:
                self.classes[ord(p)] = 5
        for k, c in enumerate(self.symbols[6:], 6):
            self.classes[ord(c)] = k
        self.classes[ord(" ")] = self.classes[ord(SPACE)]
        self.width = len(self.symbols)
        self.fit: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self):
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.lone = self.state_of(("", ((None, 0),)))
        self.spaced = self.state_of((SPACE, ((SPACE, 0), (None, -1))))
        self.grow(16)

    def state_of(self, key: tuple) -> int:
        k = self.number.get(key)
        if k is None:
            k = self.number[key] = len(self.states)
            self.states.append(key)
        return k

    def fits(self, left: str | None, right: str) -> bool:
        """Whether the two, read alone, are tokenised as these two tokens."""
        key = (left, right)
        known = self.fit.get(key)
        if known is None:
            # a line feed joins nothing, so what follows it is read alone
            got = self.library.encode("\n" + (left or "") + right, out_type=str)[2:]
            known = self.fit[key] = got == [t for t in key if t]
        return known

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """Next state and change of the token count. A state's key: the open end u, and for each k with
        u's last k characters beginning a longer piece, from k = 0, (last token before them, count)."""
        if symbol < 6:
            return self.lone, 1 if symbol == 5 else symbol
        c = self.symbols[symbol]
        end, history = self.states[state]
        if c == SPACE and end[-1:] != SPACE:
            return self.spaced, 1
        places = [k for k in range(len(end) + 1) if not k or end[-k:] in self.begins]
        for k, (token, count) in zip(reversed(places), reversed(history)):
            piece = end[len(end) - k:] + c
            if piece in self.pieces and self.fits(token, piece):
                break
        else:
            raise AssertionError(f"no token ends after {end + c!r}")
        change = count + 1
        before = dict(zip(places, history))
        grown = end + c
        while grown and grown not in self.begins:
            grown = grown[1:]
        later = [(piece, 0)]
        for k in range(1, len(grown) + 1):
            if grown[-k:] in self.begins:
                token, count = before[k - 1]
                later.append((token, count - change))
        return self.state_of((grown, tuple(later))), change

    def grow(self, bits: int, old: tuple | None = None):
        self.bits = bits
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.nexts = np.zeros(1 << bits, dtype=np.int32)
        self.changes = np.zeros(1 << bits, dtype=np.int8)
        self.filled = 0
        if old is not None:
            self.put(*old)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, nexts: np.ndarray, changes: np.ndarray):
        """Adds transitions that are not there yet (open addressing)."""
        if (self.filled + len(keys)) * 2 > len(self.keys):
            there = self.keys >= 0
            held = [np.concatenate(p) for p in zip((self.keys[there], self.nexts[there], self.changes[there]), (keys, nexts, changes))]
            return self.grow(max(self.bits + 1, int(2 * len(held[0])).bit_length()), tuple(held))
        at = self.slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            taken, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[taken], self.nexts[taken], self.changes[taken] = keys[won], nexts[won], changes[won]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
        self.filled += len(keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; where there is none yet, a slot that holds another key or nothing."""
        at = self.slot(keys)
        held = self.keys[at]
        off = np.flatnonzero((held != keys) & (held >= 0))
        while len(off):
            at[off] = (at[off] + 1) & (len(self.keys) - 1)
            held = self.keys[at[off]]
            off = off[(held != keys[off]) & (held >= 0)]
        return at

    def move(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One transition of each lane."""
        keys = states * self.width + symbols
        at = self.find(keys)
        if (self.keys[at] != keys).any():
            new = np.unique(keys[self.keys[at] != keys])
            made = [self.step(k // self.width, k % self.width) for k in new.tolist()]
            self.put(new, np.array([m[0] for m in made], dtype=np.int32), np.array([m[1] for m in made], dtype=np.int8))
            at = self.find(keys)
        return self.nexts[at].astype(np.int64), self.changes[at]

    def run(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final state and token count of each lane: symbols[starts] and so on, ``lengths`` of them."""
        order = np.argsort(-lengths, kind="stable")
        at, now, total = starts[order], states[order].copy(), np.zeros(len(order), dtype=np.int64)
        alive = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), side="left")
        for t, m in enumerate(alive.tolist()):
            now[:m], change = self.move(now[:m], symbols[at[:m] + t])
            total[:m] += change
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return now[back], total[back]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Token counts of texts without nulls."""
        if self.filled > MAX_TRANSITIONS:
            self.clear()
        if self.library.encode("a", out_type=str)[:1] == ["a"]:
            raise ValueError("the model doesn't put the space mark before a text")
        whole = "".join(texts.to_pylist())
        symbols = self.classes[np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)]
        sizes = np.array([len(t) for t in texts.to_pylist()], dtype=np.int64)
        ends = np.cumsum(sizes)
        pieces = -(-sizes // CHUNK)
        text = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = (ends - sizes)[text] + nth * CHUNK
        lengths = np.minimum(starts + CHUNK, ends[text]) - starts
        first = nth == 0
        entry = np.full(len(starts), self.spaced, dtype=np.int64)
        later = np.flatnonzero(~first)
        entry[later], _ = self.run(symbols, starts[later] - LEAD, np.full(len(later), LEAD), entry[later])
        final, total = self.run(symbols, starts, lengths, entry)
        while True:  # hand the states over from the left
            given = np.concatenate((entry[:1], final[:-1]))
            off = np.flatnonzero(~first & (given != entry))
            if not len(off):
                break
            entry[off] = given[off]
            final[off], total[off] = self.run(symbols, starts[off], lengths[off], entry[off])
        return np.bincount(text, weights=total, minlength=len(sizes)).astype(np.int64) + (sizes > 0)


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row's whole text. ``model``: path of a model file."""
    def run(batch):
        machine = worker_cache(f"transducer:{model}", lambda: Transducer(model))
        n = machine.counts(batch.column(1))
        return pa.record_batch([batch.column(0), pa.array(np.diff(string_offsets(batch.column(1)))), pa.array(n), pa.array(n > limit)],
                               ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), run,
                      "doc_id long, n_bytes long, n_tokens long, over_limit boolean", limit=SIDE_BYTES)


def op8_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
