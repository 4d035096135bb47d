"""Token ids of whole columns with the tokenizers library, each distinct atom of a slice encoded once.

Texts are cut into atoms where no pre-token of the two tokenizers crosses: before a blank or line feed
that stands alone between other characters, after such a line feed where ASCII follows, and between an
ASCII letter and the punctuation that ends its word. The ids of a text are those of its atoms end to
end. A text that holds other white space, white space at an end or in runs is given to the library whole.
"""
from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from pairlens.llm.common import string_bytes, string_offsets, worker_cache

#: Atoms handed to the library as one string.
ATOMS_PER_CALL = 64
#: Atoms whose ids a worker keeps between slices (about 200 bytes each).
CACHED_WORDS = 400_000
#: Text bytes encoded at once.
ENCODE_BYTES = 8 << 20
#: ASCII control characters, blank included: white space, or unusual enough to go to the library whole.
CONTROLS = 33
#: Punctuation that may be cut from the word it ends, where it is in no special token.
ENDINGS = b"!\"#$%&()*+,-./:;=?@[]^_`{}~"


def load_tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker; threads are left to Spark."""
    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        k = Tokenizer.from_file(path)
        k.no_truncation()
        k.no_padding()
        return k
    return worker_cache(f"tokenizer:{path}", make)


def special_strings(tokenizer) -> list[str]:
    """Strings that the tokenizer takes for special wherever they stand in a text."""
    return [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.content]


def endings(tokenizer) -> bytes:
    """The punctuation that is cut from words: part of no special token."""
    used = "".join(special_strings(tokenizer)).encode()
    return bytes(b for b in ENDINGS if b not in used)


def plain_rows(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True for each text whose only ASCII controls are single blanks and line feeds inside it."""
    n = len(ends) - 1
    ok = np.ones(n, dtype=bool)
    if not len(data):
        return ok
    low = data < CONTROLS
    ws = low & ((data == 32) | (data == 10))
    bad = low & ~ws
    bad[1:] |= ws[1:] & ws[:-1]
    full = ends[1:] > ends[:-1]
    bad[ends[:-1][full]] |= ws[ends[:-1][full]]
    bad[ends[1:][full] - 1] |= ws[ends[1:][full] - 1]
    ok[np.searchsorted(ends, np.flatnonzero(bad), side="right") - 1] = False
    return ok


def atom_starts(data: np.ndarray, ends: np.ndarray, tails: bytes) -> np.ndarray:
    """Byte positions at which the atoms of plain texts begin."""
    n = len(data)
    mark = np.zeros(n + 1, dtype=bool)
    mark[ends] = True
    feed = data == 10
    mark[:n] |= (data == 32) | feed
    mark[1:n] |= feed[:-1] & (data[1:] < 128)  # white space beyond ASCII may join the line feed
    kind = np.zeros(256, dtype=bool)
    kind[list(tails)] = True
    tail = kind[data]
    edge = np.flatnonzero(np.diff(tail, prepend=False, append=False))
    first, stop = edge[::2], edge[1::2]  # runs of punctuation
    before = data[np.maximum(first - 1, 0)] | 32
    cut = (first > 0) & ~mark[first] & mark[stop] & (before >= 97) & (before <= 122)
    mark[first[cut]] = True
    return np.flatnonzero(mark[:n])


def coded_atoms(texts: pa.Array, tails: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct atoms of plain texts, the atom of each place, and n + 1 offsets of the texts in places."""
    data, ends = string_bytes(texts), string_offsets(texts)
    starts = atom_starts(data, ends, tails)
    places = np.concatenate((starts, [len(data)])).astype(np.int64)
    atoms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data)))
    coded = atoms.dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.searchsorted(starts, ends, side="left")


def encode_atoms(tokenizer, atoms: list[str]) -> dict[str, bytes]:
    """Ids of each atom as little-endian uint32 bytes; many share a call, a special token between them."""
    special = special_strings(tokenizer)
    opens = {s[0] for s in special}
    marker = None if tokenizer.encode_special_tokens else next(
        (s for s in special if not opens & set(s[1:]) and not any(t != s and t.startswith(s) for t in special)), None)
    out, shared, rest = {}, [], atoms
    if marker is not None:  # an atom that holds no first character of a special token takes no part in one
        holds = set()
        for c in opens:
            holds.update([a for a in atoms if c in a])
        shared, rest = [a for a in atoms if a not in holds] if holds else atoms, [a for a in atoms if a in holds] if holds else []
    if shared:
        own = tokenizer.token_to_id(marker)
        groups = [shared[i: i + ATOMS_PER_CALL] for i in range(0, len(shared), ATOMS_PER_CALL)]
        for at in range(0, len(groups), 256):
            some = groups[at: at + 256]
            for group, e in zip(some, tokenizer.encode_batch_fast([marker.join(g) for g in some], add_special_tokens=False)):
                ids = np.array(e.ids, dtype="<u4")
                cuts = np.flatnonzero(ids == own) * 4
                data = ids.tobytes()
                out.update(zip(group, (data[lo:hi] for lo, hi in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(data)]))))
    for at in range(0, len(rest), 4096):
        some = rest[at: at + 4096]
        out.update((a, np.array(e.ids, dtype="<u4").tobytes()) for a, e in zip(some, tokenizer.encode_batch_fast(some, add_special_tokens=False)))
    return out


class WordStore:
    """What is known of atoms seen lately: once half of the room is taken the older half is forgotten, but for those used since."""

    def __init__(self, room: int = CACHED_WORDS):
        self.half, self.young, self.old = room // 2, {}, {}

    def look(self, words: list[str]) -> list:
        """What is known of each, None where unknown."""
        out = list(map(self.young.get, words))
        if self.old:
            young, old = self.young, self.old.get
            for i in [i for i, known in enumerate(out) if known is None]:
                if (known := old(words[i])) is not None:
                    young[words[i]] = out[i] = known
        return out

    def add(self, words: dict) -> None:
        self.young.update(words)
        if len(self.young) > self.half:
            self.old, self.young = self.young, {}

    def of(self, words: list[str], make) -> list:
        """What is known of each; ``make`` gives it for a list of unknown ones."""
        out = self.look(words)
        where = [i for i, known in enumerate(out) if known is None]
        if where:
            new = make([words[i] for i in where])
            self.add(new)
            for i in where:
                out[i] = new[words[i]]
        return out


def spread(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions begins[i] .. begins[i] + counts[i] - 1, for each i in turn."""
    total = int(counts.sum())
    kind = np.int32 if total < 1 << 31 and begins.max(initial=0) < 1 << 30 else np.int64
    shift = (begins - (np.cumsum(counts) - counts)).astype(kind)
    return np.repeat(shift, counts) + np.arange(total, dtype=kind)


def encode_column(tokenizer, texts: pa.Array, end_id: int | None = None, store: WordStore | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end as uint32, and n + 1 offsets; ``end_id`` is appended to each text.

    ``texts`` holds no nulls. An empty text has no ids besides the end id. ``store``: ids of atoms
    seen before, for calls with the same tokenizer.
    """
    n = len(texts)
    plain = plain_rows(string_bytes(texts), string_offsets(texts))
    rows = np.flatnonzero(plain)
    own = texts.filter(pa.array(plain)) if len(rows) < n else texts
    atoms, which, row_ends = coded_atoms(own, endings(tokenizer))
    parts = (store or WordStore()).of(atoms, lambda new: encode_atoms(tokenizer, new))
    counts = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
    flat, begins = np.frombuffer(b"".join(parts), dtype="<u4"), np.cumsum(counts) - counts
    each = counts[which]
    sums = np.concatenate(([0], np.cumsum(each)))
    n_ids = np.zeros(n, dtype=np.int64)
    n_ids[rows] = sums[row_ends[1:]] - sums[row_ends[:-1]]
    slow = np.flatnonzero(~plain)
    whole = {}
    for i in slow:
        whole[i] = np.array(tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
        n_ids[i] = len(whole[i])
    extra = int(end_id is not None)
    offsets = np.concatenate(([0], np.cumsum(n_ids + extra)))
    out = np.empty(int(offsets[-1]), dtype=np.uint32)
    ids = flat[spread(begins[which], each)]
    if not extra and not whole:
        out = ids
    else:
        out[spread(offsets[:-1][rows], n_ids[rows])] = ids
    for i, v in whole.items():
        out[offsets[i]: offsets[i] + len(v)] = v
    if extra:
        out[offsets[1:] - 1] = end_id
    return out, offsets
