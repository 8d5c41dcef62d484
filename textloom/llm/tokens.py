"""Token ids of whole texts by the tokenizers library, with each distinct text chunk encoded once a worker.

A byte-level BPE pre-tokenizer never joins a letter run across (a) a single space between two visible characters
or (b) an ASCII letter followed by one of ``.,!?;:``. Cutting there, in bytes, cannot change the ids; the chunks repeat
heavily, so a bounded per-worker cache from chunk hash (95 bits) to ids replaces most of the encoding work. When it
reaches ``CACHE_CHUNKS`` chunks or ``CACHE_IDS`` ids, the chunks seen least often go.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np

from .vectext import Text

CACHE_CHUNKS = 400_000
CACHE_IDS = 4_000_000
JOINED = 512
ENCODE_BYTES = 1 << 19  # text encoded at once: more of it repeats than in a smaller slice
_SIMPLE = re.compile(rb" (?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,!?;:"]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LEAD2 = np.zeros(256, bool)
_LEAD2[0xC3:0xE0] = True  # two-byte letters; 0xC2 holds Unicode spaces
_LEAD = _VISIBLE | _LEAD2
_LEAD[0xE4:0xF5] = True  # 0xE1-0xE3 hold Unicode spaces
_encoders: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # a byte-level token has one character a byte
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self._reset()

    def _reset(self) -> None:
        self.known, self.known_slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # ascending hashes and their places in the cache
        self.n_slots = self.n_ids = 0
        self.start, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.check, self.key = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.uses = np.zeros(1024, np.int64)  # slices that held the chunk
        self.flat = np.zeros(4096, np.uint32)

    def _shrink(self) -> None:
        """Keeps the half of the cache that was seen most often."""
        n = self.n_slots
        keep = np.sort(np.argsort(-self.uses[:n], kind="stable")[: n // 2])
        keep = keep[self.uses[keep] > 1]
        keep = keep[np.cumsum(self.length[keep]) <= CACHE_IDS // 2]
        start, length = self.start[keep], self.length[keep]
        kept = self.key[keep], self.check[keep], self.uses[keep] // 2
        ends = np.cumsum(length)
        flat = self.flat[np.repeat(start - (ends - length), length) + np.arange(int(length.sum()))]
        self._reset()
        n = self.n_slots = len(keep)
        self.n_ids = len(flat)
        self.start, self.length, self.key, self.check, self.uses, self.flat = (self._grown(a, size) for a, size in ((self.start, n), (self.length, n), (self.key, n), (self.check, n), (self.uses, n), (self.flat, len(flat))))
        self.start[:n], self.length[:n], (self.key[:n], self.check[:n], self.uses[:n]) = ends - length, length, kept
        self.flat[: len(flat)] = flat
        self.known_slot = np.argsort(self.key[:n])
        self.known = self.key[:n][self.known_slot]

    def _grown(self, a: np.ndarray, n: int) -> np.ndarray:
        return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def _add(self, hashes: np.ndarray, checks: np.ndarray, chunks: list[bytes]) -> np.ndarray:
        """Encodes new chunks, by ascending hash, and returns their places. Chunks of a space and letters are one pre-token each, also behind one another, so they are
        encoded as long texts, whose ids are dealt to the chunks by the bytes they stand for; that is much cheaper than a call a chunk."""
        is_simple = [_SIMPLE(c) is not None for c in chunks]
        simple, other = ([i for i, x in enumerate(is_simple) if x is want] for want in (True, False))
        groups = [simple[k : k + JOINED] for k in range(0, len(simple), JOINED)]
        found = self.tokenizer.encode_batch_fast([b"".join(chunks[i] for i in g).decode() for g in groups] + [chunks[i].decode() for i in other], add_special_tokens=False)
        ids = [e.ids for e in found]
        total = sum(map(len, ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        joined = sum(map(len, ids[: len(groups)]))
        stands = np.cumsum(self.bytes_of[flat[:joined]])  # bytes up to the end of each id
        bounds = np.cumsum(np.array([len(chunks[i]) for i in simple], np.int64))
        ends = np.searchsorted(stands, bounds)
        if len(simple) and (ends[-1] + 1 != joined or (stands[ends] != bounds).any()):
            raise ValueError("the tokenizer does not split at single spaces")
        lengths = np.concatenate([np.diff(ends + 1, prepend=0), np.array([len(x) for x in ids[len(groups) :]], np.int64)])
        n, total = self.n_slots + len(lengths), self.n_ids + total
        self.start, self.length, self.check, self.key, self.uses, self.flat = (self._grown(a, size) for a, size in ((self.start, n), (self.length, n), (self.check, n), (self.key, n), (self.uses, n), (self.flat, total)))
        new = slice(self.n_slots, n)
        order = np.array([*simple, *other])
        self.check[new], self.key[new], self.uses[new], self.length[new] = checks[order], hashes[order], 0, lengths
        self.start[new] = self.n_ids + np.cumsum(lengths) - lengths
        self.flat[self.n_ids : total] = flat
        slots = np.empty(len(order), np.int64)
        slots[order] = np.arange(self.n_slots, n)
        at, held = self._find(hashes)
        self.known_slot[at[held]] = slots[held]  # another chunk's hash: the newer entry counts
        self.known, self.known_slot = np.insert(self.known, at[~held], hashes[~held]), np.insert(self.known_slot, at[~held], slots[~held])
        self.n_slots, self.n_ids = n, total
        return slots

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash stands or belongs among the known ones, and whether it is there."""
        at = np.searchsorted(self.known, hashes)
        held = np.zeros(len(hashes), bool)
        inside = at < len(self.known)
        held[inside] = self.known[at[inside]] == hashes[inside]
        return at, held

    def encode(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents in order, and the number of ids before each document (one more entry at the end)."""
        data, bounds = text.data, text.bounds
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        if self.n_slots > CACHE_CHUNKS or self.n_ids > CACHE_IDS:
            self._shrink()
        prev, nxt = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
        prev[1:], nxt[:-1] = data[:-1], data[1:]
        cut = data == 32
        before = _VISIBLE[prev]
        before[2:] |= _LEAD2[data[:-2]] & (prev[2:] >= 0x80)
        cut &= before & _LEAD[nxt]
        cut |= _STOP[data] & _LETTER[prev]
        cut[bounds[:-1][bounds[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        first, second = text.strong_ranges(starts, ends)
        hashes, at, back = np.unique(first, return_index=True, return_inverse=True)
        checks = second[at]
        place, held = self._find(hashes)
        slots = np.zeros(len(hashes), np.int64)
        slots[held] = self.known_slot[place[held]]
        new = np.flatnonzero(~held | (self.check[slots] != checks))  # unknown, or another chunk's entry
        if len(new):
            raw = data.tobytes()
            s, e = starts[at[new]].tolist(), ends[at[new]].tolist()
            slots[new] = self._add(hashes[new], checks[new], [raw[a:b] for a, b in zip(s, e)])
        self.uses[slots] += 1
        chosen = slots[back.reshape(-1)]
        lengths = self.length[chosen]
        done = np.zeros(len(chosen) + 1, np.int64)
        np.cumsum(lengths, out=done[1:])
        where = np.repeat(self.start[chosen] - done[:-1], lengths) + np.arange(done[-1])
        return self.flat[where], done[np.searchsorted(starts, bounds)]


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
