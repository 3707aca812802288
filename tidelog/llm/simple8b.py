"""Simple-8b, a word-aligned code for ids, and a file format of it.

A 64-bit word's top four bits are its selector: how many ids the word holds and how
many bits each has. Selector 0 is an escape: the word's other bits give a place in
the block's list of values of 60 bits and over. Ids are coded in blocks; the table of
blocks says where each one's words, escapes and ids begin, so that any block can be
decoded alone, with a few numpy operations for each selector in it.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: Fixed values: (ids in a word, bits of each) by selector.
SELECTORS = [
    (1, 60), (240, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
]
ESCAPE = 0
BLOCK_IDS = 1 << 16
MAGIC = b"S8BIDS01"
_HELD = np.array([n for n, _ in SELECTORS])


_SHORT = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bit length of each id."""
    if ids.max() < len(_SHORT):
        return _SHORT[ids]
    high = (ids >> np.uint64(32)).astype(np.float64)
    low = (ids & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.uint8)


def _widest(bits: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each number of ids that a word may hold, ascending: the most bits among so many
    ids from each place on. Windows are put together from the two largest before that cover
    them; what is past the end counts as no bits."""
    n, made = len(bits), {1: bits}
    for held in sorted({n for n, _ in SELECTORS}):
        if held > 1:
            half = max(h for h in made if 2 * h >= held or h == max(made))
            while 2 * half < held:  # no window before is long enough: double the longest
                made[2 * half] = _joined(made[half], half, n)
                half *= 2
            made[held] = _joined(made[half], held - half, n)
        yield held, made[held]


def _joined(window: np.ndarray, by: int, n: int) -> np.ndarray:
    out = window.copy()
    if by < n:
        np.maximum(out[: n - by], window[by:], out=out[: n - by])
    return out


def _chain(after: np.ndarray) -> np.ndarray:
    """The places met from 0 on, by steps from each place to the one after it. Steps of 32
    are made by doubling; the places between them are then filled in, all at once."""
    n = len(after)
    hops = [np.append(after, n)]
    for _ in range(5):
        hops.append(hops[-1].take(hops[-1], mode="clip"))
    far, at, met = hops.pop(), 0, []
    while at < n:
        met.append(at)
        at = int(far[at])
    places = np.array(met)
    for hop in reversed(hops):
        places = np.stack([places, hop.take(places, mode="clip")], axis=1).ravel()
    return places[places < n]


def encode_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escaped values of a block of ids. The last word may hold fewer ids
    than its selector says; the reader knows how many there are."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    bits = _bits(ids)
    least = int(bits.min())
    widest = dict(_widest(bits)) if least < 21 else {1: bits, 2: _joined(bits, 1, n), 3: _joined(_joined(bits, 1, n), 1, n)}
    choice = np.zeros(n, np.uint8)
    for s in range(1, 16):  # the most ids win: the first selector that fits
        held, wide = SELECTORS[s]
        if wide >= least and held in widest:
            np.maximum(choice, (widest[held] <= wide) * np.uint8(16 - s), out=choice)
    choice = np.where(choice > 0, 16 - choice, ESCAPE).astype(np.uint8)
    starts = _chain(np.minimum(np.arange(n) + _HELD.take(choice), n))
    chosen = choice[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(240, np.uint64)])
    for s in np.unique(chosen).tolist():
        held, wide = SELECTORS[s]
        if s == ESCAPE or not wide:
            continue
        here = np.flatnonzero(chosen == s)
        at, own = starts[here], words[here]
        for k in range(held):
            own |= padded[at + k] << np.uint64(k * wide)
        words[here] = own
    escaped = ids[starts[chosen == ESCAPE]]
    words[chosen == ESCAPE] |= np.arange(len(escaped), dtype=np.uint64)
    return words, escaped


def decode_block(words: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    chosen = (words >> np.uint64(60)).astype(np.intp)
    starts = np.concatenate([[0], np.cumsum(_HELD[chosen])])
    out = np.zeros(max(int(starts[-1]), n), np.uint64)
    for s in np.unique(chosen):
        held, wide = SELECTORS[s]
        here = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            out[starts[here]] = escaped[(words[here] & np.uint64((1 << 60) - 1)).astype(np.intp)]
        elif wide:
            mask = np.uint64((1 << wide) - 1)
            for k in range(held):
                out[starts[here] + k] = (words[here] >> np.uint64(k * wide)) & mask
    return out[:n]


class Writer:
    """Writes documents' ids to one file: blocks, then the tables, then a trailer."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.docs: list[np.ndarray] = []
        self.known: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.blocks: list[tuple[int, int, int, int]] = []  # place, words, escapes, ids
        self.rest = np.empty(0, np.uint64)
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, docs: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> None:
        """Documents and the number of ids of each; ``ids`` has those of all in a row."""
        self.docs.append(np.array([d or 0 for d in docs], "<i8"))
        self.known.append(np.array([d is not None for d in docs], "u1"))
        self.lengths.append(np.asarray(lengths, "<i8"))
        ids = np.concatenate([self.rest, ids.astype(np.uint64)])
        whole = len(ids) // BLOCK_IDS * BLOCK_IDS
        for lo in range(0, whole, BLOCK_IDS):
            self._block(ids[lo : lo + BLOCK_IDS])
        self.rest = ids[whole:].copy()

    def _block(self, ids: np.ndarray) -> None:
        words, escaped = encode_block(ids)
        self.blocks.append((self.at, len(words), len(escaped), len(ids)))
        self._put(words.astype("<u8").tobytes())
        self._put(escaped.astype("<u8").tobytes())

    def close(self) -> dict:
        if len(self.rest):
            self._block(self.rest)
        docs, known, lengths = (np.concatenate([np.empty(0, k), *x]) for x, k in ((self.docs, "<i8"), (self.known, "u1"), (self.lengths, "<i8")))
        tables = docs.tobytes() + known.tobytes() + lengths.tobytes() + np.array(self.blocks, "<i8").tobytes()
        head = json.dumps({"docs": len(docs), "blocks": len(self.blocks), "tables": self.at, "crc32": zlib.crc32(tables)}).encode()
        self._put(tables)
        self._put(head)
        self._put(struct.pack("<I", len(head)) + MAGIC)
        self.out.close()
        return {"n_docs": len(docs), "n_tokens": int(lengths.sum()), "n_bytes": self.at}


class Reader:
    """Reads a file of ``Writer``; ``documents`` keeps one block in memory, besides
    the document that it is in."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2) or source.tell()
        tail = self._get(size - 12, 12)
        if tail[4:] != MAGIC:
            raise ValueError("not a Simple-8b id file, or cut off")
        length = struct.unpack("<I", tail[:4])[0]
        head = json.loads(self._get(size - 12 - length, length))
        raw = self._get(head["tables"], size - 12 - length - head["tables"])
        if zlib.crc32(raw) != head["crc32"]:
            raise ValueError("the tables of a Simple-8b id file are damaged")
        n, m = head["docs"], head["blocks"]
        ids, known = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "u1", n, 8 * n)
        self.docs = [int(d) if k else None for d, k in zip(ids, known, strict=True)]
        self.lengths = np.frombuffer(raw, "<i8", n, 9 * n)
        self.blocks = np.frombuffer(raw, "<i8", 4 * m, 17 * n).reshape(m, 4)

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        at, words, escapes, n = self.blocks[k].tolist()
        raw = np.frombuffer(self._get(at, 8 * (words + escapes)), "<u8")
        return decode_block(raw[:words], raw[words:], n)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        k, held = 0, np.empty(0, np.uint64)
        for doc, n in zip(self.docs, self.lengths.tolist(), strict=True):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc, held[:n]
            held = held[n:]
