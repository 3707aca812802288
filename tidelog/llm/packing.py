"""Packing documents into windows by non-negative least squares.

A document is its ids and one end id; whole windows are cut off its front, and what
is left, shorter than a window, is to be packed with others. Lengths are rounded to
buckets of a 64th of a window. Combinations of one to four buckets that fill a window
are enumerated, all of them over the buckets there are; non-negative least squares (the
active-set method) finds how often to repeat each so that the histogram is used up. Its
solution has no more combinations than there are buckets, so counts are large enough to
round. Rounded counts are taken as far as the documents go, the shortest piece of each
window being the longest that fits. The residue is packed greedily: it first fills up
planned windows that are a little short, then windows of its own, by the longest piece
that still fits; where none does, a document is cut to fill the window. If the residue
doesn't suffice, planned windows are given back to it, the last first. The last,
unfilled window is cut into sequences whose lengths are powers of two, which need no
padding.

A task packs what it reads in shards of at most ``SHARD_TOKENS`` ids (a longer
document is a shard of its own), so nothing is shuffled or collected, memory is
bounded, and any number of tasks pack alike. Sequence ids hold the task's number in
their upper half. ``planned`` says whether a piece was put where it is by the plan.

Cases: a null text is an empty one (the end id alone); null and repeated ``doc_id``
are kept row by row; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .wordids import slices, with_end, word_ids

WINDOW, END_ID = 4096, 2
SHARD_TOKENS = 6_000_000
#: Ids in a batch that a task hands on.
BATCH_TOKENS = 500_000
#: Buckets in a window, lengths in a combination, and how many buckets lower an item may be
#: than the plan says.
BUCKETS, DEPTH, NEAR = 64, 4, 1


def combinations(histogram: np.ndarray, whole: int) -> np.ndarray:
    """Rows of ``DEPTH`` ascending numbers of buckets there are, zero where there are
    fewer, whose sum is ``whole``; none asks for a bucket more often than it is there."""
    present = np.flatnonzero(histogram)
    # Ascending rows whose sum leaves room for at least their last number again.
    found, rows = [], np.zeros((1, 0), np.int64)
    for depth in range(1, DEPTH + 1):
        rest = whole - rows.sum(1)
        least = rows[:, -1] if depth > 1 else np.zeros(len(rows), np.int64)
        ends = (rest >= least) & (rest < len(histogram)) & (histogram[np.clip(rest, 0, len(histogram) - 1)] > 0)
        full = np.column_stack([rows[ends], rest[ends]])
        found.append(np.pad(full, ((0, 0), (DEPTH - depth, 0))))
        # On to one more: each number from the row's last on that leaves room for another.
        i, j = np.nonzero((present >= least[:, None]) & (2 * present <= rest[:, None]))
        rows = np.column_stack([rows[i], present[j]])
    found = np.concatenate(found)
    for k in range(DEPTH):
        found = found[(found[:, k] == 0) | ((found == found[:, [k]]).sum(1) <= histogram[found[:, k]])]
    return found


def repeats(histogram: np.ndarray, combos: np.ndarray) -> np.ndarray:
    """Counts of at least 0 for which the squares of (use of each bucket - histogram) sum
    to the least, by the active-set method: the combination that lowers the error most
    comes in, a solution over those that are in is found, and where it has counts below 0,
    combinations go out on the way to it."""
    h = histogram.astype(float)
    h[0] = 0
    x, inside = np.zeros(len(combos)), np.zeros(len(combos), bool)
    rest = h.copy()  # of the histogram, what isn't used
    for _ in range(4 * len(h)):
        gain = rest[combos].sum(1)
        gain[inside] = -1
        best = int(gain.argmax())
        if gain[best] <= 1e-9 * max(1.0, h.max()):
            break
        inside[best] = True
        while True:
            chosen = np.flatnonzero(inside)
            uses = np.zeros((len(h), len(chosen)))
            np.add.at(uses, (combos[chosen], np.arange(len(chosen))[:, None]), 1.0)
            uses[0] = 0
            own = np.linalg.lstsq(uses, h, rcond=None)[0]
            low = own <= 1e-12
            if not low.any():
                break
            old = x[chosen]
            part = (old[low] / np.maximum(old[low] - own[low], 1e-300)).min()
            x[chosen] = old + part * (own - old)
            x[chosen[low & (x[chosen] <= 1e-12)]] = 0
            inside[chosen] = x[chosen] > 0
            if not inside.any():
                return x
        x[:] = 0
        x[chosen] = own
        rest = h - uses @ own
        rest[0] = 0
    return x


class Pool:
    """Items by their lengths."""

    def __init__(self, lengths: np.ndarray):
        self.items: dict[int, list[int]] = {}
        for i, v in enumerate(lengths.tolist()):
            self.items.setdefault(v, []).append(i)
        self.order = sorted(self.items)

    def take(self, least: int, most: int) -> tuple[int, int] | None:
        """(length, item) of the longest within the bounds."""
        k = bisect_right(self.order, most) - 1
        if k < 0 or self.order[k] < least:
            return None
        v = self.order[k]
        item = self.items[v].pop()
        if not self.items[v]:
            del self.order[k]
        return v, item

    def back(self, taken: list[tuple[int, int]]) -> None:
        for v, item in taken:
            if not self.items[v]:
                insort(self.order, v)
            self.items[v].append(item)


def plan(lengths: np.ndarray, window: int) -> tuple[list[list[int]], list[int]]:
    """Items of each planned window, and the items left over."""
    step = max(1, window // BUCKETS)
    low = step // 2
    histogram = np.bincount(np.maximum(1, (lengths + low) // step), minlength=-(-window // step) + 1)
    pool, windows = Pool(lengths), []
    combos = combinations(histogram, window // step)
    times = np.floor(repeats(histogram, combos) + 0.5).astype(int) if len(combos) else np.empty(0, int)
    for k in np.argsort(-times, kind="stable").tolist():
        *large, _ = [v for v in combos[k].tolist()[::-1] if v]
        for _ in range(int(times[k])):
            taken, room = [], window
            for v in large:
                found = pool.take(max(1, v * step - low - NEAR * step), min(room - 1, v * step - low + step - 1))
                if found is None:
                    break
                taken.append(found)
                room -= found[0]
            else:
                # The last one is the longest that fits, which may be a bucket or two off.
                found = pool.take(max(1, room - 2 * step + 1), room)
                if found is not None:
                    windows.append([i for _, i in [*taken, found]])
                    continue
            pool.back(taken)
            break
    return windows, [i for held in pool.items.values() for i in held]


def pack_lengths(lengths: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int, bool]]:
    """Pieces (item, start, length, sequence, offset, planned) of items shorter than a window."""
    windows, rest = plan(lengths, window)
    size = lengths.tolist()
    left = sorted((size[i], i, 0) for i in rest)  # (length, item, start), ascending
    out, sequence = [], 0
    while windows or left:
        at, row = 0, []
        if windows:
            for i in windows.pop(0):
                row.append((i, 0, size[i], at, True))
                at += size[i]
        while at < window and (left or windows):
            if not left:  # the last planned window goes back to the residue
                left = sorted((size[i], i, 0) for i in windows.pop())
            k = bisect_right(left, (window - at, len(size), 0)) - 1
            if k >= 0:
                v, i, start = left.pop(k)
            else:
                v, i, start = left.pop(0)  # the shortest of those too long is cut
                room = window - at
                insort(left, (v - room, i, start + room))
                v = room
            row.append((i, start, v, at, False))
            at += v
        if at == window:
            out += [(i, start, v, sequence, o, planned) for i, start, v, o, planned in row]
            sequence += 1
            continue
        for bit in reversed(range(window.bit_length())):  # the last window: powers of two
            room = at & (1 << bit)
            o = 0
            while o < room:
                i, start, v, _, planned = row.pop(0)
                take = min(v, room - o)
                out.append((i, start, take, sequence, o, planned))
                o += take
                if take < v:
                    row.insert(0, (i, start + take, v - take, 0, planned))
            sequence += room > 0
    return out


class _Shard:
    def __init__(self, base: int, window: int):
        self.base, self.window, self.sequence = base, window, 0
        self.clear()

    def clear(self) -> None:
        self.docs: list[int | None] = []
        self.counts: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.tokens = 0

    def add(self, docs: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs += docs
        self.counts.append(counts)
        self.ids.append(ids)
        self.tokens += len(ids)

    def pack(self, with_ids: bool) -> Iterator[pa.RecordBatch]:
        w = self.window
        n, ids = np.concatenate(self.counts), np.concatenate(self.ids)
        begins = np.cumsum(n) - n
        whole = n // w
        # Pieces as rows of item, start, length, sequence, offset, planned: first the whole windows.
        item = np.repeat(np.arange(len(n)), whole)
        start = (np.arange(len(item)) - np.repeat(np.cumsum(whole) - whole, whole)) * w
        pieces = np.column_stack([item, start, np.full(len(item), w), np.arange(len(item)), np.zeros((len(item), 2), np.int64)])
        tails = np.flatnonzero(n % w)
        rest = np.array(pack_lengths((n % w)[tails], w), np.int64).reshape(-1, 6)
        rest[:, 0] = tails[rest[:, 0]]
        rest[:, 1] += whole[rest[:, 0]] * w
        rest[:, 3] += len(item)
        pieces = np.concatenate([pieces, rest])
        pieces[:, 3] += self.base + self.sequence
        self.sequence = int(pieces[-1, 3]) + 1 - self.base if len(pieces) else self.sequence
        cuts = np.searchsorted(np.cumsum(pieces[:, 2]), np.arange(BATCH_TOKENS, pieces[:, 2].sum(), BATCH_TOKENS))
        for part in np.split(pieces, cuts):
            if len(part):
                yield self._batch(part, n, begins, ids, with_ids)
        self.clear()

    def _batch(self, pieces: np.ndarray, n: np.ndarray, begins: np.ndarray, ids: np.ndarray, with_ids: bool) -> pa.RecordBatch:
        i, start, length, sequence, offset, planned = pieces.T
        at = begins[i] + start
        raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
        cut = [raw[4 * a : 4 * b] for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
        columns = {
            "doc_id": pa.array([self.docs[k] for k in i.tolist()], pa.int64()),
            "start": pa.array(start),
            "length": pa.array(length),
            "ids_crc32": pa.array([zlib.crc32(c) for c in cut], pa.int64()),
            "doc_tokens": pa.array(n[i]),
            "sequence_id": pa.array(sequence),
            "offset": pa.array(offset),
            "planned": pa.array(planned > 0),
        }
        if with_ids:
            columns["ids"] = pa.ListArray.from_arrays(
                np.concatenate([[0], np.cumsum(length)]).astype(np.int32), pa.array(np.frombuffer(b"".join(cut), "<u4").astype(np.int64))
            )
        return pa.RecordBatch.from_pydict(columns)


def pack(docs: DataFrame, vocabulary: str, end_id: int = END_ID, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, planned, and its ids if asked for."""

    def run(batches):
        shard, encoder = _Shard(TaskContext.get().partitionId() << 32, window), word_ids(vocabulary)
        for batch in batches:
            docs = batch["doc_id"].to_pylist()
            for first, texts in slices(batch["text"]):
                ids, counts = with_end(*encoder.encode(texts), end_id)
                ends = np.cumsum(counts)
                lo = at = 0
                while lo < len(counts):
                    hi = int(np.searchsorted(ends, at + SHARD_TOKENS - shard.tokens, "right"))
                    if hi == lo and not shard.tokens:
                        hi += 1
                    end = int(ends[hi - 1]) if hi else 0
                    shard.add(docs[first + lo : first + hi], counts[lo:hi], ids[at:end])
                    lo, at = hi, end
                    if lo < len(counts):
                        yield from shard.pack(with_ids)
        if shard.tokens:
            yield from shard.pack(with_ids)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, planned boolean"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, schema + ", ids array<long>" * with_ids)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
