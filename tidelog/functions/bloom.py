"""The Bloom filter of run files, bit for bit, over numpy arrays of keys."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .codec import read_u64, u64

#: Fixed values of the two hashes: start, multipliers and addend.
H1_START, H1_MIX_A, H1_MIX_B, H1_ADD = 0x93686449C81A1C27, 0x87C37B91114253D5, 0x4CF5AD432745937F, 0x52DCE729
H1_END_A, H1_END_B = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
H2_START, H2_MIX, H2_END = 0x123456789ABCDEF0, 0x6C62272E07BB0142, 0x946868A074F63DBB
LEAST_BITS, MOST_HASHES, LEAST_RATE, MOST_RATE = 64, 20, 1e-10, 0.999


def sizing(keys: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions for so many keys at a false positive rate."""
    n, p = max(keys, 1), min(max(rate, LEAST_RATE), MOST_RATE)
    bits = max(LEAST_BITS, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return bits, min(max(math.floor(bits / n * math.log(2) + 0.5), 1), MOST_HASHES)


def sizing_columns(keys: Column, rate: float) -> tuple[Column, Column]:
    n = F.greatest(keys, F.lit(1))
    p = min(max(rate, LEAST_RATE), MOST_RATE)
    bits = F.greatest(F.ceil(n * F.lit(-math.log(p) / math.log(2) ** 2)), F.lit(LEAST_BITS)).cast("long")
    hashes = F.least(F.greatest(F.floor(bits / n * F.lit(math.log(2)) + 0.5), F.lit(1)), F.lit(MOST_HASHES)).cast("int")
    return bits, hashes


def expected_rate(bits: int, hashes: int, keys: int) -> float:
    return (1 - math.exp(-hashes * keys / bits)) ** hashes


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hash_pairs(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of each key. Keys of one length are hashed together, so every step
    is one numpy operation over all of them."""
    h1, h2 = np.empty(len(keys), np.uint64), np.empty(len(keys), np.uint64)
    by_length: dict[int, list[int]] = {}
    for i, k in enumerate(keys):
        by_length.setdefault(len(k), []).append(i)
    c = np.uint64
    for n, where in by_length.items():
        rows = np.frombuffer(b"".join(keys[i] for i in where), np.uint8).reshape(len(where), n)
        a = np.full(len(where), H1_START, np.uint64)
        padded = np.zeros((len(where), -(-n // 8) * 8), np.uint8)
        padded[:, :n] = rows
        for word in padded.view("<u8").T.astype(np.uint64):
            a ^= _turn(word * c(H1_MIX_A), 31) * c(H1_MIX_B)
            a = _turn(a, 27) * c(5) + c(H1_ADD)
        a ^= c(n)
        for mix in (H1_END_A, H1_END_B):
            a = (a ^ (a >> c(33))) * c(mix)
        h1[where] = a ^ (a >> c(33))
        b = np.full(len(where), H2_START, np.uint64)
        for byte in rows.T:
            b = (b ^ byte) * c(H2_MIX)
            b ^= b >> c(31)
            b += b << c(13)
        b ^= c(n)
        b = (b ^ (b >> c(28))) * c(H2_END)
        h2[where] = b ^ (b >> c(28))
    return h1, h2


class BloomFilter:
    def __init__(self, bits: int, hashes: int, data: np.ndarray | None = None):
        if bits <= 0:
            raise ValueError("a Bloom filter without bits")
        self.bits, self.hashes = bits, hashes
        self.data = np.zeros(-(-bits // 8), np.uint8) if data is None else data

    @classmethod
    def of(cls, keys: list[bytes], rate: float = 0.01) -> BloomFilter:
        out = cls(*sizing(len(keys), rate))
        out.add(keys)
        return out

    @classmethod
    def of_hashes(cls, h1: np.ndarray, h2: np.ndarray, rate: float = 0.01) -> BloomFilter:
        """The same from both hashes of each key."""
        out = cls(*sizing(len(h1), rate))
        for at in range(0, len(h1), 1 << 16):
            out._set(out._places(h1[at : at + (1 << 16)], h2[at : at + (1 << 16)]))
        return out

    def places(self, keys: list[bytes]) -> np.ndarray:
        return self._places(*hash_pairs(keys))

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return (h1[:, None] + np.arange(self.hashes, dtype=np.uint64) * h2[:, None]) % np.uint64(self.bits)

    def add(self, keys: list[bytes]) -> None:
        self._set(self.places(keys))

    def _set(self, places: np.ndarray) -> None:
        at = places.ravel()
        np.bitwise_or.at(self.data, (at >> np.uint64(3)).astype(np.intp), (1 << (at & np.uint64(7))).astype(np.uint8))

    def maybe(self, keys: list[bytes]) -> np.ndarray:
        return self.maybe_hashes(*hash_pairs(keys))

    def maybe_hashes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self._places(h1, h2)
        return ((self.data[(at >> np.uint64(3)).astype(np.intp)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)

    def encode(self) -> bytes:
        return u64(self.bits) + bytes([self.hashes]) + self.data.tobytes()

    @classmethod
    def decode(cls, raw: bytes) -> BloomFilter:
        if len(raw) < 9 or len(raw) < 9 + -(-read_u64(raw) // 8):
            raise ValueError("a Bloom filter is cut off")
        bits = read_u64(raw)
        return cls(bits, raw[8], np.frombuffer(raw, np.uint8, -(-bits // 8), 9).copy())


def build_by_run(rows, key: str = "key", run: str = "segment", rate: float = 0.01):
    """One encoded filter for each run, of all its keys, deleted ones too.

    A run's keys are hashed where they are: each task sends its filter of a run, and
    filters are joined by or-ing bytes, so no task holds a run's keys.
    """
    sized = rows.groupBy(run).agg(F.count(F.lit(1)).alias("n"))
    bits, hashes = sizing_columns(F.col("n"), rate)
    sized = sized.select(F.col(run).alias("r"), bits.alias("bits"), hashes.alias("hashes"))

    def part(batches):
        open_filters: dict = {}
        for pdf in batches:
            for (r, bits, hashes), own in pdf.groupby(["r", "bits", "hashes"], dropna=False):
                f = open_filters.setdefault(r, BloomFilter(int(bits), int(hashes)))
                f.add([bytes(k) for k in own["k"]])
        if open_filters:
            yield pd.DataFrame({"r": list(open_filters), "filter": [f.encode() for f in open_filters.values()]})

    def join(key, pdf):
        filters = [BloomFilter.decode(bytes(x)) for x in pdf["filter"]]
        for f in filters[1:]:
            filters[0].data |= f.data
        return pd.DataFrame({"r": [key[0]], "filter": [filters[0].encode()]})

    keyed = rows.select(F.col(run).alias("s"), F.col(key).alias("k")).join(sized, F.col("s") == F.col("r"))
    return (
        keyed.select("r", "k", "bits", "hashes")
        .mapInPandas(part, "r long, filter binary")
        .groupBy("r")
        .applyInPandas(join, "r long, filter binary")
        .withColumnRenamed("r", run)
    )
