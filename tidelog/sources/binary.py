"""Python data sources ``kvwal`` and ``kvsst``: log and run files of the byte layouts.

``register(spark)``, then ``spark.read.format("kvwal").load(path)``. A path is a file or
a folder of files; each file is a partition, for a log has to be read from its
beginning. A log is read up to its first bad record and never changed;
``option("report", "true")`` gives a row for each file instead, with where and why its
reading stopped. Files are read piece by piece, and rows go on in Arrow batches.

A run is asked before it is read: predicates on ``key`` reach the reader, which leaves
out files whose filter says that none of the wanted keys is there, begins at the sparse
index's place for the least key, and stops after the greatest.

Writers make one file of each partition that has rows. Appending goes on after the
highest number there is; overwriting puts the new files in place, then removes the old.
"""

from __future__ import annotations

import io
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from ..functions import codec
from ..functions.bloom import BloomFilter, hash_pairs
from .folder import Folder

RECORDS = "file string, seq long, place long, op byte, key binary, value binary"
REPORT = "file string, n_records long, cut_at long, n_bytes long, reason string"
ARROW = pa.schema([("file", pa.string()), ("seq", pa.int64()), ("place", pa.int64()), ("op", pa.int8()), ("key", pa.binary()), ("value", pa.binary())])
#: Bytes read at once, and rows and bytes of a batch that goes on.
CHUNK, BATCH_ROWS, BATCH_BYTES = 1 << 20, 8192, 4 << 20
#: Keys hashed at once by a writer.
HASHED = 4096


class _Window:
    """Bytes of a file from a place on, as they are asked for."""

    def __init__(self, source, at: int, end: int):
        self.source, self.at, self.end = source, at, end
        self.raw, self.base = b"", at

    def get(self, n: int) -> bytes:
        """Up to ``n`` bytes from here, fewer at the end; the place doesn't move."""
        lo = self.at - self.base
        if len(self.raw) - lo < n and self.base + len(self.raw) < self.end:
            self.source.seek(self.base + len(self.raw))
            more = self.source.read(min(max(CHUNK, n), self.end - self.base - len(self.raw)))
            self.raw, self.base, lo = self.raw[lo:] + more, self.at, 0
        return self.raw[lo : lo + n]


def _log_records(source, size: int) -> Iterator[tuple[int, codec.LogRecord | str]]:
    """(place, record) of the valid prefix; then (place, reason) if the log goes on."""
    window = _Window(source, 0, size)
    while window.at < size:
        head = window.get(codec.LOG_HEAD)
        raw = window.get(codec.log_record_size(head)) if len(head) == codec.LOG_HEAD else head
        r = codec.read_log_record(raw)
        yield window.at, r
        if isinstance(r, str):
            return
        window.at += r.size


def parse_log(raw: bytes):
    """Records of the longest valid prefix, then (place, reason or None)."""
    out, at = [], 0
    for place, r in _log_records(io.BytesIO(raw), len(raw)):
        if isinstance(r, str):
            return out, place, r
        out.append((place, r))
        at = place + r.size
    return out, at, None


class RunFile:
    """A run file: its sparse index and filter are in memory, its records are read as asked for."""

    def __init__(self, source, size: int):
        self.source = source
        if size < codec.FOOTER:
            raise ValueError(f"a run file of {size} bytes")
        footer = self._get(size - codec.FOOTER, codec.FOOTER)
        index_at, self.data_end = codec.read_u64(footer), codec.read_u64(footer, 8)
        if not self.data_end <= index_at <= size - codec.FOOTER:
            raise ValueError("a run file's footer is damaged")
        self.bloom = BloomFilter.decode(self._get(self.data_end, index_at - self.data_end)) if index_at > self.data_end else None
        raw, at, self.index = self._get(index_at, size - codec.FOOTER - index_at), 0, []
        while at + 4 <= len(raw):
            n = codec.read_u32(raw, at)
            if at + 12 + n > len(raw):
                break
            self.index.append((raw[at + 4 : at + 4 + n], codec.read_u64(raw, at + 4 + n)))
            at += 12 + n

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def floor(self, key: bytes) -> int:
        """Where a search for the key begins: the place of the last indexed key up to it."""
        k = bisect_right(self.index, key, key=lambda e: e[0])
        return self.index[k - 1][1] if k else 0

    def records(self, at: int = 0) -> Iterator[tuple[int, bytes, bytes | None, int]]:
        """(place, key, value, op) from a record's place on."""
        window = _Window(self.source, at, self.data_end)
        while len(head := window.get(codec.RUN_HEAD)) == codec.RUN_HEAD:
            raw = window.get(codec.run_record_size(head))
            key, value, op, size = codec.read_run_record(raw, 0, len(raw))
            yield window.at, key, value, op
            window.at += size

    def get(self, keys: list[bytes], hashes: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[int, bytes, bytes | None, int]]:
        """The records of some keys, ascending. Keys that the filter rules out cost no reading;
        the others are met on one way through, which jumps by the index."""
        if self.bloom is not None and keys:
            maybe = self.bloom.maybe_hashes(*(hashes or hash_pairs(keys)))
            keys = [k for k, m in zip(keys, maybe.tolist(), strict=True) if m]
        records, r, at = iter(()), None, -1
        for key in keys:
            if (place := self.floor(key)) > at:
                records = self.records(place)
                r = next(records, None)
            while r is not None and r[1] < key:
                r = next(records, None)
            at = self.data_end if r is None else r[0]
            if r is not None and r[1] == key:
                yield r


def get_through(runs: list[RunFile], keys: list[bytes]) -> dict[bytes, bytes | None]:
    """The newest value of each key that is in any run, null where it is deleted. Runs come
    newest first; a key that one has isn't looked for in those below."""
    found: dict[bytes, bytes | None] = {}
    left = sorted(set(keys))
    h1, h2 = hash_pairs(left)
    for run in runs:
        here = {key: value for _, key, value, _ in run.get(left, (h1, h2))}
        found |= here
        stay = np.array([k not in here for k in left], bool)
        left, h1, h2 = [k for k in left if k not in here], h1[stay], h2[stay]
    return found


def parse_run(raw: bytes) -> tuple[list[tuple], list[tuple[bytes, int]], BloomFilter | None]:
    """Records, sparse index and filter of a run file, whose footer is checked."""
    run = RunFile(io.BytesIO(raw), len(raw))
    return list(run.records()), run.index, run.bloom


def write_run(out, rows, rate: float = 0.01, stride: int = codec.SPARSE_STRIDE) -> int:
    """Writes a run file of rows in ascending key order; returns how many. Of the keys that
    went by, only hashes and every ``stride``-th one are kept."""
    index, hashes, waiting = bytearray(), [], []
    at, n, last = 0, 0, None
    for key, value, op in rows:
        if last is not None and key <= last:
            raise ValueError("a run's keys must ascend")
        if n % stride == 0:
            index += codec.index_entry(key, at)
        record = codec.run_record(key, value, op)
        out.write(record)
        waiting.append(key)
        if len(waiting) == HASHED:
            hashes.append(hash_pairs(waiting))
            waiting = []
        at, n, last = at + len(record), n + 1, key
    hashes.append(hash_pairs(waiting))
    bloom = BloomFilter.of_hashes(*(np.concatenate(h) for h in zip(*hashes, strict=True)), rate).encode()
    out.write(bloom)
    out.write(index)
    out.write(codec.u64(at + len(bloom)) + codec.u64(at))
    return n


def build_run(rows: list[tuple[bytes, bytes | None, int]], rate: float = 0.01, stride: int = codec.SPARSE_STRIDE) -> bytes:
    out = io.BytesIO()
    write_run(out, rows, rate, stride)
    return out.getvalue()


def write_log(out, rows) -> int:
    n = 0
    for row in rows:
        out.write(codec.log_record(*row))
        n += 1
    return n


@dataclass
class _File(InputPartition):
    folder: str
    name: str


def _size(source) -> int:
    source.seek(0, 2)
    return source.tell()


class _Reader(DataSourceReader):
    def __init__(self, options, ending: str):
        self.path, self.ending = options["path"], ending

    def partitions(self):
        folder = Folder(self.path)
        if folder.is_file():
            return [_File(self.path, "")]
        return [_File(self.path, n) for n in folder.names(self.ending)]

    def _batches(self, file: str, rows) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for i, (place, key, value, op) in enumerate(rows):
            out.append((file, i, place, op, key, value))
            size += len(key) + len(value or b"")
            if len(out) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield self._batch(out)
                out, size = [], 0
        if out:
            yield self._batch(out)

    def _batch(self, out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ARROW, strict=True)], schema=ARROW)


class _WalReader(_Reader):
    def __init__(self, options, ending: str):
        super().__init__(options, ending)
        self.report = _asks_report(options)

    def read(self, partition):
        folder = Folder(partition.folder)
        with folder.read(partition.name) as source:
            size, file = _size(source), folder.at(partition.name)
            if not self.report:
                yield from self._batches(file, ((at, r.key, r.value, r.op) for at, r in _log_records(source, size) if not isinstance(r, str)))
                return
            n, cut, reason = 0, 0, None
            for place, r in _log_records(source, size):
                if isinstance(r, str):
                    cut, reason = place, r
                else:
                    n, cut = n + 1, place + r.size
            yield file, n, cut, size, reason


class _RunReader(_Reader):
    """``low`` and ``high`` bound the keys, both included; ``keys``, if any, are the only ones wanted."""

    def __init__(self, options, ending: str):
        super().__init__(options, ending)
        self.low: bytes | None = None
        self.high: bytes | None = None
        self.keys: list[bytes] | None = None

    def pushFilters(self, filters):
        for f in filters:
            values = f.value if isinstance(f, In) else [getattr(f, "value", None)]
            if getattr(f, "attribute", None) == ("key",) and all(isinstance(v, bytes | bytearray) for v in values):
                values = [bytes(v) for v in values]
                if isinstance(f, EqualTo | EqualNullSafe | In):
                    self.keys = sorted(set(values) if self.keys is None else set(values) & set(self.keys))
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.low = max(values[0], self.low or b"")
                elif isinstance(f, LessThan | LessThanOrEqual):
                    self.high = values[0] if self.high is None else min(values[0], self.high)
            yield f  # Spark still tests each row; what was learned here only leaves rows out

    def read(self, partition):
        folder = Folder(partition.folder)
        with folder.read(partition.name) as source:
            run = RunFile(source, _size(source))
            yield from self._batches(folder.at(partition.name), self._wanted(run))

    def _wanted(self, run: RunFile):
        if self.keys is not None:
            yield from run.get(self.keys)
            return
        if self.high is not None and run.index and run.index[0][0] > self.high:
            return
        for r in run.records(run.floor(self.low) if self.low is not None else 0):
            if self.high is not None and r[1] > self.high:
                return
            if self.low is None or r[1] >= self.low:
                yield r


@dataclass
class _Written(WriterCommitMessage):
    part: int
    name: str | None


class _Writer(DataSourceWriter):
    """Files are written under temporary names and renamed when all tasks are done."""

    def __init__(self, options, overwrite: bool, ending: str, named, build):
        self.path, self.overwrite, self.ending, self.named, self.build = options["path"], overwrite, ending, named, build

    def write(self, iterator):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rows = ((bytes(r["key"]), None if r["op"] else bytes(r["value"] or b""), int(r["op"] != 0)) for r in iterator)
        first = next(rows, None)
        if first is None:
            return _Written(part, None)
        folder, name = Folder(self.path), f".{part}-{uuid.uuid4().hex}"
        out = folder.write(name)
        try:
            self.build(out, _with_first(first, rows))
        except BaseException:
            out.close()
            folder.remove(name)
            raise
        folder.close(out)
        return _Written(part, name)

    def commit(self, messages):
        folder = Folder(self.path)
        old = folder.names(self.ending)
        number = max((int(m[1]) for n in old if (m := re.search(r"_(\d+)\.", n))), default=0)
        made = sorted((m for m in messages if m and m.name), key=lambda m: m.part)
        for i, m in enumerate(made, number + 1):
            folder.rename(m.name, self.named(i))
        if self.overwrite:
            for name in old:
                folder.remove(name)

    def abort(self, messages):
        folder = Folder(self.path)
        for m in messages:
            if m and m.name:
                folder.remove(m.name)


def _with_first(first, rest):
    yield first
    yield from rest


def _asks_report(options) -> bool:
    return str(options.get("report", "false")).lower() == "true"


class WalSource(DataSource):
    @classmethod
    def name(cls):
        return "kvwal"

    def schema(self):
        return REPORT if _asks_report(self.options) else RECORDS

    def reader(self, schema):
        return _WalReader(self.options, ".log")

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite, ".log", codec.log_name, write_log)


class RunSource(DataSource):
    @classmethod
    def name(cls):
        return "kvsst"

    def schema(self):
        return RECORDS

    def reader(self, schema):
        return _RunReader(self.options, ".sst")

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite, ".sst", codec.run_name, write_run)


def register(spark) -> None:
    # Sources that take filters don't load without it.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WalSource)
    spark.dataSource.register(RunSource)
