"""A store of versioned keys: a log, sorted runs and a manifest.

Changes are appended as Parquet batches (the log), flushed to immutable runs sorted by
key, and runs are merged by compaction. What the store holds is what its newest
manifest names: a manifest is written under a temporary name and published by one
rename, so a crash at any point leaves the state before or after, never between. Data
that no manifest names is removed by ``vacuum`` only. One writer at a time.

A change's version is its batch's number and its order in the batch; it is unique.
Durability is by batch, not by record.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bloom import expected_rate, sizing
from . import resolve
from .introspect import memtable_bytes, payload

#: Fixed values of the engine: runs that start a compaction, and how many it merges.
COMPACT_AT, MERGE_AT_MOST = 4, 4
FLUSH_BYTES = 4 << 20
ORDER_BITS = 40
LOG_SEGMENT = (1 << 63) - 1
RUN = "id long, dir string, n_rows long, n_tombstones long, min_key string, max_key string, n_bytes long, n_bits long, n_hashes int, expected_fpr double"
#: False positives that a run's filter is sized for, and the seconds that rates look back.
FILTER_RATE, RATE_SECONDS = 0.01, 1.0
ROWS = "segment long, seq long, op byte, key binary, value binary"
TARGET_BYTES = 256 << 20


class StoreError(Exception):
    """What the engine raises."""


class Corruption(StoreError):
    """The store names data that isn't there, or that can't be read."""


@dataclass
class Manifest:
    version: int = 0
    log: list[dict] = field(default_factory=list)  # dir, n_bytes
    runs: list[dict] = field(default_factory=list)  # oldest first: the columns of ``RUN``
    next_batch: int = 1
    next_run: int = 1
    compactions: int = 0
    writes: int = 0
    sources: dict[str, int] = field(default_factory=dict)  # last batch taken from a stream


class Rate:
    """How many in a second, over the last ``seconds``."""

    def __init__(self, seconds: float = RATE_SECONDS, now: Callable[[], float] = time.monotonic):
        self.seconds, self.now, self.seen = seconds, now, deque()

    def add(self, n: int) -> None:
        self.seen.append((self.now(), n))
        self._forget()

    def _forget(self) -> None:
        while self.seen and self.now() - self.seen[0][0] > self.seconds:
            self.seen.popleft()

    def value(self) -> float:
        self._forget()
        return sum(n for _, n in self.seen) / self.seconds


class Store:
    """``flush_bytes`` is the size of the buffer at which a write flushes: the keys and values
    of the newest rows of the log, so overwriting a key doesn't fill it."""

    def __init__(self, spark: SparkSession, path: str, flush_bytes: int = FLUSH_BYTES, version: int | None = None):
        self.spark, self.path, self.flush_bytes, self.version = spark, path.rstrip("/"), flush_bytes, version
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.reads = self.scans = 0  # since the store was opened
        self.write_rate, self.read_rate = Rate(), Rate()
        began = time.monotonic()
        self.manifest = self._load(version)
        for part in [*self.manifest.log, *self.manifest.runs]:
            if not self._fs.exists(self._at(part["dir"])):
                raise Corruption(f"{part['dir']} is missing")
        self.recovery_ms = int((time.monotonic() - began) * 1000)

    # Files

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _versions(self) -> list[int]:
        folder = self._at("manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _load(self, version: int | None) -> Manifest:
        versions = self._versions()
        if version is None and not versions:
            return Manifest()
        chosen = versions[-1] if version is None else version
        if chosen not in versions:
            raise StoreError(f"the store has no version {chosen}")
        stream = self._fs.open(self._at(f"manifests/{chosen:012d}.json"))
        try:
            return Manifest(**json.loads(bytes(stream.readAllBytes())))
        except (ValueError, TypeError) as e:
            raise Corruption(f"manifest {chosen}: {e}") from e
        finally:
            stream.close()

    def _publish(self, new: Manifest) -> None:
        if self.version is not None:
            raise StoreError("a past version can't be written")
        new.version = self.manifest.version + 1
        temporary = self._at(f"manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, False)
        stream.write(json.dumps(vars(new)).encode())
        stream.close()
        target = self._at(f"manifests/{new.version:012d}.json")
        if self._fs.exists(target) or not self._fs.rename(temporary, target):
            raise StoreError(f"version {new.version} is there already: is there another writer?")
        self.manifest = new

    def _next(self) -> Manifest:
        return Manifest(**json.loads(json.dumps(vars(self.manifest))))

    # Reading

    def rows(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        """All versions that the layers hold, of runs whose keys may be in the range."""
        runs = [
            r for r in self.manifest.runs
            if not (end is not None and bytes.fromhex(r["min_key"]) >= end) and not (start is not None and bytes.fromhex(r["max_key"]) < start)
        ]
        paths = [f"{self.path}/{x['dir']}" for x in [*runs, *self.manifest.log]]
        found = self.spark.read.schema(ROWS).parquet(*paths) if paths else self.spark.createDataFrame([], ROWS)
        return found.where(resolve.in_range(start, end)) if start is not None or end is not None else found

    def get(self, key: bytes) -> bytes | None:
        self._read(1)
        row = resolve.get(self.rows(key, key + b"\0"), key).select("value").first()
        return None if row is None else bytes(row.value or b"")

    def _read(self, n: int) -> None:
        self.reads += n
        self.read_rate.add(n)

    def get_many(self, probes: DataFrame) -> DataFrame:
        """Counts as one read: how many keys there are isn't known before they are read."""
        self._read(1)
        return resolve.get_many(self.rows(), probes)

    def scan(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        self.scans += 1
        return resolve.scan(self.rows(start, end), start, end).select("key", "value")

    def versions(self) -> DataFrame:
        return resolve.latest(self.rows())

    def view(self, name: str) -> None:
        """The live rows as a view for SQL."""
        resolve.live(self.rows()).select("key", "value").createOrReplaceTempView(name)

    def at(self, version: int) -> Store:
        """The store as a manifest that is still kept says."""
        return Store(self.spark, self.path, self.flush_bytes, version)

    # Writing

    def write(self, changes: DataFrame, source: str | None = None, source_batch: int | None = None) -> bool:
        """Appends ``changes(key, op, value[, order])``. ``order`` tells several changes to
        one key in the batch apart. A batch that a source has sent before changes nothing."""
        if source is not None and self.manifest.sources.get(source, -1) >= source_batch:
            return False
        new = self._next()
        rows = changes.select(
            F.lit(LOG_SEGMENT).alias("segment"),
            (F.lit(new.next_batch << ORDER_BITS) + (F.col("order").cast("long") if "order" in changes.columns else F.lit(0))).alias("seq"),
            (F.col("op") != 0).cast("byte").alias("op"),
            F.col("key").cast("binary").alias("key"),
            F.when(F.col("op") == 0, F.coalesce(F.col("value").cast("binary"), F.lit(b""))).alias("value"),
        )
        name = f"log/{new.next_batch:012d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.path}/{name}")
        written = self.spark.read.schema(ROWS).parquet(f"{self.path}/{name}")
        n = written.agg(
            F.count(F.lit(1)).alias("n"), F.count("key").alias("keys"), F.coalesce(F.sum(payload(13)), F.lit(0)).alias("size"),
            F.coalesce(F.sum(payload()), F.lit(0)).alias("held"),
            F.coalesce(F.max(F.col("seq") - (new.next_batch << ORDER_BITS)), F.lit(0)).alias("top"), F.coalesce(F.min(F.col("seq") - (new.next_batch << ORDER_BITS)), F.lit(0)).alias("low"),
        ).first()
        if n.keys != n.n:
            raise StoreError("a change without a key")
        if n.top >= 1 << ORDER_BITS or n.low < 0:
            raise StoreError("an order out of range")
        if not resolve.unique_versions(written):
            raise StoreError("two changes to one key with the same order")
        new.log.append({"dir": name, "n_bytes": n["size"], "held": n.held})
        new.next_batch += 1
        new.writes += n.n
        if source is not None:
            new.sources[source] = source_batch
        self._publish(new)
        self.write_rate.add(n.n)
        # A buffer is no larger than what was written to it; only then its own size is counted.
        if sum(x["held"] for x in new.log) >= self.flush_bytes and self.buffer_bytes() >= self.flush_bytes:
            self.flush()
        return True

    def _log_rows(self) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(*[f"{self.path}/{x['dir']}" for x in self.manifest.log])

    def buffer_bytes(self) -> int:
        """Bytes of the newest row of each key in the log: what the next run is made of."""
        return memtable_bytes(self._log_rows()).first().n_bytes if self.manifest.log else 0

    def put(self, rows: DataFrame) -> bool:
        return self.write(rows.withColumn("op", F.lit(0)))

    def delete(self, keys: DataFrame) -> bool:
        """Writes tombstones, whether the keys were there or not."""
        return self.write(keys.withColumn("op", F.lit(1)).withColumn("value", F.lit(None).cast("binary")))

    def _write_run(self, rows: DataFrame, number: int) -> dict | None:
        """A run sorted by key, in files of disjoint ranges, with Bloom filters on keys."""
        name = f"runs/{number:012d}-{uuid.uuid4().hex[:8]}"
        (
            rows.withColumn("segment", F.lit(number).cast("long")).select("segment", "seq", "op", "key", "value")
            .repartitionByRange("key").sortWithinPartitions("key")
            .write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", "0.01")
            .parquet(f"{self.path}/{name}")
        )
        s = (
            self.spark.read.schema(ROWS).parquet(f"{self.path}/{name}")
            .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("op") != 0, 1)).alias("dead"), F.hex(F.min("key")).alias("low"), F.hex(F.max("key")).alias("high"), F.sum(payload(9)).alias("size"))
            .first()
        )
        if not s.n:
            return None
        bits, hashes = sizing(s.n, FILTER_RATE)
        return {
            "id": number, "dir": name, "n_rows": s.n, "n_tombstones": s.dead, "min_key": s.low, "max_key": s.high, "n_bytes": s["size"],
            "n_bits": bits, "n_hashes": hashes, "expected_fpr": expected_rate(bits, hashes, s.n),
        }

    def flush(self, compact: bool = True) -> bool:
        """The log's newest rows become a run. Nothing happens without a log."""
        if not self.manifest.log:
            return False
        new = self._next()
        run = self._write_run(resolve.latest(self._log_rows()), new.next_run)
        if run:
            new.runs.append(run)
            new.next_run += 1
        new.log = []
        self._publish(new)
        if compact and len(new.runs) >= COMPACT_AT:
            self.compact(oldest=MERGE_AT_MOST)
        return True

    def compact(self, oldest: int | None = None) -> bool:
        """Merges the oldest runs, or all. Tombstones are kept unless all runs are merged;
        the result keeps its place in the order, whatever its number."""
        runs = self.manifest.runs if oldest is None else self.manifest.runs[:oldest]
        if len(runs) < 2:
            return False
        new = self._next()
        whole = len(runs) == len(new.runs)
        rows = self.spark.read.schema(ROWS).parquet(*[f"{self.path}/{r['dir']}" for r in runs])
        merged = resolve.live(rows) if whole else resolve.latest(rows)
        run = self._write_run(merged, max(r["id"] for r in runs))
        new.runs = ([run] if run else []) + new.runs[len(runs) :]
        new.compactions += 1
        self._publish(new)
        return True

    def vacuum(self, keep_versions: int = 1) -> list[str]:
        """Removes manifests but the newest ones, and data that those don't name."""
        versions = self._versions()
        for v in versions[:-keep_versions]:
            self._fs.delete(self._at(f"manifests/{v:012d}.json"), False)
        named = {x["dir"] for v in versions[-keep_versions:] for m in [self._load(v)] for x in [*m.log, *m.runs]}
        gone = []
        for kind in ("log", "runs"):
            if self._fs.exists(self._at(kind)):
                for s in self._fs.listStatus(self._at(kind)):
                    name = f"{kind}/{s.getPath().getName()}"
                    if name not in named:
                        self._fs.delete(self._at(name), True)
                        gone.append(name)
        return gone

    # Looking at it

    def log_bytes(self) -> int:
        return sum(x["n_bytes"] for x in self.manifest.log)

    def runs(self) -> DataFrame:
        """The runs, oldest first, with the size, hashes and expected rate of the filter that
        ``export`` gives each of them."""
        names = [c.split()[0] for c in RUN.split(", ")]
        return self.spark.createDataFrame([tuple(r[c] for c in names) for r in self.manifest.runs], RUN)

    def export(self, path: str) -> None:
        """The runs as run files of the byte layout, a folder for each run."""
        from ..sources import binary

        binary.register(self.spark)
        for r in self.manifest.runs:
            rows = self.spark.read.schema(ROWS).parquet(f"{self.path}/{r['dir']}").select("key", "op", "value")
            files = max(1, -(-r["n_bytes"] // TARGET_BYTES))
            rows.repartitionByRange(files, "key").sortWithinPartitions("key").write.format("kvsst").mode("append").save(f"{path}/{r['id']:08d}")

    def snapshot(self) -> dict[str, float]:
        """The counters and the rates of the last second, without a Spark job."""
        m = self.manifest
        return {
            "writes_per_sec": self.write_rate.value(), "reads_per_sec": self.read_rate.value(), "compaction_count": m.compactions, "wal_size_bytes": self.log_bytes(),
            "sstable_count": len(m.runs), "recovery_time_ms": self.recovery_ms, "total_writes": m.writes, "total_reads": self.reads,
        }

    def snapshot_json(self) -> str:
        """The text that ``metrics.snapshot_json`` makes of such a row."""
        return "{" + ",".join(f'"{k}":{v:.2f}' if k.endswith("_per_sec") else f'"{k}":{v}' for k, v in self.snapshot().items()) + "}"

    def metrics(self, writes_per_sec: float | None = None, reads_per_sec: float | None = None) -> DataFrame:
        """One row; ``metrics.snapshot_json`` makes its text. Rates are those of the last second,
        unless others are given."""
        given = {"writes_per_sec": writes_per_sec, "reads_per_sec": reads_per_sec}
        row = self.snapshot() | {k: v for k, v in given.items() if v is not None} | {"total_scans": self.scans}
        kinds = ", ".join(f"{k} {'double' if k.endswith('_per_sec') else 'long'}" for k in row)
        return self.spark.createDataFrame([tuple(row.values())], kinds)


def changes_of(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Changes from (key, value) or (key, None) for a delete, in their order."""
    return spark.createDataFrame(
        [(bytearray(k), 0 if v is not None else 1, None if v is None else bytearray(v), i) for i, (k, v) in enumerate(rows)],
        "key binary, op int, value binary, order long",
    )
