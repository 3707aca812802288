"""Queries that go through the engine itself: stores that are written, flushed, compacted,
crashed and opened again, log and run files that are written and read back, and streams.

Each works in a new folder under the shared one. A store takes the events in six batches;
the first five are flushed, so the first four runs are merged into one that holds no
tombstones, the fifth is a run of its own, and the sixth stays in the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import Store
from ..sources import binary
from ..sources.changelog import events_log, ordered_key, table
from ..streaming.ingest import ingest, live_latest, live_rate, tabulate
from ..workspace import scratch
from .base import CL, SIZE, key_sql, query
from .catalogue import END, KEY, PROBES, START

BATCHES, FLUSHED, MERGED = 6, 5, 4
NEVER = 1 << 62

#: The changes with their batch, and the newest of each key among some batches.
B = CL + f", b AS (SELECT *, seq * {BATCHES} // (SELECT max(seq) + 1 FROM cl) AS batch FROM cl)"


def newest(where: str) -> str:
    return f"(SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM b WHERE {where}) WHERE rn = 1)"


def changes(spark: SparkSession, sf: str) -> DataFrame:
    log = events_log(spark, sf)
    return log.select(F.col("key").cast("binary").alias("key"), "op", F.col("value").cast("binary").alias("value"), F.col("seq").alias("order"))


def batches(spark: SparkSession, sf: str) -> list[DataFrame]:
    """The changes cut by their numbers; each cut reaches the scan."""
    rows = changes(spark, sf)
    n = (rows.agg(F.max("order").alias("n")).first().n or 0) + 1
    cuts = [-(-k * n // BATCHES) for k in range(BATCHES + 1)]
    return [rows.where((F.col("order") >= lo) & (F.col("order") < hi)) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def filled(spark: SparkSession, sf: str, kind: type[Store] = Store, last: int = BATCHES) -> Store:
    store = kind(spark, scratch(spark, "store"), flush_bytes=NEVER)
    for k, batch in enumerate(batches(spark, sf)[:last]):
        store.write(batch)
        if k < FLUSHED:
            store.flush()
    return store


def text(df: DataFrame) -> DataFrame:
    """Keys and values as text, ops as plain integers."""
    kinds = {"binary": "string", "tinyint": "int"}
    return df.select(*[F.col(c).cast(kinds.get(t, t)).alias(c) for c, t in df.dtypes])


@query(CL + "SELECT key, value FROM top WHERE op = 0")
def kv_store_scan(spark, sf):
    """What a store that is opened again holds."""
    return text(Store(spark, filled(spark, sf).path).scan())


@query(CL + f"SELECT key, value FROM top WHERE op = 0 AND key >= '{START}' AND key < '{END}'")
def kv_store_range(spark, sf):
    return text(filled(spark, sf).scan(START.encode(), END.encode()))


@query(
    B + f"SELECT p.key, CASE WHEN op = 0 THEN 'live' WHEN op <> 0 AND batch >= {MERGED} THEN 'deleted' ELSE 'absent' END AS status, CASE WHEN op = 0 THEN value END AS value "
    f"FROM (SELECT {key_sql('c_custkey')} AS key FROM customer) p LEFT JOIN {newest('true')} t ON p.key = t.key"
)
def kv_store_get_many(spark, sf):
    """Lookups through all layers. What the merge of all runs dropped is absent, what was deleted after it is deleted."""
    probes = table(spark, sf, "customer").select(ordered_key(F.col("c_custkey")).cast("binary").alias("key"))
    return text(Store(spark, filled(spark, sf).path).get_many(probes))


@query(
    CL + f"SELECT p.key, value FROM (VALUES {', '.join(f"('{p}')" for p in PROBES)}) p(key) LEFT JOIN (SELECT * FROM top WHERE op = 0) t ON p.key = t.key"
)
def kv_store_get(spark, sf):
    """Single lookups, one by one."""
    store = filled(spark, sf)
    found = [(p, store.get(p.encode())) for p in PROBES]
    return spark.createDataFrame([(p, None if v is None else v.decode()) for p, v in found], "key string, value string")


@query(
    B + f", r AS (SELECT 4::BIGINT AS id, * FROM {newest(f'batch < {MERGED}')} WHERE op = 0 UNION ALL SELECT 5, * FROM {newest(f'batch = {MERGED}')}), "
    f"s AS (SELECT id, count(*) AS n_rows, count(*) FILTER (op <> 0) AS n_tombstones, hex(min(key)) AS min_key, hex(max(key)) AS max_key, sum({SIZE} + 9)::BIGINT AS n_bytes FROM r GROUP BY id), "
    "f AS (SELECT *, greatest(64, ceil(-n_rows * ln(0.01) / (ln(2) * ln(2))))::BIGINT AS n_bits FROM s), "
    "h AS (SELECT *, least(greatest(floor(n_bits / n_rows * ln(2) + 0.5), 1), 20)::INT AS n_hashes FROM f) "
    "SELECT *, round(pow(1 - exp(-n_hashes * n_rows / n_bits), n_hashes), 9) AS expected_fpr FROM h"
)
def kv_store_runs(spark, sf):
    """The manifest's runs after flushes and a merge, with their filters' sizes."""
    return Store(spark, filled(spark, sf).path).runs().drop("dir").withColumn("expected_fpr", F.round("expected_fpr", 9))


@query(
    B + f"SELECT 1::BIGINT AS compaction_count, coalesce(sum({SIZE} + 13) FILTER (batch = {FLUSHED}), 0)::BIGINT AS wal_size_bytes, 2::BIGINT AS sstable_count, "
    "count(*) AS total_writes, 0::BIGINT AS total_reads FROM b"
)
def kv_store_metrics(spark, sf):
    return Store(spark, filled(spark, sf).path).metrics().select("compaction_count", "wal_size_bytes", "sstable_count", "total_writes", "total_reads")


@query(B + f"SELECT key, value FROM {newest('batch < 2')} WHERE op = 0")
def kv_store_past(spark, sf):
    """What a store held after its second flush: the versions are a write and a flush for each batch."""
    return text(filled(spark, sf).at(4).scan())


@query(
    CL + ", puts AS (SELECT key, arg_max(value, seq) AS value FROM cl WHERE op = 0 GROUP BY key) "
    "SELECT key, value FROM puts WHERE key NOT IN (SELECT key FROM cl WHERE op <> 0)"
)
def kv_store_delete(spark, sf):
    """All puts, then a deletion of each key that ever had an error, then a merge."""
    rows = changes(spark, sf)
    store = Store(spark, scratch(spark, "store"), flush_bytes=NEVER)
    store.put(rows.where("op = 0").drop("op"))
    store.flush()
    store.delete(rows.where("op <> 0").select("key").distinct())
    store.flush()
    store.compact()
    return text(Store(spark, store.path).scan())


class Crash(Exception):
    pass


class Crashing(Store):
    """Stops before a state is published when it is armed."""

    armed = False

    def _publish(self, new):
        if self.armed:
            raise Crash
        super()._publish(new)


@query(
    B + f"SELECT 'log' AS point, key, value FROM {newest(f'batch < {FLUSHED}')} WHERE op = 0 "
    "UNION ALL SELECT p.point, key, value FROM top, (VALUES ('flush'), ('compaction'), ('vacuum')) p(point) WHERE op = 0"
)
def kv_store_crash(spark, sf):
    """What a store holds when it is opened after a crash while its log, a run or a merged run
    was written, and after what they left is cleared away."""
    path = filled(spark, sf, last=FLUSHED).path
    last = batches(spark, sf)[FLUSHED]
    found = []

    def crash(point: str, step) -> Store:
        store = Crashing(spark, path, flush_bytes=NEVER)
        store.armed = True
        try:
            step(store)
        except Crash:
            pass
        again = Store(spark, path, flush_bytes=NEVER)
        found.append(again.scan().select(F.lit(point).alias("point"), "key", "value"))
        return again

    crash("log", lambda s: s.write(last)).write(last)
    crash("flush", lambda s: s.flush())
    again = crash("compaction", lambda s: s.compact())
    out = found[0].unionByName(found[1]).unionByName(found[2])
    kept = f"{path}/seen"
    out.write.parquet(kept)
    again.vacuum()
    cleared = Store(spark, path).scan().select(F.lit("vacuum").alias("point"), "key", "value")
    return text(spark.read.schema(out.schema).parquet(kept).unionByName(cleared))


def _records(spark: SparkSession, kind: str, path: str) -> DataFrame:
    return spark.read.format(kind).load(path)


@query(CL + "SELECT key, op::INT AS op, CASE WHEN op = 0 THEN value END AS value FROM cl")
def kv_wal_round_trip(spark, sf):
    """Log files written twice over, the second time in two appends, and replayed."""
    binary.register(spark)
    path = scratch(spark, "logs")
    rows = changes(spark, sf).select("key", "op", "value", "order")
    first, *rest = batches(spark, sf)
    for mode, part in (("append", rows), ("overwrite", first), *(("append", r) for r in rest)):
        part.sortWithinPartitions("order").write.format("kvwal").mode(mode).save(path)
    return text(_records(spark, "kvwal", path).select("key", "op", "value"))


@query(CL + f"SELECT count(*) AS n_records, sum({SIZE} + 13)::BIGINT AS n_bytes, 0::BIGINT AS torn FROM cl")
def kv_wal_report(spark, sf):
    binary.register(spark)
    path = scratch(spark, "logs")
    changes(spark, sf).write.format("kvwal").mode("append").save(path)
    report = spark.read.format("kvwal").option("report", "true").load(path)
    return report.agg(F.sum("n_records").alias("n_records"), F.sum("n_bytes").alias("n_bytes"), F.count(F.when(F.col("cut_at") < F.col("n_bytes"), 1)).alias("torn"))


def run_files(spark: SparkSession, sf: str) -> DataFrame:
    """The newest rows of all keys as run files of disjoint key ranges, read back."""
    binary.register(spark)
    path = scratch(spark, "runs")
    store = filled(spark, sf)
    rows = store.versions().select("key", "op", "value").repartitionByRange("key").sortWithinPartitions("key")
    rows.write.format("kvsst").mode("append").save(path)
    return _records(spark, "kvsst", path)


#: What a store's newest rows are: tombstones of the merged runs are gone.
VERSIONS = B + f", v AS (SELECT key, op::INT AS op, CASE WHEN op = 0 THEN value END AS value FROM {newest('true')} WHERE op = 0 OR batch >= {MERGED}) "


@query(VERSIONS + "SELECT * FROM v")
def kv_sst_round_trip(spark, sf):
    return text(run_files(spark, sf).select("key", "op", "value"))


@query(VERSIONS + f"SELECT * FROM v WHERE key IN ({', '.join(f"'{p}'" for p in PROBES)})")
def kv_sst_get(spark, sf):
    """Some keys of run files, by their filters and sparse indexes."""
    wanted = [bytearray(p.encode()) for p in PROBES]
    return text(run_files(spark, sf).where(F.col("key").isin(wanted)).select("key", "op", "value"))


@query(VERSIONS + f"SELECT * FROM v WHERE key >= '{START}' AND key < '{END}'")
def kv_sst_scan(spark, sf):
    """A range of run files, from its place in their sparse indexes on."""
    found = run_files(spark, sf).where((F.col("key") >= bytearray(START.encode())) & (F.col("key") < bytearray(END.encode())))
    return text(found.select("key", "op", "value"))


@query(
    B + f"SELECT key, op::INT AS op, CASE WHEN op = 0 THEN value END AS value FROM {newest(f'batch = {MERGED}')} WHERE key >= '{START}'"
)
def kv_store_export(spark, sf):
    """A run that a store exports, read from a key on."""
    store = filled(spark, sf)
    path = scratch(spark, "export")
    store.export(path)
    found = _records(spark, "kvsst", f"{path}/{store.manifest.runs[-1]['id']:08d}")
    return text(found.where(F.col("key") >= bytearray(START.encode())).select("key", "op", "value"))


def stream_of(spark: SparkSession, df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The rows as a stream of files, and a folder for the stream's own files."""
    path = scratch(spark, label)
    df.write.parquet(f"{path}/in")
    return spark.readStream.schema(df.schema).parquet(f"{path}/in"), path


@query(CL + "SELECT key, value FROM top WHERE op = 0")
def kv_stream_ingest(spark, sf):
    """All changes streamed into a store; sent again, they change nothing."""
    stream, path = stream_of(spark, changes(spark, sf), "ingest")
    store = Store(spark, f"{path}/store", flush_bytes=NEVER)
    for _ in range(2):
        ingest(stream, store, "events", f"{path}/checkpoint").awaitTermination()
    return text(Store(spark, store.path).scan())


@query(CL + "SELECT key, seq, op, value FROM top")
def kv_stream_latest(spark, sf):
    """The newest row of each key as a stream's state."""
    stream, path = stream_of(spark, events_log(spark, sf).select("key", "seq", "op", "value"), "latest")
    return tabulate(live_latest(stream), f"{path}/out", f"{path}/checkpoint")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n_events, count(*) / 3600.0 AS rate FROM events GROUP BY 1")
def kv_stream_rate(spark, sf):
    """Events an hour, kept up by a stream in event time."""
    stream, path = stream_of(spark, table(spark, sf, "events").select("ts"), "rate")
    out = tabulate(live_rate(stream, seconds=3600), f"{path}/out", f"{path}/checkpoint")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
