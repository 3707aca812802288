"""The engine's queries over the given tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bloom, codec
from ..operators import introspect, metrics, resolve
from ..sources.changelog import conversations_log, events_log, key_of, ordered_key, orders_log, table
from ..streaming.ingest import live_latest, live_rate
from .base import CL, SIZE, key_sql, query
from .filter_sql import FILTERS

START, END, KEY = key_of(3), key_of(41), key_of(7)
PROBES = (KEY, key_of(1), key_of(2), key_of(8), key_of(99999999999), "")
PREFIX = key_of(10)[:-1]
AS_OF = 5000
SMALL_BUFFER = 100
BAD_EVERY = 997  # the planted bad record of the replay query: the first seq of this remainder and an error

@query(CL + f"SELECT key, value FROM top WHERE key = '{KEY}' AND op = 0")
def kv_get(spark, sf):
    return resolve.get(events_log(spark, sf), KEY).select("key", "value")


@query(
    CL + "SELECT p.key, CASE WHEN op IS NULL THEN 'absent' WHEN op <> 0 THEN 'deleted' ELSE 'live' END AS status, CASE WHEN op = 0 THEN value END AS value "
    f"FROM (VALUES {', '.join(f"('{p}')" for p in PROBES)}) p(key) LEFT JOIN top ON p.key = top.key"
)
def kv_get_many(spark, sf):
    return resolve.get_many(events_log(spark, sf), spark.createDataFrame([(p,) for p in PROBES], "key string"))


@query(
    "WITH l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) "
    f"SELECT {key_sql('c_custkey')} AS key, CASE WHEN o_custkey IS NULL THEN 'absent' WHEN o_orderstatus = 'F' THEN 'deleted' ELSE 'live' END AS status, "
    "CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS value FROM customer LEFT JOIN l ON c_custkey = o_custkey AND rn = 1"
)
def kv_get_many_orders(spark, sf):
    """Every customer's latest order, as a batch lookup."""
    probes = table(spark, sf, "customer").select(ordered_key(F.col("c_custkey")).alias("key"))
    return resolve.get_many(orders_log(spark, sf), probes)


@query(CL + f"SELECT key, value FROM top WHERE key >= '{START}' AND key < '{END}' AND op = 0")
def kv_scan(spark, sf):
    return resolve.scan(events_log(spark, sf), START, END).select("key", "value")


@query(CL + "SELECT key, value FROM top WHERE op = 0")
def kv_scan_all(spark, sf):
    return resolve.scan(events_log(spark, sf)).select("key", "value")


@query(CL + "SELECT key, value FROM top WHERE false")
def kv_scan_inverted(spark, sf):
    return resolve.scan(events_log(spark, sf), END, START).select("key", "value")


@query(CL + f"SELECT key, value FROM top WHERE op = 0 AND starts_with(key, '{PREFIX}')")
def kv_scan_prefix(spark, sf):
    log = events_log(spark, sf).withColumn("key", F.col("key").cast("binary"))
    return resolve.scan_prefix(log, PREFIX.encode()).select(F.col("key").cast("string").alias("key"), "value")


@query(CL + "SELECT key, value FROM top WHERE op = 0 ORDER BY key LIMIT 10")
def kv_scan_topk(spark, sf):
    return resolve.scan_top(events_log(spark, sf), 10).select("key", "value")


@query(CL + "SELECT key, value FROM top WHERE op = 0 ORDER BY key DESC LIMIT 10")
def kv_scan_reverse(spark, sf):
    return resolve.scan_top(events_log(spark, sf), 10, last=True).select("key", "value")


@query(CL + "SELECT key, seq, op, value FROM top")
def kv_versions(spark, sf):
    return resolve.latest(events_log(spark, sf)).select("key", "seq", "op", "value")


@query(CL + "SELECT key, seq AS valid_from, lead(seq) OVER (PARTITION BY key ORDER BY segment, seq) AS valid_to, op FROM cl")
def kv_history(spark, sf):
    return resolve.history(events_log(spark, sf)).select("key", "valid_from", "valid_to", "op")


@query(
    CL + f"SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM cl WHERE seq <= {AS_OF}) WHERE rn = 1 AND op = 0"
)
def kv_as_of(spark, sf):
    return resolve.as_of(events_log(spark, sf), AS_OF).select("key", "value")


@query(
    f"SELECT {key_sql('conv_id')} AS key, text AS value FROM "
    "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1"
)
def kv_last_turn(spark, sf):
    return resolve.live(conversations_log(spark, sf)).select("key", "value")


@query(
    CL + ", m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY segment DESC, seq DESC) AS rn FROM flat WHERE segment <= 3) "
    "SELECT 3::BIGINT AS segment, key, seq, op, value FROM m WHERE rn = 1 UNION ALL SELECT segment, key, seq, op, value FROM flat WHERE segment > 3"
)
def kv_compact_oldest4(spark, sf):
    return resolve.compact(introspect.flat(events_log(spark, sf)), [0, 1, 2, 3]).select("segment", "key", "seq", "op", "value")


@query(CL + "SELECT key, seq, value FROM top WHERE op = 0")
def kv_compact_full(spark, sf):
    return resolve.compact(introspect.flat(events_log(spark, sf))).select("key", "seq", "value")


@query(CL + "SELECT segment, key, seq, op, value FROM flat")
def kv_flush(spark, sf):
    """The runs that flushing every thousand changes leaves."""
    return introspect.flat(events_log(spark, sf)).select("segment", "key", "seq", "op", "value")


@query(CL + "SELECT key, max(segment) AS hit_segment, count(*) AS copies FROM flat GROUP BY key")
def kv_layer_of_hit(spark, sf):
    return introspect.layer_of_hit(events_log(spark, sf))


@query(CL + "SELECT key, (SELECT max(segment) FROM cl) - max(segment) + 1 AS probed FROM flat GROUP BY key")
def kv_read_amp(spark, sf):
    return introspect.read_amplification(events_log(spark, sf))


@query(
    CL + "SELECT segment, count(*) AS n_rows, count(*) FILTER (op <> 0) AS n_tombstones, min(key) AS min_key, max(key) AS max_key, "
    f"sum({SIZE} + 9)::BIGINT AS n_bytes FROM flat GROUP BY segment"
)
def kv_segment_stats(spark, sf):
    return introspect.segment_stats(events_log(spark, sf))


@query(
    CL + f", r AS (SELECT segment, key, row_number() OVER w AS n, (sum({SIZE} + 9) OVER w - ({SIZE} + 9))::BIGINT AS place FROM flat WINDOW w AS (PARTITION BY segment ORDER BY key)) "
    "SELECT segment, key, place FROM r WHERE (n - 1) % 16 = 0"
)
def kv_sparse_index(spark, sf):
    return introspect.sparse_index(events_log(spark, sf))


@query(
    CL + f", r AS (SELECT segment, key, row_number() OVER w AS n, (sum({SIZE} + 9) OVER w - ({SIZE} + 9))::BIGINT AS place FROM flat WINDOW w AS (PARTITION BY segment ORDER BY key)) "
    f"SELECT segment, coalesce(max(place) FILTER (key <= '{KEY}'), 0) AS place FROM r WHERE (n - 1) % 16 = 0 GROUP BY segment"
)
def kv_index_floor(spark, sf):
    return introspect.floor_in_index(introspect.sparse_index(events_log(spark, sf)), KEY)


@query(
    CL + ", n AS (SELECT segment, count(*) AS n_keys FROM flat GROUP BY segment), "
    "b AS (SELECT *, greatest(64, ceil(-n_keys * ln(0.01) / (ln(2) * ln(2))))::BIGINT AS n_bits FROM n), "
    "k AS (SELECT *, least(greatest(floor(n_bits / n_keys * ln(2) + 0.5), 1), 20)::INT AS n_hashes FROM b) "
    "SELECT segment, n_keys, n_bits, n_hashes, round(pow(1 - exp(-n_hashes * n_keys / n_bits), n_hashes), 9) AS expected_fpr FROM k"
)
def kv_bloom_params(spark, sf):
    return introspect.bloom_parameters(events_log(spark, sf)).withColumn("expected_fpr", F.round("expected_fpr", 9))


@query(CL + f"SELECT seq, sum({SIZE} + 13) OVER (ORDER BY seq)::BIGINT AS end_offset FROM cl")
def kv_wal_offsets(spark, sf):
    return introspect.log_offsets(events_log(spark, sf))


@query(CL + f"SELECT sum({SIZE} + 13)::BIGINT AS n_bytes FROM cl")
def kv_wal_size(spark, sf):
    return events_log(spark, sf).agg(F.sum(introspect.payload(codec.LOG_HEAD)).alias("n_bytes"))


@query(CL + f"SELECT count(*) AS n_entries, sum({SIZE})::BIGINT AS n_bytes FROM top")
def kv_memtable_bytes(spark, sf):
    return introspect.memtable_bytes(events_log(spark, sf))


@query(
    CL + f", bad AS (SELECT coalesce(min(seq), 9223372036854775807) AS b FROM cl WHERE seq % {BAD_EVERY} = {BAD_EVERY - 1} AND op = 1) "
    "SELECT count(*) AS n_records, max(seq) AS last_seq FROM cl WHERE seq < (SELECT b FROM bad)"
)
def kv_torn_replay(spark, sf):
    bad = (F.col("seq") % BAD_EVERY == BAD_EVERY - 1) & (F.col("op") == 1)
    return introspect.valid_prefix(events_log(spark, sf), ~bad).agg(F.count(F.lit(1)).alias("n_records"), F.max("seq").alias("last_seq"))


@query("SELECT event_id, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_window FROM events")
def kv_rate(spark, sf):
    return metrics.sliding_rate(table(spark, sf, "events"), 3600).select("event_id", "in_window")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n_events, count(*) / 3600.0 AS rate FROM events GROUP BY 1")
def kv_live_rate(spark, sf):
    out = live_rate(table(spark, sf, "events"), seconds=3600)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(CL + "SELECT key, seq, op, value FROM top")
def kv_live_latest(spark, sf):
    return live_latest(events_log(spark, sf))


@query(CL + "SELECT count(*) AS total_writes, count(*) FILTER (op = 0) AS puts, count(*) FILTER (op <> 0) AS deletes FROM cl")
def kv_totals(spark, sf):
    return metrics.totals(events_log(spark, sf))


#: Polls of a store: one a day, whose counters are derived from the day's events.
POLLS = """
WITH RECURSIVE d AS (
  SELECT date_diff('day', DATE '2024-01-01', ts::DATE) AS poll, count(*) AS n, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1
), p AS (
  SELECT poll, n AS day_writes, sum(n) OVER (ORDER BY poll)::BIGINT AS total_writes, (sum(n) OVER (ORDER BY poll) // 400)::BIGINT AS compaction_count,
         ((sum(n) OVER (ORDER BY poll) // 100) % 4 + 1)::BIGINT AS sstable_count, (e % 3)::BIGINT AS recovery_time_ms
  FROM d
)
"""


def polls(spark, sf):
    days = (
        table(spark, sf, "events")
        .groupBy(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("poll"))
        .agg(F.count(F.lit(1)).alias("day_writes"), F.count(F.when(F.col("event_type") == "error", 1)).alias("e"))
    )
    total = F.sum("day_writes").over(Window.orderBy("poll"))  # a row for each poll
    days = days.withColumn("total_writes", total)
    return days.select(
        "poll", "day_writes", "total_writes", F.floor(F.col("total_writes") / 400).alias("compaction_count"),
        (F.floor(F.col("total_writes") / 100) % 4 + 1).alias("sstable_count"), (F.col("e") % 3).alias("recovery_time_ms"),
    )


@query(POLLS + "SELECT poll, greatest(0, total_writes - lag(total_writes, 1, 0) OVER (ORDER BY poll))::BIGINT AS delta FROM p")
def kv_counter_deltas(spark, sf):
    return metrics.deltas(polls(spark, sf), "total_writes").select("poll", "delta")


@query(
    POLLS + ", o AS (SELECT *, row_number() OVER (ORDER BY poll) AS i FROM p), f AS ("
    "SELECT i, floor(0.25 * day_writes + 0.5) AS s FROM o WHERE i = 1 UNION ALL "
    "SELECT o.i, floor(0.75 * s + 0.25 * day_writes + 0.5) FROM f JOIN o ON o.i = f.i + 1) SELECT arg_max(s, i)::DOUBLE AS ema FROM f"
)
def kv_ema(spark, sf):
    return metrics.ema(polls(spark, sf), "day_writes")


EVENTS = (
    POLLS + ", w AS (SELECT *, lag(compaction_count, 1, 0) OVER (ORDER BY poll) AS c, lag(sstable_count, 1, 0) OVER (ORDER BY poll) AS r, "
    "coalesce(max((recovery_time_ms > 0)::INT) OVER (ORDER BY poll ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM p) "
    ", e AS (SELECT poll, 'compaction' AS event FROM w WHERE compaction_count > c UNION ALL "
    "SELECT poll, 'flush' FROM w WHERE sstable_count > r AND sstable_count > 1 UNION ALL "
    "SELECT poll, 'recovery' FROM w WHERE recovery_time_ms > 0 AND seen = 0) "
)


@query(EVENTS + "SELECT * FROM e")
def kv_metric_events(spark, sf):
    return metrics.metric_events(polls(spark, sf))


@query(EVENTS + "SELECT * FROM e ORDER BY poll DESC, event DESC LIMIT 6")
def kv_recent_events(spark, sf):
    return metrics.recent_events(metrics.metric_events(polls(spark, sf)))


@query(POLLS + "SELECT poll, total_writes FROM p ORDER BY poll DESC LIMIT 20")
def kv_rolling_series(spark, sf):
    return metrics.rolling_series(polls(spark, sf), 20).select("poll", "total_writes")


@query(
    CL + "SELECT printf('{\"writes_per_sec\":%.2f,\"reads_per_sec\":%.2f,\"compaction_count\":%d,\"wal_size_bytes\":%d,\"sstable_count\":%d,\"recovery_time_ms\":%d,\"total_writes\":%d,\"total_reads\":%d}', "
    f"count(*) / 3600.0, 0.0, 0, sum({SIZE} + 13)::BIGINT, count(DISTINCT segment), 0, count(*), 0) AS json FROM cl"
)
def kv_snapshot_json(spark, sf):
    zero = F.lit(0)
    row = events_log(spark, sf).agg(
        (F.count(F.lit(1)) / 3600.0).alias("writes_per_sec"), F.sum(introspect.payload(codec.LOG_HEAD)).alias("wal_size_bytes"),
        F.countDistinct("segment").alias("sstable_count"), F.count(F.lit(1)).alias("total_writes"),
    )
    return metrics.snapshot_json(row.select("*", zero.alias("reads_per_sec"), zero.alias("compaction_count"), zero.alias("recovery_time_ms"), zero.alias("total_reads")))


@query(
    f"WITH RECURSIVE c AS (SELECT {key_sql('user_id')} AS store, event_id AS seq, {key_sql('user_id')} || event_type AS key, "
    "(20 + strlen(event_type) + CASE WHEN event_type <> 'error' THEN strlen(props) ELSE 0 END)::BIGINT AS size FROM events), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY seq) AS i FROM c), "
    "f AS (SELECT store, i, seq, CASE WHEN size >= 2000 THEN MAP {} ELSE MAP {key: size} END AS held, "
    "CASE WHEN size >= 2000 THEN 0 ELSE size END AS used, 0::BIGINT AS epoch, CASE WHEN size >= 2000 THEN 1 ELSE 0 END::BIGINT AS next FROM o WHERE i = 1 UNION ALL "
    "SELECT o.store, o.i, o.seq, CASE WHEN used + size - coalesce(held[key], 0) >= 2000 THEN MAP {} ELSE map_concat(held, MAP {key: size}) END, "
    "CASE WHEN used + size - coalesce(held[key], 0) >= 2000 THEN 0 ELSE used + size - coalesce(held[key], 0) END, next, "
    "next + CASE WHEN used + size - coalesce(held[key], 0) >= 2000 THEN 1 ELSE 0 END FROM f JOIN o ON o.store = f.store AND o.i = f.i + 1) "
    "SELECT store, seq, epoch FROM f".replace("2000", str(SMALL_BUFFER))
)
def kv_flush_epochs(spark, sf):
    """A store for each user, whose keys are their event types, with a small buffer."""
    log = events_log(spark, sf).withColumn("store", F.col("key")).withColumn("key", F.concat("key", "event_type"))
    return introspect.flush_epochs(log, SMALL_BUFFER)


@query(
    CL + f", r AS (SELECT sum({SIZE} + 9)::BIGINT AS run_bytes FROM flat) SELECT sum({SIZE})::BIGINT AS user_bytes, sum({SIZE} + 13)::BIGINT AS log_bytes, "
    f"any_value(run_bytes) AS run_bytes, round((sum({SIZE} + 13) + any_value(run_bytes)) / sum({SIZE}), 9) AS amplification FROM cl, r"
)
def kv_write_amp(spark, sf):
    return introspect.write_amplification(events_log(spark, sf)).withColumn("amplification", F.round("amplification", 9))


@query(CL + ", keys AS (SELECT segment, key FROM flat)," + FILTERS)
def kv_bloom_build(spark, sf):
    """Each run's filter, bit for bit."""
    flat = introspect.flat(events_log(spark, sf)).withColumn("key", F.col("key").cast("binary"))
    return bloom.build_by_run(flat).select("segment", F.length("filter").cast("long").alias("n_bytes"), F.sha2("filter", 256).alias("filter_sha256"))


@query(
    CL + "SELECT segment, printf('sst_%08d.sst', segment + 1) AS name, CASE WHEN sum(strlen(value)) < 1024 THEN printf('%d B', sum(strlen(value))::BIGINT) "
    "ELSE printf('%.1f KB', sum(strlen(value)) / 1024.0) END AS size FROM flat GROUP BY segment"
)
def kv_run_names(spark, sf):
    size = F.sum(F.octet_length("value"))
    return introspect.flat(events_log(spark, sf)).groupBy("segment").agg(size.alias("b")).select(
        "segment", F.format_string("sst_%08d.sst", F.col("segment") + 1).alias("name"), metrics.format_bytes(F.col("b")).alias("size")
    )
