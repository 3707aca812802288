import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import metrics, resolve
from tidelog.operators.store import Corruption, Store, StoreError, changes_of
from tidelog.sources import binary


def pairs(df):
    return [(bytes(r.key), bytes(r.value)) for r in df.collect()]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def write(store, *rows):
    return store.write(changes_of(store.spark, rows))


def test_overwrite_delete_and_empty_value(store):
    write(store, (b"a", b"1"), (b"a", b"2"), (b"a", None), (b"a", b"3"), (b"e", b""), (b"z", None))
    assert store.get(b"a") == b"3" and store.get(b"e") == b"" and store.get(b"z") is None and store.get(b"q") is None
    assert {bytes(r.key): r.op for r in store.versions().collect()} == {b"a": 0, b"e": 0, b"z": 1}
    probes = store.spark.createDataFrame([(bytearray(k),) for k in (b"a", b"z", b"q")], "key binary")
    assert {bytes(r.key): r.status for r in store.get_many(probes).collect()} == {b"a": "live", b"z": "deleted", b"q": "absent"}


def test_layers(store):
    write(store, (b"a", b"1"))
    store.flush()
    write(store, (b"a", None))
    store.flush()
    write(store, (b"b", b"2"))
    assert pairs(store.scan()) == [(b"b", b"2")]
    store.compact()
    again = Store(store.spark, store.path)
    assert pairs(again.scan()) == [(b"b", b"2")] and again.get(b"a") is None


def test_byte_order_and_ranges(store):
    keys = [b"", b"a", b"a\0", b"\x7f", b"\x80", b"\xff" * 7, b"\xff" * 8]
    write(store, *[(k, b"v") for k in reversed(keys)])
    assert [k for k, _ in pairs(store.scan())] == keys
    store.flush()
    store.compact()
    assert store.get(b"\xff" * 8) == b"v"
    assert [k for k, _ in pairs(store.scan(b"a", b"\x80"))] == keys[1:4]
    assert pairs(store.scan(b"b", b"b")) == [] and pairs(store.scan(b"b", b"a")) == []
    assert [bytes(r.key) for r in resolve.scan_prefix(store.rows(), b"\xff").collect()] == keys[5:]


def test_partial_compaction_keeps_newer_values_on_top(store):
    for i in range(5):
        write(store, (b"k", str(i).encode()), (b"gone", None if i == 1 else b"x") if i < 2 else (b"n%d" % i, b"y"))
        store.flush(compact=False)
    store.compact(oldest=4)
    for s in (store, Store(store.spark, store.path)):
        assert s.get(b"k") == b"4" and s.get(b"gone") is None
    run = store.runs().orderBy("id").collect()
    assert len(run) == 2 and run[0].n_tombstones == 1
    store.compact()
    assert store.runs().first().n_tombstones == 0


def test_four_runs_start_a_compaction(store):
    for i in range(4):
        write(store, (b"k%d" % i, b"v"))
        store.flush()
    assert len(store.manifest.runs) == 1 and store.manifest.compactions == 1
    assert not store.flush() and not store.compact()


def test_only_tombstones_leave_no_run(store):
    write(store, (b"a", b"1"))
    store.flush()
    write(store, (b"a", None))
    store.flush()
    store.compact()
    assert store.manifest.runs == [] and store.manifest.compactions == 1 and pairs(store.scan()) == []


def test_ties_and_missing_keys_are_refused(store):
    bad = store.spark.createDataFrame([(bytearray(b"a"), 0, None, 1)] * 2, "key binary, op int, value binary, order long")
    with pytest.raises(StoreError):
        store.write(bad)
    with pytest.raises(StoreError):
        store.write(bad.withColumn("key", F.lit(None).cast("binary")))
    assert store.manifest.version == 0


@pytest.mark.parametrize("step", ["flush", "compact"])
@pytest.mark.parametrize("when", ["before", "after"])
def test_crashes(store, monkeypatch, step, when):
    """A crash before the manifest's rename leaves the old state, one after it the new;
    both read the same, and what is left over goes with the next vacuum."""
    write(store, (b"a", b"1"), (b"b", b"1"))
    store.flush()
    write(store, (b"a", None), (b"c", b"2"))
    if step == "compact":
        store.flush()
    publish = Store._publish

    def crash(self, new):
        if when == "after":
            publish(self, new)
        raise KeyboardInterrupt

    monkeypatch.setattr(Store, "_publish", crash)
    with pytest.raises(KeyboardInterrupt):
        getattr(store, step)()
    monkeypatch.undo()
    again = Store(store.spark, store.path)
    assert pairs(again.scan()) == [(b"b", b"1"), (b"c", b"2")]
    assert again.vacuum()
    assert pairs(Store(store.spark, store.path).scan()) == [(b"b", b"1"), (b"c", b"2")]


def test_missing_data_is_an_error(store):
    write(store, (b"a", b"1"))
    store.flush()
    store._fs.delete(store._at(store.manifest.runs[0]["dir"]), True)
    with pytest.raises(Corruption):
        Store(store.spark, store.path)


def test_past_versions(store):
    write(store, (b"a", b"1"))
    first = store.manifest.version
    write(store, (b"a", b"2"))
    assert store.at(first).get(b"a") == b"1" and store.get(b"a") == b"2"
    with pytest.raises(StoreError):
        write(store.at(first), (b"a", b"3"))


def test_model(spark, tmp_path):
    """Random changes, flushes, compactions and reopenings against a dictionary."""
    rng, model = random.Random(5), {}
    store = Store(spark, str(tmp_path / "model"), flush_bytes=400)
    for _ in range(12):
        rows = [(b"k%02d" % rng.randrange(20), None if rng.random() < 0.3 else b"v%d" % rng.randrange(99)) for _ in range(rng.randrange(1, 9))]
        write(store, *rows)
        for k, v in rows:
            model[k] = v
        action = rng.randrange(4)
        if action == 0:
            store.flush()
        elif action == 1:
            store.compact(oldest=rng.choice([2, 3, None]))
        elif action == 2:
            store = Store(spark, store.path, flush_bytes=400)
    live = sorted((k, v) for k, v in model.items() if v is not None)
    assert pairs(store.scan()) == live
    for lo, hi in ((b"k03", b"k11"), (b"k05", b"k05"), (b"", b"zz")):
        assert pairs(store.scan(lo, hi)) == [x for x in live if lo <= x[0] < hi]
    assert store.get(live[0][0]) == live[0][1]


def test_metrics_row(store):
    write(store, (b"a", b"1"))
    store.get(b"a")
    store.scan().count()
    text = metrics.snapshot_json(store.metrics(1.5, 0.0)).first().json
    assert text == (
        '{"writes_per_sec":1.50,"reads_per_sec":0.00,"compaction_count":0,"wal_size_bytes":15,"sstable_count":0,'
        f'"recovery_time_ms":{store.recovery_ms},"total_writes":1,"total_reads":1}}'
    )
    assert metrics.parse_snapshot(text)["total_writes"] == 1


def test_metrics_over_http(store):
    import json
    import urllib.error
    import urllib.request

    from tidelog.operators.endpoint import serve_metrics

    write(store, (b"a", b"1"))
    server = serve_metrics(store)
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/metrics") as r:
            assert r.headers["Access-Control-Allow-Origin"] == "*" and r.headers["Content-Type"] == "application/json"
            got = json.loads(r.read())
        assert got["total_writes"] == 1 and list(got) == ["writes_per_sec", "reads_per_sec", *metrics.COUNTERS]
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/other")
    finally:
        server.shutdown()
        server.server_close()
    row = store.metrics(0.0, 0.0)
    store.write_rate.seen.clear()
    assert metrics.snapshot_json(row).first().json == store.snapshot_json()


def test_sql_view(store):
    write(store, (b"a", b"1"), (b"b", None))
    store.view("kv")
    assert store.spark.sql("select count(*) n from kv").first().n == 1


def test_binary_sources(spark, tmp_path):
    binary.register(spark)
    rows = spark.createDataFrame([(bytearray(b"k%03d" % i), i % 5 == 0, bytearray(b"v%d" % i)) for i in range(50)], "key binary, dead boolean, value binary")
    rows = rows.selectExpr("key", "cast(dead as byte) as op", "if(dead, null, value) as value").coalesce(1).sortWithinPartitions("key")
    for kind, ending in (("kvwal", "log"), ("kvsst", "sst")):
        rows.write.format(kind).mode("append").save(str(tmp_path / kind))
        back = spark.read.format(kind).load(str(tmp_path / kind))
        assert sorted(map(tuple, back.select("key", "op", "value").collect())) == sorted(map(tuple, rows.collect()))
        assert len(list((tmp_path / kind).glob(f"*.{ending}"))) == 1
    log = next((tmp_path / "kvwal").glob("*.log"))
    raw = log.read_bytes()
    log.write_bytes(raw[:-3])
    report = spark.read.format("kvwal").option("report", "true").load(str(log)).first()
    assert (report.n_records, report.reason) == (49, "short_body")
    assert spark.read.format("kvwal").load(str(log)).count() == 49


def run_rows(spark, n=2000):
    rows = spark.range(n).selectExpr("cast(format_string('k%06d', id) as binary) as key", "cast(id % 7 = 0 as int) as op", "if(id % 7 = 0, null, cast(concat('v', id) as binary)) as value")
    return rows.coalesce(1).sortWithinPartitions("key")


@pytest.mark.parametrize("kind, ending", [("kvwal", "log"), ("kvsst", "sst")])
def test_appending_and_overwriting(spark, tmp_path, kind, ending):
    binary.register(spark)
    path = str(tmp_path / "out")
    one = lambda k: spark.createDataFrame([(bytearray(k), 0, bytearray(b"v"))], "key binary, op int, value binary").coalesce(1)
    held = lambda: sorted(bytes(r.key) for r in spark.read.format(kind).load(path).collect())
    for k in (b"a", b"b"):
        one(k).write.format(kind).mode("append").save(path)
    assert held() == [b"a", b"b"] and len(list((tmp_path / "out").glob(f"*_0000000[12].{ending}"))) == 2
    one(b"c").write.format(kind).mode("overwrite").save(path)
    assert held() == [b"c"] and [p.name[-5 - len(ending) :] for p in (tmp_path / "out").glob(f"*.{ending}")] == [f"0003.{ending}"]
    one(b"d").write.format(kind).mode("append").save(path)
    assert held() == [b"c", b"d"]
    if kind == "kvsst":
        with pytest.raises(Exception, match="ascend"):
            one(b"x").union(one(b"e")).coalesce(1).write.format(kind).mode("append").save(path)
        assert held() == [b"c", b"d"] and not list((tmp_path / "out").glob(".*-*"))


def test_key_predicates_reach_run_files(spark, tmp_path):
    binary.register(spark)
    path = str(tmp_path / "runs")
    run_rows(spark).write.format("kvsst").mode("append").save(path)
    table = spark.read.format("kvsst").load(path)
    keys = lambda df: sorted(bytes(r.key).decode() for r in df.collect())
    assert keys(table.where(F.col("key") == bytearray(b"k000777"))) == ["k000777"]
    assert keys(table.where(F.col("key").isin(bytearray(b"k000001"), bytearray(b"zz"), bytearray(b"k001999")))) == ["k000001", "k001999"]
    between = table.where((F.col("key") > bytearray(b"k000100")) & (F.col("key") <= bytearray(b"k000103")))
    assert keys(between) == ["k000101", "k000102", "k000103"]
    assert table.where(F.col("key") < bytearray(b"k")).count() == 0 and table.where("key is null").count() == 0
    assert table.where(F.col("key") >= bytearray(b"k001990")).where("op = 0").count() == 9
    run_file = next((tmp_path / "runs").glob("*.sst"))
    with open(run_file, "rb") as f:
        run = binary.RunFile(f, run_file.stat().st_size)
        seen = []
        run.records, whole = (lambda at=0: (seen.append(r) or r for r in whole(at))), run.records
        assert [r[1] for r in run.get([b"k000777"])] == [b"k000777"] and len(seen) <= 16
        seen.clear()
        absent = [b"absent%d" % i for i in range(500)]
        assert not list(run.get(absent)) and len(seen) < 500  # nearly all are ruled out by the filter
        reader = binary._RunReader({"path": path}, ".sst")
        reader.low, reader.high = b"k000500", b"k000509"
        seen.clear()
        assert len(list(reader._wanted(run))) == 10 and len(seen) <= 27


def test_records_longer_than_what_is_read_at_once(monkeypatch):
    monkeypatch.setattr(binary, "CHUNK", 50)
    from tidelog.functions.codec import log_record

    rows = [(b"k%03d" % i, b"v" * (i * 7 % 300), 0) for i in range(60)]
    records, index, _ = binary.parse_run(binary.build_run(rows))
    assert [r[1:] for r in records] == rows and len(index) == 4
    assert [r.value for _, r in binary.parse_log(b"".join(log_record(*r) for r in rows))[0]] == [r[1] for r in rows]


def test_overwriting_a_key_does_not_fill_the_buffer(spark, tmp_path):
    store = Store(spark, str(tmp_path / "small"), flush_bytes=60)
    for i in range(8):
        write(store, (b"same", b"12345"))
    assert store.manifest.runs == [] and store.buffer_bytes() == 9 and store.log_bytes() == 8 * 22
    write(store, *[(b"k%d" % i, b"123456789") for i in range(5)])
    assert len(store.manifest.runs) == 1 and store.manifest.log == [] and store.buffer_bytes() == 0


def test_rates_and_filters_of_a_store(store):
    from tidelog.functions.bloom import BloomFilter
    from tidelog.operators.store import Rate

    now = [0.0]
    rate = Rate(1.0, lambda: now[0])
    rate.add(3)
    now[0] = 1.0
    rate.add(2)
    assert rate.value() == 5  # the boundary is within
    now[0] = 1.5
    assert rate.value() == 2
    now[0] = 3.0
    assert rate.value() == 0
    store.write_rate = Rate(1e9)
    write(store, *[(b"k%02d" % i, b"v") for i in range(50)])
    assert store.metrics().first().writes_per_sec == 50 / 1e9
    store.flush()
    run = store.runs().first()
    f = BloomFilter.of([b"k%02d" % i for i in range(50)])
    assert (run.n_bits, run.n_hashes) == (f.bits, f.hashes) and 0.005 < run.expected_fpr < 0.02
    store.export(f"{store.path}/out")
    binary.register(store.spark)
    back = store.spark.read.format("kvsst").load(f"{store.path}/out/00000001")
    assert back.count() == 50 and back.where(F.col("key") == bytearray(b"k07")).count() == 1


def test_number_keys_are_lossless_and_in_order(spark):
    from tidelog.sources.changelog import key_of, ordered_key

    numbers = [-(1 << 63), -12345678902, -5, -1, 0, 7, 41, 12345678901, 12345678902, (1 << 63) - 1]
    rows = spark.createDataFrame([(n,) for n in reversed(numbers)], "n long").select("n", ordered_key(F.col("n")).alias("key"))
    assert [r.n for r in rows.orderBy("key").collect()] == numbers
    assert all(r.key == key_of(r.n) and len(r.key) == 20 for r in rows.collect())


def test_folds_go_on_across_batches(spark):
    """One group over many Arrow batches, others between; against the same fold in Python."""
    from tidelog.operators.introspect import flush_epochs

    rows = spark.range(5000).selectExpr("id as seq", "if(id % 4 = 0, 'b', 'a') as store", "concat('k', pmod(id * 7919, 37)) as key", "0 as op", "repeat('x', int(id % 23)) as value")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {(r.store, r.seq): r.epoch for r in flush_epochs(rows, 300).collect()}
        last = metrics.ema(rows.selectExpr("seq as poll", "store", "length(value) as raw"), "raw", by="store").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, state, average = {}, {}, {}
    for r in rows.orderBy("seq").collect():
        held, epoch = state.setdefault(r.store, [{}, 0])
        held[r.key] = len(r.key) + len(r.value)
        want[(r.store, r.seq)] = epoch
        if sum(held.values()) >= 300:
            state[r.store] = [{}, epoch + 1]
        average[r.store] = int(average.get(r.store, 0) * 0.75 + len(r.value) * 0.25 + 0.5)
    assert got == want and {r.store: r.ema for r in last} == average


def test_stream_ingest(spark, tmp_path):
    from tidelog.streaming.ingest import ingest

    store = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(bytearray(b"a"), 0, bytearray(b"1"), 0), (bytearray(b"b"), 1, None, 1)], "key binary, op int, value binary, order long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest(stream, store, "feed", str(tmp_path / "checkpoint")).awaitTermination()
    assert pairs(Store(spark, store.path).scan()) == [(b"a", b"1")]
    version = store.manifest.version
    assert not store.write(rows, "feed", 0) and store.manifest.version == version


def test_log_size_of_the_write_benchmark(spark):
    from tidelog.functions.codec import LOG_HEAD, log_record
    from tidelog.operators.introspect import payload

    rows = spark.range(5000).selectExpr("format_string('k%06d', id) as key", "0 as op", "format_string('value_%06d_bench_padding_____', id) as value")
    assert rows.agg(F.sum(payload(LOG_HEAD)).alias("n")).first().n == 255_000
    assert len(log_record(b"k000001", b"value_000001_bench_padding_____")) * 5000 == 255_000


def test_lookup_benchmark(store):
    for batch in range(5):
        write(store, *[(b"b%dk%04d" % (batch, i), b"val") for i in range(200)])
        store.flush()
    assert len(store.manifest.runs) == 2 and store.manifest.compactions == 1
    keys = [b"b0k%04d" % (i % 200) for i in range(500)] + [b"absent_key_%06d" % i for i in range(500)]
    probes = store.spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    assert {r.status: r["count"] for r in store.get_many(probes).groupBy("status").count().collect()} == {"live": 500, "absent": 500}


def test_rate_stream(spark, tmp_path):
    from tidelog.streaming.ingest import ingest, rate_changes

    store = Store(spark, str(tmp_path / "live"))
    running = ingest(rate_changes(spark, 50), store, "live", str(tmp_path / "checkpoint"), processingTime="1 second")
    try:
        for _ in range(60):
            if Store(spark, store.path).manifest.writes:
                break
            running.awaitTermination(1)
    finally:
        running.stop()
    assert bytes(Store(spark, store.path).scan().first().key) == b"live_00000000"


def test_smaller_metrics(spark):
    polls = spark.createDataFrame([(1, 10), (2, 30), (3, 20)], "poll long, total long")
    assert [r.delta for r in metrics.deltas(polls, "total").orderBy("poll").collect()] == [10, 20, 0]
    values = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "poll long, raw long")
    assert metrics.ema(values, "raw").first().ema == 13
    assert [r.poll for r in metrics.rolling_series(polls, 2).collect()] == [3, 2]
    sizes = spark.createDataFrame([(0,), (1023,), (1536,)], "n long").select(metrics.format_bytes(F.col("n")).alias("s"))
    assert [r.s for r in sizes.collect()] == ["0 B", "1023 B", "1.5 KB"]
    assert spark.createDataFrame([], "poll long, raw long").transform(metrics.ema, "raw").first().ema == 0
