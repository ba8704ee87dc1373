"""Sources, sinks, recovery."""

import pytest
from pyspark.sql import functions as F

from millrace import Environment, from_source
from millrace.operators.eventtime import Marked, Tumbling
from millrace.plans.stream import Stream
from millrace.session import shared_dir
from millrace.sources.custom import add_source
from millrace.sources.tables import replay_files
from millrace.streaming import processors, runner, sinks


def test_custom_source_batch_and_stream(spark):
    def numbers(subtask, parallelism):
        for i in range(5):
            yield (subtask, i * parallelism + subtask)

    batch = add_source(spark, numbers, "subtask int, x int", parallelism=2)
    assert sorted(r.x for r in batch.collect()) == list(range(10))
    stream = add_source(spark, numbers, "subtask int, x int", parallelism=2, streaming=True, step=2, limit=5)
    out, checkpoint = shared_dir(spark, "out"), shared_dir(spark, "checkpoint")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.x for r in spark.read.parquet(out).collect()) == list(range(10))
    with pytest.raises(ValueError, match="parallelism"):
        add_source(spark, numbers, "x int", parallelism=0)
    with pytest.raises(ValueError, match="limit"):
        add_source(spark, numbers, "x int", streaming=True)


def test_custom_source_starts_at_its_offset(spark):
    def numbers(subtask, parallelism, start):
        for i in range(start, 6):
            yield (i, i % 2, start)

    stream = from_source(spark, numbers, "ord bigint, k int, began int", "ord", streaming=True, step=2, limit=6)
    out, checkpoint = shared_dir(spark, "out"), shared_dir(spark, "checkpoint")
    query = stream.df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.read.parquet(out).orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(6)) and all(r.began <= r.ord for r in got)
    batch = from_source(spark, numbers, "ord bigint, k int, began int", "ord").key_by("k").sum("ord")
    assert [r["sum"] for r in batch.collect()] == [0, 1, 2, 4, 6, 9]


def test_collect_sink_is_a_copy(spark):
    rows = sinks.collect_sink(spark.range(3))
    rows.clear()
    assert len(sinks.collect_sink(spark.range(3))) == 3


def _stream(spark, name):
    files = shared_dir(spark, name)
    spark.range(8).withColumn("v", F.lit(1)).repartitionByRange(4, "id").write.parquet(files)
    return spark.readStream.schema("id bigint, v int").option("maxFilesPerTrigger", "1").parquet(files)


def test_restarts_are_exactly_once(spark):
    out, checkpoint, tries = shared_dir(spark, "restart"), shared_dir(spark, "checkpoint"), []
    stream = _stream(spark, "files")

    def start(attempt):
        tries.append(attempt)

        def fail(n):
            if n == 1 and attempt < 2:
                raise RuntimeError("injected")

        return stream.writeStream.foreachBatch(sinks.batch_table(out, fail)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    assert runner.run_with_restarts(start, 3) == 2
    assert tries == [0, 1, 2]
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(8))


def test_restarts_run_out(spark):
    checkpoint = shared_dir(spark, "checkpoint")
    stream = _stream(spark, "files")

    def broken(df, n):
        raise RuntimeError("always")

    def start(attempt):
        return stream.writeStream.foreachBatch(broken).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="always"):
        runner.run_with_restarts(start, 1)
    with pytest.raises(ValueError, match="max_restarts"):
        runner.run_with_restarts(start, -1)


def _timed(spark, rows):
    """(k, v, ms) in arrival order, two rows a file, one file a batch."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord bigint, k string, v int, ms bigint")
    files = replay_files(df.withColumn("ts", F.timestamp_millis("ms")), "ord", -(-len(rows) // 2))
    return spark.readStream.schema("ord bigint, k string, v int, ms bigint, ts timestamp").option("maxFilesPerTrigger", "1").parquet(files)


def _windows(spark, rows, delay="1 second"):
    s = Stream(_timed(spark, rows), "ord").assign_timestamps_and_watermarks("ts", delay)
    return s.key_by("k").window(Tumbling("1 second")).reduce(F.sum("v").alias("total"))


def _totals(frame):
    return sorted((r.k, int(r.win_start.timestamp()), r.total) for r in frame.collect())


def test_flush_closes_all_windows_of_many_batches(spark):
    rows = [("a", 1, 100), ("a", 2, 200), ("b", 5, 900), ("a", 10, 1100), ("a", 20, 1200), ("b", 7, 5000), ("b", 1, 5100), ("a", 3, 9000)]
    want = [("a", 0, 3), ("a", 1, 30), ("a", 9, 3), ("b", 0, 5), ("b", 5, 8)]
    runner.enable_state_store(spark)
    assert _totals(Environment(spark).execute(_windows(spark, rows))) == want


def test_windows_survive_restarts(spark):
    """Fails between batches, and again in the run that ends the input; state, watermark and sink go on."""
    runner.enable_state_store(spark)
    rows = [("a", 1, 100 + 50 * i) for i in range(8)] + [("a", 1, 1100 + 50 * i) for i in range(8)]
    windows, out, checkpoint, failed = _windows(spark, rows), shared_dir(spark, "out"), shared_dir(spark, "checkpoint"), []

    def start(_):
        def fail(n):
            if n in (2, 9) and n not in failed:
                failed.append(n)
                raise RuntimeError("injected")

        return windows.df.writeStream.foreachBatch(sinks.batch_table(out, fail)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    assert runner.run_with_restarts(start, 1) == 1
    windows.flush.close()
    assert runner.run_with_restarts(start, 1) == 1
    assert failed == [2, 9]
    assert _totals(spark.read.parquet(out)) == [("a", 0, 8), ("a", 1, 8)]


def test_snapshot_then_fire(spark):
    """What a stopped query has taken in fires in a later run on its checkpoint."""
    runner.enable_state_store(spark)
    windows, out, checkpoint = _windows(spark, [("a", 1, 100), ("a", 2, 200)]), shared_dir(spark, "out"), shared_dir(spark, "checkpoint")
    assert runner.run_to_parquet(windows.df, checkpoint, out).count() == 0
    windows.flush.close()
    assert _totals(runner.run_to_parquet(windows.df, checkpoint, out)) == [("a", 0, 3)]


def test_checkpoint_interval(spark):
    runner.enable_state_store(spark)
    env = Environment(spark).enable_checkpointing(100).set_max_restarts(0)
    assert _totals(env.execute(_windows(spark, [("a", 1, 100), ("a", 2, 200), ("a", 4, 3000)]))) == [("a", 0, 3), ("a", 3, 4)]
    for bad in (lambda: env.enable_checkpointing(0), lambda: env.set_max_restarts(-1)):
        with pytest.raises(ValueError):
            bad()


def test_environment_writes_batches(spark):
    env = Environment(spark)
    s = env.from_collection([1, 2, 3], "x int").map(x=F.col("x") * 2).filter(F.col("x") > 2)
    assert sorted(r.x for r in env.execute(s).collect()) == [4, 6]
    assert s.add_sink(sinks.collect_sink)[0].x in (4, 6)


def test_exact_watermarks_over_batches(spark):
    """Each row gets the watermark of all earlier arrivals, also those of other batches; a replayed batch changes nothing."""
    times = [5000, 3000, 9000, 7000, 1000, 12_000, 11_000, 2000]
    stream, out, checkpoint = _timed(spark, [("a", 1, t) for t in times]), shared_dir(spark, "stamps"), shared_dir(spark, "checkpoint")
    tries = []

    def start(_):
        write = processors.stamp_batches(out, ["ord"], "ts", "1 second")

        def once(batch, n):
            write(batch, n)
            tries.append(n)
            if tries == [0, 1]:
                raise RuntimeError("injected")

        return stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    runner.run_with_restarts(start, 1)
    got = processors.stamped(spark, out, stream.schema, "ts").orderBy("ord").select(F.unix_millis("wm").alias("wm")).collect()
    assert [r.wm for r in got] == [None] + [max(times[:i]) - 1000 for i in range(1, len(times))]


def test_idle_timer_is_deleted_and_set_anew(spark):
    runner.enable_state_store(spark)
    rows = [("a", 1, 100), ("b", 1, 200), ("a", 1, 900), ("a", 1, 1700), ("b", 1, 30_000), ("b", 1, 30_500)]
    stream, flush = runner.with_flush(_timed(spark, rows), "ts", k="~")
    idle = processors.idle_keys_stream(stream.withColumn("ms", F.unix_millis("ts")), "k", "ts", "ms", 1000, "0 seconds")
    got = sorted((r.k, r.end_ms, r.n) for r in runner.run_to_parquet(idle, flush=flush).collect() if r.k != "~")
    assert got == [("a", 2700, 3), ("b", 1200, 1), ("b", 31_500, 2)]


def test_list_state_is_read_and_cleared(spark):
    runner.enable_state_store(spark)
    rows = [(k, v, v) for v, k in enumerate("aababaabb")]
    stream = _timed(spark, rows).withColumn("s", F.col("v").cast("string"))
    got = sorted((r.k, r["items"]) for r in runner.run_to_parquet(processors.groups_stream(stream, "k", "ord", "s", 2)).collect())
    assert got == [("a", "0,1"), ("a", "3,5"), ("b", "2,4"), ("b", "7,8")]


def test_own_processor_on_a_fluent_stream(spark):
    runner.enable_state_store(spark)
    s = Stream(_timed(spark, [("a", 1, 1), ("a", 2, 2), ("b", 5, 3)]), "ord")
    out = s.key_by("k").process(processors.RunningFold("ord", "v", "bigint", max, "top"), "ord bigint, k string, v int, ms bigint, ts timestamp, top bigint")
    assert sorted((r.ord, r.top) for r in Environment(spark).execute(out).collect()) == [(0, 1), (1, 2), (2, 5)]


def test_running_folds_of_streams(spark):
    runner.enable_state_store(spark)
    s = Stream(_timed(spark, [("a", 3, 1), ("a", 1, 2), ("b", 5, 3), ("a", 2, 4)]), "ord").assign_timestamps_and_watermarks("ts").key_by("k")
    for fold, want in (("count", [1, 2, 1, 3]), ("min", [3, 1, 5, 1]), (lambda a, b: a * 10 + b, [3, 31, 5, 312])):
        assert [r.acc for r in Environment(spark).execute(s.reduce(fold, "v")).orderBy("ord").collect()] == want


def test_streams_take_bounds_only(spark):
    s = Stream(_timed(spark, [("a", 1, 1), ("a", 1, 2)]), "ord")
    with pytest.raises(ValueError, match="bound"):
        s.assign_timestamps_and_watermarks("ts", Marked(F.col("ts")))
    with pytest.raises(ValueError, match="event time"):
        s.key_by("k").window(Tumbling("1 second")).reduce(F.sum("v"))


def test_own_watermark_strategy(spark):
    files = shared_dir(spark, "files")
    spark.createDataFrame([(i, t, 0) for i, t in enumerate([5, 3, 9, 7])], "ord bigint, t bigint, clock int").write.parquet(files)
    runner.enable_state_store(spark)
    stream = spark.readStream.schema("ord bigint, t bigint, clock int").parquet(files)
    last_seen = (lambda state, t: t), (lambda state: -1 if state is None else state)
    out = runner.run_to_parquet(processors.stamp_watermark_stream(stream, ["ord"], "t", last_seen, "clock"))
    assert [r.wm_us for r in out.orderBy("ord").collect()] == [-1, 5, 3, 9]


def test_for_each_reaches_every_row(spark, tmp_path):
    def touch(row):
        (tmp_path / str(row.id)).touch()

    sinks.for_each(spark.range(5), touch)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["0", "1", "2", "3", "4"]
