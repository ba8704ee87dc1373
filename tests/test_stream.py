"""Golden micro-fixtures on the fluent API and the operators."""

import pytest
from pyspark.sql import functions as F

from millrace import from_collection
from millrace.functions.text import threshold_status, tokens
from millrace.operators import eventtime, keyed, stateless
from millrace.operators.eventtime import Custom, Marked, Sliding, Tumbling
from millrace.sources.collection import collection, replay_from, shard


def _values(stream, name):
    return [r[name] for r in stream.collect()]


def test_text_pipeline(spark):
    s = from_collection(spark, ["hello world", "hi there", "go"], "line string")
    out = s.flat_map(tokens("line"), "w").filter(F.length("w") > 2).map(w=F.upper("w"))
    assert sorted(_values(out, "w")) == ["HELLO", "THERE", "WORLD"]
    assert _values(out, "w")[-1] == "THERE"


def test_tokens_drop_empty_pieces(spark):
    s = from_collection(spark, ["a  b ", None, ""], "line string")
    assert _values(s.flat_map(tokens("line"), "w"), "w") == ["a", "b"]


def test_map_filter_in_order(spark):
    s = from_collection(spark, [1, 2, 3, 4, 5], "x int")
    assert _values(s.map(x=F.col("x") * 10).filter(F.col("x") > 20), "x") == [30, 40, 50]


def test_parallel_map(spark):
    s = from_collection(spark, range(1, 7), "x int").set_parallelism(2)
    assert s.df.rdd.getNumPartitions() == 2
    assert sorted(_values(s.map(x=F.col("x") * 10), "x")) == [10, 20, 30, 40, 50, 60]
    with pytest.raises(ValueError, match="parallelism"):
        s.set_parallelism(0)


def test_shard_rebalance_replay(spark):
    df = collection(spark, range(10, 15), "x int")
    got = {r.x: r.subtask for r in shard(df, 2).collect()}
    assert got == {10: 0, 11: 1, 12: 0, 13: 1, 14: 0}
    assert [r.channel for r in stateless.rebalance(df, 3, "ord").orderBy("ord").collect()] == [0, 1, 2, 0, 1]
    assert [r.x for r in replay_from(df, 2).orderBy("ord").collect()] == [12, 13, 14]
    sparse = spark.createDataFrame([(10, "a"), (20, "b"), (30, "c")], "ord bigint, x string")
    assert {r.x: r.subtask for r in shard(sparse, 2).collect()} == {"a": 0, "b": 1, "c": 0}
    assert [r.x for r in replay_from(sparse, 1).orderBy("ord").collect()] == ["b", "c"]
    for bad in (lambda: shard(df, 0), lambda: stateless.rebalance(df, 0, "ord"), lambda: replay_from(df, -1)):
        with pytest.raises(ValueError):
            bad()


def test_running_reduce(spark):
    s = from_collection(spark, [1, 3, 2, 4], "x int").map(k=F.col("x") % 2)
    assert _values(s.key_by("k").sum("x"), "sum") == [1, 4, 2, 6]
    assert _values(s.key_by("k").reduce(lambda a, b: a * 10 + b, "x"), "acc") == [1, 13, 2, 24]
    assert _values(s.key_by("k").reduce("max", "x"), "acc") == [1, 3, 2, 4]
    with pytest.raises(ValueError, match="fold"):
        s.key_by("k").reduce("median", "x")


def test_null_keys_are_a_key(spark):
    df = collection(spark, [(None, 1), ("a", 2), (None, 3)], "k string, x int")
    assert [r.acc for r in keyed.running_sum(df, "k", "ord", "x", "acc").orderBy("ord").collect()] == [1, 2, 4]
    assert sorted(r.acc for r in keyed.running_fold(df, "k", "ord", "x", lambda a, b: a + b, "bigint", "acc").collect()) == [1, 2, 4]


def test_word_count_finals(spark):
    s = from_collection(spark, "a b c a d c a b c c".split(), "w string").map(n=F.lit(1))
    counts = s.key_by("w").sum("n", "n").df.groupBy("w").agg(F.max("n").alias("n"))
    assert {r.w: r.n for r in counts.collect()} == {"a": 3, "b": 2, "c": 4, "d": 1}


def test_running_best_keeps_the_earlier_of_equals(spark):
    df = collection(spark, [("s", 20.0, 1), ("s", 24.0, 2), ("s", 24.0, 3), ("s", 22.0, 4)], "k string, t double, id int")
    got = keyed.running_best(df, "k", "ord", "t", ["id", "t"]).orderBy("ord").collect()
    assert [r.best_id for r in got] == [1, 2, 2, 2]


def test_threshold(spark):
    df = spark.createDataFrame([(25.9,), (26.0,), (None,)], "t double")
    assert [r.s for r in df.select(threshold_status("t", 26.0).alias("s")).collect()] == ["normal", "alert", None]


def _timed(spark, rows, schema="key string, value int, ms bigint"):
    return from_collection(spark, rows, schema).map(ts=F.timestamp_millis("ms"))


def _sums(frame):
    return sorted((r.key, r.total, r.last) for r in frame.collect())


def _reduce(stream, windows, delay="0 seconds"):
    s = stream.assign_timestamps_and_watermarks("ts", delay)
    return s.key_by("key").window(windows).reduce(F.sum("value").alias("total"), F.max("ms").alias("last"))


def test_tumbling(spark):
    s = _timed(spark, [("a", 1, 100), ("a", 2, 200), ("a", 10, 1100), ("a", 20, 1200)])
    assert _sums(_reduce(s, Tumbling("1 second"))) == [("a", 3, 200), ("a", 30, 1200)]


def test_windows_per_key_and_late_rows(spark):
    s = _timed(spark, [("1", 1, 1500), ("2", 2, 1500), ("1", 1, 1600)])
    assert _sums(_reduce(s, Tumbling("1 second"))) == [("1", 2, 1600), ("2", 2, 1500)]
    late = _timed(spark, [("5", 5, 1500), ("9", 9, 2000), ("5", 5, 1800)])
    assert _sums(_reduce(late, Tumbling("1 second"))) == [("5", 5, 1500), ("9", 9, 2000)]
    assert _sums(_reduce(late, Tumbling("1 second"), "1 second")) == [("5", 10, 1800), ("9", 9, 2000)]


def test_filtered_rows_move_the_watermark(spark):
    s = _timed(spark, [("a", 1, 100), ("b", 1, 9000), ("a", 1, 200)]).assign_timestamps_and_watermarks("ts")
    kept = s.filter(F.col("key") == "a").key_by("key").window(Tumbling("1 second")).reduce(F.sum("value").alias("total"), F.max("ms").alias("last"))
    assert _sums(kept) == [("a", 1, 100)]


def test_sliding_end_to_end_out_of_order(spark):
    s = _timed(spark, [("a", 1, 3500), ("a", 1, 2500), ("a", 1, 6000)])
    frame = s.assign_timestamps_and_watermarks("ts", "1 second").key_by("key").window(Sliding("3 seconds", "1 second")).reduce(F.sum("value").alias("n"))
    got = {int(r.win_start.timestamp()): r.n for r in frame.collect()}
    assert got == {0: 1, 1: 2, 2: 2, 3: 1, 4: 1, 5: 1, 6: 1}


def test_window_assignment(spark):
    df = _timed(spark, [("a", 1, 3500), ("b", 1, -1)]).df
    starts = lambda w: sorted(r.s for r in eventtime.assign_windows(df, "ts", w).select("key", F.unix_millis("win_start").alias("s")).filter("key = 'a'").collect())
    assert starts(Sliding("3 seconds", "1 second")) == [1000, 2000, 3000]
    negative = eventtime.assign_windows(df, "ts", Tumbling("1 second")).filter("key = 'b'").select(F.unix_millis("win_start").alias("s"))
    assert negative.first().s == -1000
    uneven = eventtime.assign_windows(_timed(spark, [("a", 1, 9000)]).df, "ts", Sliding("10 seconds", "3 seconds"))
    assert uneven.count() == 4
    with pytest.raises(ValueError, match="slide"):
        Sliding("1 second", "2 seconds")


def test_watermark_after_each_record(spark):
    df = _timed(spark, [("a", 1, 1000), ("a", 1, 500), ("a", 1, 3000)]).df
    got = eventtime.watermark_after(df, "ts", ["ord"], "100 milliseconds").orderBy("ord").select(F.unix_millis("wm").alias("wm"))
    assert [r.wm for r in got.collect()] == [900, 900, 2900]
    before = eventtime.watermark_before(df, "ts", ["ord"], "100 milliseconds").orderBy("ord").select(F.unix_millis("wm").alias("wm"))
    assert [r.wm for r in before.collect()] == [None, 900, 900]


def test_watermark_across_ranges_of_the_order(spark):
    from millrace.operators.prefix import ordinal, running_max_before

    df = spark.range(500).select("id", ((F.col("id") * 37) % 101).alias("v"))
    got = [r.m for r in running_max_before(df, F.col("v"), ["id"], "m", width=16).orderBy("id").collect()]
    values = [(i * 37) % 101 for i in range(500)]
    assert got == [max(values[:i]) if i else None for i in range(500)]
    assert [r.o for r in ordinal(df.filter("id % 3 = 0"), "id", "o", width=16).orderBy("id").collect()] == list(range(167))


def test_window_without_time_is_one_per_key(spark):
    s = from_collection(spark, [("a", 1), ("a", 2), ("b", 5)], "key string, value int")
    got = s.key_by("key").window(Tumbling("1 second")).reduce(F.sum("value").alias("n")).collect()
    assert {r.key: r.n for r in got} == {"a": 3, "b": 5}


def test_streams_go_on_behind_windows(spark):
    s = _timed(spark, [("a", 1, 100), ("a", 2, 1200), ("b", 4, 1300), ("a", 8, 2100)]).assign_timestamps_and_watermarks("ts")
    seconds = s.key_by("key").window(Tumbling("1 second")).reduce(F.sum("value").alias("total"))
    assert [(r.key, r.total) for r in seconds.collect()] == [("a", 1), ("a", 2), ("b", 4), ("a", 8)]
    tens = seconds.map(total=F.col("total") * 10).filter(F.col("total") > 10).key_by("key").sum("total")
    assert [(r.key, r["sum"]) for r in tens.collect()] == [("a", 20), ("b", 40), ("a", 100)]


def test_window_fold_need_not_commute(spark):
    s = _timed(spark, [("a", 1, 100), ("a", 2, 50), ("a", 7, 1100), ("a", 3, 300)]).assign_timestamps_and_watermarks("ts", "1 minute")
    got = s.key_by("key").window(Tumbling("1 second")).fold(F.col("value"), F.lit(0), lambda a, x: a * 10 + x, "digits")
    assert [r.digits for r in got.collect()] == [123, 7]


def test_own_assigner_and_strategy_on_the_fluent_api(spark):
    whole = Custom(lambda ts: F.array(F.struct(F.timestamp_millis(F.lit(0)).alias("start"), F.timestamp_millis(F.lit(5000)).alias("end"))))
    s = _timed(spark, [("a", 1, 100), ("a", 2, 9000), ("a", 4, 200)])
    late = s.assign_timestamps_and_watermarks("ts").key_by("key").window(whole).reduce(F.sum("value").alias("total"))
    assert [r.total for r in late.collect()] == [3]
    marked = s.assign_timestamps_and_watermarks("ts", Marked(F.when(F.col("value") > 2, F.col("ts")), "1 second"))
    assert [r.total for r in marked.key_by("key").window(whole).reduce(F.sum("value").alias("total")).collect()] == [7]


def test_composite_and_computed_keys(spark):
    s = from_collection(spark, [("a", 1), ("b", 3), ("a", 2)], "k string, x int")
    assert _values(s.key_by(F.col("x") % 2, name="odd").sum("x"), "sum") == [1, 4, 2]
    assert _values(s.key_by("k", F.col("x") % 2).sum("x"), "sum") == [1, 3, 2]


def test_own_partitioner(spark):
    s = from_collection(spark, range(6), "x int").partition_by(F.col("x") * 2 + 1, 4)
    rows = s.df.withColumn("p", F.spark_partition_id()).collect()
    assert all(r.p == (2 * r.x + 1) % 4 for r in rows)
    with pytest.raises(ValueError, match="parallelism"):
        s.partition_by(F.lit(0), 0)


def test_last_of_fold_streams_keys(spark):
    df = collection(spark, [("a", 1), (None, 5), ("a", 2), (None, 6), ("b", 9)], "k string, x int")
    got = keyed.last_of_fold(df, ["k"], "ord", "x", lambda a, b: a * 10 + b, "bigint", "n").collect()
    assert {r.k: r.n for r in got} == {"a": 12, None: 56, "b": 9}


def test_opaque_functions_on_the_fluent_api(spark):
    s = from_collection(spark, [3, 4], "x int")
    assert _values(s.map_rows(lambda r: (r["x"] * 2, r["ord"]), "x int, ord bigint"), "x") == [6, 8]
    assert _values(s.flat_map_rows(lambda r: [(r["x"], r["ord"])] * 2, "x int, ord bigint"), "x") == [3, 3, 4, 4]


def test_plan_shapes(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    running = plan(keyed.running_sum(df, "user_id", "event_id", "value", "acc").select("event_id", "acc"))
    assert running.count("Exchange") == 1
    final = plan(keyed.final_reduce(df, "user_id", "sum", "value", "total"))
    assert "partial_sum" in final and "ReadSchema: struct<user_id:bigint,value:double>" in final
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,20.0)]" in plan(stateless.filter_rows(df, F.col("value") > 20))
