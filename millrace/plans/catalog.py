"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import threshold_status, tokens
from millrace.operators import eventtime as et
from millrace.operators import keyed, stateless
from millrace.plans.environment import Environment
from millrace.plans.stream import Stream, from_table
from millrace.session import shared_dir
from millrace.sources.collection import replay_from, shard
from millrace.sources.tables import read_table, replay_files, stream_table, with_cents
from millrace.streaming import processors, runner, sinks

Query = Callable[[SparkSession, str], DataFrame]

DELAY = "2 hours"
#: Files, and so batches, of the streams of events.
BATCHES = 3
_ARRIVAL = "event_id + (event_id * 7919) % 97"


def _events(spark: SparkSession, root: str) -> DataFrame:
    return with_cents(read_table(spark, root, "events"))


def _arrivals(spark: SparkSession, root: str) -> DataFrame:
    return _events(spark, root).withColumn("arr", F.expr(_ARRIVAL))


def _marked(spark: SparkSession, root: str) -> DataFrame:
    return et.watermark_before(_arrivals(spark, root), "ts", ["arr", "event_id"], DELAY)


def _token_rows(spark: SparkSession, root: str) -> DataFrame:
    return stateless.flat_map(read_table(spark, root, "documents"), tokens("text"), "w", ["doc_id"])


# --- stateless ---------------------------------------------------------------------------------------------------


def map_project(spark: SparkSession, root: str) -> DataFrame:
    return stateless.map_columns(read_table(spark, root, "lineitem"), ["l_orderkey", "l_linenumber"], q10=F.col("l_quantity") * 10)


def filter_pred(spark: SparkSession, root: str) -> DataFrame:
    return stateless.filter_rows(read_table(spark, root, "events"), F.col("value") > 20).select("event_id", "user_id", "value")


def flatmap_tokens(spark: SparkSession, root: str) -> DataFrame:
    return _token_rows(spark, root)


def text_pipeline(spark: SparkSession, root: str) -> DataFrame:
    words = stateless.filter_rows(_token_rows(spark, root), F.length("w") > 2)
    return stateless.map_columns(words, ["doc_id"], w=F.upper("w"))


def map_opaque(spark: SparkSession, root: str) -> DataFrame:
    events = read_table(spark, root, "events").select("event_id", "event_type")
    return stateless.map_rows(events, lambda r: (r["event_id"], len(r["event_type"])), "event_id bigint, n bigint")


def source_shard(spark: SparkSession, root: str) -> DataFrame:
    """The order has gaps: an element's position counts, not its number."""
    return shard(read_table(spark, root, "events").filter("event_type <> 'click'"), 4, "event_id").select("event_id", "subtask")


def source_replay(spark: SparkSession, root: str) -> DataFrame:
    return replay_from(read_table(spark, root, "events").filter("event_type <> 'click'"), 250, "event_id").select("event_id", "user_id")


def rebalance_round_robin(spark: SparkSession, root: str) -> DataFrame:
    return stateless.rebalance(read_table(spark, root, "events"), 4, "event_id").select("event_id", "channel")


def sink_threshold(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "events").select("event_id", threshold_status("value", 26.0).alias("status"))


# --- keyed -------------------------------------------------------------------------------------------------------


def keyed_reduce_running(spark: SparkSession, root: str) -> DataFrame:
    return keyed.running_sum(_events(spark, root), "user_id", "event_id", "c", "acc").select("event_id", "user_id", "acc")


def keyed_reduce_opaque(spark: SparkSession, root: str) -> DataFrame:
    """The running sum once more, as an opaque Python function."""
    folded = keyed.running_fold(_events(spark, root).select("event_id", "user_id", "c"), "user_id", "event_id", "c", lambda a, b: a + b, "bigint", "acc")
    return folded.select("event_id", "user_id", "acc")


def keyed_reduce_final(spark: SparkSession, root: str) -> DataFrame:
    return keyed.final_reduce(_events(spark, root), "user_id", "sum", "c", "total")


def wordcount(spark: SparkSession, root: str) -> DataFrame:
    return _token_rows(spark, root).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def running_max_record(spark: SparkSession, root: str) -> DataFrame:
    best = keyed.running_best(_events(spark, root), "user_id", "event_id", "c", ["event_id", "c"])
    return best.select("event_id", "user_id", "best_event_id", "best_c")


def first_record_seed(spark: SparkSession, root: str) -> DataFrame:
    return keyed.first_and_last(_events(spark, root), "user_id", "event_id", "event_type", "first_type", "last_type")


def _initials(acc, item):  # noqa: ANN001, ANN202
    return F.concat(acc, F.substring(item, 1, 1))


def ordered_fold(spark: SparkSession, root: str) -> DataFrame:
    """A reduce of each key whose function does not commute."""
    return keyed.ordered_fold(_events(spark, root), "user_id", "event_id", F.col("event_type"), F.lit(""), _initials, "path").select("user_id", "path")


def last_of_fold(spark: SparkSession, root: str) -> DataFrame:
    """The last value of an opaque fold that does not commute; a key of any size."""
    events = _events(spark, root).select("event_id", "user_id", "c")
    return keyed.last_of_fold(events, ["user_id"], "event_id", "c", lambda a, x: (a * 31 + x) % 1_000_003, "bigint", "digest").select("user_id", "digest")


def value_state_previous(spark: SparkSession, root: str) -> DataFrame:
    return keyed.previous_value(_events(spark, root), "user_id", "event_id", "c", "previous").select("event_id", "user_id", "previous")


def list_state_by_key(spark: SparkSession, root: str) -> DataFrame:
    lists = keyed.list_state(_events(spark, root), "user_id", "event_id", "event_type", "items")
    return lists.select("user_id", F.array_join("items", ",").alias("items"))


def map_state_by_key(spark: SparkSession, root: str) -> DataFrame:
    return keyed.map_state_counts(_events(spark, root), "user_id", "event_type", "n")


# --- event time --------------------------------------------------------------------------------------------------


def watermark_trace(spark: SparkSession, root: str) -> DataFrame:
    return et.watermark_after(_arrivals(spark, root), "ts", ["arr", "event_id"], DELAY).select("event_id", "wm")


def _sums(df: DataFrame) -> DataFrame:
    out = et.window_reduce(df, ["event_type"], F.sum("c").alias("total"), F.max("ts").alias("last_ts"))
    return out.select("event_type", "win_start", "total", "last_ts")


def tumbling_reduce(spark: SparkSession, root: str) -> DataFrame:
    return _sums(et.assign_windows(_events(spark, root), "ts", et.Tumbling("1 hour")))


def sliding_reduce(spark: SparkSession, root: str) -> DataFrame:
    return _sums(et.assign_windows(_events(spark, root), "ts", et.Sliding("3 hours", "1 hour")))


def custom_assigner(spark: SparkSession, root: str) -> DataFrame:
    day = F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd"), F.lit("yyyy-MM-dd"))
    window = F.array(F.struct(day.alias("start"), (day + F.expr("INTERVAL 1 DAY")).alias("end")))
    return _sums(et.assign_custom(_events(spark, root), window))


def tumbling_late_drop(spark: SparkSession, root: str) -> DataFrame:
    return _sums(et.on_time(et.assign_windows(_marked(spark, root), "ts", et.Tumbling("1 hour"))))


def sliding_late_drop(spark: SparkSession, root: str) -> DataFrame:
    return _sums(et.on_time(et.assign_windows(_marked(spark, root), "ts", et.Sliding("3 hours", "1 hour"))))


def late_rows_dropped(spark: SparkSession, root: str) -> DataFrame:
    rows = et.late(et.assign_windows(_marked(spark, root), "ts", et.Tumbling("1 hour")))
    return rows.select("event_id", "win_start")


def filter_after_watermark(spark: SparkSession, root: str) -> DataFrame:
    clicks = et.filter_after_watermark(_marked(spark, root), "ts", F.col("event_type") == "click")
    return _sums(et.on_time(et.assign_windows(clicks, "ts", et.Tumbling("1 hour"))))


def window_no_timestamps(spark: SparkSession, root: str) -> DataFrame:
    stream = Stream(_events(spark, root), "event_id")
    return stream.key_by("event_type").window(et.Tumbling("1 hour")).reduce(F.sum("c").alias("total")).df.select("event_type", "total")


def window_ordered_fold(spark: SparkSession, root: str) -> DataFrame:
    """A reduce of each key and window whose function does not commute, in arrival order, without late rows."""
    stream = Stream(_arrivals(spark, root).withColumn("at", F.col("arr") * (1 << 20) + F.col("event_id")), "at")
    timed = stream.assign_timestamps_and_watermarks("ts", DELAY)
    folded = timed.key_by("event_type").window(et.Tumbling("6 hours")).fold(F.col("user_id").cast("string"), F.lit(""), lambda a, x: F.concat(a, F.lit(","), x), "users")
    return folded.df.select("event_type", "win_start", "users")


def marked_strategy(spark: SparkSession, root: str) -> DataFrame:
    """An own watermark strategy: only purchases move the watermark."""
    strategy = et.Marked(F.when(F.col("event_type") == "purchase", F.col("ts")))
    marked = et.watermark_before(_arrivals(spark, root), "ts", ["arr", "event_id"], strategy)
    return _sums(et.on_time(et.assign_windows(marked, "ts", et.Tumbling("1 hour"))))


def windows_of_windows(spark: SparkSession, root: str) -> DataFrame:
    """A stream goes on behind a window: the hours of each type, then the largest hour of each day."""
    hours = Stream(_events(spark, root), "event_id").assign_timestamps_and_watermarks("ts").key_by("event_type").window(et.Tumbling("1 hour"))
    totals = hours.reduce(F.sum("c").alias("total")).map(total=F.col("total") * 2).filter(F.col("total") > 0)
    days = totals.assign_timestamps_and_watermarks("win_start", "2 days").key_by(F.upper("event_type"), name="kind").window(et.Tumbling("1 day"))
    return days.reduce(F.max("total").alias("best")).df.select("kind", "win_start", "best")


def keyed_by_expression(spark: SparkSession, root: str) -> DataFrame:
    """A key of an expression and a column."""
    return Stream(_events(spark, root), "event_id").key_by(F.col("user_id") % 7, "event_type").sum("c", "acc").df.select("event_id", "acc")


def partitioned(spark: SparkSession, root: str) -> DataFrame:
    """An own partitioner; the channel is the partition that a row is in."""
    rows = Stream(_events(spark, root), "event_id").partition_by(F.col("user_id"), 3).df
    return rows.select("event_id", F.spark_partition_id().cast("bigint").alias("channel"))


def window_firing_order(spark: SparkSession, root: str) -> DataFrame:
    assigned = et.assign_windows(_events(spark, root), "ts", et.Tumbling("1 hour"))
    fired = et.window_reduce(assigned, ["event_type"], F.min("event_id").alias("first_id"))
    return et.firing_order(fired, "first_id").select("event_type", "win_end", F.col("fire_rank").cast("bigint").alias("fire_rank"))


# --- streams -----------------------------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, root: str) -> DataFrame:
    runner.enable_state_store(spark)
    return with_cents(stream_table(spark, root, "events")).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_text_pipeline(spark: SparkSession, root: str) -> DataFrame:
    docs = stream_table(spark, root, "documents")
    words = stateless.flat_map(docs, tokens("text"), "w", ["doc_id"]).filter(F.length("w") > 2)
    return runner.run_to_parquet(words.select("doc_id", F.upper("w").alias("w")))


def stream_keyed_reduce(spark: SparkSession, root: str) -> DataFrame:
    events = _event_stream(spark, root).select("event_id", "user_id", "c")
    return runner.run_to_parquet(processors.running_fold_stream(events, "user_id", "event_id", "c", "bigint", lambda a, b: a + b)).drop("c")


def stream_fluent_reduce(spark: SparkSession, root: str) -> DataFrame:
    """The fluent verbs on a stream: time, filter, key, running reduce, sink."""
    events = Stream(_batches(spark, root).select("event_id", "user_id", "value", "c", "ts"), "event_id")
    out = events.assign_timestamps_and_watermarks("ts", DELAY).filter(F.col("value") > 20).key_by("user_id").sum("c", "acc")
    return Environment(spark).execute(out).select("event_id", "user_id", "acc")


def stream_keyed_views(spark: SparkSession, root: str) -> DataFrame:
    events = _event_stream(spark, root).select("event_id", "user_id", "event_type")
    return runner.run_to_parquet(processors.keyed_views_stream(events, "user_id", "event_id", "event_type"))


def _batches(spark: SparkSession, root: str, order: str = "event_id") -> DataFrame:
    """The events as a stream of BATCHES files, one for each batch, in arrival order."""
    runner.enable_state_store(spark)
    events = _arrivals(spark, root).withColumn("ts", F.col("ts").cast("timestamp"))
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "1").parquet(replay_files(events, order, BATCHES))


def _stream_windows(spark: SparkSession, root: str, windows: et.Tumbling | et.Sliding) -> DataFrame:
    events = Stream(_batches(spark, root).select("event_id", "event_type", "ts", "c"), "event_id").assign_timestamps_and_watermarks("ts", DELAY)
    out = events.key_by("event_type").window(windows).reduce(F.sum("c").alias("total"), F.max("ts").alias("last_ts"))
    done = Environment(spark).execute(out).select("event_type", "win_start", "total", "last_ts")
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("win_start", "last_ts")})


def stream_tumbling_reduce(spark: SparkSession, root: str) -> DataFrame:
    return _stream_windows(spark, root, et.Tumbling("1 hour"))


def stream_sliding_reduce(spark: SparkSession, root: str) -> DataFrame:
    return _stream_windows(spark, root, et.Sliding("3 hours", "1 hour"))


def stream_tumbling_late_drop(spark: SparkSession, root: str) -> DataFrame:
    """Exact late rows on a stream: each row is stamped with its watermark, then late pairs are dropped."""
    rows, out, checkpoint = _batches(spark, root, "arr").select("event_id", "arr", "event_type", "c", "ts"), shared_dir(spark, "stamps"), shared_dir(spark, "checkpoint")

    def start(_: int):  # noqa: ANN202
        writer = rows.writeStream.foreachBatch(processors.stamp_batches(out, ["arr", "event_id"], "ts", DELAY))
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    runner.run_with_restarts(start)
    done = processors.stamped(spark, out, rows.schema, "ts")
    timed = done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "wm")})
    return _sums(et.on_time(et.assign_windows(timed, "ts", et.Tumbling("1 hour"))))


def stream_timers(spark: SparkSession, root: str) -> DataFrame:
    events, flush = runner.with_flush(_batches(spark, root).select("user_id", "ts"), "ts", user_id=-1)
    rows = events.withColumn("ts_ms", F.unix_millis("ts"))
    counts = processors.timer_counts_stream(rows, "user_id", "ts", "ts_ms", 3_600_000, DELAY)
    return runner.run_to_parquet(counts, flush=flush).filter(F.col("user_id") >= 0)


def stream_idle_keys(spark: SparkSession, root: str) -> DataFrame:
    """Users without an event for a day, or at the end: a timer that each event deletes and sets anew."""
    events, flush = runner.with_flush(_batches(spark, root).select("user_id", "ts"), "ts", user_id=-1)
    rows = events.withColumn("ts_ms", F.unix_millis("ts"))
    idle = processors.idle_keys_stream(rows, "user_id", "ts", "ts_ms", 365 * 86_400_000, DELAY)
    return runner.run_to_parquet(idle, flush=flush).filter(F.col("user_id") >= 0)


def stream_list_groups(spark: SparkSession, root: str) -> DataFrame:
    """A list state that is read and cleared: every ten event types of a user."""
    events = _batches(spark, root).select("event_id", "user_id", "event_type")
    return runner.run_to_parquet(processors.groups_stream(events, "user_id", "event_id", "event_type", 10))


def stream_window_fold(spark: SparkSession, root: str) -> DataFrame:
    """A reduce of each key and window whose function does not commute, on a stream."""
    events = Stream(_batches(spark, root).select("event_id", "event_type", "ts"), "event_id").assign_timestamps_and_watermarks("ts", DELAY)
    folded = events.key_by("event_type").window(et.Tumbling("6 hours")).fold(F.col("event_id").cast("string"), F.lit(""), lambda a, x: F.concat(a, F.lit(","), x), "ids")
    done = Environment(spark).execute(folded)
    return done.select("event_type", F.col("win_start").cast("timestamp_ntz").alias("win_start"), "ids")


def restart_windows(spark: SparkSession, root: str) -> DataFrame:
    """Windows over several batches that fail once between two of them, and once before the end of input."""
    events = Stream(_batches(spark, root).select("event_id", "event_type", "ts", "c"), "event_id").assign_timestamps_and_watermarks("ts", DELAY)
    windows = events.key_by("event_type").window(et.Tumbling("1 hour")).reduce(F.sum("c").alias("total"), F.max("ts").alias("last_ts"))
    out, checkpoint, failed = shared_dir(spark, "restart"), shared_dir(spark, "checkpoint"), set()

    def start(_: int):  # noqa: ANN202
        def fail(batch: int) -> None:
            if batch in (1, BATCHES) and batch not in failed:
                failed.add(batch)
                raise RuntimeError("injected failure")

        writer = windows.df.writeStream.foreachBatch(sinks.batch_table(out, fail)).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()

    runner.run_with_restarts(start)
    windows.flush.close()
    runner.run_with_restarts(start)
    done = spark.read.schema(windows.df.schema).parquet(out).select("event_type", "win_start", "total", "last_ts")
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("win_start", "last_ts")})


def restart_keyed_reduce(spark: SparkSession, root: str) -> DataFrame:
    """A running reduce over several files that fails once between write and commit, and resumes."""
    runner.enable_state_store(spark)
    out, checkpoint = (shared_dir(spark, p) for p in ("restart", "checkpoint"))
    events = _events(spark, root).select("event_id", "user_id", "c")
    files = replay_files(events, "event_id", 3)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "1").parquet(files)
    folded = processors.running_fold_stream(stream, "user_id", "event_id", "c", "bigint", lambda a, b: a + b)

    def start(attempt: int):  # noqa: ANN202
        def fail(batch: int) -> None:
            if attempt == 0 and batch == 1:
                raise RuntimeError("injected failure")

        writer = folded.writeStream.foreachBatch(sinks.batch_table(out, fail)).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()

    runner.run_with_restarts(start)
    totals = spark.read.schema("user_id bigint, event_id bigint, acc bigint, batch int").parquet(out)
    return totals.groupBy("user_id").agg(F.max_by("acc", F.struct("batch", "event_id")).alias("total"))


_BATCH: list[Query] = [
    tumbling_reduce, map_project, filter_pred, flatmap_tokens, text_pipeline, map_opaque, source_shard, source_replay,
    rebalance_round_robin, sink_threshold, keyed_reduce_running, keyed_reduce_opaque, keyed_reduce_final, wordcount,
    running_max_record, first_record_seed, ordered_fold, value_state_previous, list_state_by_key, map_state_by_key,
    watermark_trace, sliding_reduce, custom_assigner, tumbling_late_drop, sliding_late_drop, late_rows_dropped,
    filter_after_watermark, window_no_timestamps, window_firing_order, last_of_fold, window_ordered_fold, marked_strategy,
    windows_of_windows, keyed_by_expression, partitioned,
]
_STREAMS: list[Query] = [
    stream_text_pipeline, stream_keyed_reduce, stream_keyed_views, stream_tumbling_reduce, stream_sliding_reduce,
    stream_tumbling_late_drop, stream_timers, restart_keyed_reduce, stream_idle_keys, stream_list_groups, stream_window_fold,
    restart_windows, stream_fluent_reduce,
]

_C = "CAST(round(value*100) AS BIGINT)"
_ARR = f"(SELECT *, {_C} AS c, event_id + (event_id*7919)%97 AS arr FROM events)"
_WM = f"(SELECT *, max(ts) OVER (ORDER BY arr, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 HOUR AS wm FROM {_ARR})"
_TOKENS = "(SELECT doc_id, unnest(string_split(text,' ')) AS w FROM documents)"
_HOURS = f"(SELECT *, date_trunc('hour',ts) AS win_start FROM {_WM})"
_SLIDES = f"(SELECT e.*, date_trunc('hour',ts) - r.k*INTERVAL 1 HOUR AS win_start FROM {_WM} e, range(0,3) r(k))"
_OUT = "event_type, win_start, CAST(sum(c) AS BIGINT) AS total, max(ts) AS last_ts"
_RUN = f"CAST(sum({_C}) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS acc"
_USER_SUMS = f"SELECT user_id, CAST(sum({_C}) AS BIGINT) AS total FROM events GROUP BY user_id"
_UPPER = f"SELECT doc_id, upper(replace(w,'ß','ss')) AS w FROM {_TOKENS} WHERE w <> '' AND length(w) > 2"
_TUMBLING = f"SELECT {_OUT} FROM {_HOURS} GROUP BY 1, 2"
_SLIDING = f"SELECT {_OUT} FROM {_SLIDES} GROUP BY 1, 2"
_TUMBLING_LATE = f"SELECT {_OUT} FROM {_HOURS} WHERE wm IS NULL OR win_start + INTERVAL 1 HOUR > wm GROUP BY 1, 2"

ORACLE = {
    "tumbling_reduce": _TUMBLING,
    "map_project": "SELECT l_orderkey, l_linenumber, l_quantity*10 AS q10 FROM lineitem",
    "filter_pred": "SELECT event_id, user_id, value FROM events WHERE value > 20",
    "flatmap_tokens": f"SELECT doc_id, w FROM {_TOKENS} WHERE w <> ''",
    "text_pipeline": _UPPER,
    "map_opaque": "SELECT event_id, length(event_type) AS n FROM events",
    "source_shard": "SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) % 4 AS subtask FROM events WHERE event_type <> 'click'",
    "source_replay": "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE event_type <> 'click') WHERE n > 250",
    "rebalance_round_robin": "SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) % 4 AS channel FROM events",
    "sink_threshold": "SELECT event_id, CASE WHEN value >= 26 THEN 'alert' WHEN value < 26 THEN 'normal' END AS status FROM events",
    "keyed_reduce_running": f"SELECT event_id, user_id, {_RUN} FROM events",
    "keyed_reduce_opaque": f"SELECT event_id, user_id, {_RUN} FROM events",
    "keyed_reduce_final": _USER_SUMS,
    "wordcount": f"SELECT w, count(*) AS n FROM {_TOKENS} WHERE w <> '' GROUP BY w",
    "running_max_record": f"""
        SELECT event_id, user_id, best.event_id AS best_event_id, best.c AS best_c FROM (
          SELECT event_id, user_id, max(struct_pack(c := {_C}, n := -event_id, event_id := event_id)) OVER (
            PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM events)""",
    "first_record_seed": "SELECT user_id, arg_min(event_type,event_id) AS first_type, arg_max(event_type,event_id) AS last_type FROM events GROUP BY 1",
    "ordered_fold": "SELECT user_id, string_agg(substr(event_type,1,1), '' ORDER BY event_id) AS path FROM events GROUP BY 1",
    "value_state_previous": f"SELECT event_id, user_id, lag({_C}) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events",
    "list_state_by_key": "SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS items FROM events GROUP BY 1",
    "map_state_by_key": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "watermark_trace": f"SELECT event_id, max(ts) OVER (ORDER BY arr, event_id ROWS UNBOUNDED PRECEDING) - INTERVAL 2 HOUR AS wm FROM {_ARR}",
    "sliding_reduce": _SLIDING,
    "custom_assigner": f"SELECT event_type, date_trunc('day',ts) AS win_start, CAST(sum({_C}) AS BIGINT) AS total, max(ts) AS last_ts FROM events GROUP BY 1, 2",
    "tumbling_late_drop": _TUMBLING_LATE,
    "sliding_late_drop": f"SELECT {_OUT} FROM {_SLIDES} WHERE wm IS NULL OR win_start + INTERVAL 3 HOUR > wm GROUP BY 1, 2",
    "late_rows_dropped": f"SELECT event_id, win_start FROM {_HOURS} WHERE win_start + INTERVAL 1 HOUR <= wm",
    "filter_after_watermark": f"SELECT {_OUT} FROM {_HOURS} WHERE event_type = 'click' AND (wm IS NULL OR win_start + INTERVAL 1 HOUR > wm) GROUP BY 1, 2",
    "window_no_timestamps": f"SELECT event_type, CAST(sum({_C}) AS BIGINT) AS total FROM events GROUP BY 1",
    "window_firing_order": """
        SELECT event_type, win_end, row_number() OVER (PARTITION BY win_end ORDER BY first_id) AS fire_rank FROM (
          SELECT event_type, date_trunc('hour',ts) + INTERVAL 1 HOUR AS win_end, min(event_id) AS first_id FROM events GROUP BY 1, 2)""",
    "stream_text_pipeline": _UPPER,
    "stream_keyed_reduce": f"SELECT event_id, user_id, {_RUN} FROM events",
    "stream_keyed_views": """
        SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous,
          row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS times FROM events""",
    "stream_tumbling_reduce": _TUMBLING,
    "stream_sliding_reduce": _SLIDING,
    "stream_tumbling_late_drop": _TUMBLING_LATE,
    "stream_timers": "SELECT user_id, epoch_ms(date_trunc('hour',ts)) + 3600000 AS end_ms, count(*) AS n FROM events GROUP BY 1, 2",
    "restart_keyed_reduce": _USER_SUMS,
    "last_of_fold": f"""
        SELECT user_id, list_reduce(list({_C} ORDER BY event_id), lambda a, x: (a * 31 + x) % 1000003) AS digest FROM events GROUP BY 1""",
    "window_ordered_fold": f"""
        SELECT event_type, win_start, ',' || string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY arr, event_id) AS users
        FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS win_start FROM {_WM})
        WHERE wm IS NULL OR win_start + INTERVAL 6 HOUR > wm GROUP BY 1, 2""",
    "marked_strategy": f"""
        SELECT {_OUT} FROM (SELECT *, date_trunc('hour', ts) AS win_start, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (
          ORDER BY arr, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM {_ARR})
        WHERE wm IS NULL OR win_start + INTERVAL 1 HOUR > wm GROUP BY 1, 2""",
    "windows_of_windows": f"""
        SELECT upper(event_type) AS kind, date_trunc('day', h) AS win_start, max(total) AS best FROM (
          SELECT event_type, date_trunc('hour', ts) AS h, CAST(2 * sum({_C}) AS BIGINT) AS total FROM events GROUP BY 1, 2)
        WHERE total > 0 GROUP BY 1, 2""",
    "keyed_by_expression": f"SELECT event_id, CAST(sum({_C}) OVER (PARTITION BY user_id % 7, event_type ORDER BY event_id) AS BIGINT) AS acc FROM events",
    "partitioned": "SELECT event_id, user_id % 3 AS channel FROM events",
    "stream_idle_keys": "SELECT user_id, epoch_us(max(ts)) // 1000 + 365 * 86400000::BIGINT AS end_ms, count(*) AS n FROM events GROUP BY 1",
    "stream_list_groups": """
        SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS items FROM (
          SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS g FROM events)
        GROUP BY user_id, g HAVING count(*) = 10""",
    "stream_window_fold": """
        SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS win_start,
          ',' || string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM events GROUP BY 1, 2""",
    "restart_windows": _TUMBLING,
    "stream_fluent_reduce": f"SELECT event_id, user_id, {_RUN} FROM events WHERE value > 20",
}


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in [*_BATCH, *_STREAMS]}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
