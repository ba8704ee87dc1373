import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import frames


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_bloom_filter_holds_its_keys_in_both_forms(spark, n):
    made = frames.bloom(spark.range(n).select(F.xxhash64("id")))
    rows = spark.range(n + 5000).select("id", F.xxhash64("id").alias("k"))
    got = rows.withColumn("maybe", made.column(F.col("k"))).orderBy("id").toPandas()
    assert got["maybe"][:n].all()
    assert got["maybe"][n:].mean() < 0.02
    assert (made.array(got["k"].to_numpy(np.int64).view(np.uint64)) == got["maybe"].to_numpy(bool)).all()
    nulls = spark.sql("SELECT CAST(NULL AS BIGINT) AS k").select(made.column(F.col("k")).alias("m")).first().m
    assert nulls is False


def test_few_other_keys_seem_to_be_in_a_bloom_filter(spark):
    made = frames.bloom(spark.range(32_000).select(F.xxhash64("id")))
    others = np.random.default_rng(5).integers(0, 1 << 63, 200_000).astype(np.uint64)
    assert made.array(others).mean() < 0.0006


def test_bloom_filters_take_little_of_the_drivers_memory(spark):
    import tracemalloc

    keys = spark.range(600_000).select(F.xxhash64("id"))
    tracemalloc.start()
    made = frames.bloom(keys)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(made.bitmap) == frames.MOST_BITS // 8
    assert most < 40_000_000


def test_plans_do_not_spell_bitmaps_out(spark):
    made = frames.bloom(spark.range(50_000).select(F.xxhash64("id")))
    assert len(made.bitmap) >= 100_000
    plan = spark.range(10).filter(made.column(F.xxhash64("id")))._jdf.queryExecution().toString()
    assert len(plan) < 20_000


def test_discarded_tables_are_gone(spark):
    table = frames.cut(spark.range(3), "some")
    assert table.count() == 3
    frames.discard(table)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(table.cut_path)


def test_clusters_need_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: None)
    assert frames.shared_path(spark, "x").startswith("/tmp/")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(ValueError, match="checkpoint"):
        frames.shared_path(spark, "x")
