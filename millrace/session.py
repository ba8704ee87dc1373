"""Session defaults shared by tests, the bench and applications."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(name: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` overrides any default (dots as `__`)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors see.

    Only on one machine may that setting be missing; a local folder does there. On a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not context_dir.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = context_dir.get() if context_dir.isDefined() else "/tmp/millrace"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
