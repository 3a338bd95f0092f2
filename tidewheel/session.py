"""Session helpers: the shared scratch folder and the session streams run in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets a temporary folder
    that is remembered in the session.
    """
    root = spark.conf.get(CHECKPOINT_SETTING, None) or spark.conf.get(
        "spark.tidewheel.scratch", None
    )
    if root:
        if root.startswith("file:") and not is_local(spark):
            raise RuntimeError(f"{root} is not shared: set {CHECKPOINT_SETTING}")
        return root.rstrip("/")
    if not is_local(spark):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
    root = tempfile.mkdtemp(prefix="tidewheel-")
    spark.conf.set("spark.tidewheel.scratch", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; nothing is ever reused or deleted."""
    return f"{scratch_root(spark)}/tidewheel/{label}-{uuid.uuid4().hex}"


def streaming_session(spark: SparkSession) -> SparkSession:
    """A sibling session for streaming queries, so the caller's is left as it is.

    State lives in RocksDB with changelog checkpoints: it may outgrow executor
    memory, and every commit goes to the query's checkpoint folder, from which a
    lost executor's state is rebuilt. The number of state partitions is fixed by a
    query's first run, so on a cluster it follows the caller's setting.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if is_local(spark):
        partitions = min(partitions, spark.sparkContext.defaultParallelism)
    scratch = scratch_root(spark)
    session = spark.newSession()
    for key, value in {
        "spark.sql.shuffle.partitions": partitions,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql."
        "execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }.items():
        session.conf.set(key, str(value))
    if session.conf.get(CHECKPOINT_SETTING, None) is None:
        session.conf.set("spark.tidewheel.scratch", scratch)
    return session
