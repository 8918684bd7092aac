"""Session settings and the shared folder that jobs may write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # top-N per key is cut down before the shuffle up to this N
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
    # keeps the state of large streams off the heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # rewriting one batch of a log must leave the other batches alone
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


# bytes of input per shuffle partition
PARTITION_BYTES = 256 * 1024 * 1024


def shuffle_partitions(input_bytes: int) -> int:
    """Partitions to start from for an input; adaptive execution joins the small ones."""
    return max(8, -(-input_bytes // PARTITION_BYTES))


def build_session(
    app_name: str = "marketlens", master: str | None = None, input_bytes: int | None = None, **conf
) -> SparkSession:
    """A session with the engine's settings.

    ``input_bytes`` is the size of the largest table the job reads; the number
    of shuffle partitions follows from it. ``conf`` takes further settings with
    ``__`` written for ``.``, so ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in ENGINE_CONF.items():
        builder = builder.config(name, value)
    if input_bytes is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions(input_bytes)))
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; on a
    cluster a machine-local folder would lose data with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
        return root.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="marketlens-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path for one run below the shared folder."""
    return f"{shared_root(spark)}/marketlens/{purpose}-{uuid.uuid4().hex}"
