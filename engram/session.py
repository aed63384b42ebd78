"""Session settings and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: State of the stateful streams; a session setting, so that other streams keep theirs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cpus: int | str = "*", app: str = "engram", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    parts = "8" if cpus == "*" else str(cpus)
    return (builder.config("spark.sql.shuffle.partitions", parts)
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", memory)
            .getOrCreate())


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Only a local session may fall back to a folder of its own; a cluster without the
    setting is an error, since a machine-local folder would not survive an executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="engram-")
    return _local_folders[context.applicationId]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a result that several jobs read (reliable checkpoint)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(os.path.join(shared_folder(spark), "lineage"))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Materialise a wide or large result as a Parquet table of the shared folder.

    It takes a fraction of a checkpoint's bytes, and readers take only the columns they name."""
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), "stages", uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
