"""Session settings and the shared work folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job of the library wants. Sizes are left to the cluster: AQE
# coalesces small shuffle partitions, splits skewed ones and turns joins into
# broadcasts only after it has measured the small side.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Stream state lives on disk, not in the executors' heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(
    app_name: str = "tillbook",
    master: str | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediates, readable by every executor.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    go without; it gets a fresh folder below /tmp.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_folders:
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
        _local_folders[context.applicationId] = folder
    return _local_folders[context.applicationId]


def work_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; never reused between calls.

    All paths of an application share one folder, which can go when it ends.
    """
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, freezes anything that depends on physical partitioning, and
    gives the planner the true size, so a later join broadcasts it only when it
    measures below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written copies that one job needs only until its result is written; they go together."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder, self.count = spark, work_path(spark, label), 0

    def written(self, df: DataFrame, label: str) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}-{label}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Remove the copies; nothing that is still to be computed may read them."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
