"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # remove reliable-checkpoint files once their datasets are out of scope
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "demand_engine", extra_conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on, UTC time zone and no UI.

    ``spark.checkpoint.dir`` is taken from the Spark configuration; on a
    cluster it names shared storage.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_SESSION_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` (shared storage on a
    cluster). It is read, never replaced; without it the caller cannot go on."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None and configured:
        sc.setCheckpointDir(configured)
    current = configured or sc.getCheckpointDir()
    if not current:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return current.rstrip("/")


def write_once(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: later uses neither
    repeat the work before it nor depend on an executor that held it. The
    files are removed when the application ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/frame-{uuid.uuid4().hex}"
    df.write.partitionBy(*(partition_by or [])).parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)
