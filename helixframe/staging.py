"""Tables written in the folder that all executors share, so that work is done once and survives a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir).

    Where it is unset a temporary folder is chosen, but only for a local master: on a cluster
    a machine-local folder would be invisible to the other executors.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="helixframe-")
    return _local[app]


def stage(df: DataFrame, what: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage in files that survive the loss of any executor.  The files are removed
    when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)
