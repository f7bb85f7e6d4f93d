"""Tables written to the folder that the cluster shares: what several plans read is worked out once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode a temporary one where none is set."""
    named = spark.sparkContext.getConf().get(CONF) or spark.conf.get(CONF, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CONF} must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set(CONF, named)
    return named.rstrip("/")


#: Paths of the tables written so far.
WRITTEN: list[str] = []


def modified(spark: SparkSession, path: str) -> int | None:
    """When a file or folder was last changed, in milliseconds; None if it isn't there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return files.getFileStatus(target).getModificationTime() if files.exists(target) else None


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, which goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)
