"""Tables written between steps, in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where a local session names none, a temporary folder of its own.

    On a cluster a folder of the driver's machine would lose what executors write, so a
    session without the setting is an error there.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.orebody.scratch", None)
    if not shared:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-orebody-")
        spark.conf.set("spark.orebody.scratch", shared)
    return shared.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """The folder of this session's tables below the shared one."""
    return f"{root(spark)}/orebody-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder for one table."""
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write and read back: cuts lineage, and survives executors that are lost."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> bool:
    """Delete this session's tables; frames that were read from them are void. False where there were none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
