"""Tables written between the steps of one query.

What several rules read is computed once, written to the folder all executors
share (``spark.checkpoint.dir``) and read again: the lineage ends there, so a
lost executor costs no recomputation of what came before.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; one of our own only where none is set and all
    executors are on this machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    try:
        found = spark.conf.get("spark.checkpoint.dir") or found
    except Exception:  # an unset key raises
        pass
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table and read it again; it is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        sc = spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended before us
        pass
