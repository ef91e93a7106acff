"""A folder for files that a query writes and reads back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder that driver and executors share, ``spark.checkpoint.dir``.

    Only a session in one JVM may leave that unset.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/work/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that all who read it see the same rows.

    The job runs when this is called, not when the result is read.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` gave; nothing may read it afterwards."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(folder)
        if "/work/" not in folder:
            raise ValueError(f"{folder} is no table of this session's own")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
