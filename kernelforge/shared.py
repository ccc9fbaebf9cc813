"""Tables in the shared folder: lineage ends on files that outlive executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Of writes: the job's mark of success is left out.
UNMARKED = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kernelforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _drop() -> None:
    for spark, path in _made:
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the JVM may have gone first
            return


atexit.register(_drop)


def written(df: DataFrame, per_file: int = 0) -> DataFrame:
    """df from a Parquet table of its own, which goes when the process ends; per_file: most rows of a file (0: any number)."""
    path = f"{shared_dir(df.sparkSession)}/core-{uuid.uuid4().hex}"
    # No mark of success: for each the driver would start a process that sets the file's mode.
    df.write.options(maxRecordsPerFile=per_file, **UNMARKED).parquet(path)
    _made.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables that are written part by part; it goes when the process ends."""
    path = f"{shared_dir(spark)}/core-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def spread(df: DataFrame, *by: str, least: int = 1) -> DataFrame:
    """df dealt by keys to as many partitions as the session names (``least`` at least), however few bytes it has: for rows that are much work each, which adaptive execution would put together."""
    return df.repartition(max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)
