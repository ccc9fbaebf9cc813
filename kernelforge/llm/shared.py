"""Tables in the shared folder, and checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset on a local master, as in tests."""
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


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: the lineage ends here, on files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    gc.collect()
    spark._jvm.System.gc()  # lets Spark delete the shuffle files that the table replaces
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which a side of a join counts as small; a row here has a few numbers, so this is under 64 MB.
BROADCAST_ROWS = 500_000


def join_small(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join, broadcasting ``right`` (a written table) only if its counted rows are few; else an ordinary shuffled join."""
    n = right.limit(rows + 1).count()
    return left.join(F.broadcast(right) if n <= rows else right, on, how)



def append_column(df: DataFrame, into: str, ddl: str, make: Callable[[], Callable[[pa.RecordBatch], pa.Array]]) -> DataFrame:
    """df with a column ``into`` (replacing one of that name) that ``make()``'s function computes from Arrow batches.

    make runs once a task; every other column passes through untouched.
    """
    df = df.drop(into)
    schema = T.StructType([*df.schema.fields, T.StructField(into, T._parse_datatype_string(ddl))])
    kind = to_arrow_type(schema[into].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, f(batch).cast(kind)], [*batch.schema.names, into])

    return df.mapInArrow(run, schema)
