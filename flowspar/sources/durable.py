"""Intermediate tables that outlive executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local session gets a temporary one; a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="flowspar-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_written: list[tuple[SparkSession, str]] = []


def place(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is deleted at the end of the program."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def durable(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, which ends its lineage."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return unsent(df.sparkSession.read.schema(df.schema).parquet(path))


def unsent(df: DataFrame) -> DataFrame:
    """df, which the next join doesn't broadcast: Spark would go by the size of the compressed files, and tables that grow with
    the input would go through the driver."""
    return df.hint("merge")


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by ``durable`` that nothing lazy reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM is gone: the folder's owner cleans up
            return


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows (it reads no more than that plus one)."""
    return df.limit(rows + 1).count() <= rows
