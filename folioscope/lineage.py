"""Where loops cut their lineage: tables in the checkpoint folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir; only a local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not context.isEmpty():
            return context.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        if "own" not in _FOLDER:
            _FOLDER["own"] = tempfile.mkdtemp(prefix="tables-")
        named = _FOLDER["own"]
    return named.rstrip("/")


_FOLDER: dict[str, str] = {}
#: Application folders that are marked for removal at the end of the driver.
_MARKED: set[str] = set()


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def new_table(spark: SparkSession) -> str:
    """A name for a table among the application's own, which go when the driver ends."""
    home = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    if home not in _MARKED:
        files, path = _path(spark, home)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _MARKED.add(home)
    return f"{home}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read from there: nothing is lost with an executor.

    A checkpoint would carry its plan's partitionings and orderings on, whose number doubles with each join
    of a loop; a table carries only its size.  The application's tables go when the driver ends; ``discard`` removes
    one earlier.
    """
    spark = df.sparkSession
    where = new_table(spark)
    df.write.parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out._table = where
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``cut`` that nothing will read again; other frames are left alone."""
    for t in tables:
        if where := getattr(t, "_table", None):
            files, path = _path(t.sparkSession, where)
            files.delete(path, True)
