"""Tables written to the shared folder, where a lineage is cut."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder in that of spark.checkpoint.dir; in one of our own only where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), f"vecloom-{os.getuid()}-{os.getpid()}")
    path = f"{at.rstrip('/')}/kept-{uuid.uuid4().hex}"
    _made.add(path)
    return path


def kept(df: DataFrame) -> DataFrame:
    """Write df to a folder() and read it back; the files go when the driver ends."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files(df: DataFrame) -> list[str]:
    """Write df to a folder(); the names of its files, for tasks that read them by opened()."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(f.getPath().toString() for f in found if f.getPath().getName().startswith("part-"))


def opened(name: str):
    """One of files(), in a task."""
    from pyarrow import fs

    if name.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + name.removeprefix("file:").lstrip("/"))
    system, path = fs.FileSystem.from_uri(name)
    return system.open_input_file(path)


_made: set[str] = set()


@atexit.register
def _delete_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_made) if spark is not None else []:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the JVM may be gone; the folder's owner then cleans it
            return
