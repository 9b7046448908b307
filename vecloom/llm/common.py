"""What the operators of this subpackage share: reading, durable tables, numbering."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows and bytes of text in one Arrow batch; a batch is what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes, so that long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_tables: dict[str, dict] = {}


def worker_tables(operator: str) -> dict:
    """What tasks of an operator keep in a Python worker for the next ones."""
    return _tables.setdefault(operator, {})


def turn_to(operator: str | None = None) -> None:
    """For the begin of a task in a Python worker: tables that other operators left there go, and free memory with them."""
    gone = [own for name, own in _tables.items() if name != operator and own]
    for own in gone:
        own.clear()
    if gone:
        give_back()


def give_back() -> None:
    """Return a worker's free memory to the system, as its next task may be another operator's."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where it is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"vecloom-{os.getuid()}-{os.getpid()}")
    return named.rstrip("/")


#: Whether the shuffle files of a query go once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage like checkpoint() but computes df once. The files outlive any
    executor; they go when the driver ends, or earlier by discard(). The shuffle files of the
    writing go at its end: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _written.add(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._vecloom_path = path
    return out


_written: set[str] = set()


def _delete(path: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _written.discard(path)


def discard(df: DataFrame | None) -> None:
    """Delete the files of a table of materialize() that nothing needs any more."""
    path = getattr(df, "_vecloom_path", None)
    if path:
        _delete(path)


@atexit.register
def _delete_all() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  the JVM may be gone; the folder's owner then cleans it
            return


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def number(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Number the rows of each group, gapless from 0, without one task per group.

    df: a table of materialize(). A row is named by its file and its place there, so repeated rows
    are spread like any others, and a task that runs again meets the same names. Rows go to slices
    by the hash of their names; each slice of a group is numbered alone, by `order`, and starts where
    the slices before it end. df is read twice.
    """
    slices = parts(df.sparkSession)
    named = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sliced = named.withColumn("_slice", F.pmod(F.xxhash64("_file", "_row"), F.lit(slices)).cast("int"))
    key = [*group, "_slice"]
    sizes = sliced.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint"))).drop("_n")
    own = Window.partitionBy(*key).orderBy(*order, "_file", "_row")
    numbered = sliced.withColumn("_own", F.row_number().over(own).cast("bigint") - 1).drop("_file", "_row")
    return numbered.join(starts, key).withColumn(out, F.col("_own") + F.col("_start")).drop("_slice", "_own", "_start")


def sized(df: DataFrame, most: int = 50_000) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows; give a materialized table of narrow rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: The columns by which named() names a row.
PLACE = ("_vecloom_file", "_vecloom_at")


def named(docs: DataFrame) -> DataFrame:
    """docs with the columns PLACE, longs that name a row: a hash of its file's path and its place there.

    Documents that don't come from Parquet files are written first.
    """
    from pyspark.errors import AnalysisException

    def names(df: DataFrame) -> DataFrame:
        return df.withColumns(dict(zip(PLACE, (F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")), strict=True)))

    try:
        return names(docs)
    except AnalysisException:
        return names(materialize(docs))


def free_name(wanted: str, taken: list[str]) -> str:
    """wanted, with underscores until no column of that name is there."""
    while wanted.lower() in {c.lower() for c in taken}:
        wanted += "_"
    return wanted


def unsigned_hex(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 16, "0")
