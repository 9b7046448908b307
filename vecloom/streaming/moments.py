"""Moments of a stream of vectors: every micro-batch adds its partial sums to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import schema
from ..operators.moments import Moments, collected, combined, partial


def accumulate(stream: DataFrame, table: str, checkpoint: str, vector: str = "embedding") -> StreamingQuery:
    """Start a query that writes each batch's sums to `table` (parquet), under the batch's number.

    A batch that runs again after a failure overwrites its own folder, so it counts once.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = schema.checked(schema.vectors(batch, schema.Columns(vector, batch.columns[0], None))) if not batch.isEmpty() else None
        if rows is not None:
            combined(partial(rows)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, table: str) -> Moments:
    """The moments of all batches so far."""
    return collected(spark.read.parquet(table).drop("batch"))


def windowed_norms(stream: DataFrame, time: str, vector: str, width: str, late: str) -> DataFrame:
    """(window, n, norm_mean): lengths by event time; rows later than `late` are left out."""
    from ..functions import vec

    return stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("n"), F.avg(vec.norm(vec.doubles(F.col(vector)))).alias("norm_mean"))
