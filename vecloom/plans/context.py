"""What queries over one table share: its unit vectors, its pair draw and its neighbour graphs, computed once.

They are kept by the table's path and the state of its files, in Spark's storage (memory, then disk): what
is lost with an executor, or cleared, is computed anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..config import Config
from ..operators import crowding, neighbours, sampling
from ..operators.moments import Moments, moments
from .registered import DRAWS, raw, unit

#: Settings of the folders that a report made, by path.
given: dict[str, Config] = {}
#: Numbers of neighbours of the graphs that are kept; a query takes the first of one that has enough.
LEVELS = (10, 50, 200)
SIGMA = 0.3
_kept: dict[tuple, object] = {}


def state(spark: SparkSession, sf_dir: str, table: str = "embeddings") -> tuple:
    """The path of a table with the bytes and times of its files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return (spark.sparkContext.applicationId, str(path), *((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files.listStatus(path)))


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]) -> object:
    """make(), or what it gave before for the same files; tables are persisted."""
    key = (name, *state(spark, sf_dir))
    if key not in _kept:
        for old in [k for k in _kept if k[:3] == key[:3] or k[1] != key[1]]:  # of files that changed, or another application
            got = _kept.pop(old)
            if isinstance(got, DataFrame) and old[1] == key[1]:
                got.unpersist()
        got = make()
        _kept[key] = got.persist(StorageLevel.MEMORY_AND_DISK) if isinstance(got, DataFrame) else got
    return _kept[key]


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "units", lambda: unit(spark, sf_dir))


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of DRAWS pairs of all rows, or as many as the folder's settings say."""
    pairs = given[sf_dir].pairs if sf_dir in given else DRAWS
    return once(spark, sf_dir, "drawn", lambda: sampling.pair_cosines(units(spark, sf_dir), pairs).coalesce(8))


def graph(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The k nearest of every row, in blocks over all rows."""
    level = next((n for n in LEVELS if n >= k), k)
    if sf_dir in given and given[sf_dir].metric == "euclidean":
        return once(spark, sf_dir, f"far{level}", lambda: neighbours.euclidean_graph(raw(spark, sf_dir), level)).where(f"rank <= {k}")
    return once(spark, sf_dir, f"graph{level}", lambda: neighbours.graph(units(spark, sf_dir), level)).where(f"rank <= {k}")


def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, collisions) of every row under noise of width SIGMA, over all pairs."""
    return once(spark, sf_dir, "collisions", lambda: crowding.item_collisions(units(spark, sf_dir), SIGMA))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def fit(spark: SparkSession, sf_dir: str, of_units: bool = False) -> Moments:
    """The moments of the vectors as given, or at unit length."""
    return once(spark, sf_dir, f"fit{of_units}", lambda: moments(units(spark, sf_dir) if of_units else raw(spark, sf_dir)))


def shape(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Rows and dimensions."""
    m = fit(spark, sf_dir)
    return m.n, m.dim
