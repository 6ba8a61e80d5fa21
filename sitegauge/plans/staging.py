"""Intermediate tables and skew-proof joins shared by the operators.

Intermediate results that are read more than once are written as Parquet below the folder named by
``spark.checkpoint.dir``, which all executors share, so a lost executor costs nothing but its running
tasks. Where the setting is missing a folder is chosen only on a local master, as in tests.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot when it holds at least this share of the rows; at most 1/share keys can.
HOT_SHARE = 1e-3
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; one is set only on a local master that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="sitegauge-")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    _made.append((spark, f"file://{made}"))
    return f"file://{made}"


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of it: lineage ends here.

    Results are read lazily, so what a query staged must outlive it; ``drop_staged`` removes it, and so does the
    end of the process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


class StagedParts:
    """A table that grows by parts, each written once; all parts read as one scan."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.schema, self.parts = spark, f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}", None, 0
        _made.append((spark, self.root))

    def add(self, df: DataFrame) -> DataFrame:
        """Write a part and return a reader of it."""
        path = f"{self.root}/{self.parts}"
        df.write.option("compression", "zstd").parquet(path)
        self.schema, self.parts = df.schema, self.parts + 1
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{k}" for k in range(self.parts)))


@atexit.register
def drop_staged() -> None:
    """Delete all staged tables made so far; to be called between queries of a long session."""
    while _made:
        spark, path = _made.pop()
        try:
            jvm = spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session is gone; the folder is the cluster's to clean
            return


def join_by_group(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int, share: float = HOT_SHARE) -> DataFrame:
    """Inner join of ``rows`` with one row per key in ``groups``, safe where one key holds most rows.

    ``groups`` has the number of its rows in column ``count`` (dropped from the result). Keys with at
    least ``share`` of ``total`` rows number at most ``1 / share``, so broadcasting just those
    is bounded whatever the input; their rows are joined where they lie. All others take a shuffled
    join in which no key is hot. Both inputs must be cheap to read twice. Null keys match nothing.
    """
    bound = max(1, int(total * share))
    hot = groups.filter(F.col(count) >= bound).drop(count)
    cold = groups.filter(F.col(count) < bound).drop(count)
    hot_rows = rows.join(F.broadcast(hot), keys)
    cold_rows = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return hot_rows.unionByName(cold_rows)


#: Bytes of input below which a few files may be too few tasks.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """Small inputs of a few files dealt out to all cores, since a small file is often one row group, hence one task.

    For what comes before work in Python. Large inputs have tasks enough, and there texts never move.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size < SPREAD_BYTES and len(df.inputFiles()) < cores else df


#: Rows up to which a table counts as small.
SMALL = 1_000_000


def join_small(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with a table of one narrow row per key: broadcast if it has at most ``SMALL`` rows.

    Beyond that the join is a shuffled one whose hot keys adaptive execution splits (those of ``rows`` can be
    split in a left join).
    """
    table = staged(table)
    small = table.limit(SMALL + 1).count() <= SMALL
    return rows.join(F.broadcast(table) if small else table, keys, "left")
