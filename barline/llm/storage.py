"""Intermediate tables in the run's shared folder, and connected components over them."""

import atexit

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import run_folder

#: Ids that a partition's links are reduced over at a time.
FOREST = 1_000_000
_made: list = []


def _remove_made() -> None:
    for fs, path in _made:
        try:
            fs.delete(path, True)
        except Exception:  # the session has gone already; its folder is left to the cluster's owner
            return


def stored(df: DataFrame) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back.

    Cuts the lineage at a copy that outlives lost executors. Folders are removed when the driver
    ends, as the result may still be lazy when the job's function returns.
    """
    spark = df.sparkSession
    folder = run_folder(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not _made:
        atexit.register(_remove_made)
    _made.append((path.getFileSystem(spark._jsc.hadoopConfiguration()), path))
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def _forest(batches):
    """Links of a partition to the links of its own components' members to their smallest ids."""
    up: dict[int, int] = {}

    def top(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
        if len(up) > FOREST:
            yield _pairs(up, top)
            up.clear()
    yield _pairs(up, top)


def _pairs(up, top):
    found = [(top(x), x) for x in list(up) if top(x) != x]
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id of the undirected `links` (a, b): root is its component's smallest id.

    Partitions first reduce their links to forests, in pieces of bounded size. Then every id points
    to its smallest smaller neighbour, pointers are followed to their roots, links are rewritten to
    roots, and so on until no link joins two roots. Rounds follow the logarithm of a component's
    size; no component meets in one task.
    """
    edges = stored(links.where("a <> b").select("a", "b").mapInArrow(_forest, "a bigint, b bigint").distinct())
    roots = None
    while True:
        parent = stored(edges.groupBy("b").agg(F.min("a").alias("up")).select(F.col("b").alias("id"), "up"))
        while True:
            above = parent.select(F.col("id").alias("up"), F.col("up").alias("top"))
            joined = parent.join(above, "up", "left")
            if joined.where("top IS NOT NULL").isEmpty():
                break
            parent = stored(joined.select("id", F.coalesce("top", "up").alias("up")))
        if roots is None:
            roots = parent.select("id", F.col("up").alias("root"))
        else:
            joined = roots.join(parent.withColumnRenamed("id", "root"), "root", "full")
            roots = stored(joined.select(F.coalesce("id", "root").alias("id"), F.coalesce("up", "root").alias("root")))
        a = parent.select(F.col("id").alias("a"), F.col("up").alias("ua"))
        b = parent.select(F.col("id").alias("b"), F.col("up").alias("ub"))
        moved = edges.join(a, "a", "left").join(b, "b", "left").select(
            F.coalesce("ua", "a").alias("a"), F.coalesce("ub", "b").alias("b")
        )
        left = moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        if left.isEmpty():
            break
        edges = stored(left.distinct())
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root")).distinct()
