"""Helpers shared by the training-data operators: shared storage and connected components."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path, shared_dir

#: Word separators fixed by the operator contracts: ASCII white space.
ASCII_SPACE = "\\x20\\x09-\\x0D"


def release() -> None:
    """Give freed memory of this Python worker back to the machine; workers stay alive between tasks of other kinds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table of a data folder; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there and no lost executor loses it."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _forest(batches):
    """Union-find over one partition of edges; gives a star to the smallest member for each local component."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while (up := parent[x]) != root:
            parent[x] = root
            x = up
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["u", "v"]
        )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (two long columns): one row (node, component) for each node that has
    an edge to another node; component is the smallest id reachable.

    Alternating large-star and small-star rounds, O(log n) of them: each takes the least neighbour by a partially
    aggregated groupBy and joins it back (a join that AQE splits if one node is hot). Nothing is collected but the two
    numbers that tell convergence; lineage is cut by checkpoint() in the shared folder. Null ends and loops are left
    out; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e = e.mapInArrow(_forest, "u long, v long").distinct().checkpoint()
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every edge (u, v) below has v < u
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v")
        e = small.distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.col("m").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
