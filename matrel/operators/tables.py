"""Operators over keyed tables in observation form."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A


def unary(obs: DataFrame, op: str, arg: float = 1.0) -> DataFrame:
    return obs.withColumn("x", A.UNARY[op](F.col("x"), arg))


def _single(obs: DataFrame) -> DataFrame:
    """(key, x1): the row of keys that have only one."""
    one = obs.groupBy("key").agg(F.count("*").alias("n"), F.first("x").alias("x1"))
    return one.where("n = 1").drop("n")


def pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, obs, a, b) by key and row; a record of one row goes with every row of the other's."""
    both = left.withColumnRenamed("x", "a").join(right.withColumnRenamed("x", "b"), ["key", "obs"], "full_outer")
    both = both.join(_single(left).withColumnRenamed("x1", "a1"), "key", "left").join(_single(right).withColumnRenamed("x1", "b1"), "key", "left")
    return both.select("key", "obs", F.coalesce("a", "a1").alias("a"), F.coalesce("b", "b1").alias("b"))


def binary(left: DataFrame, right: DataFrame, op: str) -> DataFrame:
    """Element-wise with broadcasting of one row, one column or both; keys that are not in both tables are left out."""
    both = pair(left, right).where("a is not null and b is not null")
    return both.select("key", "obs", A.binary(op, F.col("a"), F.col("b")).alias("x"))


def concatenate(tables: Sequence[DataFrame], add_one: bool = False) -> DataFrame:
    """Features of all tables side by side by key and row; add_one appends a constant 1."""
    def two(left: DataFrame, right: DataFrame) -> DataFrame:
        return pair(left, right).where("a is not null and b is not null").select("key", "obs", F.concat("a", "b").alias("x"))

    out = reduce(two, tables)
    return out.withColumn("x", F.concat("x", F.array(F.lit(1.0)))) if add_one else out


def linear(obs: DataFrame, projection, offset=None) -> DataFrame:
    return obs.withColumn("x", A.affine(F.col("x"), projection, offset))


ROLLUPS = {
    "mean": lambda v: F.avg(v),
    "variance": lambda v: F.greatest(F.lit(0.0), F.var_pop(v)),
    "stdev": lambda v: F.stddev_pop(v),
    "skewness": lambda v: F.skewness(v),
    "kurtosis": lambda v: F.kurtosis(v),
    "sum": lambda v: F.sum(v),
    "sum-squared": lambda v: F.sum(v * v),
    "max": lambda v: F.max(v),
    "min": lambda v: F.min(v),
    "count": lambda v: F.count(v).cast("double"),
}


def roll_up(obs: DataFrame, op: str, index: DataFrame | None = None) -> DataFrame:
    """Observations of each record by an index table (key, obs, idx), or the whole record without one: one row for each
    index from 0 to the record's greatest, zeros where an index has no observation. An observation without index is an
    error, as sizes must match."""
    indexed = obs.withColumn("idx", F.lit(0)) if index is None else obs.join(index.select("key", "obs", "idx"), ["key", "obs"], "left")
    indexed = indexed.withColumn("idx", F.coalesce("idx", F.raise_error(F.concat(F.lit("no index for "), F.col("key"))).cast("int")))
    cell = indexed.select("key", "idx", F.posexplode("x").alias("feat", "v"))
    found = cell.groupBy("key", "idx", "feat").agg(ROLLUPS[op](F.col("v")).alias("v"))
    rows = found.groupBy("key", "idx").agg(F.array_sort(F.collect_list(F.struct("feat", "v"))).alias("c")).select("key", "idx", F.col("c.v").alias("x"))
    size = indexed.groupBy("key").agg(F.max("idx").alias("last"), F.max(F.size("x")).alias("d"))
    dense = size.select("key", "d", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("obs"))
    return dense.join(rows.withColumnRenamed("idx", "obs"), ["key", "obs"], "left").select("key", "obs", F.coalesce("x", F.array_repeat(F.lit(0.0), F.col("d"))).alias("x"))


def encode_codebook(obs: DataFrame, codebook: Sequence[Sequence[float]], mode: str = "exact") -> DataFrame:
    """Index of the codebook row: exact (-1 if none), nearest-L2 or nearest-L1; the first of equal ones. The codebook is a
    literal, so there is no join."""
    x = F.col("x")
    distance = {"exact": A.l1_distance, "nearest-L2": A.squared_distance, "nearest-L1": A.l1_distance}[mode]
    d = F.array(*(distance(x, A.constant(row)) for row in codebook))
    at = A.argmin(d)
    if mode == "exact":
        at = F.when(F.array_min(d) == 0, at).otherwise(-1)
    return obs.withColumn("x", F.array(at.cast("double")))


def decode_codebook(obs: DataFrame, codebook: Sequence[Sequence[float]]) -> DataFrame:
    """Codebook row of an index, or of the greatest of several scores; an index out of range gives the last row."""
    table = F.array(*(A.constant(row) for row in codebook))
    at = F.when(F.size("x") == 1, F.element_at("x", 1).cast("int")).otherwise(A.argmax(F.col("x")))
    return obs.withColumn("x", F.element_at(table, F.when((at >= 0) & (at < len(codebook)), at + 1).otherwise(len(codebook))))


def update_missing(source: DataFrame, done: DataFrame, compute) -> DataFrame:
    """Output brought up to date: compute runs for the keys of source that done lacks."""
    return done.unionByName(compute(source.join(done.select("key").distinct(), "key", "left_anti")))


def key_union(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [t.select("key") for t in tables]).distinct()


def with_target(obs: DataFrame, target: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """obs with (label, weight): rows without target go, weights default to 1."""
    out = obs.join(target, ["key", "obs"])
    return out.withColumn("weight", F.lit(1.0)) if weights is None else out.join(weights, ["key", "obs"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def known(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows whose label is not unknown (negative or null)."""
    return df.where(F.col(label) >= 0)
