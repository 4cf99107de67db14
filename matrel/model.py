"""The data model: keyed records of N x D matrices, in the forms the operators exchange.

Observation form: (key STRING, obs INT, x ARRAY<DOUBLE>), one row for each matrix row. Cell form: (key, obs, feat, v).
Factor form: one INT column x<i> for each variable and val DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions.hashing import dealt


def observations(df: DataFrame, key: str, features: list[str] | str, order: list[str] | None = None) -> DataFrame:
    """Observation form; order tells the rows of a key apart (row_number, as no id column is trusted to be dense)."""
    x = F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*(F.col(c).cast("double") for c in features))
    obs = (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) if order else F.lit(0)
    return df.select(F.col(key).cast("string").alias("key"), obs.cast("int").alias("obs"), x.alias("x"))


def cells(obs: DataFrame) -> DataFrame:
    return obs.select(*(c for c in obs.columns if c != "x"), F.posexplode("x").alias("feat", "v"))


def from_cells(cell: DataFrame) -> DataFrame:
    rows = cell.groupBy("key", "obs").agg(F.array_sort(F.collect_list(F.struct("feat", "v"))).alias("c"))
    return rows.select("key", "obs", F.col("c.v").alias("x"))


def records(obs: DataFrame) -> DataFrame:
    """Packed form (key, structure, data): a key's matrix as one row."""
    rows = obs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("obs", "x"))).alias("r"))
    return rows.select("key", F.array(F.size("r")).alias("structure"), F.col("r.x").alias("data"))


def from_records(rec: DataFrame) -> DataFrame:
    return rec.select("key", F.posexplode("data").alias("obs", "x"))


def check_dimension(obs: DataFrame) -> DataFrame:
    """obs, with an error at run time where the vectors of a key differ in size."""
    first = F.first(F.size("x")).over(Window.partitionBy("key").orderBy("obs"))
    return obs.withColumn("x", F.when(F.size("x") == first, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("vectors of unequal size in "), F.col("key")))))


def check_structure(rec: DataFrame) -> DataFrame:
    """rec, with an error where the product of structure is not the number of matrix rows."""
    product = F.aggregate("structure", F.lit(1), lambda a, v: a * v)
    return rec.withColumn("data", F.when(product == F.size("data"), F.col("data")).otherwise(F.raise_error(F.concat(F.lit("structure does not match in "), F.col("key")))))


def matches_colour(colour: Column, wanted: int) -> Column:
    """Fold filter: a negative wanted colour, no colour and a negative colour all match."""
    return F.lit(wanted < 0) | colour.isNull() | (colour < 0) | (colour == wanted)


def random_colours(keys: DataFrame, folds: int, seed: int = 0) -> DataFrame:
    return keys.select("key").distinct().withColumn("colour", dealt(folds, seed, "key"))


def of_colour(table: DataFrame, colours: DataFrame, wanted: int) -> DataFrame:
    return table.join(colours, "key", "left").where(matches_colour(F.col("colour"), wanted)).drop("colour")
