"""Text, matrix and random sources; text sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..functions.strings import pad, parse_vector


def read_text_table(spark: SparkSession, path: str, delimiter: str = " ", header_lines: int = 0, includes_key: bool = True, key_prefix: str = "") -> DataFrame:
    """Observation form of a text file: a non-empty line is a row; lines of one key are rows of its record in file order.
    Without a key column the key is the prefix and the line's number with leading zeros.

    Lines are numbered within files by their offsets: each input split counts its lines, and a split's start is the sum
    of the counts before it, so files are read in parallel."""
    raw = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    raw = raw.withColumn("part", F.shiftright("at", 33))
    counts = raw.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = raw.join(F.broadcast(before), "part").withColumn("number", F.col("before") + F.expr("at & 8589934591")).where((F.col("number") >= header_lines) & (F.col("line") != ""))
    text = F.regexp_replace("line", re.escape(delimiter), " ") if delimiter != " " else F.col("line")
    if includes_key:
        key = F.regexp_extract("line", f"^([^{re.escape(delimiter)}]+)", 1)
        body = F.regexp_replace(text, r"^\S+\s*", "")
    else:
        key, body = F.concat(F.lit(key_prefix), pad((F.col("number") - header_lines).cast("string"), 8)), text
    rows = rows.select(key.alias("key"), "number", parse_vector(body).alias("x"))
    obs = F.row_number().over(Window.partitionBy("key").orderBy("number")) - 1
    return rows.select("key", obs.cast("int").alias("obs"), "x")


def write_text_table(obs: DataFrame, path: str, delimiter: str = " ", include_header: bool = False, include_key: bool = True) -> None:
    """Lines by key and row, in part files whose order is that of the keys."""
    body = F.array_join(F.transform("x", lambda v: v.cast("string")), delimiter)
    line = F.concat_ws(delimiter, "key", body) if include_key else body
    out = obs.repartitionByRange("key").sortWithinPartitions("key", "obs").select(line.alias("value"))
    if include_header:
        head = obs.sparkSession.createDataFrame([(f"KEY{delimiter}DATA" if include_key else "DATA",)], "value string")
        out = head.coalesce(1).union(out)
    out.write.mode("overwrite").text(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, x) of a dense matrix in text."""
    t = read_text_table(spark, path, includes_key=False)
    return t.select(F.col("key").cast("int").alias("row"), "x")


def random_table(spark: SparkSession, records: int = 1000, features: int = 25, least_rows: int = 1, most_rows: int = 1, seed: int = 0) -> DataFrame:
    """Keys REC00000 and on, values uniform in [-1, 1]; all by hash, so any part can be made again."""
    rows = F.lit(least_rows) + F.floor(uniform(seed, F.col("id"), F.lit("n")) * (most_rows - least_rows + 1)).cast("int")
    keyed = spark.range(records).select("id", F.concat(F.lit("REC"), pad(F.col("id").cast("string"), 5)).alias("key"), F.explode(F.sequence(F.lit(0), rows - 1)).alias("obs"))
    x = F.transform(F.sequence(F.lit(0), F.lit(features - 1)), lambda i: uniform(seed, F.col("id"), F.col("obs"), i) * 2.0 - 1.0)
    return keyed.select("key", "obs", x.alias("x"))


def show(obs: DataFrame, rows: int = 20) -> None:
    obs.show(rows, truncate=False)
