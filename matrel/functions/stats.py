"""Mergeable statistics: moments, histograms, order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def sufficient(obs: DataFrame, by: list[str] | None = None, pairs: str = "full", weight: str | None = None) -> DataFrame:
    """Weighted moments in cell form: (by, i, j, value) with i = j = -1 the mass, j = -1 the sums, else second moments
    (pairs: full, diag or none). Sums of such tables are the statistics of the union, so merging is a union."""
    by = by or []
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = obs.select(*by, w.alias("w"), "x")
    first = rows.select(*by, "w", F.posexplode("x").alias("i", "v"))
    out = [rows.select(*by, F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.col("w").alias("value")), first.select(*by, "i", F.lit(-1).alias("j"), (F.col("w") * F.col("v")).alias("value"))]
    if pairs == "diag":
        out.append(first.select(*by, "i", F.col("i").alias("j"), (F.col("w") * F.col("v") * F.col("v")).alias("value")))
    elif pairs == "full":
        second = rows.select(*by, "w", "x", F.posexplode("x").alias("i", "v")).select(*by, "w", "i", "v", F.posexplode("x").alias("j", "u"))
        out.append(second.select(*by, "i", "j", (F.col("w") * F.col("v") * F.col("u")).alias("value")))
    union = out[0]
    for part in out[1:]:
        union = union.unionByName(part)
    return union.groupBy(*by, "i", "j").agg(F.sum("value").alias("value"))


def merge(*tables: DataFrame) -> DataFrame:
    union = tables[0]
    for t in tables[1:]:
        union = union.unionByName(t)
    return union.groupBy(*(c for c in union.columns if c != "value")).agg(F.sum("value").alias("value"))


def subtract(whole: DataFrame, part: DataFrame) -> DataFrame:
    """Statistics of what is left when part is taken back."""
    return merge(whole, part.withColumn("value", -F.col("value")))


def diagonal(stats: DataFrame) -> DataFrame:
    return stats.where("j = -1 or i = j")


def redistribute(stats: DataFrame, state: str, old: int, new: int) -> DataFrame:
    """Statistics of state old added to those of state new."""
    return merge(stats.withColumn(state, F.when(F.col(state) == old, F.lit(new)).otherwise(F.col(state))))


def bin_index(v: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bin from 0, values outside in the end bins."""
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((v - low) / ((high - low) / bins)))).cast("int")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by, bin, mass, share, cdf) for every bin from 0 to bins - 1, empty ones too."""
    by = by or []
    w = F.col(weight) if weight else F.lit(1.0)
    found = df.groupBy(*by, bin_index(F.col(value), low, high, bins).alias("bin")).agg(F.sum(w).alias("mass"))
    frame = (df.select(*by).distinct() if by else df.sparkSession.range(1).select()).select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    dense = frame.join(found, [*by, "bin"], "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))
    whole = Window.partitionBy(*by)
    share = F.col("mass") / F.sum("mass").over(whole)
    return dense.withColumn("share", share).withColumn("cdf", F.sum("share").over(whole.orderBy("bin")))


def histogram_distance(hist: DataFrame, other: DataFrame, kind: str = "chi-squared", by: list[str] | None = None) -> DataFrame:
    """Of shares bin by bin: chi-squared (half the sum of (p-q)^2/(p+q)) or euclidean."""
    by = by or []
    both = hist.select(*by, "bin", F.col("share").alias("p")).join(other.select(*by, "bin", F.col("share").alias("q")), [*by, "bin"])
    d = F.col("p") - F.col("q")
    s = F.col("p") + F.col("q")
    value = F.sum(F.when(s > 0, d * d / F.when(s > 0, s)).otherwise(0.0)) * 0.5 if kind == "chi-squared" else F.sqrt(F.sum(d * d))
    return both.groupBy(*by).agg(value.alias("distance"))


def histogram_entropy(hist: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Nats."""
    p = F.col("share")
    return hist.groupBy(*(by or [])).agg((-F.sum(F.when(p > 0, p * F.ln(p)).otherwise(0.0))).alias("entropy"))


def mode(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The most frequent value, the smallest of equally frequent ones."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("mode"))


def percentile(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """df with pct: the share of strictly smaller values. By counts of distinct values, so that only these meet in a
    window; without by, running sums of those counts go through range partitions instead of one task."""
    by = by or []
    n = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    if by:
        below = F.sum("n").over(Window.partitionBy(*by).orderBy(value)) - F.col("n")
        rank = n.withColumn("pct", below / F.sum("n").over(Window.partitionBy(*by)))
        return df.join(rank.select(*by, value, "pct"), [*by, value])
    rank = running_total(n, value, "n")
    total = n.agg(F.sum("n").alias("total"))
    return df.join(rank.join(F.broadcast(total)).select(value, ((F.col("running") - F.col("n")) / F.col("total")).alias("pct")), value)


def running_total(df: DataFrame, order: str, value: str, descending: bool = False) -> DataFrame:
    """df with running: the sum of value up to each row in an order of distinct values. Rows are range-partitioned; each
    partition sums its own, and the totals of the partitions before (one number each) are added."""
    key = F.col(order).desc() if descending else F.col(order)
    parts = df.repartitionByRange(key).withColumn("__part", F.spark_partition_id())
    parts = cut(parts)
    inner = parts.withColumn("__inner", F.sum(value).over(Window.partitionBy("__part").orderBy(key)))
    sums = parts.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inner.join(F.broadcast(before.select("__part", "__before")), "__part").withColumn("running", F.col("__inner") + F.col("__before")).drop("__part", "__inner", "__before")


def remove_outliers(df: DataFrame, score: str, key: str, keep: int, by: list[str] | None = None) -> DataFrame:
    """The keep rows in the middle of the order by score."""
    by = by or []
    w = Window.partitionBy(*by)
    ranked = df.withColumn("__r", F.row_number().over(w.orderBy(score, key)) - 1).withColumn("__n", F.count("*").over(w))
    start = F.floor((F.col("__n") - keep) / 2)
    return ranked.where((F.col("__r") >= start) & (F.col("__r") < start + keep)).drop("__r", "__n")
