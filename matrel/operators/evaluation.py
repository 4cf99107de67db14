"""Evaluation of predictions: confusion tables, rates, precision-recall curves, grid search."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import dealt
from ..functions.stats import running_total


def confusion(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """(by, actual, predicted, n) of rows whose actual label is known; every pair of seen classes, zeros too."""
    by = by or []
    rows = df.where(F.col(actual) >= 0).groupBy(*by, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    seen = rows.select("actual").union(rows.select("predicted")).distinct()
    grid = seen.crossJoin(F.broadcast(seen.select(F.col("actual").alias("predicted"))))  # classes squared
    if by:
        grid = rows.select(*by).distinct().crossJoin(F.broadcast(grid))
    return grid.join(rows, [*by, "actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b))


def class_scores(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, class, hits, n_actual, n_predicted, precision, recall, f1, jaccard): rates without a denominator are null,
    except precision, which is 1 for a class that is never predicted, and Jaccard, which is 1 for an empty class."""
    by = by or []
    rows = table.groupBy(*by, F.col("actual").alias("class")).agg(F.sum("n").alias("n_actual"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    cols = table.groupBy(*by, F.col("predicted").alias("class")).agg(F.sum("n").alias("n_predicted"))
    both = rows.join(cols, [*by, "class"])
    hits, a, p = F.col("hits"), F.col("n_actual"), F.col("n_predicted")
    out = both.withColumn("precision", F.coalesce(_ratio(hits, p), F.lit(1.0))).withColumn("recall", _ratio(hits, a))
    out = out.withColumn("jaccard", F.coalesce(_ratio(hits, a + p - hits), F.lit(1.0)))
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def overall(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, total, correct, accuracy, avg_precision, avg_recall, avg_jaccard); averages skip classes without a rate."""
    by = by or []
    s = class_scores(table, by)
    seen = F.col("n_predicted") > 0
    return s.groupBy(*by).agg(
        F.sum("n_actual").alias("total"), F.sum("hits").alias("correct"), _ratio(F.sum("hits"), F.sum("n_actual")).alias("accuracy"),
        F.avg(F.when(seen, F.col("precision"))).alias("avg_precision"), F.avg("recall").alias("avg_recall"), F.avg("jaccard").alias("avg_jaccard"),
    )


def scored_results(df: DataFrame, score: str, label: str, positive: int) -> DataFrame:
    """(score, pos, neg): how many of either kind have each score; unknown labels are left out."""
    return df.where(F.col(label) >= 0).groupBy(F.col(score).alias("score")).agg(F.sum((F.col(label) == positive).cast("long")).alias("pos"), F.sum((F.col(label) != positive).cast("long")).alias("neg"))


def pr_curve(results: DataFrame, misses: int = 0, weight: float = 1.0) -> DataFrame:
    """(score, recall, precision) by falling score; misses are positives without a score, weight multiplies positives.

    Running sums go over distinct scores in range partitions, so no task sorts all of them."""
    p = running_total(results.select("score", "pos", "neg", F.col("pos").alias("__v")), "score", "__v", descending=True).withColumnRenamed("running", "tp")
    n = running_total(results.select("score", F.col("neg").alias("__v")), "score", "__v", descending=True).select("score", F.col("running").alias("fp"))
    total = F.broadcast(results.agg((F.coalesce(F.sum("pos"), F.lit(0)) + misses).alias("all_pos")))
    tp = F.col("tp") * F.lit(weight)
    return p.join(n, "score").crossJoin(total).select("score", _ratio(F.col("tp"), F.col("all_pos")).alias("recall"), _ratio(tp, tp + F.col("fp")).alias("precision"))


def average_precision(curve: DataFrame, points: int = 11) -> DataFrame:
    """Mean over evenly spaced recall levels of the best precision at that recall or more. The levels are points many, so
    the curve is aggregated by its level and the rest is a window over points rows."""
    level = F.least(F.lit(points - 1), F.floor(F.col("recall") * (points - 1) + 1e-9)).cast("int")
    best = curve.groupBy(level.alias("level")).agg(F.max("precision").alias("p"))
    grid = curve.sparkSession.range(points).select(F.col("id").cast("int").alias("level"))
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("level"))
    dense = F.broadcast(grid).join(best, "level", "left").withColumn("p", F.coalesce(F.max("p").over(down), F.lit(0.0)))
    return dense.agg(F.avg("p").alias("average_precision"))


class GridSearch:
    """Every combination of parameter values is trained and scored; the first best wins."""

    def __init__(self):
        self.grid: dict[str, list] = {}

    def add(self, name: str, *values) -> GridSearch:
        self.grid.setdefault(name, []).extend(values)
        return self

    def add_linear(self, name: str, first: float, last: float, n: int) -> GridSearch:
        return self.add(name, *(first + i * (last - first) / max(1, n - 1) for i in range(n)))

    def add_logarithmic(self, name: str, first: float, last: float, n: int) -> GridSearch:
        return self.add(name, *(first * (last / first) ** (i / max(1, n - 1)) for i in range(n)))

    def trials(self) -> list[dict]:
        return [dict(zip(self.grid, v)) for v in itertools.product(*self.grid.values())]

    def run(self, train: Callable[..., object], score: Callable[[object], float]) -> tuple[dict, float, object]:
        best: tuple = ({}, float("-inf"), None)
        for trial in self.trials():
            model = train(**trial)
            if (s := score(model)) > best[1]:
                best = (trial, s, model)
        return best


def fold_split(df: DataFrame, key: str, folds: int, held: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    fold = dealt(folds, seed, key)
    return df.where(fold != held), df.where(fold == held)


def pixel_scores(df: DataFrame, item: str, actual: str, predicted: str) -> DataFrame:
    """Per item accuracy, mean class recall and mean Jaccard."""
    return overall(confusion(df, actual, predicted, [item]), [item])


def argmax_label(scores: Sequence[str]) -> Column:
    """Index of the greatest of several score columns, the first of equal ones."""
    x = F.array(*(F.col(c).cast("double") for c in scores))
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")
