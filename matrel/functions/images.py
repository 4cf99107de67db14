"""Images as arrays of doubles, row by row, and as tables of pixels (image, row, col, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from . import arrays as A


def region(x: Column, width: int, top: int, bottom: int, left: int, right: int) -> Column:
    """The pixels of rows top to bottom - 1 and columns left to right - 1, as one array; each row is one slice."""
    return F.flatten(F.array(*(F.slice(x, r * width + left + 1, right - left) for r in range(top, bottom))))


def region_moments(x: Column) -> Column:
    """Struct of mean, energy (mean square) and variance of an array; null for an empty one."""
    n = F.size(x)
    mean, energy = A.total(x) / n, A.total(F.transform(x, lambda v: v * v)) / n
    return F.when(n > 0, F.struct(mean.alias("mean"), energy.alias("energy"), F.greatest(F.lit(0.0), energy - mean * mean).alias("variance")))


def integral(x: Column, width: int, height: int) -> Column:
    """Sums of all pixels above and left of each corner, as an array of (height + 1) * (width + 1)."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: F.slice(x, r * width + 1, width))
    run = lambda row: F.aggregate(row, F.array(F.lit(0.0)), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))
    zero = F.array_repeat(F.lit(0.0), width + 1)
    lines = F.aggregate(rows, F.array(zero), lambda a, row: F.concat(a, F.array(F.zip_with(F.element_at(a, -1), run(row), lambda p, q: p + q))))
    return F.flatten(lines)


def box_sum(corners: Column, width: int, top: int, bottom: int, left: int, right: int) -> Column:
    """The sum over rows top to bottom - 1 and columns left to right - 1 from integral()."""
    at = lambda r, c: F.element_at(corners, r * (width + 1) + c + 1)
    return at(bottom, right) - at(top, right) - at(bottom, left) + at(top, left)


def components(pixels: DataFrame, width: int) -> DataFrame:
    """pixels with component: the least position (row * width + col) that neighbours of one label in four directions lead to,
    inside an image. Rounds of least labels along rows and columns: a run of one label in a row or column takes its least
    one at once, so there are as many rounds as an area has bends."""
    def run(df: DataFrame, across: str, along: str) -> DataFrame:
        w = Window.partitionBy("image", across).orderBy(along)
        starts = (F.lag("label").over(w).isNull() | (F.lag("label").over(w) != F.col("label")) | (F.lag(along).over(w) != F.col(along) - 1)).cast("int")
        cell = df.withColumn("__s", starts).withColumn("__r", F.sum("__s").over(w))
        return cell.withColumn("component", F.min("component").over(Window.partitionBy("image", across, "__r"))).drop("__s", "__r")

    now = pixels.withColumn("component", F.col("row") * width + F.col("col"))
    while True:
        new = cut(run(run(now.withColumn("__before", F.col("component")), "row", "col"), "col", "row"))
        if new.where("component <> __before").isEmpty():
            return new.drop("__before")
        now = new.drop("__before")
