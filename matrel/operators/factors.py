"""Algebra of discrete factors: one INT column for each variable and val DOUBLE, one row for each assignment.

Product is a natural join, marginalisation a groupBy, conditioning a filter; a missing row counts as 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPSILON = 1e-6


def variables(factor: DataFrame) -> list[str]:
    return [c for c in factor.columns if c != "val"]


def from_table(spark: SparkSession, names: Sequence[str], cards: Sequence[int], values: Sequence[float]) -> DataFrame:
    """A dense factor; the first variable runs fastest."""
    rows = []
    for i, v in enumerate(values):
        digits = []
        for card in cards:
            i, x = divmod(i, card)
            digits.append(x)
        rows.append((*digits, float(v)))
    return spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names) + ", val double")


def dense(factor: DataFrame, cards: dict[str, int]) -> DataFrame:
    """factor with a row for every assignment."""
    grid = factor.sparkSession.range(1).select()
    for v in variables(factor):
        grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(cards[v] - 1))).alias(v))
    return grid.join(factor, variables(factor), "left").withColumn("val", F.coalesce("val", F.lit(0.0)))


def combine(a: DataFrame, b: DataFrame, op: Callable[[Column, Column], Column]) -> DataFrame:
    """Join on the shared variables; without any, every pair of assignments (factors are small by definition)."""
    shared = [v for v in variables(a) if v in variables(b)]
    right = b.withColumnRenamed("val", "__b")
    both = a.join(right, shared) if shared else a.crossJoin(F.broadcast(right))
    names = [*variables(a), *(v for v in variables(b) if v not in shared)]
    return both.select(*names, op(F.col("val"), F.col("__b")).alias("val"))


def product(*factors: DataFrame) -> DataFrame:
    return reduce(lambda a, b: combine(a, b, lambda x, y: x * y), factors)


def add(*factors: DataFrame) -> DataFrame:
    return reduce(lambda a, b: combine(a, b, lambda x, y: x + y), factors)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return combine(a, b, lambda x, y: x - y)


def divide(a: DataFrame, b: DataFrame) -> DataFrame:
    """0 where the numerator is 0."""
    return combine(a, b, lambda x, y: F.when(x == 0, 0.0).otherwise(x / F.when(y != 0, y)))


def weighted_sum(a: DataFrame, b: DataFrame, wa: float = 1.0, wb: float = 1.0) -> DataFrame:
    return combine(a, b, lambda x, y: wa * x + wb * y)


def _fold(factor: DataFrame, out: Iterable[str], agg: Callable) -> DataFrame:
    rest = [v for v in variables(factor) if v not in set(out)]
    return factor.groupBy(*rest).agg(agg("val").alias("val"))


def marginalise(factor: DataFrame, *out: str) -> DataFrame:
    return _fold(factor, out, F.sum)


def maximise(factor: DataFrame, *out: str) -> DataFrame:
    return _fold(factor, out, F.max)


def minimise(factor: DataFrame, *out: str) -> DataFrame:
    return _fold(factor, out, F.min)


def condition(factor: DataFrame, **values: int) -> DataFrame:
    """Rows that agree with the values, without those variables."""
    for name, v in values.items():
        if name in factor.columns:
            factor = factor.where(F.col(name) == v).drop(name)
    return factor


def _whole(factor: DataFrame, **aggregates: Column) -> DataFrame:
    return factor.crossJoin(F.broadcast(factor.agg(*(c.alias(n) for n, c in aggregates.items()))))


def normalise(factor: DataFrame) -> DataFrame:
    """Values over their sum; uniform if that is not positive."""
    out = _whole(factor, __t=F.sum("val"), __n=F.count("*"))
    return out.select(*variables(factor), F.when(F.col("__t") > 0, F.col("val") / F.when(F.col("__t") > 0, F.col("__t"))).otherwise(1.0 / F.col("__n")).alias("val"))


def exp_normalise(factor: DataFrame) -> DataFrame:
    shifted = _whole(factor, __m=F.max("val")).select(*variables(factor), F.exp(F.col("val") - F.col("__m")).alias("val"))
    return normalise(shifted)


def log_normalise(factor: DataFrame) -> DataFrame:
    """The greatest value becomes 0."""
    return _whole(factor, __m=F.max("val")).select(*variables(factor), (F.col("val") - F.col("__m")).alias("val"))


def scale(factor: DataFrame, by: float) -> DataFrame:
    return factor.withColumn("val", F.col("val") * by)


def offset(factor: DataFrame, by: float) -> DataFrame:
    return factor.withColumn("val", F.col("val") + by)


def fill(factor: DataFrame, value: float) -> DataFrame:
    return factor.withColumn("val", F.lit(float(value)))


def entry_index(factor: DataFrame, cards: dict[str, int]) -> Column:
    """Mixed-radix number of an assignment, first variable fastest."""
    out, stride = F.lit(0).cast("long"), 1
    for v in variables(factor):
        out = out + F.col(v) * stride
        stride *= cards[v]
    return out


def assignment_of(index: Column, names: Sequence[str], cards: dict[str, int]) -> list[Column]:
    out, stride = [], 1
    for v in names:
        out.append((F.floor(index / F.lit(float(stride))) % cards[v]).cast("int").alias(v))
        stride *= cards[v]
    return out


def arg_best(factor: DataFrame, cards: dict[str, int], greatest: bool = False) -> DataFrame:
    """The row of the least (or greatest) value, the first of equal ones."""
    v = -F.col("val") if greatest else F.col("val")
    row = F.struct(*factor.columns)
    return factor.agg(F.min_by(row, F.struct(v, entry_index(factor, cards))).alias("r")).select("r.*")


def same(a: DataFrame, b: DataFrame) -> DataFrame:
    """(same): whether two factors agree within the tolerance."""
    right = b.withColumnRenamed("val", "__b")
    return a.join(right, variables(a), "full_outer").agg(F.coalesce(F.bool_and(F.coalesce(F.abs(F.col("val") - F.col("__b")) < EPSILON, F.lit(False))), F.lit(True)).alias("same"))


def energy(factors: Sequence[DataFrame], assignment: dict[str, int]) -> DataFrame:
    """(energy): the sum of the factors' values at an assignment."""
    picked = [condition(f, **{v: assignment[v] for v in variables(f)}).select("val") for f in factors]
    return reduce(DataFrame.union, picked).agg(F.sum("val").alias("energy"))


def brute_force_map(factors: Sequence[DataFrame], cards: dict[str, int]) -> DataFrame:
    """The assignment of least total, by one join of all factors."""
    return arg_best(add(*factors), cards)


def eliminate(factors: Sequence[DataFrame], order: Sequence[str], keep: Sequence[str] = (), combine_with: Callable = product, fold: Callable = marginalise, limit: int = 10_000_000, cards: dict[str, int] | None = None) -> DataFrame:
    """Variable elimination: the factors of each variable are joined and the variable is folded out at once, so the
    aggregate sits below the next join. Refuses a join whose dense size passes the limit."""
    pool = list(factors)
    for v in order:
        if v in keep:
            continue
        touched = [f for f in pool if v in variables(f)]
        if not touched:
            continue
        if cards:
            size = 1
            for n in {x for f in touched for x in variables(f)}:
                size *= cards[n]
            if size > limit:
                raise ValueError(f"eliminating {v} needs a factor of {size} entries; the limit is {limit}")
        pool = [f for f in pool if v not in variables(f)] + [fold(combine_with(*touched), v)]
    return combine_with(*pool)


def remove_uniform(factors: Sequence[DataFrame]) -> tuple[list[DataFrame], float]:
    """(factors without those of more than one variable that have one value only, the energy taken out)."""
    left, taken = [], 0.0
    for f in factors:
        low, high = f.agg(F.min("val"), F.max("val")).first()
        if len(variables(f)) > 1 and low == high:
            taken += low
        else:
            left.append(f)
    return left, taken


def merge_duplicates(factors: Sequence[DataFrame], op: Callable = add) -> list[DataFrame]:
    """Factors over one set of variables as one."""
    by: dict[frozenset, list[DataFrame]] = {}
    for f in factors:
        by.setdefault(frozenset(variables(f)), []).append(f)
    return [op(*fs) for fs in by.values()]


def absorb(factors: Sequence[DataFrame], op: Callable = add) -> list[DataFrame]:
    """Factors whose variables another factor has are added into it."""
    left = sorted(merge_duplicates(factors, op), key=lambda f: -len(variables(f)))
    out: list[DataFrame] = []
    for f in left:
        home = next((i for i, g in enumerate(out) if set(variables(f)) <= set(variables(g))), None)
        if home is None:
            out.append(f)
        else:
            out[home] = op(out[home], f)
    return out


def window_normalise(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Conditional distribution: values over their sum for each assignment of by."""
    t = F.sum("val").over(Window.partitionBy(*by))
    return table.withColumn("val", F.when(t > 0, F.col("val") / F.when(t > 0, t)).otherwise(0.0))
