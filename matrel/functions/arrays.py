"""Vector expressions over ARRAY<DOUBLE> columns; all stay inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerance of approximate comparison.
EPSILON = 1e-6


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def weighted(x: Column, weights: Sequence[float]) -> Column:
    return dot(x, constant(weights))


def constant(values: Sequence[float]) -> Column:
    values = list(values)
    return F.expr(_literal(values))


def _literal(values) -> str:
    """SQL of numbers or rows of numbers: one text to parse, where a column for each would be a call for each."""
    if isinstance(values, (list, tuple)):
        return f"array({', '.join(map(_literal, values))})" if len(values) else "cast(array() as array<double>)"
    v = float(values)
    return f"{v!r}D" if math.isfinite(v) else f"double('{v}')"


def squared_distance(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def l1_distance(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: F.abs(a - b)))


def l1_norm(x: Column) -> Column:
    return total(F.transform(x, F.abs))


def squared_norm(x: Column) -> Column:
    return total(F.transform(x, lambda v: v * v))


def l2_norm(x: Column) -> Column:
    return F.sqrt(squared_norm(x))


def scaled(x: Column, by: Column) -> Column:
    """x / by, or zeros if by is 0."""
    return let(by, lambda n: F.transform(x, lambda v: F.when(n == 0, 0.0).otherwise(v / n)))


def normalize(x: Column) -> Column:
    """Unit L2 length; a zero vector stays."""
    return scaled(x, l2_norm(x))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: inside a lambda it would be computed for every element."""
    return F.transform(F.array(value), use)[0]


def softmax(x: Column) -> Column:
    """exp-normalise, shifted by the maximum."""
    powers = let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    return let(powers, lambda e: let(total(e), lambda t: F.transform(e, lambda v: v / t)))


def log_sum_exp(x: Column) -> Column:
    return let(F.array_max(x), lambda top: top + F.ln(total(F.transform(x, lambda v: F.exp(v - top)))))


def power(x: Column, exponent: float) -> Column:
    return F.transform(x, lambda v: F.pow(v, F.lit(float(exponent))))


def power_normalize(x: Column, exponent: float) -> Column:
    p = power(x, exponent)
    return scaled(p, total(p))


def log(x: Column) -> Column:
    """Natural logarithm; zero gives negative infinity and negative values NaN, where Spark's ln gives null."""
    return F.transform(x, lambda v: F.when(v == 0, F.lit(float("-inf"))).when(v < 0, F.lit(float("nan"))).otherwise(F.ln(v)))


UNARY: dict[str, Callable[..., Column]] = {
    "expAndNormalize": lambda x, arg: softmax(x),
    "exp": lambda x, arg: F.transform(x, F.exp),
    "log": lambda x, arg: log(x),
    "pow": power,
    "powNormalize": power_normalize,
    "normalize": lambda x, arg: normalize(x),
    "sum": lambda x, arg: F.array(total(x)),
    "L1-norm": lambda x, arg: F.array(l1_norm(x)),
    "L2-norm": lambda x, arg: F.array(l2_norm(x)),
    "L2-norm-squared": lambda x, arg: F.array(squared_norm(x)),
}

BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": lambda a, b: F.when(b == 0, F.lit(None).cast("double")).otherwise(a / b),
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
}


def spread(x: Column, size: Column) -> Column:
    """A one-element vector repeated to size; others as they are."""
    return F.when(F.size(x) == 1, F.array_repeat(F.element_at(x, 1), size)).otherwise(x)


def binary(op: str, x: Column, y: Column) -> Column:
    n = F.greatest(F.size(x), F.size(y))
    return F.zip_with(spread(x, n), spread(y, n), BINARY[op])


def affine(x: Column, projection: Sequence[Sequence[float]], offset: Sequence[float] | None = None) -> Column:
    """y = P (x - t) for a row vector x."""
    shifted = F.zip_with(x, constant(offset), lambda a, b: a - b) if offset is not None else x
    rows = F.expr(_literal([list(map(float, row)) for row in projection]))
    return F.transform(F.array(shifted), lambda s: F.transform(rows, lambda row: dot(s, row)))[0]  # shifted once


def argmax(x: Column) -> Column:
    """First index of the greatest value, from 0."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def argmin(x: Column) -> Column:
    return (F.array_position(x, F.array_min(x)) - 1).cast("int")


def arg_random(x: Column, draw: Column) -> Column:
    """Index drawn in proportion to x by a number in [0, 1)."""
    level = draw * total(x)
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(-1).alias("at"))
    step = lambda s, v: F.struct((s["sum"] + v).alias("sum"), (s["n"] + 1).alias("n"), F.when((s["at"] < 0) & (s["sum"] + v > level), s["n"]).otherwise(s["at"]).alias("at"))
    return F.aggregate(x, state, step, lambda s: F.when(s["at"] < 0, s["n"] - 1).otherwise(s["at"]))


def sub_vector(x: Column, index: Sequence[int]) -> Column:
    return F.array(*(F.get(x, F.lit(i)) for i in index))


def has_invalid(x: Column) -> Column:
    """Whether an entry is null, NaN or infinite."""
    return F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) < EPSILON


def below(a: Column, b: Column) -> Column:
    return a < b - EPSILON


def entropy(x: Column) -> Column:
    """Bits of the distribution proportional to x; 0 for an all-zero x."""
    z = total(x)
    plogp = total(F.transform(x, lambda v: F.when(v > 0, v * F.log2(v)).otherwise(0.0)))
    return F.when(z <= 0, 0.0).otherwise(F.log2(F.when(z > 0, z)) - plogp / F.when(z > 0, z))


def gini(x: Column) -> Column:
    z = total(x)
    return F.when(z <= 0, 0.0).otherwise(1.0 - squared_norm(x) / F.when(z > 0, z * z))


def bhattacharyya(p: Column, q: Column) -> Column:
    """sqrt(1 - sum sqrt(p q) / sqrt(sum p sum q))."""
    mass = F.sqrt(total(p) * total(q))
    inside = 1.0 - total(F.zip_with(p, q, lambda a, b: F.sqrt(a * b))) / F.when(mass > 0, mass)
    return F.sqrt(F.greatest(F.lit(0.0), inside))


def logistic(theta: Sequence[float], x: Column) -> Column:
    """1 / (1 + exp(-theta . x)); one theta more than features is a bias."""
    z = weighted(x, theta)
    return 1.0 / (1.0 + F.exp(-z))


def huber(x: Column, m: float = 1.0) -> Column:
    return F.when(F.abs(x) <= m, x * x).otherwise(m * (2.0 * F.abs(x) - m))


def huber_slope(x: Column, m: float = 1.0) -> Column:
    return F.when(F.abs(x) <= m, 2.0 * x).otherwise(2.0 * m * F.signum(x))


def linear_space(first: float, last: float, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(first) + i * ((last - first) / max(1, n - 1)))


def log_space(first: float, last: float, n: int) -> Column:
    """n values whose logarithms are evenly spaced from first to last (both themselves, not exponents)."""
    from math import log as ln

    return F.transform(linear_space(ln(first), ln(last), n), F.exp)


def round_up(n: Column, multiple: int) -> Column:
    return (F.ceil(n / F.lit(float(multiple))) * multiple).cast("long")


def power_set(items: Column) -> Column:
    """All subsets, by rising bit mask."""
    n = F.size(items)
    masks = F.sequence(F.lit(0), F.pow(F.lit(2.0), n).cast("int") - 1)
    return F.transform(masks, lambda m: F.filter(items, lambda v, i: F.pmod(F.floor(m / F.pow(F.lit(2.0), i)), F.lit(2)) == 1))


def successor(digits: Sequence[int], limits: Sequence[int]) -> list[int]:
    """The next mixed-radix number, lowest digit first; wraps around."""
    out = list(digits)
    for i, most in enumerate(limits):
        out[i] += 1
        if out[i] < most:
            break
        out[i] = 0
    return out


def predecessor(digits: Sequence[int], limits: Sequence[int]) -> list[int]:
    out = list(digits)
    for i, most in enumerate(limits):
        out[i] -= 1
        if out[i] >= 0:
            break
        out[i] = most - 1
    return out


ROOT_HALF = 0.5**0.5


def feature_map(kind: str, x: Column) -> Column:
    """identity, bias [x, 1], square [x, (x*x - 1)/sqrt 2, 1] or quadratic [the same, with the cross terms x_i x_j]."""
    one = F.array(F.lit(1.0))
    square = F.transform(x, lambda v: (v * v - 1.0) * ROOT_HALF)
    if kind == "identity":
        return x
    if kind == "bias":
        return F.concat(x, one)
    if kind == "square":
        return F.concat(x, square, one)
    if kind == "quadratic":
        cross = F.flatten(F.transform(x, lambda v, i: F.transform(F.filter(x, lambda _, j: j > i), lambda w: v * w)))
        return F.concat(x, square, cross, one)
    raise ValueError(f"no feature map {kind}")


def joint_feature_map(kind: str, x: Column, y: Column, classes: int) -> Column:
    """phi(x) in the block of class y, zeros elsewhere; the last class has no block."""
    phi = feature_map(kind, x)
    zeros = F.transform(phi, lambda v: F.lit(0.0))
    return F.concat(*(F.when(y == k, phi).otherwise(zeros) for k in range(classes - 1)))
