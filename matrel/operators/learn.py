"""Learned operators: one aggregate query for each fitting step, parameters on the driver, transforms as expressions.

Data: x ARRAY<DOUBLE>, and where named label INT (negative: unknown, left out) and weight DOUBLE. What reaches the
driver is of the size of the parameters: sums, second moments, class counts by threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.stats import running_total, sufficient
from ..storage import cut


def _dimension(df: DataFrame) -> int:
    row = df.select(F.size("x")).first()
    if row is None:
        raise ValueError("no rows to fit")
    return row[0]


def moments(df: DataFrame, weight: str | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """(mass, mean, population covariance)."""
    n = _dimension(df)
    mass, first, second = 0.0, np.zeros(n), np.zeros((n, n))
    for r in sufficient(df, weight=weight).collect():
        if r["i"] < 0:
            mass = r["value"]
        elif r["j"] < 0:
            first[r["i"]] = r["value"]
        else:
            second[r["i"], r["j"]] = r["value"]
    mean = first / mass
    return mass, mean, second / mass - np.outer(mean, mean)


def class_moments(df: DataFrame, label: str = "label") -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    n = _dimension(df)
    out: dict[int, list] = {}
    for r in sufficient(df.where(F.col(label) >= 0), by=[label]).collect():
        m = out.setdefault(r[label], [0.0, np.zeros(n), np.zeros((n, n))])
        if r["i"] < 0:
            m[0] = r["value"]
        elif r["j"] < 0:
            m[1][r["i"]] = r["value"]
        else:
            m[2][r["i"], r["j"]] = r["value"]
    return {k: (c, s / c, q / c - np.outer(s / c, s / c)) for k, (c, s, q) in sorted(out.items())}


@dataclass
class Linear:
    """y = P (x - t)."""

    projection: np.ndarray
    offset: np.ndarray

    def column(self, x: Column) -> Column:
        return A.affine(x, self.projection.tolist(), self.offset.tolist())

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("x", self.column(F.col("x")))

    def gradient(self, df: DataFrame) -> DataFrame:
        """Gradient with respect to the input from one with respect to the output (column x)."""
        return df.withColumn("x", A.affine(F.col("x"), self.projection.T.tolist()))


def fit_whitener(df: DataFrame, weight: str | None = None, least: float = 1e-6) -> Linear:
    """(x - mean) / sd by feature; a nearly constant feature is divided by its mean and not shifted."""
    _, mean, cov = moments(df, weight)
    sd = np.sqrt(np.maximum(0, np.diag(cov)))
    flat = sd < least
    scale = np.where(flat, 1 / np.where(np.abs(mean) > least, mean, 1.0), 1 / np.where(flat, 1.0, sd))
    return Linear(np.diag(scale), np.where(flat, 0.0, mean))


def fit_rescale(df: DataFrame, least: float = 1e-6) -> Linear:
    _, mean, cov = moments(df)
    sd = np.sqrt(np.maximum(0, np.diag(cov)))
    return Linear(np.diag(1 / np.where(sd < least, 1.0, sd)), mean)


def _signed(rows: np.ndarray) -> np.ndarray:
    """Each row with its largest entry positive."""
    at = np.abs(rows).argmax(axis=1)
    return rows * np.sign(rows[np.arange(len(rows)), at])[:, None]


def fit_pca(df: DataFrame, output: int = 0, energy: float = 1.0, normalise: bool = True) -> Linear:
    """Principal components by rising eigenvalue; those of no variance are left out, and the lowest ones as long as the
    rest keep the share of energy."""
    _, mean, cov = moments(df)
    values, vectors = np.linalg.eigh(cov)
    first = int(np.searchsorted(values, 1e-12 * max(values[-1], 1e-300), side="right"))
    total = values[first:].sum()
    while first < len(values) - 1 and energy < 1.0 and values[first + 1 :].sum() >= energy * total:
        first += 1
    if output:
        first = max(first, len(values) - output)
    rows = _signed(vectors[:, first:].T)
    return Linear(rows / np.sqrt(values[first:])[:, None] if normalise else rows, mean)


def fit_lda(df: DataFrame, label: str = "label", ridge: float = 0.0) -> Linear:
    """Directions that part the classes: eigenvectors of within^-1 between, one less than classes; class averages unweighted."""
    by = class_moments(df, label)
    if not 2 <= len(by) <= len(next(iter(by.values()))[1]):
        raise ValueError("classes must be 2 to the number of features")
    means = np.array([m for _, m, _ in by.values()])
    within = np.mean([c for _, _, c in by.values()], axis=0) + ridge * np.eye(means.shape[1])
    centre = means.mean(axis=0)
    between = (means - centre).T @ (means - centre) / len(by)
    values, vectors = np.linalg.eig(np.linalg.solve(within, between))
    keep = np.argsort(-values.real)[: len(by) - 1]
    rows = vectors.real[:, keep].T
    return Linear(_signed(rows / np.linalg.norm(rows, axis=1, keepdims=True)), centre)


@dataclass
class KMeans:
    centres: np.ndarray

    def distances(self, x: Column) -> Column:
        return F.array(*(A.squared_distance(x, A.constant(c)) for c in self.centres.tolist()))

    def assign(self, df: DataFrame) -> DataFrame:
        return df.withColumn("cluster", A.argmin(self.distances(F.col("x"))))


def fit_kmeans(df: DataFrame, k: int = 2, key: str = "key", max_rounds: int = 100, weight: str | None = None) -> KMeans:
    """Lloyd's rounds from the first k rows by key until no centre moves; an empty cluster keeps its centre."""
    model = KMeans(np.array([r["x"] for r in df.orderBy(key).limit(k).select("x").collect()], float))
    w = F.col(weight) if weight else F.lit(1.0)
    for _ in range(max_rounds):
        cell = model.assign(df).select("cluster", w.alias("w"), F.posexplode("x").alias("i", "v"))
        new = model.centres.copy()
        for r in cell.groupBy("cluster", "i").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m")).collect():
            new[r["cluster"], r["i"]] = r["m"]
        if np.allclose(new, model.centres, rtol=0, atol=1e-12):
            break
        model = KMeans(new)
    return model


@dataclass
class Gaussian:
    mean: np.ndarray
    cov: np.ndarray

    @property
    def _factor(self) -> tuple[np.ndarray, float]:
        """(W, log normaliser): |W (x - mean)|^2 is the squared Mahalanobis distance."""
        low = np.linalg.cholesky(self.cov)
        return np.linalg.inv(low), -np.log(np.diag(low)).sum() - 0.5 * len(self.mean) * np.log(2 * np.pi)

    def log_density(self, x: Column) -> Column:
        w, z = self._factor
        return F.lit(float(z)) - 0.5 * A.squared_norm(A.affine(x, w.tolist(), self.mean.tolist()))

    def sample(self, n: int, seed: int = 0) -> np.ndarray:
        return np.random.default_rng(seed).multivariate_normal(self.mean, self.cov, n)

    def marginal(self, keep: Sequence[int]) -> Gaussian:
        i = list(keep)
        return Gaussian(self.mean[i], self.cov[np.ix_(i, i)])

    def condition(self, observed: dict[int, float]) -> Gaussian:
        """The Gaussian of the other variables given some."""
        b = sorted(observed)
        a = [i for i in range(len(self.mean)) if i not in observed]
        gain = np.linalg.solve(self.cov[np.ix_(b, b)], self.cov[np.ix_(b, a)]).T
        seen = np.array([observed[i] for i in b]) - self.mean[b]
        return Gaussian(self.mean[a] + gain @ seen, self.cov[np.ix_(a, a)] - gain @ self.cov[np.ix_(b, a)])

    def divergence(self, other: Gaussian) -> float:
        """KL of other from self."""
        inv = np.linalg.inv(other.cov)
        d = other.mean - self.mean
        return float(0.5 * (np.trace(inv @ self.cov) + d @ inv @ d - len(d) + np.linalg.slogdet(other.cov)[1] - np.linalg.slogdet(self.cov)[1]))


def fit_gaussian(df: DataFrame, ridge: float = 1e-6, weight: str | None = None) -> Gaussian:
    _, mean, cov = moments(df, weight)
    return Gaussian(mean, cov + ridge * np.eye(len(mean)))


@dataclass
class Mixture:
    weights: np.ndarray
    parts: list[Gaussian]

    def log_parts(self, x: Column) -> Column:
        return F.array(*(F.lit(float(np.log(w))) + g.log_density(x) for w, g in zip(self.weights, self.parts)))

    def log_density(self, x: Column) -> Column:
        return A.log_sum_exp(self.log_parts(x))


def fit_mixture(df: DataFrame, k: int = 2, key: str = "key", prior: float = 1e-3, max_rounds: int = 100, tolerance: float = 1e-6) -> Mixture:
    """EM from k-means cells; each covariance is drawn to the whole one by prior. A round is one weighted-moments query."""
    _, _, whole = moments(df)
    start = fit_kmeans(df, k, key, max_rounds=5).assign(df)
    by = class_moments(start, "cluster")
    total = sum(c for c, _, _ in by.values())
    shrink = lambda cov: (cov + prior * whole) / (1 + prior) + 1e-9 * np.eye(len(whole))
    model = Mixture(np.array([c / total for c, _, _ in by.values()]), [Gaussian(m, shrink(c)) for _, m, c in by.values()])
    before = -np.inf
    for _ in range(max_rounds):
        soft = df.select("x", A.softmax(model.log_parts(F.col("x"))).alias("r"), model.log_density(F.col("x")).alias("ll")).persist()
        now = soft.agg(F.sum("ll")).first()[0]
        parts = [moments(soft.select("x", F.get("r", F.lit(j)).alias("w")), "w") for j in range(len(model.parts))]
        soft.unpersist()
        mass = sum(c for c, _, _ in parts)
        model = Mixture(np.array([c / mass for c, _, _ in parts]), [Gaussian(m, shrink(c)) for _, m, c in parts])
        if abs(now - before) <= tolerance * abs(now):
            break
        before = now
    return model


# ---- classifiers: scores(x) is an array column, one score for each class --------------------------------------------


class Classifier:
    classes: int

    def scores(self, x: Column) -> Column:
        raise NotImplementedError

    def marginals(self, x: Column) -> Column:
        return A.softmax(self.scores(x))

    def label(self, x: Column) -> Column:
        return A.argmax(self.scores(x))

    def predict(self, df: DataFrame, column: str = "predicted") -> DataFrame:
        return df.withColumn(column, self.label(F.col("x")))


IMPURITY: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "ENTROPY": lambda p: -np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0).sum(-1),
    "GINI": lambda p: 1 - np.square(p).sum(-1),
    "MISCLASS": lambda p: 1 - p.max(-1),
}


@dataclass
class Tree(Classifier):
    """Nodes in heap order from 1: split (feature, threshold) goes left where x < threshold; leaves hold log shares."""

    classes: int
    splits: dict[int, tuple[int, float]] = field(default_factory=dict)
    leaves: dict[int, np.ndarray] = field(default_factory=dict)

    def node(self, x: Column, at: int = 1) -> Column:
        if at not in self.splits:
            return F.lit(at)
        f, t = self.splits[at]
        return F.when(F.get(x, F.lit(f)) < F.lit(float(t)), self.node(x, 2 * at)).otherwise(self.node(x, 2 * at + 1))

    def scores(self, x: Column, at: int = 1) -> Column:
        if at not in self.splits:
            return A.constant(self.leaves[at].tolist())
        f, t = self.splits[at]
        return F.when(F.get(x, F.lit(f)) < F.lit(float(t)), self.scores(x, 2 * at)).otherwise(self.scores(x, 2 * at + 1))


def candidate_cuts(df: DataFrame, at_most: int = 1000) -> list[np.ndarray]:
    """Split points of every feature: midpoints of neighbouring distinct values, at most at_most of them, evenly spaced in
    the order of the distinct values. Distinct values are numbered by running sums over range partitions, and only those
    on either side of a chosen midpoint come to the driver."""
    d = _dimension(df)
    one = F.lit(1).alias("one")
    distinct = cut(df.select(F.posexplode("x").alias("i", "v")).where("v is not null").distinct().select(F.struct("i", "v").alias("at"), one))
    sizes = {r["i"]: r["count"] for r in distinct.groupBy(F.col("at.i").alias("i")).count().collect()}
    wanted, first = [], 0
    for i in range(d):
        n = sizes.get(i, 0)
        chosen = np.arange(n - 1) if n - 1 <= at_most else np.linspace(0, n - 2, at_most).astype(int)
        wanted += [(i, k, int(first + c + side)) for k, c in enumerate(chosen.tolist()) for side in (0, 1)]
        first += n
    out = [np.zeros(0)] * d
    if wanted:
        places = df.sparkSession.createDataFrame(wanted, "i int, k int, place long")  # 2 at_most rows for each feature
        ranked = running_total(distinct, "at", "one").select("at", (F.col("running") - 1).alias("place"))
        found = ranked.join(F.broadcast(places), "place").groupBy("i", "k").agg(((F.min("at.v") + F.max("at.v")) / 2).alias("mid")).collect()
        for i in range(d):
            out[i] = np.array([m for _, m in sorted((r["k"], r["mid"]) for r in found if r["i"] == i)])
    return out


def fit_tree(df: DataFrame, classes: int, depth: int = 1, label: str = "label", weight: str | None = None, split: str = "ENTROPY", least_samples: int = 0, leak: float = 0.0, cuts: list[np.ndarray] | None = None, features: Sequence[int] | None = None) -> Tree:
    """Level by level: one query counts the weight of each (node, feature, interval between cuts, class), partially
    aggregated, and the best cut of every node is read off its running sums on the driver."""
    rows = df.where(F.col(label) >= 0).select("x", F.col(label).alias("y"), (F.col(weight) if weight else F.lit(1.0)).alias("w"))
    cuts = cuts if cuts is not None else candidate_cuts(rows)
    use = list(features) if features is not None else list(range(len(cuts)))
    binned = rows.select("x", "y", "w", F.array(*(_interval(F.get("x", F.lit(f)), cuts[f]) for f in use)).alias("b"))
    tree, open_nodes = Tree(classes), [1]
    impurity = IMPURITY[split]
    for level in range(depth + 1):
        cell = binned.select(tree.node(F.col("x")).alias("node"), "y", "w", F.posexplode("b").alias("f", "k")).where(F.col("node").isin(open_nodes))
        counts = {n: [np.zeros((len(cuts[f]) + 1, classes)) for f in use] for n in open_nodes}
        sizes = dict.fromkeys(open_nodes, 0)
        for r in cell.groupBy("node", "f", "k", "y").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect():
            counts[r["node"]][r["f"]][r["k"], r["y"]] += r["w"]
            sizes[r["node"]] += r["n"] if r["f"] == 0 else 0
        after = []
        for node in open_nodes:
            total = counts[node][0].sum(axis=0)
            mass = total.sum()
            best = (1e-12, -1, 0.0)
            if level < depth and mass > 0 and sizes[node] > max(1, least_samples) and (total > 0).sum() > 1:
                here = float(impurity(total / mass))
                for j, f in enumerate(use):
                    left = np.cumsum(counts[node][j], axis=0)[:-1]
                    right = total - left
                    wl, wr = left.sum(1), right.sum(1)
                    ok = (wl > 0) & (wr > 0)
                    if ok.any():
                        share = lambda c, w: c / np.where(w > 0, w, 1)[:, None]
                        gain = np.where(ok, here - (wl * impurity(share(left, wl)) + wr * impurity(share(right, wr))) / mass, -1)
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (float(gain[k]), f, float(cuts[f][k]))
            if best[1] >= 0:
                tree.splits[node] = best[1:]
                after += [2 * node, 2 * node + 1]
            else:
                tree.leaves[node] = np.log((total + max(leak, 1e-6)) / (mass + classes * max(leak, 1e-6)))
        open_nodes = after
        if not open_nodes:
            break
    return tree


def _interval(v: Column, cuts: np.ndarray) -> Column:
    """How many cuts are at or under v, by binary search: nested conditions for few cuts, else halvings of a literal array."""
    if not len(cuts):
        return F.lit(0)

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(v >= F.lit(float(cuts[mid])), search(mid + 1, high)).otherwise(search(low, mid))

    if len(cuts) <= 64:
        return search(0, len(cuts))
    table = A.constant(cuts.tolist())

    def halve(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        mid = F.floor((low + high) / 2).cast("int")
        above = (low < high) & (v >= F.element_at(table, F.least(mid + 1, F.lit(len(cuts)))))
        return F.struct(F.when(above, mid + 1).otherwise(low).alias("low"), F.when((low < high) & ~above, mid).otherwise(high).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high")), halve)["low"]


@dataclass
class Ensemble(Classifier):
    """Weighted votes, or weighted scores, of members."""

    classes: int
    members: list[tuple[float, Classifier]] = field(default_factory=list)
    votes: bool = True

    def scores(self, x: Column) -> Column:
        """One array of the members' labels, then a sum of weights for each class; or the weighted sum of their scores."""
        if self.votes:
            cast = F.array(*(F.struct(m.label(x).alias("y"), F.lit(float(w)).alias("w")) for w, m in self.members))
            share = lambda k: F.aggregate(cast, F.lit(0.0), lambda a, v: a + F.when(v["y"] == k, v["w"]).otherwise(0.0))
            return F.array(*(share(k) for k in range(self.classes)))
        each = [(w, m.scores(x)) for w, m in self.members]
        return F.array(*(sum((F.lit(float(w)) * F.get(s, F.lit(k)) for w, s in each), F.lit(0.0)) for k in range(self.classes)))


def fit_boosted(df: DataFrame, classes: int, rounds: int = 100, depth: int = 2, label: str = "label", weight: str | None = None, method: str = "DISCRETE", shrinkage: float = 0.0) -> Ensemble:
    """Multi-class boosting: weights of errors grow by e^alpha, alpha = ln((1 - e) / e) + ln(K - 1) (1 with GENTLE); ends
    when a tree is no better than chance. Row weights are written out every few rounds, which ends the lineage."""
    rows = df.where(F.col(label) >= 0).select("x", F.col(label).alias("label"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight")).persist()
    cuts = candidate_cuts(rows)
    out = Ensemble(classes)
    for r in range(rounds):
        tree = fit_tree(rows, classes, depth, "label", "weight", cuts=cuts)
        wrong = tree.label(F.col("x")) != F.col("label")
        bad, all_ = rows.agg(F.sum(F.when(wrong, F.col("weight")).otherwise(0.0)), F.sum("weight")).first()
        error = bad / all_
        if error >= 1 - 1 / classes:
            break
        alpha = 1.0 if method == "GENTLE" else float(np.log((1 - max(error, 1e-12)) / max(error, 1e-12)) + np.log(classes - 1))
        alpha *= 1 - shrinkage
        out.members.append((alpha, tree))
        if error <= 1e-12:
            break
        rows = rows.withColumn("weight", F.col("weight") * F.when(wrong, F.lit(float(np.exp(alpha)))).otherwise(1.0) / F.lit(float(all_)))
        rows = cut(rows) if r % 5 == 4 else rows
    return out


def fit_forest(df: DataFrame, classes: int, trees: int = 100, depth: int = 2, key: str = "key", label: str = "label", features: int = 0, seed: int = 0) -> Ensemble:
    """Trees on bootstrap weights (Poisson counts by hash of the key), each on some of the features if so asked."""
    from .sampling import bootstrap

    rows = df.where(F.col(label) >= 0).persist()
    cuts = candidate_cuts(rows)
    rng = np.random.default_rng(seed)
    out = Ensemble(classes)
    for t in range(trees):
        use = sorted(rng.choice(len(cuts), features, replace=False).tolist()) if features else None
        out.members.append((1.0, fit_tree(bootstrap(rows, F.col(key), seed * 100_003 + t).where("weight > 0"), classes, depth, label, "weight", cuts=cuts, features=use)))
    rows.unpersist()
    return out


def lbfgs(value_and_slope: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, max_rounds: int = 1000, history: int = 7, tolerance: float = 1e-6) -> np.ndarray:
    """Limited-memory BFGS with backtracking; each call of the function may be one query over the data."""
    x = start.astype(float)
    f, g = value_and_slope(x)
    s_list: list[np.ndarray] = []
    y_list: list[np.ndarray] = []
    for _ in range(max_rounds):
        if np.linalg.norm(g) <= tolerance * max(1.0, np.linalg.norm(x)):
            break
        q, alphas = g.copy(), []
        for s, y in zip(reversed(s_list), reversed(y_list)):
            a = s @ q / (y @ s)
            alphas.append(a)
            q -= a * y
        if s_list:
            q *= (s_list[-1] @ y_list[-1]) / (y_list[-1] @ y_list[-1])
        for (s, y), a in zip(zip(s_list, y_list), reversed(alphas)):
            q += s * (a - y @ q / (y @ s))
        step, slope = 1.0 if s_list else min(1.0, 1 / np.linalg.norm(g)), -(g @ q)
        for _ in range(30):
            new_f, new_g = value_and_slope(x - step * q)
            if new_f <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * q, new_g - g
        x, gain = x + s, f - new_f
        f, g = new_f, new_g
        if y @ s > 1e-12:
            s_list, y_list = (s_list + [s])[-history:], (y_list + [y])[-history:]
        if gain <= tolerance * 1e-3 * max(1.0, abs(f)):
            break
    return x


@dataclass
class Logistic(Classifier):
    """theta: classes - 1 rows of features and bias; the last class is the reference."""

    classes: int
    theta: np.ndarray

    def scores(self, x: Column) -> Column:
        z = F.concat(x, F.array(F.lit(1.0)))
        return F.array(*(A.weighted(z, row) for row in self.theta.tolist()), F.lit(0.0))


def fit_logistic(df: DataFrame, classes: int, label: str = "label", weight: str | None = None, ridge: float = 1e-9, max_rounds: int = 100) -> Logistic:
    """Mean negative log-likelihood plus half ridge |theta|^2, by L-BFGS on whitened features; a step is one aggregate
    query for the loss and its gradient."""
    white = fit_whitener(df.where(F.col(label) >= 0))
    w = F.col(weight) if weight else F.lit(1.0)
    rows = white.transform(df.where(F.col(label) >= 0).select("x", F.col(label).alias("y"), w.cast("double").alias("w"))).persist()
    d = _dimension(rows)

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        model = Logistic(classes, v.reshape(classes - 1, d + 1))
        scored = rows.select("x", "y", "w", model.scores(F.col("x")).alias("s"))
        scored = scored.select("x", "w", "y", A.softmax(F.col("s")).alias("p"), (A.log_sum_exp(F.col("s")) - F.get("s", F.col("y"))).alias("nll"))
        z = F.concat("x", F.array(F.lit(1.0)))
        cell = scored.select("w", "y", "p", "nll", F.posexplode(z).alias("i", "v"))
        parts = [F.sum(F.col("w") * (F.get("p", F.lit(k)) - F.when(F.col("y") == k, 1.0).otherwise(0.0)) * F.col("v")).alias(f"g{k}") for k in range(classes - 1)]
        got = {r["i"]: r for r in cell.groupBy("i").agg(F.sum(F.col("w") * F.col("nll")).alias("nll"), F.sum("w").alias("w"), *parts).collect()}
        mass = got[0]["w"]
        g = np.array([[got[i][f"g{k}"] for i in range(d + 1)] for k in range(classes - 1)]).ravel() / mass
        return got[0]["nll"] / mass + 0.5 * ridge * float(v @ v), g + ridge * v

    theta = lbfgs(loss, np.zeros((classes - 1) * (d + 1)), max_rounds).reshape(classes - 1, d + 1)
    rows.unpersist()
    flat = theta[:, :d] @ white.projection
    return Logistic(classes, np.column_stack([flat, theta[:, d] - flat @ white.offset]))


@dataclass
class Regression:
    theta: np.ndarray
    bias: bool = True

    def predict(self, x: Column) -> Column:
        return A.weighted(F.concat(x, F.array(F.lit(1.0))) if self.bias else x, self.theta.tolist())


def fit_regression(df: DataFrame, target: str = "y", bias: bool = True, ridge: float = 1e-9, loss: str = "L2", weight: str | None = None, huber: float = 1.0, rounds: int = 30) -> Regression:
    """Least squares by the normal equations, one query. The huber loss is reweighted least squares, a query a round."""
    z = F.concat("x", F.array(F.lit(1.0))) if bias else F.col("x")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    theta = None
    for _ in range(1 if loss == "L2" else rounds):
        base = df.select(F.concat(z, F.array(F.col(target).cast("double"))).alias("x"), w.alias("w"))
        if theta is not None:
            n = len(theta)
            residual = F.abs(F.get("x", F.lit(n)) - A.weighted(F.slice("x", 1, n), theta.tolist()))
            base = base.withColumn("w", F.col("w") * F.when(residual <= huber, 1.0).otherwise(F.lit(huber) / residual))
        mass, mean, cov = moments(base, "w")
        second = cov + np.outer(mean, mean)
        new = np.linalg.solve(second[:-1, :-1] + ridge * np.eye(len(mean) - 1), second[:-1, -1])
        done = theta is not None and np.allclose(new, theta, rtol=1e-8, atol=1e-10)
        theta = new
        if done:
            break
    return Regression(theta, bias)


@dataclass
class Composite(Classifier):
    """Two-class members, one against the rest or one against one, over whitened features, each calibrated."""

    classes: int
    white: Linear
    members: list[tuple[int, int, Classifier, np.ndarray]]

    def scores(self, x: Column) -> Column:
        z = self.white.column(x)
        total = [F.lit(0.0)] * self.classes
        for a, b, m, (slope, shift) in self.members:
            s = m.scores(z)
            p = F.lit(float(slope)) * (F.get(s, F.lit(1)) - F.get(s, F.lit(0))) + F.lit(float(shift))
            total[a] = total[a] + p
            if b >= 0:
                total[b] = total[b] - p
        return F.array(*total)


def fit_composite(df: DataFrame, classes: int, method: str = "ONE-VS-ALL", label: str = "label", rounds: int = 20, depth: int = 2) -> Composite:
    """Class-balanced weights; calibration is a one-feature logistic fit of the member's score."""
    white = fit_whitener(df.where(F.col(label) >= 0))
    rows = white.transform(df.where(F.col(label) >= 0).select("x", F.col(label).alias("y"))).persist()
    pairs = [(a, -1) for a in range(classes)] if method == "ONE-VS-ALL" else [(a, b) for a in range(classes) for b in range(a + 1, classes)]
    members = []
    for a, b in pairs:
        part = rows if b < 0 else rows.where(F.col("y").isin(a, b))
        part = part.select("x", (F.col("y") == a).cast("int").alias("label"))
        n = {r["label"]: r["count"] for r in part.groupBy("label").count().collect()}
        part = part.withColumn("weight", F.when(F.col("label") == 1, F.lit(1.0 / max(1, n.get(1, 0)))).otherwise(F.lit(1.0 / max(1, n.get(0, 0)))))
        member = fit_boosted(part, 2, rounds, depth, weight="weight")
        s = member.scores(F.col("x"))
        margin = part.select(F.array(F.get(s, F.lit(1)) - F.get(s, F.lit(0))).alias("x"), (1 - F.col("label")).alias("label"), "weight")
        fit = fit_logistic(margin, 2, weight="weight", ridge=1e-4, max_rounds=30)
        members.append((a, b, member, fit.theta[0]))
    rows.unpersist()
    return Composite(classes, white, members)


CLASSIFIERS = {"Tree": fit_tree, "Boosted": fit_boosted, "Forest": fit_forest, "Logistic": fit_logistic, "Composite": fit_composite}
TRANSFORMS = {"Whitener": fit_whitener, "Rescale": fit_rescale, "PCA": fit_pca, "LDA": fit_lda, "KMeans": fit_kmeans}


# ---- small programs on the driver -----------------------------------------------------------------------------------


def solve_qp(p: np.ndarray, q: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None, a: np.ndarray | None = None, b: np.ndarray | None = None, g: np.ndarray | None = None, h: np.ndarray | None = None, rounds: int = 4000) -> np.ndarray:
    """Least x'Px/2 + q'x with bounds, a x = b and g x <= h, by alternating directions."""
    n = len(q)
    parts, lows, highs = [np.eye(n)], [np.full(n, -np.inf) if low is None else low], [np.full(n, np.inf) if high is None else high]
    if a is not None:
        parts, lows, highs = [*parts, np.atleast_2d(a)], [*lows, np.atleast_1d(b)], [*highs, np.atleast_1d(b)]
    if g is not None:
        parts, lows, highs = [*parts, np.atleast_2d(g)], [*lows, np.full(len(np.atleast_1d(h)), -np.inf)], [*highs, np.atleast_1d(h)]
    m, lo, hi = np.vstack(parts), np.concatenate(lows), np.concatenate(highs)
    rho = np.where(lo == hi, 1e3, 1.0)
    k = np.linalg.inv(p + 1e-9 * np.eye(n) + m.T @ (rho[:, None] * m))
    z, u, x = np.zeros(len(m)), np.zeros(len(m)), np.zeros(n)
    for _ in range(rounds):
        x = k @ (m.T @ (rho * (z - u)) - q)
        mx = m @ x
        new = np.clip(mx + u, lo, hi)
        u += mx - new
        if np.abs(mx - new).max() < 1e-10 and np.abs(new - z).max() < 1e-10:
            break
        z = new
    return x


def solve_lp(c: np.ndarray, a: np.ndarray, b: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Least c'x with a x = b and x >= 0, by primal-dual interior-point steps from any start."""
    a, n = np.atleast_2d(a).astype(float), len(c)
    x, s, y = np.ones(n), np.ones(n), np.zeros(len(a))
    for _ in range(rounds):
        rp, rd, mu = b - a @ x, c - a.T @ y - s, float(x @ s) / n
        if max(np.abs(rp).max(initial=0), np.abs(rd).max(initial=0), mu) < 1e-10:
            break
        target = 0.1 * mu
        d = x / s
        rhs = rp + a @ (d * (rd - target / x + s))
        dy = np.linalg.lstsq((a * d) @ a.T + 1e-14 * np.eye(len(a)), rhs, rcond=None)[0]
        ds = rd - a.T @ dy
        dx = target / s - x - d * ds
        step = lambda v, dv: min(1.0, 0.99 * float(np.min(np.where(dv < 0, -v / np.where(dv < 0, dv, -1), np.inf))))
        t = min(step(x, dx), step(s, ds))
        x, y, s = x + t * dx, y + t * dy, s + t * ds
    return x


def metric_step(pull: np.ndarray, push: np.ndarray, metric: np.ndarray, rate: float, shrink: float = 0.0) -> np.ndarray:
    """One sub-gradient step of large-margin metric learning: pull and push are sums of outer products of differences over
    violated triplets; the result is projected onto positive semi-definite matrices."""
    m = metric - rate * (pull - push + shrink * np.eye(len(metric)))
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return (vectors * np.maximum(0, values)) @ vectors.T


def fit_metric(nodes: DataFrame, equal: DataFrame, other: DataFrame, rounds: int = 20, rate: float = 0.1, shrink: float = 0.01) -> tuple[np.ndarray, list[float]]:
    """(metric M, losses): hinge losses 1 + d(equal) - d(other) over pairs of edges of a node; nodes (node, x), edges
    (src, dst). Each round is one aggregate of outer products; the rate grows on gains and halves on losses."""
    d = _dimension(nodes)
    side = lambda e, name: e.select("src", "dst").join(nodes.select(F.col("node").alias("src"), F.col("x").alias("a")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("x").alias("b")), "dst").select("src", F.zip_with("a", "b", lambda p, q: p - q).alias(name))
    pairs = side(equal, "p").join(side(other, "q"), "src").persist()
    metric, best, losses = np.eye(d), None, []
    for _ in range(rounds):
        dist = lambda c: A.total(F.zip_with(A.affine(F.col(c), metric.tolist()), F.col(c), lambda u, v: u * v))  # noqa: B023, E731
        hinge = pairs.select("p", "q", (1.0 + dist("p") - dist("q")).alias("l")).where("l > 0")
        outer = lambda c: F.flatten(F.transform(F.col(c), lambda u: F.transform(F.col(c), lambda v: u * v)))
        cell = hinge.select("l", F.posexplode(F.zip_with(outer("p"), outer("q"), lambda u, v: u - v)).alias("i", "v"))
        got = cell.groupBy("i").agg(F.sum("v").alias("g"), F.sum("l").alias("l"), F.count("*").alias("n")).collect()
        n = max(1, got[0]["n"]) if got else 1
        loss = (got[0]["l"] / n if got else 0.0) + shrink * float(np.trace(metric))
        losses.append(loss)
        if best is not None and loss > best[0] * 1.001:
            rate, metric = rate / 2, best[1]
        else:
            rate *= 1.05
        if best is None or loss < best[0]:
            best = (loss, metric)
        g = np.zeros(d * d)
        for r in got:
            g[r["i"]] = r["g"] / n
        metric = metric_step(g.reshape(d, d), np.zeros((d, d)), metric, rate, shrink)
    pairs.unpersist()
    return best[1], losses
