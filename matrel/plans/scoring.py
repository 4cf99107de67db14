"""Queries of the evaluation and learned operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import model as M
from ..functions import arrays as A
from ..functions.hashing import uniform_sql
from ..operators import evaluation as E
from ..operators import learn as L
from .tables import DIGITS, read, rounded, vectors

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


def labels(spark, sf_dir):
    """Actual quality against a prediction that a number makes of the id: three classes, so that rates differ."""
    return read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).cast("int").alias("a"), ((F.col("doc_id") * 7) % 3).cast("int").alias("p"), (F.col("doc_id") % 4).cast("int").alias("item"), F.col("toxic").cast("int").alias("toxic"), ((F.col("doc_id") * 31) % 101).cast("double").alias("score"))


_L = "l as (select doc_id, quality + toxic as a, (doc_id * 7) % 3 as p, doc_id % 4 as item, toxic, cast((doc_id * 31) % 101 as double) as score from labels)"
_N = f"""{_L}, k as (select distinct a as c from l union select distinct p from l), t as (select a.c as a, p.c as p, coalesce(n, 0) as n from k a cross join k p left join (select a, p, count(*) as n from l group by a, p) g on g.a = a.c and g.p = p.c),
    r as (select a as c, sum(n) as n_actual, sum(case when a = p then n else 0 end) as hits from t group by a), q as (select p as c, sum(n) as n_predicted from t group by p),
    s as (select c, hits, n_actual, n_predicted, case when n_predicted > 0 then hits / n_predicted else 1.0 end as precision, case when n_actual > 0 then hits / n_actual end as recall, case when n_actual + n_predicted - hits > 0 then hits / (n_actual + n_predicted - hits) else 1.0 end as jaccard from r join q using (c))"""


@query("confusion", f"with {_N} select cast(a as integer) as actual, cast(p as integer) as predicted, cast(n as bigint) as n from t")
def confusion(spark, sf_dir):
    return E.confusion(labels(spark, sf_dir), "a", "p")


@query("class_scores", f"with {_N} select cast(c as integer) as class, cast(hits as bigint) as hits, cast(n_actual as bigint) as n_actual, cast(n_predicted as bigint) as n_predicted, round(cast(precision as double), 5) as precision, round(cast(recall as double), 5) as recall, round(cast(jaccard as double), 5) as jaccard, round(cast(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) end as double), 5) as f1 from s")
def class_scores(spark, sf_dir):
    return rounded(E.class_scores(E.confusion(labels(spark, sf_dir), "a", "p")), "precision", "recall", "jaccard", "f1")


@query("overall_scores", f"with {_N} select cast(sum(n_actual) as bigint) as total, cast(sum(hits) as bigint) as correct, round(cast(sum(hits) / sum(n_actual) as double), 5) as accuracy, round(cast(avg(case when n_predicted > 0 then precision end) as double), 5) as avg_precision, round(cast(avg(recall) as double), 5) as avg_recall, round(cast(avg(jaccard) as double), 5) as avg_jaccard from s")
def overall_scores(spark, sf_dir):
    return rounded(E.overall(E.confusion(labels(spark, sf_dir), "a", "p")), "accuracy", "avg_precision", "avg_recall", "avg_jaccard")


@query("item_accuracy", f"with {_L} select cast(item as integer) as item, cast(count(*) as bigint) as total, round(cast(avg(case when a = p then 1.0 else 0.0 end) as double), 5) as accuracy from l group by item")
def item_accuracy(spark, sf_dir):
    return rounded(E.pixel_scores(labels(spark, sf_dir), "item", "a", "p").select("item", "total", "accuracy"), "accuracy")


_R = f"""{_L}, r as (select score, sum(toxic) as pos, sum(1 - toxic) as neg from l group by score), c as (select score, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp, (select sum(toxic) from l) as n from r),
    v as (select score, case when n > 0 then tp / n end as recall, case when tp + fp > 0 then tp / (tp + fp) end as precision from c)"""


@query("pr_curve", f"with {_R} select score, round(cast(recall as double), 5) as recall, round(cast(precision as double), 5) as precision from v")
def pr_curve(spark, sf_dir):
    return rounded(E.pr_curve(E.scored_results(labels(spark, sf_dir), "score", "toxic", 1)), "recall", "precision")


@query("average_precision", f"with {_R} select round(cast(avg(p) as double), 5) as average_precision from (select g, coalesce((select max(precision) from v where floor(recall * 10 + 0.000000001) >= g), 0) as p from (select unnest(range(0, 11)) as g))")
def average_precision(spark, sf_dir):
    return rounded(E.average_precision(E.pr_curve(E.scored_results(labels(spark, sf_dir), "score", "toxic", 1))), "average_precision")


# ---- learned ----------------------------------------------------------------------------------------------------------


def parts(spark, sf_dir):
    return M.observations(read(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"])


@query("whitener", "select cast(p_partkey as varchar) as key, round((p_size - avg(p_size) over ()) / stddev_pop(p_size) over (), 5) + 0.0 as a, round((p_retailprice - avg(p_retailprice) over ()) / stddev_pop(p_retailprice) over (), 5) + 0.0 as b from part")
def whitener(spark, sf_dir):
    p = parts(spark, sf_dir)
    return rounded(L.fit_whitener(p).transform(p).select("key", F.element_at("x", 1).alias("a"), F.element_at("x", 2).alias("b")), "a", "b")


@query("linear_regression", "select round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as bias from lineitem")
def linear_regression(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.array("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    t = L.fit_regression(rows, ridge=0.0).theta
    return spark.createDataFrame([(round(float(t[0]), 4), round(float(t[1]), 3))], "slope double, bias double")


_SPLIT = """with d as (select l_quantity as v, l_returnflag as y from lineitem), u as (select distinct v from d), t as (select (v + lead(v) over (order by v)) / 2 as t from u), c as (select t.t, y, sum(case when v < t.t then 1 else 0 end) as l, count(*) as n from t, d where t.t is not null group by t.t, y),
    h as (select t, sum(l) as wl, sum(n) as w, -sum(case when l > 0 then l * log2(l) else 0 end) as el, -sum(case when n > l then (n - l) * log2(n - l) else 0 end) as er from c group by t)"""


@query("best_split", _SPLIT + " select t as threshold from h order by (el + wl * log2(wl) + er + (w - wl) * log2(w - wl)), t limit 1")
def best_split(spark, sf_dir):
    """The cut of quantity that tells return flags best by entropy."""
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    rows = read(spark, sf_dir, "lineitem").select(F.array("l_quantity").alias("x"), flag.alias("label"))
    tree = L.fit_tree(rows, 3, depth=1)
    return spark.createDataFrame([(tree.splits[1][1],)], "threshold double")


@query("kmeans_two_rounds", """
    with recursive x as (select vec_id, i - 1 as f, cast(embedding[i] as double) as v from (select *, unnest(range(1, len(embedding) + 1)) as i from embeddings)),
    c0 as (select k.k, f, v as c from x join (select vec_id, row_number() over (order by vec_id) - 1 as k from embeddings where vec_id < 3) k using (vec_id)),
    a0 as (select vec_id, min_by(k, (d, k)) as k from (select vec_id, k, sum((v - c) * (v - c)) as d from x join c0 using (f) group by vec_id, k) group by vec_id),
    c1 as (select k, f, avg(v) as c from x join a0 using (vec_id) group by k, f),
    a1 as (select vec_id, min_by(k, (d, k)) as k from (select vec_id, k, sum((v - c) * (v - c)) as d from x join c1 using (f) group by vec_id, k) group by vec_id),
    c2 as (select k, f, avg(v) as c from x join a1 using (vec_id) group by k, f)
    select cast(k as integer) as cluster, cast(f as integer) as feat, round(c, 5) + 0.0 as v from c2""")
def kmeans_two_rounds(spark, sf_dir):
    """Two rounds over whole vectors, from the first three."""
    v = vectors(spark, sf_dir).select("vec_id", "x")
    m = L.fit_kmeans(v, 3, "vec_id", max_rounds=2)
    rows = [(k, f, round(float(c), DIGITS) + 0.0) for k, row in enumerate(m.centres) for f, c in enumerate(row)]
    return spark.createDataFrame(rows, "cluster int, feat int, v double")


@query("gaussian_log_density", """
    with m as (select avg(p_size) as a, avg(p_retailprice) as b, var_pop(p_size) as vaa, var_pop(p_retailprice) as vbb, covar_pop(p_size, p_retailprice) as vab from part)
    select cast(p_partkey as varchar) as key, round(-ln(2 * pi()) - 0.5 * ln(vaa * vbb - vab * vab) - 0.5 * ((p_size - a) * (p_size - a) * vbb - 2 * (p_size - a) * (p_retailprice - b) * vab + (p_retailprice - b) * (p_retailprice - b) * vaa) / (vaa * vbb - vab * vab), 4) as ll from part, m""")
def gaussian_log_density(spark, sf_dir):
    p = parts(spark, sf_dir)
    g = L.fit_gaussian(p, ridge=0.0)
    return p.select("key", F.round(g.log_density(F.col("x")), 4).alias("ll"))


def _flags(spark, sf_dir):
    """Order lines by quantity, discount and tax, labelled by whether the discounted quantity is over 23."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return read(spark, sf_dir, "lineitem").select(key.alias("key"), F.array("l_quantity", "l_discount", "l_tax").alias("x"), (F.col("l_quantity") * (1 - F.col("l_discount")) > 23).cast("int").alias("label"))


_F = "f as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as key, [l_quantity, l_discount, l_tax] as x, cast(l_quantity * (1 - l_discount) > 23 as integer) as y, 1.0::double as w from lineitem)"


def _stump(name: str, rows: str) -> str:
    """SQL of the best cut of rows (x, y, w) by entropy, y being 0 or 1: name holds feature, t and the weights on either side."""
    h = lambda a, n: f"(case when {a} > 1e-12 then {a} * log2({a} / {n}) else 0 end)"
    return f"""{name}_u as (select i - 1 as f, x[i] as v, y, w from (select *, unnest([1, 2, 3]) as i from {rows})), {name}_g as (select f, v, sum(w) as n, sum(w * y) as p from {name}_u group by f, v),
    {name}_c as (select f, (v + lead(v) over o) / 2 as t, sum(n) over o as nl, sum(p) over o as pl, sum(n) over (partition by f) as n, sum(p) over (partition by f) as p from {name}_g window o as (partition by f order by v)),
    {name} as (select f, t, nl, pl, n - nl as nr, p - pl as pr from {name}_c where t is not null order by round(-({h('pl', 'nl')} + {h('(nl - pl)', 'nl')} + {h('(p - pl)', '(n - nl)')} + {h('((n - nl) - (p - pl))', '(n - nl)')}) / n, 9), f, t limit 1)"""


def _splits(spark, trees):
    """(tree, node, feature, threshold) of the inner nodes of trees."""
    rows = [(k, n, f, round(float(t), 6)) for k, tree in enumerate(trees) for n, (f, t) in sorted(tree.splits.items())]
    return spark.createDataFrame(rows, "tree int, node int, feature int, threshold double")


@query("decision_tree", f"""with {_F}, {_stump('a', 'f')}, fl as (select r.* from f r, a where r.x[a.f + 1] < t), fr as (select r.* from f r, a where r.x[a.f + 1] >= t), {_stump('b', 'fl')}, {_stump('c', 'fr')}
    select 0::integer as tree, node::integer as node, f::integer as feature, round(t, 6) as threshold from (select 1 as node, f, t from a union all select 2, f, t from b where pl + pr > 0 and pl + pr < nl + nr union all select 3, f, t from c where pl + pr > 0 and pl + pr < nl + nr)""")
def decision_tree(spark, sf_dir):
    """A tree of two levels."""
    return _splits(spark, [L.fit_tree(_flags(spark, sf_dir), 2, depth=2)])


@query("boosted_trees", f"""with {_F}, {_stump('a', 'f')}, fa as (select r.*, cast(case when r.x[a.f + 1] < t then 2 * pl > nl else 2 * pr > nr end as integer) <> y as wrong from f r, a),
    ea as (select sum(case when wrong then w else 0 end) / sum(w) as e, sum(w) as total from fa),
    f2 as (select x, y, w * (case when wrong then (1 - e) / e else 1 end) / total as w from fa, ea), {_stump('b', 'f2')},
    fb as (select r.*, cast(case when r.x[b.f + 1] < t then 2 * pl > nl else 2 * pr > nr end as integer) <> y as wrong from f2 r, b), eb as (select sum(case when wrong then w else 0 end) / sum(w) as e from fb)
    select 0::integer as round, f::integer as feature, round(t, 6) as threshold, round(ln((1 - e) / e), 6) as alpha from a, ea union all select 1, f, round(t, 6), round(ln((1 - e) / e), 6) from b, eb""")
def boosted_trees(spark, sf_dir):
    """Two rounds of stumps."""
    m = L.fit_boosted(_flags(spark, sf_dir), 2, rounds=2, depth=1)
    return spark.createDataFrame([(k, t.splits[1][0], round(float(t.splits[1][1]), 6), round(float(a), 6)) for k, (a, t) in enumerate(m.members)], "round int, feature int, threshold double, alpha double")


_POISSON = [sum(math.exp(-1) / math.factorial(k) for k in range(n)) for n in range(1, 12)]
_WEIGHT = lambda seed: " + ".join(f"(case when {uniform_sql(seed, 'key')} >= {t!r} then 1 else 0 end)" for t in _POISSON)


@query("random_forest", f"""with {_F}, {', '.join(f"g{k}_a as (select x, y, cast({_WEIGHT(k)} as double) as w from f), g{k} as (select * from g{k}_a where w > 0), {_stump(f's{k}', f'g{k}')}" for k in range(3))}
    {' union all '.join(f'select {k}::integer as tree, 1::integer as node, f::integer as feature, round(t, 6) as threshold from s{k}' for k in range(3))}""")
def random_forest(spark, sf_dir):
    """Three stumps, each on a bootstrap."""
    return _splits(spark, [t for _, t in L.fit_forest(_flags(spark, sf_dir), 2, trees=3, depth=1).members])


@query("logistic_regression", """with p as (select l_discount > 0.05 as large, avg(cast(l_returnflag = 'R' as integer)) as p from lineitem group by 1)
    select round(ln((1 - b.p) / b.p) , 3) as bias, round(ln((1 - a.p) / a.p) - ln((1 - b.p) / b.p), 3) as slope from p a, p b where a.large and not b.large""")
def logistic_regression(spark, sf_dir):
    """Class 0 against class 1 (returned) by whether the discount is large: with one feature of two values the fit is that of both shares."""
    rows = read(spark, sf_dir, "lineitem").select(F.array((F.col("l_discount") > 0.05).cast("double")).alias("x"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    slope, bias = L.fit_logistic(rows, 2, max_rounds=50).theta[0]
    return spark.createDataFrame([(round(float(bias), 3), round(float(slope), 3))], "bias double, slope double")


_XY = "r as (select l_quantity as a, l_extendedprice / 1000 as b, cast(l_linestatus = 'F' as integer) as y from lineitem)"


def _two(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.array(F.col("l_quantity"), F.col("l_extendedprice") / 1000).alias("x"), (F.col("l_linestatus") == "F").cast("int").alias("label"))


@query("pca", f"""with {_XY}, m as (select var_pop(a) as p, covar_pop(a, b) as q, var_pop(b) as r from r), e as (select p, q, (p + r) / 2 + s * sqrt((p - r) * (p - r) / 4 + q * q) as value from m, (select unnest([-1, 1]) as s)),
    v as (select value, q as x, value - p as y from e), u as (select value, x / sqrt(x * x + y * y) as x, y / sqrt(x * x + y * y) as y from v)
    select round(value, 4) as variance, round(case when (case when abs(x) >= abs(y) then x else y end) < 0 then -x else x end, 5) as a, round(case when (case when abs(x) >= abs(y) then x else y end) < 0 then -y else y end, 5) as b from u""")
def pca(spark, sf_dir):
    """The components of quantity and price, with the variance along each."""
    rows = _two(spark, sf_dir)
    m = L.fit_pca(rows, normalise=False)
    var = m.transform(rows).agg(*(F.var_pop(F.element_at("x", i)).alias(f"v{i}") for i in (1, 2))).first()
    return spark.createDataFrame([(round(var[i], 4), round(float(r[0]), 5), round(float(r[1]), 5)) for i, r in enumerate(m.projection)], "variance double, a double, b double")


@query("fisher_lda_two", f"""with {_XY}, c as (select y, avg(a) as ma, avg(b) as mb, var_pop(a) as p, covar_pop(a, b) as q, var_pop(b) as r from r group by y), w as (select avg(p) as p, avg(q) as q, avg(r) as r from c),
    d as (select x.ma - z.ma as da, x.mb - z.mb as db, (x.ma + z.ma) / 2 as ca, (x.mb + z.mb) / 2 as cb from c x, c z where x.y = 1 and z.y = 0), v as (select r * da - q * db as x, p * db - q * da as y, ca, cb from d, w),
    u as (select x / sqrt(x * x + y * y) as x, y / sqrt(x * x + y * y) as y, ca, cb from v)
    select round(case when (case when abs(x) >= abs(y) then x else y end) < 0 then -x else x end, 4) as a, round(case when (case when abs(x) >= abs(y) then x else y end) < 0 then -y else y end, 4) as b, round(ca, 5) as centre_a, round(cb, 5) as centre_b from u""")
def fisher_lda_two(spark, sf_dir):
    """The direction in quantity and price that parts line statuses best."""
    m = L.fit_lda(_two(spark, sf_dir))
    (a, b), (p, q) = m.projection[0], m.offset
    return spark.createDataFrame([(round(float(a), 4), round(float(b), 4), round(float(p), 5), round(float(q), 5))], "a double, b double, centre_a double, centre_b double")


def _rounds(n: int) -> str:
    """SQL of n rounds of two means of x (v), from c0 (k, m)."""
    return ", ".join(f"c{i + 1} as (select k, avg(v) as m from (select v, min_by(k, (abs(v - m), k)) as k from x, c{i} group by id, v) group by k)" for i in range(n))


@query("gaussian_mixture_step", f"""with x as (select p_partkey as id, cast(p_size as double) as v from part), c0 as (select row_number() over (order by id) - 1 as k, v as m from (select * from x order by id limit 2)), {_rounds(5)},
    s as (select id, v, min_by(k, (abs(v - m), k)) as k from x, c5 group by id, v), t as (select var_pop(v) as t, count(*) as n from x),
    g as (select k, count(*) / max(n) as p, avg(v) as m, (var_pop(v) + 0.001 * max(t)) / 1.001 + 1e-9 as c from s, t group by k),
    l as (select id, v, k, ln(p) - 0.5 * ln(2 * pi() * c) - 0.5 * (v - m) * (v - m) / c as l from x, g), q as (select id, v, k, exp(l - max(l) over (partition by id)) as e from l),
    r as (select id, v, k, e / sum(e) over (partition by id) as r from q), u as (select k, sum(r) as mass, sum(r * v) / sum(r) as m, sum(r * v * v) / sum(r) as s from r group by k)
    select cast(k as integer) as part, round(mass / n, 4) as weight, round(m, 3) as mean, round((s - m * m + 0.001 * t) / 1.001 + 1e-9, 2) as variance from u, t""")
def gaussian_mixture_step(spark, sf_dir):
    """One step of two Gaussians over part sizes, from the cells of two means."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double")).alias("x"))
    m = L.fit_mixture(rows, 2, "id", max_rounds=1)
    return spark.createDataFrame([(k, round(float(w), 4), round(float(g.mean[0]), 3), round(float(g.cov[0, 0]), 2)) for k, (w, g) in enumerate(zip(m.weights, m.parts))], "part int, weight double, mean double, variance double")


@query("fisher_lda")
def fisher_lda(spark, sf_dir):
    v = vectors(spark, sf_dir).select("key", "obs", "x", F.col("label").cast("int").alias("label"))
    return M.cells(L.fit_lda(v).transform(v).select("key", "obs", "x")).select("key", "feat", F.round("v", DIGITS).alias("v"))


@query("gaussian_mixture")
def gaussian_mixture(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", "x")
    m = L.fit_mixture(v, 2, "vec_id", max_rounds=2)
    return v.select("vec_id", A.argmax(m.log_parts(F.col("x"))).alias("part"), F.round(m.log_density(F.col("x")), 4).alias("ll"))
