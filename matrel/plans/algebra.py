"""Queries of the factor algebra, over factors counted from pairs of categorical columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import factors as X
from ..operators import inference as I
from .tables import DIGITS, read

CARDS = {"f": 3, "s": 2, "n": 7, "q": 5}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = f"with {_SQL} {sql}"
        return fn

    return keep


_SQL = """c as (select case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as f, case l_linestatus when 'F' then 0 else 1 end as s, l_linenumber - 1 as n, cast(least(4, floor(l_quantity / 10.5)) as integer) as q from lineitem),
    fs as (select f, s, cast(count(*) as double) as val from c group by f, s), sn as (select s, n, cast(count(*) as double) as val from c group by s, n), nq as (select n, q, cast(count(*) as double) as val from c group by n, q)"""


def coded(spark, sf_dir):
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return read(spark, sf_dir, "lineitem").select(flag.alias("f"), F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("s"), (F.col("l_linenumber") - 1).alias("n"), F.least(F.lit(4), F.floor(F.col("l_quantity") / 10.5)).cast("int").alias("q"))


def factor(spark, sf_dir, *names):
    return coded(spark, sf_dir).groupBy(*names).agg(F.count("*").cast("double").alias("val"))


def three(spark, sf_dir):
    return factor(spark, sf_dir, "f", "s"), factor(spark, sf_dir, "s", "n"), factor(spark, sf_dir, "n", "q")


def shown(f, digits=DIGITS):
    return f.withColumn("val", F.round("val", digits) + F.lit(0.0))


@query("factor_product", "select f, s, n, round(fs.val * sn.val, 5) as val from fs join sn using (s)")
def factor_product(spark, sf_dir):
    a, b, _ = three(spark, sf_dir)
    return shown(X.product(a, b))


@query("factor_divide", "select f, s, n, round(case when fs.val = 0 then 0 else fs.val / sn.val end, 5) as val from fs join sn using (s)")
def factor_divide(spark, sf_dir):
    a, b, _ = three(spark, sf_dir)
    return shown(X.divide(a, b))


@query("factor_add_subtract", "select f, s, n, round(fs.val + sn.val - 2 * (fs.val - sn.val), 5) as val from fs join sn using (s)")
def factor_add_subtract(spark, sf_dir):
    a, b, _ = three(spark, sf_dir)
    return shown(X.weighted_sum(X.add(a, b), X.subtract(a, b), 1.0, -2.0))


@query("factor_marginalise", "select s, round(sum(val), 5) as val from fs group by s")
def factor_marginalise(spark, sf_dir):
    return shown(X.marginalise(three(spark, sf_dir)[0], "f"))


@query("factor_maximise", "select s, max(val) as val from fs group by s")
def factor_maximise(spark, sf_dir):
    return X.maximise(three(spark, sf_dir)[0], "f")


@query("factor_minimise", "select s, min(val) as val from sn group by s")
def factor_minimise(spark, sf_dir):
    return X.minimise(three(spark, sf_dir)[1], "n")


@query("factor_condition", "select s, val from fs where f = 1")
def factor_condition(spark, sf_dir):
    return X.condition(three(spark, sf_dir)[0], f=1)


@query("factor_normalise", "select f, s, round(val / sum(val) over (), 7) as val from fs")
def factor_normalise(spark, sf_dir):
    return shown(X.normalise(three(spark, sf_dir)[0]), 7)


@query("factor_exp_normalise", "select f, s, round(exp((val - max(val) over ()) / 1000) / sum(exp(val / 1000 - 40)) over () * exp(max(val) over () / 1000 - 40), 7) as val from fs")
def factor_exp_normalise(spark, sf_dir):
    return shown(X.exp_normalise(X.scale(three(spark, sf_dir)[0], 0.001)), 7)


@query("factor_log_normalise", "select f, s, val - max(val) over () as val from fs")
def factor_log_normalise(spark, sf_dir):
    return X.log_normalise(three(spark, sf_dir)[0])


@query("factor_index", "select f, s, cast(f + 3 * s as bigint) as idx, f as f2, s as s2 from fs")
def factor_index(spark, sf_dir):
    a = three(spark, sf_dir)[0].select("f", "s", "val")
    out = a.withColumn("idx", X.entry_index(a, CARDS))
    back = [c.alias(n) for c, n in zip(X.assignment_of(F.col("idx"), ["f", "s"], CARDS), ("f2", "s2"))]
    return out.select("f", "s", "idx", *back)


@query("factor_energy", "select (select val from fs where f = 1 and s = 0) + (select val from sn where s = 0 and n = 2) + (select val from nq where n = 2 and q = 3) as energy")
def factor_energy(spark, sf_dir):
    return X.energy(three(spark, sf_dir), {"f": 1, "s": 0, "n": 2, "q": 3})


@query("factor_conditional", "select f, s, round(val / sum(val) over (partition by s), 7) as val from fs")
def factor_conditional(spark, sf_dir):
    return shown(X.window_normalise(three(spark, sf_dir)[0], ["s"]), 7)


@query("map_bruteforce", "select f, s, n, q, fs.val + sn.val + nq.val as val from fs join sn using (s) join nq using (n) order by val, q, n, s, f limit 1")
def map_bruteforce(spark, sf_dir):
    return X.brute_force_map(three(spark, sf_dir), CARDS)


@query("sum_product_chain", "select q, round(sum(fs.val * sn.val * nq.val), 1) as val from fs join sn using (s) join nq using (n) group by q")
def sum_product_chain(spark, sf_dir):
    """Marginal of q by elimination: each variable is summed out below the next join."""
    return shown(X.eliminate(three(spark, sf_dir), ["f", "s", "n"], cards=CARDS), 1)


@query("max_product_chain", "select min(fs.val + sn.val + nq.val) as val from fs join sn using (s) join nq using (n)")
def max_product_chain(spark, sf_dir):
    return X.eliminate(three(spark, sf_dir), ["f", "s", "n", "q"], combine_with=X.add, fold=X.minimise, cards=CARDS)


@query("factor_same", "select true as same")
def factor_same(spark, sf_dir):
    a, b, _ = three(spark, sf_dir)
    return X.same(X.marginalise(X.product(a, b), "n", "f"), X.marginalise(X.product(b, a), "f", "n"))


@query("junction_tree_map", "select min(fs.val + sn.val + nq.val) as energy from fs join sn using (s) join nq using (n)")
def junction_tree_map(spark, sf_dir):
    graph, _ = I.from_frames(three(spark, sf_dir), CARDS)
    return spark.createDataFrame([(I.solve(graph, "JunctionTree")[1],)], "energy double")


@query("message_passing_map", "select min(fs.val + sn.val + nq.val) as energy from fs join sn using (s) join nq using (n)")
def message_passing_map(spark, sf_dir):
    graph, _ = I.from_frames(three(spark, sf_dir), CARDS)
    return spark.createDataFrame([(I.solve(graph, "AsyncMaxProd")[1],)], "energy double")


@query("sum_product_marginals", """select cast(q as integer) as q, round(sum(p), 6) as p from (select q, fs.val * sn.val * nq.val / (select sum(a.val * b.val * c.val) from fs a join sn b using (s) join nq c using (n)) as p from fs join sn using (s) join nq using (n)) group by q""")
def sum_product_marginals(spark, sf_dir):
    graph, names = I.from_frames(three(spark, sf_dir), CARDS)
    m = I.sum_product(graph)[names.index("q")]
    return spark.createDataFrame([(i, round(float(p), 6)) for i, p in enumerate(m)], "q int, p double")
