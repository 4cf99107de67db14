"""Queries of the keyed-table operators, each with its SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from .. import model as M
from ..functions import arrays as A
from ..functions import stats as S
from ..functions import strings as T
from ..operators import sampling as P
from ..operators import tables as O

DIGITS = 5


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("key"), F.lit(0).alias("obs"), F.col("embedding").cast("array<double>").alias("x"), "label", "vec_id")


def lines(spark, sf_dir):
    """Order lines as records: key is the order, rows its lines."""
    return M.observations(read(spark, sf_dir, "lineitem"), "l_orderkey", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_linenumber", "l_partkey", "l_suppkey"])


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, DIGITS) + F.lit(0.0) for c in columns})


#: SQL of the two sources above in cell form.
VECTORS = "(select cast(vec_id as varchar) as key, vec_id, label, cast(i - 1 as integer) as feat, cast(embedding[i] as double) as v from (select *, unnest(range(1, len(embedding) + 1)) as i from embeddings))"
LINES = """(select key, obs, feat, case feat when 0 then l_quantity when 1 then l_extendedprice when 2 then l_discount else l_tax end as v, l_linenumber from
    (select cast(l_orderkey as varchar) as key, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as integer) as obs, l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, unnest(range(0, 4)) as feat from lineitem))"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


# ---- roll-ups -------------------------------------------------------------------------------------------------------

MOMENTS = {
    "mean": "avg(v)", "variance": "var_pop(v)", "stdev": "stddev_pop(v)", "sum": "sum(v)", "sum-squared": "sum(v * v)", "max": "max(v)", "min": "min(v)", "count": "cast(count(v) as double)",
    "skewness": "case when var_pop(v) > 0 then avg((v - m) * (v - m) * (v - m)) / power(var_pop(v), 1.5) end",
    "kurtosis": "case when var_pop(v) > 0 then avg((v - m) * (v - m) * (v - m) * (v - m)) / (var_pop(v) * var_pop(v)) - 3 end",
}


def _roll(spark, sf_dir, op):
    """Every vector of a label is a row of the label's record."""
    obs = vectors(spark, sf_dir).select(F.col("label").cast("string").alias("key"), F.col("vec_id").cast("int").alias("obs"), "x")
    return rounded(M.cells(O.roll_up(obs, op)).drop("obs"), "v")


for _op, _sql in MOMENTS.items():
    _name = f"rollup_{_op.replace('-', '_')}"
    QUERIES[_name] = partial(_roll, op=_op)
    SQL[_name] = f"select cast(label as varchar) as key, feat, round({_sql}, {DIGITS}) + 0.0 as v from (select *, avg(v) over (partition by label, feat) as m from {VECTORS}) group by label, feat"


@query("rollup_indexed", f"""
    with c as (select * from {LINES}), g as (select key, l_linenumber - 1 as idx, feat, avg(v) as v from c group by key, l_linenumber, feat),
    d as (select key, feat, unnest(range(0, last + 1)) as obs from (select key, max(l_linenumber) - 1 as last from c group by key), (select unnest(range(0, 4)) as feat))
    select d.key, cast(d.obs as integer) as obs, cast(d.feat as integer) as feat, round(coalesce(g.v, 0), {DIGITS}) + 0.0 as v from d left join g on d.key = g.key and d.obs = g.idx and d.feat = g.feat""")
def rollup_indexed(spark, sf_dir):
    obs = lines(spark, sf_dir)
    index = M.observations(read(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber"], ["l_linenumber", "l_partkey", "l_suppkey"])
    index = index.select("key", "obs", (F.element_at("x", 1).cast("int") - 1).alias("idx"))
    return rounded(M.cells(O.roll_up(obs, "mean", index)), "v")


# ---- element-wise ---------------------------------------------------------------------------------------------------

SCALARS = {"sum": "sum(v)", "L1-norm": "sum(abs(v))", "L2-norm": "sqrt(sum(v * v))", "L2-norm-squared": "sum(v * v)"}
VECTOR_OPS = {
    "expAndNormalize": "exp(v - max(v) over w) / sum(exp(v)) over w * exp(max(v) over w)", "exp": "exp(v)", "pow": "v * v",
    "powNormalize": "v * v / sum(v * v) over w", "normalize": "v / sqrt(sum(v * v) over w)", "log": "ln(abs(v) + 1)",
}


def _unary(spark, sf_dir, op):
    obs = vectors(spark, sf_dir).select("key", "obs", "x")
    if op == "log":
        obs = obs.withColumn("x", F.transform("x", lambda v: F.abs(v) + 1.0))
    return rounded(M.cells(O.unary(obs, op, 2.0)).drop("obs"), "v")


for _op, _sql in SCALARS.items():
    QUERIES[_name := f"unary_{_op.replace('-', '_')}"] = partial(_unary, op=_op)
    SQL[_name] = f"select key, 0 as feat, round({_sql}, {DIGITS}) + 0.0 as v from {VECTORS} group by key"
for _op, _sql in VECTOR_OPS.items():
    QUERIES[_name := f"unary_{_op}"] = partial(_unary, op=_op)
    SQL[_name] = f"select key, feat, round({_sql}, {DIGITS}) + 0.0 as v from {VECTORS} window w as (partition by key)"

PAIR_OPS = {"add": "a.v + b.v", "subtract": "a.v - b.v", "multiply": "a.v * b.v", "divide": "case when b.v <> 0 then a.v / b.v end", "min": "least(a.v, b.v)", "max": "greatest(a.v, b.v)"}


def _binary(spark, sf_dir, op):
    v = vectors(spark, sf_dir)
    after = v.select((F.col("vec_id") - 1).cast("string").alias("key"), "obs", "x")
    return rounded(M.cells(O.binary(v.select("key", "obs", "x"), after, op)).drop("obs"), "v")


for _op, _sql in PAIR_OPS.items():
    QUERIES[_name := f"binary_{_op}"] = partial(_binary, op=_op)
    SQL[_name] = f"select a.key, a.feat, round({_sql}, {DIGITS if _op != 'divide' else DIGITS}) + 0.0 as v from {VECTORS} a join {VECTORS} b on b.vec_id = a.vec_id + 1 and a.feat = b.feat"


@query("binary_broadcast_row", f"with c as (select * from {LINES}), o as (select cast(o_orderkey as varchar) as key, o_totalprice as p from orders) select c.key, c.obs, cast(c.feat as integer) as feat, round(c.v + o.p, {DIGITS}) as v from c join o using (key)")
def binary_broadcast_row(spark, sf_dir):
    """N x D lines plus the 1 x 1 total of their order."""
    totals = M.observations(read(spark, sf_dir, "orders"), "o_orderkey", ["o_totalprice"])
    return rounded(M.cells(O.binary(lines(spark, sf_dir), totals, "add")), "v")


@query("concat_features", f"""
    with c as (select key, obs, feat, v from {LINES}), o as (select cast(o_orderkey as varchar) as key, o_totalprice as p from orders)
    select key, obs, cast(feat as integer) as feat, round(v, {DIGITS}) as v from c
    union all select distinct c.key, c.obs, 4, round(o.p, {DIGITS}) from c join o using (key) union all select distinct key, obs, 5, 1.0 from c""")
def concat_features(spark, sf_dir):
    totals = M.observations(read(spark, sf_dir, "orders"), "o_orderkey", ["o_totalprice"])
    return rounded(M.cells(O.concatenate([lines(spark, sf_dir), totals], add_one=True)), "v")


@query("linear_transform", """
    select cast(p_partkey as varchar) as key, round(0.5 * (p_size - 25) - 0.001 * (p_retailprice - 1000), 5) + 0.0 as y0, round((p_size - 25) + 0.002 * (p_retailprice - 1000), 5) + 0.0 as y1 from part""")
def linear_transform(spark, sf_dir):
    obs = M.observations(read(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"])
    out = O.linear(obs, [[0.5, -0.001], [1.0, 0.002]], [25.0, 1000.0])
    return rounded(out.select("key", F.element_at("x", 1).alias("y0"), F.element_at("x", 2).alias("y1")), "y0", "y1")


@query("feature_map_quadratic", """
    with p as (select cast(p_partkey as varchar) as key, p_size / 10.0 as a, p_retailprice / 1000.0 as b from part)
    select key, cast(f as integer) as feat, round(case f when 0 then a when 1 then b when 2 then (a * a - 1) / sqrt(2.0) when 3 then (b * b - 1) / sqrt(2.0) when 4 then a * b else 1.0 end, 5) + 0.0 as v from p, (select unnest(range(0, 6)) as f)""")
def feature_map_quadratic(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.array(F.col("p_size") / 10.0, F.col("p_retailprice") / 1000.0).alias("x"))
    return rounded(p.select("key", F.posexplode(A.feature_map("quadratic", F.col("x"))).alias("feat", "v")), "v")


@query("joint_feature_map", """
    with p as (select cast(p_partkey as varchar) as key, p_size % 3 as y, cast(p_size as double) as a from part)
    select key, cast(f as integer) as feat, round(case when f // 2 = y then case f % 2 when 0 then a else 1.0 end else 0.0 end, 5) as v from p, (select unnest(range(0, 4)) as f)""")
def joint_feature_map(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), (F.col("p_size") % 3).alias("y"), F.array(F.col("p_size").cast("double")).alias("x"))
    return rounded(p.select("key", F.posexplode(A.joint_feature_map("bias", F.col("x"), F.col("y"), 3)).alias("feat", "v")), "v")


@query("vector_scalars", """
    with v as (select key, label, feat, v, abs(v) as p from (select cast(vec_id as varchar) as key, label, cast(i - 1 as integer) as feat, cast(embedding[i] as double) as v from (select *, unnest(range(1, len(embedding) + 1)) as i from embeddings)))
    select key, cast(min_by(feat, (-v, feat)) as integer) as argmax, cast(min_by(feat, (v, feat)) as integer) as argmin, round(log2(sum(p)) - sum(case when p > 0 then p * log2(p) else 0 end) / sum(p), 5) as entropy,
        round(1 - sum(p * p) / (sum(p) * sum(p)), 5) as gini, round(max(v) + ln(sum(exp(v)) / exp(max(v))), 5) as logsumexp, round(1 / (1 + exp(-sum(v * (feat % 3 - 1)))), 5) as logistic, round(sum(case when p <= 0.1 then v * v else 0.1 * (2 * p - 0.1) end), 5) as huber
    from v group by key""")
def vector_scalars(spark, sf_dir):
    x = F.col("x")
    p = F.transform(x, F.abs)
    theta = [float(i % 3 - 1) for i in range(64)]
    out = vectors(spark, sf_dir).select("key", A.argmax(x).alias("argmax"), A.argmin(x).alias("argmin"), A.entropy(p).alias("entropy"), A.gini(p).alias("gini"), A.log_sum_exp(x).alias("logsumexp"), A.logistic(theta, x).alias("logistic"), A.total(F.transform(x, lambda v: A.huber(v, 0.1))).alias("huber"))
    return rounded(out, "entropy", "gini", "logsumexp", "logistic", "huber")


@query("vector_distances", f"""
    select a.key, round(sum((a.v - b.v) * (a.v - b.v)), 5) as l2, round(sum(abs(a.v - b.v)), 5) as l1, round(sqrt(greatest(0, 1 - sum(sqrt(abs(a.v) * abs(b.v))) / sqrt(sum(abs(a.v)) * sum(abs(b.v))))), 5) as bhattacharyya, round(sum(a.v * b.v), 5) + 0.0 as dot
    from {VECTORS} a join {VECTORS} b on b.vec_id = a.vec_id + 1 and a.feat = b.feat group by a.key""")
def vector_distances(spark, sf_dir):
    v = vectors(spark, sf_dir)
    both = v.select("key", F.col("x").alias("a")).join(v.select((F.col("vec_id") - 1).cast("string").alias("key"), F.col("x").alias("b")), "key")
    a, b = F.col("a"), F.col("b")
    out = both.select("key", A.squared_distance(a, b).alias("l2"), A.l1_distance(a, b).alias("l1"), A.bhattacharyya(F.transform(a, F.abs), F.transform(b, F.abs)).alias("bhattacharyya"), A.dot(a, b).alias("dot"))
    return rounded(out, "l2", "l1", "bhattacharyya", "dot")


@query("valid_entries", "select cast(o_orderkey as varchar) as key, o_totalprice > 200000 as below_mark, abs(o_totalprice - round(o_totalprice, 0)) < 1e-6 as whole from orders")
def valid_entries(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where(~A.has_invalid(F.array("o_totalprice")))
    return o.select(F.col("o_orderkey").cast("string").alias("key"), A.below(F.lit(200000.0), F.col("o_totalprice")).alias("below_mark"), A.close(F.col("o_totalprice"), F.round("o_totalprice", 0)).alias("whole"))


@query("sub_vector", f"select key, round(sum(v) filter (where feat in (5, 1, 9)), 5) + 0.0 as s from {VECTORS} group by key")
def sub_vector(spark, sf_dir):
    return rounded(vectors(spark, sf_dir).select("key", A.total(A.sub_vector(F.col("x"), [5, 1, 9])).alias("s")), "s")


# ---- codebook -------------------------------------------------------------------------------------------------------


def _codebook(spark, sf_dir):
    """The first eight vectors: as many rows as the codebook has, whatever the table's size."""
    return [r["x"] for r in vectors(spark, sf_dir).where("vec_id < 8").orderBy("vec_id").select("x").collect()]


def _encode(spark, sf_dir, mode):
    out = O.encode_codebook(vectors(spark, sf_dir).select("key", "obs", "x"), _codebook(spark, sf_dir), mode)
    return out.select("key", F.element_at("x", 1).cast("int").alias("code"))


for _mode, _d in (("nearest-L2", "(a.v - b.v) * (a.v - b.v)"), ("nearest-L1", "abs(a.v - b.v)")):
    QUERIES[_name := f"lut_{_mode.replace('-', '_')}"] = partial(_encode, mode=_mode)
    SQL[_name] = f"select key, cast(min_by(c, (d, c)) as integer) as code from (select a.key, b.vec_id as c, sum({_d}) as d from {VECTORS} a join {VECTORS} b on a.feat = b.feat and b.vec_id < 8 group by a.key, b.vec_id) group by key"
QUERIES["lut_exact"] = partial(_encode, mode="exact")
SQL["lut_exact"] = f"select key, cast(coalesce(min(case when d = 0 then c end), -1) as integer) as code from (select a.key, b.vec_id as c, sum(abs(a.v - b.v)) as d from {VECTORS} a join {VECTORS} b on a.feat = b.feat and b.vec_id < 8 group by a.key, b.vec_id) group by key"


@query("lut_decode", f"with c as (select key, feat, v from {VECTORS} where vec_id < 8) select cast(e.vec_id as varchar) as key, c.feat, round(c.v, 5) + 0.0 as v from embeddings e join c on c.key = case when e.label < 8 then cast(e.label as varchar) else '7' end")
def lut_decode(spark, sf_dir):
    obs = vectors(spark, sf_dir).select("key", "obs", F.array(F.col("label").cast("double")).alias("x"))
    return rounded(M.cells(O.decode_codebook(obs, _codebook(spark, sf_dir))).drop("obs"), "v")


# ---- keys, colours, set operations ----------------------------------------------------------------------------------


@query("colour_filter", "select cast(o_orderkey as varchar) as key from orders where o_orderkey % 7 = 0 or o_orderkey % 5 = 2")
def colour_filter(spark, sf_dir):
    """Orders of colour 2; every seventh order has no colour and matches too."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), "o_orderkey")
    colours = o.where("o_orderkey % 7 <> 0").select("key", (F.col("o_orderkey") % 5).cast("int").alias("colour"))
    return M.of_colour(o.select("key"), colours, 2)


@query("key_union", "select cast(o_custkey as varchar) as key from orders union select cast(c_custkey as varchar) from customer")
def key_union(spark, sf_dir):
    key = lambda t, c: read(spark, sf_dir, t).select(F.col(c).cast("string").alias("key"))
    return O.key_union(key("orders", "o_custkey"), key("customer", "c_custkey"))


@query("update_missing", "select cast(c_custkey as varchar) as key, case when c_custkey % 3 = 0 then -1.0 else round(c_acctbal * 2, 5) end as v from customer")
def update_missing(spark, sf_dir):
    """Keys that are done (every third) stay as they are; the others are computed."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), "c_custkey", "c_acctbal")
    done = c.where("c_custkey % 3 = 0").select("key", F.lit(-1.0).alias("v"))
    return O.update_missing(c, done, lambda t: t.select("key", F.round(F.col("c_acctbal") * 2, 5).alias("v")))


@query("inner_with_target", "select cast(d.doc_id as varchar) as key, cast(l.toxic as integer) as label, case when l.doc_id % 2 = 0 then cast(2 as double) else cast(1 as double) end as weight from documents d join labels l using (doc_id)")
def inner_with_target(spark, sf_dir):
    obs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.lit(0).alias("obs"))
    lab = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("key"), F.lit(0).alias("obs"), F.col("toxic").cast("int").alias("label"), "doc_id")
    weights = lab.where("doc_id % 2 = 0").select("key", "obs", F.lit(2.0).alias("weight"))
    return O.with_target(obs, lab.drop("doc_id"), weights).select("key", "label", "weight")


@query("skip_unknown", "select cast(count(*) as bigint) as n from labels")
def skip_unknown(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return O.known(d.select(F.coalesce("quality", F.lit(-1)).alias("label"))).agg(F.count("*").alias("n"))


@query("dataset_append", "select cast(t as varchar) as source, cast(count(*) as bigint) as n from (select 'a' as t from orders where o_orderkey % 2 = 0 union all select 'b' from orders where o_orderkey % 3 = 0) group by t")
def dataset_append(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey")
    part = lambda m, name: o.where(f"o_orderkey % {m} = 0").select(F.lit(name).alias("source"))
    return part(2, "a").unionByName(part(3, "b")).groupBy("source").agg(F.count("*").alias("n"))


@query("bit_operations", "select cast(p_partkey as varchar) as key, p_size % 2 = 1 and p_size % 3 = 0 as both_set, p_size % 2 = 1 or p_size % 3 = 0 as any_set, (p_size % 2 = 1) <> (p_size % 3 = 0) as xor_set, cast((case when p_size % 2 = 1 then 1 else 0 end) + (case when p_size % 3 = 0 then 1 else 0 end) as integer) as n_set from part")
def bit_operations(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.array(F.col("p_size") % 2 == 1).alias("a"), F.array(F.col("p_size") % 3 == 0).alias("b"))
    op = lambda f: F.element_at(F.zip_with("a", "b", f), 1)
    return p.select("key", op(lambda a, b: a & b).alias("both_set"), op(lambda a, b: a | b).alias("any_set"), op(lambda a, b: a != b).alias("xor_set"), F.size(F.filter(F.concat("a", "b"), lambda v: v)).alias("n_set"))


# ---- statistics -----------------------------------------------------------------------------------------------------

def _suff_sql(by: str, w: str, sign: str = "1.0", pairs: str = "1 = 1") -> str:
    b = f"{by}, " if by else ""
    return f"""with c as (select l_returnflag as y, l_quantity as w, l_linenumber, [l_quantity, l_discount, l_tax] as x from lineitem), n as (select cast(unnest(range(0, 3)) as integer) as i), t as (
        select {b}-1 as i, -1 as j, {w} * ({sign}) as value from c
        union all select {b}n.i, -1, {w} * x[n.i + 1] * ({sign}) from c, n
        union all select {b}a.i, b.i, {w} * x[a.i + 1] * x[b.i + 1] * ({sign}) from c, n a, n b where {pairs})
        select {b}cast(i as integer) as i, cast(j as integer) as j, round(sum(value), 6) + 0.0 as value from t group by {b}i, j"""


def _line_vectors(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("y"), F.col("l_quantity").alias("w"), "l_linenumber", F.array("l_quantity", "l_discount", "l_tax").alias("x"))


def _suff(spark, sf_dir, **more):
    return S.sufficient(_line_vectors(spark, sf_dir), **more).withColumn("value", F.round("value", 6) + F.lit(0.0))


QUERIES["suffstats_full"], SQL["suffstats_full"] = _suff, _suff_sql("", "1.0")
QUERIES["suffstats_weighted"], SQL["suffstats_weighted"] = partial(_suff, weight="w"), _suff_sql("", "w")
QUERIES["suffstats_diagonal"], SQL["suffstats_diagonal"] = partial(_suff, pairs="diag"), _suff_sql("", "1.0", pairs="a.i = b.i")
QUERIES["cond_suffstats"], SQL["cond_suffstats"] = partial(_suff, by=["y"]), _suff_sql("y", "1.0")


@query("suffstats_subtract", _suff_sql("", "1.0", "case when l_linenumber > 3 then 1.0 else 0.0 end"))
def suffstats_subtract(spark, sf_dir):
    v = _line_vectors(spark, sf_dir)
    left = S.subtract(S.sufficient(v), S.sufficient(v.where("l_linenumber <= 3")))
    return left.withColumn("value", F.round("value", 6) + F.lit(0.0))


@query("cond_suffstats_redistribute", _suff_sql("y", "1.0").replace("select l_returnflag as y", "select case l_returnflag when 'R' then 'A' else l_returnflag end as y"))
def cond_suffstats_redistribute(spark, sf_dir):
    out = S.redistribute(S.sufficient(_line_vectors(spark, sf_dir), by=["y"]), "y", "R", "A")
    return out.withColumn("value", F.round("value", 6) + F.lit(0.0))


@query("order_statistics", """
    with m as (select event_type, avg(value) as a from events group by event_type),
    f as (select event_type, value, count(*) as n from events group by event_type, value), o as (select event_type, min_by(value, (-n, value)) as mode from f group by event_type)
    select e.event_type, min(value) as low, max(value) as high, max(value) - min(value) as spread, round(avg(value), 5) as mean, round(median(value), 5) as median, round(var_pop(value), 4) as variance, round(stddev_pop(value), 5) as stdev, round(kurtosis_pop(value), 5) as kurtosis, any_value(o.mode) as mode
    from events e join o using (event_type) group by e.event_type""")
def order_statistics(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    v = F.col("value")
    out = e.groupBy("event_type").agg(F.min(v).alias("low"), F.max(v).alias("high"), (F.max(v) - F.min(v)).alias("spread"), F.round(F.avg(v), 5).alias("mean"), F.round(F.median(v), 5).alias("median"), F.round(F.var_pop(v), 4).alias("variance"), F.round(F.stddev_pop(v), 5).alias("stdev"), F.round(F.kurtosis(v), 5).alias("kurtosis"))
    return out.join(S.mode(e, "value", ["event_type"]), "event_type")


_HIST = """h as (select event_type, cast(least(19, greatest(0, floor(value / 25.0))) as integer) as bin, cast(count(*) as double) as n from events group by 1, 2),
    d as (select event_type, cast(bin as integer) as bin from (select distinct event_type from events), (select unnest(range(0, 20)) as bin)),
    g as (select d.event_type, d.bin, coalesce(h.n, 0.0) as mass from d left join h using (event_type, bin)),
    s as (select *, mass / sum(mass) over (partition by event_type) as share from g)"""


@query("histogram", f"with {_HIST} select event_type, bin, mass, round(share, 5) as share, round(sum(share) over (partition by event_type order by bin), 5) as cdf from s")
def histogram(spark, sf_dir):
    return rounded(S.histogram(read(spark, sf_dir, "events"), "value", 0.0, 500.0, 20, ["event_type"]), "share", "cdf")


@query("histogram_distances", f"""with {_HIST}, t as (select bin, mass / sum(mass) over () as share from (select bin, sum(mass) as mass from g group by bin)),
    e as (select event_type, -sum(case when share > 0 then share * ln(share) else 0 end) as entropy from s group by event_type)
    select s.event_type, round(0.5 * sum(case when s.share + t.share > 0 then (s.share - t.share) * (s.share - t.share) / (s.share + t.share) else 0 end), 5) as chi, round(sqrt(sum((s.share - t.share) * (s.share - t.share))), 5) as euclid, round(any_value(e.entropy), 5) as entropy
    from s join t using (bin) join e using (event_type) group by s.event_type""")
def histogram_distances(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    h = S.histogram(e, "value", 0.0, 500.0, 20, ["event_type"])
    whole = h.select("event_type").distinct().crossJoin(F.broadcast(S.histogram(e, "value", 0.0, 500.0, 20)).select("bin", "share"))
    chi = S.histogram_distance(h, whole, "chi-squared", ["event_type"]).withColumnRenamed("distance", "chi")
    euclid = S.histogram_distance(h, whole, "euclidean", ["event_type"]).withColumnRenamed("distance", "euclid")
    return rounded(chi.join(euclid, "event_type").join(S.histogram_entropy(h, ["event_type"]), "event_type"), "chi", "euclid", "entropy")


@query("percentile_rank", "select event_id, round((rank() over (partition by event_type order by value) - 1) / count(*) over (partition by event_type), 5) as pct from events")
def percentile_rank(spark, sf_dir):
    return rounded(S.percentile(read(spark, sf_dir, "events"), "value", ["event_type"]).select("event_id", "pct"), "pct")


@query("percentile_global", "select o_orderkey, round((rank() over (order by o_totalprice) - 1) / count(*) over (), 5) as pct from orders")
def percentile_global(spark, sf_dir):
    return rounded(S.percentile(read(spark, sf_dir, "orders"), "o_totalprice").select("o_orderkey", "pct"), "pct")


@query("remove_outliers", "select event_id from (select event_id, row_number() over (partition by event_type order by value, event_id) - 1 as r, count(*) over (partition by event_type) as n from events) where r >= floor((n - 100) / 2) and r < floor((n - 100) / 2) + 100")
def remove_outliers(spark, sf_dir):
    return S.remove_outliers(read(spark, sf_dir, "events"), "value", "event_id", 100, ["event_type"]).select("event_id")


@query("colour_histogram", "select cast(p_size // 8 as integer) as r, cast(cast(p_retailprice as integer) % 256 // 32 as integer) as g, cast(p_partkey % 256 // 32 as integer) as b, round((count(*) + 1.0) / (any_value(t.n) + 512), 5) as p from part, (select count(*) as n from part) t group by 1, 2, 3")
def colour_histogram(spark, sf_dir):
    """Three channels in 8 levels each, one pseudo-count for each of the 512 cells."""
    p = read(spark, sf_dir, "part")
    level = lambda c: F.shiftright(c.cast("int"), 5)
    cell = p.select(F.floor(F.col("p_size") / 8).cast("int").alias("r"), level(F.round("p_retailprice").cast("int") % 256).alias("g"), level(F.col("p_partkey") % 256).alias("b"))
    n = cell.groupBy("r", "g", "b").agg(F.count("*").alias("n"))
    total = p.agg(F.count("*").alias("all"))
    return n.crossJoin(F.broadcast(total)).select("r", "g", "b", F.round((F.col("n") + 1.0) / (F.col("all") + 512), DIGITS).alias("p"))


@query("integral_image", "select cast(r as integer) as r, cast(c as integer) as c, cast(sum(n) over (order by r rows unbounded preceding) as bigint) as s from (select r, c, sum(n) over (partition by r order by c) as n from (select l_linenumber as r, cast(l_quantity as integer) % 10 as c, count(*) as n from lineitem group by 1, 2)) where c = 9")
def integral_image(spark, sf_dir):
    """Prefix sums along rows and then down columns of the grid of lines by number and quantity; the last column."""
    from pyspark.sql import Window

    grid = read(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("r"), (F.col("l_quantity").cast("int") % 10).alias("c")).agg(F.count("*").alias("n"))
    across = grid.withColumn("n", F.sum("n").over(Window.partitionBy("r").orderBy("c")))
    return across.withColumn("s", F.sum("n").over(Window.partitionBy("c").orderBy("r"))).where("c = 9").select("r", "c", "s")


# ---- sampling -------------------------------------------------------------------------------------------------------


@query("balanced_subsample", """with r as (select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by (o_orderkey * 7919) % 10007, o_orderkey) as r, count(*) over (partition by o_orderstatus) as n from orders)
    select o_orderkey from r where r <= ceil((select max(n) from r) / 10.0)""")
def balanced_subsample(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", ((F.col("o_orderkey") * 7919) % 10007).alias("o"))
    return P.balanced(o, "o_orderstatus", 10, ["o", "o_orderkey"]).select("o_orderkey")


@query("subsample_one_in_r", "select o_orderkey from orders where o_orderkey % 4 = 0")
def subsample_one_in_r(spark, sf_dir):
    return P.one_in(read(spark, sf_dir, "orders"), 4, F.col("o_orderkey")).select("o_orderkey")


@query("spaces", "select cast(i as integer) as i, round(cast(2 + i * 0.8 as double), 5) as lin, round(exp(ln(0.001) + i * (ln(1000.0) - ln(0.001)) / 10), 5) as log, cast(ceil((i * 7) / 8.0) * 8 as bigint) as up from (select unnest(range(0, 11)) as i)")
def spaces(spark, sf_dir):
    lin, log = A.linear_space(2.0, 10.0, 11), A.log_space(0.001, 1000.0, 11)
    rows = spark.range(1).select(F.posexplode(F.arrays_zip(lin.alias("lin"), log.alias("log"))).alias("i", "z"))
    return rows.select("i", F.round("z.lin", DIGITS).alias("lin"), F.round("z.log", DIGITS).alias("log"), A.round_up(F.col("i") * 7, 8).alias("up"))


@query("power_set", "select s from (select list_filter([1, 2, 3], lambda v: (m >> (v - 1)) & 1 = 1) as s from (select unnest(range(0, 8)) as m)) where len(s) = 2".replace("select s from", "select cast(list_sum(s) as bigint) as total from"))
def power_set(spark, sf_dir):
    sets = spark.range(1).select(F.explode(A.power_set(F.array(F.lit(1), F.lit(2), F.lit(3)))).alias("s"))
    return sets.where(F.size("s") == 2).select(F.aggregate("s", F.lit(0), lambda a, v: a + v).cast("long").alias("total"))


# ---- strings --------------------------------------------------------------------------------------------------------


@query("string_functions", """
    select p_partkey, lpad_keep as padded, spaced, upper_first, replaced, case when upper(p_brand) < 'BRAND#3' then -1 when upper(p_brand) > 'BRAND#3' then 1 else 0 end as against from
    (select *, case when length(p_brand) >= 6 then p_brand else lpad(p_brand, 6, '0') end as lpad_keep, trim(regexp_replace(regexp_replace('blueGreenRED', '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')) as spaced, p_size % 2 = 0 as upper_first, replace(p_name, ' ', '_') as replaced from part)""")
def string_functions(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", T.pad(F.col("p_brand"), 6).alias("padded"), T.space_out(F.lit("blueGreenRED")).alias("spaced"), T.true_string(F.when(F.col("p_size") % 2 == 0, "yes").otherwise("no")).alias("upper_first"), T.replace_all(F.col("p_name"), " ", "_").alias("replaced"), T.compare_no_case(F.col("p_brand"), F.lit("brand#3")).alias("against"))


@query("path_functions", r"""
    select page_id, regexp_extract(url, '([^/]*)$', 1) as file, case when instr(url, '/') = 0 then '.' else regexp_replace(url, '/[^/]*$', '') end as dir, regexp_extract(regexp_extract(url, '([^/]*)$', 1), '\.([^.]*)$', 1) as ext,
        regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^./]*$', '') as base, cast(coalesce(try_cast(regexp_extract(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^./]*$', ''), '([0-9]{1,9})$', 1) as integer), -1) as integer) as num from pages""")
def path_functions(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", T.file_name(url).alias("file"), T.directory(url).alias("dir"), T.extension(url).alias("ext"), T.base_name(url).alias("base"), T.file_index(url).alias("num"))


@query("size_and_time_text", "select o_orderkey, printf('%d:%02d:%02d.%03d', o_orderkey * 997 // 3600000, (o_orderkey * 997 // 60000) % 60, (o_orderkey * 997 // 1000) % 60, (o_orderkey * 997) % 1000) as took, case when o_orderkey < 1000 then cast(o_orderkey as varchar) || 'b' else printf('%.1fkB', round(o_orderkey / 1000.0 + 0.000001, 1)) end as size from orders where o_orderkey < 900000")
def size_and_time_text(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", T.milliseconds_text(F.col("o_orderkey") * 997).alias("took"), T.bytes_text(F.col("o_orderkey")).alias("size"))


@query("name_values", "select event_id, cast(regexp_extract(props, '([0-9]+)', 1) as integer) as k, 'true' as flag from events")
def name_values(spark, sf_dir):
    text = F.concat(F.lit("k="), F.regexp_extract("props", "([0-9]+)", 1), F.lit("; flag"))
    m = T.parse_name_values(text)
    return read(spark, sf_dir, "events").select("event_id", F.element_at(m, "k").cast("int").alias("k"), F.element_at(m, "flag").alias("flag"))


@query("parse_vector", "select p_partkey, cast(p_size as double) as a, cast('inf' as double) as b, cast(null as double) as c from part")
def parse_vector(spark, sf_dir):
    v = T.parse_vector(F.concat(F.col("p_size").cast("string"), F.lit("  inf abc")))
    return read(spark, sf_dir, "part").select("p_partkey", F.get(v, F.lit(0)).alias("a"), F.get(v, F.lit(1)).alias("b"), F.get(v, F.lit(2)).alias("c"))
