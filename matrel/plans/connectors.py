"""Queries of sources, sinks, stores, networks and streams: what is written is read back. Files go to the session's
shared folder."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import model as M
from ..functions import arrays as A
from ..functions import images as V
from ..functions.hashing import uniform_sql
from ..operators import sampling as P
from ..sources import binary as B
from ..sources import text as T
from ..sources.store import Store
from ..storage import fresh_path as scratch
from ..streaming import incremental as S
from .network import Network
from .tables import read, rounded, vectors

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


@query("text_table", "select cast(p_partkey as varchar) as key, cast(0 as integer) as obs, cast(p_size as double) as a, round(p_retailprice, 4) as b from part")
def text_table(spark, sf_dir):
    path = scratch(spark, "text")
    T.write_text_table(M.observations(read(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"]), path)
    return rounded(T.read_text_table(spark, path).select("key", "obs", F.element_at("x", 1).alias("a"), F.round(F.element_at("x", 2), 4).alias("b")), "a", "b")


@query("binary_files", "select 'n' || n_nationkey as key, cast(0 as integer) as obs, cast(n_nationkey as double) as a, cast(n_regionkey as double) as b from nation")
def binary_files(spark, sf_dir):
    path = scratch(spark, "binary")
    nation = read(spark, sf_dir, "nation").withColumn("k", F.concat(F.lit("n"), "n_nationkey"))
    B.export_files(M.observations(nation, "k", ["n_nationkey", "n_regionkey"]), path).write.format("noop").mode("overwrite").save()
    return B.import_files(spark, path, features=2).select("key", "obs", F.element_at("x", 1).alias("a"), F.element_at("x", 2).alias("b"))


@query("record_store", "select cast(c_custkey as varchar) as key, case when c_custkey % 2 = 0 then round(c_acctbal + 1, 4) else c_acctbal end as v from customer where c_custkey % 5 <> 0")
def record_store(spark, sf_dir):
    """Balances are stored, those of even customers replaced, every fifth customer erased, and the table compacted."""
    s = Store(spark, scratch(spark, "store"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_acctbal").alias("v"), "c_custkey")
    s.write("balance", c.select("key", "v"))
    s.upsert("balance", c.where("c_custkey % 2 = 0").select("key", F.round(F.col("v") + 1, 4).alias("v")))
    s.erase("balance", c.where("c_custkey % 5 = 0").select("key"))
    return s.defragment("balance", 2)


@query("random_records", f"""with r as (select range as id, cast(1 + floor({uniform_sql(0, "range", "'n'")} * 3) as bigint) as n from range(1000)), o as (select id, unnest(range(0, n)) as obs from r), f as (select id, obs, unnest(range(0, 25)) as feat from o)
    select 'REC' || lpad(cast(id as varchar), 5, '0') as key, cast(obs as integer) as obs, cast(feat as integer) as feat, round({uniform_sql(0, "id", "obs", "feat")} * 2.0 - 1.0, 6) as v from f""")
def random_records(spark, sf_dir):
    return M.cells(T.random_table(spark, 1000, 25, 1, 3)).select("key", "obs", "feat", F.round("v", 6).alias("v"))


_POISSON = [sum(math.exp(-1) / math.factorial(k) for k in range(n)) for n in range(1, 12)]


@query("bootstrap_weights", f"select o_orderkey, cast({' + '.join(f'(case when u >= {t!r} then 1 else 0 end)' for t in _POISSON)} as double) as weight from (select o_orderkey, {uniform_sql(1, 'o_orderkey')} as u from orders)")
def bootstrap_weights(spark, sf_dir):
    return P.bootstrap(read(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey"), 1)


@query("random_folds", f"select distinct cast(o_orderkey as varchar) as key, cast(floor({uniform_sql(0, 'o_orderkey')} * 5) as integer) as colour from orders")
def random_folds(spark, sf_dir):
    return M.random_colours(read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key")), 5)


@query("shuffled_top", f"select o_orderkey from orders order by {uniform_sql(3, 'o_orderkey')} limit 50")
def shuffled_top(spark, sf_dir):
    return P.without_replacement(read(spark, sf_dir, "orders").select("o_orderkey"), 50, F.col("o_orderkey"), 3)


@query("box_overlap", "select a.p_partkey as a, b.p_partkey as b, cast(greatest(0, least(a.p_size + 10, b.p_size + 10) - greatest(a.p_size, b.p_size)) as integer) as width from part a join part b on b.p_partkey = a.p_partkey + 1")
def box_overlap(spark, sf_dir):
    """Overlap of boxes of width 10 that start at the part's size."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_partkey").alias("b"), F.col("p_size").alias("s"))
    width = F.greatest(F.lit(0), F.least(F.col("p_size") + 10, F.col("s") + 10) - F.greatest("p_size", "s"))
    return p.join(q, "p_partkey").select(F.col("p_partkey").alias("a"), "b", width.cast("int").alias("width"))


@query("stack_mean_median", "select label, cast(i - 1 as integer) as pixel, round(avg(embedding[i]), 5) + 0.0 as mean, round(median(cast(embedding[i] as double)), 5) + 0.0 as median from (select *, unnest(range(1, 65)) as i from embeddings) group by label, i".replace("avg(embedding[i])", "avg(cast(embedding[i] as double))"))
def stack_mean_median(spark, sf_dir):
    """Vectors as 8 x 8 images: mean and median of each pixel over the images of a label."""
    cell = vectors(spark, sf_dir).select("label", F.posexplode("x").alias("pixel", "v"))
    return rounded(cell.groupBy("label", "pixel").agg(F.avg("v").alias("mean"), F.median("v").alias("median")), "mean", "median")


@query("image_region_sums", "select cast(vec_id as varchar) as key, round(list_sum(list_transform([i for i in range(0, 64) if i // 8 between 2 and 5 and i % 8 between 1 and 4], lambda i: cast(embedding[i + 1] as double))), 4) + 0.0 as s from embeddings")
def image_region_sums(spark, sf_dir):
    """The sum of rows 2 to 5 and columns 1 to 4 of each 8 x 8 image."""
    return rounded(vectors(spark, sf_dir).select("key", F.round(A.total(V.region(F.col("x"), 8, 2, 6, 1, 5)), 4).alias("s")), "s")


_REGION = "list_transform([i for i in range(0, 64) if i // 8 between 2 and 5 and i % 8 between 1 and 4], lambda i: cast(embedding[i + 1] as double))"


@query("image_region_moments", f"select key, round(list_avg(x), 5) + 0.0 as mean, round(list_avg(list_transform(x, lambda v: v * v)), 5) + 0.0 as energy, round(list_avg(list_transform(x, lambda v: v * v)) - list_avg(x) * list_avg(x), 5) + 0.0 as variance from (select cast(vec_id as varchar) as key, {_REGION} as x from embeddings)")
def image_region_moments(spark, sf_dir):
    """Mean, energy and variance of a filter response (the vector as an 8 x 8 image) over a region."""
    m = V.region_moments(V.region(F.col("x"), 8, 2, 6, 1, 5))
    return rounded(vectors(spark, sf_dir).select("key", *(m[c].alias(c) for c in ("mean", "energy", "variance"))), "mean", "energy", "variance")


@query("image_components", """with recursive p as (select vec_id as image, i // 8 as r, i % 8 as c, cast(embedding[i + 1] > 0 as integer) as label from (select *, unnest(range(0, 64)) as i from embeddings)),
    e as (select a.image, a.r * 8 + a.c as s, b.r * 8 + b.c as t from p a join p b on a.image = b.image and a.label = b.label and abs(a.r - b.r) + abs(a.c - b.c) = 1),
    w(image, s, t) as (select image, r * 8 + c, r * 8 + c from p union select w.image, w.s, e.t from w join e on w.image = e.image and w.t = e.s)
    select image, cast(count(distinct m) as bigint) as components, cast(max(n) as bigint) as largest from (select image, m, count(*) as n from (select image, s, min(t) as m from w group by image, s) group by image, m) group by image""")
def image_components(spark, sf_dir):
    """Regions of one sign in each vector as an 8 x 8 image: how many, and the size of the largest."""
    cell = vectors(spark, sf_dir).select(F.col("vec_id").alias("image"), F.posexplode("x").alias("i", "v"))
    pixels = cell.select("image", F.floor(F.col("i") / 8).cast("int").alias("row"), (F.col("i") % 8).alias("col"), (F.col("v") > 0).cast("int").alias("label"))
    size = V.components(pixels, 8).groupBy("image", "component").agg(F.count("*").alias("n"))
    return size.groupBy("image").agg(F.count("*").alias("components"), F.max("n").alias("largest"))


@query("network_scores")
def network_scores(spark, sf_dir):
    """A network: parts, whitened, with a decision tree for "size over 25", and its confusion table."""
    path = scratch(spark, "network")
    part = read(spark, sf_dir, "part").withColumn("large", (F.col("p_size") > 25).cast("double"))
    T.write_text_table(M.observations(part, "p_partkey", ["p_size", "p_retailprice"]), f"{path}/x")
    T.write_text_table(M.observations(part, "p_partkey", ["large"]), f"{path}/y")
    n = Network("parts")
    n.add("data", "text-source", filename=f"{path}/x")
    n.add("target", "text-source", filename=f"{path}/y")
    n.add("white", "whiten")
    n.add("tree", "decision-tree", maxDepth=1)
    n.add("table", "confusion-matrix")
    for source, target, port in (("data", "white", "dataIn"), ("white", "tree", "dataIn"), ("target", "tree", "targetIn"), ("target", "table", "actualIn"), ("tree", "table", "predictedIn")):
        n.connect(source, "dataOut", target, port)
    return Network.from_xml(n.to_xml()).run(spark)["table.tableOut"]


SQL["network_scores"] = "with a as (select unnest(range(0, 2)) as c) select cast(x.c as integer) as actual, cast(y.c as integer) as predicted, cast(case when x.c <> y.c then 0 else (select count(*) from part where (p_size > 25) = (x.c = 1)) end as bigint) as n from a x, a y"


@query("stream_moments", "select event_type, date_trunc('hour', ts) as hour, cast(count(*) as bigint) as n, round(sum(value), 6) as s, round(sum(value * value), 6) as q from events group by 1, 2")
def stream_moments(spark, sf_dir):
    """Extension: hourly moments of the event stream, written by micro-batch; the last value of a window counts."""
    path = scratch(spark, "stream")
    schema = read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = S.running_moments(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", ["event_type"])
    keep = lambda df, number: df.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{path}/out")
    out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/out").groupBy("event_type", F.col("window.start").cast("timestamp_ntz").alias("hour")).agg(F.max_by(F.struct("n", "s", "q"), "batch").alias("m"))
    return rows.select("event_type", "hour", "m.n", F.round("m.s", 6).alias("s"), F.round("m.q", 6).alias("q"))


@query("stream_missing_keys", "select cast(c_custkey as varchar) as key, cast(0 as integer) as obs, c_acctbal as v from customer")
def stream_missing_keys(spark, sf_dir):
    """Extension: only keys that the store lacks are computed; the stream is read twice."""
    path = scratch(spark, "missing")
    src = f"{path}/in"
    read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.lit(0).alias("obs"), F.array("c_acctbal").alias("x")).write.parquet(src)
    store = Store(spark, f"{path}/db")
    for k in range(2):
        S.update_missing_stream(spark.readStream.schema("key string, obs int, x array<double>").parquet(src), store, "t", lambda t: t, f"{path}/cp{k}").awaitTermination()
    return store.read("t").select("key", "obs", F.element_at("x", 1).alias("v"))
