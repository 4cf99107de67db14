"""Queries of the graph operators, over neighbour graphs of embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import uniform_sql
from ..operators import graphs as G
from ..storage import cut
from .tables import DIGITS, read

QUERIES: dict = {}
SQL: dict[str, str] = {}

_V = "v as (select vec_id as node, vec_id % 20 as grp, label, list_transform(embedding, lambda z: cast(z as double)) as x from embeddings)"
_D = "list_sum(list_transform(range(1, 65), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i])))"
_E = f"""{_V}, p as (select a.node as src, b.node as dst, b.grp as dst_grp, {_D} as weight from v a join v b on a.grp <> b.grp),
    g as (select *, row_number() over (partition by src, dst_grp order by weight, dst) as gr from p), e as (select * from (select *, row_number() over (partition by src order by weight, dst) as rank from g where gr = 1) where rank <= 3)"""
_S = "s as (select vec_id as src, (vec_id * 7 + 3) % (select count(*) from embeddings) as dst, cast((vec_id * 13) % 17 + 1 as double) as w from embeddings where vec_id % 3 <> 0 and vec_id <> (vec_id * 7 + 3) % (select count(*) from embeddings))"


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = f"with recursive {sql}"
        return fn

    return keep


def nodes(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), (F.col("vec_id") % 20).cast("int").alias("grp"), F.lit(-1).alias("eqv"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("x"))


def sparse(spark, sf_dir):
    """A sparse graph made of numbers alone."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    n = F.broadcast(e.agg(F.count("*").alias("n")))
    s = e.crossJoin(n).select(F.col("id").alias("src"), ((F.col("id") * 7 + 3) % F.col("n")).alias("dst"), ((F.col("id") * 13) % 17 + 1).cast("double").alias("w"))
    return e, s.where("src % 3 <> 0 and src <> dst")


@query("knn_exhaustive", f"{_E} select src, dst, round(weight, 4) as weight, cast(rank as integer) as rank from e")
def knn_exhaustive(spark, sf_dir):
    return G.exhaustive(nodes(spark, sf_dir), 3).withColumn("weight", F.round("weight", 4))


@query("knn_label_equal", f"{_V}, p as (select a.node as src, b.node as dst, {_D} as weight from v a join v b on a.grp <> b.grp and a.label = b.label), e as (select *, row_number() over (partition by src order by weight, dst) as rank from p) select src, dst, round(weight, 4) as weight, cast(rank as integer) as rank from e where rank <= 2")
def knn_label_equal(spark, sf_dir):
    return G.exhaustive(nodes(spark, sf_dir), 2, "label-equal", per_group=False).withColumn("weight", F.round("weight", 4))


@query("knn_enrichment", f"{_E}, c as (select src, dst from e union select dst, src from e union select a.src, b.dst from e a join e b on a.dst = b.src where a.src <> b.dst), q as (select c.src, c.dst, p.dst_grp, p.weight from c join p using (src, dst)), h as (select *, row_number() over (partition by src, dst_grp order by weight, dst) as gr from q) select src, dst, round(weight, 4) as weight, cast(rank as integer) as rank from (select *, row_number() over (partition by src order by weight, dst) as rank from h where gr = 1) where rank <= 3")
def knn_enrichment(spark, sf_dir):
    v = nodes(spark, sf_dir)
    e = cut(G.exhaustive(v, 3))  # read four times below
    return G.improve(e, G.enrich(e), v, 3).withColumn("weight", F.round("weight", 4))


@query("label_transfer", f"{_E}, k as (select e.src, l.label, row_number() over (partition by e.src order by e.weight, e.dst) as r from e join v l on l.node = e.dst where l.node % 4 <> 0), t as (select src, label, sum(1.0 / r) as v from k group by src, label) select src as node, cast(min_by(label, (-v, label)) as integer) as label from t group by src")
def label_transfer(spark, sf_dir):
    """Labels from three neighbours; every fourth node counts as unlabelled."""
    v = nodes(spark, sf_dir)
    known = v.select("node", F.when(F.col("node") % 4 != 0, F.col("label")).otherwise(-1).alias("label"))
    return G.label_transfer(G.exhaustive(v, 3), known, 10).select("node", "label")


@query("graph_energy", f"{_E} select round(sum(weight), 3) as energy, round(sum(case when rank = 1 then weight end), 3) as best_energy, cast(count(*) as bigint) as n_edges from e")
def graph_energy(spark, sf_dir):
    e = G.graph_energy(G.exhaustive(nodes(spark, sf_dir), 3))
    return e.select(F.round("energy", 3).alias("energy"), F.round("best_energy", 3).alias("best_energy"), "n_edges")


_DIRECTION = [((i * 37) % 11 - 5) / 5.0 for i in range(64)]


@query("random_projection", f"""{_V}, o as (select node, row_number() over (order by list_dot_product(x, {_DIRECTION}::double[]), node) as place from v), c as (select a.node as src, b.node as dst from o a join o b on abs(a.place - b.place) between 1 and 10),
    q as (select src, dst, b.grp as dst_grp, {_D} as weight from c join v a on a.node = src join v b on b.node = dst where a.grp <> b.grp), g as (select *, row_number() over (partition by src, dst_grp order by weight, dst) as gr from q), m as (select src, dst, weight, row_number() over (partition by src order by weight, dst) as rank from g where gr = 1)
    select src, dst, round(weight, 4) as weight, cast(rank as integer) as rank from m where rank <= 3""")
def random_projection(spark, sf_dir):
    """Neighbours by one projection with a horizon of 10, scored and cut to 3."""
    v = nodes(spark, sf_dir)
    return G.top_edges(G.scored(G.projection_candidates(v, _DIRECTION, 10), v), 3).withColumn("weight", F.round("weight", 4))


@query("neighbours", f"{_S}, b as (select src, dst from s union select dst, src from s) select src, list(dst order by dst) as neighbours from b group by src")
def neighbours(spark, sf_dir):
    return G.neighbours(sparse(spark, sf_dir)[1])


@query("components", f"{_S}, b as (select src, dst from s union select dst, src from s), r(node, other) as (select vec_id, vec_id from embeddings union select r.node, b.dst from r join b on r.other = b.src) select node as id, min(other) as component from r group by node")
def components(spark, sf_dir):
    return G.connected_components(*sparse(spark, sf_dir))


# every node has at most one edge that goes out, so a component has at most one cycle: the forest lacks its heaviest edge
@query("spanning_forest", f"""{_S}, r(a, b) as (select src, dst from s union select r.a, s.dst from r join s on r.b = s.src), c as (select a from r where a = b), k as (select a, min(b) as cycle from r where a in (select a from c) and b in (select a from c) group by a),
    e as (select s.src as id, least(src, dst) as p, greatest(src, dst) as q, w, cycle from s left join k on k.a = s.src), o as (select id, p, q, w, cycle, row_number() over (partition by cycle order by w desc, p desc, q desc, id) as n from e)
    select p as src, q as dst, w from o where cycle is null or n > 1""")
def spanning_forest(spark, sf_dir):
    return G.spanning_forest(*sparse(spark, sf_dir))


@query("shortest_paths", f"{_S}, b as (select src, dst, w from s union all select dst, src, w from s), r(id, distance, seen) as (select cast(1 as bigint), cast(0 as double), [cast(1 as bigint)] union all select b.dst, r.distance + b.w, list_append(seen, b.dst) from r join b on r.id = b.src where not list_contains(seen, b.dst)) select cast(1 as bigint) as source, id, min(distance) as distance from r group by id")
def shortest_paths(spark, sf_dir):
    """From node 1. The SQL goes along every path without a loop; a component has one cycle at most, so they are few."""
    e, s = sparse(spark, sf_dir)
    return G.shortest_paths(s, e.where("id = 1"))


_N = "s as (select cast(n_nationkey as bigint) as src, cast((n_nationkey * 7 + 3) % 25 as bigint) as dst, cast(n_nationkey % 4 + n_regionkey + 1 as double) as w from nation where n_nationkey <> (n_nationkey * 7 + 3) % 25)"


@query("all_pairs_paths", f"{_N}, b as (select src, dst, w from s union all select dst, src, w from s), r(source, id, distance, seen) as (select cast(n_nationkey as bigint), cast(n_nationkey as bigint), cast(0 as double), [cast(n_nationkey as bigint)] from nation union all select source, b.dst, r.distance + b.w, list_append(seen, b.dst) from r join b on r.id = b.src where not list_contains(seen, b.dst)) select source, id, min(distance) as distance from r group by source, id")
def all_pairs_paths(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_regionkey")
    s = n.select(F.col("id").alias("src"), ((F.col("id") * 7 + 3) % 25).alias("dst"), (F.col("id") % 4 + F.col("n_regionkey") + 1).cast("double").alias("w")).where("src <> dst")
    return G.all_pairs_paths(n, s)


#: A random graph of eight buckets, and what is left of candidates c (src, dst) and its edges after a move.
_RANDOM = f"""{_V}, b as (select node, s, floor(case s when 0 then {uniform_sql(0, "node")} else {uniform_sql(1, "node")} end * 8) as bucket from v, (select unnest([0, 1]) as s)),
    near as (select node as src, lead(node) over (partition by s, bucket order by {uniform_sql(1, "node")}, node) as dst from b), n as (select src, dst from near where dst is not null union select dst, src from near where dst is not null),
    n_g as (select src, dst, b.grp as dst_grp, {_D} as weight from n join v a on a.node = src join v b on b.node = dst where a.grp <> b.grp), n_r as (select *, row_number() over (partition by src, dst_grp order by weight, dst) as gr from n_g),
    e as (select * from (select src, dst, weight, row_number() over (partition by src order by weight, dst) as rank from n_r where gr = 1) where rank <= 3)"""
_MOVED = f"""q as (select src, dst, b.grp as dst_grp, {_D} as weight from (select src, dst from c union select src, dst from e) join v a on a.node = src join v b on b.node = dst where a.grp <> b.grp), q_r as (select *, row_number() over (partition by src, dst_grp order by weight, dst) as gr from q),
    m as (select * from (select src, dst, weight, row_number() over (partition by src order by weight, dst) as rank from q_r where gr = 1) where rank <= 3)"""
_EDGES = "select src, dst, round(weight, 4) as weight, cast(rank as integer) as rank from"
_NEAR = "t as (select node, node + 1 as near from v where node + 1 in (select node from v) union all select node, node - 1 from v where node - 1 in (select node from v))"


def _start(spark, sf_dir):
    v = nodes(spark, sf_dir)
    return v, G.random_graph(v, 3, buckets=8)


def _adjacent(v):
    """Nodes of neighbouring numbers, as pixels of an image would be."""
    n = v.select("node")
    both = n.select("node", F.explode(F.array(F.col("node") + 1, F.col("node") - 1)).alias("near"))
    return both.join(n.select(F.col("node").alias("near")), "near", "left_semi")


def _shown(e):
    return e.select("src", "dst", F.round("weight", 4).alias("weight"), "rank")


@query("knn_random", f"{_RANDOM} {_EDGES} e")
def knn_random(spark, sf_dir):
    return _shown(_start(spark, sf_dir)[1])


@query("knn_propagate", f"{_RANDOM}, {_NEAR}, c as (select p.near as src, q.near as dst from e join t p on p.node = e.src join t q on q.node = e.dst where p.near <> q.near), {_MOVED} {_EDGES} m")
def knn_propagate(spark, sf_dir):
    v, e = _start(spark, sf_dir)
    return _shown(G.improve(e, G.propagate(G.with_states(e), _adjacent(v)), v, 3))


@query("knn_local", f"{_RANDOM}, {_NEAR}, c as (select e.src, t.near as dst from e join t on t.node = e.dst where e.src <> t.near), {_MOVED} {_EDGES} m")
def knn_local(spark, sf_dir):
    v, e = _start(spark, sf_dir)
    return _shown(G.improve(e, G.local_moves(e, _adjacent(v)), v, 3))


@query("knn_search", f"""{_RANDOM}, gs as (select grp, count(*) as size, row_number() over (order by grp) - 1 as number from v group by grp), inside as (select grp, node, row_number() over (partition by grp order by node) - 1 as place from v),
    d as (select node as src, floor({uniform_sql(5, "node", "'group'")} * (select count(*) from gs)) as number, {uniform_sql(5, "node", "'node'")} as u from v),
    c as (select src, node as dst from d join gs using (number) join inside on inside.grp = gs.grp and inside.place = floor(u * size) where src <> node), {_MOVED} {_EDGES} m""")
def knn_search(spark, sf_dir):
    v, e = _start(spark, sf_dir)
    return _shown(G.improve(e, G.search_moves(v, 5), v, 3))


@query("knn_states", f"{_RANDOM}, {_NEAR}, c as (select e.src, t.near as dst from e join t on t.node = e.dst where e.src <> t.near), {_MOVED} select m.src, m.dst, cast(case when e.src is null then 0 else 1 end as integer) as state from m left join e on e.src = m.src and e.dst = m.dst")
def knn_states(spark, sf_dir):
    """Edges after a local move: 0 for new ones, 1 for those that were there."""
    v, e = _start(spark, sf_dir)
    return G.with_states(G.improve(e, G.local_moves(e, _adjacent(v)), v, 3), G.with_states(e)).select("src", "dst", "state")
