"""Graph operators: iterated queries for large graphs, plain Python for the small graphs of factor planning."""

from __future__ import annotations

import heapq
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.hashing import dealt, uniform
from ..functions.stats import running_total
from ..storage import cut
from .nearest import FOUND, PACKED, block_neighbours, pack, pair_distances

#: Edges between components that one task makes a forest of.
FEW_EDGES = 200_000
#: Vectors of a block of nodes whose neighbours are looked for exhaustively, of those on the right that a task meets, and of
#: nodes that share a part where only equal labels match; tasks at least.
BLOCK_BYTES, RIGHT_BYTES, PART_BYTES = 32 << 20, 192 << 20, 16 << 20
TASKS = 12


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges (src, dst[, w]) in either direction."""
    more = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *more).union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *more))


def neighbours(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


def supersets(cliques: DataFrame, wanted: list[int]) -> DataFrame:
    """Cliques (id, vars) that hold all of wanted."""
    return cliques.where(F.size(F.array_except(F.array(*map(F.lit, wanted)), "vars")) == 0)


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component): the least id reachable, for every row of nodes; edges (src, dst) between nodes.

    Each round takes the least label among neighbours and then jumps to the label's own label, so rounds grow with the
    logarithm of the diameter on most graphs. A round ends in a checkpoint, so plans do not grow."""
    e = cut(both_ways(edges.select("src", "dst").where("src <> dst")).distinct())
    labels = nodes.select("id", F.col("id").alias("component"))
    for _ in range(max_rounds):
        near = e.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        step = cut(labels.join(near, "id", "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("low")))
        if step.where("low <> component").isEmpty():
            return labels
        up = step.select(F.col("id").alias("low"), F.col("low").alias("jump"))
        labels = step.join(up, "low", "left").select("id", F.least("low", F.coalesce("jump", "low")).alias("component"))
    raise RuntimeError(f"no end after {max_rounds} rounds")


def _forest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (src, dst, w) of one partition's minimum spanning forest between its components a and b; of equal weights
    by ends, null ones first and NaN last."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    t = pa.Table.from_batches(found)
    t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in ("kind", "w", "src", "dst")]))
    ends = np.unique(np.concatenate([t["a"].to_numpy(), t["b"].to_numpy()]), return_inverse=True)[1].tolist()
    root, taken = list(range(max(ends) + 1)), []
    for n, (x, y) in enumerate(zip(ends[: t.num_rows], ends[t.num_rows :])):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[x] = y
            taken.append(n)
    yield from t.take(pa.array(taken, pa.int64())).select(["src", "dst", "w"]).to_batches()


def spanning_forest(nodes: DataFrame, edges: DataFrame, max_rounds: int = 40, few: int = FEW_EDGES) -> DataFrame:
    """Edges (src, dst, w), src < dst, of a minimum spanning forest, by rounds in which every component takes its least
    edge (ties by ends, so that no cycle arises) and components that an edge joins become one. A round works on the edges
    that are left between components, of which at most one for each pair stays. When few are left one task ends the work, so
    rounds, each of some ten jobs that the driver keeps record of, are only those that bring the edges down to few."""
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.struct("w", F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q")).alias("e"))
    chosen = []
    for _ in range(max_rounds):
        e = cut(e.where("a <> b").groupBy("a", "b").agg(F.min("e").alias("e")))
        if e.count() <= few:
            kind = F.when(F.col("e.w").isNull(), 0).when(F.isnan(F.col("e.w").cast("double")), 2).otherwise(1)
            last = e.select(F.col("a").cast("long"), F.col("b").cast("long"), F.col("e.p").alias("src"), F.col("e.q").alias("dst"), "e.w", kind.alias("kind"))
            chosen.append(last.repartition(1).mapInArrow(_forest_of, last.select("src", "dst", "w").schema))
            return reduce(DataFrame.union, chosen)
        sides = e.select(F.col("a").alias("c"), "a", "b", "e").union(e.select(F.col("b").alias("c"), "a", "b", "e"))
        best = cut(sides.groupBy("c").agg(F.min(F.struct("e", "a", "b")).alias("s")).select("s.*").distinct())
        chosen.append(best.select(F.col("e.p").alias("src"), F.col("e.q").alias("dst"), F.col("e.w").alias("w")))
        ends = e.select(F.col("a").alias("id")).union(e.select("b")).distinct()
        labels = cut(connected_components(ends, best.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
        to = lambda c, n: labels.select(F.col("id").alias(c), F.col("component").alias(n))  # noqa: B023, E731
        e = e.join(to("a", "x"), "a").join(to("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "e")
    raise RuntimeError(f"no end after {max_rounds} rounds")


def shortest_paths(edges: DataFrame, sources: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(source, id, distance) for the reachable nodes, by rounds of relaxation that join only what the last one improved.
    Weights are not negative."""
    e = cut(both_ways(edges.select("src", "dst", "w")))
    best = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("distance")).distinct())
    front = best
    for _ in range(max_rounds):
        reach = front.join(e, front["id"] == e["src"]).groupBy("source", F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("w")).alias("new"))
        all_ = cut(best.join(reach, ["source", "id"], "full_outer").select("source", "id", F.least("distance", "new").alias("distance"), (F.coalesce("new", F.lit(float("inf"))) < F.coalesce("distance", F.lit(float("inf")))).alias("moved")))
        best, front = all_.drop("moved"), all_.where("moved").drop("moved")
        if front.isEmpty():
            return best
    raise RuntimeError(f"no end after {max_rounds} rounds")


def all_pairs_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, id, distance) of every pair of nodes that a path joins, a node and itself (0) too. The result has the square
    of a component's size in rows, as the question asks."""
    return shortest_paths(edges, nodes.select("id"))


# ---- small graphs on the driver -------------------------------------------------------------------------------------


def dijkstra(edges: Iterable[tuple[int, int, float]], source: int, sink: int) -> tuple[list[int], float]:
    """A shortest undirected path, both ends in it; an empty path if there is none."""
    near: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    done: dict[int, int] = {}
    heap = [(0.0, source, source)]
    while heap:
        d, v, before = heapq.heappop(heap)
        if v in done:
            continue
        done[v] = before
        if v == sink:
            path = [v]
            while path[-1] != source:
                path.append(done[path[-1]])
            return path[::-1], d
        for u, w in near.get(v, ()):
            if u not in done:
                heapq.heappush(heap, (d + w, u, v))
    return [], float("inf")


def adjacency(nodes: Iterable[int], edges: Iterable[tuple[int, int]]) -> dict[int, set[int]]:
    near: dict[int, set[int]] = {v: set() for v in nodes}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return near


def cardinality_order(near: dict[int, set[int]]) -> list[int]:
    """Maximum-cardinality search: the node with most neighbours already taken comes next, the least of equal ones."""
    weight, order = dict.fromkeys(near, 0), []
    while weight:
        v = max(weight, key=lambda x: (weight[x], -x))
        del weight[v]
        order.append(v)
        for u in near[v]:
            if u in weight:
                weight[u] += 1
    return order


def is_chordal(near: dict[int, set[int]]) -> bool:
    """Each node's earlier neighbours in cardinality order are all neighbours of the last of them."""
    at = {v: i for i, v in enumerate(cardinality_order(near))}
    for v in near:
        earlier = sorted((u for u in near[v] if at[u] < at[v]), key=at.get)
        if earlier and not set(earlier[:-1]) <= near[earlier[-1]]:
            return False
    return True


def elimination_cliques(near: dict[int, set[int]], order: list[int] | None = None) -> tuple[list[int], list[frozenset[int]]]:
    """(order, maximal cliques) of eliminating nodes in the order, or by least fill-in."""
    left = {v: set(n) for v, n in near.items()}
    done, cliques = [], []
    while left:
        if order:
            v = order[len(done)]
        else:
            fill = {x: sum(b not in left[a] for a in n for b in n if a < b) for x, n in left.items()}
            v = min(left, key=lambda x: (fill[x], len(left[x]), x))
        around = left.pop(v)
        clique = frozenset(around | {v})
        if not any(clique <= c for c in cliques):
            cliques.append(clique)
        for a in around:
            left[a] |= around - {a}
            left[a].discard(v)
        done.append(v)
    return done, cliques


def triangulate(near: dict[int, set[int]], by_cardinality: bool = False) -> dict[int, set[int]]:
    """A chordal graph over near, by least fill-in or along the reverse cardinality order."""
    _, cliques = elimination_cliques(near, cardinality_order(near)[::-1] if by_cardinality else None)
    return adjacency(near, ((a, b) for c in cliques for a in c for b in c if a < b))


def kruskal(nodes: Iterable[int], edges: Iterable[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    root = {v: v for v in nodes}

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for a, b, w in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((a, b, w))
    return out


class MaxFlow:
    """Maximum flow between a source and a target by breadth-first augmenting paths over level graphs. Negative terminal
    capacities are folded into a constant."""

    def __init__(self, n: int):
        self.n, self.source, self.target = n, n, n + 1
        self.head: list[list[int]] = [[] for _ in range(n + 2)]
        self.to: list[int] = []
        self.cap: list[float] = []
        self.constant = 0.0

    def add_edge(self, a: int, b: int, capacity: float, back: float = 0.0) -> None:
        for x, y, c in ((a, b, capacity), (b, a, back)):
            self.head[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(float(c))

    def add_terminals(self, v: int, source: float, target: float) -> None:
        low = min(source, target, 0.0)
        self.constant += low
        self.add_edge(self.source, v, source - low)
        self.add_edge(v, self.target, target - low)

    def _levels(self) -> list[int]:
        level = [-1] * (self.n + 2)
        level[self.source] = 0
        todo = deque([self.source])
        while todo:
            v = todo.popleft()
            for e in self.head[v]:
                if self.cap[e] > 1e-12 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[v] + 1
                    todo.append(self.to[e])
        return level

    def solve(self) -> float:
        flow = self.constant
        while (level := self._levels())[self.target] >= 0:
            at = [0] * (self.n + 2)
            path: list[int] = []
            v = self.source
            while True:
                if v == self.target:
                    push = min(self.cap[e] for e in path)
                    for e in path:
                        self.cap[e] -= push
                        self.cap[e ^ 1] += push
                    flow += push
                    path, v = [], self.source
                elif at[v] < len(self.head[v]):
                    e = self.head[v][at[v]]
                    if self.cap[e] > 1e-12 and level[self.to[e]] == level[v] + 1:
                        path.append(e)
                        v = self.to[e]
                    else:
                        at[v] += 1
                elif path:
                    v = self.to[path.pop() ^ 1]
                    at[v] += 1
                else:
                    break
        return flow

    def on_source_side(self) -> list[bool]:
        level = self._levels()
        return [level[v] >= 0 for v in range(self.n)]


# ---- nearest-neighbour graphs ---------------------------------------------------------------------------------------
# nodes: (node, grp, eqv, label, x); edges: (src, dst, weight, rank)


def may_match(a: str = "a", b: str = "b") -> Column:
    """Nodes of one group, or of groups in one equivalence class (a class of -1 is a group's own), do not match."""
    g = F.col(f"{a}.grp") == F.col(f"{b}.grp")
    e = (F.col(f"{a}.eqv") >= 0) & (F.col(f"{a}.eqv") == F.col(f"{b}.eqv"))
    return ~(g | e)


METRICS = {
    "any": lambda a, b: F.lit(True),
    "label-equal": lambda a, b: (a == b) & (a >= 0),
    "label-equal-or-unknown": lambda a, b: (a == b) | (a < 0) | (b < 0),
    "label-different": lambda a, b: (a != b) & (a >= 0) & (b >= 0),
    "label-different-or-unknown": lambda a, b: (a != b) | (a < 0) | (b < 0),
}


def top_edges(candidates: DataFrame, k: int, per_group: bool = True) -> DataFrame:
    """Of candidates (src, dst, dst_grp, weight) the k lightest of each node, at most one into a group; those
    without weight come last."""
    if per_group:
        candidates = candidates.groupBy("src", "dst_grp").agg(F.min(F.struct(F.col("weight").isNull(), "weight", "dst")).alias("e")).select("src", "e.dst", "dst_grp", "e.weight")
    ranked = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.asc_nulls_last("weight"), "dst")))
    return ranked.where(F.col("rank") <= k).select("src", "dst", "weight", "rank")


def scored(pairs: DataFrame, nodes: DataFrame, metric: str = "any") -> DataFrame:
    """Distinct pairs (src, dst) with (dst_grp, weight) by squared distance, those that may match."""
    a = nodes.select(F.col("node").alias("src"), F.struct("grp", "eqv", "label", "x").alias("a"))
    b = nodes.select(F.col("node").alias("dst"), F.struct("grp", "eqv", "label", "x").alias("b"))
    both = pairs.select("src", "dst").where("src <> dst").distinct().join(a, "src").join(b, "dst")
    both = both.where(may_match() & METRICS[metric](F.col("a.label"), F.col("b.label")))
    both = both.select("src", "dst", F.col("b.grp").alias("dst_grp"), *(F.col(f"{c}.x").cast("array<double>").alias(c) for c in "ab"))
    of = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.schema.fields[:3])
    return both.mapInArrow(_with_distances, f"{of}, weight double")


def _with_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pair_distances(batch.column(3), batch.column(4))], names=["src", "dst", "dst_grp", "weight"])


def _bytes(r) -> int:
    return r["n"] * 8 * max(8, r["size"] or 0)


def exhaustive(nodes: DataFrame, k: int, metric: str = "any", blocks: int | None = None, per_group: bool = True) -> DataFrame:
    """The exact graph: nodes in blocks (of at most about BLOCK_BYTES of vectors, for TASKS tasks at least); a task holds one
    block and takes one other after the other, of up to RIGHT_BYTES, so tasks grow in number with the table and not in size.
    Two blocks meet once, for the nodes of both. A node or group that is null matches none. Where labels must be equal, only nodes whose labels
    are in one part meet."""
    of = nodes.schema
    v = nodes.where("node is not null and grp is not null").select(*(F.col(c).cast("long") for c in ("node", "grp", "eqv", "label")), F.col("x").cast("array<double>"))
    parts = 1
    if metric == "label-equal":
        v = v.where("label >= 0")
        parts = int(max(1, min(256, sum(_bytes(r) for r in v.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).collect()) // PART_BYTES)))
    v = v.withColumn("part", F.lit(0) if parts == 1 else F.pmod("label", F.lit(parts)).cast("int"))
    sizes = v.groupBy("part", F.size("x").alias("size")).agg(F.count("*").alias("n")).collect()
    widths = Counter()
    room = Counter()
    for r in sizes:
        room[r["part"]] += _bytes(r)
        if (r["size"] or 0) > 0:
            widths[r["size"]] += r["n"]
    width = max(((n, size) for size, n in widths.items()), default=(0, 1))[1]
    largest = max(room.values(), default=0)
    blocks = blocks or max(-(-TASKS // max(1, len(room))), -(-largest // BLOCK_BYTES))
    share = max(1, blocks * RIGHT_BYTES // max(1, largest))  # blocks on the right of a task
    if largest > BLOCK_BYTES:  # long tasks are at least twice as many, so that few cores wait for the last ones
        share = min(share, -(-len(room) * blocks * (blocks // 2 + 1) // (2 * TASKS)))
    packed = cut(v.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")).groupBy("part", "block").applyInArrow(pack, PACKED))
    # block b meets block i < b or > b, by which is fewer steps ahead on a ring, once
    steps = blocks // 2
    left = packed.select("*", F.lit(True).alias("left"), F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(steps // share))).alias("j"))
    ahead = packed.select("*", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    ahead = ahead.withColumn("i", F.pmod(F.col("block") - F.col("step"), F.lit(blocks)).cast("int"))
    if blocks % 2 == 0:
        ahead = ahead.where((F.col("step") < steps) | (F.col("i") < steps))
    right = ahead.withColumn("j", F.floor(F.col("step") / F.lit(share)).cast("int")).drop("step").select(left.columns)
    tasks = max(1, len(room)) * blocks * (steps // share + 1)
    sparse = 16 if largest > BLOCK_BYTES else 4  # partitions for each task, so few long ones share one
    both = left.unionByName(right).repartition(min(sparse * tasks, 2000), "part", "i", "j")
    near = both.groupBy("part", "i", "j").applyInArrow(block_neighbours(k, metric, per_group, width, True), FOUND)
    near = near.select(F.col("src").cast(of["node"].dataType), F.col("dst").cast(of["node"].dataType), F.col("dst_grp").cast(of["grp"].dataType), "weight")
    return top_edges(near, k, per_group)


def random_graph(nodes: DataFrame, k: int, seed: int = 0, buckets: int | None = None) -> DataFrame:
    """An initial graph: each node with the next one in two random buckets, in a random order, either way. Buckets have
    about 2000 nodes unless their number is given."""
    buckets = buckets or nodes.count() // 2000 + 1
    parts = [nodes.select("node", dealt(buckets, seed * 1000 + s, "node").alias("bucket"), F.lit(s).alias("s")) for s in range(2)]
    near = parts[0].union(parts[1]).withColumn("dst", F.lead("node").over(Window.partitionBy("s", "bucket").orderBy(uniform(seed + 1, "node"), "node")))
    near = near.where("dst is not null").select(F.col("node").alias("src"), "dst")
    return top_edges(scored(near.union(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), nodes), k)


def search_moves(nodes: DataFrame, seed: int = 0) -> DataFrame:
    """Candidates by search: for each node one random node of one random group. Groups and the nodes in each are numbered,
    so both draws are joins by number; pairs that may not match go when they are scored."""
    inside = nodes.select("grp", "node", (F.row_number().over(Window.partitionBy("grp").orderBy("node")) - 1).alias("place"))
    sizes = cut(nodes.groupBy("grp").agg(F.count("*").alias("size")))
    many = max(1, sizes.count())
    groups = running_total(sizes.withColumn("one", F.lit(1)), "grp", "one").select(F.col("grp").alias("g"), "size", (F.col("running") - 1).alias("number"))
    drawn = nodes.select(F.col("node").alias("src"), dealt(many, seed, "node", F.lit("group")).alias("number"), uniform(seed, "node", F.lit("node")).alias("u")).join(groups, "number")
    place = F.floor(F.col("u") * F.col("size")).cast("int")
    return drawn.select("src", F.col("g").alias("grp"), place.alias("place")).join(inside, ["grp", "place"]).select("src", F.col("node").alias("dst"))


def with_states(edges: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """edges with state: 0 for those that before (with states) lacks, else one more than there, up to 2. Moves that spread
    edges need only those of state 0 and 1: what an older edge could bring has been tried."""
    if before is None:
        return edges.withColumn("state", F.lit(0))
    old = before.select("src", "dst", F.col("state").alias("__old"))
    return edges.join(old, ["src", "dst"], "left").withColumn("state", F.when(F.col("__old").isNull(), 0).otherwise(F.least(F.col("__old") + 1, F.lit(2)))).drop("__old")


def fresh(edges: DataFrame) -> DataFrame:
    """The edges that moves have yet to spread; all of them if they have no states."""
    return edges.where("state < 2") if "state" in edges.columns else edges


def improve(edges: DataFrame, candidates: DataFrame, nodes: DataFrame, k: int, metric: str = "any") -> DataFrame:
    """The k best of the old edges and the candidates."""
    return top_edges(scored(edges.select("src", "dst").union(candidates.select("src", "dst")), nodes, metric), k)


def propagate(edges: DataFrame, adjacent: DataFrame) -> DataFrame:
    """Candidates from spatial neighbours: for an edge (u, v) all (neighbour of u, neighbour of v); adjacent: (node, near)."""
    a, b = adjacent.select(F.col("node").alias("src"), F.col("near").alias("p")), adjacent.select(F.col("node").alias("dst"), F.col("near").alias("q"))
    return fresh(edges).join(a, "src").join(b, "dst").select(F.col("p").alias("src"), F.col("q").alias("dst")).distinct()


def local_moves(edges: DataFrame, adjacent: DataFrame) -> DataFrame:
    """Candidates that move an edge's end to a spatial neighbour of that end."""
    return edges.join(adjacent.select(F.col("node").alias("dst"), "near"), "dst").select("src", F.col("near").alias("dst"))


def enrich(edges: DataFrame) -> DataFrame:
    """Candidates by reversing every edge, and by following two edges. Following goes along out-edges, of which a node has
    at most k, so a node brings at most k times its edges however many edges lead to it."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    two = edges.select("src", F.col("dst").alias("mid")).join(edges.select(F.col("src").alias("mid"), "dst"), "mid").where("src <> dst").select("src", "dst")
    return back.union(two).distinct()


def projection_candidates(nodes: DataFrame, direction: list[float], horizon: int) -> DataFrame:
    """Candidates by a random projection: each node with the next ones in the order of the projection, either way. Nodes are
    numbered in that order by running sums over range partitions, and meet by equal numbers."""
    order = F.struct(A.weighted(F.col("x"), direction).alias("p"), "node").alias("at")
    ranked = running_total(nodes.select(order, F.lit(1).alias("one")), "at", "one").select(F.col("at.node").alias("node"), F.col("running").alias("place"))
    ahead = ranked.select(F.col("node").alias("src"), F.explode(F.sequence(F.col("place") + 1, F.col("place") + horizon)).alias("place"))
    pairs = ahead.join(ranked.withColumnRenamed("node", "dst"), "place").select("src", "dst")
    return pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def label_transfer(edges: DataFrame, labels: DataFrame, classes: int) -> DataFrame:
    """(node, label, score): votes of 1/rank by labelled neighbours; unlabelled ones do not advance the rank. labels:
    (node, label)."""
    known = edges.join(labels.select(F.col("node").alias("dst"), "label").where("label >= 0"), "dst")
    ranked = known.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("weight", "dst")))
    votes = ranked.groupBy("src", "label").agg(F.sum(1.0 / F.col("r")).alias("v"))
    total = Window.partitionBy("src")
    share = (F.col("v") + 1e-6) / (F.sum("v").over(total) + 1e-6 * classes)
    return votes.withColumn("score", share).groupBy(F.col("src").alias("node")).agg(F.min(F.struct(-F.col("score"), "label", "score")).alias("b")).select("node", "b.label", "b.score")


def graph_energy(edges: DataFrame) -> DataFrame:
    return edges.agg(F.sum("weight").alias("energy"), F.sum(F.when(F.col("rank") == 1, F.col("weight"))).alias("best_energy"), F.count("*").alias("n_edges"))


def merge_graphs(first: DataFrame, second: DataFrame, offset: int) -> DataFrame:
    """Two node tables as one, the second's nodes and groups moved by offset."""
    return first.unionByName(second.withColumns({"node": F.col("node") + offset, "grp": F.col("grp") + offset}))


def metric_loss(edges_equal: DataFrame, edges_other: DataFrame) -> DataFrame:
    """Sum of hinge losses 1 + d(equal) - d(other), over the furthest equal and the nearest other neighbour of a node."""
    e = edges_equal.groupBy("src").agg(F.max("weight").alias("p"))
    o = edges_other.groupBy("src").agg(F.min("weight").alias("q"))
    return e.join(o, "src").agg(F.sum(F.greatest(F.lit(0.0), 1.0 + F.col("p") - F.col("q"))).alias("loss"))
