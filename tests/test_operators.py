import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matrel import model as M
from matrel.functions import arrays as A
from matrel.functions import stats as S
from matrel.functions import strings as T
from matrel.operators import evaluation as E
from matrel.operators import factors as X
from matrel.operators import graphs as G
from matrel.operators import inference as I
from matrel.operators import learn as L
from matrel.operators import nearest
from matrel.operators import tables as O


def obs(spark, rows):
    return spark.createDataFrame(rows, "key string, obs int, x array<double>")


def got(df):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect())


def as_map(df):
    return {(r["i"], r["j"]): r["value"] for r in df.collect()}


# The five rows, weights and sums are the published fixture of the sufficient-statistics test.
ROWS = [([1.0, 0.0, 0.0, 0.0], 0.0), ([1.0, 1.0, 0.0, 0.0], 1.0), ([1.0, 1.0, 1.0, 0.0], 2.0), ([1.0, 1.0, 1.0, 1.0], 3.0), ([0.5, 0.0, 0.5, 0.0], 4.0)]


def test_sufficient_statistics(spark):
    df = spark.createDataFrame(ROWS, "x array<double>, w double")
    full = S.sufficient(df, weight="w")
    m = as_map(full)
    assert m[-1, -1] == 10
    assert [m[i, -1] for i in range(4)] == [8, 6, 7, 3]
    assert [[m[i, j] for j in range(4)] for i in range(4)] == [[7, 6, 6, 3], [6, 6, 5, 3], [6, 5, 6, 3], [3, 3, 3, 3]]
    assert set(as_map(S.subtract(full, full)).values()) == {0.0}
    again = S.merge(S.sufficient(df.limit(2), weight="w"), S.sufficient(df.exceptAll(df.limit(2)), weight="w"))
    assert as_map(again) == m
    assert set(as_map(S.diagonal(full))) == {k for k in m if k[1] == -1 or k[0] == k[1]}


def test_broadcasting(spark):
    a = obs(spark, [("k", 0, [1.0, 2.0]), ("k", 1, [3.0, 4.0]), ("only", 0, [9.0])])
    assert got(O.binary(a, obs(spark, [("k", 0, [10.0])]), "add")) == [("k", 0, (11.0, 12.0)), ("k", 1, (13.0, 14.0))]
    assert got(O.binary(a, obs(spark, [("k", 0, [10.0, 20.0])]), "multiply")) == [("k", 0, (10.0, 40.0)), ("k", 1, (30.0, 80.0))]
    assert got(O.binary(a, obs(spark, [("k", 0, [1.0]), ("k", 1, [2.0])]), "subtract")) == [("k", 0, (0.0, 1.0)), ("k", 1, (1.0, 2.0))]
    assert got(O.concatenate([a, obs(spark, [("k", 0, [7.0, 8.0])])], add_one=True)) == [("k", 0, (1.0, 2.0, 7.0, 8.0, 1.0)), ("k", 1, (3.0, 4.0, 7.0, 8.0, 1.0))]


def test_rollup_has_zeros_and_refuses_gaps(spark):
    a = obs(spark, [("k", 0, [1.0]), ("k", 1, [3.0])])
    index = spark.createDataFrame([("k", 0, 0), ("k", 1, 2)], "key string, obs int, idx int")
    assert got(O.roll_up(a, "sum", index)) == [("k", 0, (1.0,)), ("k", 1, (0.0,)), ("k", 2, (3.0,))]
    with pytest.raises(Exception, match="no index"):
        O.roll_up(a, "sum", index.limit(1)).collect()


def test_update_equals_evaluate(spark):
    a = obs(spark, [(k, 0, [float(i)]) for i, k in enumerate("abc")])
    double = lambda t: O.unary(t, "pow", 2.0)
    assert got(O.update_missing(a, double(a.where("key = 'b'")), double)) == got(double(a))


def test_codebook_and_records(spark):
    book = [[0.0, 0.0], [1.0, 1.0], [1.0, 1.0]]
    a = obs(spark, [("k", 0, [0.9, 1.2]), ("k", 1, [1.0, 1.0]), ("k", 2, [5.0, 5.0])])
    assert [r[2][0] for r in got(O.encode_codebook(a, book))] == [-1.0, 1.0, -1.0]
    assert [r[2][0] for r in got(O.encode_codebook(a, book, "nearest-L1"))] == [1.0, 1.0, 1.0]
    assert got(O.decode_codebook(obs(spark, [("k", 0, [7.0])]), book)) == [("k", 0, (1.0, 1.0))]
    assert got(M.from_records(M.records(a)).select("key", "obs", "x")) == got(a)
    assert got(M.from_cells(M.cells(a))) == got(a)
    M.check_structure(M.records(a)).collect()
    with pytest.raises(Exception, match="unequal"):
        M.check_dimension(obs(spark, [("k", 0, [1.0]), ("k", 1, [1.0, 2.0])])).collect()


def test_vector_functions(spark):
    x = F.array(*(F.lit(v) for v in (1.0, 3.0, 0.0, 3.0)))
    row = spark.range(1).select(A.argmax(x).alias("a"), A.argmin(x).alias("b"), A.arg_random(x, F.lit(0.3)).alias("c"), A.normalize(x).alias("n"), A.log(x).alias("l"), A.has_invalid(A.log(x)).alias("v"), A.softmax(x).alias("s")).first()
    assert (row["a"], row["b"], row["c"]) == (1, 2, 1) and row["v"]
    assert np.allclose(row["n"], np.array([1, 3, 0, 3]) / 19**0.5) and row["l"][2] == float("-inf")
    assert abs(sum(row["s"]) - 1) < 1e-12
    assert A.successor([1, 1], [2, 2]) == [0, 0] and A.predecessor([0, 0], [2, 3]) == [1, 2]


def test_strings(spark):
    f = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    p = F.lit("/data/set.a/img012.tar.gz")
    assert [f(g(p)) for g in (T.file_name, T.directory, T.extension, T.base_name, T.strip_extension)] == ["img012.tar.gz", "/data/set.a", "gz", "img012.tar", "/data/set.a/img012.tar"]
    assert f(T.directory(F.lit("x"))) == "." and f(T.file_index(F.lit("a/img012.png"))) == 12 and f(T.file_index(F.lit("a"))) == -1
    assert f(T.parse_name_values(F.lit("a=1, b=x y; c"))) == {"a": "1", "b": "x", "y": "true", "c": "true"}
    assert f(T.pad(F.lit("abcdef"), 3)) == "abcdef" and f(T.space_out(F.lit("ABc"))) == "A Bc"
    assert f(T.milliseconds_text(F.lit(3723004))) == "1:02:03.004" and f(T.bytes_text(F.lit(1500))) == "1.5kB"
    assert f(T.parse_vector(F.lit(" 1 -inf x "))) == [1.0, float("-inf"), None]
    assert T.break_text("aa bb incomprehensible", 6) == "aa bb\ninc..."


def test_confusion_rates(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (-1, 0), (2, 0)], "a int, p int")
    s = {r["class"]: r for r in E.class_scores(E.confusion(df, "a", "p")).collect()}
    assert s[2]["precision"] == 1.0 and s[2]["recall"] == 0.0 and s[1]["precision"] == 0.5
    assert E.overall(E.confusion(df, "a", "p")).first()["accuracy"] == 0.5
    best, score, _ = E.GridSearch().add("a", 0, 1).add_logarithmic("b", 0.01, 1, 3).run(lambda a, b: (a, b), lambda m: m[0] - m[1])
    assert best["a"] == 1 and score == 0.99 and len(E.GridSearch().add("a", 0, 1).add_logarithmic("b", 1e-3, 1e3, 7).trials()) == 14


def loop():
    """The published four-variable cycle: unaries prefer 1 at variable 0, neighbours agree."""
    g = I.FactorGraph([2] * 4).add([0], [0, -1])
    for v in (1, 2, 3):
        g.add([v], [0, 0])
    for a, b in ((0, 1), (1, 2), (2, 3), (3, 0)):
        g.add([a, b], [0, 1, 1, 0])
    return g


@pytest.mark.parametrize("method", sorted(set(I.METHODS) - {"ICM"}))
def test_map_golden(method):
    assert I.solve(loop(), method) == ([1, 1, 1, 1], -1.0)


def test_icm_stops_at_local_optimum():
    assert I.solve(loop(), "ICM") == ([0, 0, 0, 0], 0.0)


def test_inference_on_random_graphs():
    rng = np.random.default_rng(0)
    for t in range(12):
        n = 6
        cards = [int(c) for c in rng.integers(2, 4, n)]
        g = I.FactorGraph(cards)
        for v in range(n):
            g.add([v], rng.normal(size=cards[v]))
        edges = [(i, int(rng.integers(0, i))) for i in range(1, n)] if t % 2 else [(i, j) for i in range(n) for j in range(i) if rng.random() < 0.5]
        for a, b in edges:
            g.add([a, b], rng.normal(size=(cards[a], cards[b])))
        best = I.brute_force(g)[1]
        for m in I.METHODS:
            assert I.solve(g, m)[1] >= best - 1e-9
        assert abs(I.junction_tree(g)[1] - best) < 1e-9
        if t % 2:
            assert abs(I.message_passing(g)[1] - best) < 1e-9
            p = I.FactorGraph(cards, [I.Factor(f.vars, np.exp(-f.table)) for f in g.factors])
            whole = np.ones(cards)
            for f in p.factors:
                whole = whole * f.over(range(n))
            for v, m in enumerate(I.sum_product(p)):
                w = whole.sum(axis=tuple(i for i in range(n) if i != v))
                assert np.allclose(m, w / w.sum(), atol=1e-5)


def test_factor_algebra(spark):
    # variables b (2) and a (3); values with the first variable fastest
    psi = X.from_table(spark, ["b", "a"], [2, 3], [0.5, 0.8, 0.1, 0.0, 0.3, 0.9])
    assert got(X.marginalise(psi, "a")) == [(0, pytest.approx(0.9)), (1, pytest.approx(1.7))]
    assert got(X.condition(psi, a=1)) == [(0, 0.1), (1, 0.0)]
    one = X.marginalise(X.marginalise(psi, "a"), "b").first()["val"]
    assert one == pytest.approx(X.marginalise(X.marginalise(psi, "b"), "a").first()["val"])
    assert X.same(psi, X.divide(X.product(psi, X.fill(psi, 2.0)), X.fill(psi, 2.0))).first()["same"]
    flat, taken = X.remove_uniform([psi, X.fill(psi, 3.0)])
    assert len(flat) == 1 and taken == 3.0
    assert len(X.merge_duplicates([psi, psi])) == 1 and len(X.absorb([psi, X.marginalise(psi, "a")])) == 1
    assert X.dense(X.condition(psi, a=1).where("val > 0"), {"b": 2}).count() == 2
    with pytest.raises(ValueError, match="limit"):
        X.eliminate([psi], ["a"], limit=2, cards={"a": 3, "b": 2})


def test_small_graphs():
    near = G.adjacency(range(4), [(0, 1), (1, 2), (2, 3), (3, 0)])
    assert not G.is_chordal(near) and G.is_chordal(G.triangulate(near)) and G.is_chordal(G.triangulate(near, by_cardinality=True))
    assert sorted(map(len, G.elimination_cliques(near)[1])) == [3, 3]
    assert G.dijkstra([(0, 1, 1), (1, 2, 1), (0, 2, 5)], 0, 2) == ([0, 1, 2], 2.0)
    f = G.MaxFlow(4)
    for a, b, c in ((0, 1, 3), (0, 2, 4), (1, 2, 1), (1, 3, 2), (2, 3, 5)):
        f.add_edge(a, b, c)
    f.add_terminals(0, 100, 0)
    f.add_terminals(3, 0, 100)
    assert f.solve() == 7 and f.on_source_side() == [True, False, False, False]


def test_learners(spark):
    rng = np.random.default_rng(1)
    centre = np.array([[0, 0], [4, 0], [0, 4]])
    y = np.arange(150) % 3
    x = centre[y] + rng.normal(size=(150, 2)) * 0.7
    df = spark.createDataFrame([(f"{i:03d}", x[i].tolist(), int(y[i])) for i in range(150)], "key string, x array<double>, label int").persist()
    accuracy = lambda m: df.select((m.label(F.col("x")) == F.col("label")).cast("double").alias("h")).agg(F.avg("h")).first()[0]
    assert accuracy(L.fit_tree(df, 3, depth=3)) > 0.95
    assert accuracy(L.fit_boosted(df, 3, rounds=3, depth=2)) > 0.95
    assert accuracy(L.fit_logistic(df, 3, max_rounds=15)) > 0.97
    p = L.fit_pca(df)
    assert np.allclose(L.moments(p.transform(df))[2], np.eye(2), atol=1e-8)
    w = L.moments(L.fit_whitener(df).transform(df))
    assert np.allclose(w[1], 0, atol=1e-9) and np.allclose(np.diag(w[2]), 1)
    assert sorted(L.fit_kmeans(df, 3).assign(df).groupBy("cluster").count().toPandas()["count"]) == pytest.approx([50, 50, 50], abs=6)
    g = L.fit_gaussian(df)
    c = g.condition({0: 1.0})
    assert c.mean[0] == pytest.approx(g.mean[1] + g.cov[1, 0] / g.cov[0, 0] * (1.0 - g.mean[0])) and g.divergence(g) == pytest.approx(0)
    assert L.fit_lda(df.where("label < 2")).projection.shape == (1, 2)


def test_programs():
    x = L.solve_qp(np.eye(2), np.array([-1.0, -2.0]), low=np.zeros(2), a=np.ones((1, 2)), b=np.array([1.0]))
    assert np.allclose(x, [0, 1], atol=1e-5)
    x = L.solve_lp(np.array([-1.0, -2, 0, 0]), np.array([[1.0, 1, 1, 0], [1, 3, 0, 1]]), np.array([4.0, 6]))
    assert np.allclose(x[:2], [3, 1], atol=1e-5)
    q = L.lbfgs(lambda v: (float(((v - 3) ** 2).sum()), 2 * (v - 3)), np.zeros(3))
    assert np.allclose(q, 3, atol=1e-4)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), min_size=3, max_size=3), min_size=1, max_size=3), st.integers(0, 5))
def test_mixed_radix_round_trip(digits, k):
    limits = [2, 3, 4]
    start = [d % n for d, n in zip(digits[0], limits)]
    v = start
    for _ in range(k):
        v = A.successor(v, limits)
    for _ in range(k):
        v = A.predecessor(v, limits)
    assert v == start


def test_size_text_of_all_orders(spark, tmp_path):
    from matrel.plans import tables

    want = {999: "999b", 1500: "1.5kB", 950_000: "950.0kB", 2_500_000: "2.5MB", 3_000_000_000: "3.0GB"}
    spark.createDataFrame([(k,) for k in want], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert {r["o_orderkey"]: r["size"] for r in tables.size_and_time_text(spark, str(tmp_path)).collect()} == want


def test_lda_sees_every_feature(spark, tmp_path):
    from matrel.plans import scoring

    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=64) + (np.arange(64) == 40) * 30.0 * (i % 2)).tolist(), i % 2) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    v = {int(r["key"]): r["v"] for r in scoring.fisher_lda(spark, str(tmp_path)).where("feat = 0").collect()}
    a, b = (np.array([v[i] for i in v if i % 2 == y]) for y in (0, 1))
    assert abs(a.mean() - b.mean()) > 5 * max(a.std(), b.std())


def test_metric_learning_parts_classes(spark):
    rng = np.random.default_rng(4)
    label = np.arange(40) % 2
    x = np.column_stack([rng.normal(size=40) * 3, label + rng.normal(size=40) * 0.2])  # the first feature only disturbs
    nodes = spark.createDataFrame([(i, i, -1, int(y), [float(v) for v in r]) for i, (y, r) in enumerate(zip(label, x))], "node int, grp int, eqv int, label int, x array<double>")
    equal = G.exhaustive(nodes, 1, "label-equal", blocks=2)
    other = G.exhaustive(nodes, 1, "label-different", blocks=2)
    metric, losses = L.fit_metric(nodes, equal, other, rounds=12, rate=0.3)
    assert min(losses) < losses[0] and metric[1, 1] > metric[0, 0] and np.linalg.eigvalsh(metric).min() >= -1e-9
    assert G.metric_loss(equal, other).first()["loss"] >= 0


def test_equivalence_classes_do_not_match(spark):
    nodes = spark.createDataFrame([(i, i, i % 2 if i < 4 else -1, 0, [float(i)]) for i in range(6)], "node int, grp int, eqv int, label int, x array<double>")
    pairs = {(r["src"], r["dst"]) for r in G.exhaustive(nodes, 6, blocks=2).collect()}
    assert pairs == {(a, b) for a in range(6) for b in range(6) if a != b and not (a < 4 and b < 4 and a % 2 == b % 2)}


def test_split_candidates_and_intervals(spark):
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.integers(0, 40, 3000), rng.normal(size=3000).round(3)])
    df = spark.createDataFrame([([float(a), float(b)],) for a, b in x], "x array<double>")
    for most in (1000, 90, 7):
        for got, column in zip(L.candidate_cuts(df, most), x.T):
            v = np.unique(column)
            mid = (v[1:] + v[:-1]) / 2
            assert np.allclose(got, mid if len(mid) <= most else mid[np.linspace(0, len(mid) - 1, most).astype(int)])
    cuts = np.sort(rng.normal(size=333))
    for c in (cuts, cuts[:5], cuts[:0]):
        got = [r["k"] for r in df.select(L._interval(F.element_at("x", 2), c).alias("k"), F.element_at("x", 2).alias("v")).collect()]
        want = [int(np.searchsorted(c, r["v"], side="right")) for r in df.select(F.element_at("x", 2).alias("v")).collect()]
        assert got == want


def test_images(spark):
    from matrel.functions import images as V

    rng = np.random.default_rng(8)
    x = rng.normal(size=(5, 30))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "image int, x array<double>")
    sums = V.integral(F.col("x"), 6, 5)
    got = df.select("image", V.box_sum(sums, 6, 1, 4, 2, 5).alias("s"), V.region_moments(V.region(F.col("x"), 6, 1, 4, 2, 5)).alias("m")).orderBy("image").collect()
    for r, row in zip(got, x):
        part = row.reshape(5, 6)[1:4, 2:5]
        assert np.allclose([r["s"], r["m"]["mean"], r["m"]["energy"], r["m"]["variance"]], [part.sum(), part.mean(), (part**2).mean(), part.var()])
    assert df.select(V.region_moments(F.array().cast("array<double>")).alias("m")).first()["m"] is None


def test_repeated_names_take_the_last_value(spark):
    got = spark.range(1).select(T.parse_name_values(F.lit("a=1,b=2,a=3;c")).alias("m")).first()["m"]
    assert got == {"a": "3", "b": "2", "c": "true"}


def test_blocks_of_odd_vectors_against_all_pairs(spark):
    """The same edges as by all pairs: copies, groups of one, vectors that are null, short, huge or hold a null or NaN."""
    rng = np.random.default_rng(5)
    x = [list(map(float, v)) for v in np.round(rng.normal(size=(90, 3)), 1)]
    x[10:30] = [x[9]] * 20
    x[40], x[41], x[42], x[43], x[44], x[45] = None, [1.0], [1.0, None, 2.0], [float("nan"), 0.0, 1.0], [1e200, 0.0, 0.0], [float("inf"), 0.0, 1.0]
    rows = [(i, i % 7 if i < 80 else 100 + i, i % 3 - 1 if i % 11 else None, i % 5 - 1 if i % 13 else None, v) for i, v in enumerate(x)]
    nodes = spark.createDataFrame(rows, "node long, grp int, eqv int, label int, x array<double>")
    null = lambda v: v is None

    def weight(p, q):
        if null(p) or null(q) or len(p) != len(q) or any(map(null, (*p, *q))):
            return None
        total = 0.0
        for a, b in zip(p, q):
            total += (a - b) * (a - b)
        return total

    order = lambda e: (null(e[0]), not null(e[0]) and e[0] != e[0], 0 if null(e[0]) or e[0] != e[0] else e[0], e[1])
    fine = {
        "any": lambda a, b: True,
        "label-equal": lambda a, b: not null(a) and a == b and a >= 0,
        "label-different": lambda a, b: not null(a) and not null(b) and a != b and a >= 0 and b >= 0,
        "label-equal-or-unknown": lambda a, b: not null(a) and (a < 0 or a == b) or not null(b) and b < 0,
    }
    for metric, ok in fine.items():
        for k, per_group in ((3, True), (2, False), (40, True), (100, False)):
            want = set()
            for i, g, e, label, v in rows:
                found = [(weight(v, w), j, h) for j, h, f, m, w in rows if h != g and not null(e) and not (e >= 0 and (null(f) or e == f)) and ok(label, m)]
                found.sort(key=order)
                taken, n = set(), 0
                for w, j, h in found:
                    if n < k and not (per_group and h in taken):
                        taken.add(h)
                        n += 1
                        want.add((i, j, repr(w), n))
            got = {(r["src"], r["dst"], repr(r["weight"]), r["rank"]) for r in G.exhaustive(nodes, k, metric, blocks=3, per_group=per_group).collect()}
            assert got == want, (metric, k, per_group)


def test_spanning_forest_ends_in_one_task(spark):
    """The same forest by rounds alone, by one task, and by Kruskal's method; loops, equal weights and double edges too."""
    rng = np.random.default_rng(6)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 150), rng.integers(0, 60, 150), rng.integers(0, 6, 150))]
    nodes, edges = spark.range(80), spark.createDataFrame([*rows, rows[0]], "src long, dst long, w double")
    want = sorted(G.kruskal(range(80), [(min(a, b), max(a, b), w) for a, b, w in rows if a != b]))
    jobs = spark.sparkContext.statusTracker()
    for few, most in ((0, None), (20, None), (1000, 12)):
        spark.sparkContext.setJobGroup(f"forest-{few}", "")
        got = sorted(tuple(r) for r in G.spanning_forest(nodes, edges, few=few).collect())
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert got == want
        assert most is None or len(jobs.getJobIdsForGroup(f"forest-{few}")) <= most
    assert G.spanning_forest(nodes, edges.where("false")).count() == 0


def packed_block(block, nodes, x, groups):
    n = len(nodes)
    whole = {c: pa.array(v, pa.int64()) for c, v in (("node", nodes), ("grp", groups), ("eqv", [-1] * n), ("label", [0] * n))}
    return nearest.pack(pa.table({"part": pa.array([0] * n, pa.int32()), "block": pa.array([block] * n, pa.int32()), **whole, "x": pa.array(x.tolist(), pa.list_(pa.float64()))}))


@pytest.mark.parametrize("per_group", [True, False])
@pytest.mark.parametrize("offset", [0.0, 1.0, 1e7])
def test_one_block_meets_several(per_group, offset):
    """A task takes several blocks on the right; far from the origin single precision tells nothing, yet edges are exact."""
    rng, k = np.random.default_rng(5), 3
    x = offset + rng.normal(size=(240, 8)) * 1e-3
    x[200:] = x[160:200]  # ties
    node, grp = np.arange(240), np.arange(240) % 7
    blocks = [packed_block(b, node[b::4], x[b::4], grp[b::4]) for b in range(4)]
    table = pa.concat_tables([t.append_column("left", pa.array([at == 0])) for at, t in enumerate([blocks[0], *blocks])])
    got = nearest.block_neighbours(k, "any", per_group, 8)(table).to_pylist()
    want = []
    for i in node[0::4]:
        seen = {}
        for d, j in sorted((float(np.cumsum((x[i] - x[j]) ** 2)[-1]), int(j)) for j in node if grp[j] != grp[i]):
            seen.setdefault(grp[j] if per_group else j, (int(i), j, d))
        want += list(seen.values())[:k]
    assert sorted((r["src"], r["dst"], r["weight"]) for r in got) == sorted(want)


def test_equal_labels_meet_in_parts(spark, monkeypatch):
    """Nodes whose labels cannot be equal do not meet in a task, and no edge is lost."""
    monkeypatch.setattr(G, "PART_BYTES", 1 << 10)
    rng = np.random.default_rng(6)
    x, label = rng.integers(0, 5, (120, 8)).astype(float), rng.integers(-1, 40, 120)
    nodes = spark.createDataFrame([(i, i % 7, -1, int(label[i]), x[i].tolist()) for i in range(120)], "node long, grp int, eqv int, label int, x array<double>")
    got = {(r["src"], r["dst"], r["weight"], r["rank"]) for r in G.exhaustive(nodes, 2, "label-equal", per_group=False).collect()}
    want = set()
    for i in range(120):
        near = sorted((float(((x[i] - x[j]) ** 2).sum()), j) for j in range(120) if j % 7 != i % 7 and label[j] == label[i] >= 0)
        want |= {(i, j, d, r) for r, (d, j) in enumerate(near[:2], 1)}
    assert got == want


@pytest.mark.parametrize("tile", [7, 16, 512])
@pytest.mark.parametrize("metric", ["any", "label-equal"])
@pytest.mark.parametrize("per_group", [True, False])
def test_two_blocks_meet_once_for_both(monkeypatch, tile, metric, per_group):
    """Tasks of a ring of blocks give the nodes of either block of a meeting their neighbours; with ties, few waiting pairs,
    and a node that is not finite."""
    monkeypatch.setattr(nearest, "TILE", tile)
    monkeypatch.setattr(nearest, "WAITING", 60)
    rng, k, n, blocks = np.random.default_rng(8), 2, 150, 5
    x = rng.integers(0, 5, (n, 8)).astype(float)
    x[11, 3] = np.inf
    node, grp = np.arange(n), np.arange(n) % 7
    packed = [packed_block(b, node[b::blocks], x[b::blocks], grp[b::blocks]) for b in range(blocks)]
    best = {int(i): set() for i in node}
    for i in range(blocks):
        met = [packed[i], *(packed[(i + s) % blocks] for s in range(blocks // 2 + 1))]
        table = pa.concat_tables([t.append_column("left", pa.array([at == 0])) for at, t in enumerate(met)])
        for r in nearest.block_neighbours(k, metric, per_group, 8, both=True)(table).to_pylist():
            best[r["src"]].add((r["weight"], r["dst"]))
    first = lambda found: list({(grp[j] if per_group else j): (d, j) for d, j in sorted(found, reverse=True)}.values())
    for i in node:
        every = [(float(np.cumsum((x[i] - x[j]) ** 2)[-1]), int(j)) for j in node if grp[j] != grp[i]]
        assert sorted(first(best[int(i)]))[:k] == sorted(first(every))[:k]


def test_bounds_to_begin_with_need_no_measuring(monkeypatch):
    """What a few columns tell by the product alone bounds the k-th best of each row."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    row = {c: v.astype(np.int64).tobytes() for c, v in {"node": np.arange(300), "grp": np.arange(300) % 7, "eqv": np.full(300, -1), "label": np.zeros(300), "size": np.full(300, 8)}.items()}
    b = nearest.Block(row | {"x": x.tobytes(), "single": False, "hole": b""}, 8)
    calls = []
    monkeypatch.setattr(nearest, "measured", lambda *a: calls.append(a))
    for per_group in (True, False):
        side, few = nearest.Side(b, 3, per_group), np.arange(0, 300, 4)
        side.one_way(np.arange(300), b, few, np.zeros(8), "any", True)
        d = ((b.x[:, None] - b.x[None, few]) ** 2).sum(axis=2)
        d[b.grp[:, None] == b.grp[None, few]] = np.inf
        if per_group:
            d = np.stack([d[:, b.grp[few] == g].min(axis=1) for g in range(7)], 1)
        assert not calls and np.isfinite(side.bound).all() and (side.bound >= np.sort(d, axis=1)[:, 2]).all()


def test_pairs_are_measured_in_batches(spark):
    """scored: a vector with a null, null or of another width has no distance; the plan has no function over elements."""
    rows = [(0, 0, [1.0, 2.0]), (1, 1, [0.0, 4.5]), (2, 2, None), (3, 3, [None, 1.0]), (4, 4, [1.0]), (5, 5, [float("nan"), 1.0]), (6, 6, []), (7, 7, [])]
    nodes = spark.createDataFrame([(n, g, -1, 0, x) for n, g, x in rows], "node long, grp int, eqv int, label int, x array<double>")
    pairs = spark.createDataFrame([(0, n) for n, _, _ in rows] + [(6, 7), (1, 0)], "src long, dst long")
    out = G.scored(pairs, nodes)
    assert "MapInArrow" in (plan := out._jdf.queryExecution().toString()) and "zip_with" not in plan
    got = {(r["src"], r["dst"]): (r["dst_grp"], r["weight"]) for r in out.collect()}
    assert np.isnan(got.pop((0, 5))[1])
    assert got == {(0, 1): (1, 7.25), (1, 0): (0, 7.25), (0, 2): (2, None), (0, 3): (3, None), (0, 4): (4, None), (0, 6): (6, None), (0, 7): (7, None), (6, 7): (7, 0.0)}


def test_long_tasks_are_many_and_apart(spark, monkeypatch):
    """Blocks that are all sent to one task by their size still make at least twice TASKS of them, in many partitions."""
    import re

    x = np.random.default_rng(5).normal(size=(96, 4))
    nodes = spark.createDataFrame([(i, i % 5, -1, 0, v) for i, v in enumerate(x.tolist())], "node long, grp int, eqv int, label int, x array<double>")
    want = sorted(map(tuple, G.exhaustive(nodes, 2).collect()))
    monkeypatch.setattr(G, "BLOCK_BYTES", 1 << 9)
    out = G.exhaustive(nodes, 2)
    assert sorted(map(tuple, out.collect())) == want
    assert max(map(int, re.findall(r"hashpartitioning\(part#\d+, i#\d+, j#\d+L?, (\d+)\)", out._jdf.queryExecution().toString()))) >= 16 * 2 * G.TASKS
