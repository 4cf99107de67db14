import numpy as np
import pytest
from pyspark.sql import functions as F

from matrel import cli
from matrel.operators import learn as L
from matrel.plans.network import Network
from matrel.sources import binary as B
from matrel.sources import models
from matrel.sources import text as T
from matrel.sources.store import Store
from matrel.storage import cut
from matrel.streaming import incremental as S


def test_text_round_trip(spark, tmp_path):
    (tmp_path / "in.txt").write_text("# head\nb 1 2\n\na 3 inf\nb 5 6\n")
    t = T.read_text_table(spark, str(tmp_path / "in.txt"), header_lines=1)
    rows = [tuple(r) for r in t.orderBy("key", "obs").collect()]
    assert rows == [("a", 0, [3.0, float("inf")]), ("b", 0, [1.0, 2.0]), ("b", 1, [5.0, 6.0])]
    T.write_text_table(t, str(tmp_path / "out"))
    assert sorted(map(tuple, T.read_text_table(spark, str(tmp_path / "out")).select("key", "obs").collect())) == [("a", 0), ("b", 0), ("b", 1)]
    (tmp_path / "m.txt").write_text("1,2\n3,4\n")
    assert [tuple(r) for r in T.read_text_table(spark, str(tmp_path / "m.txt"), ",", includes_key=False, key_prefix="r").orderBy("key").collect()] == [("r00000000", 0, [1.0, 2.0]), ("r00000001", 0, [3.0, 4.0])]
    assert T.read_matrix(spark, str(tmp_path / "m.txt")).count() == 2
    assert T.random_table(spark, 10, 3, 1, 4).where(F.exists("x", lambda v: F.abs(v) > 1)).count() == 0


def test_files_and_datasets(spark, tmp_path):
    obs = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 1, [3.0, 4.0]), ("b", 0, [5.0, 6.0])], "key string, obs int, x array<double>")
    for kind in ("double", "float", "int", "text"):
        d = str(tmp_path / kind)
        assert B.export_files(obs, d, kind=kind).count() == 2
        assert sorted(map(str, B.import_files(spark, d, kind=kind, features=2).collect())) == sorted(map(str, obs.collect()))
    x = np.arange(6.0).reshape(3, 2)
    raw = B.encode_dataset(x, np.array([0, 1, -1]), np.ones(3), np.arange(3))
    (tmp_path / "d.bin").write_bytes(raw)
    assert B.dataset_info(raw)["size"] == 3
    back = B.read_dataset(spark, str(tmp_path / "d.bin"), first=1).orderBy("number").collect()
    assert [r["target"] for r in back] == [1.0, -1.0] and back[0]["x"] == [2.0, 3.0] and back[1]["idx"] == 2


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    row = lambda *r: spark.createDataFrame(list(r), "key string, v int")
    s.write("t", row(("a", 1), ("b", 2)))
    s.upsert("t", row(("b", 3), ("c", 4)))
    assert sorted(map(tuple, s.read("t").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    s.erase("t", row(("a", 0)))
    s.defragment("t")
    assert s.all_keys().count() == 2 and s.statistics().first()["rows"] == 2
    s.rename("t", "u")
    assert s.tables() == ["u"]
    s.drop("u")
    assert s.tables() == []


def test_network(spark, tmp_path):
    rng = np.random.default_rng(0)
    y = np.arange(60) % 2
    (tmp_path / "x.txt").write_text("\n".join(f"k{i} {a} {b}" for i, (a, b) in enumerate(rng.normal(size=(60, 2)) + 3 * y[:, None])) + "\n")
    (tmp_path / "y.txt").write_text("\n".join(f"k{i} {v}" for i, v in enumerate(y)) + "\n")
    n = Network("small")
    n.add("data", "text-source", filename=str(tmp_path / "x.txt"))
    n.add("labels", "text-source", filename=str(tmp_path / "y.txt"))
    n.add("pca", "pca")
    n.add("fit", "logistic", maxIterations=10)
    n.add("table", "confusion-matrix")
    n.add("curve", "pr-curve")
    for e in (("data", "pca", "dataIn"), ("pca", "fit", "dataIn"), ("labels", "fit", "targetIn"), ("labels", "table", "actualIn"), ("fit", "table", "predictedIn"), ("labels", "curve", "actualIn"), ("fit", "curve", "predictedIn")):
        n.connect(e[0], "dataOut", e[1], e[2])
    again = Network.from_xml(n.to_xml())
    assert again.order() and again.edges == n.edges
    out = again.run(spark)
    assert out["table.scoresOut"].first()["accuracy"] > 0.95 and out["curve.curveOut"].count() > 10
    again.reset()
    again.rename("pca", "components")
    again.remove("curve")
    assert "components" in again.nodes and not any("curve" in k[0] for k in again.edges)


def test_streaming(spark, tmp_path):
    schema = "key string, obs int, x array<double>"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    src = str(tmp_path / "in")
    store = Store(spark, str(tmp_path / "db"))
    run = lambda: S.update_missing_stream(spark.readStream.schema(schema).parquet(src), store, "t", lambda t: t, str(tmp_path / "cp")).awaitTermination()
    rows(("a", 0, [1.0])).write.parquet(src)
    run()
    rows(("a", 0, [9.0]), ("b", 0, [2.0])).write.mode("append").parquet(src)
    run()
    assert sorted((r["key"], r["x"][0]) for r in store.read("t").collect()) == [("a", 1.0), ("b", 2.0)]
    near = S.online_labels(rows(("a", 0, [0.9])), [(0, [0.0]), (1, [1.0])])
    assert near.first()["label"] == 1


def test_store_keeps_deltas_and_refuses_a_second_writer(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    row = lambda *r: spark.createDataFrame(list(r), "key string, v int")
    for k in range(4):
        s.append("t", row((f"k{k}", k)))
    s.erase("t", row(("k1", 0)))
    s.append("t", row(("k1", 9)))
    assert sorted(map(tuple, s.read("t").collect())) == [("k0", 0), ("k1", 9), ("k2", 2), ("k3", 3)]
    number, parts = s._parts("t")
    assert [p[0] for p in parts] == ["data"] * 4 + ["erased", "data"]
    with pytest.raises(RuntimeError, match="another writer"):
        s._commit("t", number, parts)
    s.defragment("t")
    s.defragment("t")
    assert len(s._parts("t")[1]) == 1 and s.read("t").count() == 4
    assert s.lock() and not s.lock() and s.unlock() and s.lock()
    assert s.tables() == ["t"]


def test_models_come_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(str(i), 0, [float(a), float(b)], int(a + 0.3 * b > 0) + int(a > 1)) for i, (a, b) in enumerate(rng.normal(size=(80, 2)))]
    df = spark.createDataFrame(rows, "key string, obs int, x array<double>, label int")
    fitted = [L.fit_whitener(df), L.fit_pca(df), L.fit_lda(df.where("label < 2")), L.fit_kmeans(df, 2), L.fit_mixture(df, 2, max_rounds=2), L.fit_gaussian(df), L.fit_tree(df, 3, 2), L.fit_boosted(df, 3, 2), L.fit_forest(df, 3, 2), L.fit_logistic(df, 3, max_rounds=5), L.fit_composite(df, 3, rounds=2)]
    for k, m in enumerate(fitted):
        models.save_model(spark, m, str(tmp_path / f"m{k}.json"))
        again = models.load_model(spark, str(tmp_path / f"m{k}.json"))
        assert models.to_json(again) == models.to_json(m)
        if isinstance(m, L.Classifier):
            assert m.predict(df).collect() == again.predict(df).collect()
        elif isinstance(m, L.Linear):
            assert m.transform(df).collect() == again.transform(df).collect()
    with pytest.raises(TypeError):
        models.to_json(object())


def test_command_line(spark, tmp_path, capsys):
    rng = np.random.default_rng(2)
    y = np.arange(90) % 3
    (tmp_path / "x.txt").write_text("\n".join(f"{a} {b}" for a, b in rng.normal(size=(90, 2)) * 0.3 + np.column_stack([y, y * y])) + "\n")
    (tmp_path / "y.txt").write_text("\n".join(map(str, y)) + "\n")
    files = ["--features", str(tmp_path / "x.txt"), "--labels", str(tmp_path / "y.txt"), "--model", str(tmp_path / "m.json")]
    assert cli.main(["train", *files, "--method", "Tree", "--set", "depth=3"], spark) == 0
    assert cli.main(["evaluate", *files, "--out", str(tmp_path / "out")], spark) == 0
    assert "accuracy" in capsys.readouterr().out
    rows = cli.labelled(spark, str(tmp_path / "x.txt"), str(tmp_path / "y.txt"))
    _, table, scores = cli.evaluate(rows, models.load_model(spark, str(tmp_path / "m.json")))
    assert scores.first()["accuracy"] > 0.9 and table.count() == 9
    assert T.read_text_table(spark, str(tmp_path / "out")).count() == 90
    store = Store(spark, str(tmp_path / "db"))
    store.write("t", spark.createDataFrame([("a", 1)], "key string, v int"))
    assert cli.main(["store", str(tmp_path / "db"), "--rename", "t", "u"], spark) == 0 and store.tables() == ["u"]


def test_network_updates_missing_keys_alone(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a 1 2\nb 3 4\nc 5 7\n")
    seen = []

    def double(df):
        seen.append(sorted(r["key"] for r in df.collect()))
        return df.withColumn("x", F.transform("x", lambda v: v * 2))

    n = Network("u")
    n.add("data", "text-source", filename=str(tmp_path / "x.txt"))
    n.add("white", "whiten")
    n.add("twice", "python", function=double)
    n.add("sum", "python-multi", function=lambda a, b: a.unionByName(b).groupBy("key", "obs").agg(F.array(F.count("*").cast("double")).alias("x")))
    n.add("mine", "python-adaptive", fit=lambda d: d.count(), apply=lambda d, m: d.withColumn("x", F.array(F.lit(float(m)))))
    for s, t, p in (("data", "white", "dataIn"), ("data", "twice", "dataIn"), ("white", "sum", "in0"), ("twice", "sum", "in1"), ("data", "mine", "dataIn")):
        n.connect(s, "dataOut", t, p)
    first = {k: cut(v) for k, v in n.run(spark).items()}
    spark.catalog.clearCache()  # outputs that several nodes read are kept in memory, by path
    white = n.nodes["white"].model
    (tmp_path / "x.txt").write_text("a 9 9\nb 3 4\nc 5 7\nd 1 1\n")
    out = n.update(spark, first)
    assert seen == [["a", "b", "c"], ["d"]] and n.nodes["white"].model is white
    got = {r["key"]: r["x"] for r in out["twice.dataOut"].collect()}
    assert got == {"a": [2.0, 4.0], "b": [6.0, 8.0], "c": [10.0, 14.0], "d": [2.0, 2.0]}
    assert {r["key"]: r["x"][0] for r in out["sum.dataOut"].collect()} == dict.fromkeys("abcd", 2.0)
    assert {r["x"][0] for r in out["mine.dataOut"].collect()} == {3.0}


def test_codebook_files_and_scatter_nodes(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a 0.1 0\nb 0.9 1\nb 2 2\n")
    (tmp_path / "c.txt").write_text("a 1\nb 0\n")
    n = Network("nodes")
    n.add("data", "text-source", filename=str(tmp_path / "x.txt"))
    n.add("code", "codebook-encode", codebook=[[0.0, 0.0], [1.0, 1.0]])
    n.add("back", "codebook-decode", codebook=[[0.0, 0.0], [1.0, 1.0]])
    n.add("out", "export-files", directory=str(tmp_path / "files"))
    n.add("colours", "colour-table", filename=str(tmp_path / "c.txt"))
    n.add("white", "whiten", colour=0)
    n.add("plot", "scatter-data")
    for s, o, t, p in (("data", "dataOut", "code", "dataIn"), ("code", "dataOut", "back", "dataIn"), ("data", "dataOut", "out", "dataIn"), ("data", "dataOut", "white", "dataIn"), ("colours", "colourOut", "white", "colourIn"), ("back", "dataOut", "plot", "dataIn")):
        n.connect(s, o, t, p)
    out = n.run(spark)
    assert [r["x"] for r in out["code.dataOut"].orderBy("key", "obs").collect()] == [[0.0], [1.0], [1.0]]
    assert sorted(map(tuple, out["plot.plotOut"].collect())) == [(0.0, 0.0, -1, 1), (1.0, 1.0, -1, 2)]
    assert {r["name"]: r["bytes"] for r in B.list_files(spark, str(tmp_path / "files"), ".bin").collect()} == {"a.bin": 16, "b.bin": 32}
    assert np.allclose(n.nodes["white"].model.offset, [1.45, 1.5])
    again = Network.from_xml(n.to_xml())
    assert np.allclose(again.nodes["white"].model.offset, [1.45, 1.5]) and again.nodes["code"].get("codebook") == [[0.0, 0.0], [1.0, 1.0]]
    m = Network("read")
    m.add("in", "import-files", directory=str(tmp_path / "files"), features=2)
    assert m.run(spark)["in.dataOut"].count() == 3
