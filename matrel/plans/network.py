"""Dataflow networks: named nodes, ports and connections, read from XML or built in Python, run as lazy DataFrames."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import learn as L
from ..operators import tables as O
from ..sources import binary as B
from ..sources import models
from ..sources import text as T
from ..storage import cut

#: name: (group, input ports, output ports, function (node, spark, inputs) -> outputs, default properties)
REGISTRY: dict[str, tuple] = {}


def register(kind: str, group: str, inputs: tuple[str, ...], outputs: tuple[str, ...], /, **defaults):
    def keep(fn: Callable):
        REGISTRY[kind] = (group, inputs, outputs, fn, defaults)
        return fn

    return keep


@dataclass
class Node:
    name: str
    kind: str
    properties: dict = field(default_factory=dict)
    model: object = None

    def get(self, prop: str):
        return self.properties.get(prop, REGISTRY[self.kind][4].get(prop))


class Network:
    def __init__(self, title: str = ""):
        self.title = title
        self.nodes: dict[str, Node] = {}
        self.edges: dict[tuple[str, str], tuple[str, str]] = {}  # (node, input port): (node, output port)

    def add(self, name: str, kind: str, /, **properties) -> Node:
        if name in self.nodes:
            raise ValueError(f"a node {name} is there")
        if kind not in REGISTRY:
            raise KeyError(kind)
        self.nodes[name] = Node(name, kind, properties)
        return self.nodes[name]

    def connect(self, source: str, output: str, target: str, inlet: str) -> None:
        self.edges[target, inlet] = (source, output)
        try:
            self.order()
        except CycleError:
            del self.edges[target, inlet]
            raise

    def disconnect(self, target: str, inlet: str) -> None:
        self.edges.pop((target, inlet), None)

    def remove(self, name: str) -> None:
        del self.nodes[name]
        self.edges = {k: v for k, v in self.edges.items() if k[0] != name and v[0] != name}

    def rename(self, old: str, new: str) -> None:
        node = self.nodes.pop(old)
        node.name = new
        self.nodes[new] = node
        swap = lambda p: (new if p[0] == old else p[0], p[1])
        self.edges = {swap(k): swap(v) for k, v in self.edges.items()}

    def copy_into(self, other: Network, names: list[str], prefix: str = "copy-of-") -> None:
        """Nodes and the connections between them, under new names."""
        for n in names:
            other.add(prefix + n, self.nodes[n].kind, **self.nodes[n].properties)
        for (t, i), (s, o) in self.edges.items():
            if t in names and s in names:
                other.connect(prefix + s, o, prefix + t, i)

    def order(self) -> list[str]:
        graph = {n: set() for n in self.nodes}
        for (t, _), (s, _) in self.edges.items():
            graph[t].add(s)
        return list(TopologicalSorter(graph).static_order())

    def reset(self) -> None:
        for n in self.nodes.values():
            n.model = None

    def run(self, spark: SparkSession) -> dict[str, DataFrame]:
        """Outputs as <node>.<port>: fitted in topological order, everything else lazy. An output that several nodes read
        is kept in memory and on disk."""
        out: dict[str, DataFrame] = {}
        readers: dict[tuple[str, str], int] = {}
        for source in self.edges.values():
            readers[source] = readers.get(source, 0) + 1
        for name in self.order():
            node = self.nodes[name]
            _, inputs, outputs, fn, _ = REGISTRY[node.kind]
            given = {p: out["{}.{}".format(*self.edges[name, p])] for p in inputs if (name, p) in self.edges}
            for port, df in fn(node, spark, given).items():
                out[f"{name}.{port}"] = df.persist() if readers.get((name, port), 0) > 1 else df
        return out

    def update(self, spark: SparkSession, done: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Outputs with the keys that done lacks computed, those it has as they are. A node gets only the records of keys
        that its outputs lack; adaptive nodes that are fitted stay as they are, others are fitted on all their input.
        Nodes whose outputs have no keys (tables of results) run on everything."""
        out: dict[str, DataFrame] = {}
        for name in self.order():
            node = self.nodes[name]
            group, inputs, outputs, fn, _ = REGISTRY[node.kind]
            given = {p: out["{}.{}".format(*self.edges[name, p])] for p in inputs if (name, p) in self.edges}
            have = [done.get(f"{name}.{port}") for port in outputs]
            keyed = bool(outputs) and all(d is not None and "key" in d.columns for d in have)
            if not keyed:
                out |= {f"{name}.{port}": df for port, df in fn(node, spark, given).items()}
                continue
            if group == "Adaptive" and node.model is None:
                fn(node, spark, given)  # fits; what it would compute is lazy and not used
            there = have[0].select("key").distinct()
            lack = lambda df: df.join(there, "key", "left_anti") if "key" in df.columns else df  # noqa: B023, E731
            new = fn(node, spark, {p: lack(df) for p, df in given.items()})
            out |= {f"{name}.{port}": done[f"{name}.{port}"].unionByName(lack(df)) for port, df in new.items()}
        return out

    def to_xml(self) -> str:
        """The network with its properties and what its nodes have fitted."""
        root = ET.Element("network", title=self.title)
        for n in self.nodes.values():
            e = ET.SubElement(root, "node", name=n.name, type=n.kind)
            for k, v in n.properties.items():
                if callable(v):
                    raise TypeError(f"{n.name}: a function cannot be written")
                ET.SubElement(e, "property", name=k).text = json.dumps(v) if isinstance(v, (list, dict)) else str(v)
            if n.model is not None:
                ET.SubElement(e, "model").text = models.to_json(n.model)
        for (t, i), (s, o) in self.edges.items():
            ET.SubElement(root, "connection", source=s, output=o, target=t, input=i)
        return ET.tostring(root, encoding="unicode")

    @classmethod
    def from_xml(cls, text: str) -> Network:
        root = ET.fromstring(text)
        out = cls(root.get("title", ""))
        for e in root.iter("node"):
            defaults = REGISTRY[e.get("type")][4]
            props = {p.get("name"): _typed(p.text or "", defaults.get(p.get("name"))) for p in e.iter("property")}
            node = out.add(e.get("name"), e.get("type"), **props)
            if (fitted := e.find("model")) is not None:
                node.model = models.from_json(fitted.text)
        for e in root.iter("connection"):
            out.connect(e.get("source"), e.get("output"), e.get("target"), e.get("input"))
        return out


def _typed(text: str, default):
    if isinstance(default, bool):
        return text.strip().upper() in ("1", "TRUE", "YES")
    if isinstance(default, (list, dict)):
        return json.loads(text)
    return type(default)(text) if isinstance(default, (int, float)) else text


@register("text-source", "Source", (), ("dataOut",), filename="", delimiter=" ", headerLines=0, includesKey=True, keyPrefix="")
def _text(node, spark, given):
    return {"dataOut": T.read_text_table(spark, node.get("filename"), node.get("delimiter"), node.get("headerLines"), node.get("includesKey"), node.get("keyPrefix"))}


@register("random-source", "Source", (), ("dataOut",), numRecords=1000, numFeatures=25, minObservations=1, maxObservations=1)
def _random(node, spark, given):
    return {"dataOut": T.random_table(spark, node.get("numRecords"), node.get("numFeatures"), node.get("minObservations"), node.get("maxObservations"))}


@register("table-source", "Source", (), ("dataOut",), name="")
def _table(node, spark, given):
    return {"dataOut": spark.table(node.get("name"))}


@register("text-sink", "Sink", ("dataIn",), (), filename="", delimiter=" ", includeHeader=False, includeKey=True)
def _sink(node, spark, given):
    T.write_text_table(given["dataIn"], node.get("filename"), node.get("delimiter"), node.get("includeHeader"), node.get("includeKey"))
    return {}


@register("unary", "Static", ("dataIn",), ("dataOut",), operation="exp", argument=1.0)
def _unary(node, spark, given):
    return {"dataOut": O.unary(given["dataIn"], node.get("operation"), node.get("argument"))}


@register("binary", "Static", ("inA", "inB"), ("dataOut",), operation="add")
def _binary(node, spark, given):
    return {"dataOut": O.binary(given["inA"], given["inB"], node.get("operation"))}


@register("concatenate", "Static", ("in0", "in1", "in2", "in3"), ("dataOut",), appendOne=False)
def _concat(node, spark, given):
    return {"dataOut": O.concatenate(list(given.values()), node.get("appendOne"))}


@register("rollup", "Static", ("dataIn", "indexIn"), ("dataOut",), operation="mean")
def _roll(node, spark, given):
    index = given["indexIn"].select("key", "obs", F.element_at("x", 1).cast("int").alias("idx")) if "indexIn" in given else None
    return {"dataOut": O.roll_up(given["dataIn"], node.get("operation"), index)}


def _fold(df: DataFrame, given: dict, colour: int) -> DataFrame:
    from ..model import of_colour

    return of_colour(df, given["colourIn"], colour) if "colourIn" in given else df


def _labelled(node, given) -> DataFrame:
    target = given["targetIn"].select("key", "obs", F.element_at("x", 1).cast("int").alias("label"))
    weights = given["weightsIn"].select("key", "obs", F.element_at("x", 1).alias("weight")) if "weightsIn" in given else None
    rows = O.known(O.with_target(_fold(given["dataIn"], given, node.get("colour")), target, weights))
    rate = node.get("subSample")
    return rows.where(F.pmod(F.xxhash64("key", "obs"), F.lit(rate)) == 0) if rate and rate > 1 else rows


for _kind, _fit in (("rescale", L.fit_rescale), ("whiten", L.fit_whitener)):

    @register(_kind, "Adaptive", ("dataIn", "colourIn"), ("dataOut",), colour=-1)
    def _scale(node, spark, given, fit=_fit):
        node.model = node.model or fit(_fold(given["dataIn"], given, node.get("colour")))
        return {"dataOut": node.model.transform(given["dataIn"])}


@register("pca", "Adaptive", ("dataIn", "colourIn"), ("dataOut",), colour=-1, numOutputDims=0, energyThreshold=1.0, normalizeOutput=True)
def _pca(node, spark, given):
    node.model = node.model or L.fit_pca(_fold(given["dataIn"], given, node.get("colour")), node.get("numOutputDims"), node.get("energyThreshold"), node.get("normalizeOutput"))
    return {"dataOut": node.model.transform(given["dataIn"])}


@register("lda", "Adaptive", ("dataIn", "targetIn", "colourIn"), ("dataOut",), colour=-1, regularization=0.0, subSample=0)
def _lda(node, spark, given):
    node.model = node.model or L.fit_lda(_labelled(node, given), ridge=node.get("regularization"))
    return {"dataOut": node.model.transform(given["dataIn"])}


def _classify(node, given, fit):
    if node.model is None:
        rows = _labelled(node, given).persist()
        classes = int(rows.agg(F.max("label")).first()[0]) + 1
        node.model = fit(rows, classes)
        rows.unpersist()
    return {"dataOut": given["dataIn"].withColumn("x", node.model.marginals(F.col("x")))}


_PORTS = ("dataIn", "targetIn", "weightsIn", "colourIn")


@register("logistic", "Adaptive", _PORTS, ("dataOut",), colour=-1, subSample=0, maxIterations=100, regStrength=1e-9)
def _logistic(node, spark, given):
    return _classify(node, given, lambda rows, k: L.fit_logistic(rows, k, weight="weight", ridge=node.get("regStrength"), max_rounds=node.get("maxIterations")))


@register("decision-tree", "Adaptive", _PORTS, ("dataOut",), colour=-1, subSample=0, maxDepth=1, split="ENTROPY")
def _tree(node, spark, given):
    return _classify(node, given, lambda rows, k: L.fit_tree(rows, k, node.get("maxDepth"), weight="weight", split=node.get("split")))


@register("boosting", "Adaptive", _PORTS, ("dataOut",), colour=-1, subSample=0, numRounds=100, maxDepth=2, method="DISCRETE")
def _boost(node, spark, given):
    return _classify(node, given, lambda rows, k: L.fit_boosted(rows, k, node.get("numRounds"), node.get("maxDepth"), weight="weight", method=node.get("method")))


@register("regression", "Adaptive", _PORTS, ("dataOut",), colour=-1, subSample=0, regStrength=1e-9, loss="L2")
def _regress(node, spark, given):
    if node.model is None:
        target = given["targetIn"].select("key", "obs", F.element_at("x", 1).alias("y"))
        node.model = L.fit_regression(_fold(given["dataIn"], given, node.get("colour")).join(target, ["key", "obs"]), bias=False, ridge=node.get("regStrength"), loss=node.get("loss"))
    return {"dataOut": given["dataIn"].withColumn("x", F.array(node.model.predict(F.col("x"))))}


def _label_of(df: DataFrame, name: str) -> DataFrame:
    from ..functions.arrays import argmax

    return df.select("key", "obs", F.when(F.size("x") > 1, argmax(F.col("x"))).otherwise(F.element_at("x", 1).cast("int")).alias(name))


@register("confusion-matrix", "Sink", ("actualIn", "predictedIn", "colourIn"), ("tableOut", "scoresOut"), colour=-1)
def _confusion(node, spark, given):
    both = _fold(_label_of(given["actualIn"], "a").join(_label_of(given["predictedIn"], "p"), ["key", "obs"]), given, node.get("colour"))
    table = E.confusion(both, "a", "p")
    return {"tableOut": table, "scoresOut": E.overall(table)}


@register("pr-curve", "Sink", ("actualIn", "predictedIn", "colourIn"), ("curveOut",), colour=-1)
def _curve(node, spark, given):
    """(class, score, recall, precision): a curve for each class that the scores have, from its score in predictedIn."""
    scores = given["predictedIn"].select("key", "obs", F.posexplode("x").alias("class", "score"))
    both = _fold(_label_of(given["actualIn"], "a").join(scores, ["key", "obs"]), given, node.get("colour"))
    classes = sorted(r["class"] for r in scores.select("class").distinct().collect())
    curves = [E.pr_curve(E.scored_results(both.where(F.col("class") == k), "score", "a", k)).select(F.lit(k).alias("class"), "score", "recall", "precision") for k in classes]
    none = spark.createDataFrame([], "class int, score double, recall double, precision double")
    return {"curveOut": reduce(DataFrame.union, curves, none)}


def _codebook(node, spark) -> list[list[float]]:
    """Rows of the property codebook, or of the matrix file that filename names."""
    if node.get("filename"):
        return [r["x"] for r in T.read_matrix(spark, node.get("filename")).orderBy("row").collect()]
    return node.get("codebook")


@register("codebook-encode", "Static", ("dataIn",), ("dataOut",), codebook=[], filename="", mode="nearest-L2")
def _encode(node, spark, given):
    return {"dataOut": O.encode_codebook(given["dataIn"], _codebook(node, spark), node.get("mode"))}


@register("codebook-decode", "Static", ("dataIn",), ("dataOut",), codebook=[], filename="")
def _decode(node, spark, given):
    return {"dataOut": O.decode_codebook(given["dataIn"], _codebook(node, spark))}


@register("import-files", "Source", (), ("dataOut",), directory="", extension=".bin", kind="double", features=1, headerBytes=0, footerBytes=0)
def _import(node, spark, given):
    return {"dataOut": B.import_files(spark, *(node.get(p) for p in ("directory", "extension", "kind", "features", "headerBytes", "footerBytes")))}


@register("export-files", "Sink", ("dataIn",), ("filesOut",), directory="", extension=".bin", kind="double", update=False)
def _export(node, spark, given):
    """filesOut: (key, rows) of what was written."""
    done = B.export_files(given["dataIn"].select("key", "obs", "x"), *(node.get(p) for p in ("directory", "extension", "kind", "update")))
    return {"filesOut": cut(done)}


@register("random-colours", "Static", ("dataIn",), ("colourOut",), folds=2, seed=0)
def _colours(node, spark, given):
    from ..model import random_colours

    return {"colourOut": random_colours(given["dataIn"], node.get("folds"), node.get("seed"))}


@register("colour-table", "Source", (), ("colourOut",), filename="", delimiter=" ")
def _colour_table(node, spark, given):
    """Colours from a text file of lines "key colour"."""
    return {"colourOut": T.read_text_table(spark, node.get("filename"), node.get("delimiter")).select("key", F.element_at("x", 1).cast("int").alias("colour"))}


@register("python", "Custom", ("dataIn",), ("dataOut",), function=None)
def _python(node, spark, given):
    """function: a Python callable from a DataFrame in observation form to another."""
    return {"dataOut": node.get("function")(given["dataIn"])}


@register("python-multi", "Custom", ("in0", "in1", "in2", "in3"), ("dataOut",), function=None)
def _python_multi(node, spark, given):
    """function: from the connected inputs, in the order of their ports, to a DataFrame."""
    return {"dataOut": node.get("function")(*given.values())}


@register("python-adaptive", "Adaptive", ("dataIn", "targetIn", "colourIn"), ("dataOut",), colour=-1, fit=None, apply=None)
def _python_adaptive(node, spark, given):
    """fit: from data of the fold (and the target, if there is one) to a model; apply: from data and model to a DataFrame."""
    if node.model is None:
        node.model = node.get("fit")(_fold(given["dataIn"], given, node.get("colour")), *([given["targetIn"]] if "targetIn" in given else []))
    return {"dataOut": node.get("apply")(given["dataIn"], node.model)}


@register("scatter-data", "Sink", ("dataIn", "targetIn"), ("plotOut",), xFeature=0, yFeature=1)
def _scatter(node, spark, given):
    """(x, y, label, n) of a scatter plot: how many rows have each point, so what is drawn is as small as it looks."""
    rows = given["dataIn"]
    label = F.lit(-1).alias("label")
    if "targetIn" in given:
        rows, label = rows.join(_label_of(given["targetIn"], "label"), ["key", "obs"], "left"), F.coalesce("label", F.lit(-1)).alias("label")
    at = lambda p: F.get("x", F.lit(node.get(p)))
    return {"plotOut": rows.select(at("xFeature").alias("px"), at("yFeature").alias("py"), label).groupBy("px", "py", "label").agg(F.count("*").alias("n")).select(F.col("px").alias("x"), F.col("py").alias("y"), "label", "n")}
