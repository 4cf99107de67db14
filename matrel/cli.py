"""Command line: train and evaluate classifiers on text tables, convert and list stores.

    python -m matrel.cli train --features X --labels Y --model M [--method Boosted] [--set depth=2] ...
    python -m matrel.cli evaluate --features X --labels Y --model M [--out PREDICTIONS]
    python -m matrel.cli store PATH [--defragment TABLE] [--drop TABLE] [--rename OLD NEW]

A features file has a row of numbers a line, a labels file a class (negative: unknown) a line, in the same order; with
--keyed both begin lines with a key instead.
"""

from __future__ import annotations

import argparse
import ast
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluation as E
from .operators import learn as L
from .sources import models
from .sources import text as T
from .sources.store import Store


def labelled(spark: SparkSession, features: str, labels: str, keyed: bool = False, delimiter: str = " ") -> DataFrame:
    """(key, obs, x, label) from two text files whose lines belong together."""
    x = T.read_text_table(spark, features, delimiter, includes_key=keyed)
    y = T.read_text_table(spark, labels, delimiter, includes_key=keyed)
    return x.join(y.select("key", "obs", F.element_at("x", 1).cast("int").alias("label")), ["key", "obs"])


def train(spark: SparkSession, rows: DataFrame, method: str = "Boosted", **settings):
    """A classifier of learn.CLASSIFIERS on rows of known label; classes are those up to the greatest label."""
    known = rows.where("label >= 0")
    top = known.agg(F.max("label")).first()[0]
    if top is None:
        raise ValueError("no row with a label")
    return L.CLASSIFIERS[method](known, int(top) + 1, **settings)


def evaluate(rows: DataFrame, model: L.Classifier) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions (key, obs, predicted), confusion table, overall scores)."""
    both = model.predict(rows)
    table = E.confusion(both, "label", "predicted")
    return both.select("key", "obs", "predicted"), table, E.overall(table)


def _settings(pairs: Sequence[str]) -> dict:
    out = {}
    for p in pairs:
        name, _, value = p.partition("=")
        try:
            out[name] = ast.literal_eval(value)
        except (ValueError, SyntaxError):
            out[name] = value
    return out


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="matrel")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("train", "evaluate"):
        p = commands.add_parser(name)
        for option in ("--features", "--labels", "--model"):
            p.add_argument(option, required=True)
        p.add_argument("--keyed", action="store_true")
        p.add_argument("--delimiter", default=" ")
        if name == "train":
            p.add_argument("--method", choices=sorted(L.CLASSIFIERS), default="Boosted")
            p.add_argument("--set", dest="settings", action="append", default=[], metavar="NAME=VALUE")
        else:
            p.add_argument("--out")
    p = commands.add_parser("store")
    p.add_argument("path")
    p.add_argument("--defragment")
    p.add_argument("--drop")
    p.add_argument("--rename", nargs=2)
    a = top.parse_args(args)
    spark = spark or SparkSession.builder.appName("matrel").getOrCreate()
    if a.command == "store":
        store = Store(spark, a.path)
        if a.defragment:
            store.defragment(a.defragment)
        if a.drop:
            store.drop(a.drop)
        if a.rename:
            store.rename(*a.rename)
        if store.tables():
            store.statistics().orderBy("table").show(truncate=False)
        return 0
    rows = labelled(spark, a.features, a.labels, a.keyed, a.delimiter)
    if a.command == "train":
        models.save_model(spark, train(spark, rows, a.method, **_settings(a.settings)), a.model)
        return 0
    predictions, table, scores = evaluate(rows, models.load_model(spark, a.model))
    if a.out:
        T.write_text_table(predictions.select("key", "obs", F.array(F.col("predicted").cast("double")).alias("x")), a.out)
    table.orderBy("actual", "predicted").show(1000, truncate=False)
    scores.show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
