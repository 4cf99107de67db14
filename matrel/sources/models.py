"""Fitted models as JSON: what a fit gives can be saved, loaded in another session and applied with equal results."""

from __future__ import annotations

import dataclasses
import json

import numpy as np
from pyspark.sql import SparkSession

from ..operators import learn as L

#: Classes that can be saved, by the name they have in files.
KINDS = {c.__name__: c for c in (L.Linear, L.KMeans, L.Gaussian, L.Mixture, L.Tree, L.Ensemble, L.Logistic, L.Regression, L.Composite)}
FORMAT = 1


def _plain(value):
    """value in the types of JSON; what has another form there is an object with one marked member."""
    if isinstance(value, np.ndarray):
        return {"array": value.tolist(), "shape": list(value.shape)}
    if isinstance(value, np.generic):
        return value.item()
    if dataclasses.is_dataclass(value):
        name = type(value).__name__
        if name not in KINDS:
            raise TypeError(f"no model: {name}")
        return {"kind": name, "fields": {f.name: _plain(getattr(value, f.name)) for f in dataclasses.fields(value)}}
    if isinstance(value, dict):
        return {"items": [[_plain(k), _plain(v)] for k, v in value.items()]}
    if isinstance(value, tuple):
        return {"tuple": [_plain(v) for v in value]}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    raise TypeError(f"no part of a model: {type(value).__name__}")


def _model(value):
    if isinstance(value, list):
        return [_model(v) for v in value]
    if not isinstance(value, dict):
        return value
    if "kind" in value:
        return KINDS[value["kind"]](**{k: _model(v) for k, v in value["fields"].items()})
    if "array" in value:
        return np.array(value["array"]).reshape(value["shape"])
    if "tuple" in value:
        return tuple(_model(v) for v in value["tuple"])
    return {_model(k): _model(v) for k, v in value["items"]}


def to_json(model) -> str:
    return json.dumps({"format": FORMAT, "model": _plain(model)})


def from_json(text: str):
    found = json.loads(text)
    if found.get("format") != FORMAT:
        raise ValueError(f"a model file of format {found.get('format')}")
    return _model(found["model"])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file wherever Spark's file systems reach, replaced if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def save_model(spark: SparkSession, model, path: str) -> None:
    write_text(spark, path, to_json(model))


def load_model(spark: SparkSession, path: str):
    return from_json(read_text(spark, path))
