"""Directories with one file for each record, and the binary dataset layout."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the dataset layout: the flag word's high half, and its bits for weights and indexes.
MAGIC, HAS_WEIGHTS, HAS_INDEXES = 0x00010000, 1, 2
KINDS = {"double": "<f8", "float": "<f4", "int": "<i4"}


def import_files(spark: SparkSession, directory: str, extension: str = ".bin", kind: str = "double", features: int = 1, header_bytes: int = 0, footer_bytes: int = 0) -> DataFrame:
    """Observation form of a directory of files; the key is the file's base name, kind text, double, float or int."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = content[header_bytes : len(content) - footer_bytes]
                m = np.array(body.decode().split(), float) if kind == "text" else np.frombuffer(body, KINDS[kind]).astype(float)
                m = m[: len(m) // features * features].reshape(-1, features)
                key = path.rpartition("/")[2].removesuffix(extension)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(m), pa.string()), pa.array(range(len(m)), pa.int32()), pa.array(m.tolist(), pa.list_(pa.float64()))], names=["key", "obs", "x"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").load(directory)
    return files.select("path", "content").mapInArrow(run, "key string, obs int, x array<double>")


def list_files(spark: SparkSession, directory: str, extension: str = "", nested: bool = False) -> DataFrame:
    """(name, path, bytes, modified) of the files of a directory; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").option("recursiveFileLookup", str(nested).lower()).load(directory)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def export_files(obs: DataFrame, directory: str, extension: str = ".bin", kind: str = "double", update: bool = False) -> DataFrame:
    """One file for each record, written by the tasks; gives (key, rows). update leaves existing files alone. directory:
    a folder that all executors reach."""
    uri = directory if "://" in directory else f"file://{directory}"

    def run(table: pa.Table) -> pa.Table:
        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        key = table["key"][0].as_py()
        path = f"{root}/{key}{extension}"
        if not (update and store.get_file_info(path).type == fs.FileType.File):
            rows = table.sort_by("obs")["x"].to_pylist()
            data = "\n".join(" ".join(map(repr, r)) for r in rows).encode() + b"\n" if kind == "text" else np.array(rows).astype(KINDS[kind]).tobytes()
            with store.open_output_stream(path) as f:
                f.write(data)
        return pa.table({"key": [key], "rows": pa.array([table.num_rows], pa.int64())})

    return obs.groupBy("key").applyInArrow(run, "key string, rows long")


def encode_dataset(features: np.ndarray, targets: np.ndarray, weights: np.ndarray | None = None, indexes: np.ndarray | None = None, integer_target: bool = True) -> bytes:
    flags = MAGIC | (HAS_WEIGHTS if weights is not None else 0) | (HAS_INDEXES if indexes is not None else 0)
    n = features.shape[1]
    kind = [("t", "<i4" if integer_target else "<f8"), ("x", "<f8", (n,))] + [("w", "<f8")] * (weights is not None) + [("i", "<i4")] * (indexes is not None)
    rows = np.zeros(len(features), kind)
    rows["t"], rows["x"] = targets, features
    if weights is not None:
        rows["w"] = weights
    if indexes is not None:
        rows["i"] = indexes
    return struct.pack("<Ii", flags, n) + rows.tobytes()


def dataset_info(content: bytes, integer_target: bool = True) -> dict:
    """Size, features and which columns there are, from the header and the length alone."""
    flags, n = struct.unpack("<Ii", content[:8])
    if flags & 0xFFFF0000 != MAGIC:
        raise ValueError("not a dataset")
    width = (4 if integer_target else 8) + 8 * n + (8 if flags & HAS_WEIGHTS else 0) + (4 if flags & HAS_INDEXES else 0)
    return {"features": n, "weights": bool(flags & HAS_WEIGHTS), "indexes": bool(flags & HAS_INDEXES), "size": (len(content) - 8) // width, "width": width}


def read_dataset(spark: SparkSession, path: str, integer_target: bool = True, first: int = 0, last: int | None = None) -> DataFrame:
    """(number, target, x, weight, idx) of dataset files; first and last bound the row numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                info = dataset_info(content, integer_target)
                kind = [("t", "<i4" if integer_target else "<f8"), ("x", "<f8", (info["features"],))] + [("w", "<f8")] * info["weights"] + [("i", "<i4")] * info["indexes"]
                rows = np.frombuffer(content, kind, offset=8)[first : info["size"] if last is None else last]
                for a in range(0, len(rows), 10_000):
                    r = rows[a : a + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(first + a, first + a + len(r)), pa.int64()), pa.array(r["t"].astype(float)), pa.array(r["x"].tolist(), pa.list_(pa.float64())), pa.array(r["w"] if info["weights"] else [None] * len(r), pa.float64()), pa.array(r["i"] if info["indexes"] else [None] * len(r), pa.int32())],
                        names=["number", "target", "x", "weight", "idx"],
                    )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "number long, target double, x array<double>, weight double, idx int")


def count_label(df: DataFrame, label: int) -> DataFrame:
    return df.where(F.col("target") == label).agg(F.count("*").alias("n"))
