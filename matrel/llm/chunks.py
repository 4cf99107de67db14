"""Texts packed into chunks, for operators that ask the whole corpus about what a chunk holds.

A chunk is a row (chunk, ids, sizes, data, rest, bytes): the documents of a few MB of text, and any further columns of
theirs as an Arrow stream. The rows are written once, as files in the shared folder that are bucketed by chunk, so a pass
that brings answers back to the chunks shuffles the answers and not the texts. Chunks are numbered so that those of a
task fall into a few buckets, as each is a file. Questions go out as one binary value for each (chunk, group), each distinct question of a chunk once:
a string that a third of all documents hold is one entry for each chunk, not for each document.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, release

#: UTF-8 bytes of a chunk; one longer text is a chunk by itself.
CHUNK_BYTES = 4 << 20
#: Files that a task writes at most.
TASK_FILES = 8
#: Text whose questions make up a group.
GROUP_BYTES = 64 << 20

SCHEMA = "chunk long, ids binary, sizes binary, data binary, rest binary, bytes long"
ANSWER = "chunk long, kind int, grp int, value binary"
ANSWER_ARROW = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("grp", pa.int32()), ("value", pa.binary())])


def bucket_of(numbers: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that Spark puts a long into: its Murmur3 hash with seed 42, by the number of buckets."""
    with np.errstate(over="ignore"):
        turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
        h = np.full(len(numbers), 42, np.uint32)
        for half in (numbers & 0xFFFFFFFF, numbers >> 32):
            k = turn((half & 0xFFFFFFFF).astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
            h = turn(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(8)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % buckets


def chunk_numbers(part: int, buckets: int) -> Iterator[int]:
    """Numbers for the chunks of a task, of no other task, that go round TASK_FILES of the buckets."""
    wanted = [(part * TASK_FILES + i) % buckets for i in range(min(TASK_FILES, buckets))]
    ready: dict[int, list[int]] = {b: [] for b in wanted}
    base, width, n = 0, max(64, 4 * buckets), 0
    while True:
        b = wanted[n % len(wanted)]
        while not ready[b]:
            numbers = (part << 32) + np.arange(base, base + width)
            found = bucket_of(numbers, buckets)
            for x in wanted:
                ready[x] += numbers[found == x].tolist()
            base += width
        yield ready[b].pop(0)
        n += 1


def _pack(chunk_bytes: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = chunk_numbers(TaskContext.get().partitionId(), buckets)
        ids: list[int | None] = []
        texts: list[bytes] = []
        rest: list[pa.RecordBatch] = []
        size = 0

        def flush():
            nonlocal ids, texts, rest, size
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest[0].schema) as out:
                for r in rest:
                    out.write_batch(r)
            known = np.array([k is not None for k in ids], bool)
            keys = np.array([k or 0 for k in ids], np.int64).tobytes() + known.tobytes()
            row = [next(numbers), keys, np.array([len(t) for t in texts], np.int64).tobytes(), b"".join(texts), sink.getvalue().to_pybytes() if rest[0].num_columns else None, size]
            ids, texts, rest, size = [], [], [], 0
            kinds = (pa.int64(), *[pa.binary()] * 4, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, kinds)], names=["chunk", "ids", "sizes", "data", "rest", "bytes"])

        for batch in batches:
            more = pa.RecordBatch.from_arrays(batch.columns[2:], schema=pa.schema([batch.schema.field(i) for i in range(2, batch.num_columns)]))
            since = 0
            for at, (key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                raw = (text.as_py() or "").encode()
                if texts and size + len(raw) > chunk_bytes:
                    rest.append(more.slice(since, at - since))
                    since = at
                    yield flush()
                ids.append(key)
                texts.append(raw)
                size += len(raw)
            rest.append(more.slice(since))
        if texts:
            yield flush()

    return run


def write_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """The chunks of docs, bucketed (null texts are empty; rows that repeat are kept); carry: further columns to keep.
    Buckets: the session's shuffle partitions, so that answers, shuffled by chunk, meet the chunks without another
    exchange. The table's name leaves the catalog at once; its files stay in the shared folder, as lost executors read
    them again, until that folder expires."""
    spark = docs.sparkSession
    buckets = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000))
    name = f"matrel_chunks_{uuid.uuid4().hex}"
    columns = [F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"carried_{c}") for c in carry)]
    packed = docs.select(columns).mapInArrow(_pack(chunk_bytes, buckets), SCHEMA)
    packed.write.option("compression", "zstd").option("path", fresh_path(spark, "chunks")).bucketBy(buckets, "chunk").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"drop table {name}")  # it names files outside the warehouse, which stay
    return out


def groups_of(chunks: DataFrame) -> int:
    """How many groups questions are dealt to: a few for each shuffle partition, so that tasks even out, and more for more
    text, so that a group does not grow with the corpus."""
    size = chunks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return max(3 * int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // GROUP_BYTES))


class Chunk:
    """One unpacked chunk."""

    def __init__(self, table: pa.Table):
        self.number = table["chunk"][0].as_py()
        raw = table["ids"][0].as_py()
        self.ids = np.frombuffer(raw, np.int64, len(raw) // 9)  # 0 where there is none
        self.known = np.frombuffer(raw, bool, len(raw) // 9, 8 * (len(raw) // 9))
        self.sizes = np.frombuffer(table["sizes"][0].as_py(), np.int64)
        self.data = table["data"][0].as_py()
        self.packed_rest = table["rest"][0].as_py()
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes


    def keys(self) -> list:
        return [k if y else None for k, y in zip(self.ids.tolist(), self.known.tolist())]

    def rest(self) -> pa.Table:
        """The columns that were carried."""
        return pa.ipc.open_stream(self.packed_rest).read_all()


def _released(out: pa.Table) -> pa.Table:
    release()
    return out


def ask(chunks: DataFrame, answers: DataFrame | None, fn: Callable, schema: str) -> DataFrame:
    """fn(chunk, {(kind, group): value}) for each chunk, with the answers that came back to it; gives an Arrow table."""
    if answers is None:
        return chunks.groupBy("chunk").applyInArrow(lambda t: _released(fn(Chunk(t), {})), schema)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise ValueError("an answer for no chunk")
        values = dict(zip(zip(right["kind"].to_pylist(), right["grp"].to_pylist()), right["value"].to_pylist()))
        return _released(fn(Chunk(left), values))

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(both, schema)
