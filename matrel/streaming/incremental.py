"""Streaming forms of the incremental operators: missing keys only, running statistics, labels of new items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import arrays as A
from ..sources.store import Store


def update_missing_stream(stream: DataFrame, store: Store, table: str, compute: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch computes the keys that the table lacks and adds them; a batch run again finds them there."""

    def batch(df: DataFrame, number: int) -> None:
        new = df.dropDuplicates(["key", "obs"]) if "obs" in df.columns else df.dropDuplicates(["key"])
        if table in store.tables():
            new = new.join(store.keys(table), "key", "left_anti")
        store.append(table, compute(new))

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_moments(stream: DataFrame, time: str, value: str, by: list[str], window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Mergeable moments of event-time windows: count, sum and sum of squares, closed by the watermark."""
    v = F.col(value)
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))


def first_seen(stream: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def online_labels(stream: DataFrame, centres: list[tuple[int, list[float]]]) -> DataFrame:
    """Label of the nearest of some labelled centres for each new row (key, x)."""
    d = F.array(*(F.struct(A.squared_distance(F.col("x"), A.constant(c)).alias("d"), F.lit(label).alias("label")) for label, c in centres))
    return stream.withColumn("label", F.array_min(d)["label"])
