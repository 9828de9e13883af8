"""Streams of documents: record-local steps run as they are; term statistics and near-duplicate keys keep state.

The reference has no unbounded streams; these follow from its operators.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..plans import spec


def documents(spark: SparkSession, path: str, schema: T.StructType, files: int = 100) -> DataFrame:
    """New JSON-lines files of a folder, so many a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).json(path)


def steps(stream: DataFrame, configs: Sequence[dict[str, Any]]) -> DataFrame:
    """Record-local steps of a specification on a stream; collectors need batches."""
    local = [c for c in configs if spec.KINDS.get(c.get("step", "")) == "collector"]
    if local:
        raise ValueError(f"not record by record: {local[0]['step']}")
    return spec.build(configs)(stream)


def term_frequencies(stream: DataFrame, tokens: Column, field: str) -> DataFrame:
    """[A4] field, term, tf, df in update mode; a document counts once for df, so no state by document is kept."""
    terms = stream.select(F.explode(X.counts(tokens)).alias("term", "n"))
    return terms.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df")).select(F.lit(field).alias("field"), "term", "tf", "df")


def windowed_counts(stream: DataFrame, time: str, late: str, window: str, by: Sequence[str] = ()) -> DataFrame:
    """Documents by event-time window; state is dropped once a window is later than the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"))


def first_by_url(stream: DataFrame, time: str, late: str, url: str = "url") -> DataFrame:
    """The first document of each URL within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([url])


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all that is there, exactly once, then stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_memory(stream: DataFrame, name: str, mode: str = "update") -> StreamingQuery:
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
