"""Sinks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_TERMS = 10_000


def json_lines(df: DataFrame, path: str, compression: str = "gzip", mode: str = "errorifexists") -> None:
    """[K1 K8] null fields are left out of a line."""
    df.write.mode(mode).option("compression", compression).option("ignoreNullFields", "true").json(path)


def json_by_source(df: DataFrame, source: str, path: str, mode: str = "errorifexists") -> None:
    """[K2] one folder a source file, for results that mirror their input."""
    df.write.mode(mode).partitionBy(source).json(path)


def reduced_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """[K3] a reduced result as one file."""
    df.coalesce(1).write.mode(mode).json(path)


def tsv_line(df: DataFrame) -> DataFrame:
    """[K4] value: fields joined by tabs, list elements too."""
    parts = [F.array_join(F.transform(F.col(f.name), lambda x: x.cast("string")), "\t", "") if f.dataType.typeName() == "array" else F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in df.schema]
    return df.select(F.concat_ws("\t", *parts).alias("value"))


def reduced_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """[K4]"""
    tsv_line(df).coalesce(1).write.mode(mode).text(path)


def fields_to_tsv(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """[K5] value: the fields' values joined by tabs, missing ones empty."""
    have = set(df.columns)
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(f).cast("string"), F.lit("")) if f in have else F.lit("") for f in fields]).alias("value"))


def vectors_to_text(vectors: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """[K6] lines "word x1 x2 ..."."""
    vectors.select(F.concat_ws(" ", "word", F.array_join(F.transform("vec", lambda x: x.cast("string")), " "))).write.mode(mode).text(path)


def vectors_to_npz(vectors: DataFrame, path: str) -> None:
    """[K6] one .npz of words and vectors, made on the driver: for tables that fit there."""
    rows = vectors.orderBy("idx").select("word", "vec").toPandas()
    np.savez(path, words=np.array(rows["word"].tolist()), vectors=np.stack(rows["vec"].to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, 0)))


def conll_text(sentences: Column) -> Column:
    """[K7] token columns joined by tabs, a line a token, a blank line after each sentence."""
    return F.array_join(F.transform(sentences, lambda s: F.concat(F.array_join(F.transform(s, lambda t: F.array_join(t, "\t")), "\n"), F.lit("\n\n"))), "")


def conll_files(df: DataFrame, field: str, path: str, mode: str = "errorifexists") -> None:
    """[K7]"""
    df.select(F.regexp_replace(conll_text(F.col(field)), r"\n\z", "")).write.mode(mode).text(path)


def term_stats(stats: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """[K9] the long table as Parquet."""
    stats.write.mode(mode).parquet(path)


def term_stats_json(stats: DataFrame, parts: int = 1) -> DataFrame:
    """[K9] value: the nested JSON {field: {TF, DF}}, as so many objects, which the reader adds up: no row need hold a whole
    vocabulary.  Where that is more than one, there are as many times more as keep them to about PART_TERMS terms."""
    if parts > 1:
        parts *= max(1, math.ceil(stats.count() / (parts * PART_TERMS)))
    maps = stats.groupBy(F.pmod(F.xxhash64("term"), F.lit(parts)).alias("part"), "field").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("TF"), F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("DF"))
    return maps.groupBy("part").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("field", F.struct("TF", "DF"))))).alias("value")).select("value")
