"""MinHash signatures, banding, and the survivors of near-duplicate elimination in order of arrival."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder

PRIME = 2147483647


def hash32(x: Column) -> Column:
    """First 32 bits of the MD5, equal in any engine."""
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("bigint")


def permutations(n: int) -> list[tuple[int, int]]:
    """Multipliers and offsets of (a x + b) mod 2^31 - 1, from a congruential rule; a x stays within 63 bits."""
    out, x = [], 12345
    for _ in range(n):
        x = (x * 1103515245 + 12345) % PRIME
        a = x % (PRIME - 1) + 1
        x = (x * 1103515245 + 12345) % PRIME
        out.append((a, x))
    return out


def bands_for(threshold: float, n: int) -> tuple[int, int]:
    """(bands, rows) within n permutations with the least sum of false-positive and false-negative areas."""
    s = (np.arange(1000) + 0.5) / 1000
    best = (np.inf, 1, n)
    for b in range(1, n + 1):
        for r in range(1, n // b + 1):
            p = 1 - (1 - s**r) ** b
            cost = (p[s < threshold].sum() + (1 - p[s >= threshold]).sum()) / 1000
            best = min(best, (cost, b, r))
    return best[1], best[2]


def _words_of(lists: pa.Array) -> Iterator[list[bytes]]:
    """The lists of strings, one after the other, as UTF-8."""
    values, lengths = lists.flatten().cast(pa.binary()), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    at = 0
    for n in lengths.tolist():
        yield values.slice(at, n).to_pylist()
        at += n


def _runs(words: list[bytes], n: int) -> set[bytes]:
    """Distinct runs of n words, joined by blanks."""
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n > 1 else set(words)


def least_of_permutations(hashes: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Minima of (scale h + shift) mod 2^31 - 1 over hashes below that, a permutation each.

    As 2^31 is 1 by that modulus, high and low bits are added up instead of dividing; their sum is below twice the modulus.
    """
    best = np.full(len(scale), PRIME, np.uint32)
    for at in range(0, len(hashes), 256):
        x = hashes[at : at + 256, None] * scale + shift
        y = ((x & PRIME) + (x >> 31)).astype(np.uint32)
        best = np.minimum(best, np.minimum(y, y - np.uint32(PRIME)).min(axis=0))
    return best.astype(np.int64)


def signatures(df: DataFrame, key: str, shingles: Column, num_perm: int = 128, keep_short: bool = False, keep: Sequence[str] = (), words: int = 1) -> DataFrame:
    """[X12 Q6] key, the fields to keep and minhash: a minimum a permutation over the document's shingles.

    Documents without any are dropped, or with keep_short have a null.  With words > 1 the lists hold words, and shingles are runs
    of so many.  Nothing is shuffled; a document at a time its runs are made and hashed, as hash32() does, and the permutations
    run over arrays of hashes in numpy, which takes a small part of the time that lambdas or as many aggregates need.
    """
    scale, shift = (np.array(x, np.int64) for x in zip(*permutations(num_perm), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray | None] = []
            for own in _words_of(batch.column(batch.num_columns - 1)):
                runs = _runs(own, words)
                first = b"".join([md5(x, usedforsecurity=False).digest()[:4] for x in runs])
                out.append(least_of_permutations(np.frombuffer(first, ">u4").astype(np.int64) % PRIME, scale, shift) if runs else None)
            made = pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names[:-1], "minhash"])
            yield made if keep_short else made.filter(pc.is_valid(made.column("minhash")))

    made = df.select(key, *keep, shingles.alias("_h"))
    return made.mapInArrow(run, T.StructType([*made.schema.fields[:-1], T.StructField("minhash", T.ArrayType(T.LongType()))]))


def shingle_summary(df: DataFrame, key: str, shingles: Column) -> DataFrame:
    """key, n, least: how many distinct shingles a document has, and the smallest MD5 of one; none, no row.

    A row is summed up where it lies: the shingles as rows would be sorted for the minimum of a text.
    """
    lists = df.select(key, shingles.alias("_s")).select(key, F.size("_s").cast("long").alias("n"), F.array_min(F.transform("_s", lambda x: F.md5(x.cast("binary")))).alias("least"))
    return lists.groupBy(key).agg(F.sum("n").alias("n"), F.min("least").alias("least")).where("n > 0")


def buckets(signed: DataFrame, key: str, bands: int, rows: int) -> DataFrame:
    """[J17] key, band, bucket."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.array_join(F.slice("minhash", i * rows + 1, rows), "-").alias("bucket")))
    return signed.select(key, F.explode(cut).alias("b")).select(key, "b.band", F.md5(F.col("b.bucket").cast("binary")).alias("bucket"))


def collisions(buckets_: DataFrame, key: str) -> DataFrame:
    """[J17] a < b: documents that share a bucket.  Every pair of a bucket is a row; survivors() does without them."""
    other = buckets_.select(F.col(key).alias("b"), "band", "bucket")
    return buckets_.withColumnRenamed(key, "a").join(other, ["band", "bucket"]).where("a < b").select("a", "b").distinct()


def survivors(buckets_: DataFrame, key: str, urls: DataFrame | None = None) -> DataFrame:
    """[A9 Q5] keys kept when documents come in the key's order and one goes if it shares a bucket (or url) with a kept one.

    This is the first maximal independent set in that order, found in rounds over buckets, without pairs: a document is
    kept if it is the smallest undecided one in all its buckets; the others of these buckets go.  urls(key, url) adds a
    bucket for each url.  Rounds are written to the checkpoint folder.
    """
    shared_folder(buckets_.sparkSession)
    rows = buckets_.select(F.col(key).alias("k"), F.xxhash64("band", "bucket").alias("g"))
    if urls is not None:
        rows = rows.union(urls.select(F.col(key).alias("k"), F.when(F.col(urls.columns[-1]).isNotNull(), F.xxhash64(F.lit("url"), F.col(urls.columns[-1]))).alias("g")).where("g is not null"))
    rows = rows.distinct().checkpoint()  # a few numbers a document, read again and again
    alone = rows.groupBy("g").agg(F.count("*").alias("n"))
    shared = rows.join(alone.where("n > 1").select("g"), "g", "left_semi").checkpoint()
    kept = rows.select("k").distinct().join(shared.select("k").distinct(), "k", "left_anti")
    parts = [kept]
    open_rows = shared
    while not open_rows.isEmpty():
        first = open_rows.groupBy("g").agg(F.min("k").alias("least"))
        state = open_rows.join(first, "g")
        chosen = state.groupBy("k").agg(F.min(F.when(F.col("k") == F.col("least"), 1).otherwise(0)).alias("all_least")).where("all_least = 1").select("k").checkpoint()
        parts.append(chosen)
        closed = open_rows.join(chosen, "k", "left_semi").select("g").distinct()
        gone = open_rows.join(closed, "g", "left_semi").select("k").distinct()
        open_rows = open_rows.join(gone, "k", "left_anti").checkpoint()
    return reduce(lambda a, b: a.union(b), parts).withColumnRenamed("k", key)
