"""Quality by an interpolated modified Kneser-Ney model of trusted text.

The model is over words: a word given the one before it, backing off to in how many pairs the word comes second, and from
there to a uniform distribution over the words of trusted text and one for all others.  Pairs of trusted text are counted by
batch and merged in shards, continuation counts are a join of the pairs with the words, and a document's pairs, counted by
batch, are joined with the sharded counts, from which the sums by document come back (see `pairs`).  A document is kept if
its perplexity does not exceed a quantile of its language's held-back trusted documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pairs as P
from .common import discard, pick, unit_hash, written

MAX_BROADCAST_IDS = 500_000
PRIOR_DOCUMENTS = 20  # a language's threshold is drawn towards that of all languages as by so many documents


def discounts(seen: dict[str, int]) -> np.ndarray:
    """0 and D1, D2, D3+ of Chen and Goodman from the numbers of counts 1 to 4, each taken as one more, so that none is 0."""
    n = [seen[f"n{k}"] + 1 for k in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *(np.clip(k - (k + 1) * y * n[k] / n[k - 1], 0.05, k - 0.05) for k in (1, 2, 3))])


def word_points(customers: np.ndarray, cut: np.ndarray, total: int, freed: float, distinct: int) -> np.ndarray:
    """log10 p of words from the numbers of pairs they come second in."""
    return np.log10((customers - cut[np.minimum(customers, 3)]) / total + freed / total / (distinct + 1))


def train(trusted: DataFrame, text: str = "text") -> P.PairModel | None:
    """Counts the words and pairs of all trusted documents with a text; None without one."""
    spark = trusted.sparkSession
    texts = P.texts_of(trusted.where(trusted[text].isNotNull()), text)
    if texts.isEmpty():
        return None
    shards, hot = P.shards_for(texts), P.hot_words(texts)
    shared = spark.sparkContext.broadcast(hot)
    words = P.count_words(texts, shards, False)
    stats, hot_counts = P.count_stats(words, "counts", 0), P.collect_hot(words, "counts", hot)
    pairs = P.count_pairs(texts, shards, lambda: shared.value, len(hot))
    counted = P.count_stats(pairs, "pairs", 3)
    taken = discounts(counted)
    notes = written(pairs.mapInArrow(P.first_notes(shards, lambda: shared.value, lambda n: taken[np.minimum(n, 3)]), P.NOTES), "notes")
    held = P.collect_restaurants(notes, len(hot))

    def continued(own: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        return own[["shard", "hashes", "counts"]].assign(customers=[P.pack(P.customers_of(own, sent, shared.value))])

    seconds = words.groupBy("shard").cogroup(notes.where(f"kind = {P.CUSTOMERS}").groupBy("shard"))
    seconds = written(seconds.applyInPandas(continued, "shard int, hashes binary, counts binary, customers binary"), "seconds")
    seen = P.count_stats(seconds, "customers", 0)
    cut = discounts(seen)
    freed = float(cut[1] * seen["n1"] + cut[2] * seen["n2"] + cut[3] * (seen["rows"] - seen["n1"] - seen["n2"]))

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [P.pack(word_points(P.unpack(x)[0], cut, seen["total"], freed, seen["rows"])) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.binary())], names=["shard", "hashes", "counts", "points"])

    model = written(seconds.mapInArrow(points, "shard int, hashes binary, counts binary, points binary"), "model")
    asked = written(notes.where(f"kind = {P.ASKED}"), "asked")
    discard(words, seconds, notes)
    left = np.where(hot_counts > 0, np.log10(np.maximum(held, 1e-300) / np.maximum(hot_counts, 1)), 0.0)
    unseen = float(np.log10(freed / seen["total"] / (seen["rows"] + 1)))
    made = P.PairModel(model, pairs, asked, taken, 0.0, shards, stats["total"], stats["rows"], unseen, hot, hot_counts, P.collect_hot(model, "points", hot, "<f8"), left, None, P.known_filter(pairs, shared, counted["rows"]))
    least = P.frequent_bucket(pairs, len(hot))
    return made.with_frequent(pairs.mapInArrow(P.frequent_rows(len(hot), least, taken), P.NOTES))


def perplexities(documents: DataFrame, model: P.PairModel | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of documents (all by default) and perplexity, per word, the text's end included; null for null texts
    and without a model."""
    keep = documents.columns if keep is None else keep
    name = pick(documents.select(*keep), "perplexity")
    if model is None:
        return documents.select(*keep).withColumn(name, F.lit(None).cast("double"))
    own = documents.select(*(documents[c].alias(f"_{k}") for k, c in enumerate(keep)), documents[text].isNull().alias("none"), documents[text].alias("text"))
    scored = P.score(own, model, "text")
    value = F.when(~F.col("none"), F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    return scored.select(*(F.col(f"_{k}").alias(c) for k, c in enumerate(keep)), value.alias(name))


def classify(documents: DataFrame, labels: DataFrame, quantile: float = 0.995, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of documents (all by default), perplexity, threshold and keep.

    Trusted are the documents labelled 1 (the largest of repeated labels; null ids are left out).  Four fifths of them, by a
    hash of the id, train the model; the rest give the thresholds: a language's is the quantile of its logarithmic
    perplexities, averaged with that of all languages, which counts as PRIOR_DOCUMENTS documents; so null languages and those
    without such documents have that of all.  Null texts are not kept; empty ones are their end and count like any other;
    texts of any length count whole; repeated rows get equal results.  With no trusted text all other texts are kept; an
    empty table gives an empty one.  Added names get underscores where they clash.
    """
    keep = documents.columns if keep is None else keep
    trusted = labels.where(labels[doc_id].isNotNull()).groupBy(labels[doc_id].alias("_trusted")).agg(F.max(label).alias("_y")).where("_y = 1").select("_trusted")
    trusted = written(trusted, "trusted")
    small = F.broadcast(trusted) if trusted.count() <= MAX_BROADCAST_IDS else trusted
    held = unit_hash(F.lit("held"), F.col("_trusted")) < 0.2
    own = documents.select(documents[doc_id].alias("_id"), documents[text].alias("_text")).join(small.where(~held), F.col("_id") == F.col("_trusted"), "left_semi")
    names = [pick(documents.select(*keep), c) for c in ("perplexity", "threshold", "keep")]
    carried = documents.select(*(documents[c].alias(f"_{k}") for k, c in enumerate(keep)), documents[doc_id].alias("_id"), documents[lang].cast("string").alias("_lang"), documents[text].isNotNull().alias("_some"), documents[text].alias("_text"))
    scored = written(perplexities(carried, train(own, "_text"), "_text", [c for c in carried.columns if c != "_text"]), "scored")
    marks = scored.where("perplexity is not null").join(small.where(held), F.col("_id") == F.col("_trusted"), "left_semi").select("_lang", F.ln("perplexity").alias("p"))
    level = F.percentile_approx("p", quantile, 10000)
    every = marks.agg(level).first()[0]
    by_lang = marks.where("_lang is not null").groupBy("_lang").agg(level.alias("t"), F.count("*").alias("n"))
    by_lang = written(by_lang.select(F.col("_lang").alias("_of"), ((F.col("t") * F.col("n") + F.lit(every).cast("double") * PRIOR_DOCUMENTS) / (F.col("n") + PRIOR_DOCUMENTS)).alias("_t")), "thresholds")
    made = scored.join(F.broadcast(by_lang) if by_lang.count() <= MAX_BROADCAST_IDS else by_lang, F.col("_lang") == F.col("_of"), "left")
    limit = F.coalesce(F.col("_t"), F.lit(every).cast("double"))
    kept = F.col("_some") & (F.col("perplexity").isNull() | limit.isNull() | (F.ln("perplexity") <= limit + 1e-9))  # but for rounding
    return made.select(*(F.col(f"_{k}").alias(c) for k, c in enumerate(keep)), F.col("perplexity").alias(names[0]), F.exp(limit).alias(names[1]), kept.alias(names[2]))
