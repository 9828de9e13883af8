"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams over letters (all else is a blank) are hashed to a fixed number of features.  Document frequencies
come from all training documents; the classifier is fitted in numpy on a bounded sample per language by
follow-the-regularised-leader with elastic-net penalties (McMahan et al., 2013), which leaves most weights zero, and its
temperature is then calibrated on sampled documents that took no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import pick, unit_hash
from .packing import added, pack, unpack

BITS = 16
ORDERS = (1, 2, 3)
PER_LANGUAGE = 800  # documents sampled for the fit
MAX_SAMPLE = 20_000  # over all languages
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 2e-4, 1e-4, 3
UNKNOWN = "und"
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def gram_counts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """The hashed n-grams of each text, in order, and their counts, or None where it has no letter."""
    letters = _letter_table()
    for lo, hi, data, offsets in kernel.chunks(column):
        base = int(offsets[0])
        part = data[base : int(offsets[-1])]
        codes = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[offsets - base]
        if at[-1] != len(codes):  # never for the well-formed UTF-8 that Spark holds
            raise ValueError("text is not UTF-8")
        is_letter = letters[codes]
        x = np.where(is_letter, codes, 32).astype(np.uint32)
        grams, run = [], np.zeros(len(x), np.uint32)
        for k in ORDERS:
            run = run[: max(0, len(x) - k + 1)] * np.uint32(0x9E3779B1) + x[k - 1 :]
            mixed = (run ^ (run >> np.uint32(15))) * np.uint32((0x85EBCA6B + 2 * k) & 0xFFFFFFFF)
            grams.append((mixed >> np.uint32(32 - BITS)).astype(np.int32))
        some = np.concatenate([[0], np.cumsum(is_letter)])
        for k in range(hi - lo):
            a, b = int(at[k]), int(at[k + 1])
            if some[b] == some[a]:
                yield None
            else:
                own = np.concatenate([g[a : max(a, b - n + 1)] for n, g in zip(ORDERS, grams, strict=True)])
                if len(own) > 1 << (BITS - 2):
                    dense = np.bincount(own)
                    seen = np.flatnonzero(dense)
                    yield seen, dense[seen]
                else:
                    yield np.unique(own, return_counts=True)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # n-grams x languages, divided by the temperature

    def predict(self, column: pa.Array) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for grams in gram_counts(column):
            if grams is None or not self.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            at, counts = grams
            x = counts * self.idf[at]
            z = x @ self.weights[at] / np.sqrt(x @ x)
            p = np.exp(z - z.max())
            best = int(p.argmax())
            names.append(self.languages[best])
            scores.append(float(p[best] / p.sum()))
        return names, scores


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for grams in gram_counts(batch.column(0)):
            if grams is not None:
                df[grams[0]] += 1
                n += 1
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([pack(np.append(df, n))], pa.binary())], names=["k", "df"])


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = []
        for grams in gram_counts(batch.column(0)):
            packed.append(pack(*grams) if grams is not None else None)
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(packed, pa.binary())], names=["lang", "u", "grams"])


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, n_classes: int, size: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (size x classes) by FTRL-proximal with elastic net; rows are (feature numbers, values of unit norm)."""
    z, n = np.zeros((size, n_classes)), np.zeros((size, n_classes))
    solve = lambda z, n: np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0)
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, value = rows[k]
            zk, nk = z[at], n[at]
            w = solve(zk, nk)
            score = value @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[classes[k]] -= 1
            g = value[:, None] * p
            new = nk + g * g
            z[at] = zk + g - (np.sqrt(new) - np.sqrt(nk)) / ALPHA * w
            n[at] = new
    return solve(z, n)


def best_temperature(scores: np.ndarray, classes: np.ndarray) -> float:
    """The temperature with the least mean log loss, from a fine geometric grid."""
    if not len(scores):
        return 1.0
    def loss(t: float) -> float:
        x = scores / t
        return float((np.logaddexp.reduce(x, axis=1) - x[np.arange(len(x)), classes]).mean())
    return min(np.geomspace(0.02, 5, 120), key=loss)


def train(documents: DataFrame, trains: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> LanguageModel:
    """Fits on the documents where trains holds and lang is not null; without any, the model says `und` always.

    Document frequencies count all of them.  The fit uses PER_LANGUAGE documents of each language at most, chosen by a hash of
    the id, and MAX_SAMPLE in all; with more languages than that, the commonest are learned.  Null and letterless texts
    teach nothing.
    """
    spark = documents.sparkSession
    base = documents.where(trains & documents[lang].isNotNull()).select(F.lower(documents[text]).alias("text"), documents[lang].cast("string").alias("lang"), documents[doc_id].alias("id"))
    base = base.where("text is not null")
    counts = {r["lang"]: r["n"] for r in base.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_SAMPLE).collect()}
    languages = sorted(counts)
    total = base.select("text").mapInArrow(_frequencies, "k int, df binary")
    total = added(total, "k int", "df").collect()
    if not total:
        return LanguageModel([], np.ones(1 << BITS), np.zeros((1 << BITS, 0)))
    df = unpack(total[0]["df"])[0]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    each = max(2, min(PER_LANGUAGE, MAX_SAMPLE // len(languages)))
    shares = spark.createDataFrame([(k, min(1.0, each / n)) for k, n in counts.items()], "lang string, share double")
    u = unit_hash(F.lit("sample"), F.col("id"))
    sample = base.join(F.broadcast(shares), "lang").where(u < F.col("share")).select("text", "lang", (unit_hash(F.lit("held"), F.col("id"))).alias("u"))
    number = {k: i for i, k in enumerate(languages)}
    rows, classes, held = [], [], []
    found = sample.mapInArrow(_sample_rows, "lang string, u double, grams binary").where("grams is not null")
    for r in found.orderBy("u", "grams").limit(2 * MAX_SAMPLE).toLocalIterator():  # in an order that any run repeats
        at, count = unpack(r["grams"])
        x = count * idf[at]
        rows.append((at, x / np.sqrt(x @ x)))
        classes.append(number[r["lang"]])
        held.append(r["u"] < 0.2)
    y, out = np.array(classes, int), np.array(held, bool)
    if out.all():
        out[:] = False
    weights = fit_ftrl([rows[k] for k in np.flatnonzero(~out)], y[~out], len(languages), 1 << BITS)
    scores = np.array([rows[k][1] @ weights[rows[k][0]] for k in np.flatnonzero(out)])
    return LanguageModel(languages, idf, weights / best_temperature(scores, y[out]))


def predict(documents: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (0 to 1); `und` with score 0 where the text is null or has no letter.

    Whole texts count; repeated rows get equal results, an empty table gives an empty one; where a name is taken, the added
    column gets an underscore.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    lang_pred, score, both = (pick(documents, x) for x in ("lang_pred", "score", "_both"))

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in columns:
            names, scores = shared.value.predict(pa.array(texts, pa.string(), from_pandas=True))
            yield pd.DataFrame({"a": names, "b": scores})

    made = documents.withColumn(both, F.pandas_udf(run, "a string, b double")(F.lower(documents[text])))
    return made.select(*documents.columns, F.col(f"{both}.a").alias(lang_pred), F.col(f"{both}.b").alias(score))
