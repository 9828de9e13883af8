"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents are labelled; everything else is unlabelled and holds toxic texts, too, in the share of the
class prior.  Features are hashed words and word beginnings.  Their document counts, over all training documents, keep those
far commoner in the confirmed documents; on these a logistic model is fitted in numpy by the non-negative risk estimator

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

(Kiryo et al., 2017): where the corrected risk of the unlabelled turns negative, the step goes the other way.  A fifth of the
confirmed and of the unlabelled documents takes no part in this; on them scale and offset of the scores are set by the same
risk.  The unlabelled documents of the risk are those that have a label, whatever it is, with the label hidden: so the prior,
the share of toxic ones among them, is theirs.  Documents labelled clean count nowhere else.
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

BITS = 20
STEMS = (4, 5, 6)  # bytes of a word's beginning
MAX_CONFIRMED = 20_000  # confirmed documents that are used for fitting
MAX_UNLABELLED = 20_000  # unlabelled documents of the risk; feature counts cover all
LEAST_RATIO, LEAST_DOCUMENTS, LEAST_ERRORS = 4.0, 3, 3.5  # of a feature: share ratio, confirmed documents, standard errors
_BLOCK = 1 << 16


def document_features(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct feature numbers of each text: words without ASCII punctuation, and their beginnings."""
    shift = np.uint64(64 - BITS)
    for lo, hi, data, offsets in kernel.chunks(column):
        words = kernel.scan(data, offsets, letters_only=True)
        every = [words.hashes]
        for k, size in enumerate(STEMS):
            every.append(words.part(words.starts, np.minimum(words.starts + size, words.ends)) * np.uint64(2 * k + 3))
        cells = np.stack([x >> shift for x in every]).astype(np.int64)
        for k in range(hi - lo):
            yield np.unique(cells[:, words.bounds[k] : words.bounds[k + 1]])


@dataclass
class ToxicityModel:
    features: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        table = np.zeros(1 << BITS)
        table[self.features] = self.weights
        z = np.array([table[x].sum() for x in document_features(column)]) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, totals = np.zeros((2, 1 << BITS), np.int64), [0, 0]
    for batch in batches:
        sides = batch.column(1).to_numpy(zero_copy_only=False)
        for side, cells in zip(sides, document_features(batch.column(0)), strict=True):
            counts[side][cells] += 1
            totals[side] += 1
    rows = []
    for side in (0, 1):
        if totals[side]:
            rows.append((side, -1, pack(np.array([totals[side]]))))
            rows += [(side, b, pack(part)) for b in range((1 << BITS) // _BLOCK) if (part := counts[side][b * _BLOCK : (b + 1) * _BLOCK]).any()]
    if rows:
        side, block, packed = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(side, pa.int32()), pa.array(block, pa.int32()), pa.array(packed, pa.binary())], names=["side", "block", "counts"])


def _rows_of(features: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros(1 << BITS, bool)
        kept[features] = True
        for batch in batches:
            packed = [x[kept[x]].astype("<i4").tobytes() for x in document_features(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(packed, pa.binary())], names=["side", "u", "features"])

    return run


def fit_nnpu(confirmed: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights (>= 0: features are chosen as signs of toxicity) and bias of the logistic model, by Adam on the whole sets."""
    sides = [confirmed, unlabelled]
    owner = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in sides]
    cell = [np.concatenate([*s, np.zeros(0, np.int64)]).astype(np.int64) for s in sides]
    weights, bias = np.full(size + 1, 1.0), -3.0
    weights[size] = bias
    moment, square = np.zeros(size + 1), np.zeros(size + 1)

    def grad(side: int, slope: np.ndarray) -> np.ndarray:
        out = np.bincount(cell[side], weights=slope[owner[side]], minlength=size + 1)[: size + 1]
        out[size] = slope.sum()
        return out / max(1, len(sides[side]))

    for step in range(1, rounds + 1):
        z = [np.bincount(owner[s], weights=weights[cell[s]], minlength=len(sides[s])) + weights[size] for s in (0, 1)]
        p, u = (1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in z)
        risk = np.logaddexp(0, z[1]).mean() - prior * np.logaddexp(0, z[0]).mean()
        negative = grad(1, u) - prior * grad(0, p)
        g = -negative if risk < 0 else prior * grad(0, p - 1) + negative
        g[:size] += decay * weights[:size]
        moment, square = 0.9 * moment + 0.1 * g, 0.999 * square + 0.001 * g * g
        weights -= rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weights[:size] = np.maximum(weights[:size], 0)
    return weights[:size], float(weights[size])


def risk(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the non-negative risk with logistic loss: prior * R_p(+), and R_u(-) - prior * R_p(-)."""
    return prior * float(np.logaddexp(0, -z_p).mean()), float(np.logaddexp(0, z_u).mean()) - prior * float(np.logaddexp(0, z_p).mean())


def calibrate(z_p: np.ndarray, z_u: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.02) -> tuple[float, float]:
    """Scale (> 0) and offset of scores, by the same risk on confirmed and unlabelled scores that took no part in the fit."""
    value, moment, square = np.array([1.0, 0.0]), np.zeros(2), np.zeros(2)
    slope = lambda z, p: np.array([(z * p).mean(), p.mean()])
    for step in range(1, rounds + 1):
        p, u = (1 / (1 + np.exp(-np.clip(value[0] * z + value[1], -30, 30))) for z in (z_p, z_u))
        negative = slope(z_u, u) - prior * slope(z_p, p)
        g = prior * slope(z_p, p - 1) + negative
        if risk(value[0] * z_p + value[1], value[0] * z_u + value[1], prior)[1] < 0:
            g = -negative
        g += 1e-3 * (value - [1, 0])
        moment, square = 0.9 * moment + 0.1 * g, 0.999 * square + 0.001 * g * g
        value = value - rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        value[0] = max(value[0], 0.05)
    return float(value[0]), float(value[1])


def train(documents: DataFrame, labels: DataFrame, trains: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", prior: float | None = None) -> ToxicityModel | None:
    """Fits on the documents where trains holds; None without a confirmed toxic document.

    The prior, if not given, is the toxic share of the labelled training rows.  Of repeated labels the largest counts; null
    labels and ids are left out.  At most about MAX_CONFIRMED confirmed documents (a hash sample beyond) mark the positive
    side, and about MAX_UNLABELLED of those with any label are the unlabelled ones of the risk, both lists small enough to
    broadcast; features are counted in the confirmed documents against all other training documents.  Features are all that are signs of toxicity by their counts over all documents.
    """
    marks = labels.where(labels[label].isNotNull() & labels[doc_id].isNotNull()).groupBy(labels[doc_id].alias("_id")).agg(F.max(label).alias("_y"))
    marks = marks.withColumnRenamed("_id", doc_id).where(trains).withColumnRenamed(doc_id, "_id")
    total = marks.agg(F.count("*").alias("n"), F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).alias("p")).first()
    if not total["p"]:
        return None
    prior = min(0.9, total["p"] / total["n"]) if prior is None else prior
    marks = marks.withColumn("_u", unit_hash(F.col("_id")))
    first = lambda rows, most, count: rows.where(F.col("_u") < most / count).orderBy("_u", "_id").limit(2 * most).select("_id")
    confirmed = first(marks.where("_y = 1"), MAX_CONFIRMED, total["p"]).withColumn("_p", F.lit(True))
    chosen = confirmed.join(first(marks, MAX_UNLABELLED, total["n"]).withColumn("_s", F.lit(True)), "_id", "full_outer")
    side = F.when(F.col("_p"), 1).otherwise(0).alias("side")
    base = documents.select(doc_id, F.lower(documents[text]).alias("_text")).where(trains)
    marked = base.join(F.broadcast(chosen), base[doc_id] == chosen["_id"], "left").select("_text", side, F.coalesce("_s", F.lit(False)).alias("s"), unit_hash(base[doc_id]).alias("u"))

    counts, totals = np.zeros((2, 1 << BITS), np.int64), [0, 0]
    for r in added(marked.select("_text", "side").mapInArrow(_count, "side int, block int, counts binary"), "side int, block int", "counts").toLocalIterator():
        values = unpack(r["counts"])[0]
        if r["block"] < 0:
            totals[r["side"]] = int(values[0])
        else:
            counts[r["side"]][r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = values
    if not totals[1]:
        return None
    features = np.concatenate([_signs(counts[:, at : at + _BLOCK], totals, prior) + at for at in range(0, 1 << BITS, _BLOCK)])
    del counts
    kinds = (F.col("side") + F.when(F.col("s"), 2).otherwise(0)).alias("side")
    sample = marked.where("side = 1 or s").select("_text", kinds, "u").mapInArrow(_rows_of(features), "side int, u double, features binary")
    sets: list[list[np.ndarray]] = [[], [], [], []]  # unlabelled, confirmed; the same for calibration
    for r in sample.orderBy("u", "side", "features").limit(2 * (MAX_CONFIRMED + MAX_UNLABELLED)).toLocalIterator():  # in an order that any run repeats
        held = 2 * (int(r["u"] * (1 << 40)) % 5 == 0)
        own = np.searchsorted(features, np.frombuffer(r["features"], "<i4")).astype(np.int32)
        if r["side"] & 1:
            sets[1 + held].append(own)
        if r["side"] & 2:
            sets[held].append(own)
    if not sets[1]:
        sets[:2], sets[2:] = sets[2:], [[], []]
    weights, bias = fit_nnpu(sets[1], sets[0], len(features), prior)
    z_u, z_p = (np.array([weights[x].sum() for x in own]) + bias for own in sets[2:])
    scale, offset = calibrate(z_p, z_u, prior) if len(z_p) and len(z_u) else (1.0, 0.0)
    return ToxicityModel(features, weights * scale, bias * scale + offset)


def _signs(counts: np.ndarray, totals: list[int], prior: float) -> np.ndarray:
    """Features that confirmed documents have far oftener than others."""
    shares = [(counts[s] + 0.5) / (totals[s] + 1) for s in (0, 1)]
    ratio = np.log(shares[1] / shares[0])
    errors = np.sqrt(1 / (counts[1] + 0.5) + 1 / (counts[0] + 0.5))
    return np.flatnonzero((counts[1] >= LEAST_DOCUMENTS) & (ratio >= LEAST_ERRORS * errors) & (ratio >= np.log(min(LEAST_RATIO, 0.5 / prior))))


def score(documents: DataFrame, model: ToxicityModel | None, text: str = "text") -> DataFrame:
    """Adds toxicity, 0 to 1, from the text alone; 0 without a model.  Null, empty and wordless texts get the bias's score.

    Texts count whole, whatever their length; repeated rows get equal scores, an empty table gives an empty one; a column of
    that name stays, and the added one is called _toxicity.
    """
    name = pick(documents, "toxicity")
    if model is None:
        return documents.withColumn(name, F.lit(0.0))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in columns:
            yield pd.Series(shared.value.scores(pa.array(texts, pa.string(), from_pandas=True)))

    return documents.withColumn(name, F.pandas_udf(run, "double")(F.lower(documents[text])))
