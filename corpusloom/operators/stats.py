"""Corpus statistics on the long table (field, term, tf, df)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .basic import broadcast_if_small

TOKENS_AT_ONCE = 1 << 20  # a longer document is taken alone
ROWS_AT_ONCE = 1 << 16


def term_counts(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key, term, tf: a document's terms and how often it has them."""
    return df.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def tf_df(df: DataFrame, field_weights: Mapping[str, float], suffix: str = "_counts") -> DataFrame:
    """[A4 A5] weighted term and document frequencies of the count-map columns <field>_counts; absent maps are empty."""
    out: DataFrame | None = None
    for field, weight in field_weights.items():
        part = df.select(F.lit(field).alias("field"), F.explode(f"{field}{suffix}").alias("term", "n")).groupBy("field", "term").agg((F.sum("n") * float(weight)).alias("tf"), F.count("*").alias("df"))
        out = part if out is None else out.union(part)
    if out is None:
        raise ValueError("no field is given")
    return out


def _sums(values: pa.Array, doc: np.ndarray, fields: tuple[str | None, str | None]) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
    """field, terms, tf, df of the tokens (first field) and adjacent pairs (second) of some documents, numbered by doc."""
    coded = values.dictionary_encode()
    codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    n = len(words)
    if fields[0]:
        yield fields[0], words, np.bincount(codes, minlength=n), np.bincount(np.unique(doc * n + codes) % n, minlength=n)
    if fields[1]:
        inside = doc[1:] == doc[:-1]
        pairs, number, tf = np.unique((codes[:-1] * n + codes[1:])[inside], return_inverse=True, return_counts=True)
        m = max(len(pairs), 1)
        df = np.bincount(np.unique(doc[1:][inside] * m + number) % m, minlength=len(pairs))[: len(pairs)]
        yield fields[1], pc.binary_join_element_wise(words.take(pa.array(pairs // n)), words.take(pa.array(pairs % n)), " "), tf, df


def term_parts(df: DataFrame, tokens: Column, field: str | None, bigram_field: str | None = None) -> DataFrame:
    """field, term, tf, df to be added up: of the tokens, of their adjacent pairs "a b" or of both, summed over many documents
    before anything is shuffled.  A row is a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values, ends = lists.flatten(), np.cumsum(lengths)
            at = (ends - lengths) // TOKENS_AT_ONCE
            bounds = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(lengths)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                start, stop = (int(ends[a - 1]) if a else 0), (int(ends[b - 1]) if b else 0)
                if stop == start:
                    continue
                for name, terms, tf, dfs in _sums(values.slice(start, stop - start), np.repeat(np.arange(b - a), lengths[a:b]), (field, bigram_field)):
                    made = pa.RecordBatch.from_arrays([pa.array([name]).take(pa.array(np.zeros(len(terms), np.int32))), terms, pa.array(tf.astype(np.float64)), pa.array(dfs.astype(np.int64))], names=["field", "term", "tf", "df"])
                    for x in range(0, len(terms), ROWS_AT_ONCE):
                        yield made.slice(x, ROWS_AT_ONCE)

    return df.select(tokens.alias("t")).mapInArrow(run, "field string, term string, tf double, df bigint")


def tf_df_of_tokens(df: DataFrame, tokens: Column, field: str | None, weight: float = 1.0, bigram_field: str | None = None) -> DataFrame:
    """[A4] the same from token lists, of their bigrams under bigram_field; a row is a document."""
    parts = term_parts(df, tokens, field, bigram_field)
    return parts.groupBy("field", "term").agg((F.sum("tf") * float(weight)).alias("tf"), F.sum("df").alias("df"))


def merge(parts: Sequence[DataFrame], across_fields: bool = False, fields: Sequence[str] | None = None) -> DataFrame:
    """[A7] sums of several tables by field and term, or across fields (document frequencies are added up then, too)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if fields:
        out = out.where(F.col("field").isin(list(fields)))
    keys = ["term"] if across_fields else ["field", "term"]
    return out.groupBy(*keys).agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def filter_df(stats: DataFrame, least: Mapping[str, int]) -> DataFrame:
    """[L14] terms with at least the field's document frequency; fields not named stay whole."""
    bound = F.lit(0)
    for field, n in least.items():
        bound = F.when(F.col("field") == field, n).otherwise(bound)
    return stats.where(F.col("df") >= bound)


def cross_filter(stats: DataFrame, unigram_field: str, bigram_field: str) -> DataFrame:
    """[L15 J8] bigrams whose two words survive among the unigrams; what isn't two words goes (Q19)."""
    words = stats.where(F.col("field") == unigram_field).select(F.col("term").alias("w")).distinct()
    parts = F.split("term", " ")
    bigrams = stats.where(F.col("field") == bigram_field).where(F.size(parts) == 2).withColumn("w1", F.get(parts, F.lit(0))).withColumn("w2", F.get(parts, F.lit(1)))
    words = broadcast_if_small(words)
    for c in ("w1", "w2"):
        bigrams = bigrams.join(words, F.col(c) == F.col("w"), "left_semi")
    return stats.where(F.col("field") != bigram_field).unionByName(bigrams.select(*stats.columns))


def report(stages: Mapping[str, DataFrame]) -> DataFrame:
    """[L16] vocabulary and token counts by field after each named step."""
    out: DataFrame | None = None
    for step, stats in stages.items():
        part = stats.groupBy("field").agg(F.count("*").alias("vocabulary"), F.sum("tf").alias("tokens")).select(F.lit(step).alias("step"), "field", "vocabulary", "tokens")
        out = part if out is None else out.union(part)
    if out is None:
        raise ValueError("no step is given")
    return out


def idf(df: Column, documents: int | float | Column) -> Column:
    """[A13] max(ln((N - df + 0.5) / (df + 0.5)), 0)"""
    n = documents if isinstance(documents, Column) else F.lit(documents)
    return F.greatest(F.ln((n - df + 0.5) / (df + 0.5)), F.lit(0.0))


def idf_weights(stats: DataFrame, documents: int, words: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    """[A13 L19 L20 O3] term, weight by IDF, optionally of listed words and from a threshold up."""
    made = with_words(stats, words).select("term", idf(F.col("df"), documents).alias("weight"))
    return by_weight(made if threshold is None else made.where(F.col("weight") >= threshold))


def with_words(stats: DataFrame, words: DataFrame | None) -> DataFrame:
    """[L19] the listed words only; no or an empty list passes all."""
    if words is None or words.limit(1).isEmpty():
        return stats
    return stats.join(words.select(F.col(words.columns[0]).alias("term")).distinct(), "term", "left_semi")


def by_weight(weights: DataFrame) -> DataFrame:
    """[O3] by descending weight, then term."""
    return weights.orderBy(F.desc_nulls_last("weight"), "term")


def log_tf_ratio(subset: DataFrame, base: DataFrame, words: DataFrame | None = None, threshold: float | None = None, print_dfs: bool = False, symmetric: bool = False) -> DataFrame:
    """[A14 J4 J5 L19 L20] ln(tf / base tf) - ln(subset size / base size).

    The subset's size is that of the words looked at, the base's that of all its words (Q13) unless symmetric.  Words that
    the base lacks, or has zero times, are dropped.  print_dfs adds subset_df and base_df.
    """
    chosen = with_words(subset, words)
    size = chosen.agg(F.sum("tf").alias("size"))
    base_size = (with_words(base, words) if symmetric else base).agg(F.sum("tf").alias("base_size"))
    other = base.select("term", F.col("tf").alias("base_tf"), F.col("df").alias("base_df")).where("base_tf > 0")
    made = chosen.where("tf > 0").join(other, "term").crossJoin(F.broadcast(size)).crossJoin(F.broadcast(base_size))  # one row each
    made = made.withColumn("weight", F.ln(F.col("tf") / F.col("base_tf")) - F.ln(F.col("size") / F.col("base_size")))
    made = made if threshold is None else made.where(F.col("weight") >= threshold)
    made = made.select("term", "weight", F.col("df").alias("subset_df"), "base_df")
    return by_weight(made if print_dfs else made.select("term", "weight"))


def weight_query(query: DataFrame, weights: DataFrame, threshold: float | None = None) -> DataFrame:
    """[J6 O4 Q11 Q12] the query's words with their weights, heaviest first; missing and zero weights are dropped."""
    w = weights.select(F.col(weights.columns[0]).alias("term"), F.col(weights.columns[1]).alias("weight"))
    made = query.select(F.col(query.columns[0]).alias("term")).join(w, "term").where("weight <> 0")
    return by_weight(made if threshold is None else made.where(F.col("weight") >= threshold))


def sane_terms() -> Column:
    """[L18] every word of letters, dots and hyphens, no hyphen at either end, none of them NNP."""
    good = lambda w: F.rlike(w, F.lit(r"^[\p{L}.\-]+$")) & ~F.startswith(w, F.lit("-")) & ~F.endswith(w, F.lit("-")) & (w != "NNP")
    return F.forall(F.split("term", " "), good)


def select_terms(
    terms: DataFrame,
    query: DataFrame,
    which: str = "all",
    min_ur: float | None = None, max_ur: float | None = None, min_br: float | None = None, max_br: float | None = None,
    min_udf: float | None = None, max_udf: float | None = None, min_bdf: float | None = None, max_bdf: float | None = None,
    min_uedf: float | None = None, max_uedf: float | None = None, min_bedf: float | None = None, max_bedf: float | None = None,
    min_udfr: float | None = None, max_udfr: float | None = None, min_bdfr: float | None = None, max_bdfr: float | None = None,
    sane: bool = True,
) -> DataFrame:
    """[L17 L18 J7 U7] term, weight, subset_df, base_df, label of the terms within inclusive bounds.

    u bounds hold for single words, b bounds for terms with a blank: on the log ratio (r), base document frequency (df),
    subset's (edf) and their quotient (dfr).  label is "query" for terms of the query, "new" for others, "missing" for the
    query's terms that are absent or filtered out (without numbers).  which selects "new", "query", "missing" or "all"
    (the first two).  sane drops terms that don't look like words.
    """
    two = F.instr("term", " ") > 0
    quotient = F.try_divide(F.col("base_df").cast("double"), F.col("subset_df"))
    kept = sane_terms() if sane else F.lit(True)
    for value, u_lo, u_hi, b_lo, b_hi in (("weight", min_ur, max_ur, min_br, max_br), ("base_df", min_udf, max_udf, min_bdf, max_bdf), ("subset_df", min_uedf, max_uedf, min_bedf, max_bedf), (quotient, min_udfr, max_udfr, min_bdfr, max_bdfr)):
        v = F.col(value) if isinstance(value, str) else value
        for single, pair, above in ((u_lo, b_lo, True), (u_hi, b_hi, False)):
            bound = F.when(two, F.lit(pair).cast("double")).otherwise(F.lit(single).cast("double"))
            kept = kept & (bound.isNull() | F.coalesce(v >= bound if above else v <= bound, F.lit(False)))
    asked = query.select(F.col(query.columns[0]).alias("term"), F.lit(True).alias("asked")).distinct()
    made = terms.where(kept).join(asked, "term", "full_outer")
    label = F.when(F.col("asked").isNull(), "new").when(F.col("weight").isNotNull(), "query").otherwise("missing")
    made = made.select("term", "weight", "subset_df", "base_df", label.alias("label"))
    return made.where(F.col("label").isin("new", "query") if which == "all" else F.col("label") == which)


def sort_terms(terms: DataFrame, pattern: str = "rdw") -> DataFrame:
    """[O5 Q17] by any arrangement of r (ratio, falling), d (base document frequency, falling) and w (term)."""
    if not pattern or set(pattern) - set("rdw") or len(set(pattern)) != len(pattern):
        raise ValueError(f"not an arrangement of r, d and w: {pattern!r}")
    by = {"r": F.coalesce("weight", F.lit(0.0)).desc(), "d": F.coalesce("base_df", F.lit(0)).desc(), "w": F.col("term").asc()}
    return terms.orderBy(*[by[c] for c in pattern])


def average_length(df: DataFrame, counts_map: Column) -> DataFrame:
    """[A20] mean number of counted tokens a document."""
    from ..functions.text import total

    return df.agg(F.avg(total(counts_map)).alias("avgdl"))
