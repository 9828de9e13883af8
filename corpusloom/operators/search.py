"""Weighted TF and BM25 search."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from .basic import broadcast_if_small

LEAST_SCORE = 2.2250738585072014e-308  # the smallest normal double: in effect, scores must exceed 0


def query_table(query: DataFrame) -> DataFrame:
    """[S11] term, weight: a missing weight column or value is 1; of repeated words the heaviest counts."""
    columns = query.columns
    weight = F.coalesce(F.col(columns[1]).cast("double"), F.lit(1.0)) if len(columns) > 1 else F.lit(1.0)
    return query.select(F.col(columns[0]).alias("term"), weight.alias("weight")).groupBy("term").agg(F.max("weight").alias("weight"))


def term_score(scorer: str, tf: Column, weight: Column, length: Column, k1: float = 1.2, b: float = 0.75, avgdl: float | Column = 1.0) -> Column:
    """[X9 X10 Q20] a term's share of a document's score; divisions by zero give 0."""
    if scorer == "tf":
        return tf * weight
    if scorer == "okapi":
        average = avgdl if isinstance(avgdl, Column) else F.lit(float(avgdl))
        below = tf + k1 * (1 - b + b * F.try_divide(length, average))
        return F.coalesce(F.try_divide((k1 + 1) * tf, below) * weight, F.lit(0.0))
    raise ValueError(f"no such scorer: {scorer!r}")


def search_postings(postings: DataFrame, query: DataFrame, key: str, scorer: str = "okapi", k1: float = 1.2, b: float = 0.75, avgdl: float | Column | None = None, field_weights: Mapping[str, float] | None = None, min_score: float = LEAST_SCORE, lengths: DataFrame | None = None) -> DataFrame:
    """[J3 X9-X11 L13] key, score of the documents in postings(key, [field,] term, tf) that reach min_score.

    Lengths are sums of a document's tf in the field, unless given for postings that are not whole; avgdl, if not given, is
    their mean over documents and fields.
    """
    by = [key, "field"] if "field" in postings.columns else [key]
    if lengths is None:
        lengths = postings.groupBy(*by).agg(F.sum("tf").cast("double").alias("length"))
    matched = postings.join(broadcast_if_small(query_table(query)), "term")
    if scorer == "okapi":
        matched = matched.join(lengths, by)
        if avgdl is None:
            matched = matched.crossJoin(F.broadcast(lengths.agg(F.avg("length").alias("avgdl"))))  # one row
            avgdl = F.col("avgdl")
    else:
        matched = matched.withColumn("length", F.lit(0.0))
    score = term_score(scorer, F.col("tf").cast("double"), F.col("weight"), F.col("length"), k1, b, 1.0 if avgdl is None else avgdl)
    if field_weights is not None and "field" in postings.columns:
        share = F.create_map(*[F.lit(x) for f, w in field_weights.items() for x in (f, float(w))])[F.col("field")]
        score = score * F.coalesce(share, F.lit(0.0))
    return matched.groupBy(key).agg(F.sum(score).alias("score")).where(F.col("score") >= min_score)


def search_tokens(df: DataFrame, query: DataFrame, key: str, fields: Mapping[str, Column], counts: Mapping[str, Column] | None = None, **how) -> DataFrame:
    """[J3 X9-X11 L13] search_postings() on token lists by field: only the query's terms are shuffled, and a number a document.

    counts has the lengths of lists that take longer to make than to count.  how: what search_postings() takes.
    """
    asked = broadcast_if_small(query_table(query))
    found, sizes = None, None
    for field, tokens in fields.items():
        terms = df.select(key, F.lit(field).alias("field"), F.explode(tokens).alias("term")).join(asked.select("term"), "term", "left_semi")
        size = df.select(key, F.lit(field).alias("field"), (counts or {}).get(field, F.size(tokens)).alias("n")).where("n > 0")
        found, sizes = (terms, size) if found is None else (found.unionByName(terms), sizes.unionByName(size))
    postings = found.groupBy(key, "field", "term").agg(F.count("*").alias("tf"))
    lengths = sizes.groupBy(key, "field").agg(F.sum("n").cast("double").alias("length"))
    return search_postings(postings, query, key, lengths=lengths, **how)


def search_maps(df: DataFrame, query: Mapping[str, float], field_weights: Mapping[str, float], scorer: str = "okapi", k1: float = 1.2, b: float = 0.75, avgdl: float = 1.0, min_score: float = LEAST_SCORE) -> DataFrame:
    """[X11] score column on documents with count maps, for small queries: one look-up a word, no shuffle."""
    if not query:
        raise ValueError("the query is empty")
    whole = F.lit(0.0)
    for field, weight in field_weights.items():

        def share(found: Column) -> Column:
            own = F.lit(0.0)
            for k, w in enumerate(query.values()):
                own = own + F.coalesce(term_score(scorer, found["tf"][k], F.lit(float(w)), found["length"], k1, b, avgdl), F.lit(0.0))
            return own

        def looked_up(counts: Column) -> Column:
            length = F.aggregate(F.map_values(counts), F.lit(0.0), lambda s, x: s + x)
            return F.struct(length.alias("length"), F.array(*[F.try_element_at(counts, F.lit(t)).cast("double") for t in query]).alias("tf"))

        # bound, so that neither the map nor the length is computed once a term where the optimizer merges projections
        whole = whole + F.coalesce(bind(bind(F.col(field), looked_up), share), F.lit(0.0)) * float(weight)
    return df.withColumn("score", whole).where(F.col("score") >= min_score)


def top(hits: DataFrame, key: str, k: int) -> DataFrame:
    """[O2] the k best, ties by key."""
    return hits.orderBy(F.desc("score"), key).limit(k)
