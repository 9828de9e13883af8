"""Relevance feedback: search, statistics of what was found, new weights, search again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import search, stats
from ..session import saved, shared_folder


def feedback(postings: DataFrame, query: DataFrame, key: str, hits: int = 100, terms: int = 20, rounds: int = 1, least_ratio: float = 0.0) -> DataFrame:
    """key, score after the given rounds of feedback on postings(key, term, tf).

    Each round takes the best documents, weighs their terms by log TF ratio against the corpus, keeps the query's terms and
    the best new ones, and searches with these.
    """
    shared_folder(postings.sparkSession)
    postings = postings.checkpoint()  # read by every round
    base = postings.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
    asked = search.query_table(query)
    for _ in range(rounds):
        best = search.top(search.search_postings(postings, asked, key), key, hits).select(key)
        subset = postings.join(F.broadcast(best), key, "left_semi").groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
        weights = stats.log_tf_ratio(subset, base, threshold=least_ratio, print_dfs=True)
        chosen = stats.select_terms(weights, asked.select("term"))
        new = chosen.where("label = 'new'").orderBy(F.desc("weight"), "term").limit(terms)
        asked = chosen.where("label = 'query'").unionByName(new).select("term", "weight")
    return search.search_postings(postings, asked, key)


def feedback_tokens(df: DataFrame, query: DataFrame, key: str, tokens: Column, hits: int = 100, terms: int = 20, rounds: int = 1, least_ratio: float = 0.0) -> DataFrame:
    """The same on token lists, without the postings of the whole corpus: of these only the terms' sums are kept."""
    base = saved(stats.tf_df_of_tokens(df, tokens, "terms").select("term", "tf", "df"), "base")
    asked = search.query_table(query)
    for _ in range(rounds):
        best = search.top(search.search_tokens(df, asked, key, {"terms": tokens}), key, hits).select(key)
        best = saved(best, "best")
        subset = stats.term_counts(df.join(F.broadcast(best), key, "left_semi"), key, tokens).groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
        chosen = stats.select_terms(stats.log_tf_ratio(subset, base, threshold=least_ratio, print_dfs=True), asked.select("term"))
        new = chosen.where("label = 'new'").orderBy(F.desc("weight"), "term").limit(terms)
        asked = saved(chosen.where("label = 'query'").unionByName(new).select("term", "weight"), "asked")
    return search.search_tokens(df, asked, key, {"terms": tokens})
