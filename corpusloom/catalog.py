"""Registered queries: each operator on the driver's tables, with the same in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions import vector as V
from .operators import annotate, basic, dedup, filters, lexicon, search, stats, vectors
from .plans import feedback, spec
from .session import saved, ship
from .sources import webarchive, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

STOP = ("the", "of", "and", "to", "a", "in", "it", "is", "that", "on", "or", "an")
LISTED = ", ".join(f"'{w}'" for w in STOP)
PERMUTATIONS = 128
BANDS, ROWS = dedup.bands_for(0.85, PERMUTATIONS)


def query(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", "text", "lang", "source", X.tokens(F.col("text")).alias("lemmas"))


def lemmas() -> dict[str, Column]:
    return {"lemmas": X.tokens(F.col("text"))}


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items' words, each with weight 1."""
    return table(spark, sf_dir, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("term")).distinct()


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items' words, weighted by how many items have them."""
    return table(spark, sf_dir, "benchmark").select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("weight"))


def good_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


TOK = r"tok AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents)"
POST = TOK + ", post AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL)"
BI = "bi AS (SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM tok), bipost AS (SELECT doc_id, term, count(*) AS tf FROM bi GROUP BY ALL)"
ASK = r"ask AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark)"
LEN = "len AS (SELECT doc_id, sum(tf)::DOUBLE AS dl FROM post GROUP BY doc_id), avg AS (SELECT avg(dl) AS avgdl FROM len)"
BM25 = "2.2 * p.tf / (p.tf + 1.2 * (0.25 + 0.75 * l.dl / a.avgdl))"
STAT = "st AS MATERIALIZED (SELECT 'lemmas' AS field, term, sum(tf)::DOUBLE AS tf, count(*) AS df FROM post GROUP BY term)"
STAT2 = STAT + ", st2 AS (SELECT * FROM st UNION ALL SELECT 'lemmas_bigrams', term, sum(tf)::DOUBLE, count(*) FROM bipost GROUP BY term)"
SUB = "sub AS MATERIALIZED (SELECT term, sum(tf)::DOUBLE AS tf, count(*) AS df FROM post WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY term)"
RATIO = "small AS MATERIALIZED (SELECT sum(tf) AS size FROM sub), large AS MATERIALIZED (SELECT sum(tf) AS size FROM st), r AS MATERIALIZED (SELECT s.term, ln(s.tf / b.tf) - ln(small.size / large.size) AS weight, s.df AS subset_df, b.df AS base_df FROM sub s JOIN st b USING (term), small, large)"


# --- search -------------------------------------------------------------------------------------------------------------


@query("bm25_search", f"WITH {POST}, {LEN}, {ASK} SELECT doc_id, round(sum({BM25}), 6) AS score FROM post p JOIN ask USING (term) JOIN len l USING (doc_id), avg a GROUP BY doc_id ORDER BY sum({BM25}) DESC, doc_id LIMIT 100")
def bm25_search(s: SparkSession, d: str) -> DataFrame:
    """The 100 best."""
    hits = search.search_tokens(docs(s, d), asked(s, d), "doc_id", lemmas())
    return search.top(hits, "doc_id", 100).select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_search_all", f"WITH {POST}, {LEN}, {ASK} SELECT doc_id, round(sum({BM25}), 6) AS score FROM post p JOIN ask USING (term) JOIN len l USING (doc_id), avg a GROUP BY doc_id")
def bm25_search_all(s: SparkSession, d: str) -> DataFrame:
    """Every scored document."""
    return search.search_tokens(docs(s, d), asked(s, d), "doc_id", lemmas()).select("doc_id", F.round("score", 6).alias("score"))


_TWO = f"WITH {POST}, {BI}, {ASK}, ask2 AS (SELECT term, 1.0 AS w FROM ask UNION ALL SELECT DISTINCT x, 1.0 FROM (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS x FROM (SELECT regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM benchmark))), both_ AS (SELECT doc_id, 'lemmas' AS field, term, tf FROM post UNION ALL SELECT doc_id, 'lemmas_bigrams', term, tf FROM bipost), ln2 AS (SELECT doc_id, field, sum(tf)::DOUBLE AS dl FROM both_ GROUP BY ALL) SELECT doc_id, round(sum(2.2 * p.tf / (p.tf + 1.2 * (0.25 + 0.75 * l.dl / 400.0)) * CASE WHEN p.field = 'lemmas' THEN 1.0 ELSE 2.0 END), 6) AS score FROM both_ p JOIN ask2 USING (term) JOIN ln2 l USING (doc_id, field) GROUP BY doc_id"


@query("bm25_search_two_fields", _TWO)
def bm25_search_two_fields(s: SparkSession, d: str) -> DataFrame:
    """X11: field weights, one average length for both fields."""
    pairs = table(s, d, "benchmark").select(F.explode(X.bigrams(X.tokens(F.col("text")))).alias("term"))
    fields = lemmas() | {"lemmas_bigrams": X.bigrams(X.tokens(F.col("text")))}
    hits = search.search_tokens(docs(s, d), asked(s, d).union(pairs), "doc_id", fields, {"lemmas_bigrams": F.size(X.tokens(F.col("text"))) - 1}, avgdl=400.0, field_weights={"lemmas": 1.0, "lemmas_bigrams": 2.0})
    return hits.select("doc_id", F.round("score", 6).alias("score"))


@query("tf_search", f"WITH {POST}, {ASK} SELECT doc_id, sum(tf)::DOUBLE AS score FROM post JOIN ask USING (term) GROUP BY doc_id")
def tf_search(s: SparkSession, d: str) -> DataFrame:
    """X10."""
    return search.search_tokens(docs(s, d), asked(s, d), "doc_id", lemmas(), scorer="tf")


@query("search_min_score", f"WITH {POST}, {ASK} SELECT doc_id, sum(tf)::DOUBLE AS score FROM post JOIN ask USING (term) GROUP BY doc_id HAVING sum(tf) >= 50")
def search_min_score(s: SparkSession, d: str) -> DataFrame:
    """L13."""
    return search.search_tokens(docs(s, d), asked(s, d), "doc_id", lemmas(), scorer="tf", min_score=50)


@query("search_weighted_query", rf"WITH {POST}, {LEN}, q AS (SELECT term, count(*)::DOUBLE AS w FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'))) AS term FROM benchmark) GROUP BY term) SELECT doc_id, round(sum({BM25} * q.w), 6) AS score FROM post p JOIN q USING (term) JOIN len l USING (doc_id), avg a GROUP BY doc_id")
def search_weighted_query(s: SparkSession, d: str) -> DataFrame:
    """S11 X9 with weights."""
    return search.search_tokens(docs(s, d), weighted(s, d), "doc_id", lemmas()).select("doc_id", F.round("score", 6).alias("score"))


_WORDS = {"the": 1.0, "is": 0.5, "mente": 2.0, "der": 1.5, "tion": 1.0}
_MAPQ = ", ".join(f"('{k}', {v})" for k, v in _WORDS.items())


@query("search_maps", f"WITH {POST}, len AS (SELECT doc_id, sum(tf)::DOUBLE AS dl FROM post GROUP BY doc_id), q(term, w) AS (VALUES {_MAPQ}) SELECT doc_id, round(sum(2.2 * p.tf / (p.tf + 1.2 * (0.25 + 0.75 * l.dl / 400.0)) * q.w), 6) AS score FROM post p JOIN q USING (term) JOIN len l USING (doc_id) GROUP BY doc_id")
def search_maps(s: SparkSession, d: str) -> DataFrame:
    """X11 on count maps, without a shuffle."""
    made = tokenized(s, d).select("doc_id", X.counts(F.col("lemmas")).alias("c"))
    return search.search_maps(made, _WORDS, {"c": 1.0}, avgdl=400.0).select("doc_id", F.round("score", 6).alias("score"))


@query("spec_search", f"WITH {POST}, len AS (SELECT doc_id, sum(tf)::DOUBLE AS dl FROM post GROUP BY doc_id), q(term, w) AS (VALUES {_MAPQ}) SELECT doc_id, round(sum(2.2 * p.tf / (p.tf + 1.2 * (0.25 + 0.75 * l.dl / 400.0)) * q.w), 6) AS score FROM post p JOIN q USING (term) JOIN len l USING (doc_id) GROUP BY doc_id ORDER BY 2 DESC, 1 LIMIT 50")
def spec_search(s: SparkSession, d: str) -> DataFrame:
    """The same from a specification, with a reducer."""
    config = {"pipeline": [{"step": "tokens", "field": "text"}, {"step": "counts", "fields": ["lemmas"]}, {"step": "search", "query": _WORDS, "field_weights": {"lemmas_counts": 1.0}, "avgdl": 400.0}, {"step": "filter_empty", "fields": ["score"]}, {"step": "new_field", "expression": "round(score, 6)", "name": "score"}, {"step": "retain_fields", "fields": ["doc_id", "score"]}], "reducer": {"step": "sort", "fields": [["score", True]], "num_records": 50, "tie": ["doc_id"]}}
    return spec.run(s, config, docs(s, d))


_BEST = f"best AS (SELECT doc_id FROM post p JOIN ask USING (term) JOIN len l USING (doc_id), avg a GROUP BY doc_id ORDER BY sum({BM25}) DESC, doc_id LIMIT 100), sub AS MATERIALIZED (SELECT term, sum(tf)::DOUBLE AS tf, count(*) AS df FROM post WHERE doc_id IN (FROM best) GROUP BY term)"
_AGAIN = r"k AS (SELECT term, weight FROM r WHERE weight >= 0 AND regexp_full_match(term, '[\p{L}.\-]+') AND NOT starts_with(term, '-') AND NOT ends_with(term, '-') AND term <> 'NNP'), asked AS MATERIALIZED (SELECT k.term, k.weight FROM k JOIN ask USING (term) UNION ALL (SELECT term, weight FROM k WHERE term NOT IN (FROM ask) ORDER BY weight DESC, term LIMIT 20))"


@query("feedback_search", f"WITH {POST}, {LEN}, {ASK}, {STAT}, {_BEST}, {RATIO}, {_AGAIN} SELECT doc_id, round(sum({BM25} * q.weight), 6) AS score FROM post p JOIN asked q USING (term) JOIN len l USING (doc_id), avg a GROUP BY doc_id HAVING sum({BM25} * q.weight) > 0")
def feedback_search(s: SparkSession, d: str) -> DataFrame:
    """SURVEY 3.3: one round of relevance feedback."""
    return feedback.feedback_tokens(docs(s, d), asked(s, d), "doc_id", X.tokens(F.col("text"))).select("doc_id", F.round("score", 6).alias("score"))


@query("avgdl", f"WITH {POST}, {LEN} SELECT round(avgdl, 6) AS avgdl FROM avg")
def avgdl(s: SparkSession, d: str) -> DataFrame:
    """A20."""
    made = tokenized(s, d).where(F.size("lemmas") > 0)
    return stats.average_length(made, X.counts(F.col("lemmas"))).select(F.round("avgdl", 6).alias("avgdl"))


# --- statistics ---------------------------------------------------------------------------------------------------------


def base_stats(s: SparkSession, d: str) -> DataFrame:
    return stats.tf_df_of_tokens(docs(s, d), X.tokens(F.col("text")), "lemmas")


def both_stats(s: SparkSession, d: str) -> DataFrame:
    return stats.tf_df_of_tokens(docs(s, d), X.tokens(F.col("text")), "lemmas", bigram_field="lemmas_bigrams")


def subset_stats(s: SparkSession, d: str) -> DataFrame:
    return stats.tf_df_of_tokens(basic.in_set(docs(s, d), "doc_id", good_ids(s, d)), X.tokens(F.col("text")), "lemmas")


@query("tf_df", f"WITH {POST}, {STAT} SELECT * FROM st")
def tf_df(s: SparkSession, d: str) -> DataFrame:
    """A4 A5."""
    return base_stats(s, d)


@query("tf_df_weighted", f"WITH {POST}, {STAT} SELECT 'lemmas' AS field, term, tf * 2 AS tf, df FROM st")
def tf_df_weighted(s: SparkSession, d: str) -> DataFrame:
    """A4 with a field weight, from count maps."""
    made = tokenized(s, d).select(X.counts(F.col("lemmas")).alias("lemmas_counts"))
    return stats.tf_df(made, {"lemmas": 2.0})


@query("tf_df_subset", f"WITH {POST}, {SUB} SELECT 'lemmas' AS field, term, tf, df FROM sub")
def tf_df_subset(s: SparkSession, d: str) -> DataFrame:
    """A6 J1."""
    return subset_stats(s, d)


@query("tf_df_merge_fields", f"WITH {POST}, {BI}, {STAT2} SELECT term, sum(tf) AS tf, sum(df)::BIGINT AS df FROM st2 GROUP BY term")
def tf_df_merge_fields(s: SparkSession, d: str) -> DataFrame:
    """A7 across fields."""
    return stats.merge([stats.term_parts(docs(s, d), X.tokens(F.col("text")), "lemmas", "lemmas_bigrams")], across_fields=True)


@query("tf_df_merge_parts", f"WITH {POST}, {STAT}, {SUB} SELECT 'lemmas' AS field, term, sum(tf) AS tf, sum(df)::BIGINT AS df FROM (SELECT term, tf, df FROM st UNION ALL SELECT term, tf, df FROM sub) GROUP BY term")
def tf_df_merge_parts(s: SparkSession, d: str) -> DataFrame:
    """A7 by field."""
    return stats.merge([base_stats(s, d), subset_stats(s, d)], fields=["lemmas"])


@query("tfdf_filter", f"WITH {POST}, {BI}, {STAT2} SELECT * FROM st2 WHERE df >= CASE WHEN field = 'lemmas' THEN 10 ELSE 5 END")
def tfdf_filter(s: SparkSession, d: str) -> DataFrame:
    """L14."""
    return stats.filter_df(both_stats(s, d), {"lemmas": 10, "lemmas_bigrams": 5})


_CROSS = "u AS (SELECT term FROM st2 WHERE field = 'lemmas' AND df >= 10), x AS (SELECT * FROM st2 WHERE field = 'lemmas' AND df >= 10 UNION ALL SELECT * FROM st2 WHERE field = 'lemmas_bigrams' AND string_split(term, ' ')[1] IN (FROM u) AND string_split(term, ' ')[2] IN (FROM u))"


@query("tfdf_cross_filter", f"WITH {POST}, {BI}, {STAT2}, {_CROSS} SELECT * FROM x")
def tfdf_cross_filter(s: SparkSession, d: str) -> DataFrame:
    """L15 J8."""
    return stats.cross_filter(stats.filter_df(saved(both_stats(s, d), "stats"), {"lemmas": 10}), "lemmas", "lemmas_bigrams")


@query("tfdf_report", f"WITH {POST}, {BI}, {STAT2}, {_CROSS} SELECT 'before' AS step, field, count(*) AS vocabulary, sum(tf) AS tokens FROM st2 GROUP BY field UNION ALL SELECT 'after', field, count(*), sum(tf) FROM x GROUP BY field")
def tfdf_report(s: SparkSession, d: str) -> DataFrame:
    """L16."""
    before = saved(both_stats(s, d), "stats")
    return stats.report({"before": before, "after": stats.cross_filter(stats.filter_df(before, {"lemmas": 10}), "lemmas", "lemmas_bigrams")})


@query("idf_weights", f"WITH {POST}, {STAT}, n AS (SELECT count(*) AS n FROM documents) SELECT term, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 0), 6) AS weight FROM st, n")
def idf_weights(s: SparkSession, d: str) -> DataFrame:
    """A13 O3."""
    return stats.idf_weights(base_stats(s, d), docs(s, d).count()).select("term", F.round("weight", 6).alias("weight"))


@query("idf_weights_listed", f"WITH {POST}, {STAT}, n AS (SELECT count(*) AS n FROM documents), {ASK} SELECT term, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 0), 6) AS weight FROM st, n WHERE term IN (FROM ask) AND greatest(ln((n - df + 0.5) / (df + 0.5)), 0) >= 1.2345678")
def idf_weights_listed(s: SparkSession, d: str) -> DataFrame:
    """Of listed words, from a threshold up."""
    return stats.idf_weights(base_stats(s, d), docs(s, d).count(), asked(s, d), 1.2345678).select("term", F.round("weight", 6).alias("weight"))


@query("tf_log_ratio", f"WITH {POST}, {STAT}, {SUB}, {RATIO} SELECT term, round(weight, 6) AS weight FROM r WHERE weight >= 0.1234567")
def tf_log_ratio(s: SparkSession, d: str) -> DataFrame:
    """A14 J4 L20 O3."""
    return stats.log_tf_ratio(subset_stats(s, d), base_stats(s, d), threshold=0.1234567).select("term", F.round("weight", 6).alias("weight"))


@query("tf_log_ratio_dfs", f"WITH {POST}, {STAT}, {SUB}, {RATIO} SELECT term, round(weight, 6) AS weight, subset_df, base_df FROM r")
def tf_log_ratio_dfs(s: SparkSession, d: str) -> DataFrame:
    """A14 J5."""
    return stats.log_tf_ratio(subset_stats(s, d), base_stats(s, d), print_dfs=True).withColumn("weight", F.round("weight", 6))


@query("tf_log_ratio_words", f"WITH {POST}, {STAT}, sub0 AS (SELECT term, sum(tf)::DOUBLE AS tf, count(*) AS df FROM post WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY term), {ASK}, sub AS MATERIALIZED (SELECT * FROM sub0 WHERE term IN (FROM ask)), {RATIO} SELECT term, round(weight, 6) AS weight FROM r")
def tf_log_ratio_words(s: SparkSession, d: str) -> DataFrame:
    """Of listed words only."""
    return stats.log_tf_ratio(subset_stats(s, d), base_stats(s, d), asked(s, d)).select("term", F.round("weight", 6).alias("weight"))


@query("query_weights", f"WITH {POST}, {STAT}, {SUB}, {RATIO}, {ASK} SELECT term, round(weight, 6) AS weight FROM r JOIN ask USING (term) WHERE weight <> 0")
def query_weights(s: SparkSession, d: str) -> DataFrame:
    """J6 O4 Q12."""
    return stats.weight_query(asked(s, d), stats.log_tf_ratio(subset_stats(s, d), base_stats(s, d))).select("term", F.round("weight", 6).alias("weight"))


def ratios(s: SparkSession, d: str) -> DataFrame:
    return stats.log_tf_ratio(subset_stats(s, d), base_stats(s, d), print_dfs=True)


_BOUNDS = {"min_ur": 0.2000001, "min_udf": 3, "min_uedf": 2, "max_udfr": 4.0}
_KEPT = r"k AS (SELECT r.* FROM r WHERE weight >= 0.2000001 AND base_df >= 3 AND subset_df >= 2 AND base_df / subset_df::DOUBLE <= 4.0 AND regexp_full_match(term, '[\p{L}.\-]+') AND NOT starts_with(term, '-') AND NOT ends_with(term, '-') AND term <> 'NNP')"
_SELECT = f"WITH {POST}, {STAT}, {SUB}, {RATIO}, {ASK}, {_KEPT}, f AS (SELECT coalesce(k.term, ask.term) AS term, round(k.weight, 6) AS weight, k.subset_df, k.base_df, CASE WHEN ask.term IS NULL THEN 'new' WHEN k.term IS NOT NULL THEN 'query' ELSE 'missing' END AS label FROM k FULL JOIN ask ON k.term = ask.term) SELECT * FROM f WHERE label IN "


def _select(which: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: stats.select_terms(ratios(s, d), asked(s, d), which, **_BOUNDS).withColumn("weight", F.round("weight", 6))


for _which, _in in (("all", "('new', 'query')"), ("new", "('new')"), ("query", "('query')"), ("missing", "('missing')")):
    query(f"select_terms_{_which}", _SELECT + _in)(_select(_which))


@query("select_terms_unchecked", f"WITH {POST}, {STAT}, {SUB}, {RATIO}, {ASK} SELECT r.term, round(weight, 6) AS weight, subset_df, base_df, CASE WHEN ask.term IS NULL THEN 'new' ELSE 'query' END AS label FROM r LEFT JOIN ask ON r.term = ask.term WHERE weight >= 0.2000001 AND base_df >= 3 AND subset_df >= 2 AND base_df / subset_df::DOUBLE <= 4.0")
def select_terms_unchecked(s: SparkSession, d: str) -> DataFrame:
    """L17 without L18."""
    return stats.select_terms(ratios(s, d), asked(s, d), "all", sane=False, **_BOUNDS).withColumn("weight", F.round("weight", 6))


@query("select_terms_sorted", _SELECT + "('new', 'query') ORDER BY base_df DESC, term LIMIT 200")
def select_terms_sorted(s: SparkSession, d: str) -> DataFrame:
    """The 200 with the highest document frequency."""
    return stats.sort_terms(_select("all")(s, d), "dw").limit(200)


# --- collectors, projections, filters -----------------------------------------------------------------------------------

_WC = r"SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS lines, len(regexp_extract_all(text, '[^\s]+'))::BIGINT AS words, length(text)::BIGINT AS chars FROM documents"


@query("wc_per_doc", _WC)
def wc_per_doc(s: SparkSession, d: str) -> DataFrame:
    """X8 Q3."""
    return docs(s, d).select("doc_id", X.word_count(F.col("text")).alias("w")).select("doc_id", "w.*")


@query("wc_total", f"SELECT sum(lines)::BIGINT AS lines, sum(words)::BIGINT AS words, sum(chars)::BIGINT AS chars FROM ({_WC})")
def wc_total(s: SparkSession, d: str) -> DataFrame:
    """A8 Q2."""
    return basic.word_counts(docs(s, d), "text")


@query("doc_count", "SELECT count(*) AS n FROM documents")
def doc_count(s: SparkSession, d: str) -> DataFrame:
    """A1."""
    return basic.doc_count(docs(s, d))


@query("field_sum", "SELECT sum(n_chars)::BIGINT AS total FROM documents")
def field_sum(s: SparkSession, d: str) -> DataFrame:
    """A2."""
    return basic.field_sum(docs(s, d), "n_chars")


@query("dict_aggregate", "SELECT 'counts' AS field, event_type AS key, count(*) AS value FROM events GROUP BY event_type")
def dict_aggregate(s: SparkSession, d: str) -> DataFrame:
    """A3."""
    per_user = table(s, d, "events").groupBy("user_id").agg(X.counts(F.collect_list("event_type")).alias("counts"))
    return basic.dict_aggregate(per_user, ["counts"])


@query("retain_fields", "SELECT doc_id, lang FROM documents")
def retain_fields(s: SparkSession, d: str) -> DataFrame:
    """P2."""
    return basic.retain_fields(docs(s, d), ["doc_id", "lang", "absent"])


@query("delete_fields", "SELECT doc_id, lang, source, n_chars FROM documents")
def delete_fields(s: SparkSession, d: str) -> DataFrame:
    """P1."""
    return basic.delete_fields(docs(s, d), ["text", "absent"])


@query("get_field", "SELECT toxic FROM labels WHERE toxic IS NOT NULL AND toxic <> 0")
def get_field(s: SparkSession, d: str) -> DataFrame:
    """Falsy values go."""
    return basic.get_field(table(s, d, "labels"), "toxic")


@query("new_field", "SELECT doc_id, lang || '-' || source AS tag FROM documents")
def new_field(s: SparkSession, d: str) -> DataFrame:
    """P4."""
    return basic.new_field(docs(s, d), "concat(lang, '-', source)", "tag").select("doc_id", "tag")


@query("filter_document", "SELECT doc_id, n_chars FROM documents WHERE n_chars > 2000 AND lang = 'en'")
def filter_document(s: SparkSession, d: str) -> DataFrame:
    """L1."""
    return basic.filter_document(docs(s, d).select("doc_id", "n_chars", "lang"), "n_chars > 2000 AND lang = 'en'").select("doc_id", "n_chars")


@query("filter_empty", "SELECT * FROM labels WHERE coalesce(toxic, 0) <> 0 OR coalesce(quality, 0) <> 0")
def filter_empty(s: SparkSession, d: str) -> DataFrame:
    """L2."""
    return basic.filter_empty(table(s, d, "labels"), ["toxic", "quality"])


@query("in_set", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def in_set(s: SparkSession, d: str) -> DataFrame:
    """J1."""
    return basic.in_set(docs(s, d).select("doc_id", "source"), "doc_id", good_ids(s, d))


@query("not_in_set", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def not_in_set(s: SparkSession, d: str) -> DataFrame:
    """J2."""
    return basic.not_in_set(docs(s, d).select("doc_id", "source"), "doc_id", good_ids(s, d))


def _words(condition: str) -> str:
    return f"WITH {TOK} SELECT doc_id, array_to_string(list_filter(t, lambda x: {condition}), ' ') AS words FROM tok"


def _filtered(*filters_: X.WordFilter) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: tokenized(s, d).select("doc_id", F.array_join(X.filter_words(F.col("lemmas"), filters_), " ").alias("words"))


query("filter_stop_words", _words(f"x NOT IN ({LISTED})"))(_filtered(X.stop_word_filter(STOP)))
query("filter_long_words", _words("length(x) <= 8"))(_filtered(X.long_word_filter(8)))
query("filter_alnum", _words("regexp_matches(x, '[a-zA-Z0-9]')"))(_filtered(X.alnum_filter()))
query("filter_words", _words(f"x NOT IN ({LISTED}) AND length(x) <= 8 AND regexp_matches(x, '[a-zA-Z0-9]')"))(_filtered(X.stop_word_filter(STOP), X.long_word_filter(8), X.alnum_filter()))


@query("filter_dict_field", f"WITH {POST} SELECT doc_id, term, tf FROM post WHERE tf >= 3")
def filter_dict_field(s: SparkSession, d: str) -> DataFrame:
    """L5 A12."""
    made = tokenized(s, d).select("doc_id", X.counts(F.col("lemmas")).alias("c"))
    return basic.filter_dict_field(made, "c", lambda k, v: v >= 3).select("doc_id", F.explode("c").alias("term", "tf"))


@query("filter_dict_field_set", f"WITH {POST}, {ASK} SELECT doc_id, term, tf FROM post WHERE term IN (FROM ask)")
def filter_dict_field_set(s: SparkSession, d: str) -> DataFrame:
    """L5 with a set of any size."""
    made = tokenized(s, d).select("doc_id", X.counts(F.col("lemmas")).alias("c"))
    return basic.filter_dict_field_by_set(made, "c", asked(s, d), "doc_id").select("doc_id", F.explode("c").alias("term", "tf"))


@query("token_counts", f"WITH {POST} SELECT doc_id, term, tf FROM post")
def token_counts(s: SparkSession, d: str) -> DataFrame:
    """A12 X2."""
    return tokenized(s, d).select("doc_id", F.explode(X.counts(F.col("lemmas"))).alias("term", "tf"))


_BIS = "list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])"


@query("bigrams", f"WITH {TOK} SELECT doc_id, md5(array_to_string({_BIS}, '|')) AS pairs, len({_BIS})::INTEGER AS n FROM tok")
def bigrams(s: SparkSession, d: str) -> DataFrame:
    """W1."""
    return tokenized(s, d).select("doc_id", X.bigrams(F.col("lemmas")).alias("b")).select("doc_id", F.md5(F.array_join("b", "|").cast("binary")).alias("pairs"), F.size("b").alias("n"))


@query("bigrams_filtered", f"WITH {TOK} SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(t)), lambda i: t[i] NOT IN ({LISTED}) AND t[i + 1] NOT IN ({LISTED})), lambda i: t[i] || ' ' || t[i + 1]), '|') AS pairs FROM tok")
def bigrams_filtered(s: SparkSession, d: str) -> DataFrame:
    """W1 L6 L7."""
    return tokenized(s, d).select("doc_id", F.array_join(X.bigrams(F.col("lemmas"), [X.stop_word_filter(STOP)]), "|").alias("pairs"))


@query("bigram_filter_global", f"WITH {TOK}, {BI} SELECT doc_id, term, tf FROM bipost WHERE string_split(term, ' ')[1] IN ({LISTED}) AND string_split(term, ' ')[2] IN ({LISTED})")
def bigram_filter_global(s: SparkSession, d: str) -> DataFrame:
    """L11 Q1."""
    made = tokenized(s, d).select("doc_id", X.counts(X.bigrams(F.col("lemmas"))).alias("c"))
    return made.select("doc_id", F.explode(X.bigrams_of_set(F.col("c"), F.array(*[F.lit(w) for w in STOP]), True)).alias("term", "tf"))


@query("bigram_filter_document", f"WITH {TOK}, u AS (SELECT doc_id, t, list_distinct(list_filter(t, lambda x: length(x) > 6)) AS own FROM tok) SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(t)), lambda i: list_contains(own, t[i]) AND list_contains(own, t[i + 1])), lambda i: t[i] || ' ' || t[i + 1]), '|') AS pairs FROM u")
def bigram_filter_document(s: SparkSession, d: str) -> DataFrame:
    """L12."""
    own = F.array_distinct(F.filter("lemmas", lambda x: F.length(x) > 6))
    made = tokenized(s, d).select("doc_id", own.alias("u"), X.bigrams(F.col("lemmas")).alias("b"))
    return made.select("doc_id", F.array_join(X.bigrams_of_unigrams(F.col("b"), F.col("u")), "|").alias("pairs"))


@query("sort_top_k", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def sort_top_k(s: SparkSession, d: str) -> DataFrame:
    """O1 O2."""
    return basic.sorter(docs(s, d).select("doc_id", "n_chars"), [("n_chars", True)], 20, ["doc_id"])


@query("sort_top_k_per_source", "SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 3 ORDER BY n_chars DESC, doc_id LIMIT 30")
def sort_top_k_per_source(s: SparkSession, d: str) -> DataFrame:
    """O2 in two levels."""
    return basic.two_level_top(docs(s, d).select("doc_id", "source", "n_chars"), [("n_chars", True)], "source", 3, 30, ["doc_id"])


@query("list_first_n", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 25")
def list_first_n(s: SparkSession, d: str) -> DataFrame:
    """A10."""
    return basic.collect_list(docs(s, d).select("doc_id", "source"), 25, ["doc_id"])


@query("set_collect", "SELECT DISTINCT lang, source FROM documents")
def set_collect(s: SparkSession, d: str) -> DataFrame:
    """A11."""
    return basic.collect_set(docs(s, d).select("lang", "source"))


@query("json_to_tsv", "SELECT concat_ws(chr(9), coalesce(doc_id::VARCHAR, ''), coalesce(lang, ''), '') AS value FROM documents")
def json_to_tsv(s: SparkSession, d: str) -> DataFrame:
    """K5."""
    return writers.fields_to_tsv(docs(s, d), ["doc_id", "lang", "absent"])


@query("union_sources", "SELECT doc_id AS id, text FROM documents UNION ALL SELECT conv_id, text FROM conversations UNION ALL SELECT item_id, text FROM benchmark")
def union_sources(s: SparkSession, d: str) -> DataFrame:
    """S6 U1."""
    from .sources.readers import union_documents

    return union_documents([docs(s, d).select(F.col("doc_id").alias("id"), "text"), table(s, d, "conversations").select(F.col("conv_id").alias("id"), "text"), table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text")])


# --- near duplicates ----------------------------------------------------------------------------------------------------

_SHING = f"{TOK}, sh AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + 4], ' ') AS s FROM (SELECT doc_id, t, unnest(range(1, len(t) - 3)) AS i FROM tok))"
_MINS = ", ".join(f"min((h * {a} + {b}) % 2147483647) AS m{i}" for i, (a, b) in enumerate(dedup.permutations(PERMUTATIONS)))
_SIG = f"{_SHING}, sig AS (SELECT doc_id, {_MINS} FROM (SELECT doc_id, ('0x' || substr(md5(s), 1, 8))::BIGINT % 2147483647 AS h FROM sh) GROUP BY doc_id)"
_BAND = " UNION ALL ".join(f"SELECT doc_id, {b} AS band, md5(concat_ws('-', {', '.join(f'm{b * ROWS + r}' for r in range(ROWS))})) AS bucket FROM sig" for b in range(BANDS))
_BUCK = f"{_SIG}, buck AS ({_BAND})"


def signed(s: SparkSession, d: str) -> DataFrame:
    return dedup.signatures(docs(s, d), "doc_id", X.tokens(F.col("text")), PERMUTATIONS, words=5)


def bucketed(s: SparkSession, d: str) -> DataFrame:
    return dedup.buckets(signed(s, d), "doc_id", BANDS, ROWS)


@query("shingles", f"WITH {_SHING} SELECT doc_id, count(*) AS n, min(md5(s)) AS least FROM sh GROUP BY doc_id")
def shingles(s: SparkSession, d: str) -> DataFrame:
    """W2."""
    return dedup.shingle_summary(tokenized(s, d), "doc_id", X.shingles(F.col("lemmas"), 5))


@query("minhash_signature", f"WITH {_SIG} SELECT doc_id, concat_ws('-', {', '.join(f'm{i}' for i in range(PERMUTATIONS))}) AS minhash FROM sig")
def minhash_signature(s: SparkSession, d: str) -> DataFrame:
    """X12 Q6."""
    return signed(s, d).select("doc_id", F.array_join("minhash", "-").alias("minhash"))


@query("lsh_buckets", f"WITH {_BUCK} SELECT doc_id, band::INTEGER AS band, bucket FROM buck")
def lsh_buckets(s: SparkSession, d: str) -> DataFrame:
    """J17."""
    return bucketed(s, d)


@query("lsh_bucket_sizes", f"WITH {_BUCK} SELECT band::INTEGER AS band, bucket, count(*) AS n, min(doc_id) AS first_doc FROM buck GROUP BY ALL HAVING count(*) > 1")
def lsh_bucket_sizes(s: SparkSession, d: str) -> DataFrame:
    """Collisions as groups, not as pairs, which a large group of copies would square."""
    return bucketed(s, d).groupBy("band", "bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


_LSH = f"""WITH RECURSIVE {_BUCK}, ids AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM sig),
e AS (SELECT i.k, list(DISTINCT j.k) AS near FROM buck a JOIN buck b ON a.band = b.band AND a.bucket = b.bucket AND b.doc_id < a.doc_id JOIN ids i ON i.doc_id = a.doc_id JOIN ids j ON j.doc_id = b.doc_id GROUP BY i.k),
walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL SELECT w.k + 1, CASE WHEN e.near IS NOT NULL AND list_has_any(e.near, w.kept) THEN w.kept ELSE list_append(w.kept, w.k + 1) END FROM walk w LEFT JOIN e ON e.k = w.k + 1 WHERE w.k < (SELECT count(*) FROM ids)),
kept AS (SELECT unnest(kept) AS k FROM walk WHERE k = (SELECT count(*) FROM ids))"""


@query("lsh_unique", f"{_LSH} SELECT doc_id FROM ids JOIN kept USING (k)")
def lsh_unique(s: SparkSession, d: str) -> DataFrame:
    """Survivors in order of doc_id."""
    return dedup.survivors(bucketed(s, d), "doc_id")


@query("unique_documents", f"{_LSH} SELECT d.doc_id, d.source, d.n_chars FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM ids JOIN kept USING (k))")
def unique_documents(s: SparkSession, d: str) -> DataFrame:
    """J1 A9."""
    return basic.in_set(docs(s, d).select("doc_id", "source", "n_chars"), "doc_id", dedup.survivors(bucketed(s, d), "doc_id"))


# --- annotated tokens ---------------------------------------------------------------------------------------------------

_LINES = r"ln AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '[\p{L}\p{N}]+')) > 0), lambda x: regexp_extract_all(x, '[\p{L}\p{N}]+')) AS s FROM documents)"
_NNP = "CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'NNP' ELSE lower(w) END"


def sentences(s: SparkSession, d: str) -> DataFrame:
    """Lines as sentences of (word, lemma, tag); words with an ASCII capital in front are tagged NNP."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_extract_all(x, F.lit(X.TOKEN), F.lit(0)))
    token = lambda w: F.array(w, F.lower(w), F.when(F.rlike(w, F.lit("^[A-Z]")), "NNP").otherwise("NN"))
    return docs(s, d).select("doc_id", F.transform(F.filter(lines, lambda x: F.size(x) > 0), lambda x: F.transform(x, token)).alias("sentences"))


@query("conll_to_list", f"WITH {_LINES} SELECT doc_id, md5(array_to_string(list_transform(flatten(s), lambda w: {_NNP}), ' ')) AS tokens FROM ln")
def conll_to_list(s: SparkSession, d: str) -> DataFrame:
    """X1 X3 X7."""
    return sentences(s, d).select("doc_id", F.md5(F.array_join(X.conll_list(F.col("sentences"), "word", True, "NNP"), " ").cast("binary")).alias("tokens"))


@query("conll_to_lists", f"WITH {_LINES} SELECT doc_id, len(s)::INTEGER AS n_sentences, md5(array_to_string(list_transform(s, lambda x: array_to_string(list_transform(x, lambda w: lower(w)), ' ')), '|')) AS tokens FROM ln")
def conll_to_lists(s: SparkSession, d: str) -> DataFrame:
    """X4."""
    lists = X.conll_lists(F.col("sentences"), "lemma")
    return sentences(s, d).select("doc_id", F.size(lists).alias("n_sentences"), F.md5(F.array_join(F.transform(lists, lambda x: F.array_join(x, " ")), "|").cast("binary")).alias("tokens"))


@query("conll_to_set", f"WITH {_LINES} SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list_transform(flatten(s), lambda w: lower(w)))), ' ')) AS tokens FROM ln")
def conll_to_set(s: SparkSession, d: str) -> DataFrame:
    """X5 Q7."""
    return sentences(s, d).select("doc_id", F.md5(F.array_join(F.array_sort(X.conll_set(F.col("sentences"), "lemma")), " ").cast("binary")).alias("tokens"))


@query("conll_to_counts", f"WITH {_LINES}, w AS (SELECT doc_id, unnest(list_transform(flatten(s), lambda w: {_NNP})) AS token FROM ln) SELECT doc_id, token, count(*) AS n FROM w GROUP BY ALL")
def conll_to_counts(s: SparkSession, d: str) -> DataFrame:
    """X2."""
    return sentences(s, d).select("doc_id", F.explode(X.conll_counts(F.col("sentences"), "word", True, "NNP")).alias("token", "n"))


@query("conll_to_text", f"WITH {_LINES} SELECT doc_id, md5(array_to_string(list_transform(s, lambda x: array_to_string(x, ' ')), chr(10))) AS tokens FROM ln")
def conll_to_text(s: SparkSession, d: str) -> DataFrame:
    """X6."""
    return sentences(s, d).select("doc_id", F.md5(X.conll_text(F.col("sentences"), "word").cast("binary")).alias("tokens"))


_MARKS = "('.', '!', '?')"
_ANNOTATED = rf"WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')) AS line FROM documents), t AS (SELECT doc_id, regexp_extract_all(line, '[\p{{L}}\p{{Nl}}\p{{No}}]+(?:[''’\-][\p{{L}}\p{{Nl}}\p{{No}}]+)*|\p{{Nd}}+(?:[.,]\p{{Nd}}+)*|[^\p{{L}}\p{{N}}_\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]') AS t FROM l) SELECT doc_id, sum(len(list_filter(t, lambda x: x IN {_MARKS})) + CASE WHEN len(t) > 0 AND t[-1] NOT IN {_MARKS} THEN 1 ELSE 0 END)::INTEGER AS n_sentences, sum(len(t))::INTEGER AS n_tokens FROM t GROUP BY doc_id"


@query("annotate", _ANNOTATED)
def annotated(s: SparkSession, d: str) -> DataFrame:
    """The built-in annotator."""
    made = annotate.annotate(docs(s, d).select("doc_id", "text"), ["text"])
    return made.select("doc_id", F.size("text_corenlp").alias("n_sentences"), F.size(F.flatten("text_corenlp")).alias("n_tokens"))


# --- language, domain, web ----------------------------------------------------------------------------------------------

_HOST = r"h AS (SELECT page_id, url, regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)', 1) AS host FROM pages)"


@query("domain_suffix", f"WITH {_HOST} SELECT page_id, url FROM h WHERE host <> '' AND string_split(host, '.')[-1] IN ('com', 'org')")
def domain_suffix(s: SparkSession, d: str) -> DataFrame:
    """L4."""
    return filters.domain_filter(table(s, d, "pages").select("page_id", "url"), ["com", "org"])


@query("domain_exclude", f"WITH {_HOST} SELECT page_id, url FROM h WHERE host <> '' AND string_split(host, '.')[-2] || '.' || string_split(host, '.')[-1] <> 'example.com'")
def domain_exclude(s: SparkSession, d: str) -> DataFrame:
    """L4 J2."""
    return filters.domain_filter(table(s, d, "pages").select("page_id", "url"), ["example.com"], expression="concat(domain, '.', suffix)", retain=False)


_VOTES = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in own.split())})))::INTEGER AS n_{code}" for code, own in sorted(filters.FUNCTION_WORDS.items()))
_BEST = "greatest(" + ", ".join(f"n_{c}" for c in sorted(filters.FUNCTION_WORDS)) + ")"
_TIES = " + ".join(f"(n_{c} = best)::INTEGER" for c in sorted(filters.FUNCTION_WORDS))
_CASE = " ".join(f"WHEN n_{c} = best THEN '{c}'" for c in sorted(filters.FUNCTION_WORDS))


_DETECT = rf"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{{L}}+') AS w FROM documents), v AS (SELECT doc_id, {_VOTES} FROM w), b AS (SELECT *, {_BEST} AS best FROM v) SELECT doc_id, CASE WHEN best = 0 OR {_TIES} > 1 THEN NULL {_CASE} END AS lang FROM b"


@query("language_detect", _DETECT)
def language_detect(s: SparkSession, d: str) -> DataFrame:
    """L3: the built-in detector; null where it is undecided."""
    return docs(s, d).select("doc_id", filters.detect_language([F.col("text")]).alias("lang"))


@query("language_filter", rf"SELECT doc_id FROM ({_DETECT}) WHERE lang IN ('fr', 'de')")
def language_filter(s: SparkSession, d: str) -> DataFrame:
    """L3: documents found to be in one of two languages."""
    return filters.language_filter(docs(s, d).select("doc_id", "text"), ["text"], ["fr", "de"]).select("doc_id")


_GRAMS = ", ".join(f"len(list_filter(g, lambda x: x IN ({', '.join(repr(x) for x in own)}))) / sqrt({len(own)}) AS t_{code}" for code, own in sorted(filters.trigram_profiles().items()))
_TOP3 = "greatest(" + ", ".join(f"t_{c}" for c in sorted(filters.FUNCTION_WORDS)) + ")"
_TIES3 = " + ".join(f"(t_{c} = top)::INTEGER" for c in sorted(filters.FUNCTION_WORDS))
_CASE3 = " ".join(f"WHEN t_{c} = top THEN '{c}'" for c in sorted(filters.FUNCTION_WORDS))
_CHAIN = rf"WITH a AS ({_DETECT}), f AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g')) || ' ' AS flat FROM documents), g AS (SELECT doc_id, list_transform(range(1, greatest(length(flat) - 1, 2)), lambda i: substr(flat, i, 3)) AS g FROM f), v AS (SELECT doc_id, {_GRAMS} FROM g), b AS (SELECT *, {_TOP3} AS top FROM v) SELECT doc_id, coalesce(a.lang, CASE WHEN top = 0 OR {_TIES3} > 1 THEN NULL {_CASE3} END) AS lang FROM b JOIN a USING (doc_id)"


@query("language_detect_chain", _CHAIN)
def language_detect_chain(s: SparkSession, d: str) -> DataFrame:
    """L3: two detectors in order."""
    return docs(s, d).select("doc_id", filters.detect_language([F.col("text")], ["function_words", "trigrams"]).alias("lang"))


@query("html_extract")
def html_extract(s: SparkSession, d: str) -> DataFrame:
    """Both extractors."""
    made = table(s, d, "pages").select("page_id", webarchive.main_text(F.col("html")).alias("a"), webarchive.main_text(F.col("html"), "justext").alias("b"))
    return made.select("page_id", F.length("a").alias("article_chars"), F.length("b").alias("paragraph_chars"))


# --- vectors ------------------------------------------------------------------------------------------------------------


def embedded(s: SparkSession, d: str) -> DataFrame:
    """idx, word, vec (scaled to length 1), list of the embeddings."""
    e = table(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("idx"), F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), V.normalize(F.col("embedding")).alias("vec"), F.concat(F.lit("list"), F.col("label").cast("string")).alias("list"))


_EMB = "e0 AS (SELECT vec_id AS idx, list_transform(embedding, lambda x: x::DOUBLE) AS r, 'list' || label AS list FROM embeddings), e AS (SELECT idx, list, list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS v FROM e0)"
_KNN = f"{_EMB}, q AS (SELECT * FROM e WHERE idx % 100 = 0), s AS (SELECT q.idx AS src, e.idx AS dst, list_dot_product(q.v, e.v) AS sim FROM q, e), k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM s)"
_OUT = "'w' || src AS query, 'w' || dst AS word, round(sim, 6) AS sim, rank::INTEGER AS rank"


def asked_words(s: SparkSession, d: str) -> DataFrame:
    """The stated query set: vectors whose number is divisible by 100."""
    return embedded(s, d).where("idx % 100 = 0").select("word")


@query("normalize_vectors", f"WITH {_EMB} SELECT idx, round(list_dot_product(v, v), 6) AS norm, round(v[1], 6) AS first FROM e")
def normalize_vectors(s: SparkSession, d: str) -> DataFrame:
    """X13."""
    return embedded(s, d).select("idx", F.round(V.dot(F.col("vec"), F.col("vec")), 6).alias("norm"), F.round(F.col("vec")[0], 6).alias("first"))


@query("angular_distance", f"WITH {_EMB}, m AS (SELECT list, min(idx) AS first_idx FROM e GROUP BY list) SELECT e.idx, round(acos(greatest(-1.0, least(1.0, list_dot_product(e.v, f.v)))) / pi(), 5) AS distance FROM e JOIN m USING (list) JOIN e f ON f.idx = m.first_idx")
def angular_distance(s: SparkSession, d: str) -> DataFrame:
    """To the first vector of the same list."""
    e = embedded(s, d)
    first = e.groupBy("list").agg(F.min("idx").alias("idx")).join(e, ["list", "idx"]).select("list", F.col("vec").alias("first"))
    return e.join(first, "list").select("idx", F.round(V.angular(V.dot(F.col("vec"), F.col("first"))), 5).alias("distance"))


@query("knn", f"WITH {_KNN} SELECT {_OUT} FROM k WHERE k.rank <= 5 AND sim >= 0")
def knn(s: SparkSession, d: str) -> DataFrame:
    """G6 J9 W4."""
    return vectors.neighbours(embedded(s, d), asked_words(s, d), 5).withColumn("sim", F.round("sim", 6))


@query("knn_min_similarity", f"WITH {_KNN} SELECT {_OUT} FROM k WHERE k.rank <= 10 AND sim >= 0.2500001")
def knn_min_similarity(s: SparkSession, d: str) -> DataFrame:
    """L21 Q24."""
    return vectors.neighbours(embedded(s, d), asked_words(s, d), 10, min_similarity=0.2500001).withColumn("sim", F.round("sim", 6))


@query("knn_min_freq", f"WITH {_KNN}, f AS (SELECT vec_id AS idx, label AS freq FROM embeddings) SELECT {_OUT} FROM k JOIN f ON f.idx = k.dst WHERE k.rank <= 10 AND sim >= 0 AND coalesce(freq, 0) >= 5")
def knn_min_freq(s: SparkSession, d: str) -> DataFrame:
    """L22 S12; the label stands for a frequency."""
    freqs = table(s, d, "embeddings").select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), F.col("label").alias("freq"))
    return vectors.neighbours(embedded(s, d), asked_words(s, d), 10, freqs=freqs, min_freq=5).withColumn("sim", F.round("sim", 6))


@query("knn_self_contained", f"WITH {_EMB}, q AS (SELECT * FROM e WHERE idx % 100 = 0), s AS (SELECT a.idx AS src, b.idx AS dst, list_dot_product(a.v, b.v) AS sim FROM q a, q b WHERE a.idx <> b.idx), k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM s) SELECT {_OUT} FROM k WHERE k.rank <= 3 AND sim >= -1")
def knn_self_contained(s: SparkSession, d: str) -> DataFrame:
    """Among the queries, without themselves."""
    return vectors.neighbours(embedded(s, d), asked_words(s, d), 3, min_similarity=-1.0, self_contained=True, exclude_self=True).withColumn("sim", F.round("sim", 6))


LEAST = 0.3500001
_EDGES = f"{_EMB}, g AS (SELECT a.idx AS src, b.idx AS dst, list_dot_product(a.v, b.v) AS sim FROM e a, e b WHERE a.idx <> b.idx AND list_dot_product(a.v, b.v) >= {LEAST}), c AS (SELECT idx FROM e WHERE list = 'list0')"
_CAND = "cand AS (SELECT DISTINCT src FROM g WHERE dst IN (FROM c) AND src NOT IN (FROM c)), rk AS (SELECT src, dst, sim, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) - 1 AS r, (dst IN (FROM c))::INTEGER::DOUBLE AS inside FROM g WHERE src IN (FROM cand))"


def nearest_edges(s: SparkSession, d: str) -> DataFrame:
    return vectors.nearest_edges(embedded(s, d), LEAST)


def seeds(s: SparkSession, d: str) -> DataFrame:
    return embedded(s, d).where("list = 'list0'").select("idx")


@query("emscan_first_step", f"WITH {_EDGES}, {_CAND} SELECT src AS idx FROM rk WHERE r = 0 AND inside = 1")
def emscan_first_step(s: SparkSession, d: str) -> DataFrame:
    """G1 J10 J11 W5."""
    return vectors.emscan_step_of(embedded(s, d), seeds(s, d), LEAST, "first")


@query("emscan_dcg_step", f"WITH {_EDGES}, {_CAND} SELECT src AS idx FROM rk WHERE r < 5 GROUP BY src HAVING sum(inside * CASE WHEN r = 0 THEN 1.0 ELSE 1.0 / log2(r + 1) END) >= 1 - 1e-12")
def emscan_dcg_step(s: SparkSession, d: str) -> DataFrame:
    """G2 W6."""
    return vectors.emscan_step_of(embedded(s, d), seeds(s, d), LEAST, "dcg")


@query("emscan_ratio_step", f"WITH {_EDGES}, {_CAND} SELECT src AS idx FROM rk GROUP BY src HAVING avg(inside) >= 0.5")
def emscan_ratio_step(s: SparkSession, d: str) -> DataFrame:
    """G3."""
    return vectors.emscan_step_of(embedded(s, d), seeds(s, d), LEAST, "ratio")


_LOOP = f"{_EMB}, g AS MATERIALIZED (SELECT a.idx AS src, b.idx AS dst, list_dot_product(a.v, b.v) AS sim FROM e a, e b WHERE a.idx <> b.idx AND list_dot_product(a.v, b.v) >= {LEAST}), nn AS MATERIALIZED (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS r FROM g) WHERE r = 1), c AS (SELECT idx, 0 AS it FROM e WHERE list = 'list0' UNION ALL SELECT n.src, c.it + 1 FROM c JOIN nn n ON n.dst = c.idx WHERE n.src NOT IN (SELECT idx FROM e WHERE list = 'list0') AND c.it < 50)"


@query("emscan_first_loop", f"WITH RECURSIVE {_LOOP} SELECT idx, min(it)::INTEGER AS it FROM c GROUP BY idx")
def emscan_first_loop(s: SparkSession, d: str) -> DataFrame:
    """Rounds until nothing is added."""
    return vectors.emscan(nearest_edges(s, d), seeds(s, d), 50)[0]


@query("emscan_graph_edges", f"WITH {_EDGES}, {_CAND} SELECT src, dst, round(sim, 6) AS weight, 1 AS it FROM rk WHERE r = 0 AND inside = 1")
def emscan_graph_edges(s: SparkSession, d: str) -> DataFrame:
    """The first round's attraction edges."""
    return vectors.emscan(nearest_edges(s, d), seeds(s, d), 1)[2].withColumn("weight", F.round("weight", 6))


@query("isolated_seeds", f"WITH {_EDGES}, {_CAND}, a AS (SELECT src, dst FROM rk WHERE r = 0 AND inside = 1) SELECT idx, 0 AS it FROM c WHERE idx IN (SELECT src FROM a UNION SELECT dst FROM a) UNION ALL SELECT src, 1 FROM a")
def isolated_seeds(s: SparkSession, d: str) -> DataFrame:
    """L23."""
    _, nodes, graph = vectors.emscan(nearest_edges(s, d), seeds(s, d), 1)
    return vectors.without_isolated_seeds(nodes, graph)


_CENT = f"{_EMB}, m0 AS (SELECT list, unnest(v) AS x, unnest(range(len(v))) AS d FROM e), m AS (SELECT list, d, avg(x) AS x FROM m0 GROUP BY ALL), cn0 AS (SELECT list, list(x ORDER BY d) AS c FROM m GROUP BY list), cn AS (SELECT list, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM cn0)"
_ASSIGN = "asg AS (SELECT list, idx, assigned FROM (SELECT e.list, e.idx, cn.list AS assigned, row_number() OVER (PARTITION BY e.idx ORDER BY acos(greatest(-1.0, least(1.0, list_dot_product(e.v, cn.c)))) / pi(), cn.list) AS r FROM e, cn) WHERE r = 1)"


@query("centroid_stats", f"WITH {_CENT}, f AS (SELECT e.list, acos(greatest(-1.0, least(1.0, list_dot_product(e.v, cn.c)))) / pi() AS d FROM e JOIN cn USING (list)), st AS (SELECT list, count(*) AS n, max(d) AS mx, avg(d) AS mn, stddev_pop(d) AS sd FROM f GROUP BY list) SELECT list, n, round(mx, 6) AS max_distance, round(mn, 6) AS mean_distance, round(sd, 6) AS std_distance, round((SELECT count(*) FROM f WHERE f.list = st.list AND abs(f.d - st.mn) < st.sd) * 100.0 / n, 6) AS within_std FROM st")
def centroid_stats(s: SparkSession, d: str) -> DataFrame:
    """A15."""
    return vectors.centroid_statistics(embedded(s, d)).select("list", "n", *(F.round(c, 6).alias(c) for c in ("max_distance", "mean_distance", "std_distance", "within_std")))


@query("centroid_confusion", f"WITH {_CENT}, {_ASSIGN} SELECT list, assigned, count(*) AS n FROM asg GROUP BY ALL")
def centroid_confusion(s: SparkSession, d: str) -> DataFrame:
    """A16."""
    return vectors.confusion(embedded(s, d))


@query("centroid_members", f"WITH {_CENT}, {_ASSIGN} SELECT list, idx FROM asg WHERE list = assigned")
def centroid_members(s: SparkSession, d: str) -> DataFrame:
    """A17."""
    return vectors.centroid_members(embedded(s, d))


@query("mds")
def mds(s: SparkSession, d: str) -> DataFrame:
    """The lists' centroids in two dimensions."""
    cents = vectors.centroids(embedded(s, d)).select(F.xxhash64("list").alias("idx"), F.col("centroid").alias("vec"))
    return vectors.mds(cents).select("idx", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("densifier")
def densifier(s: SparkSession, d: str) -> DataFrame:
    """A direction learned from two lists as gold, all words ranked by it."""
    e = embedded(s, d)
    gold = e.where("list in ('list0', 'list1')").select("word", F.when(F.col("list") == "list0", 1).otherwise(-1).alias("value"))
    return vectors.project(e, vectors.densifier(e, gold)).select("word", F.round("score", 6).alias("score"))


@query("sparse_dot", f"WITH {_EMB}, q AS (SELECT * FROM e WHERE idx % 100 = 0) SELECT 'w' || a.idx AS a_word, 'w' || b.idx AS b_word, round(list_dot_product(a.v, b.v), 6) AS dot FROM q a, e b")
def sparse_dot(s: SparkSession, d: str) -> DataFrame:
    """X14 X15 on the stated query set."""
    e = embedded(s, d)
    return vectors.sparse_dot(vectors.to_sparse(e.where("idx % 100 = 0")), vectors.to_sparse(e)).withColumn("dot", F.round("dot", 6))


_TOP = f"{_EMB}, sp AS (SELECT list, idx, unnest(v) AS val, unnest(range(len(v))) AS topic FROM e), hi AS (SELECT * FROM sp WHERE val >= 0.2000001)"


def topics(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = embedded(s, d)
    return vectors.to_sparse(e).where("val >= 0.2000001"), e.select("list", "word")


@query("topic_stats", f"WITH {_TOP} SELECT list, topic::INTEGER AS topic, count(*) AS n FROM hi GROUP BY ALL HAVING count(*) <> 1")
def topic_stats(s: SparkSession, d: str) -> DataFrame:
    """A18 L24 O6."""
    return vectors.topic_statistics(*topics(s, d), filter_unique=True)


@query("topic_words", f"WITH {_TOP} SELECT list, topic::INTEGER AS topic, array_to_string(list('w' || idx ORDER BY 'w' || idx), ', ') AS words FROM hi GROUP BY ALL")
def topic_words(s: SparkSession, d: str) -> DataFrame:
    """A18 X26."""
    made = vectors.topic_words(*topics(s, d))
    return made.select("list", "topic", X.topic_repr(F.col("entries"), values=False).alias("words"))


# --- word lists ---------------------------------------------------------------------------------------------------------

_LISTS = r"wl AS MATERIALIZED (SELECT DISTINCT lang AS list, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents), n AS (SELECT word, count(*) AS n FROM wl GROUP BY word)"


def word_lists(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select(F.col("lang").alias("list"), F.explode(X.tokens(F.col("text"))).alias("word")).distinct()


@query("set_union", f"WITH {_LISTS} SELECT word FROM n")
def set_union(s: SparkSession, d: str) -> DataFrame:
    """U2."""
    return basic.union_words(word_lists(s, d))


@query("set_unique", f"WITH {_LISTS} SELECT list || '-unique' AS list, word FROM wl JOIN n USING (word) WHERE n = 1")
def set_unique(s: SparkSession, d: str) -> DataFrame:
    """U4."""
    return basic.unique_items(word_lists(s, d))


@query("set_common", f"WITH {_LISTS} SELECT list || '-common' AS list, word FROM wl JOIN n USING (word) WHERE n > 1")
def set_common(s: SparkSession, d: str) -> DataFrame:
    """U5."""
    return basic.common_items(word_lists(s, d))


@query("set_intersections", f"WITH {_LISTS} SELECT a.list || '-' || b.list AS list, word FROM wl a JOIN wl b USING (word) WHERE a.list < b.list")
def set_intersections(s: SparkSession, d: str) -> DataFrame:
    """U3."""
    return basic.intersections(word_lists(s, d))


@query("set_bitmask", f"WITH {_LISTS} SELECT word, sum(CASE list WHEN 'en' THEN 1 WHEN 'fr' THEN 2 ELSE 4 END)::BIGINT AS mask FROM wl WHERE list IN ('en', 'fr', 'de') GROUP BY word")
def set_bitmask(s: SparkSession, d: str) -> DataFrame:
    """U6 J14."""
    return basic.membership_mask(word_lists(s, d), ["en", "fr", "de"])


# --- definitions --------------------------------------------------------------------------------------------------------

_DEF = "df AS (SELECT p_partkey, lower(p_name) || '-' || p_partkey AS headword, lower(p_type || ' ' || p_brand || ' size' || p_size) AS definition FROM part)"
_BAG = f"{_DEF}, bg AS (SELECT DISTINCT headword, unnest(regexp_extract_all(definition, '[^\\s]+')) AS term FROM df)"


def definitions(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    return p.select(F.concat(F.lower("p_name"), F.lit("-"), F.col("p_partkey").cast("string")).alias("headword"), F.concat_ws(" ", "p_type", "p_brand", F.concat(F.lit("size"), F.col("p_size").cast("string"))).alias("definition"), "p_partkey")


@query("definition_vocabulary", f"WITH {_BAG} SELECT DISTINCT term FROM bg WHERE term NOT IN ({LISTED})")
def definition_vocabulary(s: SparkSession, d: str) -> DataFrame:
    """U8."""
    return lexicon.vocabulary(definitions(s, d), STOP)


_SIM = f"WITH {_BAG}, sz AS (SELECT headword, count(*) AS n FROM bg GROUP BY headword), q AS (SELECT b.* FROM bg b JOIN df USING (headword) WHERE p_partkey % 100 = 0), sh AS (SELECT q.headword AS word, b.headword, count(*) AS c, list(term ORDER BY term) AS common FROM q JOIN bg b USING (term) GROUP BY ALL)"


def _shared(s: SparkSession, d: str) -> DataFrame:
    own = definitions(s, d)
    return lexicon.shared_words(lexicon.bags(own, lexicon.vocabulary(own)), own.where("p_partkey % 100 = 0").select("headword"), whole=True)


@query("definition_similarity", _SIM + " SELECT word, sh.headword, round(c / sqrt(a.n * b.n::DOUBLE), 6) AS similarity FROM sh JOIN sz a ON a.headword = sh.headword JOIN sz b ON b.headword = sh.word")
def definition_similarity(s: SparkSession, d: str) -> DataFrame:
    """J12 X17, for the stated query set."""
    made = _shared(s, d).select("headword", "words", F.round(lexicon.cosine(), 6).alias("similarity"))
    return made.select(F.explode("words").alias("word"), "headword", "similarity")


@query("definition_common_words", _SIM + " SELECT word, headword, array_to_string(common, ' ') AS common FROM sh")
def definition_common_words(s: SparkSession, d: str) -> DataFrame:
    """X19."""
    made = _shared(s, d).select("headword", "words", F.array_join("common", " ").alias("common"))
    return made.select(F.explode("words").alias("word"), "headword", "common")


@query("definition_numbered", "WITH df AS (SELECT lower(string_split(p_name, ' ')[1]) AS headword, p_name || p_partkey AS definition FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY headword ORDER BY definition) AS n FROM df) SELECT CASE WHEN n = 1 THEN headword ELSE headword || '_' || n END AS headword, definition FROM n")
def definition_numbered(s: SparkSession, d: str) -> DataFrame:
    """Equal headwords told apart."""
    own = table(s, d, "part").select(F.lower(F.split("p_name", " ")[0]).alias("headword"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("definition"))
    return lexicon.numbered(own)


@query("definition_index", r"WITH df AS (SELECT p_name || '_' || p_partkey AS headword, unnest(regexp_extract_all(p_type, '[^\s]+')) AS term FROM part) SELECT headword, array_to_string(list(DISTINCT term ORDER BY term), ' ') AS words FROM df WHERE term IN ('STEEL', 'COPPER', 'TIN', 'ECONOMY') GROUP BY headword")
def definition_index(s: SparkSession, d: str) -> DataFrame:
    """J13 A19."""
    own = table(s, d, "part").select(F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string")).alias("headword"), F.col("p_type").alias("definition"))
    words = s.createDataFrame([("STEEL",), ("COPPER",), ("TIN",), ("ECONOMY",)], "word string")
    return lexicon.headwords_of(own, words).select("headword", F.array_join("words", " ").alias("words"))


from . import catalog_files  # noqa: E402, F401  registers the queries that write files and read them back
