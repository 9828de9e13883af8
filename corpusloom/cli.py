"""Command line: python -m corpusloom COMMAND ....  Tables are read and written by Spark, so any path it knows will do."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import topic_repr
from .operators import basic, filters, lexicon, stats, vectors  # noqa: F401  filters registers detectors
from .plans import spec
from .session import session
from .sources import readers, webarchive, writers


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *positional: str) -> argparse.ArgumentParser:
        own = commands.add_parser(name, help=text)
        for p in positional:
            own.add_argument(p)
        return own

    p = command("run", "run a specification", "config")
    p.add_argument("-i", "--input", action="append", default=[])
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-R", dest="variables", action="append", default=[], metavar="KEY=VALUE")
    p = command("ingest", "WARC files to JSON lines", "output")
    p.add_argument("warc", nargs="+")
    p.add_argument("-e", "--extractor", choices=sorted(webarchive.EXTRACTORS), default="boilerpipe")
    p = command("weight-words", "IDF or log TF ratio", "stats", "output")
    p.add_argument("-t", "--threshold", type=float)
    p.add_argument("-w", "--words")
    p.add_argument("-n", "--documents", type=int, help="number of documents, for IDF")
    p.add_argument("-b", "--base", help="statistics of the whole corpus, for the ratio")
    p.add_argument("-p", "--print-dfs", action="store_true")
    p = command("weight-query", "a query's words with their weights", "query", "weights", "output")
    p.add_argument("-t", "--threshold", type=float)
    p = command("select-terms", "terms within bounds, against a query", "terms", "query", "output")
    p.add_argument("-s", "--sort", default="rdw")
    p.add_argument("-c", "--which", choices=("all", "new", "query", "missing"), default="all")
    p.add_argument("--unchecked", action="store_true", help="terms that don't look like words, too")
    for kind in ("ur", "br", "udf", "bdf", "uedf", "bedf", "udfr", "bdfr"):
        for side in ("min", "max"):
            p.add_argument(f"--{side}-{kind}", type=float)
    p = command("filter-tfdf", "drop rare terms", "input", "output")
    p.add_argument("-f", "--field", action="append", required=True)
    p.add_argument("-u", "--min-unigram", type=int, default=0)
    p.add_argument("-b", "--min-bigram", type=int, default=0)
    p.add_argument("-c", "--cross", action="store_true")
    p = command("join-tfdf", "add statistics up", "output")
    p.add_argument("files", nargs="+")
    p.add_argument("-a", "--all-fields", action="store_true")
    p.add_argument("-f", "--field", action="append")
    p = command("json-to-tsv", "fields of JSON lines as TSV", "input", "output")
    p.add_argument("-f", "--field", action="append", required=True)
    p = command("knn", "nearest words", "vectors", "queries", "output")
    p.add_argument("-k", type=int, default=10)
    p.add_argument("-s", "--min-similarity", type=float, default=0.0)
    p.add_argument("-F", "--freqs")
    p.add_argument("-m", "--min-freq", type=int, default=0)
    p.add_argument("-n", "--normalize", action="store_true")
    p.add_argument("--self-contained", action="store_true")
    p.add_argument("--interactive", action="store_true", help="show the neighbours of each line of standard input instead of a file's")
    p = command("emscan", "grow a cluster of words", "vectors", "seeds", "output")
    p.add_argument("method", choices=("first", "dcg", "ratio"))
    p.add_argument("-s", "--min-similarity", type=float, default=0.5)
    p.add_argument("-c", "--max-cluster", type=int)
    p.add_argument("-i", "--iterations", type=int, default=100)
    p.add_argument("-g", "--graph")
    p.add_argument("-l", "--dcg-length", type=int, default=5)
    p.add_argument("-m", "--min-dcg", type=float, default=1.0)
    p = command("embedding-bounds", "centroid statistics of word lists (TSV list, word)", "vectors", "lists", "output")
    p.add_argument("--confusion", metavar="PATH", help="lists against the lists with the nearest centroid")
    p.add_argument("--write-real", metavar="PATH", help="list and word of the words nearest to their own list's centroid")
    p.add_argument("--sets", metavar="PATH", help="list and word of the lists' intersections, unique and common words")
    p = command("topic-stats", "topics of word lists (TSV list, word)", "vectors", "lists", "output")
    p.add_argument("--filter-unique", action="store_true")
    p.add_argument("--words", metavar="PATH", help="each topic's words, with their values")
    p = command("definition-similarity", "headwords with similar definitions", "dictionary", "words", "output")
    p.add_argument("-v", "--verbose", action="store_true", help="with the common words")
    p.add_argument("--stop-words", help="words that don't count, one a line")
    p.add_argument("--exclude", help="further words that don't count")
    command("def-to-hw", "headwords whose definitions have the words", "dictionary", "words", "output")
    command("densifier", "words by a direction learned from a gold list", "vectors", "gold", "output")
    command("mds", "two coordinates a word", "vectors", "output").add_argument("-d", "--distance", choices=("cos", "euc"), default="cos")
    return top


def _tsv(df: DataFrame, path: str) -> None:
    writers.reduced_tsv(df, path, mode="overwrite")


def main(arguments: Sequence[str] | None = None) -> None:
    a = _parser().parse_args(arguments)
    own_session = SparkSession.getActiveSession() is None
    spark = session()
    _run(a, spark)
    if own_session:
        spark.stop()


def _neighbours(spark: SparkSession, a: argparse.Namespace, lines: DataFrame) -> DataFrame:
    """Of value: lines of a word, or of a word and its vector."""
    table, freqs = readers.text_vectors(spark, a.vectors), readers.frequencies(spark, a.freqs) if a.freqs else None
    parts = F.split(F.trim("value"), " ")
    rows = lines.where(F.trim("value") != "").select(F.get(parts, F.lit(0)).alias("word"), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda x: x.try_cast("double")).alias("vec")).distinct()
    find = lambda queries: vectors.neighbours(table, queries, a.k, a.min_similarity, freqs, a.min_freq, a.normalize, a.self_contained)
    return find(rows.where(F.size("vec") == 0).select("word")).unionByName(find(rows.where(F.size("vec") > 0))).orderBy("query", "rank")


def _run(a: argparse.Namespace, spark: SparkSession) -> None:
    if a.command == "run":
        variables = dict(v.split("=", 1) for v in a.variables)
        text = spec.config_file(a.config)
        config = spec.load(text, input=a.input if len(a.input) > 1 else "".join(a.input), output=a.output, **{k: _value(v) for k, v in variables.items()})
        spec.run(spark, config)
    elif a.command == "ingest":
        writers.json_lines(webarchive.warc_documents(spark, a.warc, a.extractor), a.output)
    elif a.command == "weight-words":
        own, words = readers.term_stats_json(spark, a.stats), readers.word_set(spark, a.words) if a.words else None
        if a.base:
            made = stats.log_tf_ratio(own, readers.term_stats_json(spark, a.base), words, a.threshold, a.print_dfs)
        elif a.documents:
            made = stats.idf_weights(own, a.documents, words, a.threshold)
        else:
            raise SystemExit("--documents or --base is needed")
        _tsv(made, a.output)
    elif a.command == "weight-query":
        _tsv(stats.weight_query(readers.query_file(spark, a.query), readers.query_file(spark, a.weights), a.threshold), a.output)
    elif a.command == "select-terms":
        terms = spark.read.csv(a.terms, sep="\t", schema="term string, weight double, subset_df bigint, base_df bigint", quote="")
        bounds = {k: v for k, v in vars(a).items() if k.startswith(("min_", "max_"))}
        _tsv(stats.sort_terms(stats.select_terms(terms, readers.query_file(spark, a.query), a.which, sane=not a.unchecked, **bounds), a.sort), a.output)
    elif a.command == "filter-tfdf":
        own = readers.term_stats_json(spark, a.input)
        made = stats.filter_df(own, {f: a.min_bigram if "bigram" in f else a.min_unigram for f in a.field})
        if a.cross:
            made = stats.cross_filter(made, *sorted(a.field, key=lambda f: "bigram" in f)[:2])
        stats.report({"before": own, "after": made}).show(truncate=False)
        writers.term_stats(made, a.output)
    elif a.command == "join-tfdf":
        writers.term_stats(stats.merge([readers.term_stats_json(spark, f) for f in a.files], a.all_fields, a.field), a.output)
    elif a.command == "json-to-tsv":
        writers.fields_to_tsv(spark.read.json(a.input), a.field).write.text(a.output)
    elif a.command == "knn":
        if a.interactive:
            for line in sys.stdin:
                _neighbours(spark, a, spark.createDataFrame([(line,)], "value string")).show(truncate=False)
        else:
            _tsv(_neighbours(spark, a, spark.read.text(a.queries)), a.output)
    elif a.command == "emscan":
        table = vectors.normalized(readers.text_vectors(spark, a.vectors))
        seeds = table.join(readers.word_set(spark, a.seeds).withColumnRenamed("item", "word"), "word", "left_semi")
        how = {"dcg_length": a.dcg_length, "min_dcg": a.min_dcg} if a.method == "dcg" else {}
        members, nodes, graph = vectors.emscan(vectors.nearest_edges(table, a.min_similarity) if a.method == "first" else vectors.similarity_edges(table, a.min_similarity), seeds, a.iterations, a.max_cluster, a.method, **how)
        _tsv(table.join(members, "idx").select("word").orderBy("word"), a.output)
        if a.graph:
            with open(a.graph, "w", encoding="utf-8") as file:
                file.write(vectors.graphml(nodes, graph))
    elif a.command in ("embedding-bounds", "topic-stats"):
        lists = spark.read.csv(a.lists, sep="\t", schema="list string, word string", quote="")
        table = readers.text_vectors(spark, a.vectors)
        if a.command == "embedding-bounds":
            members = vectors.normalized(table).join(lists, "word")
            _tsv(vectors.centroid_statistics(members).orderBy("list"), a.output)
            if a.confusion:
                _tsv(vectors.confusion(members).orderBy("list", "assigned"), a.confusion)
            if a.write_real:
                _tsv(vectors.centroid_members(members).join(table.select("idx", "word"), "idx").select("list", "word").orderBy("list", "word"), a.write_real)
            if a.sets:
                _tsv(basic.intersections(lists).union(basic.unique_items(lists)).union(basic.common_items(lists)).orderBy("list", "word"), a.sets)
        else:
            sparse = vectors.to_sparse(table)
            _tsv(vectors.topic_statistics(sparse, lists, a.filter_unique), a.output)
            if a.words:
                _tsv(vectors.topic_words(sparse, lists).select("list", "topic", topic_repr(F.col("entries"), True).alias("words")).orderBy("list", "topic"), a.words)
    elif a.command in ("definition-similarity", "def-to-hw"):
        own, words = readers.dictionary(spark, a.dictionary, header=a.command == "definition-similarity"), readers.word_set(spark, a.words)
        if a.command == "def-to-hw":
            _tsv(lexicon.headwords_of(own, words), a.output)
        else:
            own = lexicon.numbered(own)
            without = None
            for path in (a.stop_words, a.exclude):
                if path:
                    listed = readers.word_set(spark, path)
                    without = listed if without is None else without.union(listed)
            _tsv(lexicon.similar(lexicon.bags(own, lexicon.vocabulary(own, (), without)), words, a.verbose).orderBy("word", F.desc("similarity"), "headword"), a.output)
    elif a.command == "densifier":
        table = readers.text_vectors(spark, a.vectors)
        _tsv(vectors.project(table, vectors.densifier(table, readers.gold_list(spark, a.gold, table))), a.output)
    elif a.command == "mds":
        table = readers.text_vectors(spark, a.vectors)
        _tsv(vectors.mds(table, a.distance).join(table.select("idx", "word"), "idx").select("word", "x", "y"), a.output)


def _value(text: str) -> object:
    import json

    try:
        return json.loads(text)
    except ValueError:
        return text
