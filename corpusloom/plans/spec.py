"""Pipelines from JSON specifications.

A specification names registered steps; no code is imported or evaluated from it.

    {"pipeline": [{"step": "filter_empty", "fields": ["content"]}, ...],
     "source": {"format": "json", "path": "$input", "schema": "url string, content string"},
     "reducer": {"step": ...}, "sink": {"format": "json", "path": "$output"}}

A step may carry "connection": "map" (values are dropped when falsy, the default of maps) or "filter" (rows are kept where
the result is truthy, the default of filters).
"""

from __future__ import annotations

import json
import string
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import annotate, basic, dedup, filters, search, stats
from ..sources import readers, webarchive, writers

Step = Callable[[DataFrame], DataFrame]
STEPS: dict[str, Callable[..., Step]] = {}
KINDS: dict[str, str] = {}
PRESETS = Path(__file__).parent / "presets"


def step(name: str, kind: str = "map") -> Callable[[Callable[..., Step]], Callable[..., Step]]:
    """[F10 E2] Registers a maker of steps under a name; kind is "map", "filter" or "collector" (F4-F6)."""

    def put(f: Callable[..., Step]) -> Callable[..., Step]:
        STEPS[name], KINDS[name] = f, kind
        return f

    return put


def _register(name: str, kind: str, function: Callable[..., DataFrame]) -> None:
    STEPS[name], KINDS[name] = lambda **kw: lambda df: function(df, **kw), kind


for _name, _kind, _function in (
    ("delete_fields", "map", basic.delete_fields), ("retain_fields", "map", basic.retain_fields), ("get_field", "map", basic.get_field),
    ("new_field", "map", basic.new_field), ("filter_document", "filter", basic.filter_document), ("filter_empty", "filter", basic.filter_empty),
    ("language_filter", "filter", filters.language_filter), ("domain_filter", "filter", filters.domain_filter), ("annotate", "map", annotate.annotate),
    ("doc_count", "collector", basic.doc_count), ("sum", "collector", basic.field_sum), ("dict_aggregate", "collector", basic.dict_aggregate),
    ("word_counts", "collector", basic.word_counts), ("collect", "collector", basic.collect_list), ("collect_set", "collector", basic.collect_set),
    ("tf_df", "collector", stats.tf_df), ("filter_df", "map", stats.filter_df), ("search", "map", search.search_maps),
):
    _register(_name, _kind, _function)


@step("in_set", "filter")
def _in_set(field: str, set_file: str, retain: bool = True) -> Step:
    return lambda df: (basic.in_set if retain else basic.not_in_set)(df, field, readers.word_set(df.sparkSession, set_file))


@step("sort", "collector")
def _sort(fields: Sequence[Sequence[Any]], num_records: int = 0, tie: Sequence[str] = ()) -> Step:
    return lambda df: basic.sorter(df, [(f, bool(r)) for f, r in fields], num_records, tie)


def _conll(function: Callable[..., Any]) -> Callable[..., Step]:
    def make(fields: Mapping[str, Any]) -> Step:
        """[X7] {field: [column, lower, proper noun, delete, new field]}, or the same by name."""

        def run(df: DataFrame) -> DataFrame:
            for field, how in fields.items():
                named = dict(zip(("column", "lower", "convert_nnps", "delete", "new_field"), how, strict=False)) if isinstance(how, list) else dict(how)
                if field not in df.columns:
                    continue
                made = function(df[field], named.get("column", "lemma"), bool(named.get("lower", False)), named.get("convert_nnps") or None)
                df = df.withColumn(named.get("new_field") or field, made)
                if named.get("delete") and (named.get("new_field") or field) != field:
                    df = df.drop(field)
            return df

        return run

    return make


for _name, _function in (("conll_to_list", X.conll_list), ("conll_to_lists", X.conll_lists), ("conll_to_set", X.conll_set), ("conll_to_counts", X.conll_counts), ("conll_to_text", X.conll_text)):
    STEPS[_name], KINDS[_name] = _conll(_function), "map"

WORD_FILTERS: dict[str, Callable[..., X.WordFilter]] = {"stop_words": X.stop_word_filter, "long_words": X.long_word_filter, "alnum": X.alnum_filter}


def word_filters(configs: Sequence[Mapping[str, Any]] | None) -> list[X.WordFilter]:
    """[E6] filters of {"filter": name, ...} entries."""
    return [WORD_FILTERS[c["filter"]](**{k: v for k, v in c.items() if k != "filter"}) for c in configs or []]


@step("filter_words")
def _filter_words(fields: Sequence[str], filters: Sequence[Mapping[str, Any]] | None = None) -> Step:
    return lambda df: df.withColumns({f: X.filter_words(df[f], word_filters(filters)) for f in fields if f in df.columns})


@step("filter_dict")
def _filter_dict(field: str, expression: str) -> Step:
    """[L5] expression is SQL over k and v."""
    return lambda df: df.withColumn(field, F.expr(f"map_filter(`{field}`, (k, v) -> {expression})"))


@step("bigrams")
def _bigrams(fields: Mapping[str, str], overwrite: bool = False, filters: Sequence[Mapping[str, Any]] | None = None) -> Step:
    """[W1] {token field: bigram field}; an existing bigram field stays unless overwrite."""
    return lambda df: df.withColumns({new: X.bigrams(df[old], word_filters(filters)) for old, new in fields.items() if old in df.columns and (overwrite or new not in df.columns)})


@step("bigrams_of_unigrams")
def _bigram_filter(fields: Mapping[str, str]) -> Step:
    """[L12] {bigram field: unigram field}."""

    def run(df: DataFrame) -> DataFrame:
        is_map = lambda f: df.schema[f].dataType.typeName() == "map"
        return df.withColumns({b: X.bigrams_of_unigrams(df[b], df[u], is_map(b), is_map(u)) for b, u in fields.items()})

    return run


@step("counts")
def _counts(fields: Sequence[str]) -> Step:
    """[A12] <field>_counts of token lists."""
    return lambda df: df.withColumns({f"{f}_counts": X.counts(df[f]) for f in fields if f in df.columns})


@step("tokens")
def _tokens(field: str, new_field: str = "lemmas") -> Step:
    return lambda df: df.withColumn(new_field, X.tokens(df[field]))


@step("minhash")
def _minhash(fields: Sequence[str], key: str, shingles: int = 5, num_perm: int = 128, keep_short: bool = False, keep: Sequence[str] = ()) -> Step:
    """[X12] key, minhash over the union of the fields' shingles and the fields to keep; strings give character shingles."""

    def run(df: DataFrame) -> DataFrame:
        lists = [X.shingles(X.characters(df[f]) if df.schema[f].dataType.typeName() == "string" else df[f], shingles) for f in fields if f in df.columns]
        return dedup.signatures(df, key, F.array_distinct(F.concat(*lists)), num_perm, keep_short, keep)

    return run


@step("lsh", "collector")
def _lsh(id_field: str, threshold: float, num_perm: int = 128, out_field: str | None = None) -> Step:
    """[A9] out_field (id_field by default) of the documents that survive near-duplicate elimination.

    Documents come in the order of out_field, record ids ("<file>-<line>") by file and line; one whose id came before goes,
    too.
    """

    def run(df: DataFrame) -> DataFrame:
        bands, rows = dedup.bands_for(threshold, num_perm)
        out = F.col(out_field or id_field)
        text = out.cast("string")
        order = F.struct(F.regexp_replace(text, r"-\d+$", "").alias("file"), F.regexp_extract(text, r"-(\d+)$", 1).try_cast("long").alias("line"), out.alias("out"))
        df = df.withColumn("_order", order)
        kept = dedup.survivors(dedup.buckets(df, "_order", bands, rows), "_order", df.select("_order", id_field) if out_field else None)
        return kept.select(F.col("_order.out").alias(out_field or id_field))

    return run


@step("main_text")
def _main_text(field: str, new_field: str = "content", extractor: str = "boilerpipe") -> Step:
    return lambda df: df.withColumn(new_field, webarchive.main_text(df[field], extractor))


# --- reading and running ------------------------------------------------------------------------------------------------


def config_file(name: str) -> str:
    """the text of a specification: a path, or the name of a packaged one."""
    for path in (Path(name), PRESETS / name, PRESETS / f"{name}.json"):
        if path.is_file():
            return path.read_text(encoding="utf-8")
    raise ValueError(f"no such specification: {name!r}")


def load(text: str, **variables: Any) -> dict[str, Any]:
    """[F12 Q14] a specification with $variables put in; those left over are named in an error.

    A variable that stands for a whole JSON value, quotes and all, keeps its type: "$num_docs" with num_docs=100 is 100.
    """
    for key, value in variables.items():
        if not isinstance(value, str):
            text = text.replace(f'"${key}"', json.dumps(value))
    filled = string.Template(text).safe_substitute(**{k: v if isinstance(v, str) else json.dumps(v) for k, v in variables.items()})
    left = sorted({m["named"] or m["braced"] for m in string.Template.pattern.finditer(filled) if m["named"] or m["braced"]})
    if left:
        raise ValueError(f"variables without a value: {', '.join(left)}")
    return json.loads(filled)


def build(configs: Sequence[Mapping[str, Any]]) -> Step:
    """[F7-F9] one function of the steps, in order; unknown names and arguments are errors at once."""
    made: list[Step] = []
    for c in configs:
        name = c.get("step")
        if name not in STEPS:
            raise ValueError(f"no such step: {name!r}")
        arguments = {k: v for k, v in c.items() if k not in ("step", "connection")}
        own = STEPS[name](**arguments)
        connection = c.get("connection")
        if connection not in (None, "map", "filter"):
            raise ValueError(f"no such connection: {connection!r}")
        made.append(_connected(own, KINDS[name], connection, name, arguments))
    return lambda df: reduce(lambda d, f: f(d), made, df)


def _connected(own: Step, kind: str, connection: str | None, name: str, arguments: Mapping[str, Any]) -> Step:
    if connection is None or connection == kind or kind == "collector":
        return own
    if kind == "filter" and name == "filter_document":  # as a map it yields the boolean, and falsy results are dropped
        return lambda df: df.select(F.expr(arguments["expression"]).alias("value")).where("value")
    if kind == "map" and name == "get_field":  # as a filter it keeps the row where the value is full
        return lambda df: df.where(X.truthy_field(df, arguments["field"]))
    if kind == "map" and name == "retain_fields":
        return lambda df: df.dropna(how="all", subset=[c for c in df.columns if c in set(arguments["fields"])])
    if kind == "filter":
        return lambda df: _marked(df, own).where("value").select("value")
    return lambda df: _marked(df, own).where("value").select(*df.columns)


def _marked(df: DataFrame, own: Step) -> DataFrame:
    """df with value: whether the step leaves anything of the row.  Steps drop, keep or change rows, never repeat them."""
    rows = df.withColumn("_row", F.struct(*df.columns))
    left = own(rows)
    if "_row" not in left.columns:  # the step keeps its own columns only; a row it lets through is not empty
        raise ValueError("a step that drops columns has no other connection")
    return left.select("_row.*", F.lit(True).alias("value"))


def read(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    """The source of a specification: json, text, conll, warc, parquet."""
    kind, path = config["format"], config["path"]
    if kind == "json":
        from pyspark.sql.types import StructType

        schema = StructType.fromDDL(config["schema"])
        return readers.json_documents(spark, path, schema, config.get("on_error", "fail"), config.get("add_id"))
    if kind == "text":
        return readers.text_documents(spark, path)
    if kind == "conll":
        return readers.conll_documents(spark, path)
    if kind == "warc":
        return webarchive.warc_documents(spark, path, config.get("extractor", "boilerpipe"))
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no such source: {kind!r}")


def write(df: DataFrame, config: Mapping[str, Any]) -> None:
    """The sink of a specification: json, reduced_json, reduced_tsv, parquet."""
    kind, path = config["format"], config["path"]
    sinks = {"json": writers.json_lines, "reduced_json": writers.reduced_json, "reduced_tsv": writers.reduced_tsv, "parquet": lambda d, p: d.write.parquet(p)}
    if kind not in sinks:
        raise ValueError(f"no such sink: {kind!r}")
    sinks[kind](df, path)


def run(spark: SparkSession, spec: Mapping[str, Any], source: DataFrame | None = None) -> DataFrame:
    """the specification's result; it is written, too, where a sink is named.  A reducer works on the whole."""
    df = source if source is not None else read(spark, spec["source"])
    out = build([*spec.get("pipeline", []), *([spec["reducer"]] if spec.get("reducer") else [])])(df)
    if spec.get("sink"):
        write(out, spec["sink"])
    return out
