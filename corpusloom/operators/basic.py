"""Projections, filters, collectors, sorting and set operations on any table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def row_bytes(df: DataFrame) -> Column:
    """About the size of a row: texts by their bytes, lists by their elements, 8 for all else."""
    width = F.lit(0).cast("long")
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        own = F.octet_length(c) + 8 if kind in ("string", "binary") else F.size(c) * 16 + 8 if kind in ("array", "map") else F.lit(8)
        width = width + F.coalesce(own, F.lit(8))
    return width


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hinted to be broadcast if it has no more rows and bytes than that, looked at without reading more; else left to a
    shuffle."""
    seen = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if seen["n"] <= rows and seen["b"] <= size else df


# --- projections --------------------------------------------------------------------------------------------------------


def delete_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """[P1]"""
    return df.drop(*fields)


def retain_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """[P2] absent fields are ignored; rows left without any value are dropped."""
    kept = [c for c in df.columns if c in set(fields)]
    made = df.select(*kept)
    return made.dropna(how="all") if kept else made.limit(0)


def get_field(df: DataFrame, field: str) -> DataFrame:
    """[P3] one field as the document; falsy values are dropped."""
    return df.where(X.truthy_field(df, field)).select(field)


def new_field(df: DataFrame, expression: str | Column, name: str) -> DataFrame:
    """[P4 E1] a column from a SQL expression."""
    return df.withColumn(name, F.expr(expression) if isinstance(expression, str) else expression)


# --- filters ------------------------------------------------------------------------------------------------------------


def filter_document(df: DataFrame, expression: str | Column) -> DataFrame:
    """[L1] rows for which a SQL expression holds; errors and nulls drop a row."""
    return df.where(expression)


def in_set(df: DataFrame, field: str, items: DataFrame) -> DataFrame:
    """[J1] rows whose field is in the one-column set."""
    members = items.select(F.col(items.columns[0]).alias("_item")).distinct()
    return df.join(broadcast_if_small(members), df[field] == F.col("_item"), "left_semi")


def not_in_set(df: DataFrame, field: str, items: DataFrame) -> DataFrame:
    """[J2] rows whose field has a value that isn't in the set; nulls are dropped."""
    members = items.select(F.col(items.columns[0]).alias("_item")).distinct()
    return df.where(df[field].isNotNull()).join(broadcast_if_small(members), df[field] == F.col("_item"), "left_anti")


def filter_empty(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """[L2] rows in which any of the fields is present and full."""
    found = F.lit(False)
    for f in fields:
        if f in df.columns:
            found = found | X.truthy_field(df, f)
    return df.where(found)


def filter_dict_field(df: DataFrame, field: str, condition: Callable[[Column, Column], Column]) -> DataFrame:
    """[L5] a map column with the entries for which condition(key, value) holds."""
    return df.withColumn(field, X.filter_map(F.col(field), condition))


def filter_dict_field_by_set(df: DataFrame, field: str, items: DataFrame, key: str) -> DataFrame:
    """[L5] a map column with the keys in a set of any size; key names a unique column of df."""
    members = items.select(F.col(items.columns[0]).alias("_k")).distinct()
    entries = df.select(key, F.explode(field).alias("_k", "_v")).join(members, "_k", "left_semi")
    kept = entries.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_m"))
    made = df.join(kept, key, "left")
    empty = F.when(F.col(field).isNotNull(), F.map_filter(field, lambda k, v: F.lit(False)))
    return made.withColumn(field, F.coalesce("_m", empty)).select(*df.columns)


# --- collectors ---------------------------------------------------------------------------------------------------------


def doc_count(df: DataFrame) -> DataFrame:
    """[A1]"""
    return df.agg(F.count("*").alias("n"))


def field_sum(df: DataFrame, field: str) -> DataFrame:
    """[A2] sum; null for no rows."""
    return df.agg(F.sum(field).alias("total"))


def dict_aggregate(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """[A3] count maps summed key by key, as rows (field, key, value); missing maps count as empty."""
    parts = [df.select(F.lit(f).alias("field"), F.explode(f).alias("key", "value")) for f in fields]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("field", "key").agg(F.sum("value").alias("value"))


def dict_aggregate_lists(df: DataFrame, field: str, order: str) -> DataFrame:
    """[A3] list-valued maps: lists of a key concatenated in the rows' order."""
    entries = df.select(F.col(order).alias("_o"), F.explode(field).alias("key", "value"))
    return entries.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_o", "value"))), lambda e: e["value"])).alias("value"))


def word_counts(df: DataFrame, field: str, strict: bool = False) -> DataFrame:
    """[A8] lines, words and chars over the table."""
    wc = df.select(X.word_count(F.col(field), strict).alias("wc")) if field in df.columns else df.select(X.word_count(F.lit(None).cast("string"), strict).alias("wc"))
    return wc.agg(*(F.sum(f"wc.{c}").alias(c) for c in ("lines", "words", "chars")))


def collect_list(df: DataFrame, num_records: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """[A10] all rows, or the first so many (0: none)."""
    if num_records is None:
        return df
    return (df.orderBy(*order) if order else df).limit(num_records)


def collect_set(df: DataFrame) -> DataFrame:
    """[A11]"""
    return df.distinct()


def sorter(df: DataFrame, fields: Sequence[tuple[str, bool]], num_records: int = 0, tie: Sequence[str] = ()) -> DataFrame:
    """[O1 O2] by (field, reverse) pairs, nulls last, ties by further columns; the first so many (0: all)."""
    order = [F.col(f).desc_nulls_last() if r else F.col(f).asc_nulls_last() for f, r in fields]
    out = df.orderBy(*order, *[F.col(t).asc_nulls_last() for t in tie])
    return out.limit(num_records) if num_records else out


def two_level_top(df: DataFrame, fields: Sequence[tuple[str, bool]], part: str, first: int, then: int, tie: Sequence[str] = ()) -> DataFrame:
    """[O2] the top of each part, then the top of these; fewer than the true top where a part's own is cut short."""
    order = [F.col(f).desc_nulls_last() if r else F.col(f).asc_nulls_last() for f, r in fields] + [F.col(t).asc_nulls_last() for t in tie]
    if first:
        df = df.withColumn("_n", F.row_number().over(W.partitionBy(part).orderBy(*order))).where(F.col("_n") <= first).drop("_n")
    return sorter(df, fields, then, tie)


# --- word lists as (list, word) rows ------------------------------------------------------------------------------------


def union_words(lists: DataFrame) -> DataFrame:
    """[U2] distinct words of all lists."""
    return lists.select("word").distinct()


def intersections(lists: DataFrame) -> DataFrame:
    """[U3] words two lists share, under the name "a-b" with a before b."""
    pairs = lists.distinct()
    other = pairs.select(F.col("list").alias("other"), "word")
    return pairs.join(other, "word").where("list < other").select(F.concat_ws("-", "list", "other").alias("list"), "word")


def _shared(lists: DataFrame) -> DataFrame:
    return lists.distinct().groupBy("word").agg(F.count("*").alias("_n"))


def unique_items(lists: DataFrame) -> DataFrame:
    """[U4] words of one list only, under "<list>-unique"."""
    return lists.distinct().join(_shared(lists).where("_n = 1").select("word"), "word").select(F.concat("list", F.lit("-unique")).alias("list"), "word")


def common_items(lists: DataFrame) -> DataFrame:
    """[U5] words a list shares with another, under "<list>-common"."""
    return lists.distinct().join(_shared(lists).where("_n > 1").select("word"), "word").select(F.concat("list", F.lit("-common")).alias("list"), "word")


def membership_mask(lists: DataFrame, names: Sequence[str]) -> DataFrame:
    """[U6] sum of 2^i over the lists a word is in."""
    number = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    ids = lists.where(F.col("list").isin(list(names))).select("word", F.expr("1L").alias("one"), number[F.col("list")].alias("i"))
    return ids.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.col("one"), F.col("i"))).alias("mask"))
