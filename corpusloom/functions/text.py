"""Column -> Column functions on strings, token lists and count maps.  SURVEY ids are given in brackets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WordFilter = Callable[[Column], Column]
TOKEN = r"[\p{L}\p{N}]+"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often, or within which lambda, it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def truthy(column: Column, kind: T.DataType) -> Column:
    """Python's idea of a non-empty value (1.4): no null, empty string or collection, zero or False; NaN counts as full."""
    if isinstance(kind, T.StringType):
        full = column != ""
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        full = F.size(column) > 0
    elif isinstance(kind, T.BooleanType):
        full = column
    elif isinstance(kind, T.NumericType):
        full = column != 0
    elif isinstance(kind, T.BinaryType):
        full = F.octet_length(column) > 0
    else:
        full = F.lit(True)
    return F.coalesce(column.isNotNull() & full, F.lit(False))


def truthy_field(df: DataFrame, name: str) -> Column:
    return truthy(df[name], df.schema[name].dataType)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def split_words(text: Column) -> Column:
    """White-space separated words, as Unicode has white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def word_count(text: Column, strict: bool = False) -> Column:
    """[X8] lines, words, chars of a text; a missing text gives zeros.

    By default a final line feed adds a line (quirk Q3); strict counts an unfinished last line instead, as is usual.
    """
    t = F.coalesce(text, F.lit(""))
    feeds = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    ends = F.endswith(t, F.lit("\n"))
    last = F.when(~ends & (t != ""), 1).otherwise(0) if strict else F.when(ends, 1).otherwise(0)
    return F.struct((feeds + last).cast("long").alias("lines"), F.size(split_words(t)).cast("long").alias("words"), F.length(t).cast("long").alias("chars"))


# --- annotated tokens ---------------------------------------------------------------------------------------------------


def column_number(which: str | int) -> int:
    """[X7] "word" is column 0, "lemma" 1; a number stands for itself."""
    if isinstance(which, int) and not isinstance(which, bool):
        return which
    try:
        return {"word": 0, "lemma": 1}[which]
    except KeyError:
        raise ValueError(f"no such token column: {which!r}") from None


def conll_lists(sentences: Column, column: str | int = "lemma", lower: bool = False, proper_noun: str | None = None) -> Column:
    """[X1 X4] one list of converted tokens a sentence.

    White space within a token becomes "_"; proper_noun replaces tokens whose part of speech (column 2) begins with NNP,
    and is not lower-cased itself.
    """
    k = column_number(column)

    def convert(token: Column) -> Column:
        out = F.regexp_replace(F.regexp_replace(F.get(token, F.lit(k)), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", "_")
        out = F.lower(out) if lower else out
        return out if proper_noun is None else F.when(F.startswith(F.get(token, F.lit(2)), F.lit("NNP")), proper_noun).otherwise(out)

    return F.transform(sentences, lambda s: F.transform(s, convert))


def conll_list(sentences: Column, column: str | int = "lemma", lower: bool = False, proper_noun: str | None = None) -> Column:
    """[X3] all tokens in one list."""
    return F.flatten(conll_lists(sentences, column, lower, proper_noun))


def conll_set(sentences: Column, column: str | int = "lemma", lower: bool = False, proper_noun: str | None = None) -> Column:
    """[X5] distinct tokens, first come first."""
    return F.array_distinct(conll_list(sentences, column, lower, proper_noun))


def conll_counts(sentences: Column, column: str | int = "lemma", lower: bool = False, proper_noun: str | None = None) -> Column:
    """[X2] token -> count."""
    return counts(conll_list(sentences, column, lower, proper_noun))


def conll_text(sentences: Column, column: str | int = "lemma", lower: bool = False, proper_noun: str | None = None) -> Column:
    """[X6] a line a sentence, tokens joined by blanks."""
    return F.array_join(F.transform(conll_lists(sentences, column, lower, proper_noun), lambda s: F.array_join(s, " ")), "\n")


# --- counts -------------------------------------------------------------------------------------------------------------


def counts(items: Column) -> Column:
    """[A12] value -> count of a token list: runs of the sorted list, so the cost is that of sorting."""

    def entries(ordered: Column) -> Column:
        n = F.size(ordered)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (n > 0) & ((i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))))
        runs = lambda first: F.zip_with(first, F.slice(F.concat(first, F.array(n)), 2, F.size(first)), lambda a, b: F.struct(F.get(ordered, a), (b - a).cast("long")))
        return bind(starts, runs)

    return F.map_from_entries(F.when(items.isNotNull(), bind(F.sort_array(items), entries)))


def add_counts(a: Column, b: Column) -> Column:
    """[A3] sum of two count maps, key by key."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.element_at(a, k), F.lit(0)) + F.coalesce(F.element_at(b, k), F.lit(0))))


def total(counts_map: Column) -> Column:
    return F.aggregate(F.map_values(counts_map), F.lit(0).cast("double"), lambda s, x: s + x)


# --- word filters -------------------------------------------------------------------------------------------------------


def stop_word_filter(words: Sequence[str] | None = None) -> WordFilter:
    """[L7] not in the stop-word list, exact case; by default Spark's English list."""
    if words is None:
        from pyspark.ml.feature import StopWordsRemover

        words = StopWordsRemover.loadDefaultStopWords("english")
    listed = [str(w) for w in words]
    return lambda x: ~x.isin(listed)


def long_word_filter(length: int) -> WordFilter:
    """[L8] at most that many characters."""
    return lambda x: F.length(x) <= length


def alnum_filter() -> WordFilter:
    """[L9] holds an ASCII letter or digit."""
    return lambda x: F.rlike(x, F.lit("[a-zA-Z0-9]"))


def all_filter(filters: Sequence[WordFilter] | None) -> WordFilter:
    """[L10] all of them; none means true."""
    filters = list(filters or [])

    def run(x: Column) -> Column:
        out = F.lit(True)
        for f in filters:
            out = out & f(x)
        return out

    return run


def filter_words(items: Column, filters: Sequence[WordFilter] | None = None) -> Column:
    """[L6] the list's elements that pass."""
    valid = all_filter(filters)
    return F.filter(items, lambda x: valid(x))


def filter_map(counts_map: Column, condition: Callable[[Column, Column], Column]) -> Column:
    """[L5] the map's entries for which condition(key, value) holds."""
    return F.map_filter(counts_map, condition)


# --- sequences ----------------------------------------------------------------------------------------------------------


def bigrams(items: Column, filters: Sequence[WordFilter] | None = None) -> Column:
    """[W1] adjacent pairs "a b" whose two words pass; lists of fewer than two words give an empty list."""
    valid = all_filter(filters)

    def run(own: Column) -> Column:
        n = F.greatest(F.size(own) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(own, 1, n), F.slice(own, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        if filters:
            pairs = F.filter(pairs, lambda p: valid(p["a"]) & valid(p["b"]))
        return F.transform(pairs, lambda p: F.concat_ws(" ", p["a"], p["b"]))

    return bind(items, run)


def shingles(items: Column, n: int = 5) -> Column:
    """[W2] distinct runs of n items, joined by blanks; none where there are fewer."""

    def runs(own: Column) -> Column:
        size = F.size(own)
        return F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(own, i, n), " ")))

    return F.array_distinct(F.coalesce(bind(items, runs), F.array().cast("array<string>")))


def characters(text: Column) -> Column:
    """A string as the list of its characters, for character shingles."""
    return F.split(text, "")


def bigrams_of_unigrams(pairs: Column, unigrams: Column, pairs_are_map: bool = False, unigrams_are_map: bool = False) -> Column:
    """[L12] bigrams both of whose words are unigrams of the same document, lists or maps on either side.

    Keys that aren't two words are left out (Q19).
    """

    def among(own: Column) -> Column:
        known = lambda word: F.map_contains_key(own, word) if unigrams_are_map else F.array_contains(own, word)

        def both(b: Column) -> Column:
            return bind(F.split(b, " "), lambda parts: (F.size(parts) == 2) & F.coalesce(known(F.get(parts, F.lit(0))) & known(F.get(parts, F.lit(1))), F.lit(False)))

        return F.map_filter(pairs, lambda k, _: both(k)) if pairs_are_map else F.filter(pairs, both)

    return bind(unigrams, among)


def bigrams_of_set(pairs: Column, words: Column, pairs_are_map: bool = False) -> Column:
    """[L11] bigrams both of whose words are in a given set (an array column or literal); see quirk Q1."""
    return bigrams_of_unigrams(pairs, words, pairs_are_map)


# --- names and numbers --------------------------------------------------------------------------------------------------


def base_name(path: Column) -> Column:
    """[X21] the last part of a path without its extensions."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^/]*)?$", 1)


def set_name(path: Column) -> Column:
    """[X21] a word list's name: the file's, without an extension of three characters."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]{3}$", "")


def replace_extension(path: Column, extension: str) -> Column:
    """[X22] json or txt (before any compression suffix) replaced; other names stay."""
    return F.regexp_replace(path, r"\.(?:json|txt)(?=(?:\.(?:gz|bz2))?$)", f".{extension}")


def item_getter(items: Column, *positions: int, defaults: Sequence[object] = ()) -> list[Column]:
    """[X23] the elements at some positions, or the defaults where the list is short."""
    padded = [*defaults, *[None] * (len(positions) - len(defaults))]
    return [F.coalesce(F.get(items, F.lit(p)), F.lit(d)) for p, d in zip(positions, padded, strict=True)]


def topic_repr(entries: Column, values: bool, digits: int = 2) -> Column:
    """[X26] "word [0.12]" by descending value, else the sorted words; entries are structs (word, val)."""
    if not values:
        return F.array_join(F.array_sort(F.transform(entries, lambda e: e["word"])), ", ")
    ordered = F.array_sort(F.transform(entries, lambda e: F.struct((-e["val"]).alias("k"), e["word"].alias("word"))))
    return F.array_join(F.transform(ordered, lambda e: F.concat(e["word"], F.lit(" ["), F.format_number(-e["k"], digits), F.lit("]"))), ", ")
