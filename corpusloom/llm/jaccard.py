"""Exact n-gram Jaccard join by a token-group matrix.

Similar documents are partitioned into groups; a group keeps the union of its members' tokens; a query document opens a
group only if its overlap with that union could still meet the threshold.  Here tokens are hashed word n-grams and a
"document" is a class of documents with equal token sets, so exact copies cost one member whatever their number.

1. Each text gives its token set, the set's hash (the class) and its share in a fixed-size sketch of token counts.
2. Tokens are ordered by (sketched count, hash): any fixed order is exact, and this one puts shared passages last.  Only a
   class's first |s| - ceil(t|s|) + 1 tokens can be the first one it shares with a partner, so only these are indexed.
3. Leaders: each indexed token names the class where it stands first in order, the one with least text of its own; members
   are checked against their leaders and linked components become the groups.  This joins large sets of near copies in time linear in their number.
4. Matrix: indexed tokens by group, split in blocks of a bounded number of members.  A class is a query to a block of
   another group only if they share an indexed token and sizes and remaining positions leave enough overlap.
5. The query's overlap with the block's token union bounds every member's; blocks that qualify are opened and members
   checked one by one.  Components of all links are the result.

Hashes are 64 bits wide; sets are compared by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import discard, forget_shuffles, written
from .components import connected
from .packing import added, pack, unpack

SKETCH_CELLS = 1 << 20
SKETCH_BLOCK = 1 << 16
MARK_BITS = 1 << 24  # of the filter for shared tokens
BLOCK_MEMBERS = 256
QUERY_BLOCK = 1024
BROADCAST_ROWS = 100_000
_OUT_ROWS = 2000


_POSTING = "token long, cls long, n long, at long"
#: Smallest for a token's most central member: where the token stands first, the text has least of its own.
_CENTRAL = "shiftleft(least(at, 524287L), 44) + shiftright(cls, 19)"


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct word n-gram hashes of each text; of shorter texts the whole sequence's; of none the empty set."""
    for lo, hi, data, offsets in kernel.chunks(column):
        words = kernel.scan(data, offsets)
        grams = kernel.ngram_hashes(words.hashes, n)
        for k in range(hi - lo):
            a, b = int(words.bounds[k]), int(words.bounds[k + 1])
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield np.array([kernel.sequence_hash(words.hashes[a:b])], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def class_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) >> 1


def least_overlap(sizes: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Of two sets with this total size, the smallest intersection that meets the threshold."""
    return -(-percent * sizes // (100 + percent))


def _broadcast_if_small(written_table: DataFrame) -> DataFrame:
    """Hinted to be broadcast if its rows, a few numbers each, are counted and few; else it is joined by a shuffle."""
    return F.broadcast(written_table) if written_table.count() <= BROADCAST_ROWS else written_table


def _sizes_and_sketch(n: int):
    mask = np.uint64(SKETCH_CELLS - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH_CELLS, np.uint32)
        names, seen = ["doc_id", "digest", "n_shingles", "cls", "block", "counts"], False
        for batch in batches:
            seen = seen or batch.num_rows > 0
            sizes, classes, cells = [], [], []
            for tokens in shingle_sets(batch.column(1), n):
                sizes.append(len(tokens))
                classes.append(class_of(tokens) if len(tokens) else None)
                cells.append((tokens & mask).astype(np.int64))
                if sum(map(len, cells[-64:])) > 1 << 20 or len(cells) > 4096:
                    sketch += np.bincount(np.concatenate(cells), minlength=SKETCH_CELLS).astype(np.uint32)
                    cells = []
            if cells:
                sketch += np.bincount(np.concatenate(cells), minlength=SKETCH_CELLS).astype(np.uint32)
            nulls = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array([-1] * batch.num_rows, pa.int32()), nulls], names=names)
        if seen:
            blocks = range(SKETCH_CELLS // SKETCH_BLOCK)
            packed = [pack(sketch[b * SKETCH_BLOCK : (b + 1) * SKETCH_BLOCK]) for b in blocks]
            k = len(packed)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, batch.column(0).type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(list(blocks), pa.int32()), pa.array(packed, pa.binary())], names=names)

    return run


def _prefixes(n: int, percent: int, sketch: np.ndarray):
    mask = np.uint64(SKETCH_CELLS - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for tokens in shingle_sets(batch.column(0), n):
                size = len(tokens)
                if size:
                    order = np.lexsort((tokens, sketch[(tokens & mask).astype(np.int64)]))[: size - -(-percent * size // 100) + 1]
                    rows.append((class_of(tokens), size, tokens[order].astype("<u8").tobytes()))
            for at in range(0, len(rows), _OUT_ROWS):
                cls, sizes, packed = zip(*rows[at : at + _OUT_ROWS], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], names=["cls", "n", "prefix"])

    return run


def _unpack_prefixes(marks_of):
    """Postings of the packed prefixes: all, or those whose token may be shared by the marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = marks_of() if marks_of else None
        for batch in batches:
            packed = batch.column(2).to_pylist()
            lengths = np.array([len(x) // 8 for x in packed], np.int64)
            ends = np.cumsum(lengths)
            total = int(ends[-1]) if len(ends) else 0
            at = np.arange(total) - np.repeat(ends - lengths, lengths)
            row = np.repeat(np.arange(len(packed)), lengths)
            tokens = np.frombuffer(b"".join(packed), "<u8")
            if marks is not None:
                bit = tokens & np.uint64(MARK_BITS - 1)
                kept = np.flatnonzero(marks[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                at, row, tokens = at[kept], row[kept], tokens[kept]
            cls, size = (batch.column(k).to_numpy()[row] for k in (0, 1))
            tokens = tokens.view("<i8")
            for lo in range(0, len(tokens), 200_000):
                cut = slice(lo, lo + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(tokens[cut]), pa.array(cls[cut]), pa.array(size[cut]), pa.array(at[cut])], names=["token", "cls", "n", "at"])

    return run


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks, seen = np.zeros(MARK_BITS // 8, np.uint8), False
    for batch in batches:
        bit = batch.column(0).to_numpy().view(np.uint64) & np.uint64(MARK_BITS - 1)
        np.bitwise_or.at(marks, (bit >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (bit & np.uint64(7)).astype(np.uint8)))
        seen = seen or batch.num_rows > 0
    if seen:
        parts = np.split(marks, 32)
        yield pa.RecordBatch.from_arrays([pa.array(range(32), pa.int32()), pa.array([pack(p) for p in parts], pa.binary())], names=["block", "bits"])


def _sets(n: int):
    """Class and token set of each text, a class once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for tokens in shingle_sets(batch.column(0), n):
                if len(tokens) and (cls := class_of(tokens)) not in seen:
                    seen.add(cls)
                    rows.append((cls, tokens.astype("<u8").tobytes()))
            for at in range(0, len(rows), 500):
                cls, packed = zip(*rows[at : at + 500], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(packed, pa.binary())], names=["cls", "tokens"])

    return run


def _open_groups(percent: int):
    def run(rows_: pd.DataFrame) -> pd.DataFrame:
        rows_ = rows_.drop_duplicates(["cls", "is_query"])
        members, queries = rows_[~rows_["is_query"]], rows_[rows_["is_query"]]
        sets = [np.frombuffer(x, "<u8") for x in members["tokens"]]
        src, dst = [], []
        if sets and len(queries):
            union = np.unique(np.concatenate(sets))
            sizes = np.array([len(x) for x in sets])
            rows = np.concatenate([np.full(len(x), k) for k, x in enumerate(sets)])
            tokens = np.concatenate(sets)
            order = np.argsort(tokens, kind="stable")
            tokens, rows = tokens[order], rows[order]
            ids = members["cls"].to_numpy()
            for cls, packed in zip(queries["cls"], queries["tokens"], strict=True):
                query = np.frombuffer(packed, "<u8")
                known = query[np.isin(query, union, assume_unique=True)]
                if 100 * len(known) < percent * len(query):  # the union's overlap bounds each member's
                    continue
                lo, hi = np.searchsorted(tokens, known, "left"), np.searchsorted(tokens, known, "right")
                common = np.bincount(np.concatenate([rows[a:b] for a, b in zip(lo, hi, strict=True)]), minlength=len(sets))
                hits = np.flatnonzero(100 * common >= percent * (sizes + len(query) - common))
                src += [int(cls)] * len(hits)
                dst += ids[hits].tolist()
        return pd.DataFrame({"src": np.array(src, np.int64), "dst": np.array(dst, np.int64)})

    return run


def jaccard_classes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, firsts: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of each document row: components of links with Jaccard >= percent / 100.

    Words are runs of non-white-space after lower-casing A-Z; a set holds distinct n-word shingles, or the whole sequence
    where a text is shorter.  Null, empty and blank texts have no shingles, link with nothing and keep their own id as
    component_id.  component_id is the smallest doc_id of the component; null ids never are, unless no other is there.
    Repeated rows and ids stay as they are, one result row each.  An empty table gives an empty result.
    firsts adds digest (the text's hash) and is_first: whether (doc_id, digest) is the component's smallest, null ids last;
    null where there are no shingles.
    """
    spark = documents.sparkSession
    source = documents.select(documents[doc_id].cast("long").alias("doc_id"), documents[text].alias("text"), F.xxhash64(documents[text]).alias("digest"))
    seen = written(source.mapInArrow(_sizes_and_sketch(n), "doc_id long, digest long, n_shingles long, cls long, block int, counts binary"), "sets")
    docs = seen.where("block < 0").select("doc_id", "digest", "n_shingles", "cls")
    sketch = np.zeros(SKETCH_CELLS, np.int64)
    for row in added(seen.where("block >= 0").select("block", "counts"), "block int", "counts").toLocalIterator():
        sketch[row["block"] * SKETCH_BLOCK : (row["block"] + 1) * SKETCH_BLOCK] = np.minimum(unpack(row["counts"])[0], 1 << 30)

    texts = documents.select(documents[text].alias("text"))
    prefixes = texts.mapInArrow(_prefixes(n, percent, sketch.astype(np.int32)), "cls long, n long, prefix binary").dropDuplicates(["cls"])
    packed = written(prefixes, "prefixes")
    postings = packed.mapInArrow(_unpack_prefixes(None), _POSTING)
    heads = postings.groupBy("token").agg(F.count("*").alias("members"), F.min(F.expr(_CENTRAL)).alias("head_key")).where("members > 1").select("token", "head_key")
    heads = written(heads, "heads")
    marks = np.zeros(MARK_BITS // 8, np.uint8)
    for row in added(heads.select("token").mapInArrow(_mark, "block int, bits binary"), "block int", "bits", union=True).toLocalIterator():
        own = unpack(row["bits"])[0]
        marks[row["block"] * len(own) : (row["block"] + 1) * len(own)] = own
    marked = spark.sparkContext.broadcast(marks)
    del marks
    postings = packed.mapInArrow(_unpack_prefixes(lambda: marked.value), _POSTING)
    shared = written(postings.join(heads, "token").withColumn("is_head", F.col("head_key") == F.expr(_CENTRAL)).drop("head_key"), "shared")
    marked.destroy()
    forget_shuffles(spark)

    def opened(places: DataFrame, name: str) -> DataFrame:
        """Links of places(group, cls, is_query): each query checked against the members of its groups.

        The token sets come from another scan and go straight to the groups; queries of a group are dealt out in shares of
        about QUERY_BLOCK, each with the group's members, so no task gets more than a block and a share.
        """
        places = written(places.distinct(), f"{name}_places")
        shares = places.where("is_query").groupBy("group").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("long").alias("shares"))
        dealt = places.join(shares, "group")
        share = F.pmod(F.xxhash64("cls"), F.col("shares"))
        dealt = dealt.withColumn("share", F.explode(F.when(F.col("is_query"), F.array(share)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))).drop("shares")
        dealt = written(dealt, f"{name}_dealt")
        moved = texts.mapInArrow(_sets(n), "cls long, tokens binary").join(_broadcast_if_small(dealt), "cls")
        made = written(moved.groupBy("group", "share").applyInPandas(_open_groups(percent), "src long, dst long").distinct(), name)
        discard(places, dealt)
        forget_shuffles(spark)
        return made

    leaders = shared.where("is_head").select("token", F.col("cls").alias("head"), F.col("n").alias("head_n"), F.col("at").alias("head_at"))
    led = shared.where("not is_head").join(leaders, "token")
    most = F.least("at", "head_at") + F.least(F.col("n") - F.col("at"), F.col("head_n") - F.col("head_at"))  # of the overlap
    led = led.where((F.least("n", "head_n") * 100 >= F.greatest("n", "head_n") * percent) & (most * (100 + percent) >= (F.col("n") + F.col("head_n")) * percent))
    led = written(led.select("cls", "head").distinct(), "led")
    group_of = lambda *key: F.xxhash64(*key).alias("group")
    heads_led = led.select(group_of("head"), F.col("head").alias("cls"), F.lit(False).alias("is_query"))
    links = opened(heads_led.union(led.select(group_of("head"), "cls", F.lit(True).alias("is_query"))), "links")
    group = connected(links)

    placed = shared.join(group.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    open_tokens = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    placed = written(placed.join(open_tokens, "token", "left_semi").select("token", "cls", "n", "at", "component"), "placed")
    counts = placed.groupBy("component").agg(F.ceil(F.approx_count_distinct("cls") / BLOCK_MEMBERS).cast("long").alias("blocks"))
    counts = written(counts, "blocks")  # broadcast if few, so that a large component is not dealt to one task
    member = placed.join(_broadcast_if_small(counts), "component").withColumn("part", F.pmod(F.xxhash64("cls"), F.greatest("blocks", F.lit(1))))
    bands = F.floor(F.log(F.col("n").cast("double")) / -np.log(percent / 100)).cast("int")
    cells = member.groupBy("token", "component", "part", bands.alias("own")).agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max(F.col("n") - F.col("at")).alias("rest"))
    cells = cells.withColumn("band", F.explode(F.array(F.col("own") - 1, "own", F.col("own") + 1))).drop("own")
    queries = placed.select("token", F.col("cls").alias("query"), F.col("n").alias("query_n"), (F.col("n") - F.col("at")).alias("query_rest"), F.col("component").alias("query_component"), bands.alias("band"))
    need = F.ceil((F.col("query_n") + F.greatest("least_n", F.ceil(F.col("query_n") * percent / 100))) * percent / (100.0 + percent) - 1e-9)
    asked = queries.join(cells, ["token", "band"]).where(
        (F.col("query_component") < F.col("component"))
        & (F.col("query_n") * 100 >= F.col("least_n") * percent)
        & (F.col("most_n") * 100 >= F.col("query_n") * percent)
        & (F.least("query_rest", "rest") >= need)
    )
    asked = written(asked.select("query", "component", "part").distinct(), "asked")
    asked_members = member.select("component", "part", "cls").distinct().join(asked.select("component", "part").distinct(), ["component", "part"])
    asked_members = written(asked_members, "asked_members")
    block = group_of("component", "part")
    more = opened(asked_members.select(block, "cls", F.lit(False).alias("is_query")).union(asked.select(block, F.col("query").alias("cls"), F.lit(True).alias("is_query"))), "more_links")
    every = written(links.union(more), "all_links")
    final = connected(every)
    discard(packed, heads, shared, led, links, placed, counts, asked, asked_members, more, every)
    forget_shuffles(spark)

    classes = docs.join(final.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    named = classes.where("cls is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"), *([F.min(place).alias("first")] if firsts else []))
    out = classes.join(named, "component", "left")
    more = ["digest", F.when(F.col("cls").isNotNull(), place.eqNullSafe(F.col("first"))).alias("is_first")] if firsts else []
    return out.select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *more)
