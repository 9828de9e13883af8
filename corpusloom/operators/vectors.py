"""Vector operators: neighbours, cluster growth, centroids, topics, scaling to two dimensions, word projections.

Tables: vectors(idx, word, vec), similarity edges(src, dst, sim) by idx, clusters(idx).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.text import bind
from ..session import shared_folder
from .basic import broadcast_if_small

BLOCK = 2048
CENTROIDS = 10_000  # that are broadcast


def normalized(vectors: DataFrame) -> DataFrame:
    """[X13]"""
    return vectors.withColumn("vec", V.normalize(F.col("vec")))


def _block_products(least: float | None, k: int):
    """Similarities of one block of queries with one block of vectors: those from least up, or each query's k best."""

    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(vectors):
            return pd.DataFrame({"src": np.zeros(0, np.int64), "dst": np.zeros(0, np.int64), "sim": np.zeros(0)})
        q, x = (np.stack(f["vec"].to_numpy()).astype(np.float64) for f in (queries, vectors))
        s, ids = q @ x.T, vectors["idx"].to_numpy()
        if least is not None:
            r, c = np.nonzero(s >= least)
        else:
            order = np.argsort(ids, kind="stable")
            best = order[np.argsort(-s[:, order], axis=1, kind="stable")[:, :k]]
            r, c = np.repeat(np.arange(len(q)), best.shape[1]), best.ravel()
        return pd.DataFrame({"src": queries["idx"].to_numpy()[r], "dst": ids[c], "sim": s[r, c]})

    return run


def _blocks(vectors: DataFrame, queries: DataFrame, least: float | None, k: int, block: int) -> DataFrame:
    """src, dst, sim over all pairs of query blocks and vector blocks, a task's group each: memory stays bounded."""
    nv, nq = (max(1, math.ceil(df.count() / block)) for df in (vectors, queries))
    v = vectors.select(F.col("idx").alias("idx"), F.col("vec").alias("vec"), F.pmod(F.xxhash64("idx"), F.lit(nv)).alias("vb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    q = queries.select(F.col("idx").alias("idx"), F.col("vec").alias("vec"), F.pmod(F.xxhash64("idx"), F.lit(nq)).cast("int").alias("qb")).withColumn("vb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nv - 1).cast("long"))))
    return q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(_block_products(least, k), "src long, dst long, sim double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """[J9 W4] src, dst, sim, rank: each query's k most similar vectors, ties to the smaller idx."""
    found = _blocks(vectors, queries, None, k + int(exclude_self), block)
    if exclude_self:
        found = found.where("src <> dst")
    order = W.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    min_similarity: float = 0.0,
    freqs: DataFrame | None = None,
    min_freq: int = 0,
    normalize: bool = False,
    self_contained: bool = False,
    exclude_self: bool = False,
) -> DataFrame:
    """[G6 L21 L22 Q24 Q25] query, word, sim, rank for queries(word[, vec]).

    Word-only queries take their vector from the table; thresholds on similarity and frequency apply after the k best were
    chosen, so fewer may be left.  self_contained searches among the queries only.
    """
    base = normalized(vectors) if normalize else vectors
    if "vec" in queries.columns:
        own = queries.select("word", F.col("vec").alias("_v")).join(base.select("word", F.col("vec").alias("_t")), "word", "left")
        asked = own.select("word", F.coalesce(V.normalize(F.col("_v")) if normalize else F.col("_v"), F.col("_t")).alias("vec")).where("vec is not null")
        asked = asked.withColumn("idx", F.monotonically_increasing_id())
        ids = asked.select(F.col("idx").alias("src"), F.col("word").alias("query"))
    else:
        asked = base.join(queries.select("word").distinct(), "word", "left_semi")
        ids = asked.select(F.col("idx").alias("src"), F.col("word").alias("query"))
    table = base.join(queries.select("word").distinct(), "word", "left_semi") if self_contained else base
    found = nearest(table, asked, k, exclude_self).where(F.col("sim") >= min_similarity)
    found = found.join(ids, "src").join(base.select(F.col("idx").alias("dst"), "word"), "dst")
    if freqs is not None:
        counts = freqs.select("word", F.col("freq").cast("long").alias("freq")).groupBy("word").agg(F.max("freq").alias("freq"))
        found = found.join(counts, "word", "left").where(F.coalesce("freq", F.lit(0)) >= min_freq)
    return found.select("query", "word", "sim", "rank")


def similarity_edges(vectors: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """[J10 J11] src, dst, sim of all pairs of different vectors with sim >= least, both ways."""
    if least <= 0:
        raise ValueError("the least similarity must be positive")
    return _blocks(vectors, vectors, least, 0, block).where("src <> dst")


# Summaries of a vector's edges, found without the edges, whose number grows with the square of the vectors.

CELLS = 8  # parts that vectors are dealt into, each to meet each other one in a task: they move 2 * CELLS times
CELL_LEAST = 1024  # vectors in a part at least
CELL_NUMBERS = 4 << 20  # in a part at most; more vectors make more parts
ROWS_AT_ONCE = 4 << 20  # products held at once


def _cells(vectors: DataFrame, other: DataFrame, kernel, schema: str) -> DataFrame:
    """kernel over each part of the vectors, as queries, with each part of the other table; both have idx and vec."""
    width = other.select(F.size("vec").alias("n")).first()
    n = other.count()
    parts = max(min(CELLS, math.ceil(n / CELL_LEAST)), math.ceil(n * (width["n"] if width else 1) / CELL_NUMBERS), 1)
    part, every = F.pmod(F.xxhash64("idx"), F.lit(parts)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    q = vectors.select(*(F.col(c).alias(c) for c in vectors.columns), part.alias("qb")).withColumn("vb", every)
    v = other.select(*(F.col(c).alias(c) for c in other.columns), part.alias("vb")).withColumn("qb", every)
    return q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInArrow(kernel, schema)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and vectors by rising number."""
    ids = table["idx"].to_numpy()
    x = np.concatenate([c.flatten().to_numpy() for c in table["vec"].chunks]).astype(np.float64).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    return ids[order], x[order]


def _similarities(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, least: float):
    """Some queries after the other: their first number, and the products with all vectors, -inf below least and with
    themselves.  Equal vectors have equal products, whichever way the product was summed up."""
    _, first, same = np.unique(np.ascontiguousarray(v).view(np.void(8 * v.shape[1])).ravel(), return_index=True, return_inverse=True)
    source = first[same.ravel()]
    copies = np.flatnonzero(source != np.arange(len(v)))
    step = max(1, ROWS_AT_ONCE // len(v))
    at = np.searchsorted(v_ids, q_ids)
    own = (at < len(v_ids)) & (v_ids[np.minimum(at, len(v_ids) - 1)] == q_ids)
    for a in range(0, len(q), step):
        s = q[a : a + step] @ v.T
        if len(copies):
            s[:, copies] = s[:, source[copies]]
        s[~(s >= least)] = -np.inf
        mine = np.flatnonzero(own[a : a + step])
        s[mine, at[a + mine]] = -np.inf
        yield a, s


def _best_of_cell(least: float, k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(queries) and len(vectors):
            (q_ids, q), (v_ids, v) = _matrix(queries), _matrix(vectors)
            for a, s in _similarities(q_ids, q, v_ids, v, least):
                rows = np.arange(len(s))
                for _ in range(min(k, len(v))):
                    c = s.argmax(axis=1)
                    r = np.flatnonzero(s[rows, c] > -np.inf)
                    c = c[r]
                    found.append((q_ids[a + r], v_ids[c], (q[a + r] * v[c]).sum(axis=1)))
                    s[r, c] = -np.inf
        src, dst, sim = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"src": src.astype(np.int64), "dst": dst.astype(np.int64), "sim": sim})

    return run


def nearest_edges(vectors: DataFrame, least: float, k: int = 1) -> DataFrame:
    """[J10 J11 W5] src, dst, sim of the k nearest others of each vector among those with sim >= least, ties to the smaller idx.

    What the methods "first" (k = 1) and "dcg" (k = dcg_length) of emscan_step look at of similarity_edges().
    """
    if least <= 0:
        raise ValueError("the least similarity must be positive")
    own = vectors.select("idx", "vec")
    found = _cells(own, own, _best_of_cell(least, k), "src long, dst long, sim double")
    order = W.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def _count_of_cell(least: float):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        n, inside, ids = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64), np.zeros(0, np.int64)
        if len(queries) and len(vectors):
            (ids, q), (v_ids, v) = _matrix(queries), _matrix(vectors)
            member = vectors["inside"].to_numpy()[np.argsort(vectors["idx"].to_numpy(), kind="stable")].astype(np.float32)
            for a, s in _similarities(ids, q, v_ids, v, least):
                linked = s > -np.inf
                n[a : a + len(s)] = np.count_nonzero(linked, axis=1)
                inside[a : a + len(s)] = np.count_nonzero(linked[:, member > 0], axis=1)
        some = n[: len(ids)] > 0
        return pa.table({"src": ids[some].astype(np.int64), "n": n[: len(ids)][some], "inside": inside[: len(ids)][some]})

    return run


def neighbour_counts(vectors: DataFrame, cluster: DataFrame, least: float) -> DataFrame:
    """src, n, inside: with how many others a vector has sim >= least, and with how many members of the cluster."""
    if least <= 0:
        raise ValueError("the least similarity must be positive")
    members = cluster.select("idx", F.lit(1).alias("inside")).distinct()
    flagged = vectors.select("idx", "vec").join(members, "idx", "left").fillna(0, ["inside"])
    found = _cells(vectors.select("idx", "vec"), flagged, _count_of_cell(least), "src long, n long, inside long")
    return found.groupBy("src").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside"))


def emscan_step_of(vectors: DataFrame, cluster: DataFrame, least: float, method: str = "first", dcg_length: int = 5, min_dcg: float = 1.0, cluster_ratio: float = 0.5) -> DataFrame:
    """emscan_step() on the edges of similarity_edges(vectors, least), which are not made."""
    if method == "ratio":
        share = neighbour_counts(vectors, cluster, least).where("inside > 0").where(F.col("inside") / F.col("n") >= cluster_ratio)
        return share.select(F.col("src").alias("idx")).join(cluster.select("idx").distinct(), "idx", "left_anti")
    if method == "dcg" and min_dcg <= 1e-12:  # then a member farther off is enough
        return emscan_step(similarity_edges(vectors, least), cluster, method, dcg_length, min_dcg)
    return emscan_step(nearest_edges(vectors, least, dcg_length if method == "dcg" else 1), cluster, method, dcg_length, min_dcg)


def nearest_other(edges: DataFrame) -> DataFrame:
    """[W5] src, dst, sim: the nearest neighbour among the edges, ties to the smaller idx."""
    order = W.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return edges.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def dcg_gain(rank: Column) -> Column:
    """[W6] weight of the 0-based rank: 1, then 1 / log2(rank + 1)."""
    return F.when(rank == 0, 1.0).otherwise(1.0 / F.log2(F.greatest(rank, F.lit(1)).cast("double") + 1.0))


def emscan_step(edges: DataFrame, cluster: DataFrame, method: str = "first", dcg_length: int = 5, min_dcg: float = 1.0, cluster_ratio: float = 0.5) -> DataFrame:
    """[G1 G2 G3] idx of the new members that one round adds.

    Candidates are outside the cluster with an edge to a member.  "first": the nearest neighbour is a member.  "dcg": the
    discounted gain of membership over the dcg_length nearest neighbours reaches min_dcg.  "ratio": the members' share of
    the neighbours reaches cluster_ratio.
    """
    members = cluster.select(F.col("idx").alias("m")).distinct()
    candidates = edges.join(members, F.col("dst") == F.col("m"), "left_semi").join(members, F.col("src") == F.col("m"), "left_anti").select("src").distinct()
    own = edges.join(candidates, "src", "left_semi").join(members, F.col("dst") == F.col("m"), "left").withColumn("inside", F.when(F.col("m").isNotNull(), 1.0).otherwise(0.0))
    if method == "ratio":
        return own.groupBy("src").agg(F.avg("inside").alias("r")).where(F.col("r") >= cluster_ratio).select(F.col("src").alias("idx"))
    order = W.partitionBy("src").orderBy(F.desc("sim"), "dst")
    ranked = own.withColumn("r", F.row_number().over(order) - 1)
    if method == "first":
        return ranked.where("r = 0 and inside = 1.0").select(F.col("src").alias("idx"))
    if method == "dcg":
        return ranked.where(F.col("r") < dcg_length).groupBy("src").agg(F.sum(F.col("inside") * dcg_gain(F.col("r"))).alias("g")).where(F.col("g") >= min_dcg - 1e-12).select(F.col("src").alias("idx"))
    raise ValueError(f"no such method: {method!r}")


def attraction_edges(edges: DataFrame, cluster: DataFrame, added: DataFrame, method: str = "first") -> DataFrame:
    """[G5] src, dst, weight of one round: candidate -> attractor for "first", member -> candidate otherwise."""
    members, new = cluster.select(F.col("idx").alias("dst")).distinct(), added.select(F.col("idx").alias("src")).distinct()
    own = edges.join(new, "src", "left_semi")
    if method == "first":
        return nearest_other(own).select("src", "dst", F.col("sim").alias("weight"))
    own = own.join(members, "dst", "left_semi")
    return own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("sim").alias("weight"))


def _saved(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def emscan(edges: DataFrame, seeds: DataFrame, iterations: int = 100, max_cluster: int | None = None, method: str = "first", **how: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """[G4 G5 Q16] members(idx, it), graph nodes (the same) and edges(src, dst, weight, it) after the rounds.

    It ends after so many rounds, when nothing is added, or before adopting a round that would reach max_cluster members.
    For "first", nearest_edges() are enough.
    """
    edges = _saved(edges)
    cluster = _saved(seeds.select("idx", F.lit(0).alias("it")).distinct())
    graph: DataFrame | None = None
    size = cluster.count()
    for it in range(1, iterations + 1):
        added = _saved(emscan_step(edges, cluster, method, **how))
        n = added.count()
        if not n or (max_cluster is not None and size + n >= max_cluster):
            break
        links = attraction_edges(edges, cluster, added, method).withColumn("it", F.lit(it))
        graph = _saved(links if graph is None else graph.union(links))
        cluster = _saved(cluster.union(added.withColumn("it", F.lit(it))))
        size += n
    if graph is None:
        graph = edges.select("src", "dst", F.col("sim").alias("weight"), F.lit(0).alias("it")).limit(0)
    return cluster, cluster, graph


def without_isolated_seeds(nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """[L23] nodes but for seeds (it = 0) that no edge touches."""
    ends = graph.select(F.col("src").alias("idx")).union(graph.select(F.col("dst").alias("idx"))).distinct()
    return nodes.where("it <> 0").unionByName(nodes.where("it = 0").join(ends, "idx", "left_semi"))


def graphml(nodes: DataFrame, graph: DataFrame) -> str:
    """[K10] the attraction graph as GraphML, built on the driver: for graphs to be looked at."""
    from xml.sax.saxutils import quoteattr

    lines = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="it" for="node" attr.name="it" attr.type="int"/>', '<key id="weight" for="edge" attr.name="weight" attr.type="double"/>', '<graph edgedefault="directed">']
    lines += [f'<node id={quoteattr(str(r[0]))}><data key="it">{r[1]}</data></node>' for r in nodes.orderBy(nodes.columns[0]).toLocalIterator()]
    lines += [f'<edge source={quoteattr(str(r["src"]))} target={quoteattr(str(r["dst"]))}><data key="weight">{r["weight"]}</data></edge>' for r in graph.orderBy("src", "dst").toLocalIterator()]
    return "\n".join([*lines, "</graph>", "</graphml>", ""])


# --- centroids ----------------------------------------------------------------------------------------------------------


def centroids(members: DataFrame) -> DataFrame:
    """list, centroid: mean vectors scaled to length 1, of members(list, idx, vec)."""
    means = members.select("list", F.posexplode(V.as_double(F.col("vec"))).alias("d", "x")).groupBy("list", "d").agg(F.avg("x").alias("x"))
    flat = means.groupBy("list").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda e: e["x"]).alias("c"))
    return flat.select("list", V.normalize(F.col("c")).alias("centroid"))


def centroid_statistics(members: DataFrame) -> DataFrame:
    """[A15] list, n, max and mean angular distance to the centroid, their population deviation, percentage within one of it."""
    far = members.join(broadcast_if_small(centroids(members), CENTROIDS), "list").select("list", V.angular(V.dot(F.col("vec"), F.col("centroid"))).alias("d"))
    stats = far.groupBy("list").agg(F.count("*").alias("n"), F.max("d").alias("max_distance"), F.avg("d").alias("mean_distance"), F.stddev_pop("d").alias("std_distance"))
    inside = F.abs(F.col("d") - F.col("mean_distance")) < F.col("std_distance")
    share = far.join(broadcast_if_small(stats.select("list", "mean_distance", "std_distance")), "list").groupBy("list").agg((F.count_if(inside) * 100.0 / F.count("*")).alias("within_std"))
    return stats.join(share, "list")


def nearest_centroid(members: DataFrame) -> DataFrame:
    """[A16] list, idx, assigned: the list with the nearest centroid, ties to the first name.

    CENTROIDS of them at most are gathered into one row that is broadcast; more are compared block by block.
    """
    own = centroids(members)
    if own.count() > CENTROIDS:
        named = own.select(F.col("list").alias("assigned"), F.col("centroid").alias("vec")).withColumn("idx", F.dense_rank().over(W.orderBy("assigned")).cast("long"))
        shared_folder(members.sparkSession)
        named = named.checkpoint()
        best = nearest(named.select("idx", "vec"), members.select("idx", "vec"), 1).select(F.col("src").alias("idx"), F.col("dst").alias("_c"))
        return members.join(best, "idx").join(named.select(F.col("idx").alias("_c"), "assigned"), "_c").select("list", "idx", "assigned")
    table = own.agg(F.sort_array(F.collect_list(F.struct("list", "centroid"))).alias("all"))
    score = bind(F.col("vec"), lambda v: F.transform("all", lambda c: F.struct(V.angular(V.dot(v, c["centroid"])).alias("d"), c["list"].alias("list"))))
    return members.crossJoin(F.broadcast(table)).select("list", "idx", F.array_min(score)["list"].alias("assigned"))  # one row


def confusion(members: DataFrame) -> DataFrame:
    """[A16] list, assigned, n."""
    return nearest_centroid(members).groupBy("list", "assigned").agg(F.count("*").alias("n"))


def confusion_matrix(members: DataFrame) -> DataFrame:
    """[A16] the same with a column a list."""
    return nearest_centroid(members).groupBy("list").pivot("assigned").count().na.fill(0)


def centroid_members(members: DataFrame) -> DataFrame:
    """[A17] list, idx of those assigned to their own list."""
    return nearest_centroid(members).where(F.col("list") == F.col("assigned")).select("list", "idx").orderBy("list", "idx")


# --- sparse topics ------------------------------------------------------------------------------------------------------


def topic_statistics(sparse: DataFrame, lists: DataFrame, filter_unique: bool = False) -> DataFrame:
    """[A18 L24 O6] list, topic, n of sparse(word, dim, val) and lists(list, word); filter_unique drops topics of one word."""
    found = sparse.where("val <> 0").join(lists.distinct(), "word").groupBy("list", F.col("dim").alias("topic")).agg(F.count("*").alias("n"))
    found = found.where("n <> 1") if filter_unique else found
    return found.orderBy(F.desc("n"), "list", "topic")


def topic_words(sparse: DataFrame, lists: DataFrame) -> DataFrame:
    """[A18] list, topic, entries: (word, val) by word."""
    found = sparse.where("val <> 0").join(lists.distinct(), "word")
    return found.groupBy("list", F.col("dim").alias("topic")).agg(F.sort_array(F.collect_list(F.struct("word", "val"))).alias("entries"))


# --- small dense problems, on the driver --------------------------------------------------------------------------------


def distance_matrix(vectors: DataFrame, kind: str = "cos") -> tuple[list[int], np.ndarray]:
    """Distances of a small table's vectors: "cos" is the angular distance, "euc" the Euclidean."""
    rows = vectors.orderBy("idx").select("idx", "vec").toPandas()
    x = np.stack(rows["vec"].to_numpy()).astype(np.float64)
    if kind == "cos":
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        return rows["idx"].tolist(), np.arccos(np.clip(u @ u.T, -1, 1)) / np.pi
    if kind == "euc":
        return rows["idx"].tolist(), np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0))
    raise ValueError(f"no such distance: {kind!r}")


def mds(vectors: DataFrame, kind: str = "cos", rounds: int = 300, seed: int = 0) -> DataFrame:
    """[G7] idx, x, y by metric multidimensional scaling (stress majorization), for tables small enough to look at."""
    ids, d = distance_matrix(vectors, kind)
    n = len(ids)
    at, last = np.random.default_rng(seed).standard_normal((n, 2)), np.inf
    for _ in range(rounds):
        now = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1))
        stress = ((now - d) ** 2).sum() / 2
        if last - stress < 1e-9 * max(stress, 1e-12):
            break
        last = stress
        b = -np.where(now > 0, d / np.where(now > 0, now, 1), 0)
        b[np.arange(n), np.arange(n)] = -b.sum(axis=1)
        at = b @ at / n
    return vectors.sparkSession.createDataFrame([(int(i), float(x), float(y)) for i, (x, y) in zip(ids, at, strict=True)], "idx long, x double, y double")


def densifier(vectors: DataFrame, gold: DataFrame, rounds: int = 20, rate: float = 0.1, decay: float = 0.99, seed: int = 0, batch: int = 100) -> list[float]:
    """[G8 J15 J16 Q18] a direction that pulls gold words of equal value together and others apart, from gold(word, value).

    Pairs of the gold list, a hand-made and small one, are sampled on the driver; the orthogonal matrix is restored after
    each step by a singular value decomposition.  Its first row is returned.
    """
    rows = vectors.join(gold, "word").orderBy("idx").select("vec", "value").toPandas()
    x, y = np.stack(rows["vec"].to_numpy()).astype(np.float64), rows["value"].to_numpy()
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        for _ in range(max(1, len(x) // 10)):
            a, b = rng.integers(0, len(x), (2, batch))
            keep = a != b
            difference, same = x[a[keep]] - x[b[keep]], y[a[keep]] == y[b[keep]]
            side = np.sign(difference @ q[0])
            pull = np.where(same, 1.0, -1.0) * side
            q[0] -= rate * (pull[:, None] * difference).mean(axis=0)
            u, _, v = np.linalg.svd(q)
            q = u @ v
        rate *= decay
    side = np.sign(((x @ q[0]) * (y - y.mean())).sum()) or 1.0
    return (side * q[0]).tolist()


def project(vectors: DataFrame, direction: Sequence[float]) -> DataFrame:
    """[O7 X20] word, score by falling score."""
    return vectors.select("word", V.first_coordinate(F.col("vec"), list(direction)).alias("score")).orderBy(F.desc("score"), "word")


def to_sparse(vectors: DataFrame) -> DataFrame:
    """word, dim, val of the components that aren't zero."""
    return vectors.select("word", F.posexplode(V.as_double(F.col("vec"))).alias("dim", "val")).where("val <> 0")


def to_dense(sparse: DataFrame, dimension: int) -> DataFrame:
    """[X15] word, vec from the sparse form."""
    made = sparse.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("dim", "val"))).alias("m"))
    return made.select("word", F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("vec"))


BROADCAST_NUMBERS = 100_000


def sparse_dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """[X14] a_word, b_word, dot of sparse vectors, by their common dimensions.

    Where a has few numbers it is broadcast to b, dealt out by word, so that the pairs' products are added where they arise.
    """
    x, y = (t.select(F.col("word").alias(f"{n}_word"), "dim", F.col("val").alias(f"{n}_val")) for t, n in ((a, "a"), (b, "b")))
    if a.count() <= BROADCAST_NUMBERS:
        x, y = F.broadcast(x), y.repartition("b_word")
    return x.join(y, "dim").groupBy("a_word", "b_word").agg(F.sum(F.col("a_val") * F.col("b_val")).alias("dot"))
