"""Approximate nearest neighbours by balanced posting lists (after SPANN, Chen et al., 2021).

Balanced k-means on a bounded sample gives centroids; a graph of each centroid's neighbours, held in memory, is searched to
find those near a vector.  Each vector goes to the list of its nearest centroid and, if it lies near a boundary, to further
ones about as near that aren't occluded by one already chosen.  A query reads the lists whose centroids are within a factor
of its nearest one's distance, LEAST_PROBES at any rate.  Equal vectors share one entry that keeps the few smallest ids a
result can need.  Only vectors of one dimension are compared: each that is common has an index of its own, in the others
all vectors are compared.  Queries that find too few candidates read every list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import unit_hash, written

SAMPLE = 40_000  # vectors the centroids are fitted on, or ten a centroid where that is more
LIST_SIZE = 160  # vectors a centroid is made for
CENTROIDS = 4096  # up to which their number grows with that of the vectors; then with its root
INDEXED = 1024  # distinct vectors of a dimension from which up it has an index
DEGREE, BEAM = 24, 96  # of the centroid graph and of its search
REPLICAS, BOUNDARY = 6, 1.15  # lists a vector may be in; distance against the nearest centroid's
LEAST_PROBES, PROBES, RATIO = 6, 64, 1.35  # lists a query reads at least, at most (or a 32nd of all); distance against the nearest centroid's
PART, SHARE = 4096, 1024  # vectors of one list, and queries, that one task's group holds, about


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safely for very large and very small values."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means on the sphere in which a centroid gets dearer as its list outgrows the mean."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    price = np.zeros(k)
    for _ in range(rounds):
        owner = np.concatenate([(x[a : a + 4096] @ centroids.T - price).argmax(axis=1) for a in range(0, len(x), 4096)])
        sizes = np.bincount(owner, minlength=k)
        price += 0.05 * (sizes / (len(x) / k) - 1).clip(-1, 3)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, x)
        sums[sizes == 0] = x[rng.choice(len(x), int((sizes == 0).sum()))]
        sums[~sums.any(axis=1)] = x[0]
        centroids = unit(sums)
    return centroids


@dataclass
class CentroidGraph:
    centroids: np.ndarray
    neighbours: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray) -> CentroidGraph:
        k = len(centroids)
        degree = min(DEGREE, max(1, k - 1))
        rng = np.random.default_rng(3)
        near = np.zeros((k, degree), np.int64)
        for a in range(0, k, 512):
            s = centroids[a : a + 512] @ centroids.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
            near[a : a + 512] = np.argsort(-s, axis=1, kind="stable")[:, :degree]
        far = rng.integers(0, k, (k, 4))  # a few long links keep the graph connected
        return cls(centroids, np.concatenate([near, far], axis=1), rng.permutation(k)[: min(k, 32)])

    def search(self, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search for many vectors at once: numbers and distances of the nearest centroids found."""
        k, rows = len(self.centroids), len(x)
        beam = min(k, max(BEAM, want))
        seen = np.zeros((rows, k), bool)
        seen[:, self.entries] = True
        ids = np.tile(self.entries, (rows, 1))
        dist = 2 - 2 * (x @ self.centroids[self.entries].T)
        done = np.zeros(ids.shape, bool)
        every = np.arange(rows)
        for _ in range(4 * beam):
            open_dist = np.where(done, np.inf, dist)
            best = open_dist.argmin(axis=1)
            live = np.isfinite(open_dist[every, best])
            if not live.any():
                break
            done[every, best] = True
            fresh = self.neighbours[ids[every, best]]
            fresh_dist = 2 - 2 * np.einsum("rnd,rd->rn", self.centroids[fresh], x)
            fresh_dist[seen[every[:, None], fresh] | ~live[:, None]] = np.inf
            order = np.sort(fresh, axis=1)
            if (order[:, 1:] == order[:, :-1]).any():  # a node listed twice counts once
                at = np.argsort(fresh, axis=1, kind="stable")
                twice = np.zeros(fresh.shape, bool)
                np.put_along_axis(twice, at[:, 1:], order[:, 1:] == order[:, :-1], axis=1)
                fresh_dist[twice] = np.inf
            seen[every[:, None], fresh] = True
            ids, dist = np.concatenate([ids, fresh], axis=1), np.concatenate([dist, fresh_dist], axis=1)
            done = np.concatenate([done, ~np.isfinite(fresh_dist)], axis=1)
            if ids.shape[1] > beam:
                keep = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
                ids, dist, done = (np.take_along_axis(v, keep, axis=1) for v in (ids, dist, done))
        order = np.argsort(dist, axis=1, kind="stable")[:, :want]
        return np.take_along_axis(ids, order, axis=1), np.sqrt(np.maximum(np.take_along_axis(dist, order, axis=1), 0))


def centroid_count(vectors: int) -> int:
    """About vectors / LIST_SIZE, but beyond CENTROIDS twice the root of vectors."""
    return max(1, min(vectors // LIST_SIZE, max(CENTROIDS, 2 * int(vectors**0.5))))


def _unlike(centroids: np.ndarray, ids: np.ndarray, dist: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Of each row's near centroids, nearest first: those that no chosen one is nearer to than the row's vector is."""
    own = centroids[ids]
    apart = 2 - 2 * np.einsum("rad,rbd->rab", own, own)
    chosen = np.zeros(near.shape, bool)
    chosen[:, 0] = True
    for c in range(1, near.shape[1]):
        occluded = (chosen & (apart[:, :, c] <= dist[:, c, None] ** 2)).any(axis=1)
        chosen[:, c] = near[:, c] & ~occluded & (chosen.sum(axis=1) < REPLICAS)
    return chosen


def _lists(graph_of, queries: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = graph_of()
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                column = part.column(1)
                x = unit(column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()].astype(np.float64).reshape(len(column), -1))
                ids, dist = graph.search(x, max(PROBES, len(graph.centroids) // 32) if queries else REPLICAS * 3)
                near = np.isfinite(dist) & (dist <= (RATIO if queries else BOUNDARY) * dist[:, :1] + 1e-12)
                if queries:
                    near[:, :LEAST_PROBES] = np.isfinite(dist[:, :LEAST_PROBES])
                else:
                    near = _unlike(graph.centroids, ids, dist, near)
                rows, places = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), pa.array(ids[rows, places])], names=["cls", "embedding", "list"])

    return run


def _scan_lists(k: int):
    def run(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": np.zeros(0, np.int64), "cls": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(members) or not len(queries):
            return none
        x, q = (np.stack(f["embedding"].to_numpy()).astype(np.float64) for f in (members, queries))
        ux, uq, ids = unit(x), unit(q), members["cls"].to_numpy()
        made = []
        for a in range(0, len(q), 1024):
            s = uq[a : a + 1024] @ ux.T
            keep = min(k + 8, s.shape[1])
            top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
            for r, columns in enumerate(top):
                score = cosine(q[a + r], x[columns])
                best = np.lexsort((ids[columns], -score))[:k]
                made.append((queries["cls"].iloc[a + r], ids[columns[best]], score[best]))
        return pd.DataFrame({"query": np.concatenate([np.full(len(i), c) for c, i, _ in made]), "cls": np.concatenate([i for _, i, _ in made]), "score": np.concatenate([s for _, _, s in made])})

    return run


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of one vector with the rows of x in double precision; scaled where squares would leave the range."""
    dot, norms = (x * q).sum(axis=1), np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum())
    odd = ~(np.isfinite(norms) & (norms > 1e-290))
    if odd.any():
        dot[odd], norms[odd] = (unit(x[odd]) * unit(q[None])[0]).sum(axis=1), 1.0
    return np.clip(dot / norms, -1, 1)


def nearest(vectors: DataFrame, every: int, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found by cosine for each row whose id is divisible by every.

    A row is no candidate for its own id.  Nearest first, ties to the smaller id; fewer rows where there are fewer.  Null,
    zero and empty vectors, those with null or non-finite components and rows with a null id take no part; vectors of other
    dimensions than the query's are no candidates.  Rows that repeat id and vector count once.  Further columns are left
    out, so none can clash; an empty table gives an empty one.  The index covers all rows; only the centroids are fitted on
    a sample, of about SAMPLE vectors or ten a centroid.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[embedding].alias("embedding"))
    finite = F.forall(F.transform("embedding", lambda x: x.cast("double")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("vec_id is not null and embedding is not null and size(embedding) > 0").where(finite).where(F.exists("embedding", lambda x: x != 0))
    keyed = rows.withColumn("cls", F.xxhash64("embedding"))
    order = W.partitionBy("cls", "embedding").orderBy("vec_id")
    few = written(keyed.distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1), "smallest_ids")
    entries = written(few.where("nth = 1").select(F.col("vec_id").alias("cls"), "embedding", F.col("cls").alias("hash"), F.size("embedding").alias("size")), "distinct_vectors")
    ids = few.select("vec_id", F.col("cls").alias("hash"), "embedding").join(entries, ["hash", "embedding"]).select("cls", "vec_id")
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    asked = written(queries.withColumn("hash", F.xxhash64("embedding")).join(entries, ["hash", "embedding"]).select("query_id", "cls", "embedding", "size"), "asked")
    common = {r["size"]: r["n"] for r in entries.groupBy("size").agg(F.count("*").alias("n")).where(F.col("n") >= INDEXED).collect()}
    kind = f"cls long, embedding {entries.schema['embedding'].dataType.simpleString()}, list long"
    listed = lambda df: df.select("cls", "embedding", (-F.col("size")).cast("long").alias("list"))  # noqa: E731  a rare dimension is one list
    members, reads = listed(entries.where(~F.col("size").isin(list(common)))), listed(asked.where(~F.col("size").isin(list(common)))).distinct()
    for number, (size, count) in enumerate(sorted(common.items())):
        lists = centroid_count(count)
        share = max(SAMPLE, 10 * lists) / count
        sample = entries.where(F.col("size") == size).where(unit_hash("cls") < share).select("embedding").toPandas()["embedding"]
        x = unit(np.stack(sample.to_numpy()).astype(np.float64))
        graph = CentroidGraph.build(balanced_centroids(x, min(len(x), lists)))
        shared = spark.sparkContext.broadcast(graph)
        put = lambda df, is_query, own=shared, n=number: df.mapInArrow(_lists(lambda: own.value, is_query), kind).withColumn("list", F.col("list") + (n << 32))
        own = written(put(entries.where(F.col("size") == size).select("cls", "embedding"), False), "postings")
        members = members.union(own)
        asks = written(put(asked.where(F.col("size") == size).select("cls", "embedding").distinct(), True), "reads")
        reads = reads.union(asks)
        shared.destroy()
        del sample, x, graph
    found = written(_scanned(members, reads, k), "found")
    best = W.partitionBy("query").orderBy(F.desc("score"), "cls")

    def named(found: DataFrame) -> DataFrame:
        """Of each query's vector: its nearest ids, from the nearest entries."""
        near = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth").join(ids, "cls").select("query", "vec_id", "score")
        within = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        return near.withColumn("nth", F.row_number().over(within)).where(F.col("nth") <= k + 1).drop("nth")

    near = named(found)
    short = asked.select("cls", "embedding", "size").distinct().join(near.groupBy(F.col("query").alias("cls")).agg(F.count("*").alias("n")), "cls", "left").where(F.coalesce("n", F.lit(0)) <= k).drop("n")
    short = written(short.where(F.col("size").isin(list(common))).select("cls", "embedding", "size"), "short")
    if not short.isEmpty():  # these read all vectors of their dimension
        every_list = listed(entries.join(short.select("size").distinct(), "size", "left_semi").select("cls", "embedding", "size"))
        more = _scanned(every_list, listed(short), k)
        near = named(found.join(short.select(F.col("cls").alias("query")), "query", "left_anti").union(more.select("query", "cls", "score")))
    out = asked.select("query_id", F.col("cls").alias("query")).join(near, "query").where("query_id <> vec_id")
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.select("query_id", F.row_number().over(ranked).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _scanned(members: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """query, cls, score: of each query the nearest members of the lists it reads.

    Lists are split in parts, and the queries of a list in shares, so that no group holds more than about PART vectors and
    SHARE queries.
    """
    parts = members.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("long").alias("parts"))
    shares = reads.groupBy("list").agg(F.ceil(F.count("*") / SHARE).cast("long").alias("shares"))
    cut = written(parts.join(shares, "list"), "list_parts")
    cut = F.broadcast(cut) if cut.count() <= 1 << 20 else cut  # three numbers a list
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("cls"), F.col(n))
    own = members.join(cut, "list").withColumn("part", dealt("parts")).withColumn("share", spread("shares")).drop("parts", "shares")
    asks = reads.join(cut, "list").withColumn("share", dealt("shares")).withColumn("part", spread("parts")).drop("parts", "shares")
    keys = ["list", "part", "share"]
    return own.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(_scan_lists(k + 1), "query long, cls long, score double").distinct()
