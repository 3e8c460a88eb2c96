"""Exact top-k search by integer inner product, block at a time.

Rows are put in order by a code of their strongest dimensions, so that neighbours are
alike, and cut into shards, ranges of that order, and shards into blocks. A block keeps a
forward index (the integer vectors of its rows) and, for every dimension, the largest
and smallest value in it. A query's bound on a block is the sum, over dimensions, of the
larger of the two products. Blocks are taken in order of falling bounds; once the bound
is below the k-th score found so far, no later block can hold a better row.

1. Every shard answers the queries that lie in it. The k-th score there is a floor for
   what the query still looks for.
2. A query is sent only to the other shards whose bound reaches its floor, with the floor,
   so that blocks below it are never scored.

Queries come in groups; a group meets a shard in one task, so that neither grows with
the table. A shard returns at most k rows for a query, and the shards' rows are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from manyview.llm.scratch import Scratch
from manyview.llm.worker_code import ship

#: Rows of a block, rows of a shard (between these, by the number of tasks at once), shards, queries scored together, queries of a group.
BLOCK, SHARD, SHARDS, QUERIES, GROUP = 128, (4096, 131_072), 16_384, 512, 65_536
#: Floats are exact below this; tiles with larger scores are computed in whole numbers of any size.
EXACT = 2.0**53
FOUND = "shard int, uid long, query long, id long, score long, floor double, most array<double>, least array<double>"


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """List column as rows of ``width`` numbers; shorter vectors end in zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def widest(*tables: pa.Table) -> int:
    return max((int(np.max(t["v"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False))) for t in tables if len(t)), default=0)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row: highest score, then smallest id."""
    if scores.shape[1] > 4 * k:
        edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        keep = (scores >= edge).any(0)
        ids, scores = ids[keep] if ids.ndim == 1 else ids[:, keep], scores[:, keep]
    ids = np.broadcast_to(ids, scores.shape)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


class Shard:
    """The forward index of a shard and the extremes of its blocks."""

    def __init__(self, rows: pa.Table, width: int, block: int):
        rows = rows.sort_by([("code", "ascending"), ("uid", "ascending")])
        self.uid, self.id = (rows[c].to_numpy() for c in ("uid", "id"))
        self.v = matrix(rows["v"].combine_chunks(), width) if len(rows) else np.zeros((0, width))
        self.starts, self.block = np.arange(0, len(self.v), block), block
        some = len(self.v) > 0
        self.most = np.maximum.reduceat(self.v, self.starts) if some else self.v
        self.least = np.minimum.reduceat(self.v, self.starts) if some else self.v
        self.visited = self.blocks = 0

    def bounds(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(q, 0) @ self.most.T + np.minimum(q, 0) @ self.least.T

    def search(self, uid: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows for each query, but for the query's own
        row; scores below its ``floor`` may be missing. Missing ones are -inf."""
        out_id = np.full((len(q), k), np.iinfo(np.int64).max)
        out = np.full((len(q), k), -np.inf)
        if not len(self.v) or not len(q):
            return out_id, out
        if (np.abs(q).max(0) * np.abs(self.v).max(0)).sum() >= EXACT:
            return self.search_whole(uid, q, k)
        bounds = self.bounds(q)
        order = np.argsort(-bounds, axis=1, kind="stable")
        self.blocks += bounds.size
        for turn in range(len(self.starts)):
            at = order[:, turn]
            # a block that only ties with the k-th score may still have the smaller id
            open_ = bounds[np.arange(len(q)), at] >= np.maximum(out[:, -1], floor)
            if not open_.any():
                break
            self.visited += int(open_.sum())
            for b in np.unique(at[open_]):
                mine = np.flatnonzero(open_ & (at == b))
                s = slice(self.starts[b], self.starts[b] + self.block)
                scores = q[mine] @ self.v[s].T
                scores[uid[mine][:, None] == self.uid[s][None, :]] = -np.inf
                ids, top = best_of(self.id[s], scores, k)
                ids, top = best_of(np.hstack([out_id[mine], ids]), np.hstack([out[mine], top]), k)
                out_id[mine], out[mine] = ids, top
        return out_id, out

    def search_whole(self, uid: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same in whole numbers of any size, without bounds; scores that do not fit a long are cut to one."""
        whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
        rows, ids, out = whole(self.v), [], []
        low, high = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max
        for u, one in zip(uid, whole(q), strict=True):
            scores = np.array([min(max(int(x), low), high) for x in rows @ one], object) if rows.size else np.zeros(len(rows), object)
            keep = [(-s, i) for s, i, r in zip(scores, self.id.tolist(), self.uid, strict=True) if r != u]
            best = sorted(keep)[:k] + [(None, high)] * k
            ids.append([i for _, i in best[:k]])
            out.append([-np.inf if s is None else -s for s, _ in best[:k]])
        return np.array(ids, np.int64), np.array(out, object)


def rows_found(shard: int, uid: np.ndarray, query: np.ndarray, ids: np.ndarray, scores: np.ndarray, floors: np.ndarray | None = None) -> pa.Table:
    there = scores != -np.inf
    times = there.sum(1)
    n = int(times.sum())
    return pa.table(
        {
            "shard": pa.array(np.full(n, shard, np.int32)),
            "uid": np.repeat(uid, times),
            "query": np.repeat(query, times),
            "id": ids[there],
            "score": pa.array([int(x) for x in scores[there]], pa.int64()),
            "floor": np.repeat(floors, times) if floors is not None else np.zeros(n),
            "most": pa.nulls(n, pa.list_(pa.float64())),
            "least": pa.nulls(n, pa.list_(pa.float64())),
        }
    )


def at_home(number: int, rows: pa.Table, k: int, every: int) -> pa.Table:
    """A shard's own answers to the queries in it, each with the k-th score as floor, and a row with the shard's extremes."""
    shard = Shard(rows, widest(rows), BLOCK)
    parts, asking = [], np.flatnonzero(shard.id % every == 0)
    for i in range(0, len(asking), QUERIES):
        mine = asking[i : i + QUERIES]
        ids, scores = shard.search(shard.uid[mine], shard.v[mine], np.full(len(mine), -np.inf), k)
        floors = np.array([float(x) for x in scores[:, -1]])
        parts.append(rows_found(number, shard.uid[mine], shard.id[mine], ids, scores, floors))
    extremes = [pa.array([m.tolist()], pa.list_(pa.float64())) for m in (shard.v.max(0), shard.v.min(0))]
    none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())]
    own = pa.table([pa.array([number], pa.int32()), *none, *extremes], names=["shard", "uid", "query", "id", "score", "floor", "most", "least"])
    return pa.concat_tables([*parts, own])


def sent(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Each query once for every shard but its own whose bound reaches the query's floor."""
    numbers, most, least = shared.value
    for batch in batches:
        q = matrix(batch.column(3), most.shape[1])
        home, floor = batch.column(0).to_numpy(), batch.column(4).to_numpy()
        # sums in another order may differ in the last digits
        bound = (np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T) * (1 + 1e-12) + np.abs(q) @ np.maximum(np.abs(most), np.abs(least)).T * 1e-12
        row, shard = np.nonzero((~(bound < floor[:, None])) & (numbers[None, :] != home[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(numbers[shard]), *[batch.column(i).take(pa.array(row)) for i in range(1, 6)]], names=["shard", *batch.schema.names[1:]])


def search_tile(number: int, queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The answers of a shard to a group of queries."""
    width = widest(queries, rows)
    shard, parts = Shard(rows, width, BLOCK), []
    for i in range(0, max(1, len(queries)), QUERIES):
        some = queries.slice(i, QUERIES)
        q = matrix(some["v"].combine_chunks(), width) if len(some) else np.zeros((0, width))
        uid, query, floor = (some[c].to_numpy() for c in ("uid", "id", "floor"))
        parts.append(rows_found(number, uid, query, *shard.search(uid, q, floor, k)))
    return pa.concat_tables(parts)


def top_k(
    vectors: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """(query, rank, id, score): for each row whose id is divisible by ``every``, the
    ``k`` other rows with the highest inner product, ties to the smaller id.

    Components x count as floor(``scale`` * x). Vectors that are null or hold a null
    or non-finite component take no part, nor do rows without an id. Rows that share an
    id are rows like others, as candidates and as queries. Vectors of unlike lengths are
    compared over what both have; an empty vector scores 0. Scores are exact, and cut to
    a long where they do not fit one. An empty table gives an empty result. Other columns
    are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "search")
    x = F.col("raw")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("raw"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & x.isNotNull() & finite)
    floored = F.transform(x, lambda e: F.when(F.abs(e) < 2.0**44, F.floor(e * scale).cast("double")).otherwise(F.greatest(F.least(e * scale, F.lit(1e308)), F.lit(-1e308))))
    rows = rows.select("id", floored.alias("v"))
    # the three strongest dimensions with their signs, the strongest first
    strong = F.slice(F.reverse(F.array_sort(F.transform("v", lambda e, i: F.struct(F.abs(e).alias("size"), i.alias("i"), (e < 0).alias("down"))))), 1, 3)
    rows = rows.withColumn("code", F.array_join(F.transform(strong, lambda s: F.format_string("%05d%s", s["i"], s["down"].cast("string"))), " "))
    n = vectors.count()
    a_task = max(SHARD[0], min(SHARD[1], n // (2 * spark.sparkContext.defaultParallelism)))
    shards, groups = max(1, min(SHARDS, -(-n // a_task))), max(1, -(-n // (every * GROUP)))
    placed = rows.repartitionByRange(shards, "code", "id").withColumn("uid", F.monotonically_increasing_id()).withColumn("shard", F.spark_partition_id())
    placed = scratch.table(placed, "placed")
    home = placed.groupBy("shard").applyInArrow(lambda key, t: at_home(key[0].as_py(), t, k, every), FOUND)
    home = scratch.table(home, "home")
    # one row for each shard, of which there are at most SHARDS
    edges = home.where("uid IS NULL").select("shard", "most", "least").orderBy("shard").collect()
    if not edges:
        return home.select("query", F.lit(0).alias("rank"), "id", "score")
    first = home.where("uid IS NOT NULL")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "id")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "id", "score")
    if len(edges) == 1:
        # no other shard to send a query to
        return ranked(first)
    width = max(len(r["most"]) for r in edges)
    wide = lambda name: np.array([r[name] + [0.0] * (width - len(r[name])) for r in edges])
    shared = spark.sparkContext.broadcast((np.array([r["shard"] for r in edges], np.int32), wide("most"), wide("least")))
    # a floor holds only where k rows were found
    floors = first.groupBy("uid").agg(F.when(F.count("*") >= k, F.max("floor")).alias("floor"))
    asked = placed.where(F.col("id") % every == 0).join(floors, "uid", "left")
    asked = asked.select("shard", "uid", "id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int").alias("group"))
    away = asked.mapInArrow(lambda it: sent(it, shared), "shard int, uid long, id long, v array<double>, floor double, group int")
    tiles = placed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).groupBy("shard", "group")
    found = away.groupBy("shard", "group").cogroup(tiles).applyInArrow(lambda key, q, r: search_tile(key[0].as_py(), q, r, k), FOUND)
    return ranked(first.unionByName(found))
