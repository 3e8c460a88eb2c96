"""Vector similarity between stories and articles. The definitions are this library's."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

if TYPE_CHECKING:
    import pyarrow as pa

#: Queries and rows of a task: 50 and 200 MB of the widest vectors.
GROUP, SHARD = 4096, 16_384


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either is all zeros or null, or if they differ in length."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def unit(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, unit): vectors of length one, those of length zero left out."""
    length = norm(F.col(vector))
    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("raw"), length.alias("length")).where("length > 0")
    return rows.select("key", F.transform("raw", lambda x: x.cast("double") / F.col("length")).alias("unit"))


def tile_of(k: int, at_least: float):
    """What compares a group of queries with a shard of rows, both (key, unit): the k best of
    the shard for each query. Similarities count to twelve digits, so that copies tie. A
    query may come with a ``floor``: what is less similar is not asked for."""

    def tile(q: pa.Table, r: pa.Table) -> pa.Table:
        """A function of its own, so that executors need nothing but numpy and Arrow."""
        import numpy as np
        import pyarrow as pa

        out = {"query": [], "key": [], "similarity": []}
        wide = [t["unit"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if len(t) else np.zeros(0, int) for t in (q, r)]
        for width in np.intersect1d(*wide):
            some = [t.filter(pa.array(w == width)).sort_by("key") for t, w in zip((q, r), wide, strict=True)]
            a, b = (t["unit"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, int(width)) for t in some)
            asking, keys = (t["key"].to_pylist() for t in some)
            least = np.full(len(a), at_least, float)
            if "floor" in q.column_names:
                least = np.fmax(least, some[0]["floor"].to_numpy().astype(float))
            place = {x: i for i, x in enumerate(keys)}
            for begin in range(0, len(a), 256):
                scores = a[begin : begin + 256] @ b.T
                for i in range(len(scores)):
                    own = place.get(asking[begin + i])
                    while own is not None and own >= 0 and keys[own] == asking[begin + i]:
                        scores[i, own] = -np.inf
                        own -= 1
                # those that rounding could bring among the k best, of which few are more than k
                low = least[begin : begin + 256] - 1e-11
                near = scores >= low[:, None]
                full = np.flatnonzero(near.sum(axis=1) > k)
                if len(full) and len(keys) > k:
                    low[full] = np.maximum(low[full], np.partition(scores[full], len(keys) - k, axis=1)[:, len(keys) - k] - 1e-11)
                    near[full] = scores[full] >= low[full, None]
                lines, columns = np.nonzero(near)
                found = np.round(scores[lines, columns], 12)
                # among equal scores the smaller keys stand first
                order = np.lexsort((columns, -found, lines))
                lines, columns, found = lines[order], columns[order], found[order]
                rank = np.arange(len(lines)) - np.searchsorted(lines, lines)
                good = (rank < k) & (found >= least[begin + lines])
                out["query"] += [asking[begin + i] for i in lines[good]]
                out["key"] += [keys[j] for j in columns[good]]
                out["similarity"] += found[good].tolist()
        return pa.table({"query": pa.array(out["query"], q.schema.field("key").type), "key": pa.array(out["key"], r.schema.field("key").type), "similarity": pa.array(out["similarity"], pa.float64())})

    return tile


def nearest(queries: DataFrame, rows: DataFrame, k: int, key: str = "_id", vector: str = "embedding", at_least: float = -1.0) -> DataFrame:
    """(query, rank, key, similarity): the k most similar rows for each query, not counting itself.

    Queries come in groups and rows in shards, so that neither grows with its table; a
    group meets a shard in one task, as a product of two matrices, which gives back the
    k best of the shard. Vectors of unlike length are not compared. Ties go to the
    smaller key; a key that occurs twice is two rows.
    """
    asked, found = unit(queries, key, vector), unit(rows, key, vector)
    groups, shards = -(-queries.count() // GROUP) or 1, -(-rows.count() // SHARD) or 1
    kind = found.schema["key"].dataType.simpleString()
    part = lambda n, c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.withColumn("group", part(groups, "key")).withColumn("shard", every(shards))
    found = found.withColumn("shard", part(shards, "key")).withColumn("group", every(groups))

    best = asked.groupBy("shard", "group").cogroup(found.groupBy("shard", "group")).applyInArrow(tile_of(k, at_least), f"query {kind}, key {kind}, similarity double")
    whole = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
    return best.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).select("query", "rank", "key", "similarity")


def related(stories: DataFrame, slug: str, k: int = 5) -> DataFrame:
    """The published stories most similar to one."""
    return nearest(stories.where(F.col("slug") == slug), stories.where(F.col("status") == "published"), k)


def assign(articles: DataFrame, stories: DataFrame, threshold: float) -> DataFrame:
    """(_id, eventId): for each unprocessed article, the most similar story, or null if none reaches the threshold."""
    waiting = articles.where(F.col("status") == "unprocessed")
    best = nearest(waiting, stories, 1, at_least=threshold).select(F.col("query").alias("_id"), F.col("key").alias("eventId"))
    return waiting.select("_id").join(best, "_id", "left")


def outdated(stories: DataFrame, current: float) -> DataFrame:
    return stories.where(F.col("embeddingVersion") < current)
