"""An inverted file of vectors on Parquet: one folder for each cell, read by pruning.

Cells are those of k-means on a bounded sample; every row goes to the cell of its nearest
centre. A cell's radius is the largest distance of its rows from the centre, so that by
the triangle inequality no row of it is nearer to a query than the centre's distance less
the radius. A query looks into its nearest cells first; the k-th distance found there
tells which other cells can hold anything better, and only their folders are read. The
result is exact. How many folders that spares depends on how far the rows are in groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from manyview.operators.similarity import GROUP, SHARD, tile_of, unit
from manyview.sources.shared import written

if TYPE_CHECKING:
    import pyarrow as pa

#: Most rows that cells are fitted on, most bytes of their vectors, and most cells.
SAMPLE, SAMPLE_BYTES, CELLS = 100_000, 128 << 20, 4096


class VectorIndex:
    """An index in the folder ``root``. Vectors are of one length; null ones and those of length zero are left out."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def build(cls, rows: DataFrame, root: str, key: str = "_id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Index ``rows``, in about sqrt(rows) cells unless told otherwise."""
        index = cls(rows.sparkSession, root)
        units = written(unit(rows, key, vector), index.root, "units")
        n = units.count()
        width = units.agg(F.max(F.size("unit"))).first()[0] or 1
        sample = max(1, min(sample, SAMPLE_BYTES // (8 * width)))
        cells = min(cells or math.isqrt(n) or 1, CELLS, sample)
        few = units.orderBy(F.xxhash64("key")).limit(sample).repartition(rows.sparkSession.sparkContext.defaultParallelism).select(array_to_vector("unit").alias("v"))
        named = units.select("key", "unit", array_to_vector("unit").alias("v"))
        if n and cells == 1:
            # k-means is for two cells or more
            named, centres = named.withColumn("cell", F.lit(0)), [(0, [float(x) for x in few.agg(Summarizer.mean(F.col("v"))).first()[0]])]
        elif n:
            model = KMeans(k=cells, seed=7, maxIter=10, featuresCol="v", predictionCol="cell").fit(few)
            named = model.transform(named)
            centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        else:
            named, centres = named.withColumn("cell", F.lit(0)), []
        centre = index.spark.createDataFrame(centres, "cell int, centre array<double>")
        # as many rows as cells, of which there is a largest number
        far = named.drop("v").join(F.broadcast(centre), "cell").withColumn("far", F.aggregate(F.zip_with("unit", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        far = written(far.select("key", "unit", "cell", F.sqrt("far").alias("far")), index.root, "assigned")
        sizes = far.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
        shards = F.ceil(F.col("n") / SHARD).cast("int")
        index_cells = centre.join(sizes, "cell").withColumn("shards", shards)
        index_cells.write.mode("overwrite").parquet(f"{index.root}/cells")
        parted = far.join(F.broadcast(sizes.select("cell", shards.alias("shards"))), "cell")
        parted = parted.select("key", "unit", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int").alias("shard"), "cell")
        parted.repartitionByRange("cell", "shard").write.mode("overwrite").partitionBy("cell").parquet(f"{index.root}/rows")
        return index

    def cells(self) -> DataFrame:
        """(cell, centre, radius, n, shards)."""
        return self.spark.read.parquet(f"{self.root}/cells")

    def rows(self, cells: list[int]) -> DataFrame:
        """(key, unit, shard, cell) of some cells; other folders are not read."""
        return self.spark.read.parquet(f"{self.root}/rows").where(F.col("cell").isin(cells))

    def nearest(self, queries: DataFrame, k: int, key: str = "_id", vector: str = "embedding", at_least: float = -1.0, first: int = 1) -> Found:
        """The k most similar rows for each query, not counting itself, as ``similarity.nearest`` has them.

        ``first`` is the number of cells that a query looks into before it asks which others matter.
        """
        work = f"{self.root}/asked"
        cells = self.cells().orderBy("cell").collect()  # of which there is a largest number
        asked = unit(queries, key, vector)
        groups = -(-asked.count() // GROUP) or 1
        kind = asked.schema["key"].dataType.simpleString()
        asked = asked.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int"))
        if not cells:
            return Found(self.spark.createDataFrame([], f"query {kind}, rank int, key {kind}, similarity double"), [], [])
        shared = self.spark.sparkContext.broadcast(([c["centre"] for c in cells], [c["radius"] for c in cells]))
        numbers = [c["cell"] for c in cells]

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np
            import pyarrow as pa

            centres, radii = (np.array(x, float) for x in shared.value)
            for batch in batches:
                vectors = [np.array(v.as_py()) if len(v.as_py()) == centres.shape[1] else None for v in batch.column("unit")]
                out = []
                for v in vectors:
                    # a query of another length has nothing to look for
                    low = np.linalg.norm(centres - v, axis=1) - radii if v is not None else np.full(len(radii), np.inf)
                    out.append(np.maximum(low - 1e-9, 0.0))
                order = [np.argsort(low, kind="stable") for low in out]
                columns = [pa.array([[numbers[i] for i in o] for o in order], pa.list_(pa.int32())), pa.array([low[o].tolist() for low, o in zip(out, order, strict=True)], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "cells", "lows"])

        ordered = written(asked.mapInArrow(bounds, f"key {kind}, unit array<double>, group int, cells array<int>, lows array<double>"), work, "bounds")
        widest = math.sqrt(max(0.0, 2 - 2 * at_least)) + 1e-9
        every = ordered.select("key", "unit", "group", F.posexplode(F.arrays_zip("cells", "lows")).alias("place", "c"))
        every = every.select("key", "unit", "group", "place", F.col("c.cells").alias("cell"), F.col("c.lows").alias("low")).where(F.col("low") <= widest)
        none = F.lit(None).cast("double")
        some, read = self._met(every.where(F.col("place") < first).withColumn("floor", none), k, kind, at_least)
        some = written(some, work, "first")
        kth = some.groupBy(F.col("query").alias("key")).agg(F.sort_array(F.collect_list("similarity"), asc=False).alias("s"))
        kth = kth.where(F.size("s") >= k).select("key", F.element_at("s", k).alias("floor"), (F.sqrt(F.greatest(2 - 2 * F.element_at("s", k), F.lit(0.0))) + 1e-9).alias("most"))
        rest = every.where(F.col("place") >= first).join(kth, "key", "left").where("most IS NULL OR low <= most").drop("most")
        more, also = self._met(rest, k, kind, at_least)
        best = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
        out = some.unionByName(more).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return Found(out.select("query", "rank", "key", "similarity"), sorted({*read, *also}), numbers)

    def _met(self, asked: DataFrame, k: int, kind: str, at_least: float) -> tuple[DataFrame, list[int]]:
        """The k best of each cell for those who ask, if they reach the asker's ``floor``, and the cells that were read."""
        wanted = sorted(r[0] for r in asked.select("cell").distinct().collect())  # of which there is a largest number
        shards = self.cells().where(F.col("cell").isin(wanted)).select("cell", "shards")
        sent = asked.join(F.broadcast(shards), "cell").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        sent = written(sent, f"{self.root}/asked", "sent")
        groups = sent.select("cell", "shard", F.col("group").alias("asking")).distinct()
        rows = self.rows(wanted).join(groups, ["cell", "shard"])
        tiles = ["cell", "shard", "group"]
        asking, there = sent.select(*tiles, "key", "unit", "floor").groupBy(*tiles), rows.select("cell", "shard", "asking", "key", "unit").groupBy("cell", "shard", "asking")
        return asking.cogroup(there).applyInArrow(tile_of(k, at_least), f"query {kind}, key {kind}, similarity double"), wanted


class Found:
    """``rows`` (query, rank, key, similarity), the cells that were ``read``, and all cells."""

    def __init__(self, rows: DataFrame, read: list[int], cells: list[int]):
        self.rows, self.read, self.cells = rows, read, cells
