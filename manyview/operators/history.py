"""A large history of addresses, of which most need not be read to know what is new.

Addresses are stored by a hash, in parts, and each addition has for each part a Bloom
filter in pieces, made of Spark's bitmaps. A new address is looked up in the filters of its
own part. What they rule out is new, whatever the history holds; only the parts of what is
left are read, and compared by the address itself. The result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from manyview.functions import urls
from manyview.sources.shared import written

#: Bits of one of Spark's bitmaps.
PIECE = 32_768


class History:
    """Addresses in the folder ``root``: ``parts`` of them, filters of ``bits`` for each address, set by ``hashes``."""

    def __init__(self, spark: SparkSession, root: str, parts: int = 64, bits: int = 10, hashes: int = 5):
        self.spark, self.root, self.parts, self.bits, self.hashes = spark, root.rstrip("/"), parts, bits, hashes
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("canonicalUrl"), F.lit(self.parts)).cast("int")

    def _places(self, size: Column) -> Column:
        return F.array(*[F.pmod(F.xxhash64(F.lit(i), "canonicalUrl", F.lit("place")), size) for i in range(self.hashes)])

    def additions(self) -> list[tuple[int, int]]:
        """(number, bits of a part's filter) of additions that were finished."""
        folder = self._path(f"{self.root}/filters")
        if not self._fs.exists(folder):
            return []
        done = [s.getPath() for s in self._fs.listStatus(folder) if self._fs.exists(self._path(s.getPath(), "_SUCCESS"))]
        return sorted(tuple(map(int, p.getName().split("-"))) for p in done)

    def add(self, addresses: DataFrame, number: int) -> None:
        """Add the column ``canonicalUrl``, null ones left out. An addition that was finished is not done again."""
        if number in {n for n, _ in self.additions()}:
            return
        rows = addresses.select("canonicalUrl").where("canonicalUrl IS NOT NULL").distinct().withColumn("part", self._part())
        rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/urls/{number:012d}")
        stored = self.spark.read.schema("canonicalUrl STRING, part INT").parquet(f"{self.root}/urls/{number:012d}")
        most = stored.groupBy("part").count().agg(F.max("count")).first()[0] or 1
        size = -(-most * self.bits // PIECE) * PIECE
        places = stored.select("part", F.explode(self._places(F.lit(size))).alias("place"))
        pieces = places.groupBy("part", F.expr(f"place div {PIECE}").alias("piece")).agg(F.bitmap_construct_agg(F.col("place") % PIECE).alias("bits"))
        pieces.write.mode("overwrite").parquet(f"{self.root}/filters/{number:012d}-{size}")

    def possible(self, addresses: DataFrame) -> DataFrame:
        """(canonicalUrl, part) of those that may be in the history: all that are, and few others."""
        found = self.additions()
        rows = addresses.select("canonicalUrl").where("canonicalUrl IS NOT NULL").distinct().withColumn("part", self._part())
        if not found:
            return rows.where(F.lit(False))
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("number"), F.lit(s).cast("long").alias("size")) for n, s in found])).alias("a")
        asked = rows.select("canonicalUrl", "part", each).select("canonicalUrl", "part", "a.number", F.explode(self._places(F.col("a.size"))).alias("place"))
        asked = asked.withColumn("piece", F.expr(f"place div {PIECE}"))
        filters = None
        for n, s in found:
            some = self.spark.read.schema("part INT, piece LONG, bits BINARY").parquet(f"{self.root}/filters/{n:012d}-{s}").withColumn("number", F.lit(n))
            filters = some if filters is None else filters.unionByName(some)
        met = asked.join(filters, ["number", "part", "piece"])
        octet = F.conv(F.hex(F.expr(f"substring(bits, cast(place % {PIECE} div 8 AS int) + 1, 1)")), 16, 10).cast("int")
        set_ = F.expr("getbit(octet, cast(place % 8 AS int))").cast("int")
        hits = met.select("canonicalUrl", "part", "number", "place", octet.alias("octet")).groupBy("canonicalUrl", "part", "number").agg(F.sum(set_).alias("n"))
        return hits.where(F.col("n") == self.hashes).select("canonicalUrl", "part").distinct()

    def rows(self, parts: list[int]) -> DataFrame:
        """Addresses of some parts; other folders are not read."""
        out = None
        for n, _ in self.additions():
            some = self.spark.read.schema("canonicalUrl STRING, part INT").parquet(f"{self.root}/urls/{n:012d}").where(F.col("part").isin(parts))
            out = some if out is None else out.unionByName(some)
        return out if out is not None else self.spark.createDataFrame([], "canonicalUrl STRING, part INT")

    def new(self, incoming: DataFrame) -> DataFrame:
        """Rows of ``incoming`` whose ``canonicalUrl`` is not in the history; null ones are never."""
        maybe = written(self.possible(incoming), f"{self.root}/work", "maybe")
        parts = sorted(r[0] for r in maybe.select("part").distinct().collect())  # no more than there are
        known = maybe.join(self.rows(parts), ["canonicalUrl", "part"], "left_semi").select("canonicalUrl")
        return incoming.join(known, "canonicalUrl", "left_anti").select(*incoming.columns)


def new_articles(incoming: DataFrame, history: History) -> DataFrame:
    """As ``ingest.new_articles``, against a stored history: the first row (smallest ``_id``) of each new address."""
    named = incoming.withColumn("canonicalUrl", urls.canonical(F.col("url")))
    first = named.groupBy("canonicalUrl").agg(F.min("_id").alias("_id"))
    return named.join(history.new(first).select("_id"), "_id", "left_semi")
