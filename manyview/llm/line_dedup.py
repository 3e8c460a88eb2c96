"""Line deduplication over levelled sorted runs of line keys.

A run is a table of line keys, bucketed and sorted by key, with the number of documents
that hold a key and the largest id among them. Every key is in one run only. A batch of
new documents is merged against the runs: what an anti join with all of them leaves are
new keys, which form a new run; keys that a run has already only leave a delta beside
that run. A level that has more than ``fanout`` runs is compacted into one run of the
next level, its deltas with it, so that a batch meets few runs however many came before.

Batches, runs and deltas have the same buckets, so that a batch is shuffled once, when
its own lines are counted, and runs never are until they are compacted.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from manyview.llm.scratch import Scratch
from manyview.llm.text_columns import ASCII_SPACE, ascii_lower, row_key

KEY = ["k1", "k2"]


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def keyed_lines(docs: DataFrame, min_chars: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every line with a key of at least ``min_chars`` code points: two independent
    64-bit digests of its key, the row's identity and the line's place."""
    lines = docs.select(
        F.col(doc_id).alias("id"),
        row_key(F.col(doc_id), F.col(text)).alias("row"),
        F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"),
    )
    # a key is never longer than its line, so most short lines go before the costly part
    keys = lines.where(F.char_length("line") >= min_chars).select("id", "row", "pos", line_key(F.col("line")).alias("key"))
    keys = keys.where(F.char_length("key") >= min_chars)
    return keys.select(F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("second"), "key").alias("k2"), "id", "row", "pos")


@dataclass
class Run:
    """Keys of one run, and what later batches add to them."""

    keys: DataFrame
    deltas: list[DataFrame] = field(default_factory=list)


class LineRuns:
    """The runs, by level, each a bucketed table in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.scratch = Scratch(spark, "line-runs")
        self.fanout = fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[Run]] = [[]]

    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def _sorted(self, keys: DataFrame, name: str) -> DataFrame:
        return self.scratch.bucketed(keys.select(*KEY, "docs", "last"), name, self.buckets, KEY)

    def add(self, keyed: DataFrame) -> None:
        """Merge one batch of ``keyed_lines`` into the runs.

        Repeated lines of a document count once, as do repeated rows of it; a null
        id counts as one document and as the smallest id. A document's lines must all
        come in the same batch.
        """
        own = keyed.groupBy(*KEY, "id").agg(F.lit(1).alias("n"))
        own = own.groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("id").alias("last"))
        known = self.runs()
        if not known:
            self.levels[0].append(Run(self._sorted(own, "run")))
            return
        batch = self._sorted(own, "batch")
        fresh = batch
        for run in known:
            fresh = fresh.join(run.keys.select(*KEY), KEY, "left_anti")
            run.deltas.append(self._sorted(batch.join(run.keys.select(*KEY), KEY, "left_semi"), "delta"))
        self.levels[0].append(Run(self._sorted(fresh, "run")))
        self.scratch.drop(batch)
        level = 0
        while len(self.levels[level]) > self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            merged = reduce(DataFrame.unionByName, [self._counted(run) for run in self.levels[level]])
            self.levels[level + 1].append(Run(self._sorted(merged, "run")))
            self._forget(self.levels[level])
            self.levels[level] = []
            level += 1

    def _counted(self, run: Run) -> DataFrame:
        """The keys of a run, each once, with all that was added to them."""
        if not run.deltas:
            return run.keys
        more = reduce(DataFrame.unionByName, run.deltas).groupBy(*KEY).agg(F.sum("docs").alias("more"), F.max("last").alias("later"))
        docs = (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs")
        return run.keys.join(more, KEY, "left").select(*KEY, docs, F.greatest("last", "later").alias("last"))

    def frequent(self, min_docs: int) -> DataFrame:
        """Keys in at least ``min_docs`` documents, read off the runs."""
        every = reduce(DataFrame.unionByName, [self._counted(run) for run in self.runs()])
        return self.scratch.table(every.where(F.col("docs") >= min_docs), "frequent")

    def _forget(self, runs: list[Run]) -> None:
        self.scratch.drop(*[table for run in runs for table in (run.keys, *run.deltas)])

    def drop_runs(self) -> None:
        self._forget(self.runs())
        self.levels = [[]]


def drop_repeated_lines(
    docs: DataFrame,
    carry: list[str],
    *,
    min_chars: int = 40,
    min_docs: int = 5,
    batches: int = 3,
    fanout: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Columns ``carry`` of every row, with ``__line_kept`` (the text left),
    ``__line_n`` and ``__line_dropped``.

    Lines whose key is frequent go, except in the document with the largest id that
    holds it. A null or empty text is one empty line, which stays. Rows that repeat
    an id are the same document. Where all ids are null, the lines stay. Columns of
    ``docs`` beside ``carry`` are not read; names that begin with ``__line_`` are
    reserved. The documents come in ``batches`` by a digest of their id. Texts are split
    whole, however long or many-lined; a very frequent line is one key of a run, and its
    rows are dealt out by the join. An empty table gives an empty result.
    """
    runs = LineRuns(docs.sparkSession, fanout)
    keyed = runs.scratch.table(keyed_lines(docs, min_chars, doc_id, text), "lines")
    for i in range(batches):
        runs.add(keyed.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == i))
    frequent = runs.frequent(min_docs)
    runs.drop_runs()
    gone = keyed.join(frequent, KEY).where(F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last")))
    gone = gone.groupBy(F.col("id").alias("__line_gone_id"), F.col("row").alias("__line_gone_row")).agg(F.collect_set("pos").alias("__line_gone"))
    rows = docs.select(*[F.col(c) for c in carry], F.col(doc_id).alias("__line_id"), F.col(text).alias("__line_text"))
    rows = rows.withColumn("__line_row", row_key(F.col("__line_id"), F.col("__line_text")))
    joined = rows.join(gone, F.expr("__line_id <=> __line_gone_id AND __line_row = __line_gone_row"), "left")
    kept_text = F.coalesce(F.col("__line_text"), F.lit(""))
    split = joined.select(*[F.col(c) for c in carry], kept_text.alias("__line_text"), "__line_gone", F.split(kept_text, "\n").alias("__line_all"))
    # the array is used twice, so that the optimiser keeps it as a column and the lambda does not split again
    places = F.array_except(F.sequence(F.lit(0), F.size("__line_all") - 1), F.col("__line_gone"))
    left = F.array_join(F.transform(places, lambda i: F.get(F.col("__line_all"), i)), "\n")
    return split.select(
        *[F.col(c) for c in carry],
        F.when(F.col("__line_gone").isNull(), F.col("__line_text")).otherwise(left).alias("__line_kept"),
        F.size("__line_all").cast("long").alias("__line_n"),
        F.coalesce(F.size("__line_gone"), F.lit(0)).cast("long").alias("__line_dropped"),
    )
