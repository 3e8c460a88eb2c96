"""Mixing sources to target weights by systematic sampling.

The documents of a source stand in a fixed order, the longest first. The running sum
of their expected copies, shifted by one random offset, crosses an integer so many
times within a document, and so many copies of it are taken.

Documents of like size form a bin and have the same expected copies, the source's target
over its words. Only documents that have more than a hundredth of the target are not
left to the offset: a bin of them has a whole number of expected copies, and what the
rounding leaves goes to the shorter ones. Expected copies are fixed before the offset.

No source is sorted as a whole: cells of a bin are counted, the counts are summed
within the bin, and a document's place is the sum before its cell plus its rank within
the cell. The cells are many even in a single hot source, and no task gets more than a
few of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from manyview.llm.scratch import Scratch
from manyview.llm.text_columns import word_count

#: Cells of a bin, by a digest of id and text.
SPLITS = 256
P = "__mix_"
STATE = "struct<goal:double,left:double,upto:double,out:array<struct<bin:int,rate:double,before:double>>>"


def _key(source: Column) -> Column:
    """A source as a value that is never null and sorts after all others if it was."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def running(rows: DataFrame, order: list[str], sums: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``place`` (from 1, along ``order``) and, for each of ``sums``, the
    sum over all rows before, as ``before_...``.

    Rows are dealt to tasks by ranges of ``order``; only one row for each task is put
    in order as a whole.
    """
    parts = scratch.table(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    totals = parts.groupBy("part").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"all_{c}") for c in sums])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, over: F.coalesce(F.sum(c).over(over), F.lit(0))
    starts = totals.select("part", so_far("n", earlier).alias("skip"), *[so_far(f"all_{c}", earlier).alias(f"skip_{c}") for c in sums])
    mine = Window.partitionBy("part").orderBy(*order)
    upto = mine.rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(starts, "part").select(
        *rows.columns,
        (F.row_number().over(mine) + F.col("skip")).alias("place"),
        *[(so_far(c, upto) + F.col(f"skip_{c}")).alias(f"before_{c}") for c in sums],
    )


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float, scratch: Scratch) -> DataFrame:
    """Target words of each source: by weight, none above ``cap`` times its size.

    With the sources in order of cap over weight, those that reach their cap come
    first; the level that the others share follows from the running sums of what is
    before them. Sums are of whole numbers, so that their order does not matter.
    """
    s = sized.groupBy(f"{P}key").agg(F.sum(f"{P}size").alias(f"{P}total"))
    s = running(s, [f"{P}key"], [], scratch)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long")
    s = s.select(f"{P}key", f"{P}total", weight.alias("w"))
    s = s.withColumn("turn", F.col(f"{P}total") * F.lit(float(cap)) / F.col("w"))
    s = scratch.table(running(s, ["turn", f"{P}key"], [f"{P}total", "w"], scratch), "sources")
    whole = s.agg(F.sum(f"{P}total").alias("all"), F.sum("w").alias("w_all"))
    s = s.crossJoin(F.broadcast(whole))  # one row
    full_before = F.col(f"before_{P}total") * F.lit(float(cap))
    s = s.withColumn("level", (F.col("all") * F.lit(float(share)) - full_before) / (F.col("w_all") - F.col("before_w")))
    # the first source that stays below its cap, all before it being full, has the level that the rest share
    below = F.col("turn") > F.col("level")
    first = s.where(below).agg(F.min(F.struct("place", "level")).alias("first"))
    s = s.drop("level").crossJoin(F.broadcast(first))  # one row
    full = F.col("first").isNull() | (F.col("place") < F.col("first.place"))
    target = F.when(full, F.col(f"{P}total") * F.lit(float(cap))).otherwise(F.col("first.level") * F.col("w"))
    return s.select(f"{P}key", f"{P}total", target.alias(f"{P}target"))


def bin_rates(bins: Column, target: Column, total: Column, max_copies: int) -> Column:
    """Along a source's ``bins`` (structs of down, bin, n, size, sorted), the expected
    copies of a bin's documents and the sum of expected copies before it.

    All depends on sizes and target alone. A bin gets what is left of the target over what
    is left of the words. Where a document has more than a hundredth of the target, the
    bin's copies are rounded down to a whole number, and what that leaves goes to shorter
    documents; not if those could not take it up, then it is rounded to the nearer side.
    """
    most = F.lit(float(max_copies))

    def once(value: Column, use) -> Column:
        # in an array, so that it is computed once
        return F.get(F.transform(F.array(value), use), 0)

    def step(state: Column, b: Column) -> Column:
        base = F.when(total > 0, target / total).otherwise(F.lit(0.0))
        wanted = F.when(state["left"] > 0, state["goal"] / state["left"]).otherwise(base)
        return once(F.least(F.greatest(wanted, F.lit(0.0)), most), lambda r: whole(state, b, r))

    def whole(state: Column, b: Column, rate: Column) -> Column:
        mean, rest = b["size"] / b["n"], state["left"] - b["size"]
        low = F.floor(b["n"] * rate).cast("double")
        lacks = state["goal"] - low * mean - most * rest
        copies = F.when((lacks > 0) & (lacks > (low + 1) * mean - state["goal"]), F.least(low + 1, most * b["n"])).otherwise(low)
        return once(F.when(mean * 100 > target, copies / b["n"]).otherwise(rate), lambda r: after(state, b, r))

    def after(state: Column, b: Column, rate: Column) -> Column:
        own = F.struct(b["bin"].alias("bin"), rate.alias("rate"), state["upto"].alias("before"))
        return F.struct(
            (state["goal"] - rate * b["size"]).alias("goal"), (state["left"] - b["size"]).alias("left"), (state["upto"] + b["n"] * rate).alias("upto"), F.concat(state["out"], F.array(own)).alias("out")
        ).cast(STATE)

    start = F.struct(target.alias("goal"), total.cast("double").alias("left"), F.lit(0.0).alias("upto"), F.array().alias("out")).cast(STATE)
    return F.aggregate(bins, start, step, lambda s: s["out"])


def mix_sources(
    docs: DataFrame,
    carry: list[str],
    *,
    weights: tuple[int, ...] = (1, 2, 3),
    share: float = 1.0,
    max_copies: int = 3,
    splits: int = SPLITS,
    seed: str = "mix",
    source: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Columns ``carry`` of every row, with ``__mix_size``, ``__mix_total``,
    ``__mix_target`` and ``__mix_copies``.

    A null text has size 0; null sources form one source, the last; null ids sort
    first among documents of equal size. Documents of one id and size stand in the
    order of a digest of their texts; rows that are equal in all of that are alike, and
    it does not matter which of them is taken. A document of no words has the
    expected copies of its source as a whole, target over words, and takes nothing. An empty table gives an empty result. Very long texts make bins
    of their own; a source has at most twice the square root of its longest text's words
    as bins, which are taken along in one row. Columns of ``docs`` beside ``carry`` are
    not read; names that begin with ``__mix_`` are reserved.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = docs.select(
        *[F.col(c) for c in carry],
        F.col(doc_id).alias(f"{P}id"),
        _key(F.col(source)).alias(f"{P}key"),
        word_count(F.col(text)).alias(f"{P}size"),
        F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias(f"{P}digest"),
    )
    digest = F.md5(F.concat(F.coalesce(F.col(f"{P}id").cast("string"), F.lit("")), F.col(f"{P}digest")).cast("binary"))
    rows = rows.withColumn(f"{P}split", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % splits)
    rows = rows.withColumn(f"{P}bin", F.floor(F.sqrt(F.col(f"{P}size").cast("double")) * 2).cast("int"))
    cell, one_bin = [f"{P}key", f"{P}bin", f"{P}split"], [f"{P}key", f"{P}bin"]
    cells = scratch.table(rows.groupBy(*cell).agg(F.count("*").alias("n"), F.sum(f"{P}size").alias(f"{P}size")), "cells")
    targets = source_targets(cells, weights, share, max_copies, scratch)
    start = F.md5(F.concat(F.lit(f"{seed}|"), F.col(f"{P}key")).cast("binary"))
    start = F.conv(F.substring(start, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    bins = cells.groupBy(*one_bin).agg(F.sum("n").alias("n"), F.sum(f"{P}size").alias("size"))
    entry = F.struct((-F.col(f"{P}bin")).alias("down"), F.col(f"{P}bin").alias("bin"), "n", "size")
    by_source = bins.groupBy(f"{P}key").agg(F.array_sort(F.collect_list(entry)).alias("bins")).join(targets, f"{P}key")
    by_source = by_source.withColumn(f"{P}start", start)
    rated = F.inline(bin_rates(F.col("bins"), F.col(f"{P}target"), F.col(f"{P}total"), max_copies))
    rated = by_source.select(f"{P}key", f"{P}total", f"{P}target", f"{P}start", rated).withColumnRenamed("bin", f"{P}bin")
    along = Window.partitionBy(*one_bin).orderBy(f"{P}split").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*cell, F.coalesce(F.sum("n").over(along), F.lit(0)).alias("skip"))
    cells = scratch.table(cells.join(scratch.table(rated, "rated"), one_bin), "placed")
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc(f"{P}size"), f"{P}id", f"{P}digest"))
    placed = rows.withColumn("rank", rank).join(cells, cell)
    upto = lambda i: F.floor(F.col("before") + F.col("rate") * i + F.col(f"{P}start"))
    place = (F.col("skip") + F.col("rank")).cast("double")
    copies = F.least(upto(place) - upto(place - 1), F.lit(max_copies)).cast("long")
    return placed.select(*[F.col(c) for c in carry], f"{P}size", f"{P}total", f"{P}target", copies.alias(f"{P}copies"))
