"""Running sums within groups that may be of any size.

Rows are dealt out in ranges of (group, order), so that a hot group is spread over
many tasks. Every task sums what it has; what the tasks before it have of the group
that it begins with is added afterwards. Only those groups cross tasks, so that what
is broadcast has fewer rows than twice the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType
from pyspark.sql.window import Window

from manyview.llm.scratch import Scratch
from manyview.llm.worker_code import ship

#: Digests are summed modulo 2 to this power, so that the sums of many fit in a long.
BITS = 61
MASK = (1 << BITS) - 1


def _accumulate(batches: Iterator[pa.RecordBatch], group: list[str], sums: dict[str, str], last: dict[str, str]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    key, first = None, None
    totals, latest = dict.fromkeys(sums, 0), dict.fromkeys(last)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = [batch.column(g).to_numpy(zero_copy_only=False) for g in group]
        here = tuple(int(k[0]) for k in keys)
        first = here if first is None else first
        new = np.zeros(n, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        new[0] = here != key
        key = tuple(int(k[-1]) for k in keys)
        starts = np.flatnonzero(new)
        of = np.cumsum(new) - 1  # -1: the group goes on from the batch before
        goes_on = of < 0
        begin = np.where(goes_on, 0, starts[np.maximum(of, 0)]) if len(starts) else np.zeros(n, np.int64)
        out = {"part": pa.array(np.full(n, part, np.int32)), "edge": pa.array(np.logical_and.reduce([k == f for k, f in zip(keys, first, strict=True)]))}
        for name, source in sums.items():
            total = np.cumsum(batch.column(source).to_numpy(zero_copy_only=False).astype(np.int64))
            before = np.concatenate([[0], total])[begin]
            run = total - before + np.where(goes_on, totals[name], 0)
            totals[name] = run[-1]
            out[name] = pa.array(run)
        for name, source in last.items():
            column = batch.column(source)
            there = column.is_valid().to_numpy(zero_copy_only=False)
            at = np.maximum.accumulate(np.where(there, np.arange(n), -1))
            seen = at >= begin
            value = np.where(seen, column.fill_null(0).to_numpy(zero_copy_only=False)[np.maximum(at, 0)], 0)
            if latest[name] is not None:
                value = np.where(~seen & goes_on, latest[name], value)
                seen = seen | goes_on
            latest[name] = int(value[-1]) if seen[-1] else None
            out[name] = pa.array(value, mask=~seen)
        yield pa.RecordBatch.from_arrays([*batch.columns, *out.values()], [*batch.schema.names, *out])


def running(
    df: DataFrame, scratch: Scratch, group: list[str], order: list[Column], sums: dict[str, str], digests: tuple[str, ...] = (), last: dict[str, str] | None = None
) -> DataFrame:
    """``df`` with, for each name in ``sums``, the sum of its column over the rows of the
    group up to this one, and for each in ``last`` the last value that is not null.

    Groups are told by columns of whole numbers that are never null. Sums named in
    ``digests`` are modulo 2**61. Rows that tie in ``order`` come in any order.
    """
    ship(df.sparkSession)
    last = last or {}
    fields = StructType(list(df.schema.fields)).add("part", IntegerType()).add("edge", BooleanType())
    for name in (*sums, *last):
        fields = fields.add(name, LongType())
    keys = [F.col(g) for g in group]
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    local = scratch.table(dealt.mapInArrow(lambda it: _accumulate(it, group, sums, last), fields).withColumn("at", F.monotonically_increasing_id()), "running")
    firsts = local.where("edge").select(*group).distinct()
    by_part = local.join(F.broadcast(firsts), group, "left_semi").groupBy(*group, "part")
    ends = by_part.agg(*[F.max_by(name, "at").alias(name) for name in (*sums, *last)])
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    added = {}
    for name in sums:
        total = F.sum(F.col(name).cast("decimal(38,0)")).over(before)
        added[name] = (F.pmod(total, F.lit(1 << BITS).cast("decimal(38,0)")) if name in digests else total).cast("long")
    for name in last:
        added[name] = F.last(name, ignorenulls=True).over(before)
    carried = ends.select(*group, "part", *[c.alias(f"__{n}") for n, c in added.items()])
    carried = scratch.table(carried.where(" OR ".join(f"__{n} IS NOT NULL" for n in added)), "carried")
    out = local.join(F.broadcast(carried), [*group, "part"], "left")
    whole = {}
    for name in sums:
        if name in digests:
            mine = F.col(name).bitwiseAND(F.lit(MASK)) + F.coalesce(F.col(f"__{name}"), F.lit(0))
            whole[name] = mine.bitwiseAND(F.lit(MASK))
        else:
            whole[name] = F.col(name) + F.coalesce(F.col(f"__{name}"), F.lit(0))
    for name in last:
        whole[name] = F.coalesce(F.col(name), F.col(f"__{name}"))
    return out.select(*df.columns, *[c.alias(n) for n, c in whole.items()])


def _pieces(batches: Iterator[pa.RecordBatch], width: int, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of at most ``size`` values of a group as one text, numbers joined by commas."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    key, held, place = None, [], 0
    found: list[tuple] = []

    def flush() -> None:
        nonlocal held, place
        if held:
            found.append((*key, part, place, ",".join(map(str, held))))
            held, place = [], place + 1

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*found, strict=True))
        kinds = [pa.int64()] * width + [pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*[f"k{i}" for i in range(width)], "part", "place", "piece"])

    for batch in batches:
        *keys, values = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width + 1)]
        n = batch.num_rows
        new = np.zeros(n, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), n]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            here = tuple(int(k[i]) for k in keys)
            if here != key:
                flush()
                key = here
            while i < j:
                taken = values[i : min(j, i + size - len(held))].tolist()
                held += taken
                i += len(taken)
                if len(held) >= size:
                    flush()
        if found:
            yield batch_of()
            found.clear()
    flush()
    if found:
        yield batch_of()


def _hashed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    import hashlib

    key, digest = None, None
    names, kinds = [*[f"k{i}" for i in range(width)], "sha256"], [pa.int64()] * width + [pa.string()]
    for batch in batches:
        found = []
        *keys, _, _, pieces = [batch.column(i).to_pylist() for i in range(width + 3)]
        for *here, piece in zip(*keys, pieces, strict=True):
            if here == key:
                digest.update(b",")
            else:
                if key is not None:
                    found.append((*key, digest.hexdigest()))
                key, digest = here, hashlib.sha256()
            digest.update(piece.encode())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((*key, digest.hexdigest()), kinds, strict=True)], names)


def digest_of_lists(df: DataFrame, scratch: Scratch, group: list[str], value: str, size: int = 8192) -> DataFrame:
    """(group, sha256): SHA-256 of each group's values, ascending and joined by commas.

    A digest is made from first to last, so the values of one group end in one task; they
    come to it as texts of ``size`` values, one at a time, and are never held together.
    """
    ship(df.sparkSession)
    width = len(group)
    keys = [f"k{i}" for i in range(width)]
    rows = df.select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], F.col(value).alias("value"))
    dealt = rows.repartitionByRange(*keys, "value").sortWithinPartitions(*keys, "value")
    named = ", ".join(f"{k} long" for k in keys)
    pieces = dealt.mapInArrow(lambda it: _pieces(it, width, size), f"{named}, part int, place int, piece string")
    pieces = scratch.table(pieces, "pieces")
    found = pieces.repartition(*keys).sortWithinPartitions(*keys, "part", "place").mapInArrow(lambda it: _hashed(it, width), f"{named}, sha256 string")
    return found.select(*[F.col(k).alias(g) for g, k in zip(group, keys, strict=True)], "sha256")
