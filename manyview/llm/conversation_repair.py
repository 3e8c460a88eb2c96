"""Repairing the structure of conversations: faults, the cheapest edits, and what they give.

Turns are told by (conversation, turn, role, digest of the text); equal ones are one row
with a number, so that faults, order and parsing need no text. They are dealt out in
ranges of that order. What a task has of a conversation is a stretch; stretches of one
conversation are parsed from every symbol, put together, and only then traced, so that a
conversation of any length needs no task of its own. Texts come last, merged with the
edits in the same order. What a digest of a whole conversation cannot do in one task goes
on to another as bytes, a block at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyview.llm.role_grammar import Kind, join_stretches, parse, stretch
from manyview.llm.scratch import Scratch
from manyview.llm.text_columns import ASCII_SPACE
from manyview.llm.worker_code import ship

#: SHA-256 of nothing.
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
LEGAL = {"su", "ua", "au"}
#: The conversation; with it, the order of its turns: null turns first, ties by role and digest.
CONV = ["none", "conv"]
ORDER = [*CONV, "known", "turn", "role", "digest"]
BLOCK_BYTES = 1 << 20


def damage(conversations: DataFrame) -> DataFrame:
    """Turns with planted faults, and ``copies`` (0: dropped, 2: repeated).

    The fault is crc32 of `conv_id:turn` modulo 20; nulls of any column count as one space.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    return conversations.select(
        "conv_id", "turn", F.when(k == 4, "user").otherwise(text_of("role")).alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).cast("long").alias("copies")
    )


def _keyed(turns: DataFrame, *more: Column) -> DataFrame:
    c, t = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    zero = F.lit(0).cast("long")
    text = F.coalesce(F.col("text"), F.lit(""))
    return turns.where("copies > 0").select(
        c.isNull().cast("long").alias("none"),
        F.coalesce(c, zero).alias("conv"),
        t.isNotNull().cast("long").alias("known"),
        F.coalesce(t, zero).alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        *more,
    )


def faults(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct turns (``ORDER``) with their copies, whether blank, cut short, or said before in an earlier turn."""
    text = F.coalesce(F.col("text"), F.lit(""))
    said = F.rtrim(text, F.lit(ASCII_SPACE))
    blank, cut = said == "", ~F.substring(said, -1, 1).isin(".", "!", "?")
    rows = _keyed(turns, blank.alias("blank"), cut.alias("cut"), "copies").groupBy(*ORDER, "blank", "cut").agg(F.sum("copies").alias("copies"))
    rows = scratch.table(rows, "turns")
    alike = [*CONV, "role", "digest"]
    first = rows.groupBy(*alike).agg(F.count("*").alias("n"), F.min(F.struct("known", "turn")).alias("first")).where("n > 1").drop("n")
    return rows.join(first, alike, "left").withColumn("again", F.coalesce(F.struct("known", "turn") > F.col("first"), F.lit(False))).drop("first")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], [*b.schema.names, "part", "at"])
        at += n


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of each (none, conv, part), which come one after another."""
    rows = (row for b in batches for row in b.to_pylist())
    for key, group in groupby(rows, lambda r: (r["none"], r["conv"], r["part"])):
        yield key, list(group)


def _kind(row: dict) -> Kind:
    first = row["role"][:1]
    return Kind(first if first in ("s", "u", "a") else "", row["blank"] or row["again"], row["cut"])


SUMMARY = "none long, conv long, part int, costs array<long>, orders array<long>, ends string"
SYMBOLS = "none long, conv long, part int, begin int, end int, before string"
EDITS = (
    "none long, conv long, known long, turn long, role string, digest binary, cost long, illegal long, audit string, part int, new_role string, lead array<string>, tail array<string>"
)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (none, conv, part), rows in _stretches(batches):
        costs, orders = stretch([_kind(r) for r in rows])
        line = {"none": none, "conv": conv, "part": part, "costs": costs, "orders": orders, "ends": rows[-1]["role"][:1]}
        yield pa.RecordBatch.from_pylist([line], _arrow(SUMMARY))


def _symbols(t: pa.Table) -> pa.Table:
    """For each stretch of one conversation: its symbols (no end for the last) and the initial before it."""
    rows = sorted(t.to_pylist(), key=lambda r: r["part"])
    ways = join_stretches([(r["costs"], r["orders"]) for r in rows])
    out = []
    for i, (r, (begin, end)) in enumerate(zip(rows, ways, strict=True)):
        before = rows[i - 1]["ends"] if i else None
        out.append({"none": r["none"], "conv": r["conv"], "part": r["part"], "begin": begin, "end": end if i + 1 < len(rows) else None, "before": before})
    return pa.Table.from_pylist(out, _arrow(SYMBOLS))


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: list[dict] = []
    for _, rows in _stretches(batches):
        one = rows[0]
        moves, tail = parse([_kind(r) for r in rows], one["begin"] or 0, one["end"])
        last, audit = one["before"], []
        for r, move in zip(rows, moves, strict=True):
            more = r["copies"] - 1
            first = r["role"][:1]
            r |= {"cost": move.cost + 2 * more, "illegal": (last is not None and last + first not in LEGAL) + more, "lead": list(move.inserted) or None, "tail": None, "audit": None}
            r["new_role"] = None if move.role is None else move.role or r["role"]
            last = first
            audit.append(move.letters + "D" * more)
        one["audit"] = "".join(audit) + "I" * len(tail)
        if tail:
            rows[-1]["tail"] = list(tail)
            rows[-1]["cost"] += 5 * len(tail)
        kept += rows
        if len(kept) >= 4096:
            yield pa.RecordBatch.from_pylist(kept, _arrow(EDITS))
            kept = []
    if kept:
        yield pa.RecordBatch.from_pylist(kept, _arrow(EDITS))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in ddl.split(", "))])


def edits(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``ORDER``, and of each turn: cost, illegal (pairs that end with it), new_role (null: deleted), lead
    and tail (roles put in before and after). The first of a stretch has the ``audit`` of all of it."""
    dealt = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*ORDER, "blank", "cut", "copies", "again").schema.fields)
    placed = scratch.table(dealt.select(*ORDER, "blank", "cut", "copies", "again").mapInArrow(_placed, f"{fields}, part int, at long"), "placed")
    by_stretch = lambda df: df.repartition(*CONV, "part").sortWithinPartitions(*CONV, "part", "at")
    # conversations in several parts: fewer than twice the number of tasks have rows here
    parted = scratch.table(placed.groupBy(*CONV).agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select(*CONV), "parted")
    summed = by_stretch(placed.join(F.broadcast(parted), CONV, "left_semi")).mapInArrow(_summaries, SUMMARY)
    symbols = scratch.table(summed.groupBy(*CONV).applyInArrow(_symbols, SYMBOLS), "symbols")
    ready = placed.join(F.broadcast(symbols), [*CONV, "part"], "left")
    return scratch.table(by_stretch(ready).mapInArrow(_edits, EDITS), "edits")


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One of equal turns of a batch, so that copies are not all sent to one task."""
    for b in batches:
        t = pa.Table.from_batches([b]).select(ORDER).append_column("i", pa.array(np.arange(b.num_rows)))
        yield b.take(t.group_by(ORDER).aggregate([("i", "min")])["i_min"].combine_chunks())


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str, str]]:
    """((none, conv), role, text) of the repaired turns, from edits each followed by its texts."""
    waiting, edit = None, None
    for b in batches:
        for r in b.to_pylist():
            key = tuple(r[c] for c in ORDER)
            if r["edited"] == 0:
                waiting, edit = key, r
                if r["new_role"] is None:
                    yield from ((key[:2], name, "") for name in r["tail"] or ())
                    waiting = None
            elif key == waiting:
                yield from ((key[:2], name, "") for name in edit["lead"] or ())
                yield key[:2], edit["new_role"], r["text"]
                yield from ((key[:2], name, "") for name in edit["tail"] or ())
                waiting = None


TURNS = "none long, conv long, part int, place long, role string, text string"
HASHED = "none long, conv long, part int, place long, block binary, sha256 string"


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, found, size = TaskContext.get().partitionId(), [], 0
    for place, ((none, conv), role, text) in enumerate(_lines(batches)):
        found.append({"none": none, "conv": conv, "part": part, "place": place, "role": role, "text": text})
        size += len(text) + 64
        if size >= BLOCK_BYTES:
            yield pa.RecordBatch.from_pylist(found, _arrow(TURNS))
            found, size = [], 0
    yield pa.RecordBatch.from_pylist(found, _arrow(TURNS))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of a conversation that others surround, which is whole here. Of the first
    and the last of a task, and of very long ones, the bytes."""
    from pyspark import TaskContext

    part, place = TaskContext.get().partitionId(), 0
    line = lambda key, block, sha: pa.RecordBatch.from_pylist([{"none": key[0], "conv": key[1], "part": part, "place": place, "block": block, "sha256": sha}], _arrow(HASHED))
    held: list[bytes] = []
    key, size, whole = None, 0, False
    for here, role, text in _lines(batches):
        if here != key:
            if held:
                block = b"\n".join(held)
                yield line(key, None, hashlib.sha256(block).hexdigest()) if whole else line(key, block, None)
            whole = key is not None
            key, held, size = here, [], 0
        held.append(f"{role}:{text}".encode())
        size += len(held[-1])
        if size >= BLOCK_BYTES:
            yield line(key, b"\n".join(held), None)
            place, held, size, whole = place + 1, [], 0, False
    if key is not None and held:
        yield line(key, b"\n".join(held), None)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (r for b in batches for r in b.to_pylist())
    for (none, conv), blocks in groupby(rows, lambda r: (r["none"], r["conv"])):
        digest = hashlib.sha256(next(blocks)["block"])
        for r in blocks:
            digest.update(b"\n" + r["block"])
        yield pa.RecordBatch.from_pylist([{"none": none, "conv": conv, "sha256": digest.hexdigest()}], _arrow("none long, conv long, sha256 string"))


def _merged(turns: DataFrame, edited: DataFrame) -> DataFrame:
    """Edits that leave something, each before the texts of its turn."""
    fields = "none long, conv long, known long, turn long, role string, digest binary, text string"
    texts = _keyed(turns, F.coalesce(F.col("text"), F.lit("")).alias("text")).where(F.rtrim("text", F.lit(ASCII_SPACE)) != "").mapInArrow(_first_copies, fields)
    nothing = F.lit(None).cast("array<string>")
    texts = texts.select(*ORDER, F.lit(1).alias("edited"), "text", F.lit(None).cast("string").alias("new_role"), nothing.alias("lead"), nothing.alias("tail"))
    some = edited.where("new_role IS NOT NULL OR tail IS NOT NULL").select(*ORDER, F.lit(0).alias("edited"), F.lit(None).cast("string").alias("text"), "new_role", "lead", "tail")
    return some.unionByName(texts).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER, "edited")


def _named(df: DataFrame) -> Column:
    return F.when(df["none"] == 0, df["conv"]).alias("conv_id")


class Repair:
    """The repair of ``turns`` (conv_id, turn, role, text, and copies, 0 or more).

    Nulls in role and text are empty. Turns that are null come first; of turns alike,
    role and then the SHA-256 of the text decide. A null conversation is one more. Turns
    of 0 copies are not there. Blank turns and those said before (role and text) go;
    roles are told by their initials.
    """

    def __init__(self, turns: DataFrame):
        ship(turns.sparkSession)
        self.turns, self.scratch = turns, Scratch(turns.sparkSession, "repair")
        self.rows = self.scratch.table(faults(turns, self.scratch), "faults")
        self.edited = edits(self.rows, self.scratch)

    def repaired(self) -> DataFrame:
        """(conv_id, part, place, role, text): the repaired turns, in order of (part, place)."""
        out = _merged(self.turns, self.edited).mapInArrow(_turns, TURNS)
        return out.select(_named(out), "part", "place", "role", "text")

    def digests(self) -> DataFrame:
        """(none, conv, sha256) of the repaired `role:text`, joined by line ends, where any turn is left."""
        out = self.scratch.table(_merged(self.turns, self.edited).mapInArrow(_digests, HASHED), "digests")
        parted = out.where("block IS NOT NULL").repartition(*CONV).sortWithinPartitions(*CONV, "part", "place")
        joined = parted.select(*CONV, "block").mapInArrow(_joined, "none long, conv long, sha256 string")
        return out.where("sha256 IS NOT NULL").select(*CONV, "sha256").unionByName(joined)

    def report(self) -> DataFrame:
        """One row for each conversation of ``turns``: conv_id, gaps, blank, duplicate, truncated, illegal,
        cost, audit and repaired_sha256. Nothing but zeros and empty texts where no turn is there."""
        c = F.col("conv_id").cast("long")
        every = self.turns.select(c.isNull().cast("long").alias("none"), F.coalesce(c, F.lit(0).cast("long")).alias("conv")).distinct()
        turn = F.when(F.col("known") == 1, F.col("turn"))
        fresh = ~F.col("blank") & ~F.col("again")
        found = self.rows.groupBy(*CONV).agg(
            (F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn)).alias("gaps"),
            F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
            F.sum(F.when(F.col("blank"), 0).otherwise(F.col("copies") - fresh.cast("int"))).alias("duplicate"),
            F.sum((fresh & F.col("cut")).cast("long")).alias("truncated"),
        )
        # a conversation has no more audits than there are tasks
        audits = F.array_sort(F.collect_list(F.when(F.col("audit").isNotNull(), F.struct("part", "audit"))))
        edited = self.edited.groupBy(*CONV).agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(audits, lambda x: x["audit"]), "").alias("audit"))
        out = every.join(found, CONV, "left").join(edited, CONV, "left").join(self.digests(), CONV, "left")
        numbers = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        return out.select(_named(out), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(EMPTY)).alias("repaired_sha256"))
