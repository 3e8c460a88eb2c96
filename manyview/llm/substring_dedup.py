"""Substring deduplication on a compacted De Bruijn graph of the corpus.

Words are the alphabet, windows of ``window`` words the edges, and the runs of one word
less at a window's two ends its nodes. Only edges that occur twice matter, so the graph
is built of those, in steps that are joins and hash aggregates:

1. Windows are partitioned by their minimiser, the smallest run of ``k`` words in them;
   consecutive windows of a document with the same minimiser are a stretch. Minimisers
   met once hold no repeat and go.
2. Stretches are counted by content. Where a minimiser has one content, met twice, that
   content is a unit of the graph: a path followed by all. Where it has several, the
   windows of each are taken one by one and counted; those met twice are units.
3. The degrees of the nodes at the ends of units tell where paths branch. Over the
   other nodes, units that follow each other at their source make sections, each section
   is joined with the one before it, and pointers are doubled until every section knows
   where its path begins. Sections in a circle stay on their own.
4. Units go back to where their contents occur. What lies on one path and follows one
   source, the first occurrence, word by word makes one span, however long.
5. The words of each span are compared with those at its source, as SHA-256 of both
   texts. If any span of a path differs, all windows of that path are counted again by
   the SHA-256 of their words.

Steps 1 to 4 only nominate, so that a clash of digests cannot take words away that the
texts do not share. No step lists the occurrences of a passage in one row or task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from manyview.llm.scratch import Scratch
from manyview.llm.text_columns import row_key
from manyview.llm.word_arrays import Chunk, Runs, Words, chunks, signed, word_digests, words
from manyview.llm.worker_code import ship

#: Words of a minimiser. Shorter ones would be common by chance, longer ones leave less choice.
EDGE = 8
STRETCH = "id long, row long, m long, c1 long, c2 long, start int, n int"
#: Units of the graph as they lie in a content: its place there, its edges, its digests and its nodes.
UNITS = "id long, row long, m long, c1 long, c2 long, times long, start int, k int, n int, w1 long, w2 long, u long, v long"
SPANS = "id long, row long, start int, n int, sha binary"
CONTENT, UNIT, PLACE = ["m", "c1", "c2"], ["w1", "w2"], ["id", "row", "start", "n"]


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` values (the first, if they tie)."""
    bits = max(20, len(values).bit_length())
    low = np.uint64((1 << bits) - 1)
    v = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    if span < width:
        v = np.minimum(v[: len(v) - (width - span)], v[width - span :])
    return (v & low).astype(np.int64)


def both_runs(chunk: Chunk, w: Words) -> tuple[Runs, Runs]:
    """Two independent digests of any run of words."""
    return Runs(word_digests(chunk, w)), Runs(word_digests(chunk, w, which=1))


def stretches(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = (batch.column(i) for i in (0, 1))
        for chunk in chunks(batch.column(2)):
            w = words(chunk)
            n = len(w.starts) - window + 1
            if n <= 0:
                continue
            first, second = both_runs(chunk, w)
            edges = first.every(k)
            least = smallest(edges, window - k + 1)
            whole = np.flatnonzero(w.text[:n] == w.text[window - 1 :])
            if not len(whole):
                continue
            at, text = least[whole], w.text[whole]
            new = np.ones(len(whole), bool)
            new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(whole)))
            start = whole[begin]
            end = start + size + window - 1
            text = w.text[start]
            here = pa.array(text + chunk.first)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(here),
                    rows.take(here),
                    pa.array(signed(edges[at[begin]])),
                    *[pa.array(signed(runs.of(start, end))) for runs in (first, second)],
                    pa.array((start - w.offsets[text]).astype(np.int32)),
                    pa.array(size.astype(np.int32)),
                ],
                names=["id", "row", "m", "c1", "c2", "start", "n"],
            )


def expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... sizes[0] of them, then the next."""
    skip = np.cumsum(sizes) - sizes
    return np.repeat(starts - skip, sizes) + np.arange(int(sizes.sum()))


def lists(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Owner of each element of a list column, and the elements."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def units(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The units in the contents that are asked for, from the texts they lie in: the
    whole content, or each of its windows if it is to be cut ``apart``."""
    for batch in batches:
        ids, rows = (batch.column(i) for i in (0, 1))
        owner, wanted = lists(batch.column(3))
        begin, size, apart = (wanted.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        content = [wanted.field(i) for i in (3, 4, 5, 6)]
        for chunk in chunks(batch.column(2)):
            mine = np.flatnonzero((owner >= chunk.first) & (owner < chunk.last))
            if not len(mine):
                continue
            w = words(chunk)
            first, second = both_runs(chunk, w)
            times = np.where(apart[mine], size[mine], 1).astype(np.int64)
            start = expand(begin[mine] + w.offsets[owner[mine] - chunk.first], times)
            place = expand(np.zeros(len(mine), np.int64), times)
            asked = np.repeat(mine, times)
            n = np.where(apart[asked], 1, size[asked]).astype(np.int64)
            end = start + n + window - 1
            here = pa.array(owner[asked])
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(here),
                    rows.take(here),
                    *[c.take(pa.array(asked)) for c in content],
                    *[pa.array(x.astype(np.int32)) for x in (begin[asked] + place, place, n)],
                    *[pa.array(signed(runs.of(start, end))) for runs in (first, second)],
                    pa.array(signed(first.of(start, start + window - 1))),
                    pa.array(signed(first.of(end - window + 1, end))),
                ],
                names=["id", "row", "m", "c1", "c2", "times", "start", "k", "n", "w1", "w2", "u", "v"],
            )


def spelled(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the words of each span asked for, joined by a space."""
    for batch in batches:
        ids, rows = (batch.column(i) for i in (0, 1))
        owner, wanted = lists(batch.column(3))
        begin, size = (wanted.field(i).to_numpy(zero_copy_only=False) for i in range(2))
        for chunk in chunks(batch.column(2)):
            mine = np.flatnonzero((owner >= chunk.first) & (owner < chunk.last))
            if not len(mine):
                continue
            w, raw = words(chunk), chunk.data.tobytes()
            start = begin[mine] + w.offsets[owner[mine] - chunk.first]
            last = start + size[mine] + window - 2
            text = [b" ".join(raw[a:b].split()) for a, b in zip(w.starts[start].tolist(), w.ends[last].tolist(), strict=True)]
            here = pa.array(owner[mine])
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(here),
                    rows.take(here),
                    *[pa.array(x[mine].astype(np.int32)) for x in (begin, size)],
                    pa.array([hashlib.sha256(t).digest() for t in text], pa.binary()),
                ],
                names=["id", "row", "start", "n", "sha"],
            )


def cut(batches: Iterator[pa.RecordBatch], window: int, carried: int) -> Iterator[pa.RecordBatch]:
    """Texts without the words that the windows cover."""
    for batch in batches:
        owner, spans = lists(batch.column(carried + 1))
        begin, size = (spans.field(i).to_numpy(zero_copy_only=False) for i in range(2))
        n_words, n_gone, kept = [], [], []
        for chunk in chunks(batch.column(carried)):
            w = words(chunk)
            mine = np.flatnonzero((owner >= chunk.first) & (owner < chunk.last))
            at = begin[mine] + w.offsets[owner[mine] - chunk.first]
            change = np.zeros(len(w.starts) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + size[mine] + window - 1, -1)
            gone = np.cumsum(change)[:-1] > 0
            n_words.append(np.diff(w.offsets))
            sums = np.concatenate([[0], np.cumsum(gone)])
            n_gone.append(sums[w.offsets[1:]] - sums[w.offsets[:-1]])
            raw = chunk.data.tobytes()
            for i in range(chunk.last - chunk.first):
                a, b = w.offsets[i], w.offsets[i + 1]
                if n_gone[-1][i]:
                    left = np.flatnonzero(~gone[a:b]) + a
                    kept.append(b" ".join([raw[s:e] for s, e in zip(w.starts[left].tolist(), w.ends[left].tolist(), strict=True)]))
                else:
                    kept.append(b" ".join(raw[chunk.offsets[i] : chunk.offsets[i + 1]].split()))
        none = [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(i) for i in range(carried)],
                pa.array(np.concatenate(n_words or none)),
                pa.array(np.concatenate(n_gone or none)),
                pa.array(kept, pa.binary()).cast(pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            ],
            names=[*batch.schema.names[:carried], "__sub_words", "__sub_removed", "__sub_kept", "__sub_sha256"],
        )


def joined_units(found: DataFrame, scratch: Scratch) -> DataFrame:
    """``found``, units with their source and the digests of their nodes, each with the
    unit that its path begins with as (p1, p2); that may be itself."""
    out = found.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("outs"))
    into = found.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("ins"))
    passed = scratch.table(out.where("outs = 1").join(into.where("ins = 1"), "node").select("node"), "passed")
    # units that follow each other at their source too make a section; only sections are joined by their nodes
    at = Window.partitionBy("source.id", "source.row").orderBy("source.start")
    over = found.join(passed.select(F.col("node").alias("u"), F.lit(True).alias("over")), "u", "left")
    follows = F.col("over") & (F.lag(F.col("source.start") + F.col("n")).over(at) == F.col("source.start"))
    cut = over.withColumn("fresh", (~F.coalesce(follows, F.lit(False))).cast("int")).withColumn("part", F.sum("fresh").over(at))
    head = F.first(F.struct(*UNIT)).over(Window.partitionBy("source.id", "source.row", "part").orderBy("source.start"))
    cut = scratch.table(cut.select(*UNIT, "source", "u", "v", head.alias("head")), "cut")
    sections = cut.groupBy(F.col("head.w1").alias("w1"), F.col("head.w2").alias("w2")).agg(F.min_by("u", "source.start").alias("u"), F.max_by("v", "source.start").alias("v"))
    sections = scratch.table(sections, "sections")
    before = sections.select(F.col("w1").alias("p1"), F.col("w2").alias("p2"), F.col("v").alias("node")).join(passed, "node")
    links = scratch.table(before.join(sections.select(*UNIT, F.col("u").alias("node")), "node").select(*UNIT, "p1", "p2"), "links")
    # a pointer is settled if it points at the beginning of a path, which has no link of its own
    tails = links.select(F.col("w1").alias("p1"), F.col("w2").alias("p2"), F.lit(False).alias("settled"))
    state = scratch.table(links.join(tails, ["p1", "p2"], "left").select(*UNIT, "p1", "p2", F.coalesce("settled", F.lit(True)).alias("settled")), "pointers")
    loose, done = state.where("NOT settled"), [state.where("settled")]
    left, steps = loose.count(), 1
    while left:
        # four steps a round: where a pointer's unit points, twice over
        known = done[0]
        for d in done[1:]:
            known = known.unionByName(d)
        jump = known.unionByName(loose).select(F.col("w1").alias("p1"), F.col("w2").alias("p2"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("settled").alias("sure"))
        moved = loose.drop("settled")
        for _ in range(2):
            moved = moved.join(jump, ["p1", "p2"], "left")
            moved = moved.select(*UNIT, F.coalesce("q1", "p1").alias("p1"), F.coalesce("q2", "p2").alias("p2"), F.coalesce("sure", F.lit(True)).alias("settled"))
        state = scratch.table(moved, "pointers")
        loose, now = state.where("NOT settled"), state.where("NOT settled").count()
        done.append(state.where("settled"))
        steps += 1
        # units in circles are never settled: as many are left as were before
        if now == left:
            break
        left = now
    paths = done[0]
    for d in done[1:]:
        paths = paths.unionByName(d)
    paths = paths.select(F.struct(*UNIT).alias("head"), "p1", "p2")
    return cut.join(paths, "head", "left").select(*UNIT, "source", F.coalesce("p1", "head.w1").alias("p1"), F.coalesce("p2", "head.w2").alias("p2"))


def repeated_spans(keyed: DataFrame, window: int, edge: int, scratch: Scratch) -> DataFrame:
    """(id, row, start, n): the windows of ``keyed`` (id, row, text) whose words start
    elsewhere too, as spans of ``n`` consecutive windows each."""
    every = scratch.table(keyed.mapInArrow(lambda it: stretches(it, window, edge), STRETCH), "stretches")
    again = scratch.table(every.groupBy("m").count().where("count > 1").select("m"), "minimisers")
    met = scratch.table(every.join(again, "m", "left_semi"), "met")
    scratch.drop(every, again)
    contents = scratch.table(met.groupBy(*CONTENT).agg(F.count("*").alias("times"), F.min(F.struct(*PLACE)).alias("one")), "contents")
    branching = scratch.table(contents.groupBy("m").count().where("count > 1").select("m", F.lit(True).alias("apart")), "branching")
    # one place of each content is enough to take its units from
    ask = contents.join(branching, "m", "left").withColumn("apart", F.coalesce("apart", F.lit(False)))
    ask = ask.groupBy("one.id", "one.row").agg(F.collect_list(F.struct("one.start", "one.n", "apart", *CONTENT, "times")).alias("ask"))
    said = keyed.alias("d").join(ask.alias("a"), F.expr("d.id <=> a.id AND d.row = a.row")).select("d.id", "d.row", "d.text", "ask")
    placed = scratch.table(said.mapInArrow(lambda it: units(it, window), UNITS), "units")
    # where a unit occurs first is its source; it counts as often as the contents that it lies in were met
    found = placed.groupBy(*UNIT).agg(F.sum("times").alias("times"), F.min(F.struct("id", "row", "start")).alias("source"), F.first("n").alias("n"), F.first("u").alias("u"), F.first("v").alias("v"))
    found = scratch.table(found.where("times > 1").drop("times"), "found")
    paths = scratch.table(joined_units(found, scratch), "paths")
    # what follows one source within a content is one part of it
    lies = [F.col("source.id").alias("s_id"), F.col("source.row").alias("s_row"), (F.col("source.start") - F.col("k")).alias("shift")]
    parts = placed.select(*CONTENT, "k", "n", *UNIT).join(paths, UNIT).select(*CONTENT, "p1", "p2", *lies, "k", (F.col("k") + F.col("n")).alias("end"))
    parts = scratch.table(parts.groupBy(*CONTENT, "p1", "p2", "s_id", "s_row", "shift").agg(F.min("k").alias("k"), F.max("end").alias("end")), "parts")
    scratch.drop(placed)
    here = met.join(parts, CONTENT).select(
        "id", "row", (F.col("start") + F.col("k")).alias("start"), (F.col("start") + F.col("end")).alias("end"), "p1", "p2", "s_id", "s_row", (F.col("shift") - F.col("start")).alias("shift")
    )
    # parts of one path that follow each other at the source too are one span
    same = ["id", "row", "p1", "p2", "s_id", "s_row", "shift"]
    along = Window.partitionBy(*same).orderBy("start", "end")
    fresh = F.coalesce(F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)) < F.col("start"), F.lit(True))
    here = here.withColumn("fresh", fresh).withColumn("island", F.sum(F.col("fresh").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = here.groupBy(*same, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = scratch.table(spans.select("id", "row", "start", (F.col("end") - F.col("start")).alias("n"), "p1", "p2", "s_id", "s_row", (F.col("start") + F.col("shift")).alias("s_start")), "spans")
    scratch.drop(met, parts)
    return verified(keyed, spans, window, scratch)


def spell(keyed: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """``asked`` places (id, row, start, n) with the SHA-256 of their words, each once for every row that has this id and text."""
    asked = asked.groupBy("id", "row").agg(F.collect_set(F.struct("start", "n")).alias("ask"))
    said = keyed.alias("d").join(asked.alias("a"), F.expr("d.id <=> a.id AND d.row = a.row"))
    return said.select("d.id", "d.row", "d.text", "ask").mapInArrow(lambda it: spelled(it, window), SPANS)


def verified(keyed: DataFrame, spans: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """The spans whose words are those at their source; the windows of other paths as they repeat."""
    source = ["s_id", "s_row", "s_start", "n"]
    away = spans.where("NOT (id <=> s_id AND row = s_row AND start = s_start)")
    asked = away.select(*PLACE).unionByName(away.select(*[F.col(c).alias(p) for c, p in zip(source, PLACE, strict=True)]))
    read = scratch.table(spell(keyed, asked, window).dropDuplicates(PLACE), "read")
    own, theirs = (read.select(*[F.col(c).alias(f"{side}_{c}") for c in (*PLACE, "sha")]) for side in ("own", "src"))
    a = away.join(own, F.expr("id <=> own_id AND row = own_row AND start = own_start AND n = own_n"))
    a = a.join(theirs, F.expr("s_id <=> src_id AND s_row = src_row AND s_start = src_start AND n = src_n"))
    bad = scratch.table(a.where("own_sha <> src_sha").select("p1", "p2").distinct(), "bad")
    if bad.isEmpty():
        return spans.select(*PLACE)
    good = spans.join(bad, ["p1", "p2"], "left_anti").select(*PLACE)
    again = spans.join(bad, ["p1", "p2"], "left_semi").select("id", "row", F.explode(F.sequence("start", F.expr("start + n - 1"))).alias("start"), F.lit(1).alias("n"))
    told = scratch.table(spell(keyed, again, window).groupBy(*PLACE, "sha").agg(F.count("*").alias("rows")), "told")
    twice = scratch.table(told.groupBy("sha").agg(F.sum("rows").alias("rows")).where("rows > 1").select("sha"), "twice")
    return good.unionByName(told.join(twice, "sha", "left_semi").select(*PLACE))


def drop_repeated_windows(
    docs: DataFrame, carry: list[str], *, window: int = 35, edge: int = EDGE, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Columns ``carry`` of every row, with ``__sub_words`` (the number of words),
    ``__sub_removed``, ``__sub_kept`` (the words left, joined by a space) and
    ``__sub_sha256`` of the latter.

    A word goes if a window of ``window`` words over it also starts anywhere else,
    in the same document or another. Null and empty texts have no words; texts of
    fewer words than a window stay. Rows equal in id and text are two places for
    every window of theirs. Null ids are ids like others. Very long texts are cut into
    stretches like others; all spans of one text meet in one row. An empty table gives an
    empty result. Columns of ``docs`` beside ``carry`` are not read; names that begin with
    ``__sub_`` are reserved.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    ship(docs.sparkSession)
    keyed = docs.select(F.col(doc_id).cast("long").alias("id"), row_key(F.col(doc_id), F.col(text)).alias("row"), F.col(text).alias("text"))
    spans = repeated_spans(keyed, window, edge, scratch)
    spans = spans.groupBy(F.col("id").alias("__sub_in_id"), F.col("row").alias("__sub_in_row")).agg(F.collect_set(F.struct("start", "n")).alias("__sub_spans"))
    rows = docs.select(*[F.col(c) for c in carry], F.col(text).alias("__sub_text"), F.col(doc_id).cast("long").alias("__sub_id"), row_key(F.col(doc_id), F.col(text)).alias("__sub_row"))
    joined = rows.join(spans, F.expr("__sub_id <=> __sub_in_id AND __sub_row = __sub_in_row"), "left").select(*carry, "__sub_text", "__sub_spans")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema.fields)
    return joined.mapInArrow(
        lambda it: cut(it, window, len(carry)), f"{fields}, __sub_words long, __sub_removed long, __sub_kept string, __sub_sha256 string"
    )
