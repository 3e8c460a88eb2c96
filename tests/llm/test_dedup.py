"""Substring, line and near deduplication against plain Python."""

from collections import Counter

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from manyview.llm import near_dedup
from manyview.llm.line_dedup import LineRuns, drop_repeated_lines, keyed_lines
from manyview.llm.near_dedup import near_duplicates
from manyview.llm.scratch import Scratch
from manyview.llm.substring_dedup import drop_repeated_windows, joined_units, smallest, verified


def bag(rows):
    return Counter(map(tuple, rows))


def test_substring(documents, corpus):
    out = drop_repeated_windows(documents, ["doc_id", "id", "row"])
    assert out.columns[:3] == ["doc_id", "id", "row"]
    got = out.select("doc_id", "__sub_words", "__sub_removed", "__sub_sha256").collect()
    want = [(i, *r) for (i, _), r in zip(corpus, plain.without_repeats(corpus), strict=True)]
    assert bag(got) == bag(want)
    assert sum(r[2] for r in got) > 0


def test_substring_keeps_text(documents):
    kept = drop_repeated_windows(documents.where("doc_id = 27"), ["doc_id"]).first()
    assert kept["__sub_removed"] == 0 and len(plain.words(kept["__sub_kept"])) == kept["__sub_words"]


def thue_morse(n):
    """A regular word of n characters and its complement, on which digests that are polynomials agree."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_regular_words_do_not_meet(spark):
    one, two = thue_morse(1024)
    around = [f"w{i}" for i in range(34)]
    docs = spark.createDataFrame([(1, " ".join([one, *around])), (2, " ".join([two, *around])), (3, one), (4, two)], "doc_id long, text string")
    assert {r["__sub_removed"] for r in drop_repeated_windows(docs, ["doc_id"]).collect()} == {0}
    assert all(r["id"] == r["component"] for r in near_duplicates(docs.where("doc_id > 2")).collect())


@pytest.mark.parametrize("window", [5, 12])
def test_substring_of_other_windows(documents, corpus, window):
    got = drop_repeated_windows(documents, ["doc_id"], window=window, edge=4).select("doc_id", "__sub_words", "__sub_removed", "__sub_sha256").collect()
    assert bag(got) == bag([(i, *r) for (i, _), r in zip(corpus, plain.without_repeats(corpus, window), strict=True)])


def test_spans_are_believed_only_if_the_words_agree(spark):
    """Spans that digests would have put together wrongly are counted again by their words."""
    words = [f"w{i}" for i in range(9)]
    keyed = spark.createDataFrame([(1, 1, " ".join(words)), (2, 2, " ".join([*words[:6], "other", "two", "three"])), (3, 3, "nothing like it at all")], "id long, row long, text string")
    spans = [(1, 1, 0, 6, 7, 7, 1, 1, 0), (2, 2, 0, 6, 7, 7, 1, 1, 0), (3, 3, 0, 2, 7, 7, 1, 1, 0)]
    kinds = "id long, row long, start int, n int, p1 long, p2 long, s_id long, s_row long, s_start int"
    got = verified(keyed, spark.createDataFrame(spans, kinds), 4, Scratch(spark, "test")).collect()
    assert {tuple(r) for r in got} == {(d, d, i, 1) for d in (1, 2) for i in range(3)}
    good = spark.createDataFrame([(1, 1, 0, 3, 7, 7, 1, 1, 0), (2, 2, 0, 3, 7, 7, 1, 1, 0)], kinds)
    assert {tuple(r) for r in verified(keyed, good, 4, Scratch(spark, "test")).collect()} == {(1, 1, 0, 3), (2, 2, 0, 3)}


def test_units_are_joined_over_nodes_that_do_not_branch(spark):
    """a-b-c is a path, d and e branch off, f and g go in a circle."""
    edges = {"a": (1, 2), "b": (2, 3), "c": (3, 4), "d": (4, 5), "e": (4, 6), "f": (8, 9), "g": (9, 8)}
    rows = [(i, i, 1, (i, i, 0), u, v) for i, (u, v) in enumerate(edges.values())]
    found = spark.createDataFrame(rows, "w1 long, w2 long, n int, source struct<id:long,row:long,start:int>, u long, v long")
    got = {r["w1"]: r["p1"] for r in joined_units(found, Scratch(spark, "test")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6}


def test_long_paths_are_joined(spark):
    rows = [(i, i, 1, (i % 7, 0, i), i, i + 1) for i in range(300)]
    found = spark.createDataFrame(rows, "w1 long, w2 long, n int, source struct<id:long,row:long,start:int>, u long, v long")
    assert {r["p1"] for r in joined_units(found, Scratch(spark, "test")).collect()} == {0}


def test_smallest_takes_the_first_of_equals():
    v = np.array([5, 3, 3, 9, 1, 1, 7, 8], np.uint64) << np.uint64(50)
    assert smallest(v, 3).tolist() == [1, 1, 4, 4, 4, 5]
    assert smallest(v, 1).tolist() == list(range(8))


def test_lines(documents, corpus):
    out = drop_repeated_lines(documents, ["doc_id", "gone", "pos", "id"], batches=3)
    got = [(r["doc_id"], r["__line_n"], r["__line_dropped"], plain.sha(r["__line_kept"])) for r in out.collect()]
    want = [(i, *r) for (i, _), r in zip(corpus, plain.without_lines(corpus), strict=True)]
    assert bag(got) == bag(want)
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("batches, fanout", [(1, 2), (5, 1)])
def test_line_runs_do_not_depend_on_batches(spark, documents, batches, fanout):
    runs = LineRuns(spark, fanout)
    keyed = keyed_lines(documents, 40)
    for i in range(batches):
        runs.add(keyed.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == i))
        assert all(len(level) <= fanout for level in runs.levels)
    # the anti joins see to it that no key stands in two runs
    stored = [tuple(r) for run in runs.runs() for r in run.keys.select("k1", "k2").collect()]
    assert len(stored) == len(set(stored)) == keyed.select("k1", "k2").distinct().count()
    assert batches == 1 or any(len(level) for level in runs.levels[1:])
    got = runs.frequent(2)
    whole = keyed.groupBy("k1", "k2").agg(F.countDistinct(F.coalesce("id", F.lit(-1))).alias("docs"), F.max("id").alias("last")).where("docs >= 2")
    assert bag(got.collect()) == bag(whole.collect())


def test_near(documents, corpus):
    got = near_duplicates(documents).select("id", "n", "component").collect()
    want = [(i, *r) for (i, _), r in zip(corpus, plain.groups(corpus), strict=True)]
    assert bag(got) == bag(want)
    assert max(Counter(r[2] for r in got).values()) > 10


def test_near_in_small_blocks(documents, corpus, monkeypatch):
    """Pairs in different blocks of a cluster are compared too."""
    monkeypatch.setattr(near_dedup, "BLOCK", 6)
    monkeypatch.setattr(near_dedup, "TEXT_BYTES", 3000)
    got = near_duplicates(documents).select("id", "n", "component").collect()
    assert bag(got) == bag([(i, *r) for (i, _), r in zip(corpus, plain.groups(corpus), strict=True)])


def test_near_copies_that_are_not_linked_to_their_centre(spark):
    """A chain of texts, each like the next and unlike the others, is one component."""
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(12):
        words = [*words[12:], *[f"x{i}_{j}" for j in range(12)]]
        rows.append((i + 5, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(docs).select("id", "n", "component").collect()
    assert bag(got) == bag([(i, *r) for (i, _), r in zip(rows, plain.groups(rows), strict=True)]) and {r[2] for r in got} == {5}


def test_near_keeps_one_of_each(documents):
    kept = near_duplicates(documents).where("keeper").select("id", "row").distinct()
    every = near_duplicates(documents).select("component", (F.col("n") == 0).alias("empty"), "id", "row")
    classes = every.where("NOT empty AND component IS NOT NULL").select("component").distinct().count()
    assert kept.where("id IS NOT NULL").count() >= classes


def test_least_matches_falls_with_the_threshold():
    high, low = (near_dedup.least_matches(t, 1e-6) for t in (0.85, 0.5))
    assert all(h > x for h, x in zip(high, low, strict=True))
    # the chance that 85 in 100 agree so seldom is small
    assert high[-1] < 0.85 * near_dedup.BATCHES[-1]


def test_empty_tables(nothing):
    assert drop_repeated_windows(nothing, ["doc_id"]).count() == 0
    assert drop_repeated_lines(nothing, ["doc_id"]).count() == 0
    assert near_duplicates(nothing).count() == 0
