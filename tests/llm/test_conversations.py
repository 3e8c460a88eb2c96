"""Conversations against plain Python."""

import random

import plain_conversations as plain
import pytest
from pyspark.sql import functions as F

from manyview.llm import conversation_trie
from manyview.llm.running import digest_of_lists, running
from manyview.llm.scratch import Scratch

SCHEMA = "conv_id long, turn long, role string, text string, node long, depth string, part int"
TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.fixture(scope="module")
def said():
    """Conversations that share beginnings, with nulls, ties, repeated rows, a long one and many alike."""
    rng = random.Random(5)
    rows = []
    for c in [*range(70), -3, -45, 400, 418, 2**40 + 7]:
        for t in range(rng.choice([0, 1, 2, 3, 4, 7])):
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", "assistant", "system", None, ""]), rng.choice(["", None, "yes", "a b  c", "one two\tthree\n four. ", "x" * 50])))
    rows += [(440, t, "user" if t % 2 else "assistant", f"turn {t % 7} of many") for t in range(900)]
    rows += [(460 + c, t, "user", "the same again") for c in range(120) for t in range(4)]
    rows += [rows[3], rows[3], (None, 1, "user", "of no conversation"), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (5, 1, "assistant", "tie")]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", 2) for r in rows], SCHEMA).repartition(3)


def built(spark, df):
    scratch = Scratch(spark, "trie")
    return conversation_trie.prefix_trie(*conversation_trie.with_shared_starts(conversation_trie.sequences(df, scratch), scratch), scratch)


def test_trie(spark, said):
    out = built(spark, table(spark, said))
    got = [tuple(r[c] for c in TRIE) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == plain.trie(said)
    assert 1 <= out.agg(F.max("level")).first()[0] <= 8  # at most log2 of the conversations


def test_trie_of_nothing(spark):
    assert built(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    alone = built(spark, spark.createDataFrame([(1, 0, "user", "gone", 1, "d", 2)], SCHEMA)).collect()
    assert {tuple(r[c] for c in TRIE) for r in alone} == plain.trie([(1, 0, "user", "gone")])


def test_running_sums_cross_tasks(spark):
    rows = [(1, i, 2**60 + i, i if i % 400 == 7 else None) for i in range(3000)] + [(g, i, g, None) for g in range(2, 40) for i in range(5)]
    df = spark.createDataFrame(rows, "g long, i long, x long, y long").repartition(5)
    scratch = Scratch(spark, "running")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        small = df.withColumn("one", F.lit(1).cast("long"))
        got = {(r["g"], r["i"]): (r["n"], r["s"], r["l"]) for r in running(small, scratch, ["g"], [F.col("i")], {"n": "one", "s": "x"}, ("s",), {"l": "y"}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, sums, last = {}, {}, {}
    for g, i, x, y in rows:
        sums[g] = (sums.get(g, 0) + x) % 2**61
        last[g] = y if y is not None else last.get(g)
        want[g, i] = (i + 1, sums[g], last[g])
    assert got == want


def test_digest_of_lists(spark):
    rows = [(1, 0, i * 7 % 1000) for i in range(1000)] + [(2, 5, -3), (2, 5, 11), (3, 0, 4)]
    df = spark.createDataFrame(rows, "a long, b long, v long").repartition(4)
    got = {(r["a"], r["b"]): r["sha256"] for r in digest_of_lists(df, Scratch(spark, "lists"), ["a", "b"], "v", size=16).collect()}
    assert got == {(1, 0): plain.sha(",".join(map(str, range(1000)))), (2, 5): plain.sha("-3,11"), (3, 0): plain.sha("4")}
