"""Repairing conversations against plain Python."""

import random

import plain_conversations as plain
import pytest

from manyview.llm import role_grammar
from manyview.llm.conversation_repair import Repair, damage
from manyview.llm.role_grammar import Kind

SCHEMA = "conv_id long, turn long, role string, text string, copies long, cost int, part string, digest string"
REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def conversation(rng, c, n):
    rows = []
    for t in range(n):
        role = rng.choice(["user", "assistant"] * 6 + ["system", "tool", "", None, "unknown"]) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
        text = rng.choice(["Said so.", "Why?", "cut sho", "Yes! ", None, "", " \t\n", "Done.\n", f"This is turn {t}.", f"half of turn {t}"])
        rows.append((c, None if rng.random() < 0.05 else t * rng.choice([1, 1, 1, 2]), role, text))
    return rows


@pytest.fixture(scope="module")
def said():
    rng = random.Random(11)
    rows = [r for c in range(60) for r in conversation(rng, c, rng.choice([1, 2, 3, 5, 9, 14]))]
    rows += conversation(rng, 900, 700)
    rows += conversation(rng, None, 6)
    rows += [(901, 3, "user", "the same row, over and over."), (902, None, "system", "Be kind."), (903, 1, "assistant", "x" * 3000 + ".")] + [(901, 3, "user", "the same row, over and over.")] * 80
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 7, "p", "d") for r in rows], SCHEMA).repartition(4)


def check(repair, rows, ids):
    want = plain.repairs(rows, ids)
    got = {r["conv_id"]: tuple(r[c] for c in REPORT) for r in repair.report().collect()}
    assert set(got) == set(ids)
    for i in ids:
        assert got[i] == want[i][0], i
    lines = {}
    for r in sorted(repair.repaired().collect(), key=lambda r: (r["part"], r["place"])):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert lines == {i: v[1] for i, v in want.items() if v[1]}


def test_repair(spark, said):
    check(Repair(table(spark, said)), said, {r[0] for r in said})


def test_conversations_in_many_tasks(spark, said):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        repair = Repair(table(spark, said))
        assert repair.edited.where("conv = 900").select("part").distinct().count() > 5
        check(repair, said, {r[0] for r in said})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_planted_faults(spark, said):
    out = damage(table(spark, said))
    got = sorted(((r["conv_id"], r["turn"], r["role"], r["text"]) for r in out.collect() for _ in range(r["copies"])), key=str)
    assert got == sorted(plain.damaged(said), key=str)
    check(Repair(out), plain.damaged(said), {r[0] for r in said})


def test_nothing(spark):
    assert Repair(spark.createDataFrame([], SCHEMA)).report().count() == 0
    gone = Repair(spark.createDataFrame([(5, 1, "user", "Dropped.", 0, 1, "p", "d")], SCHEMA)).report().collect()
    assert [tuple(r) for r in gone] == [(5, 0, 0, 0, 0, 0, 0, "", plain.sha(""))]


def test_parser_against_all_edits():
    """Short conversations, and stretches of them put together."""
    rng = random.Random(2)
    for n in [0, 1, 2, 3, 4, 6, 9] * 60:
        kinds = [Kind(rng.choice(["s", "u", "a", ""]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]
        moves, tail = role_grammar.parse(kinds)
        audit = "".join(m.letters for m in moves) + "I" * len(tail)
        cost = sum(m.cost for m in moves) + 5 * len(tail)
        # as turns of which the plain version finds the same faults
        turns = [(1, i, {"s": "system", "u": "user", "a": "assistant", "": "x"}[k.initial], "" if k.must_go else f"turn {i}" + "." * (not k.truncated)) for i, k in enumerate(kinds)]
        want = plain.repair(turns)[0]
        assert (cost, audit) == want[5:7]
        cuts = sorted(rng.sample(range(1, n), min(n - 1, 2))) if n > 1 else []
        pieces = [kinds[i:j] for i, j in zip([0, *cuts], [*cuts, n], strict=True)]
        symbols = role_grammar.join_stretches([role_grammar.stretch(p) for p in pieces])
        whole = ""
        for i, (piece, (begin, end)) in enumerate(zip(pieces, symbols, strict=True)):
            some, tail = role_grammar.parse(piece, begin, end if i + 1 < len(pieces) else None)
            whole += "".join(m.letters for m in some) + "I" * len(tail)
        assert whole == audit
