"""The pipeline's stages, each on its own input, against plain Python."""

import random
from collections import Counter

import corpus_pipeline
import plain
import pytest
from conftest import SCHEMA, prose
from pyspark.sql import functions as F

import __spark_entry__
from manyview.llm import near_dedup

LINE = "A line that stands in many of the documents, as menus do."
ITEM = "Seven old foxes cross the frozen river each winter and nobody in the valley knows where they sleep at night."
COLUMNS = corpus_pipeline.COLUMNS


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    rows = []
    for i in range(80):
        text = prose(rng, rng.choice([30, 80, 200]), 3000)
        if i % 6 == 0:
            text += f"\n{LINE}\n{prose(rng, 9)}"
        if i % 10 == 3:
            text = f"{prose(rng, 12)}. {ITEM} {prose(rng, 12)}"
        rows.append([i, text, "en", f"s{i % 4}"])
    for i in range(12):
        words = rows[1][1].split(" ")
        if i % 2:
            words[rng.randrange(len(words))] = f"edit{i}"
        rows.append([200 + i, " ".join(words), "en", "s1"])
    rows += [[300, None, None, None], [301, "", "en", "s0"], [302, "12 345 ...", "en", "s0"], [303, LINE, None, "s2"], [304, "single", None, None], rows[2], [None, prose(rng, 50), "en", "s3"]]
    path = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "i", "r", "w", 1, "c", "g", "p") for r in rows], SCHEMA)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain_rows = [tuple(r) for r in docs.select(COLUMNS).collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == COLUMNS, name
        got = [tuple(r) for r in out.select(COLUMNS).collect()]
        pairs = [(r[0], r[1]) for r in plain_rows]
        if name == "language_id":
            kept = [r for r in plain_rows if any(c.isalpha() for c in r[1] or "")]
            # one language is known, so documents without one get it
            want = [(*r[:2], r[2] or "en", *r[3:]) for r in kept]
            assert len(kept) < len(plain_rows) and want != kept
        elif name == "line_dedup":
            want = []
            for r, (_, dropped, digest) in zip(plain_rows, plain.without_lines(pairs), strict=True):
                if not dropped:
                    want.append(r)
                    continue
                kept = next(g for g in got if g[0] == r[0]) if any(g[0] == r[0] for g in got) else None
                if kept:
                    assert plain.sha(kept[1]) == digest and kept[4] == len(kept[1])
                    want.append(kept)
            assert sum(d for _, d, _ in plain.without_lines(pairs)) > 0
        elif name == "near_dedup":
            groups = plain.groups(pairs)
            seen, want = set(), []
            for r, (n, component) in zip(plain_rows, groups, strict=True):
                mine = r[0] is None or r[0] == component
                if mine and r not in seen:
                    want.append(r)
                    seen.add(r)
            assert len(want) < len(plain_rows)
        elif name == "decontamination":
            want = [r for r in plain_rows if ITEM not in r[1]]
            assert len(want) < len(plain_rows)
        else:
            size = {r: len(plain.words(r[1])) for r in plain_rows}
            total = Counter()
            for r in plain_rows:
                total[r[3]] += size[r]
            goal = plain.targets(total)
            taken, copies = Counter(), Counter(got)
            for r, n in copies.items():
                assert r in size and n <= 3
                taken[r[3]] += n * size[r]
            assert all(abs(taken[s] - goal[s]) <= 2 * max(size.values()) for s in total)
            break
        assert Counter(got) == Counter(want), name
        docs, plain_rows = out, got


def test_documents_without_a_language(spark, folder):
    """The model's answer is filled in; without any label there is no model, and what has a letter stays."""
    english, german = "the thing is there and on the other hand ing", "der stein und die schwester ungeheuer schlich"
    rows = [(i, f"{english if i % 2 else german} {'the' if i % 2 else 'sch'} {i}", ("en", "de")[i % 2 == 0] if i < 60 else None, "s", 9) for i in range(80)]
    docs = spark.createDataFrame([*rows, (99, "12 ...", None, "s", 6)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language(spark, docs, folder).collect()}
    assert got == {i: "en" if i % 2 else "de" for i in range(80)}
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language(spark, bare, folder).collect()}
    assert got == dict.fromkeys(range(80))


def test_rows_equal_in_id_and_text_keep_one_language(spark, folder):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(1, text, lang, source, 9) for lang, source in (("fr", "b"), ("en", "z"), ("en", "a"), (None, None))][:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n in (1, 5):
        assert [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs.repartition(n), folder).collect()] == [(1, text, "en", "a", 9)]


def test_run_is_registered(spark, folder):
    out = __spark_entry__.queries()["pipeline"](spark, folder)
    assert out.columns == [*COLUMNS, "copy"] and out.count() > 0
    assert out.where(F.col("text").contains(ITEM)).count() == 0


def test_stages_of_nothing(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name


def test_near_copies_at_four_fifths(spark, folder):
    """Of 100 words two are others: 86 of 106 shingles are shared."""
    text = " ".join(f"word{i}" for i in range(100))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([text, text.replace("word30 ", "x ").replace("word60 ", "y ")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, folder).collect()] == [0]
    assert near_dedup.bands_at(85) == 40 and all((1 - (p / 100) ** 8) ** near_dedup.bands_at(p) <= 3e-6 for p in (70, 80, 85, 90))
