"""The inverted file of vectors, and articles gathered into stories."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from manyview.operators.clusters import StoryClusters
from manyview.operators.graph import components
from manyview.operators.similarity import tile_of
from manyview.operators.vector_index import VectorIndex
from manyview.plans import followed

SCHEMA = "_id long, embedding array<double>, unit int, cell string"


def grouped(n, groups=12, width=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    return [(i, (centres[i % groups] + rng.normal(size=width) * 0.03).tolist()) for i in range(n)]


def best(rows, queries, k, at_least=-1.0):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    good = [(i, unit(v)) for i, v in rows if v and np.linalg.norm(v) > 0]
    out = {}
    for q, v in queries:
        if v and np.linalg.norm(v) > 0:
            found = sorted((-round(float(unit(v) @ w), 12), i) for i, w in good if i != q and len(w) == len(v))
            out[q] = [(i, round(-s, 6)) for s, i in found[:k] if -s >= at_least]
    return {q: x for q, x in out.items() if x}


def asked(found):
    out = {}
    for r in sorted(found.rows.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query"], []).append((r["key"], round(r["similarity"], 6)))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c") for i, v in rows], SCHEMA).repartition(3)


def test_index_is_exact_and_reads_few_cells(spark, tmp_path):
    rows = grouped(600)
    index = VectorIndex.build(table(spark, rows), f"file://{tmp_path}/index", cells=12)
    queries = rows[:3]
    found = index.nearest(table(spark, queries), 4)
    assert asked(found) == best(rows, queries, 4)
    assert len(found.read) < len(found.cells) == 12
    plan = index.rows(found.read)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    files = [r[0] for r in index.rows(found.read).select(F.input_file_name()).distinct().collect()]
    assert len(files) < 12 and {int(f.split("cell=")[1].split("/")[0]) for f in files} == set(found.read)


@pytest.mark.parametrize("at_least", [-1.0, 0.9])
def test_index_on_any_vectors(spark, tmp_path, at_least):
    """Vectors all over the place, ties, nulls, zeros, a repeated key, and queries of another length."""
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(150)]
    rows += [(200 + i, rows[i % 3][1]) for i in range(9)] + [(300, None), (301, [0.0] * 5)]
    index = VectorIndex.build(table(spark, rows), f"file://{tmp_path}/index")
    queries = [*rows[:20], *rows[-4:], (900, [1.0, 2.0])]
    found = index.nearest(table(spark, queries), 3, at_least=at_least)
    want = best(rows, queries, 3, at_least)
    want.pop(900, None)
    assert asked(found) == want


def test_index_of_nothing(spark, tmp_path):
    index = VectorIndex.build(table(spark, []), f"file://{tmp_path}/index")
    assert index.nearest(table(spark, grouped(3)), 2).rows.count() == 0
    some = VectorIndex.build(table(spark, grouped(9)), f"file://{tmp_path}/some")
    assert some.nearest(table(spark, []), 2).rows.count() == 0


def test_components(spark, tmp_path):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7)]
    root = list(range(200))
    for a, b in links * 200:
        root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), f"file://{tmp_path}").collect()}
    assert got == {i: root[i] for a, b in links if a != b for i in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long"), f"file://{tmp_path}").count() == 0


def test_stories_stay(spark, tmp_path):
    """Stories open on what is left, keep their names, and take in what comes later."""
    rows = grouped(36, groups=6)
    first = [r for r in rows if r[0] % 6 < 4 and r[0] < 24]
    clusters = StoryClusters(spark, f"file://{tmp_path}/c", 0.9, k=5, buckets=2)
    clusters.apply(table(spark, [*first, (500, None), (501, [0.0] * 8)]), 0)
    opened = {r["_id"]: r["eventId"] for r in clusters.members.read().collect()}
    assert opened == {i: i % 6 for i, _ in first}
    again = {r["_id"]: r["eventId"] for r in clusters.apply(table(spark, [(0, rows[5][1])]), 0).collect()}
    assert again == {0: 0}  # done before
    out = {r["_id"]: (r["eventId"], r["opened"]) for r in clusters.apply(table(spark, [*rows, (500, None)]), 1).collect()}
    assert {i: x[0] for i, x in out.items() if i != 500} == {i: i % 6 for i, _ in rows} and out[500] == (None, None)
    assert {i for i, x in out.items() if x[1]} == {i for i, _ in first} | {i for i, _ in rows if i % 6 > 3}
    assert {r["_id"]: r["batch"] for r in clusters.stories.read().collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1}


@pytest.mark.parametrize("n", [1, 2, 3])
def test_so_few_that_there_is_one_cell(spark, tmp_path, n):
    rows = grouped(n, groups=2)
    index = VectorIndex.build(table(spark, rows), f"file://{tmp_path}/index")
    assert asked(index.nearest(table(spark, rows), 2)) == best(rows, rows, 2)
    assert [c["n"] for c in index.cells().collect()] == [n]


def test_few_articles_are_left(spark, tmp_path):
    """All but two articles join stories; what is left, fewer than make two cells, opens one."""
    rows = grouped(30, groups=6)
    first = [r for r in rows if r[0] % 6 < 5 and r[0] < 24]
    clusters = StoryClusters(spark, f"file://{tmp_path}/c", 0.9, k=5, buckets=2)
    clusters.apply(table(spark, first), 0)
    clusters.apply(table(spark, [r for r in rows if r[0] % 6 < 5 or r[0] < 12]), 1)
    assert {r["_id"]: r["eventId"] for r in clusters.members.read().collect()} == {i: i % 6 for i, _ in rows if i % 6 < 5 or i < 12}


def test_letters_are_counted_as_by_replacing(spark):
    """Texts with letters of two bytes, others with the same bytes, empty ones and null ones, in one go."""
    texts = ["", "abba zz", "äöüéèç ÄÖÜ é", "Ã©ñ¤ 漢字 🙂 ß€", "x" * 5000 + "ç"]
    rows = spark.createDataFrame(list(enumerate(texts)), "_id long, text string").select("_id", F.lower("text").alias("text"))
    got = {r["_id"]: r["embedding"] for r in followed._letters(rows).collect()}
    assert got == {i: [float(t.lower().count(c)) for c in followed.LETTERS] for i, t in enumerate(texts)}
    plan = followed._letters(rows).where("embedding[0] > 0").selectExpr("embedding", "embedding[0] + embedding[1]")
    assert plan._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_floor_leaves_ties(spark):
    """A floor, the k-th that a query has found elsewhere, keeps what is as similar and drops what is less."""
    table = lambda rows, kind: pa.Table.from_pylist(rows, schema=pa.schema([("key", pa.int64()), ("unit", pa.list_(pa.float64())), *kind]))
    queries = table([{"key": 1, "unit": [1.0, 0.0], "floor": 0.6}, {"key": 2, "unit": [1.0, 0.0], "floor": None}], [("floor", pa.float64())])
    rows = table([{"key": 9, "unit": [0.6, 0.8]}, {"key": 7, "unit": [0.6, 0.8]}, {"key": 1, "unit": [1.0, 0.0]}, {"key": 5, "unit": [0.0, 1.0]}], [])
    got = tile_of(3, -1.0)(queries, rows).to_pylist()
    assert [(r["query"], r["key"]) for r in got] == [(1, 7), (1, 9), (2, 1), (2, 7), (2, 9)]
