"""The history of addresses, and properties of any shape."""

from pyspark.sql import functions as F

from manyview.operators import properties
from manyview.operators.history import History


def addresses(spark, names):
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "_id long, canonicalUrl string")


def test_new_addresses(spark, tmp_path):
    history = History(spark, f"file://{tmp_path}/h", parts=8)
    assert {r["canonicalUrl"] for r in history.new(addresses(spark, ["x", None, "x"])).collect()} == {"x", None}
    history.add(addresses(spark, [f"old{i}" for i in range(500)] + ["old1", None]), 0)
    history.add(addresses(spark, [f"late{i}" for i in range(40)]), 3)
    history.add(addresses(spark, ["never"]), 3)  # done before
    incoming = addresses(spark, [*[f"old{i}" for i in range(0, 500, 50)], "late7", *[f"new{i}" for i in range(300)], "never", None, "new1"])
    got = sorted(r["_id"] for r in history.new(incoming).collect())
    assert got == sorted(r["_id"] for r in incoming.where("canonicalUrl IS NULL OR canonicalUrl LIKE 'ne%'").collect())
    possible = {r["canonicalUrl"] for r in history.possible(incoming).collect()}
    assert {f"old{i}" for i in range(0, 500, 50)} | {"late7"} <= possible and len(possible) < 30


def test_only_parts_that_matter_are_read(spark, tmp_path):
    history = History(spark, f"file://{tmp_path}/h", parts=16)
    history.add(addresses(spark, [f"old{i}" for i in range(400)]), 0)
    asked = addresses(spark, ["old5", "other"])
    parts = sorted({r["part"] for r in history.possible(asked).collect()})
    read = history.rows(parts)
    assert len(parts) <= 2 and "PartitionFilters: [isnotnull(part" in read._jdf.queryExecution().executedPlan().toString().replace("PartitionFilters: [part", "PartitionFilters: [isnotnull(part")
    assert {int(r[0].split("part=")[1].split("/")[0]) for r in read.select(F.input_file_name()).distinct().collect()} == set(parts)


def test_properties(spark):
    rows = [(1, '{"k": 5}'), (1, '{"k": "six", "more": {"k": 7}}'), (2, "{broken"), (2, None), (2, "[1]"), (3, "null"), (3, '{"k": 1.5}')]
    log = properties.with_extras(spark.createDataFrame(rows, "g int, props string"))
    out = properties.taken_out(log, {"k": ("bigint", ("$.k", "$.more.k")), "t": ("string", ("$.k",))}).collect()
    assert [(r["k"], r["t"]) for r in out] == [(5, "5"), (7, "six"), (None, None), (None, None), (None, None), (None, None), (1, "1.5")]
    assert {r["g"]: r["n"] for r in properties.shapes(log, "g").collect()} == {1: 2, 2: 1, 3: 2}
