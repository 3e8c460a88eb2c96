"""The bounded sample of labelled rows that a model is trained on in the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from manyview.llm.text_columns import row_key


def labelled_sample(
    rows: DataFrame, *, per_label: int, limit: int, longest: int, seed: str
) -> list[tuple[str, str]]:
    """(text, label) of at most ``limit`` of ``rows`` (id, text, label), at most ``per_label``
    of each label, none with a text of more than ``longest`` characters.

    ``rows`` must be cheap to read twice. Every label counts; if there are more than
    ``limit``, each has one row. Rows are taken in the order of a digest of id and text,
    so that the sample does not depend on how they are stored; equal rows count once,
    rows that share an id one by one. No more than ``limit`` texts, or one for each label, reach the driver.
    """
    rows = rows.where("label IS NOT NULL AND text IS NOT NULL").where(F.char_length("text") <= longest)
    keyed = rows.select("id", "label", row_key(F.col("id"), F.col("text")).alias("key"))
    counts = keyed.groupBy("label").count().orderBy("label").collect()
    if not counts:
        return []
    each = min(per_label, max(1, limit // len(counts)))
    # only about twice as many as are wanted are put in order
    shares = pa.table({"label": [r["label"] for r in counts], "share": [min(1.0, (2 * each + 50) / r["count"]) for r in counts]})
    # from an Arrow table: a list would go through Python workers of its own on every executor
    shares = rows.sparkSession.createDataFrame(shares, rows.select("label").schema.add("share", "double"))
    few = keyed.withColumn("order", F.xxhash64("id", "key", F.lit(seed))).join(F.broadcast(shares), "label")
    few = few.where(F.pmod("order", F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("id", "key", "label", "order").distinct()
    place = F.row_number().over(Window.partitionBy("label").orderBy("order", "id", "key"))
    chosen = few.withColumn("place", place).where(F.col("place") <= each).select(F.col("id").alias("c_id"), F.col("key").alias("c_key"), F.col("label").alias("c_label"))
    # at most as many as the limit says, so that every executor can have them
    wanted = rows.withColumn("key", row_key(F.col("id"), F.col("text"))).join(F.broadcast(chosen), F.expr("id <=> c_id AND key = c_key AND label = c_label"), "left_semi")
    sample = wanted.dropDuplicates(["id", "key", "label"]).orderBy("id", "key", "label").collect()
    return [(r["text"], r["label"]) for r in sample]
