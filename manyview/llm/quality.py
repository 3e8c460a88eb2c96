"""Quality scores by supervised subword embeddings.

Each word, pair of neighbouring words and n-gram of characters of a text has a learned
vector, found by its hash; a document is the average of its vectors, and a softmax over
that gives the class. Training is stochastic gradient descent in numpy on a bounded sample of
labelled documents. Since the output is linear in the average, the vectors and the
output layer fold into one weight for each bucket when documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyview.llm.ngram_features import averages, sparse_rows
from manyview.llm.text_columns import fold_of, row_key
from manyview.llm.worker_code import ship

#: Labelled documents that a model is trained on, and characters of one, at most.
LABELLED, LONGEST = 3000, 30_000
ORDERS, BITS, LOWER, PAIRS = (6,), 18, False, True
DIMENSIONS, EPOCHS, RATE = 8, 5, 20.0


@dataclass
class QualityModel:
    weights: np.ndarray  # by bucket
    bias: float


def train(texts: list[str], good: list[int]) -> QualityModel:
    """Vectors and output layer by gradient descent, folded. Without labels, all scores are 0.5."""
    y = np.array(good, int)
    if not len(y):
        return QualityModel(np.zeros((1 << BITS, 1), np.float32), 0.0)
    rows = sparse_rows(texts, ORDERS, BITS, LOWER, PAIRS)
    rng = np.random.default_rng(3)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS)).astype(np.float32)
    out = np.zeros((2, DIMENSIONS), np.float32)
    bias = np.log(np.maximum(np.bincount(y, minlength=2), 0.5) / len(y)).astype(np.float32)
    done, steps = 0, EPOCHS * len(rows)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            bucket, x = rows[i]
            rate = RATE * (1 - done / steps)
            done += 1
            if not len(bucket):
                continue
            x = x.astype(np.float32)
            mean = x @ vectors[bucket]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ out
            out -= np.float32(0.02 * rate) * np.outer(p, mean)
            vectors[bucket] -= np.float32(rate) * x[:, None] * back
    fold = vectors @ (out[1] - out[0])
    return QualityModel(fold.astype(np.float32)[:, None], float(bias[1] - bias[0]))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    limit: int = LABELLED,
    longest: int = LONGEST,
    doc_id: str = "doc_id",
    text: str = "text",
    target: str = "quality",
) -> QualityModel:
    """A model from a bounded sample of labelled documents: at most ``limit``, none of
    more than ``longest`` characters, in the shares that the labels have. Null labels do
    not count; of several labels for an id, the lowest does; rows that share an id each
    have its label. Null texts are empty ones."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(target).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("id").agg(F.min("y").alias("y"))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # which rows have a label is found without their texts
    near = rows.where(F.char_length("text") <= longest).select("id", row_key(F.col("id"), F.col("text")).alias("key")).join(known, "id").distinct()
    order = F.xxhash64("id", "key", F.lit("quality"))
    chosen = near.orderBy(order, "id", "key").limit(limit).select(F.col("id").alias("c_id"), F.col("key").alias("c_key"), "y")
    # a bounded number of rows, so that every executor can have them
    wanted = rows.withColumn("key", row_key(F.col("id"), F.col("text"))).join(F.broadcast(chosen), F.expr("id = c_id AND key = c_key"))
    sample = wanted.dropDuplicates(["id", "key"]).orderBy("id", "key").collect()
    return train([r["text"] for r in sample], [int(r["y"] > 0) for r in sample])


def rate(batches: Iterator[pa.RecordBatch], shared, carried: int) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        mean, _ = averages(batch.column(carried), model.weights, ORDERS, BITS, LOWER, PAIRS)
        score = 1 / (1 + np.exp(-np.clip(mean[:, 0] + model.bias, -500, 500)))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in range(carried)], pa.array(score, pa.float64())],
            names=[*batch.schema.names[:carried], "__quality_score"],
        )


def score_quality(docs: DataFrame, carry: list[str], model: QualityModel, *, text: str = "text") -> DataFrame:
    """Columns ``carry`` of every row, with ``__quality_score`` (0 to 1).

    Null and empty texts have the score that the labels alone suggest; a model that saw
    labels of one class, or none, is defined too: without labels all scores are 0.5. Whole texts are
    read, in chunks, however long they are; equal texts get equal scores, whatever their
    ids. An empty table gives an empty result. Columns of
    ``docs`` beside ``carry`` are not read; names that begin with ``__quality_`` are
    reserved. Nothing is shuffled.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(c) for c in carry], F.col(text).alias("__quality_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema.fields)
    return rows.mapInArrow(lambda it: rate(it, shared, len(carry)), f"{fields}, __quality_score double")


def learnable(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows that a model may learn from."""
    return docs.where(fold_of(F.col(doc_id), 5) != 0)
