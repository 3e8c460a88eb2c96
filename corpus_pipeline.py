"""From raw documents to a training mixture.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it
kept, and returns the columns of ``documents``; ``run`` writes what a stage returns
and reads it again for the next. The last stage also returns ``copy``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyview.llm import language_id
from manyview.llm.decontamination import leaks
from manyview.llm.line_dedup import drop_repeated_lines
from manyview.llm.mixing import mix_sources
from manyview.llm.near_dedup import near_duplicates
from manyview.llm.scratch import Scratch
from manyview.llm.text_columns import row_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the model rejects, which are null texts and texts without a letter,
    and gives documents without a language the one that the model predicts.

    Labels that are there stay. Where no document has a label, there is no model: what
    has a letter stays, without a language. Repeated rows stay repeated, an empty table
    stays empty, and texts are read whole, however long.
    """
    model = language_id.fit(language_id.learnable(docs))
    out = language_id.identify(docs, COLUMNS, model)
    if not model.languages:
        return out.where(F.col("text").rlike(r"\p{L}")).select(COLUMNS)
    known = F.coalesce(F.col("lang"), F.col("__lang")).alias("lang")
    return out.where(F.col("__lang") != language_id.UNKNOWN).select("doc_id", "text", known, "source", "n_chars")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes frequent lines out of texts, and drops documents of which no word is left.

    A line stays in the document with the largest id that holds it; where all ids are
    null, in all. Null and empty texts have no frequent line and stay as they are.
    Repeated rows are one document, and change alike. An empty table stays empty.
    """
    out = drop_repeated_lines(docs, COLUMNS)
    kept = F.col("__line_kept")
    left = out.where((F.col("__line_dropped") == 0) | kept.rlike(r"[^\x20\x09-\x0D]"))
    changed = F.col("__line_dropped") > 0
    return left.select(
        "doc_id",
        F.when(changed, kept).otherwise(F.col("text")).alias("text"),
        "lang",
        "source",
        F.when(changed, F.char_length(kept).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, alike in 80 of 100 shingles, the one with the smallest id.

    A null id is never the smallest unless the group has no others. Texts without a word
    are like nothing and stay. Of rows equal in id and text one stays, with the smallest
    language, source and size among them. An empty table stays empty.
    """
    keep = near_duplicates(docs, percent=80).where("keeper").select("id", "row").distinct()
    rows = docs.select(*COLUMNS, row_key(F.col("doc_id"), F.col("text")).alias("key"))
    kept = rows.join(keep, F.expr("doc_id <=> id AND key = row"), "left_semi")
    rest = F.min(F.struct("lang", "source", "n_chars")).alias("rest")
    return kept.groupBy("doc_id", "key").agg(F.first("text").alias("text"), rest).select("doc_id", "text", "rest.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark, as it is or with other values.

    Null and empty texts hold none and stay; so do all documents if the benchmark is
    empty. Repeated rows stay or go together. An empty table stays empty.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    held = leaks(docs, benchmark).select("id", "row").distinct()
    rows = docs.select(*COLUMNS, row_key(F.col("doc_id"), F.col("text")).alias("key"))
    return rows.join(held, F.expr("doc_id <=> id AND key = row"), "left_anti").select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target shares; a document comes once for each of its copies.

    Null sources are one source, the last. Texts without words have no size, and may
    come or not. Of rows alike in all but their place, it does not matter which comes.
    An empty table stays empty.
    """
    out = mix_sources(docs, COLUMNS).where("__mix_copies > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int")))
    return out.select(*COLUMNS, copies.alias("copy"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

#: No SQL: the language model and the signatures have none. The tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; one row for each copy of a document that the mixture takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, before = Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
