"""Language identification by families, then pairwise within a family.

One linear machine for each family tells it from the rest; within the family that
wins, a linear support vector machine for each pair of its languages votes. All are
trained by subgradient steps on hashed n-grams of characters, from a bounded sample of each language,
and share one weight table, so that a text is read once whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyview.llm.ngram_features import averages, sparse_rows
from manyview.llm.text_columns import fold_of
from manyview.llm.training_sample import labelled_sample
from manyview.llm.word_arrays import slices
from manyview.llm.worker_code import ship

#: Rows of a language that a model is trained on, rows in all, and characters of a row, at most.
PER_LANGUAGE, LIMIT, LONGEST = 400, 8000, 20_000
ORDERS, BITS, LOWER = (3, 4), 17, True
#: Weight of the L2 term, and passes over the rows.
L2, EPOCHS = 1e-3, 6
UNKNOWN = "und"
# Families by ISO 639-1 code. A language of no family here is one of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be bg mk sr hr bs sl pl cs sk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tt",
    "indic": "hi ur bn pa gu mr ne",
    "iranian": "fa ku ps tg",
    "semitic": "ar he am mt",
    "sinitic": "zh yue wuu",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


@dataclass
class LanguageModel:
    languages: list[str]
    families: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # bucket x (families, then pairs)
    scale: np.ndarray  # of each column's margin
    bits: int  # of the buckets


def margins(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights of a linear support vector machine that separates rows by ``sign``, and the
    factor that brings its typical margin on mean features to 3.

    Subgradient steps on the hinge loss with an L2 term, of rate 1 / (L2 * step). Under that rate
    the weights at a step are the sum of all moves over the number of steps, so that only
    the sum is kept; the result is the average over all steps. Both classes weigh alike.
    """
    total, sums, rng = np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float64), np.random.default_rng(5)
    cost = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())) * len(sign)
    units = [(b, (x / np.sqrt((x * x).sum())).astype(np.float32)) for b, x in rows]
    harmonic = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, epochs * len(rows) + 1))])
    step = 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            bucket, x = units[i]
            if sign[i] * (total[bucket] @ x) < step:
                move = np.float32(sign[i] * cost[i] / L2) * x
                total[bucket] += move
                sums[bucket] += move * harmonic[step]
            step += 1
    # a move made at a step counts in all later averages, each time over their number of steps
    final = (harmonic[step] * total - sums) / max(1, step)
    typical = np.median([abs(final[b] @ x) for b, x in rows]) if rows else 1.0
    return final.astype(np.float32), 3.0 / max(float(typical), 1e-9)


def bits_for(machines: int) -> int:
    """Bits of the buckets: fewer from 256 machines on, so that the weight table stays within 2^25 numbers, 128 MB."""
    return BITS - max(0, int(np.ceil(np.log2(max(1, machines) / 256))))


def train(texts: list[str], langs: list[str]) -> LanguageModel:
    keep = [i for i, t in enumerate(texts) if t and t.strip()]
    langs = [langs[i] for i in keep]
    languages = sorted(set(langs))
    family_of = [FAMILY_OF.get(x, x) for x in languages]
    families = sorted(set(family_of))
    label = np.array([languages.index(x) for x in langs], int)
    family = np.array([families.index(family_of[i]) for i in label], int)
    pairs = [(a, b) for a, b in combinations(range(len(languages)), 2) if family_of[a] == family_of[b]]
    bits = bits_for(len(families) + len(pairs))
    rows = sparse_rows([texts[i] for i in keep], ORDERS, bits, LOWER)
    columns = [margins(rows, np.where(family == f, 1, -1), bits) for f in range(len(families))] if len(families) > 1 else []
    for a, b in pairs:
        mine = np.flatnonzero((label == a) | (label == b))
        columns.append(margins([rows[i] for i in mine], np.where(label[mine] == a, 1, -1), bits))
    weights = np.stack([w for w, _ in columns], 1) if columns else np.zeros((1 << bits, 0), np.float32)
    return LanguageModel(languages, families, pairs, weights, np.array([s for _, s in columns]), bits)


def predict(model: LanguageModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language and the confidence of each text."""
    means, _ = averages(texts, model.weights, ORDERS, model.bits, LOWER)
    m = np.clip(means * model.scale, -30, 30)
    n, one = len(m), np.zeros(len(m), int)
    family_of = [FAMILY_OF.get(x, x) for x in model.languages]
    sure = np.ones(n)
    if len(model.families) > 1:
        f = m[:, : len(model.families)]
        m = m[:, len(model.families) :]
        one = f.argmax(1)
        e = np.exp(f - f.max(1, keepdims=True))
        sure = e.max(1) / e.sum(1)
    lang = np.zeros(n, int)
    for i, name in enumerate(model.families):
        mine = np.flatnonzero(one == i)
        inside = [j for j, x in enumerate(family_of) if x == name]
        votes = np.zeros((len(mine), len(model.languages)))
        for c, (a, b) in enumerate(model.pairs):
            if a in inside:
                p = 1 / (1 + np.exp(-m[mine, c]))
                votes[:, a] += (p >= 0.5) + p / (2 * len(model.languages))
                votes[:, b] += (p < 0.5) + (1 - p) / (2 * len(model.languages))
        if len(inside) == 1:
            lang[mine] = inside[0]
            continue
        lang[mine] = np.array(inside)[votes[:, inside].argmax(1)]
        for c, (a, b) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-m[mine, c]))
            sure[mine] *= np.where(lang[mine] == a, p, np.where(lang[mine] == b, 1 - p, 1.0))
    return lang, sure


def fit(
    docs: DataFrame,
    per_language: int = PER_LANGUAGE,
    limit: int = LIMIT,
    longest: int = LONGEST,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> LanguageModel:
    """A model from a bounded sample of the rows that have a language and a text: at most
    ``per_language`` rows of each, none of more than ``longest`` characters, and ``limit``
    in all. Every language with such a text is learned: many share the limit, and where
    there are more languages than that, each has one row. A model of no language calls
    every text unknown."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("label"), F.col(text).alias("text"))
    sample = labelled_sample(rows, per_label=per_language, limit=limit, longest=longest, seed="language")
    return train([t for t, _ in sample], [name for _, name in sample])


def label(batches: Iterator[pa.RecordBatch], shared, carried: int, text: int) -> Iterator[pa.RecordBatch]:
    """The first ``carried`` columns, and what the model says of the texts in column ``text``;
    the last column tells which have a letter. Batches go out in slices of a megabyte of
    text, so that only what comes in is ever in memory whole."""
    model = shared.value
    for batch in (part for whole in batches for part in slices(whole, text)):
        letters = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
        if model.languages:
            lang, sure = predict(model, batch.column(text))
            names = np.where(letters, np.array(model.languages, object)[lang], UNKNOWN)
        else:
            names, sure = np.full(len(letters), UNKNOWN, object), np.zeros(len(letters))
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(i) for i in range(carried)],
                pa.array(names.tolist(), pa.string()),
                pa.array(np.where(letters, sure, 0.0), pa.float64()),
            ],
            names=[*batch.schema.names[:carried], "__lang", "__lang_score"],
        )


def identify(docs: DataFrame, carry: list[str], model: LanguageModel, *, text: str = "text") -> DataFrame:
    """Columns ``carry`` of every row, with ``__lang`` and ``__lang_score`` (0 to 1).

    A text that is null or has no letter is ``und`` with score 0, as is every text if
    the model has seen no language. Whole texts are read, in chunks, however long they
    are. Rows are told apart by nothing: equal texts get equal answers. Columns of ``docs`` beside ``carry`` are not
    read; names that begin with ``__lang`` are reserved. Nothing is shuffled.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    # a text that is carried goes to Python once
    texts = [] if text in carry else [F.col(text).alias("__lang_text")]
    at = carry.index(text) if text in carry else len(carry)
    rows = docs.select(*[F.col(c) for c in carry], *texts, has_letter.alias("__lang_letter"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema.fields)
    return rows.mapInArrow(lambda it: label(it, shared, len(carry), at), f"{fields}, __lang string, __lang_score double")


def learnable(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows that a model may learn from."""
    return docs.where(fold_of(F.col(doc_id), 4) != 2)
