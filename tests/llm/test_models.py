"""Language and quality models: held-out accuracy and odd inputs."""

import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from conftest import SCHEMA

from manyview.llm import language_id, quality
from manyview.llm.ngram_features import averages, bucket_lists, code_points, sparse_rows
from manyview.llm.training_sample import labelled_sample
from manyview.llm.word_arrays import Runs, chunks, slices, word_digests, words

SYLLABLES = {"en": "the th ing er on an re", "de": "der sch ung ei ich en ge", "fr": "le que ou eau ai é ment", "es": "el os ado ción que ar ie", "xx": "zzu kla mbo iri ndu"}


def text_in(rng, lang, n=60):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(4)
    rows = []
    for i in range(500):
        lang = rng.choice(sorted(SYLLABLES))
        rows.append((i, text_in(rng, lang), lang if i % 11 else None, lang, 0, "i", "r", "w", 1, "c", "g", "p"))
    rows += [(1000 + k, t, "en", None, 0, "i", "r", "w", 1, "c", "g", "p") for k, t in enumerate([None, "", "123 !?", " \n", "the " * 30000, "é"])]
    return spark.createDataFrame([*rows, rows[3], (None, "the thing er", "en", "en", 0, "i", "r", "w", 1, "c", "g", "p")], SCHEMA)


def test_language(spoken):
    model = language_id.fit(language_id.learnable(spoken), per_language=50)
    assert model.languages == sorted(SYLLABLES) and model.families == ["germanic", "romance", "xx"]
    got = language_id.identify(spoken, ["doc_id", "lang", "source", "words"], model).collect()
    assert len(got) == spoken.count() and all(0 <= r["__lang_score"] <= 1 for r in got)
    true = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1000]
    assert np.mean([r["__lang"] == r["source"] for r in true]) > 0.98
    odd = {r["doc_id"]: r["__lang"] for r in got if r["doc_id"] is not None and r["doc_id"] >= 1000}
    assert [odd[1000 + k] for k in range(4)] == ["und"] * 4 and odd[1004] == "en" and odd[1005] in SYLLABLES


def test_language_learns_from_its_rows_only(spoken):
    """Other rows and columns change nothing."""
    a = language_id.fit(language_id.learnable(spoken), per_language=20)
    b = language_id.fit(language_id.learnable(spoken.repartition(5)).drop("source", "n_chars"), per_language=20)
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


def test_the_sample_is_bounded_and_has_every_language(spark):
    """Rows that share an id count one by one, equal rows once, and rare labels too."""
    rows = [(1, f"some text number {i}", "en") for i in range(3000)] + [(2, "the same text", "en")] * 500
    rows += [(i, f"dirty {i}", f"l{i:04d}") for i in range(3, 300)] + [(9000 + i, "x" * 21_000, "zz") for i in range(3)]
    docs = spark.createDataFrame(rows, "id long, text string, label string")
    sample = labelled_sample(docs, per_label=400, limit=8000, longest=20_000, seed="s")
    each = Counter(label for _, label in sample)
    assert each["en"] <= 400 and len(each) == 298 and max(len(t) for t, _ in sample) <= 20_000 and sum(t == "the same text" for t, _ in sample) <= 1
    one_each = labelled_sample(docs, per_label=400, limit=100, longest=20_000, seed="s")
    assert len(one_each) == 298 == len({label for _, label in one_each})
    assert sample == labelled_sample(docs.repartition(9), per_label=400, limit=8000, longest=20_000, seed="s")


@pytest.mark.parametrize("langs", [[], ["en"], ["de", "en"], ["en", "fr"]])
def test_language_of_few(spark, langs):
    rng = random.Random(9)
    rows = [(i, text_in(rng, x), x) for i, x in enumerate(langs * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    got = language_id.identify(docs, ["lang"], model).collect()
    assert all(r["lang"] == r["__lang"] for r in got) and len(got) == len(rows)
    if not langs:
        more = spark.createDataFrame([(1, "hello")], "doc_id long, text string")
        assert language_id.identify(more, ["doc_id"], model).first()["__lang"] == "und"


def test_quality(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.8
        t = text_in(rng, rng.choice(["en", "de"]), 40)
        rows.append((i, t if good else " ".join(w.upper() + "!!" if i % 2 else w + " |" for w in t.split()), None, None, 0, "i", "r", "w", 1, "c", "g", "p"))
        labels.append((i, int(good), None))
    rows += [(1000, None, *rows[0][2:]), (1001, "", *rows[0][2:]), (None, "the thing", *rows[0][2:]), rows[5]]
    labels += [(3, None, 1), (None, 1, 1), (9999, 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(quality.learnable(docs), marks, limit=200)
    got = quality.score_quality(docs, ["doc_id", "words"], model).collect()
    assert len(got) == len(rows) and all(0 <= r["__quality_score"] <= 1 for r in got)
    good = dict((i, y) for i, y, _ in labels[:400])
    assert np.mean([(r["__quality_score"] >= 0.3) == good[r["doc_id"]] for r in got if r["doc_id"] in good]) > 0.97
    empty = [r["__quality_score"] for r in got if r["doc_id"] in (1000, 1001)]
    assert len(set(empty)) == 1
    assert quality.score_quality(docs.where("false"), ["doc_id"], model).count() == 0
    without = quality.fit(docs, marks.where("false"))
    assert {r["__quality_score"] for r in quality.score_quality(docs, ["doc_id"], without).collect()} == {0.5}


def test_more_than_64_languages_are_told_apart():
    rng = random.Random(2)
    own = {f"q{i:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for i in range(90)}
    said = [(" ".join(rng.choice(w) for _ in range(20)), lang) for lang, w in own.items() for _ in range(6)]
    model = language_id.train([t for t, _ in said], [lang for _, lang in said])
    new = [(" ".join(rng.choice(w) for _ in range(20)), lang) for lang, w in own.items()]
    lang, _ = language_id.predict(model, pa.array([t for t, _ in new]))
    assert [model.languages[i] for i in lang] == [x for _, x in new]
    assert [language_id.bits_for(n) for n in (0, 1, 256, 257, 512, 5000)] == [17, 17, 17, 16, 16, 12]


def test_machines_are_support_vector_machines():
    """Their loss, L2 term included, is near the least that plain full-batch descent finds."""
    rng = np.random.default_rng(1)
    x = rng.random((60, 16))
    sign = np.where(x[:, 0] + 0.3 * rng.random(60) > 0.6, 1, -1)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    cost = np.where(sign > 0, 0.5 / (sign > 0).sum(), 0.5 / (sign < 0).sum())

    def loss(w):
        return language_id.L2 / 2 * w @ w + cost @ np.maximum(0, 1 - sign * (x @ w))

    got, _ = language_id.margins([(np.arange(16), row) for row in x], sign, bits=4, epochs=400)
    w, best = np.zeros(16), loss(np.zeros(16))
    for t in range(1, 200_000):
        w -= (language_id.L2 * w - (cost * sign * (sign * (x @ w) < 1)) @ x) / (language_id.L2 * (t + 1000))
        best = min(best, loss(w))
    assert loss(got) < 1.1 * best + 0.01 and best < 0.8


def test_no_bucket_decides(spark):
    """Texts of repeated words are told by many n-grams; without the heaviest bucket they still are."""
    rng = random.Random(8)

    def junk():
        return " ".join(w for w in text_in(rng, "en", 6).split() for _ in range(9))

    train = [(junk(), 0) if i % 4 == 0 else (text_in(rng, "en", 50), 1) for i in range(400)]
    test = [(junk(), 0) if i % 4 == 0 else (text_in(rng, "en", 50), 1) for i in range(200)]
    model = quality.train([t for t, _ in train], [y for _, y in train])
    y, texts = np.array([y for _, y in test]), pa.array([t for t, _ in test])

    def auc(weights):
        s = averages(texts, weights, quality.ORDERS, quality.BITS, quality.LOWER, quality.PAIRS)[0][:, 0]
        return np.mean(s[y == 1][:, None] > s[y == 0][None, :])

    less = model.weights.copy()
    less[np.abs(less[:, 0]).argmax()] = 0
    assert auc(model.weights) > 0.95 and abs(auc(model.weights) - auc(less)) < 0.01


def test_pairs_are_ordered_and_characters_are_whole():
    (chunk,) = chunks(pa.array(["a b a b", "b a", "zz zz c c", "é€😀é", ""]))
    _, (pair, begin, end), (gram, first, last) = bucket_lists(chunk, (3,), 20, False, True)
    assert (end - begin).tolist() == [3, 1, 3, 0, 0]
    assert pair[0] == pair[2] != pair[1] == pair[begin[1]]
    assert pair[begin[2]] != pair[begin[2] + 2]
    assert (last - first).tolist() == [5, 1, 7, 2, 0]
    points, at = code_points(chunk, False)
    assert "".join(map(chr, points)) == "a b a bb azz zz c cé€😀é" and at.tolist() == [0, 7, 10, 19, 23, 23]
    points, at = code_points(next(chunks(pa.array(["ABÉ"]))), True)
    assert "".join(map(chr, points)) == "abÉ" and at.tolist() == [0, 3]


def test_averages_are_those_of_the_rows():
    texts = ["", "a", "ab", "the quick brown fox", " \n ", "x" * 50, "é ü ß", "the"]
    weights = np.random.default_rng(0).normal(size=(1 << 12, 2))
    for pairs in (False, True):
        same_averages(texts, weights, pairs)


def same_averages(texts, weights, pairs):
    got, n = averages(pa.array(texts), weights, (3, 4), 12, True, pairs)
    for i, (bucket, share) in enumerate(sparse_rows(texts, (3, 4), 12, True, pairs)):
        assert np.allclose(got[i], (weights[bucket] * share[:, None]).sum(0)) and (n[i] > 0) == (len(bucket) > 0)


def test_words_and_runs():
    texts = pa.array(["a b  c", None, "", "b c", "\x0bé\x1cx\n", "a b c"])
    (chunk,) = chunks(texts)
    w = words(chunk)
    found = [bytes(chunk.data[s:e]).decode() for s, e in zip(w.starts, w.ends, strict=True)]
    assert found == ["a", "b", "c", "b", "c", "é\x1cx", "a", "b", "c"]
    assert w.text.tolist() == [0, 0, 0, 3, 3, 4, 5, 5, 5] and w.offsets.tolist() == [0, 3, 3, 3, 5, 6, 9]
    d = word_digests(chunk, w)
    runs = Runs(d)
    assert runs.of(np.array([1]), np.array([3])) == runs.of(np.array([3]), np.array([5])) == runs.every(2)[7]
    assert runs.of(np.array([0]), np.array([3])) == runs.of(np.array([6]), np.array([9])) != runs.of(np.array([1]), np.array([3]))


def test_chunks_of_slices():
    texts = pa.array([f"text {i} " * 3000 for i in range(200)])
    for part in (texts, texts.slice(50, 100), texts.cast(pa.large_string()).slice(7, 90)):
        got = [bytes(c.data[a:b]).decode() for c in chunks(part) for a, b in zip(c.offsets[:-1], c.offsets[1:], strict=True)]
        assert got == part.to_pylist()


def test_memory_of_averages_is_that_of_a_part():
    """Eight megabytes of text need the arrays of a quarter of one."""
    texts, weights = pa.array(["the quick brown fox " * 50] * 8000 + [None]), np.ones((1 << 12, 2), np.float32)
    tracemalloc.start()
    got, n = averages(texts, weights, (3, 4), 12, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24e6 and np.allclose(got[:-1], 1) and n[0] == n[7999] > n[8000] == 0


def test_carried_texts_go_to_python_once(spark):
    docs = spark.createDataFrame([(1, "the thing", "en"), (2, None, "en"), (3, "le que", "fr")], "doc_id long, text string, lang string")
    model = language_id.train(["the thing", "le que"], ["en", "fr"])
    out = language_id.identify(docs, ["doc_id", "text", "lang"], model)
    assert "__lang_text" not in out._jdf.queryExecution().analyzed().toString()
    assert sorted(tuple(r)[:4] for r in out.collect()) == [(1, "the thing", "en", "en"), (2, None, "en", "und"), (3, "le que", "fr", "fr")]
    alone = language_id.identify(docs, ["lang", "doc_id"], model).collect()
    assert sorted((r["doc_id"], r["__lang"]) for r in alone) == [(1, "en"), (2, "und"), (3, "fr")]


def test_answers_go_out_in_slices():
    texts = [text_in(random.Random(i), "en fr"[3 * (i % 2) :][:2], 2000) if i % 7 else None for i in range(600)]
    model = language_id.train(["the thing er on", "le que ou"], ["en", "fr"])
    batch = pa.record_batch({"doc_id": list(range(600)), "text": pa.array(texts), "letter": [t is not None for t in texts]})
    parts = list(language_id.label(iter([batch, batch.slice(0, 0), batch.slice(100, 3)]), SimpleNamespace(value=model), 2, 1))
    assert len(parts) > 4 and max(sum(len(t or "") for t in p["text"].to_pylist()) for p in parts) <= 1 << 20
    got = pa.Table.from_batches(parts)
    assert got["doc_id"].to_pylist() == [*range(600), 100, 101, 102] and got["text"].to_pylist() == texts + texts[100:103]
    lang, sure = language_id.predict(model, batch["text"])
    want = ["und" if t is None else model.languages[k] for t, k in zip(texts, lang, strict=True)]
    assert got["__lang"].to_pylist()[:600] == want and np.allclose(got["__lang_score"].to_numpy()[:600], np.where([t is None for t in texts], 0, sure))
    assert sum(b.num_rows for b in slices(batch, 1, 1)) == 600 and max(b.num_rows for b in slices(batch, 1, 1)) <= 2


def test_the_sample_needs_no_python_workers(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}", "ab"[i % 2]) for i in range(40)], "id long, text string, label string")
    want = {(f"text {i}", "ab"[i % 2]) for i in range(40)}
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **b: pytest.fail("rows that go through Python workers"))
    assert set(labelled_sample(docs, per_label=30, limit=100, longest=100, seed="s")) == want
