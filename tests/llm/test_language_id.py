"""Language codes: held-out accuracy, pieces and batches against plain n-grams, odd rows."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from assayer.llm import language_id, words


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return language_id.train(docs)


def test_held_out_languages_are_told(docs, model):
    found = language_id.identify(docs, model).join(docs.withColumnRenamed("doc_id", "id").select("id", "lang"), "id").filter("held_out").collect()
    right = sum(r.lang_pred == r.lang for r in found)
    assert len(found) > 150 and right >= 0.98 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6, 20, 60])
def test_code_words_lie_apart(n):
    code = language_id.code_words(n)
    assert code.shape[0] == n and len({tuple(w) for w in code}) == max(n, 1) or n == 0
    if n >= 2:
        apart = min((a != b).sum() for i, a in enumerate(code) for b in code[:i])
        assert apart >= (1 << (n - 2) if n <= 5 else 0.25 * code.shape[1])
        assert all(0 < (bit > 0).sum() < n for bit in code.T)


def plain_grams(text):
    """How often each n-gram occurs, by a loop over words and places."""
    data, word, found = text.encode() + b" ", b"", Counter()
    for c in data:
        if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128:
            word += bytes([c + 32 if 65 <= c <= 90 else c])
        elif word:
            padded = b" " + word + b" "
            for n in language_id.SIZES:
                found.update(g for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) != b" ")
            word = b""
    return found


TEXTS = ["", None, "Ab ab, ÄÖ don't 12x3 ß", "a", "1 2 3", "word " * 300 + "x" * 500 + " été", "Ελλάδα και 日本語 text"]


def number(gram):
    value = np.array([int.from_bytes(gram, "big") + (len(gram) << 40)], dtype=np.uint64)
    return int(words.mix(value)[0] >> np.uint64(64 - 20))


@pytest.mark.parametrize("piece", [1 << 20, 64])
def test_features_and_margins_equal_plain_ones(monkeypatch, piece):
    monkeypatch.setattr(language_id, "PIECE_BYTES", piece)
    monkeypatch.setattr(language_id, "PIECE_WORDS", 40)
    random = np.random.default_rng(1)
    weights = random.normal(size=((1 << 20) + 1, 3)).astype(np.float32)
    got = language_id.margins(pa.array(TEXTS), weights, 20)
    for text, margin, (at, times) in zip(TEXTS, got, language_id.features(pa.array(TEXTS), 20)):
        want = Counter()
        for gram, many in plain_grams(text or "").items():
            want[number(gram)] += many
        assert dict(zip(at.tolist(), times.tolist())) == dict(want)
        total = sum((weights[f].astype(float) * many for f, many in want.items()), np.zeros(3))
        assert np.allclose(margin, total / np.sqrt(max(1, sum(want.values()))) + weights[-1])


def test_decoding_weighs_losses_by_trust():
    code = language_id.code_words(3)
    even = language_id.Model(list("abc"), code, np.zeros((1, 3)), np.full(code.shape, 1 / 3))
    margin = code.astype(float) * 4
    margin[:, 0] = 0
    best, score = even.decode(margin)
    assert best.tolist() == [0, 1, 2] and (score > 0.5).all()
    # The first bit contradicts; a language that does not trust it stays nearest.
    wrong = margin.copy()
    wrong[:, 0] = -code[:, 0] * 30.0
    trust = np.array([[0.0, 0.5, 0.5]] * 3)
    assert language_id.Model(list("abc"), code, np.zeros((1, 3)), trust).decode(wrong)[0].tolist() == [0, 1, 2]
    assert even.decode(np.zeros((1, 3)))[1][0] < language_id.SURE


def test_odd_rows(odd_docs, model):
    found = {(r.id, r.lang_pred, r.ambiguous and r.score == 0) for r in language_id.identify(odd_docs, model).collect()}
    assert (9, "und", True) in found and (1, "und", True) in found and all(pred != "und" for i, pred, _ in found if i not in (9, 1))
    assert language_id.identify(odd_docs, model).count() == odd_docs.count()


def test_empty_and_unlabelled_tables(odd_docs, no_docs, model):
    assert language_id.identify(no_docs, language_id.train(no_docs)).count() == 0
    nothing = language_id.train(odd_docs.withColumn("lang", odd_docs["lang"].substr(9, 1)).filter("false"))
    assert {r.lang_pred for r in language_id.identify(odd_docs, nothing).collect()} == {"und"}
    one = language_id.train(odd_docs.filter("lang = 'en'"))
    assert one.languages == ["en"]
    assert {(r.lang_pred, r.score) for r in language_id.identify(odd_docs, one).collect()} == {("en", 1.0), ("und", 0.0)}


def test_samples_are_bounded_and_even(docs):
    rows = language_id.sample(docs, "doc_id", "text", "lang", per_language=20).groupBy("lang").count().collect()
    assert {r["count"] for r in rows} == {20} and len(rows) == 4
    assert language_id.sample(docs, "doc_id", "text", "lang", languages=2).select("lang").distinct().count() == 2
    assert language_id.sample(docs, "doc_id", "text", "lang", most=8).count() == 8


def test_one_long_text(spark, model):
    text = spark.createDataFrame([(1, "Les dans avec " * 900_000 + "é" * 3_000_000)], "doc_id long, text string")
    assert language_id.identify(text, model).collect()[0].lang_pred == "fr"
