"""Language identification by error-correcting output codes over byte n-grams.

Each language has a code word; a binary logistic regression over hashed n-grams learns each bit, all of them
from the same examples.  A text's margins are decoded to the code word of least loss, where the loss of a
bit counts for a language as much as that bit's classifier was right on the language's texts kept aside.
Where the second-nearest code word is about as near, the text is flagged as ambiguous.

Few languages get the exhaustive code (every way to divide them in two is a bit); more get the best of
several random codes, whose length grows with the logarithm of their number.  Learning takes at most
``PER_LANGUAGE`` labelled rows of each of the ``LANGUAGES`` most frequent languages, at most ``SAMPLE`` in
all, picked by a hash of their id in the same way whatever the partitioning; only their distinct feature
numbers reach the driver.  Every whole text is scored, in pieces cut between words, as n-grams
do not reach beyond a word.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and ambiguous; so is every text
if no row has a language; one language is predicted for all texts with letters, with score 1; null
languages and ids are not learned from, the empty string is a language; rows that repeat are learned from
each and scored each; equal losses go to the first language in code-point order; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import ngram_model, words

#: Languages learned at most, rows of each, rows in all; weights a bit: 2 ** BITS.
LANGUAGES, PER_LANGUAGE, SAMPLE, BITS = 200, 250, 6000, 16
#: Bytes in an n-gram, with a space for either edge of a word.
SIZES = (1, 2, 3, 4)
#: Scores below this are flagged as ambiguous.
SURE = 0.8
UNDETERMINED = "und"
#: Text bytes looked at at once, and words.
PIECE_BYTES, PIECE_WORDS = 1 << 20, 1 << 15

LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def code_words(n: int, seed: int = 11) -> np.ndarray:
    """Rows of +1 and -1, one a language: every division in two up to 5 languages, else the best of random codes."""
    if n < 2:
        return np.ones((n, 0), dtype=np.int8)
    if n <= 5:
        divisions = np.arange((1 << (n - 1)) - 1)  # the first language is always on one side
        return np.array([np.ones(len(divisions)), *[np.where(divisions >> k & 1, 1, -1) for k in range(n - 1)]], dtype=np.int8)
    length, random = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed)
    best, apart = None, -1
    for _ in range(50):
        code = random.choice(np.array([-1, 1], dtype=np.int8), (n, length))
        near = (length - code.astype(int) @ code.T) // 2 + length * np.eye(n, dtype=int)
        if near.min() > apart and (np.abs(code.sum(axis=0)) < n).all():
            best, apart = code, near.min()
    return best


def _word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of letters (and of bytes beyond ASCII) start and end; none reaches into the next text."""
    letter = LETTER[data]
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = letter[1:] != letter[:-1]
    edge[offsets] = True
    bounds = np.flatnonzero(edge)
    run = letter[bounds[:-1]]
    return bounds[:-1][run], bounds[1:][run]


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the n-grams of words, in order of the words, and how many each word has."""
    sizes = ends - starts + 2
    upto = np.cumsum(sizes)
    padded = np.full(int(upto[-1]) if len(upto) else 0, 0x20, dtype=np.uint8)
    word = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(padded)) - (upto - sizes)[word]
    letter = (inside > 0) & (inside < sizes[word] - 1)
    padded[letter] = words.FOLD[data[(starts[word] + inside - 1)[letter]]]
    wide = padded.astype(np.uint64)
    found, owner, packed = [], [], np.zeros(len(wide), dtype=np.uint64)
    for n in SIZES:
        packed = (packed[: len(wide) - n + 1] << np.uint64(8)) | wide[n - 1 :]
        whole = letter if n == 1 else word[: len(packed)] == word[n - 1 :]
        found.append(words.mix(packed[whole[: len(packed)]] + np.uint64(n << 40)) >> np.uint64(64 - bits))
        owner.append(word[: len(packed)][whole[: len(packed)]])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order].astype(np.int64), np.bincount(owner, minlength=len(sizes))


def _pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)``; long texts come in several pieces, cut where no letter is."""
    for at, data, offsets in words.slices(texts, min(words.SLICE_BYTES, PIECE_BYTES)):
        if len(data) <= PIECE_BYTES:
            yield at, data, offsets
            continue
        begin = 0  # one text alone
        while begin < len(data):
            end = begin + PIECE_BYTES
            while end < len(data) and not (gap := np.flatnonzero(~LETTER[data[end : end + PIECE_BYTES]])).size:
                end += PIECE_BYTES
            end = end + int(gap[0]) if end < len(data) else len(data)
            yield at, data[begin:end], np.array([0, end - begin])
            begin = end


def _distinct_words(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of words: starts and ends of the distinct ones, each word's distinct one, and each word's text."""
    starts, ends = _word_spans(data, offsets)
    for k in range(0, len(starts), PIECE_WORDS):
        a, b = starts[k : k + PIECE_WORDS], ends[k : k + PIECE_WORDS]
        low, high = int(a[0]), int(b[-1])
        hashed = words.hashes(words.FOLD[data[low:high]], a - low, b - low)
        _, first, place = np.unique(hashed, return_index=True, return_inverse=True)
        yield a[first], b[first], place, np.searchsorted(offsets, a, side="right") - 1


def features(texts: pa.Array, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct feature numbers and how often it has them."""
    found: list[list] = [[] for _ in range(len(texts))]
    for at, data, offsets in _pieces(texts):
        for starts, ends, place, text in _distinct_words(data, offsets):
            grams, many = _grams(data, starts, ends, bits)
            begin = np.concatenate([[0], np.cumsum(many)])
            for row in np.unique(text):
                which, times = np.unique(place[text == row], return_counts=True)
                parts = [grams[begin[w] : begin[w + 1]] for w in which]
                found[at + row].append((np.concatenate(parts), np.repeat(times, many[which])))
    for parts in found:
        at, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in ([p[k] for p in parts] for k in (0, 1)))
        number, place = np.unique(at, return_inverse=True)
        yield number, np.bincount(place, weights=times, minlength=len(number)).astype(np.int64)


def margins(texts: pa.Array, weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    """A row a text, a column a bit: the classifiers' margins; ``weights`` has the biases behind its last feature."""
    total, counts = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts), dtype=np.int64)
    for at, data, offsets in _pieces(texts):
        for starts, ends, place, text in _distinct_words(data, offsets):
            grams, many = _grams(data, starts, ends, bits)
            begin = np.concatenate([[0], np.cumsum(many)[:-1]])
            of_word = np.add.reduceat(weights[grams], begin, axis=0, dtype=np.float64)
            edge = np.flatnonzero(np.diff(text, prepend=-1))
            total[at + text[edge]] += np.add.reduceat(of_word[place], edge, axis=0)
            counts[at + text[edge]] += np.add.reduceat(many[place], edge)
    return total / np.sqrt(np.maximum(counts, 1))[:, None] + weights[-1]


@dataclass
class Model:
    """Languages in code-point order, their code words, the bits' weights, and how much a bit tells of a language."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    bits: int = BITS

    def decode(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language of least weighted loss for each row of margins, and a score from all losses."""
        loss = np.zeros((len(margin), len(self.languages)))
        for k, word in enumerate(self.code):
            loss[:, k] = np.logaddexp(0.0, -margin * word) @ self.trust[k]
        best = loss.argmin(axis=1)
        apart = np.exp(np.clip((loss.min(axis=1, keepdims=True) - loss) * max(1, self.code.shape[1]), -700, 0))
        return best, 1.0 / apart.sum(axis=1)


def _trust(code: np.ndarray, margin: np.ndarray, language: np.ndarray) -> np.ndarray:
    """For each language the part of its texts that each bit gets right, scaled to a sum of one; even where it has none."""
    out = np.ones(code.shape, dtype=np.float64)
    for k, word in enumerate(code):
        own = margin[language == k]
        if len(own):
            out[k] = ((own * word > 0).sum(axis=0) + 1) / (len(own) + 2)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-12)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, languages: int = LANGUAGES, per_language: int = PER_LANGUAGE, most: int = SAMPLE) -> DataFrame:
    """``id, lang, text`` of at most ``most`` labelled rows that are not held out."""
    known = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    known = known.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    counts = known.sparkSession.createDataFrame([(r.lang, r.n) for r in counts.collect()], "lang string, n long")  # at most ``languages`` rows
    quota = max(1, min(per_language, most // max(1, counts.count())))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    # A draw of about three times the quota is all that is ordered.
    drawn = known.join(F.broadcast(counts), "lang").filter(place * F.col("n") <= 3.0 * quota + 30)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(place, "id", "text"))
    return drawn.withColumn("nth", nth).filter(F.col("nth") <= quota).select("id", "lang", "text")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bits: int = BITS, **limits: int) -> Model:
    """A model learned from a bounded sample (:func:`sample`); every fifth row weighs the bits and is not learned from."""

    def extract(batches):
        for batch in batches:
            at, times, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [0]
            for number, many in features(batch.column(2), bits):
                at.append(number)
                times.append(many)
                ends.append(ends[-1] + len(number))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x), pa.int32())) for x in (at, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["id", "lang", "at", "times"])

    rows = sample(docs, id_col, text_col, lang_col, **limits)
    examples = rows.mapInArrow(extract, "id string, lang string, at array<int>, times array<int>").toArrow().sort_by([("id", "ascending"), ("lang", "ascending")])
    names = examples.column("lang").to_pylist()
    languages = sorted(set(names))
    code = code_words(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros(((1 << bits) + 1, 0), np.float32), np.ones(code.shape), bits)
    language = np.array([languages.index(x) for x in names])
    sparse = []
    for at, times in zip(*(_lists(examples.column(c)) for c in ("at", "times"))):
        sparse.append((at.astype(np.int64), times / np.sqrt(max(1, times.sum()))))
    aside = np.zeros(len(names), dtype=bool)
    for k in range(len(languages)):
        aside[np.flatnonzero(language == k)[4::5]] = True
    labels = (code[language] > 0).astype(np.int64)
    learned = np.flatnonzero(~aside)
    weights = ngram_model.train_sparse([sparse[i] for i in learned], labels[learned], bits, passes=2).astype(np.float32)
    margin = np.array([v @ weights[at] + weights[-1] for at, v in (sparse[i] for i in np.flatnonzero(aside))]).reshape(-1, code.shape[1])
    return Model(languages, code, weights, _trust(code, margin, language[aside]), bits)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    whole = column.combine_chunks()
    values, ends = whole.flatten().to_numpy(), whole.offsets.to_numpy()
    return [values[a - ends[0] : b - ends[0]] for a, b in zip(ends, ends[1:])]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", sure: float = SURE) -> DataFrame:
    """``id, held_out, lang_pred, score, ambiguous`` for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size for a number of languages

    @F.arrow_udf("struct<lang: string, score: double>")
    def decoded(texts: pa.Array) -> pa.Array:
        model = sent.value
        best, score = model.decode(margins(texts, model.weights, model.bits))
        names = pa.array(model.languages, pa.string()).take(pa.array(best))
        return pa.StructArray.from_arrays([names, pa.array(score)], names=["lang", "score"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"), text.alias("text"))
    if not model.languages:
        nothing = (F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
        return rows.select("id", "held_out", *nothing)
    found = rows.select("id", "held_out", "letters", decoded(F.col("text")).alias("d"))
    return found.select(
        "id", "held_out", F.when(F.col("letters"), F.col("d.lang")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(F.col("letters"), F.col("d.score")).otherwise(0.0).alias("score"), (~F.col("letters") | (F.col("d.score") < sure)).alias("ambiguous"),
    )
