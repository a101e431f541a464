"""Divergences against plain Python over small tables with many ties and odd rows."""

import re
from collections import Counter, defaultdict

import pytest

from assayer.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, listed=50):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(UPPER))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        within = Counter(t for _, _, terms in own for t in set(terms))
        kept = sorted(t for t, n in within.items() if n >= least)
        counts, whole = defaultdict(Counter), Counter()
        for _, source, terms in own:
            counts[source].update(t for t in terms if within[t] >= least)
            whole.update(t for t in terms if within[t] >= least)

        def share(count, total):
            return 1 + 1_000_000_000 * (count + 5) // (total + 5 * len(kept))

        p = {s: {t: share(counts[s][t], counts[s].total()) for t in kept} for s in {d[1] for d in own}}
        q = {t: share(whole[t], whole.total()) for t in kept}
        for s in p:
            pairs = [(u, sum(abs(p[s][t] - p[u][t]) for t in kept)) for u in p if u != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(items[: listed if part == "term" else None], 1)]
    return sorted(out)


def ours(spark, rows, least, listed=50):
    docs = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "'x' AS term", "1 AS n", "2 AS digest", "3 AS kept", "4 AS p")
    return sorted(map(tuple, divergence.audit(docs, least=least, listed=listed).collect()))


ROWS = [
    ("The cat, the CAT sat.", "en", "a"), ("the cat sat", "en", "b"), ("dog dog dog", "en", "b"), ("", "en", "c"), (None, "en", None), ("123 _ ", "en", ""),
    ("Ärger ÄRGER ärger x", "de", "a"), ("ärger x", "de", "a"), ("x y z", None, None), ("the cat sat on the mat", None, "q"), ("lonely words", "fr", "a"), ("lonely", "fr", "b"),
    *[("copied text of the cat 𝒳 \U0001f600", "en", s) for s in "aaaaaaabbbc"], ("z" * 5000 + " the " * 4000, "en", "c"),
]


def test_terms_in_bounded_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE_BYTES", 7)
    text = "The  cat-sat, on É日本x the MAT" * 30
    found = [t.decode() for part in divergence._terms(text.encode().translate(divergence.TERM_BYTES)) for t in part]
    assert found == TERM.findall(text.translate(UPPER))


def test_handed_on_early(monkeypatch):
    counts, documents = {("en", "a"): Counter({b"x": 3, b"y": 1}), ("en", "b"): Counter({b"x": 1})}, {("en", "a"): Counter({b"x": 2, b"y": 1}), ("en", "b"): Counter({b"x": 1})}
    monkeypatch.setattr(divergence, "ROWS", 1)
    rows = sorted(tuple(r.values()) for batch in divergence._rows(counts, documents) for r in batch.to_pylist())
    assert rows == [("en", "a", "x", 3, 2), ("en", "a", "y", 1, 1), ("en", "b", "x", 1, 1)] and not counts and not documents


@pytest.mark.parametrize("least", [1, 2, 3, 12])
def test_equals_plain_python(spark, least):
    assert ours(spark, ROWS, least) == plain(ROWS, least)


def test_listed_terms_and_ties(spark):
    rows = [(" ".join(f"t{chr(97 + i)}" for i in range(26)), "en", "a"), (" ".join(f"u{chr(97 + i)}" for i in range(26)), "en", "b")]
    assert ours(spark, rows, 1, listed=5) == plain(rows, 1, listed=5)


def test_no_rows(spark):
    assert ours(spark, [], 1) == []


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    found = spark.range(1).select(divergence.share(F.lit(7 * 10**17), F.lit(9 * 10**17), F.lit(1000)).alias("p"), divergence.share(F.lit(0), F.lit(0), F.lit(0)).alias("none")).first()
    assert found.p == 1 + 1_000_000_000 * (7 * 10**17 + 5) // (9 * 10**17 + 5000) and found.none is None
