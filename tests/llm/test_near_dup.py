import re

import numpy as np
import pyarrow as pa

from assayer.llm import components, near_dup, words

from .conftest import TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(texts, size):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(FOLD))
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def brute(rows, size, percent):
    """``{(id, set size, component)}``: all pairs, by Python sets."""
    sets = sets_of([t for _, t in rows], size)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    for k, i in enumerate(order):
        if not sets[i]:
            continue
        for j in order[k + 1 :]:
            if 100 * len(sets[i]) < percent * len(sets[j]):
                break
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted(((r.id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_shingle_hashes_stand_for_shingles():
    texts = [r[1] for r in TEXTS] + ["a b c", "A b c", "c b a", "ab c", " \t ", "x", "a b c d", "a b c d e a b c d"]
    found = []
    for _, data, offsets in words.slices(pa.array(texts)):
        found += words.shingle_sets(data, offsets, 4)
    seen = {}
    for hashed, plain in zip(found, sets_of(texts, 4)):
        assert len(hashed) == len(plain)
        assert seen.setdefault(hashed.tobytes(), plain) == plain


def test_bitmaps_bound_overlaps():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [np.unique(pool[a : a + n]) for a, n in zip(rng.integers(0, 900, 80), rng.integers(1, 300, 80))]
    n, bits = np.array([len(s) for s in sets]), [near_dup.bitmap(s) for s in sets]
    left, right = np.triu_indices(len(sets), 1)
    through = near_dup.within_bound(n, bits, left, right, 85)
    for a, b, ok in zip(left, right, through):
        both = len(np.intersect1d(sets[a], sets[b]))
        assert ok or not near_dup.overlap_reaches(len(sets[a]), len(sets[b]), both, 85)
    assert through.mean() < 0.2


def test_sizes_within_reach_lie_in_adjoining_bands(spark):
    """Every size up to 3000 and powers of ten, with the largest size that each threshold lets it meet."""
    sizes = [*range(1, 3001), *[10**k for k in range(4, 9)]]
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    for percent in (50, 80, 85, 90, 100):
        most = (df.n * 100 / percent).cast("long")
        found = df.select(near_dup.size_band(df.n, percent).alias("a"), near_dup.size_band(most, percent).alias("b"))
        assert found.filter("b - a not in (0, 1)").count() == 0
        assert found.select("a").distinct().count() > 5


def test_classes_meet_in_tiles_of_bands(spark):
    """Of classes that share one shingle, pairs within reach by size meet once; no tile holds guests alone."""
    sizes = [10, 11, 12, 13, 20, 22, 40, 47, 48, 300]
    heads = spark.createDataFrame([(1, k, n) for k, n in enumerate(sizes)], "shingle long, node long, n int")
    roots = spark.createDataFrame([(3, 2)], "node long, root long")  # two are one component already
    rows = near_dup.banded(heads, roots, 85).collect()
    tiles = {}
    for r in rows:
        tiles.setdefault(r.band, []).append(r)
    met = [tuple(sorted((p.node, q.node))) for t in tiles.values() for i, p in enumerate(t) for q in t[i + 1 :] if not (p.guest and q.guest)]
    assert len(met) == len(set(met))
    assert {(a, b) for a in range(10) for b in range(a + 1, 10) if 100 * sizes[a] >= 85 * sizes[b]} - {(2, 3)} <= set(met)
    assert all(r.many == len(tiles[r.band]) for r in rows) and all(not all(r.guest for r in t) for t in tiles.values())
    assert 9 not in {r.node for r in rows}  # nothing is near its size


def test_odd_rows(spark, odd_docs, no_docs):
    want = brute([(r[0], r[1]) for r in TEXTS], 4, 85)
    assert got(near_dup.near_duplicates(odd_docs, 4, 85)) == want
    assert near_dup.near_duplicates(no_docs).count() == 0


def test_corpus_matches_all_pairs(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rng = np.random.default_rng(3)
    for k in range(300):  # chains of edits around the threshold, and a line that most texts share
        w = rows[int(rng.integers(0, 40))][1].split()[:120]
        for at in rng.integers(0, len(w), int(rng.integers(0, 1 + len(w) // 40))):
            w[at] = f"new{rng.integers(0, 9)}"
        rows.append((1000 + k, "one line that most of these texts share at their very start " * (k % 3 > 0) + " ".join(w)))
    extended = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 4, 85)
    assert got(near_dup.near_duplicates(extended, 4, 85)) == want
    monkeypatch.setattr(near_dup, "LARGE", 3)
    monkeypatch.setattr(near_dup, "BLOCK", 7)  # many blocks to a tile, and no frequent shingles put last
    monkeypatch.setattr(near_dup, "leader_pairs", lambda classes: classes.selectExpr("node a", "node b").limit(0))
    assert got(near_dup.near_duplicates(extended, 4, 85)) == want
    monkeypatch.setattr(near_dup, "FREQUENT", 3)
    assert got(near_dup.near_duplicates(extended, 4, 85)) == want


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(i, i + 1) for i in range(500, 560)]
    least = {}

    def find(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        least[max(x, y)] = min(x, y)
    want = {x: find(x) for x in list(least) if find(x) != x}
    assert {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_keep_one_decides_by_row(spark, odd_docs, no_docs):
    rows = [(None, "a b c"), (None, "d e f"), (5, "a b c"), (5, "g h i"), (5, "G H I"), (7, "g h i"), (7, "j k l"), (7, "j k l"), (8, ""), (8, ""), (9, None), (9, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as id", "1 as mark", "2 as root", "3 as n")
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns
    found = sorted(((r.doc_id, (r.text or "").lower()) for r in kept.collect()), key=repr)
    assert found == sorted([(None, "d e f"), (5, "a b c"), (5, "g h i"), (7, "j k l"), (8, ""), (8, ""), (9, ""), (9, " ")], key=repr)
    assert near_dup.keep_one(no_docs).count() == 0
    odd = near_dup.keep_one(odd_docs)
    assert odd.columns == odd_docs.columns
    # The cat's texts and the row that repeats one of them are one document; null and empty texts stay.
    assert sorted((r.doc_id or 0) for r in odd.collect()) == [0, 1, 3, 4, 5, 9]


def test_any_shingle_size(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(100))), (2, " ".join(f"w{i}" for i in range(99)) + " x"), (3, "w1 w2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1, 6, 40):
        assert got(near_dup.near_duplicates(df, size, 80)) == brute(rows, size, 80)
