"""How sources differ in their words, language by language, in exact integer arithmetic.

Texts that repeat within a language are collapsed first: rows become one count a language, digest and
source, combined before their shuffle, and each distinct text travels and is cut into terms once, whatever
number of rows holds it.  What a text contributes to document frequencies and counts is then its terms
times its multiplicity in each source.

Divergences of two sources sum over all kept terms of their language, of which most sources lack most.
So pairs are evaluated sparsely: terms that both lack all differ by the same amount; what a source's own
terms differ from the other's floor follows from the histogram of its counts; only terms that both have are
joined, by term.

Defined cases: null text, language or source are the empty string; a language without kept terms has pairs
of value 0 and no term rows; a group without terms has floor probabilities; ties are ordered by item in
UTF-8; repeated rows count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.storage import materialize

#: Letters A-Z, lower-cased, a-z, and all beyond ASCII make terms; every other byte parts them.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Documents of a language that a kept term occurs in at least, what is added to every count, terms listed a group.
LEAST_DOCUMENTS, SMOOTHING, LISTED = 30, 5, 50
SCALE = 1_000_000_000
#: Terms by group that a task holds before it hands them on, bytes of text cut at once, rows handed on at once.
MOST_HELD, PIECE_BYTES, ROWS = 1_000_000, 1 << 22, 50_000


def distinct_texts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """``lang, digest, text`` once for each language's distinct texts, and ``lang, digest, source, n`` with their rows."""
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, lang_col, source_col))
    rows = docs.select(lang.alias("lang"), source.alias("source"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    copies = rows.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("lang", "digest").agg(F.first("text").alias("text")), copies


def term_counts(texts: DataFrame, copies: DataFrame) -> DataFrame:
    """``lang, source, term, count, documents`` from the distinct texts and their multiplicities, dealt by language and term.

    A task combines its texts before anything is shuffled; beyond ``MOST_HELD`` terms it hands on what it has.
    """
    many = copies.groupBy("lang", "digest").agg(F.collect_list("source").alias("sources"), F.collect_list("n").alias("ns"))
    single = texts.join(many, ["lang", "digest"]).select("lang", "text", "sources", "ns")

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        documents: dict[tuple[str, str], Counter] = defaultdict(Counter)
        for batch in batches:
            data = batch.column("text").cast(pa.large_binary())
            groups = zip(*(batch.column(c).to_pylist() for c in ("lang", "sources", "ns")))
            for text, (lang, sources, ns) in zip(data, groups):
                once: set[bytes] = set()
                for terms in _terms(text.as_py().translate(TERM_BYTES)):
                    once.update(terms)
                    repeated = Counter(terms).items() if max(ns) > 1 else ()
                    for source, n in zip(sources, ns):
                        if n == 1:
                            counts[lang, source].update(terms)
                        else:
                            for term, count in repeated:
                                counts[lang, source][term] += n * count
                for source, n in zip(sources, ns):
                    if n == 1:
                        documents[lang, source].update(once)
                    else:
                        for term in once:
                            documents[lang, source][term] += n
                if sum(map(len, documents.values())) > MOST_HELD:
                    yield from _rows(counts, documents)
        yield from _rows(counts, documents)

    combined = single.mapInArrow(combine, "lang string, source string, term string, count long, documents long")
    return combined.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text whose other bytes are spaces, a bounded piece at a time."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE_BYTES)
        end = end if end >= 0 else len(text)
        yield text[at:end].split()
        at = end


def _rows(counts: dict[tuple[str, str], Counter], documents: dict[tuple[str, str], Counter]) -> Iterator[pa.RecordBatch]:
    """What was counted, a group of documents at a time; the counters are empty afterwards."""
    while documents:
        (lang, source), within = documents.popitem()
        found = counts.pop((lang, source), Counter())
        terms = list(found)
        for at in range(0, len(terms), ROWS):
            part = terms[at : at + ROWS]
            columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string())]
            columns += [pa.array([x[t] for t in part], pa.int64()) for x in (found, within)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "count", "documents"])


def share(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * kept))``, exactly; null where nothing is kept."""
    over = (count + F.lit(SMOOTHING)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    under = F.when(kept > 0, total + F.lit(SMOOTHING) * kept).cast("decimal(20,0)")
    return 1 + F.call_function("div", over, under)


def pair_sums(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every two sources of a language, both ways."""
    base = groups.select("lang", "source", "terms", "floor", "kept")
    other = base.select("lang", F.col("source").alias("item"), F.col("terms").alias("item_terms"), F.col("floor").alias("item_floor"))
    pairs = base.join(other, "lang").filter("source <> item")
    # Own terms against the other's floor, each distinct count once.
    histogram = entries.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    own = histogram.join(other, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("n") * F.abs(F.col("p") - F.col("item_floor"))).alias("own"))
    theirs = own.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("own").alias("theirs"))
    # Terms of both: what they differ by, in place of what was summed for them above.
    mine = entries.select("lang", "term", "source", "p", "floor")
    others = entries.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("floor").alias("item_floor"))
    gap = F.abs(F.col("p") - F.col("q")) - F.abs(F.col("p") - F.col("item_floor")) - F.abs(F.col("q") - F.col("floor")) + F.abs(F.col("floor") - F.col("item_floor"))
    met = mine.join(others, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(F.sum(gap).alias("both"))
    both = met.unionByName(met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "both"))
    keys = ["lang", "source", "item"]
    whole = pairs.join(own, keys, "left").join(theirs, keys, "left").join(both, keys, "left").na.fill(0, ["own", "theirs", "both"])
    lacking = (F.col("kept") - F.col("terms") - F.col("item_terms")) * F.abs(F.col("floor") - F.col("item_floor"))
    return whole.select(*keys, F.when(F.col("kept") > 0, lacking + F.col("own") + F.col("theirs") + F.col("both")).otherwise(F.lit(0)).cast("long").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, listed: int = LISTED) -> DataFrame:
    """``lang, source, part, item, value, rank``: each group's divergences from other sources, and its most typical terms."""
    texts, copies = distinct_texts(docs, text_col, lang_col, source_col)
    copies = materialize(copies, "copies")
    everywhere = Window.partitionBy("lang", "term")
    counts = term_counts(texts, copies).withColumns({"documents": F.sum("documents").over(everywhere), "lang_count": F.sum("count").over(everywhere)})
    counts = materialize(counts.filter(F.col("documents") >= least).drop("documents"), "terms")

    kept = counts.select("lang", "term", "lang_count").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_count").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("terms"), F.sum("count").alias("total"))
    groups = copies.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0)
    groups = materialize(groups.withColumn("floor", share(F.lit(0), F.col("total"), F.col("kept"))), "groups")

    entries = counts.join(groups.drop("terms"), ["lang", "source"])
    entries = entries.withColumns({"p": share(F.col("count"), F.col("total"), F.col("kept")), "q": share(F.col("lang_count"), F.col("lang_total"), F.col("kept"))})
    entries = materialize(entries.select("lang", "source", "term", "p", "q", "floor"), "entries")

    in_order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_sums(entries, groups).withColumn("rank", F.row_number().over(in_order))
    typical = entries.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    typical = typical.withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= listed)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(typical.withColumn("part", F.lit("term")).select(*columns))
