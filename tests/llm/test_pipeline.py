"""The pipeline against plain Python over the same documents."""

import os
from collections import Counter, defaultdict

import corpus_pipeline
from assayer.llm import ngram_model, quality
from assayer import storage
from assayer.storage import materialize
import pyarrow as pa

from .test_exact_dedup import FOLD
from .test_mixing import check
from .test_near_dup import brute
from .test_tokens import crc, ids_of


def test_stages_match_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), "test")
        kept.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    weights = quality.train(raw, labels)
    rows = {r.doc_id: r.text for r in raw.collect()}
    scores = ngram_model.score(pa.array(list(rows.values())), weights, quality.BITS)
    good = {d: t for (d, t), p in zip(rows.items(), scores) if p >= quality.THRESHOLD}
    assert {r.doc_id for r in kept[0]} == set(good)
    last = {}
    for d, t in sorted(good.items()):
        last[t.translate(FOLD)] = d
    assert {r.doc_id for r in kept[1]} == set(last.values())
    groups = brute([(d, rows[d]) for d in last.values()], 5, 80)
    stay = {d for d, _, component in groups if d == component}
    assert sorted(r.doc_id for r in kept[2]) == sorted(stay)
    copies = Counter(r.doc_id for r in kept[3])
    assert set(copies) <= stay and max(copies.values()) <= 2 and all(r.text == rows[r.doc_id] for r in kept[3])
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in kept[4]:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(copies)
    for d, n in copies.items():
        ids = [*ids_of(rows[d]), 0]
        assert sorted(pieces[d]) == sorted((a, len(ids[a : a + 2048]), crc(ids[a : a + 2048])) for a in range(0, len(ids), 2048) for _ in range(n))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_mixing_stage_comes_near_its_targets(spark, sf):
    from assayer.llm import mixing

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(mixing.mix(docs).collect(), [(r.source, r.text) for r in docs.collect()], spark)


def test_odd_and_empty_documents_run_through(spark, odd_docs, no_docs, tmp_path):
    """Nulls, repeated rows, clashing columns, and no rows at all; intermediate tables are gone afterwards."""
    from pyspark.sql import functions as F

    shared = storage.shared_dir(spark).removeprefix("file://")
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        folder, before = str(tmp_path / name), set(os.listdir(shared))
        docs.write.parquet(f"{folder}/documents.parquet")
        labels = spark.createDataFrame([(7, 1), (5, 1), (4, 1), (1, 0), (9, 0)], "doc_id long, quality int")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder)
        rows = out.collect()
        made = set(os.listdir(shared)) - before
        assert len(made) == len(corpus_pipeline.STAGES)
        if name == "none":
            assert not rows
            continue
        kept = spark.read.parquet(f"{folder}/documents.parquet")
        good = {r.doc_id for r in quality.keep_good(kept, quality.train(kept, labels)).collect()}
        assert {r.doc_id for r in rows} <= good
        assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_stages_bound_the_batches_of_python_tasks(spark, sf):
    """Rows of 20 kB: ten thousand of them, or 64 MB, do not reach a Python worker at once; a session's own bound stands."""
    from pyspark.sql import functions as F

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wide = spark.range(0, 2000, 1, 1).select("id", F.repeat(F.lit("x"), 20_000).alias("text"))
    for k in (0, 2, 4):
        spark.conf.unset(setting)
        corpus_pipeline.STAGES[k][1](spark, docs, sf)
        seen = wide.mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r["rows"] for r in seen) == 2000 and max(r["bytes"] for r in seen) < 5_000_000
    try:
        spark.conf.set(setting, "1m")
        corpus_pipeline.small_batches(spark)
        assert spark.conf.get(setting) == "1m"
    finally:
        spark.conf.unset(setting)
