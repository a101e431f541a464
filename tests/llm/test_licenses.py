import re

from assayer.llm import licenses


def test_corpus_notices_are_found_and_nothing_else(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.id: r for r in licenses.scan(docs, licenses.train(docs)).collect()}
    notice = {
        "mit": "Released under the MIT License", "apache-2.0": "Licensed under the Apache License, Version 2.0",
        "gpl-3.0": "GNU General Public License, version 3", "cc-by-nc": "Licensed under CC BY-NC 4.0",
    }
    assert len(rows) == docs.count()
    for d in docs.collect():
        want = sorted({f for f, t in notice.items() if re.search(t, d.text or "", re.I)})
        got = sorted(set(rows[d.doc_id].families) & set(notice))
        assert got == want, (d.doc_id, got, want)
        if "licen" not in (d.text or "").lower() and "rights" not in (d.text or "").lower():
            assert not rows[d.doc_id].families


def test_every_template_is_recognised_alone(spark, no_docs, odd_docs):
    texts = [(i, t) for i, t in enumerate(t for f in licenses.FAMILIES for t in licenses.TEMPLATES[f])]
    owner = [f for f in licenses.FAMILIES for _ in licenses.TEMPLATES[f]]
    model = licenses.train(no_docs)
    rows = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    right = sum(r.families == [owner[r.id]] for r in rows)
    assert right >= 0.9 * len(rows)
    odd = licenses.scan(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and not any(r.families for r in odd)
    assert licenses.scan(no_docs, model).count() == 0
