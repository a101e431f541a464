import hashlib
from collections import defaultdict

import pytest

from assayer.llm import exact_dedup

from .conftest import TEXTS

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture
def index(spark):
    made = exact_dedup.temporary_index(spark)
    yield made
    made.drop()
    assert not spark.catalog.tableExists(made.table)


def rows(found):
    return sorted(((r.id is None, r.id, bytes(r.digest), r.keep_id, r.group_size, r.kept) for r in found.collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_groups_match_brute_force(odd_docs, index, parts):
    found = exact_dedup.deduplicate(odd_docs, index, parts=parts).collect()
    groups = defaultdict(list)
    for doc_id, text, *_ in TEXTS:
        groups[hashlib.sha256((text or "").translate(FOLD).encode()).digest()].append(doc_id)
    assert len(found) == len(TEXTS)
    for r in found:
        ids = groups[bytes(r.digest)]
        keep = max((x for x in ids if x is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.id == keep)
    assert index.rows().count() == len(groups)


def test_rows_without_id_are_decided_once(spark, index):
    df = spark.createDataFrame([(None, "a"), (None, "A"), (None, "b")], "doc_id long, text string")
    assert [(r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(df, index, "x").orderBy("group_size").collect()] == [(None, 1, True), (None, 2, True), (None, 2, True)]
    assert not any(r.kept for r in exact_dedup.deduplicate(df, index, "y").collect())


def test_second_corpus_meets_the_index(odd_docs, index):
    exact_dedup.deduplicate(odd_docs.filter("doc_id = 3"), index, "first")
    found = {(r.id, r.keep_id, r.kept) for r in exact_dedup.deduplicate(odd_docs.filter("doc_id in (7, 5)"), index, "second").collect()}
    assert found == {(7, 3, False), (5, 5, True)}
    assert index.rows().count() == 2


def test_later_batches_of_a_corpus_meet_the_index(spark, sf, index, monkeypatch):
    """The anti-join decides: copies in the second range of ids are not new."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    new, ingest = [], exact_dedup.DigestIndex.ingest

    def watched(self, groups, batch):
        new.append((groups.count(), (decided := ingest(self, groups, batch)).filter("is_new").count()))
        return decided

    monkeypatch.setattr(exact_dedup.DigestIndex, "ingest", watched)
    exact_dedup.deduplicate(docs, index)
    assert len(new) == 2 and new[0][0] == new[0][1] and 0 < new[1][1] < new[1][0]


def test_a_batch_that_runs_again_gets_the_same_answer(odd_docs, index):
    first = rows(exact_dedup.deduplicate(odd_docs, index, "a"))
    exact_dedup.deduplicate(odd_docs.withColumn("doc_id", odd_docs.doc_id + 100), index, "b")
    held = index.rows().count()
    assert rows(exact_dedup.deduplicate(odd_docs, index, "a")) == first
    assert index.rows().count() == held


@pytest.mark.parametrize("after_append", [False, True])
@pytest.mark.parametrize("at", [0, 1])
def test_a_run_that_dies_around_the_append_can_run_again(odd_docs, index, monkeypatch, at, after_append):
    write, calls = exact_dedup.DigestIndex._write, []

    def dies(self, found, mode):
        calls.append(mode)
        if len(calls) - 1 == at:
            if after_append:
                write(self, found, mode)
            raise RuntimeError("lost")
        write(self, found, mode)

    with monkeypatch.context() as m:
        m.setattr(exact_dedup.DigestIndex, "_write", dies)
        with pytest.raises(RuntimeError):
            exact_dedup.deduplicate(odd_docs, index, "a")
    again = rows(exact_dedup.deduplicate(odd_docs, index, "a"))
    other = exact_dedup.temporary_index(index.spark)
    assert again == rows(exact_dedup.deduplicate(odd_docs, other))
    assert index.rows().count() == other.rows().count()
    other.drop()


def test_keep_distinct_keeps_one_row_and_all_columns(odd_docs, no_docs, index):
    kept = exact_dedup.keep_distinct(odd_docs, index, "a")
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 4, 5, 7, 9]
    assert exact_dedup.keep_distinct(no_docs, index, "b").count() == 0
