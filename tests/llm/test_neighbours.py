import zlib
from collections import Counter

import numpy as np
import pytest

from tabloom.llm import neighbours
from tabloom.llm.queries import QUERIES

COLUMNS = ["doc_id", "held_out", "score", "predicted"]


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))


@pytest.fixture(scope="module")
def space(tables):
    return neighbours.train(*tables)


def test_held_out_accuracy(spark, tables, space):
    rows = {r.doc_id: r for r in neighbours.classify(tables[0], space).collect()}
    marks = {r.doc_id: r.quality for r in tables[1].collect()}
    assert len(rows) == tables[0].count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    unseen = [(rows[i].predicted, q) for i, q in marks.items() if i in rows and rows[i].held_out]
    assert np.mean([p == q for p, q in unseen]) > 0.95
    assert np.mean([p for p, q in unseen if q]) > 0.97
    assert np.mean([1 - p for p, q in unseen if not q]) > 0.7


def test_scores_against_brute_force(tables, space):
    """Votes with plain Python numbers from the same vectors, one document at a time."""
    docs = tables[0].limit(60).collect()
    counts = np.stack([neighbours.term_counts((r.text or "").encode()) for r in docs])
    got = space.scores(counts)
    for row, score in zip(space.place(counts), got):
        cosine = [max(sum(int(a) * int(b) for a, b in zip(row, v)), 0) for v in space.vectors]
        least = sorted(cosine)[-neighbours.NEIGHBOURS]
        near = [(c, y) for c, y in zip(cosine, space.labels) if c >= least]
        assert score == pytest.approx(sum(c * y for c, y in near) / sum(c for c, _ in near), abs=1e-12)
    # A score does not depend on the rows around it.
    assert [space.scores(counts[k:k + 1])[0] for k in range(len(docs))] == list(got)


def test_term_counts_of_slices(monkeypatch):
    """Distances between words are the same however a text is cut."""
    text = ("One two two three.\nOne | 12 é\t" * 50).encode()
    whole = neighbours.term_counts(text)
    monkeypatch.setattr(neighbours, "SLICE", 40)
    assert list(neighbours.term_counts(text)[neighbours.RUN_TERMS:]) == list(whole[neighbours.RUN_TERMS:])
    words, want, seen = text.split(), Counter(), {}
    for k, w in enumerate(words):
        want[(k - seen[w]).bit_length() if w in seen else 0] += 1
        seen[w] = k
    assert {k: n for k, n in enumerate(whole[neighbours.RUN_TERMS:]) if n} == want


def test_labels_of_held_out_rows_are_not_read(spark, tables, space):
    docs, labels = tables
    turned = labels.withColumn("quality", neighbours.F.when(neighbours.held_out(neighbours.F.col("doc_id")), 1 - neighbours.F.col("quality")).otherwise(neighbours.F.col("quality")))
    again = neighbours.train(docs, turned)
    assert np.array_equal(space.vectors, again.vectors) and np.array_equal(space.labels, again.labels)


def test_document_frequency(spark):
    texts = ["a b", "a b", None, "", "| | |"]
    df, n = neighbours.document_frequency(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert n == 5 and list(df) == list(sum((neighbours.term_counts((t or "").encode()) > 0).astype(int) for t in texts))


def test_edge_cases(spark, space):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "A text."), (4, "x" * 2_500_000), (5, "w " * 800_000), (6, "漢字" * 1000), (7, "same"), (7, "same")]
    docs = spark.createDataFrame([(*r, 0.5, True) for r in rows], "doc_id long, text string, score double, held_out boolean")
    got = neighbours.classify(docs, space)
    assert got.columns == COLUMNS
    found = got.collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in rows)
    empty = {r.score for r in found if r.doc_id in (1, 2)}
    assert empty == {space.labels.mean()}
    assert [r.held_out for r in found if r.doc_id is None] == [None]
    assert neighbours.classify(docs.limit(0), space).count() == 0


def test_without_usable_labels(spark, tables):
    docs, labels = tables
    assert neighbours.train(docs, labels.limit(0)) is None
    assert neighbours.train(docs, labels.where("quality = 1")) is None
    few = docs.limit(5)
    assert {(r.score, r.predicted) for r in neighbours.classify(few, None).collect()} == {(1.0, 1)}


def test_repeated_labels_and_rows(spark, tables):
    """Repeated rows and further labels of a document change nothing if they say the same."""
    docs, labels = tables
    twice = neighbours.train(docs.where("doc_id < 600").unionAll(docs.where("doc_id < 300")), labels.unionAll(labels))
    labelled = {r.doc_id for r in labels.collect()}
    ids = {r.doc_id for r in docs.collect() if r.doc_id < 600 and r.doc_id in labelled and zlib.crc32(str(r.doc_id).encode()) % 5}
    assert len(twice.labels) == len(ids)


def test_query(spark, folder):
    df = QUERIES["op12_neighbours"](spark, folder)
    assert df.columns == COLUMNS and df.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
