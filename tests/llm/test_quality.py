import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import quality


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab \n\x0b\xa0\x85É漢🙂#|")), max_size=120))
def test_counts(text):
    assert quality.measure(text.encode())[0] == plain_counts(text)


def test_counts_of_repetition():
    for text in ("a b c d e f g h " * 5, "x " * 50, " ".join(map(str, range(40))) + " " + " ".join(map(str, range(30, 45))), "line\nline\n line\n\n \nline"):
        assert quality.measure(text.encode())[0] == plain_counts(text)


def test_trees_follow_their_constraints():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] + 0.1 * rng.standard_normal(2000) > 0.6) | (x[:, 2] > 0.9)).astype(float)
    trees = quality.fit_trees(x, y, monotone=(1, -1, 0))
    assert ((trees.raw(x) > 0) == (y > 0.5)).mean() > 0.9
    grid = np.linspace(-0.2, 1.2, 200)
    for _ in range(20):
        probe = np.repeat(rng.random((1, 3)), 200, axis=0)
        for j, sign in ((0, 1), (1, -1)):
            moved = probe.copy()
            moved[:, j] = grid
            assert (sign * np.diff(trees.raw(moved)) >= -1e-9).all()


def test_flat_trees_equal_a_walk_of_the_nodes():
    rng = np.random.default_rng(2)
    x = rng.random((500, 4))
    trees = quality.fit_trees(x, (x[:, 1] > x[:, 2]).astype(float), monotone=(0, 0, 0, 0), rounds=10)

    def walk(row):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        return total

    assert np.allclose(trees.raw(x), [walk(r) for r in x])


def test_held_out_accuracy(spark, folder):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    trees = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    other = quality.assess(docs, trees).join(labels.where("doc_id % 3 = 0"), "doc_id").where("not base_failed").collect()
    assert len(other) > 80
    assert np.mean([r.kept == bool(r.quality) for r in other]) >= 0.97
    good = [r.kept for r in other if r.quality]
    assert np.mean(good) >= 0.98


SCHEMA = "n_words string, doc_id long, text string, kept int, score string"


def test_edge_cases(spark):
    texts = [None, "", "word " * 19, " ".join(map(str, range(20))), "z " * 100_000, " ".join(f"w{k}" for k in range(50_000))]
    rows = [("n", k, t, 1, None) for k, t in enumerate(texts)] + [(None, None, texts[3], None, None)] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    got = quality.assess(df, None).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((r[1], *plain_counts(r[2])) for r in rows)
    assert {r.doc_id: (r.base_failed, r.kept) for r in got} == {0: (True, False), 1: (True, False), 2: (True, False), 3: (False, True), 4: (True, False), 5: (False, True), None: (False, True)}
    assert quality.assess(df.limit(0), None).count() == 0
    assert Counter(map(tuple, quality.keep_good(df, None).collect())) == Counter([rows[3], rows[5], *rows[6:]])
    assert quality.train(df, spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")) is None


def test_a_repeated_labelled_id_counts_once(spark):
    clean = lambda k: " ".join(f"word{(k * 7 + j * j) % 91}" for j in range(40))
    texts = [(0, clean(0))] * 3000 + [(k, clean(k) if k % 2 == 0 else clean(k) + " #$% !!! ABC" * 20) for k in range(1, 100)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(k, k % 2 ^ 1) for k in range(100)], "doc_id long, quality int")
    trees = quality.train(docs, labels, rows=100)
    other = quality.train(docs.dropDuplicates().repartition(5), labels, rows=100)
    assert trees is not None and np.array_equal(trees.value, other.value) and np.array_equal(trees.threshold, other.threshold)
