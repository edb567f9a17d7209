import numpy as np

import __spark_entry__
import corpus_pipeline
from tabloom.llm import quality
from tests.llm.test_packing import checked
from tests.llm.test_quality import plain_counts
from tests.llm.test_repeats import plain
from tests.llm.test_simhash import plain_components, plain_fingerprint


def whole_rest(text, first, d):
    """What the contract leaves of a text, with every character of which a byte stays."""
    data = text.encode()
    gone = np.zeros(len(data), bool)
    for p in range(len(data) - 49):
        if first[data[p:p + 50]] < d:
            gone[p:p + 50] = True
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        if not gone[at:at + n].all():
            out.append(c)
        at += n
    return "".join(out), bool(gone.any())


def test_stages(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "suffix-array dedup", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    names = docs.columns

    kept = stages[0](spark, docs, folder)
    rows = kept.collect()
    assert kept.schema == docs.schema and 0 < len(rows) < docs.count()
    trees = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = set()
    for r in docs.collect():
        counts = plain_counts(r.text)
        features = quality.measure(r.text.encode())[1]
        if counts[0] >= 20 and 100 * counts[4] <= 30 * counts[0] and trees.raw(np.array([features]))[0] >= 0:
            want.add(r.doc_id)
    assert {r.doc_id for r in rows} == want

    one = stages[1](spark, kept, folder)
    rows = sorted(rows, key=lambda r: r.doc_id)
    roots = plain_components([plain_fingerprint(r.text, 3) for r in rows], 3)
    rows = [r for k, r in enumerate(rows) if roots[k] == k]
    assert one.columns == names and sorted(map(tuple, one.collect())) == sorted(map(tuple, rows))

    cut = stages[2](spark, one, folder)
    pairs = [(r.doc_id, r.text) for r in rows]
    assert any(x[2] for x in plain(pairs))
    first = {}
    for d, t in pairs:
        for p in range(len(t.encode()) - 49):
            first.setdefault(t.encode()[p:p + 50], d)
    left = {}
    for d, t in pairs:
        rest, changed = whole_rest(t, first, d)
        if rest or not changed:
            left[d] = rest
    got = cut.collect()
    assert cut.columns == names and {r.doc_id: r.text for r in got} == left and all(r.n_chars == len(r.text) for r in got)

    checked_rows = stages[3](spark, cut, folder).collect()
    assert {r.doc_id for r in checked_rows} == set(left)
    assert sum(r.length for r in checked_rows) == sum({r.doc_id: r.doc_tokens for r in checked_rows}.values())
    from tabloom.llm import packing
    checked(packing.pack(cut, 2048, with_ids=True).collect(), left, 2048)


def test_run_and_registration(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def _words(k, n=60):
    return " ".join(f"w{k}q{i * 104729 % 99991}x" for i in range(n)) + "."


def test_odd_documents(spark, folder):
    """Nulls, empty and equal texts, ties and columns with the names that the stages use."""
    texts = [(1, _words(1)), (2, _words(2)), (3, _words(1)), (3, _words(3)), (3, _words(3)), (4, None), (5, ""), (6, "too short"), (7, "again " * 80), (8, _words(2).upper()),
             (9, _words(9, 30) + " " + _words(1, 25)), (10, _words(10, 20_000)), (None, _words(11)), (None, _words(1))]
    columns = "doc_id long, text string, lang string, source string, n_chars long, row long, component_id string, label_id int, queue string, left string, n_removed int, length int"
    rows = [(i, t, "en", None if k % 3 else f"s{k % 2}", None if t is None else len(t), 0, "c", k, "q", "l", k, k) for k, (i, t) in enumerate(texts)]
    docs, names = spark.createDataFrame(rows, columns), [c.split()[0] for c in columns.split(", ")]
    stages = [f for _, f in corpus_pipeline.STAGES]
    kept = stages[0](spark, docs, folder)
    assert kept.columns == names and sorted(r.queue + str(r.length) for r in kept.collect()) == sorted(f"q{k}" for k, (i, t) in enumerate(texts) if t and i not in (6, 7))
    one = stages[1](spark, kept, folder)
    got = sorted(((r.doc_id is None, r.doc_id, r.length) for r in one.collect()), key=str)
    assert one.columns == names and len({i for _, i, _ in got}) == len(got) and {i for _, i, _ in got} == {1, 2, 3, 9, 10, None}
    cut = stages[2](spark, one, folder)
    left = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == names and set(left) == {1, 2, 3, 9, 10, None}
    assert left[9].text == _words(9, 30) + left[9].text[len(_words(9, 30)):] and len(left[9].text) < len(_words(9, 30)) + 20 and left[9].n_chars == len(left[9].text)
    assert all(left[k].text == t for k, t in ((1, _words(1)), (2, _words(2)), (10, _words(10, 20_000))))
    pieces = stages[3](spark, cut, folder).collect()
    assert {r.doc_id for r in pieces} == set(left) and sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())


def test_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0 and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[3][1](spark, docs, folder).count() == 0
