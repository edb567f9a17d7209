import hashlib
import re
import zlib
from collections import Counter
from math import exp, log

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import sampled_pieces as sp

MODEL = "piece_bpe_32k.model"
V = sp.lattice_of(MODEL)
ID_OF = {V.output[i].decode().replace(" ", "▁"): int(i) for i in V.ids}


def segmentations(word, theta):
    """All ways to write a stretch, with their weights."""
    if not word:
        return {(): 1.0}
    out = Counter()
    for n in range(1, min(len(word), V.longest) + 1):
        piece = word[:n]
        if piece in ID_OF:
            head, weight = (ID_OF[piece],), (V.rank[ID_OF[piece]] + 1) ** -theta
        elif n == 1:
            head = tuple(int(V.byte_id[b]) for b in piece.encode())
            weight = (len(V.keys) + 1) ** (-theta * len(head))
        else:
            continue
        for rest, w in segmentations(word[n:], theta).items():
            out[head + rest] += weight * w
    return out


@pytest.mark.parametrize("theta", [0.0, 0.3, 1.0])
@pytest.mark.parametrize("text", ["hello", "in the", "漢a", "tt  t"])
def test_shares_are_exact(text, theta):
    keys = np.arange(40_000)
    got = Counter(map(tuple, (x.tolist() for x in sp.sample(V, [text] * len(keys), keys, theta, 3))))
    want = {(): 1.0}
    for word in re.findall("▁+[^▁]*", "▁" + text.replace(" ", "▁")):
        ways = segmentations(word, theta)
        total = sum(ways.values())
        want = {a + b: p * w / total for a, p in want.items() for b, w in ways.items()}
    assert set(got) <= set(want)
    for ids, p in want.items():
        spread = (p * (1 - p) / len(keys)) ** 0.5
        assert abs(got[ids] / len(keys) - p) <= 5 * spread + 3 / len(keys)


def test_forward_sums_all_segmentations():
    words = ["▁hello", "▁a", "▁▁▁x", "▁漢", "▁nation"]
    codes = np.array([ord(c) for w in words for c in w], np.int64)
    size = np.array([len(w) for w in words])
    total = sp.forward(V, codes, np.cumsum(size) - size, size, 0.7)[-1]
    for word, t in zip(words, total):
        assert abs(exp(t - log(sum(segmentations(word, 0.7).values()))) - 1) < 1e-9


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("  ab th\n\t▁é漢🙂<s>in\x00")), max_size=40), max_size=6), st.integers(-2**63, 2**63 - 1))
def test_decoding_is_lossless(texts, key):
    for text, ids in zip(texts, sp.sample(V, texts, np.full(len(texts), key), 1.0, 5)):
        assert sp.decode(V, ids).decode() == text


def test_draws_do_not_depend_on_the_batch(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    a = {r.doc_id: r for r in sp.segment(docs, with_ids=True).collect()}
    b = {r.doc_id: r for r in sp.segment(docs.repartition(7), with_ids=True).collect()}
    assert a == b and all(r.lossless for r in a.values())
    for r in docs.collect():
        x = a[r.doc_id]
        assert x.n_bytes == len(r.text.encode()) and x.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
        assert x.n_pieces == len(x.ids) and x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
    other = {r.doc_id: r.ids_crc32 for r in sp.segment(docs, seed=18).collect()}
    assert sum(other[k] != r.ids_crc32 for k, r in a.items()) > 0.9 * len(a)


def test_edge_cases(spark):
    texts = [None, "", " ", "   ", "a", "▁", "x" * 5000, "ab " * 100_000, "\n\n", "a b"]
    rows = [(k, k, t, "y") for k, t in enumerate(texts)] + [(1, None, "a b c d e f", "y")] * 2
    df = spark.createDataFrame(rows, "n_pieces int, doc_id long, text string, ids string").repartition(2)
    got = sp.segment(df).collect()
    assert Counter((r.doc_id, r.n_bytes, r.lossless) for r in got) == Counter((i, len((t or "").encode()), True) for _, i, t, _ in rows)
    assert len({r.ids_crc32 for r in got if r.doc_id is None}) == 1
    assert {r.doc_id: r.n_pieces for r in got}[0] == 0 == {r.doc_id: r.n_pieces for r in got}[1]
    assert sp.segment(df.limit(0)).count() == 0
