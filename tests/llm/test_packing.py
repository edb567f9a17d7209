import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabloom.llm.packing import SCALE, Queues, pack
from tabloom.llm.tokens import byte_pairs

SCHEMA = "source string, doc_id long, text string, queue int, `sequence_id` string, block string"


def round_robin(lengths, weights, quantum):
    """The plain loop: (queue, token) in the order of service."""
    alike = [[q for q in range(len(weights)) if weights[q] == w] for w in weights]
    deficit = [(2 * a.index(q) + 1) * SCALE // (2 * len(a)) for q, a in enumerate(alike)]
    done, order = [0] * len(lengths), []
    while sum(done) < sum(lengths):
        for q, n in enumerate(lengths):
            deficit[q] += weights[q]
            if deficit[q] >= SCALE:
                deficit[q] -= SCALE
                served = range(done[q], min(n, done[q] + quantum))
                order += [(q, j) for j in served]
                done[q] += len(served)
    return order


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([900, 900, 901, 5000, 20000, SCALE]), st.integers(1, 60)), min_size=1, max_size=25), st.integers(1, 30), st.integers(1, 50), st.integers(1, 40))
def test_queues_equal_the_plain_loop(pairs, quantum, window, step):
    pairs = sorted(pairs, key=lambda x: (x[0], -x[1]))
    weights, lengths = [w for w, _ in pairs], [n for _, n in pairs]
    order = round_robin(lengths, weights, quantum)
    kinds, n = np.unique(np.array(pairs).T, axis=1, return_counts=True)
    for queues in (Queues(weights, lengths, [1] * len(pairs), quantum), Queues(*kinds.tolist(), n.tolist(), quantum)):
        stretches = [(q, j, min(step, n - j)) for q, n in enumerate(lengths) for j in range(0, n, step)]
        queue, begin, length = np.array(stretches, np.int64).T
        index, start, size, at, offset = (x.tolist() for x in queues.pieces(queue, begin, length, window))
        cells = sorted((w * window + o + k, int(queue[i]), int(begin[i]) + s + k) for i, s, m, w, o in zip(index, start, size, at, offset) for k in range(m))
        assert cells == [(k, q, j) for k, (q, j) in enumerate(order)]
        assert all(0 < m and o + m <= window for m, o in zip(size, offset))


@pytest.mark.parametrize("sources", [5, 500])
def test_documents_stay_in_few_pieces_and_windows_keep_the_mixture(sources):
    rng = np.random.default_rng(5)
    lengths = np.sort(rng.integers(5_000, 50_000, sources))
    share = lengths / lengths.sum()
    weights = np.maximum(1, np.rint(share * SCALE)).astype(int)
    order = np.lexsort((-lengths, weights))
    lengths, weights, share = lengths[order], weights[order], share[order]
    queues = Queues(weights.tolist(), lengths.tolist(), [1] * sources, 256)
    queue, begin = (np.concatenate(x) for x in zip(*((np.full(-(-n // 1000), q), np.arange(0, n, 1000)) for q, n in enumerate(lengths))))
    length = np.minimum(1000, lengths[queue] - begin)
    index, start, size, at, _ = queues.pieces(queue, begin, length, 2048)
    assert len(index) / (size.sum() / 1000) < 6.5
    held = np.zeros((at.max() + 1, sources))
    np.add.at(held, (at, queue[index]), size)
    early = np.cumsum(held, axis=0)[:int(0.9 * len(held))]  # before queues run dry
    ideal = 2048 * np.arange(1, len(early) + 1)[:, None] * share[None, :]
    assert abs(early - ideal).max() <= 2 * 256
    assert abs(np.diff(early, axis=0) - 2048 * share[None, :]).max() <= 2 * 256


def test_thousands_of_sources_are_placed_quickly():
    lengths = np.random.default_rng(6).integers(100, 200_000, 3000)
    weights = np.maximum(1, np.rint(lengths / lengths.sum() * SCALE)).astype(int)
    queues = Queues(weights.tolist(), lengths.tolist(), [1] * 3000, 256)
    order = np.lexsort((-lengths, weights))
    queue = np.random.default_rng(7).integers(0, 3000, 512)
    length = np.minimum(1000, lengths[order][queue])
    began = time.monotonic()
    queues.pieces(queue, np.zeros(512, np.int64), length, 2048)
    assert time.monotonic() - began < 2


TEXTS = ["", None, "one", "Eins, zwei  drei\n\n vier\tfünf  \n", "a<|endoftext|>b  <|endoftext|> \n c", "word " * 3000, "it's  what we'll  do", "  x\x1c y\x85\x85z", "漢字 かな"]


def test_ids_are_those_of_the_library():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in TEXTS:
        assert byte_pairs("byte_bpe_50k").ids(text or "") == library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("ab1'st ,\n\t \x1c\x85 é漢<|")), max_size=30))
def test_ids_of_random_texts(text):
    library = _library()
    assert byte_pairs("byte_bpe_50k").ids(text) == library.encode(text, add_special_tokens=False).ids


def _library(made=[]):
    if not made:
        made.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return made[0]


def checked(rows, texts_by_id, window, doc_tokens=None):
    library = _library()
    pieces, grid = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        grid[r.sequence_id].append(r)
        assert r.length > 0
    for doc_id, own in pieces.items():
        ids = [*library.encode(texts_by_id[doc_id] or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids == ids[at:at + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert set(pieces) == set(texts_by_id)
    assert sorted(grid) == list(range(len(grid)))
    for k, own in grid.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and (at == window or k == max(grid))
    return grid


def test_pack(spark):
    rows = [(("x", "y", None)[k % 3], k, t, 1, "s", "b") for k, t in enumerate(TEXTS * 3)]
    got = pack(spark.createDataFrame(rows, SCHEMA).repartition(4), window=64, quantum=1, with_ids=True).collect()
    grid = checked(got, {k: t for _, k, t, *_ in rows}, 64)
    total = defaultdict(int)
    for r in got:
        total[r.queue] += r.length
    for k, own in grid.items():  # every full window has the mixture of the whole
        if k < len(grid) - 2:
            for q, n in total.items():
                assert abs(sum(r.length for r in own if r.queue == q) - 64 * n / sum(total.values())) <= 2.5


def test_pack_by_weights(spark):
    rows = [("a", 1, "word " * 400, 1, "", ""), ("b", 2, "word " * 2000, 1, "", "")]
    got = pack(spark.createDataFrame(rows, SCHEMA), window=100, weights={"a": 0.5, "b": 0.5}, quantum=1, with_ids=True).collect()
    grid = checked(got, {1: rows[0][2], 2: rows[1][2]}, 100)
    for own in list(grid.values())[:6]:
        assert {k: sum(r.length for r in own if r.doc_id == k) for k in (1, 2)} == {1: 50, 2: 50}


def test_empty_null_and_repeated(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0
    got = pack(spark.createDataFrame([(None, None, None, 1, "", "")] * 3, SCHEMA)).collect()
    assert [(r.doc_id, r.length, r.doc_tokens, r.sequence_id) for r in got] == [(None, 1, 1, 0)] * 3
    assert sorted(r.offset for r in got) == [0, 1, 2]


@pytest.mark.parametrize("sources", [70])
def test_more_sources_than_queues(spark, sources):
    rows = [(f"s{k % sources}", k, f"text {k}", 1, "", "") for k in range(300)]
    checked(pack(spark.createDataFrame(rows, SCHEMA), window=32, quantum=8, with_ids=True).collect(), {k: t for _, k, t, *_ in rows}, 32)


def test_every_source_has_its_queue(spark):
    rows = [(f"s{k:03}", k, "word " * (40 if k % 2 else 120), 1, "", "") for k in range(150)]  # stored by source
    got = pack(spark.createDataFrame(rows, SCHEMA).coalesce(1), window=600, quantum=1, with_ids=True).collect()
    grid = checked(got, {r[1]: r[2] for r in rows}, 600)
    sizes = {r.doc_id: r.doc_tokens for r in got}
    for own in list(grid.values())[:-2]:
        for k, n in sizes.items():
            assert abs(sum(r.length for r in own if r.doc_id == k) - 600 * n / sum(sizes.values())) <= 2.5


def test_a_named_source_keeps_its_weight(spark):
    rows = [(f"s{k % 90:03}", k, "some words", 1, "", "") for k in range(900)] + [("z", 1000, "word " * 3000, 1, "", "")]
    got = pack(spark.createDataFrame(rows, SCHEMA), window=100, weights={"z": 0.5, "s000": 0.5}, quantum=1, with_ids=True).collect()
    grid = checked(got, {r[1]: r[2] for r in rows}, 100)
    assert sum(r.length for r in grid[0] if r.doc_id == 1000) >= 49 - 10  # 30 tokens of s000 are all it has
    assert sum(r.length for r in grid[1] if r.doc_id == 1000) >= 90
