import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import repeats, suffixes


def test_cover():
    for period in (4, 7, 13, 16):
        cover = suffixes.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"ab", b"abcabcabcabc", b"\x00", b"\xff", b"x" * 40, b"the same words again "]), min_size=1, max_size=40), st.randoms())
def test_suffix_order(parts, random):
    text = b"".join(parts)
    words = suffixes.leading_words(text)
    starts = np.array(sorted(random.sample(range(len(text)), random.randint(1, len(text)))))
    got = suffixes.sort_suffixes(words, suffixes.cover_ranks(words, len(text)), starts).tolist()
    assert sorted(got) == starts.tolist()
    padded = text + bytes(200)
    keys = [padded[p:p + suffixes.DEPTH] for p in got]
    assert keys == sorted(keys)
    assert suffixes.equal_next(words, np.array(got), 50).tolist() == [a[:50] == b[:50] for a, b in zip(keys, keys[1:])]


def plain(rows):
    """The contract, gram by gram."""
    first = {}
    data = [((1 << 63) - 1 if d is None else d, (t or "").encode()) for d, t in rows]
    for d, x in data:
        for p in range(len(x) - 49):
            g = x[p:p + 50]
            first[g] = min(first.get(g, d), d)
    out = []
    for (d, x), (own, _) in zip(data, rows):
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - 49):
            if first[x[p:p + 50]] < d:
                gone[p:p + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((own, len(x), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~gone])).hexdigest()))
    return out


SCHEMA = "row string, doc_id long, text string, block int, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([("r", d, t, 1, len(t or "")) for d, t in rows], SCHEMA)


def corpus(seed, n=120):
    rng = np.random.default_rng(seed)
    words = [f"wörd{k}" for k in range(200)]
    phrase = [" ".join(words[k] for k in rng.integers(0, 200, rng.integers(4, 40))) for _ in range(12)]
    rows = [(3, None), (1, ""), (None, phrase[0]), (None, phrase[0]), (7, "a" * 49), (8, "a" * 50), (9, "a" * 400), (10, "a" * 300 + "b"), (11, "ab" * 100), (12, "ba" * 100), (500, "é" * 100), (501, "xé" + "é" * 60)]
    for k in range(n):
        parts = [" ".join(words[j] for j in rng.integers(0, 200, rng.integers(0, 30))) for _ in range(rng.integers(1, 4))]
        if rng.random() < 0.6:
            parts.insert(rng.integers(0, len(parts) + 1), phrase[rng.integers(0, len(phrase))])
        rows.append((int(rng.integers(20, 400)), " ".join(parts)))
        if rng.random() < 0.2:
            rows.append((int(rng.integers(20, 400)), rows[-1][1]))
    rows += [rows[20]] * 3
    rows.append((13, " ".join(words[j] for j in rng.integers(0, 200, 20000)) + phrase[3]))
    return rows


@pytest.mark.parametrize("seed, block, part, bits", [(1, 8 << 20, 400_000, 4 << 20), (2, 2000, 50, 1000), (3, 1, 5000, 1 << 14)])
def test_repeats(spark, monkeypatch, seed, block, part, bits):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    monkeypatch.setattr(repeats, "PART", part)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", bits)
    rows = corpus(seed)
    got = repeats.repeats(frame(spark, rows).repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(plain(rows))


def test_code_collisions_do_no_harm(spark):
    rows = corpus(4, 40)
    assert Counter(map(tuple, repeats.repeats(frame(spark, rows), code_bits=8).collect())) == Counter(plain(rows))


def test_without_repeats(spark):
    rows = corpus(5)
    got = repeats.without_repeats(frame(spark, rows)).collect()
    left = {}
    for (d, t), (_, n, gone, _, _) in zip(rows, plain(rows)):
        left.setdefault((d, t), (n, gone))
    whole = Counter((d, t) for d, t in rows if left[d, t][1] == 0)
    assert Counter((r.doc_id, r.text) for r in got if (r.doc_id, r.text) in whole) == whole
    assert all(r.n_chars == len(r.text or "") for r in got)
    assert set(got[0].asDict()) == {"row", "doc_id", "text", "block", "n_chars"}
    fully = Counter((d, t) for d, t in rows if left[d, t][1] and left[d, t][1] == left[d, t][0])
    assert len(got) == len(rows) - sum(fully.values())
    # Characters of which a byte stays are kept whole.
    assert next(r.text for r in got if r.doc_id == 501) == "x"


def test_small_tables(spark):
    assert repeats.repeats(frame(spark, [])).count() == 0
    assert repeats.without_repeats(frame(spark, [])).count() == 0
    assert Counter(map(tuple, repeats.repeats(frame(spark, [(1, None)])).collect())) == Counter(plain([(1, None)]))


def test_a_hot_code_is_split(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(repeats, "PART", 500)
    rng = np.random.default_rng(6)
    foreign = lambda: "".join(chr(97 + k) for k in rng.integers(0, 26, 60))
    rows = [(int(rng.integers(0, 300)), foreign()[:k % 40] + "a passage that a third of all documents have in common, be it short" + foreign()) for k in range(400)]
    rows += rows[:40] + [(400 + k, "z" * (60 + k)) for k in range(30)]
    sizes, settled = Counter(), repeats.settled

    def seen(strings, *rest):
        for r in strings.collect():
            sizes[r.bucket] += sum(x.nbytes for x in repeats.expand(r.data))
        return settled(strings, *rest)

    monkeypatch.setattr(repeats, "settled", seen)
    got = repeats.repeats(frame(spark, rows).repartition(4)).collect()
    assert Counter(map(tuple, got)) == Counter(plain(rows))
    assert max(sizes.values()) < 0.15 * sum(sizes.values())
