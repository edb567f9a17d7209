import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import simhash
from tabloom.llm.components import components


def plain_fingerprint(text, width):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, distance):
    """fps: index -> fingerprint; the smallest index reachable."""
    n = len(fps)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from(list("aB1 \n\x0b\x1c\xa0É漢")), max_size=60), st.integers(1, 4))
def test_fingerprint(text, width):
    assert simhash.fingerprint(text.encode(), width) == plain_fingerprint(text, width)


def test_fingerprint_of_long_text():
    text = " ".join(f"w{k % 701}" for k in range(5000))
    assert simhash.fingerprint(text.encode(), 3) == plain_fingerprint(text, 3)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("aB1 \n\x0bÉ漢")), max_size=80), st.integers(1, 4), st.integers(1, 30))
def test_fingerprint_in_stretches(text, width, stretch):
    whole, simhash.STRETCH = simhash.STRETCH, stretch
    try:
        assert simhash.fingerprint(text.encode(), width) == plain_fingerprint(text, width)
    finally:
        simhash.STRETCH = whole


def test_fingerprint_of_a_million_words_in_bounded_memory():
    text = b"one two three four five six seven eight nine ten " * 100_000
    tracemalloc.start()
    simhash.fingerprint(text, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=7), st.integers(0, 7))
def test_close_pairs_share_a_key_and_keep_its_budgets(a, flips, distance):
    b = a
    for k in flips[:distance]:
        b ^= 1 << k
    found = False
    for start, mask in simhash.key_masks(distance):
        good = simhash.within(np.array([a], np.uint64), np.array([b], np.uint64), np.array([start]), distance)[0]
        found |= bool((a & mask) == (b & mask) and good)
    assert found


def near(rng, fp, most):
    for k in rng.choice(64, rng.integers(0, most + 1), replace=False):
        fp ^= 1 << int(k)
    return fp


@pytest.mark.parametrize("block", [8, 2048])
def test_links_give_the_components(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(7)
    fps = {0}
    for _ in range(40):
        centre = int(rng.integers(0, 2**63))
        chain = centre
        for _ in range(rng.integers(1, 60)):
            fps.add(near(rng, centre, 4))
            chain = near(rng, chain, 3)
            fps.add(chain)
    fps = sorted(fps)
    signed = [simhash.as_signed(x) for x in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 3)
    found = {r.node: r.root for r in components(links).collect()}
    want = plain_components(fps, 3)
    groups = defaultdict(set)
    for x, r in zip(signed, want):
        groups[r].add(x)
    for g in groups.values():
        roots = {found.get(x, x) for x in g}
        assert roots == {min(g)}
    assert all((a ^ b) & (2**64 - 1) for a, b in links.collect())


def test_components_of_paths_and_hubs(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(1, 90)] + [(5, 5), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(90)}, **{k: 100 for k in range(100, 161)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


WORDS = [f"word{k}" for k in range(400)]
SCHEMA = "fp string, doc_id long, text string, row string, component_id double, root string"


def rows_of_documents():
    rng = np.random.default_rng(3)
    texts = [None, "", " \n", "Hello World", "hello WORLD", "x", "y", "long " * 20000]
    for _ in range(15):
        words = [WORDS[k] for k in rng.integers(0, 400, 300)]
        texts.append(" ".join(words))
        for _ in range(rng.integers(0, 5)):
            changed = list(words)
            changed[rng.integers(0, 300)] = "other"
            texts.append(" ".join(changed))
    rows = [("f", 1000 - k, t, "r", 0.5, "x") for k, t in enumerate(texts)]
    return rows + [rows[9], ("f", None, texts[9], "r", None, None), ("f", None, "only without id", "", 0.0, "")]


def test_simhash(spark):
    rows = rows_of_documents()
    fps = [plain_fingerprint(t, 3) for _, _, t, *_ in rows]
    want = plain_components(fps, 3)
    least = defaultdict(list)
    for r, row in zip(want, rows):
        least[r] += [row[1]] if row[1] is not None else []
    expected = Counter((row[1], f"{fp:016x}", min(least[r], default=None)) for row, fp, r in zip(rows, fps, want))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert Counter(map(tuple, simhash.simhash(df).collect())) == expected
    kept = simhash.keep_one(df).collect()
    assert kept and set(kept[0].asDict()) == {"fp", "doc_id", "text", "row", "component_id", "root"}
    assert Counter(r.doc_id for r in kept) == Counter(min(x, default=None) for x in least.values())
    assert simhash.simhash(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0
