import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import lexical
from tabloom.llm.queries import ORACLES, QUERIES
from tests.compare import compare

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, most):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t, Counter(t)) for i, t in held if t]
    n_docs, n_terms = len(held), sum(len(t) for _, t, _ in held)
    df = Counter(x for _, _, c in held for x in c)
    asked = {}
    for k, text in items:
        asked.setdefault(k, set()).update(terms(text))
    out = []
    for k, wanted in asked.items():
        scored = []
        for i, t, c in held:
            m = 100 - 50 + (50 * len(t) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 20 * m)) for x in wanted if x in c)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(k, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:most], 1)]
    return out


def both(spark, docs, items, most=50, **more):
    d = spark.createDataFrame([(*r, 1, "y", 2) for r in docs], "doc_id long, text string, score int, item_id string, n int")
    q = spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, doc_id string")
    got = lexical.search(d, q, most, **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, items, most), key=key)


DOCS = [(1, "The cat sat. the CAT"), (2, "the dog"), (3, None), (4, ""), (5, "..."), (None, "cat dog"), (None, "cat"), (6, "ÉTÉ été İstanbul K"), (7, "cats concat ca t"),
        (8, "x" * 100_000 + " cat"), (9, "cat " * 50_000), (2, "the dog"), (10, "漢字 かな 🙂cat"), (11, "a1 1a A1\x00cat\x7fdog"), (12, "cat"), (13, "cat"), (14, "rare")]
ITEMS = [(1, "Cat cat CAT?"), (2, "dog; the"), (3, None), (4, ""), (5, "--"), (6, "unknown"), (7, "été ÉTÉ istanbul"), (8, "漢字 🙂cat"), (9, "A1"), (1, "rare"), (None, "k K")]


def test_small_corpus(spark):
    both(spark, DOCS, ITEMS)
    both(spark, DOCS, ITEMS, most=2)


def test_items_in_blocks(spark):
    both(spark, DOCS, ITEMS, most=3, item_bytes=20)


@pytest.mark.parametrize("docs, items", [([], ITEMS), (DOCS, []), ([(1, None)], ITEMS), (DOCS, [(1, None)]), ([], [])])
def test_empty(spark, docs, items):
    both(spark, docs, items)


def test_query_against_brute_force(spark, folder):
    got = QUERIES["op13_lexical"](spark, folder).collect()
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    assert sorted(map(tuple, got)) == sorted(brute([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items], 50))


def test_query_against_sql(spark, folder):
    assert compare(spark, folder, "op13_lexical", QUERIES["op13_lexical"], ORACLES["op13_lexical"]) is None


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("aAb éÉ1.\n\x00漢")), max_size=30), st.lists(st.text(st.sampled_from(list("aAbé1漢 ")), max_size=4), max_size=4))
def test_automaton_counts_whole_terms(text, asked):
    items = lexical.compile_items([(k, t) for k, t in enumerate(asked)])
    numbers = {}
    for t in asked:
        for x in terms(t):
            numbers.setdefault(x, len(numbers))
    n, counts = items.counts(text.encode())
    want = Counter(terms(text))
    assert n == sum(want.values()) and counts == {numbers[t]: k for t, k in want.items() if t in numbers}
