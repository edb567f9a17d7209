import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tabloom.llm import minhash


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_bins(hashes):
    """The same rule in plain Python."""
    least = [None] * 256
    for h in hashes:
        b = (h >> 56) + 128
        if least[b] is None or h < least[b]:
            least[b] = h
    full = [b for b in range(256) if least[b] is not None]
    out = []
    for j in range(256):
        b = j
        if least[j] is None:
            b = next((t[j] for t in minhash.TRIES if least[t[j]] is not None), None)
            if b is None:
                a, s = minhash.ORDERS[0][j], minhash.ORDERS[1][j]
                b = min(full, key=lambda c: ((a * c + s) % minhash.PRIME, c))
        out.append(least[b])
    return out


def expected(rows):
    """id, characters and digest of the edited text."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        out.append((i, t, t[:len(t) - half] + following[:half], following))
    return out


WORDS = [f"w{k}é" for k in range(3000)]


def some_rows():
    rng = np.random.default_rng(9)
    texts = [None, "", " \n\t", "one", "a b c d", "a b c d e", "a  b\x0bc d e f", "🙂 漢字", "many " * 30_000]
    for _ in range(40):
        words = [WORDS[k] for k in rng.integers(0, 3000, rng.integers(5, 900))]
        texts += [" ".join(words), " ".join(words[:-3] + ["x", "y", "z"])]
    rows = [(k * 7 % 101, t) for k, t in enumerate(texts)]
    return rows + [rows[12]] * 3 + [(None, "no id"), (None, None)]


def test_bins(spark):
    rng = np.random.default_rng(4)
    sets = [rng.integers(-2**63, 2**63, n).tolist() for n in (1, 2, 5, 30, 200, 3000)]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "k int, h array<long>").select("k", minhash.bins(F.col("h")).alias("b"))
    assert {r.k: r.b for r in df.collect()} == {k: plain_bins(s) for k, s in enumerate(sets)}


def run(spark, rows, monkeypatch, range_rows):
    monkeypatch.setattr(minhash, "RANGE_ROWS", range_rows)
    df = spark.createDataFrame([("f", i, t, 1) for i, t in rows], "fp string, doc_id long, text string, part int").repartition(3)
    return minhash.fingerprint(df).collect()


def test_fingerprints(spark, monkeypatch):
    rows = some_rows()
    want = expected(rows)
    for range_rows in (2048, 4):
        got = run(spark, rows, monkeypatch, range_rows)
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in want)
        by_text = {}
        for r in got:
            near = [(t, e, f) for i, t, e, f in want if i == r.doc_id and hashlib.sha256(e.encode()).hexdigest() == r.edited_sha256]
            t, e, f = near[0]
            assert by_text.setdefault(" ".join(re.findall(r"[^\x20\x09-\x0D]+", t)), r.fingerprint) == r.fingerprint
            assert len(r.fingerprint) == (512 if shingles(t) else 0)
            assert abs(r.near_edited - jaccard(t, e)) < 0.17 and abs(r.near_next - jaccard(t, f)) < 0.17
            if jaccard(t, e) == 1:
                assert r.near_edited == 1


def test_the_estimate_has_no_bias(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(300):
        n, shared = (30, 20) if k % 2 else (600, 300)
        both = [f"s{x}" for x in rng.integers(0, 10**9, shared)]
        rows.append((k, " ".join(both + [f"a{x}" for x in rng.integers(0, 10**9, n - shared)]), " ".join(both + [f"b{x}" for x in rng.integers(0, 10**9, n - shared)])))
    df = spark.createDataFrame(rows, "k int, a string, b string")
    got = df.select("k", minhash.likeness(minhash.packed(F.col("a")), minhash.packed(F.col("b"))).alias("s")).collect()
    true = {k: jaccard(a, b) for k, a, b in rows}
    for parity in (0, 1):
        off = [r.s - true[r.k] for r in got if r.k % 2 == parity]
        assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.12


def test_small_tables(spark, monkeypatch):
    assert run(spark, [], monkeypatch, 4) == []
    only, = run(spark, [(None, "abcd")], monkeypatch, 4)
    assert (only.n_chars, only.near_next, only.edited_sha256) == (4, 1.0, hashlib.sha256(b"abab").hexdigest())
