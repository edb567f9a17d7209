import zlib
from collections import defaultdict

import numpy as np
import pytest

from tabloom.llm import sharding


def check(rows, got, shards):
    assert len(got) == len(rows)
    want = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    groups = defaultdict(list)
    for r in got:
        groups[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None
    total, largest = sum(r.size for r in got), max((r.size for r in got), default=0)
    for k in range(shards):
        own = groups.get(k, [])
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / shards) <= largest
    assert set(groups) <= set(range(shards))


SCHEMA = "size string, doc_id long, text string, shard string, row int, part string"


def frame(spark, rows):
    return spark.createDataFrame([("s", d, t, "x", 1, None) for d, t in rows], SCHEMA)


@pytest.mark.parametrize("ranges, samples", [(32, 16), (2, 1), (200, 16)])
def test_shards(spark, monkeypatch, ranges, samples):
    monkeypatch.setattr(sharding, "RANGES", ranges)
    monkeypatch.setattr(sharding, "SAMPLES", samples)
    rng = np.random.default_rng(5)
    rows = [(k, "é" * int(rng.integers(0, 200))) for k in range(700)] + [(1000 + k, "hot copy " * 20) for k in range(400)]
    rows += [(5, "again")] * 300 + [(None, None)] * 50 + [(9999, "z" * 20_000), (None, "x")]
    got = sharding.shard_by_bytes(frame(spark, rows).repartition(4), 16).collect()
    check(rows, got, 16)


def test_copies_stay_together_where_they_fit(spark):
    rows = [(k, f"text {k // 5} " * 10) for k in range(2000)]
    shards = defaultdict(set)
    for r in sharding.shard_by_bytes(frame(spark, rows), 16).collect():
        shards[r.text_crc32].add(r.shard)
    assert sum(len(x) > 1 for x in shards.values()) <= 15


def test_small_tables(spark):
    assert sharding.shard_by_bytes(frame(spark, []), 16).count() == 0
    for rows in ([(1, "a")], [(None, None)], [(1, "a"), (1, "a"), (2, "b")]):
        check(rows, sharding.shard_by_bytes(frame(spark, rows), 4).collect(), 4)
