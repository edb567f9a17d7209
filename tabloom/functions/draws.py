"""Random draws as pure functions of (seed, stream, row key).

A draw never depends on partitioning, task retries or row order, and any SQL engine with md5 can repeat it. One
md5 digest carries two independent 52-bit uniforms, so a Box-Muller pair costs a single hash.
"""

from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13
SCALE = float(16**HEX_DIGITS)

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _digest(seed: int, stream: str, keys: tuple[Column, ...]) -> Column:
    parts = [F.lit(f"{seed}|{stream}")] + [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def _unit(digest: Column, start: int) -> Column:
    number = F.conv(F.substring(digest, start, HEX_DIGITS), 16, 10).cast("double")
    return (number + F.lit(0.5)) / F.lit(SCALE)


def uniform(seed: int, stream: str, *keys: Column) -> Column:
    """One uniform draw in the open interval (0, 1) per row."""
    return _unit(_digest(seed, stream, keys), 1)


def normal(seed: int, stream: str, *keys: Column) -> Column:
    """One standard normal draw per row (Box-Muller on the two uniforms of one digest)."""
    digest = _digest(seed, stream, keys)
    radius = F.sqrt(F.lit(-2.0) * F.log(_unit(digest, 1)))
    return radius * F.cos(F.lit(2.0 * math.pi) * _unit(digest, 1 + HEX_DIGITS))


def stream_key(seed: int, stream: str) -> int:
    """64 bits naming a stream of ``array_uniform`` draws."""
    return int.from_bytes(hashlib.md5(f"{seed}|{stream}".encode()).digest()[:8], "big")


def array_uniform(key: int, ids: np.ndarray) -> np.ndarray:
    """Uniform draws in (0, 1) for an array of row ids, again a pure function of stream and id.

    The mixing is the public SplitMix64 finaliser on unsigned 64-bit arithmetic; it serves the sampling tasks,
    where hashing text per draw would dominate the run time.
    """
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def array_normal(seed: int, stream: str, ids: np.ndarray) -> np.ndarray:
    first, second = array_uniform(stream_key(seed, stream + ":a"), ids), array_uniform(stream_key(seed, stream + ":b"), ids)
    return np.sqrt(-2.0 * np.log(first)) * np.cos(2.0 * np.pi * second)
