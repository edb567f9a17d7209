"""Exact quantiles (linear interpolation between order statistics) at any size.

Small inputs use Spark's ``percentile`` directly. That aggregate keeps every distinct value in one buffer, so
beyond a value budget the order statistics are bracketed instead: exact counts of bins of equal width narrow each target to
the bin that holds it. Where a bin still holds too many values, a mergeable quantile sketch proposes a closer range and one exact
count checks it. Only the values left inside the narrowed range are grouped and ranked. The shuffle of a round holds sketches and
counts, never rows.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.small import small_frame

VALUE_BUDGET = 500_000
BRACKET_LIMIT = 100_000
ACCURACY = 10_000
#: Bins of a round over all expressions, and at least so many for each.
BINS, LEAST_BINS = 1 << 16, 64

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class _Target:
    """One wanted quantile: the order statistics it needs and the value range known to hold them."""

    name: str
    prob: float
    value: Column
    first: int
    last: int
    low: float
    high: float
    below: int
    inside: int
    accuracy: int
    settled: bool = False


def exact_quantiles(
    df: DataFrame,
    requests: dict[str, tuple[Column, list[float]]],
    value_budget: int = VALUE_BUDGET,
    bracket_limit: int = BRACKET_LIMIT,
    accuracy: int = ACCURACY,
    known: dict[str, tuple[int, float, float]] | None = None,
) -> dict[str, list[float | None]]:
    """Quantiles of several numeric expressions over ``df``; ``None`` where an expression has no value.

    ``known`` may give the count of every expression and bounds of its values, which saves a scan.
    """
    if not requests:
        return {}
    names = list(requests)
    values = {n: requests[n][0].cast("double") for n in names}
    if known is not None:
        head = {f"{k}{i}": known[n][j] for i, n in enumerate(names) for j, k in enumerate(("n", "lo", "hi"))}
    else:
        head = df.agg(
            *[F.count(values[n]).alias(f"n{i}") for i, n in enumerate(names)],
            *[F.min(values[n]).alias(f"lo{i}") for i, n in enumerate(names)],
            *[F.max(values[n]).alias(f"hi{i}") for i, n in enumerate(names)],
        ).first()
    counts = {n: head[f"n{i}"] for i, n in enumerate(names)}
    if sum(counts.values()) <= value_budget:
        row = df.agg(*[
            F.percentile(values[n], F.array(*[F.lit(float(p)) for p in requests[n][1]])).alias(f"q{i}")
            for i, n in enumerate(names)
        ]).first()
        return {n: list(row[f"q{i}"]) if counts[n] else [None] * len(requests[n][1]) for i, n in enumerate(names)}

    targets = []
    for i, n in enumerate(names):
        for p in requests[n][1] if counts[n] else []:
            at = p * (counts[n] - 1)
            targets.append(_Target(n, p, values[n], math.floor(at), math.ceil(at),
                                   head[f"lo{i}"], head[f"hi{i}"], 0, counts[n], accuracy))
    _count_bins(df, [t for t in targets if t.inside > bracket_limit])
    while any(not t.settled for t in targets):
        _narrow(df, [t for t in targets if not t.settled], bracket_limit)
    picked = _order_statistics(df, targets)
    answer: dict[str, list[float | None]] = {n: [] for n in names}
    for i, t in enumerate(targets):
        first, last = picked[i]
        at = t.prob * (counts[t.name] - 1)
        answer[t.name].append(first + (last - first) * (at - t.first))
    for n in names:
        if not counts[n]:
            answer[n] = [None] * len(requests[n][1])
    return answer


def grouped_quantiles(df: DataFrame, group: str, requests: dict[str, tuple[Column, list[float]]], value_budget: int = VALUE_BUDGET,
                      accuracy: int = ACCURACY) -> dict[str, dict[str, list[float | None]]]:
    """Quantiles of several numeric expressions for each of a few groups, as ``percentile`` gives them; any number of them costs three scans.

    Beyond the budget a sketch proposes cuts close to every wanted rank. The values between two cuts are counted, which tells exactly
    where each rank lies however good the sketch is, and only the values of those stretches are grouped and ranked. Null groups are the
    text ``None``.
    """
    names = list(requests)
    named = df.select(F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("None")).alias("grp"), *[requests[n][0].cast("double").alias(f"x{i}") for i, n in enumerate(names)])
    counts = {r["grp"]: r for r in named.groupBy("grp").agg(*[F.count(f"x{i}").alias(f"n{i}") for i in range(len(names))]).collect()}
    small = sum(r[f"n{i}"] for r in counts.values() for i in range(len(names))) <= value_budget

    def sketched(i: int) -> Column:
        probs = requests[names[i]][1]
        if small:
            return F.percentile(f"x{i}", F.array(*[F.lit(float(p)) for p in probs]))
        slack = 2.0 / accuracy
        near = sorted({e for p in probs for e in (max(0.0, p - slack), min(1.0, p + slack))})
        return F.percentile_approx(f"x{i}", near, accuracy)

    found = {r["grp"]: r for r in named.groupBy("grp").agg(*[sketched(i).alias(f"q{i}") for i in range(len(names))]).collect()}
    if small:
        return {g: {n: list(r[f"q{i}"]) if r[f"q{i}"] is not None else [None] * len(requests[n][1]) for i, n in enumerate(names)} for g, r in found.items()}
    cuts = {(g, i): np.unique([x for x in r[f"q{i}"] or [] if not math.isnan(x)]) for g, r in found.items() for i in range(len(names))}
    counting, width = _Stretches(cuts, len(names)), "grp string, x int, stretch int, n long"
    held: dict[tuple, dict[int, int]] = {}
    for r in named.mapInArrow(lambda batches: counting(batches), width).groupBy("grp", "x", "stretch").agg(F.sum("n").alias("n")).collect():
        held.setdefault((r["grp"], r["x"]), {})[r["stretch"]] = r["n"]
    ranks: dict[tuple, set[int]] = {}
    for g, i in cuts:
        for p in requests[names[i]][1] if counts[g][f"n{i}"] else []:
            at = p * (counts[g][f"n{i}"] - 1)
            ranks.setdefault((g, i), set()).update((math.floor(at), math.ceil(at)))
    wanted = []
    for (g, i), mine in ranks.items():
        stretches = sorted(held[g, i].items())
        upto = np.cumsum([n for _, n in stretches])
        for rank in sorted(mine):
            k = int(np.searchsorted(upto, rank, side="right"))
            wanted.append((g, i, stretches[k][0], rank, rank - int(upto[k] - stretches[k][1])))
    picking = _Stretches(cuts, len(names), {key: np.array(sorted({w[2] for w in wanted if w[:2] == key})) for key in cuts})
    counted = named.mapInArrow(lambda batches: picking(batches), "grp string, x int, stretch int, v double, n long").groupBy("grp", "x", "stretch", "v").agg(F.sum("n").alias("n"))
    upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("grp", "x", "stretch").orderBy("v")))
    places = small_frame(df.sparkSession, wanted, "grp string, x int, stretch int, rank long, place long")
    hit = upto.join(F.broadcast(places), ["grp", "x", "stretch"]).where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("n") <= F.col("place")))
    value = {(r["grp"], r["x"], r["rank"]): r["v"] for r in hit.select("grp", "x", "rank", "v").collect()}
    answer: dict[str, dict[str, list[float | None]]] = {g: {} for g in counts}
    for g, i in cuts:
        n = counts[g][f"n{i}"]
        answer[g][names[i]] = [_between(value, (g, i), p * (n - 1)) if n else None for p in requests[names[i]][1]]
    return answer


def _between(value: dict[tuple, float], key: tuple, at: float) -> float:
    low, high = math.floor(at), math.ceil(at)
    first, last = value[*key, low], value[*key, high]
    return first if first == last or low == high else (high - at) * first + (at - low) * last


class _Stretches:
    """Task side of ``grouped_quantiles``: counts the values between each two cuts, or the different values of the ``kept`` stretches."""

    def __init__(self, cuts: dict[tuple[str, int], np.ndarray], width: int, kept: dict[tuple[str, int], np.ndarray] | None = None):
        self.cuts, self.width, self.kept = cuts, width, kept

    def __call__(self, batches):
        totals: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            keys = batch.column(0)
            for g in pc.unique(keys).to_pylist():
                part = batch.filter(pc.equal(keys, g))
                for i in range(self.width):
                    x = part.column(i + 1).drop_null().to_numpy(zero_copy_only=False)
                    at = np.searchsorted(self.cuts[g, i], x, side="left")
                    if self.kept is None:
                        n = np.bincount(at, minlength=len(self.cuts[g, i]) + 1)
                        totals[g, i] = totals[g, i] + n if (g, i) in totals else n
                        continue
                    v, n = np.unique(x[np.isin(at, self.kept[g, i])], return_counts=True)
                    if len(v):
                        yield self._rows(g, i, np.searchsorted(self.cuts[g, i], v, side="left"), n, v)
        for (g, i), n in totals.items():
            some = np.nonzero(n)[0]
            yield self._rows(g, i, some, n[some])

    @staticmethod
    def _rows(g: str, i: int, stretch: np.ndarray, n: np.ndarray, v: np.ndarray | None = None) -> pa.RecordBatch:
        columns = {"grp": pa.array([g] * len(n), pa.string()), "x": pa.array(np.full(len(n), i), pa.int32()), "stretch": pa.array(stretch, pa.int32())}
        if v is not None:
            columns["v"] = pa.array(v, pa.float64())
        return pa.RecordBatch.from_pydict({**columns, "n": pa.array(n, pa.int64())})


DIGIT_BITS = 16


def value_at_rank(df: DataFrame, column: Column, rank: int) -> int | None:
    """The ``rank``-th smallest value (0-based) of an integer column, found digit by digit in 64-bit integers.

    Each of the four scans counts the values by their next 16 bits among those that share the bits found so far, so a
    round moves counts only and its result has at most 65,536 rows.
    """
    if rank < 0:
        return None
    value = column.cast("long")
    found: int | None = None
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        upper = F.shiftright(value, shift)
        rows = df.where(value.isNotNull()) if found is None else df.where(F.shiftright(value, shift + DIGIT_BITS) == found)
        for r in sorted(rows.groupBy(upper.alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect()):
            if rank < r["n"]:
                found = r["digit"]
                break
            rank -= r["n"]
        else:
            return None
    return found


def _count_bins(df: DataFrame, targets: list[_Target]) -> None:
    """Shrink every range to the bins of equal width that hold its order statistics.

    The bin of a value never falls as the value grows, rounding included, so the counts are exact ranks, and least and largest
    value of a bin are the ends of a range that holds the bin's values alone.
    """
    shared: dict[tuple, list[_Target]] = {}
    for t in targets:
        if math.isfinite(t.high - t.low) and t.high > t.low:
            shared.setdefault((t.name, t.low, t.high), []).append(t)
    bins, parts = max(LEAST_BINS, BINS // max(1, len(shared))), None
    for k, ((_, low, high), mine) in enumerate(shared.items()):
        values = df.select(mine[0].value.alias("v")).where(F.col("v").between(low, high))
        place = F.floor((F.col("v") - F.lit(low)) / F.lit(high - low) * F.lit(bins))
        one = values.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).withColumn("k", F.lit(k))
        parts = one if parts is None else parts.unionByName(one)
    counted: dict[int, list] = {}
    for r in parts.collect() if parts is not None else []:  # a row for each bin
        counted.setdefault(r["k"], []).append((r["bin"], r["n"], r["low"], r["high"]))
    for k, mine in enumerate(shared.values()):
        rows = sorted(counted[k])
        upto = np.cumsum([n for _, n, _, _ in rows])
        for t in mine:
            a, b = (int(np.searchsorted(upto, rank, side="right")) for rank in (t.first, t.last))
            t.low, t.high, t.below, t.inside = rows[a][2], rows[b][3], int(upto[a]) - rows[a][1], int(upto[b] - upto[a]) + rows[a][1]


def _narrow(df: DataFrame, open_targets: list[_Target], bracket_limit: int) -> None:
    """Shrink every open range once; settle those small enough, or no longer shrinking because of ties."""
    for t in open_targets:
        t.settled = t.inside <= bracket_limit or t.low == t.high
    work = [t for t in open_targets if not t.settled]
    if not work:
        return

    def ends(t: _Target) -> list[float]:
        slack = 2.0 / t.accuracy
        return [max(0.0, (t.first - t.below) / t.inside - slack), min(1.0, (t.last - t.below + 1) / t.inside + slack)]

    # Targets that still search the same range of one expression share a sketch.
    shared: dict[tuple, list[int]] = {}
    for i, t in enumerate(work):
        shared.setdefault((t.name, t.low, t.high, t.accuracy), []).append(i)
    row = df.agg(*[
        F.percentile_approx(F.when(work[g[0]].value.between(work[g[0]].low, work[g[0]].high), work[g[0]].value),
                            [p for i in g for p in ends(work[i])], work[g[0]].accuracy).alias(f"s{k}")
        for k, g in enumerate(shared.values())
    ]).first()
    sketches = {f"t{i}": row[f"s{k}"][2 * j:2 * j + 2] for k, g in enumerate(shared.values()) for j, i in enumerate(g)}
    checks = df.agg(
        *[F.count_if(t.value < sketches[f"t{i}"][0]).alias(f"b{i}") for i, t in enumerate(work)],
        *[F.count_if(t.value.between(*sketches[f"t{i}"])).alias(f"m{i}") for i, t in enumerate(work)],
    ).first()
    for i, t in enumerate(work):
        (low, high), below, inside = sketches[f"t{i}"], checks[f"b{i}"], checks[f"m{i}"]
        holds = below <= t.first and below + inside > t.last
        if not holds:  # the sketch was off by more than it promises: a finer one for the same range
            t.accuracy = min(t.accuracy * 10, 10**8)
            continue
        if inside >= t.inside:
            t.settled = True
            continue
        t.low, t.high, t.below, t.inside = low, high, below, inside


def _order_statistics(df: DataFrame, targets: list[_Target]) -> dict[int, tuple[float, float]]:
    """Group the values left in each range and find the two wanted ranks among their running counts."""
    known = {i: (t.low, t.high) for i, t in enumerate(targets) if t.low == t.high}
    ranged = [(i, t) for i, t in enumerate(targets) if i not in known]
    if not ranged:
        return known
    inside = [t.value.between(t.low, t.high) for _, t in ranged]
    cells = F.array(*[F.when(held, F.struct(F.lit(i).alias("t"), t.value.alias("v"))) for held, (i, t) in zip(inside, ranged)])
    counted = (
        df.where(reduce(lambda a, b: a | b, inside))  # most rows are in no range
        .select(F.explode(F.array_compact(cells)).alias("cell"))
        .groupBy("cell.t", "cell.v").agg(F.count(F.lit(1)).alias("n"))
    )
    upto = F.sum("n").over(Window.partitionBy("t").orderBy("v"))
    wanted = small_frame(
        df.sparkSession, [(i, t.first - t.below, t.last - t.below) for i, t in ranged], "t int, first long, last long")
    rows = (
        counted.withColumn("upto", upto).join(F.broadcast(wanted), "t")
        .groupBy("t").agg(
            F.min(F.when(F.col("upto") > F.col("first"), F.col("v"))).alias("first"),
            F.min(F.when(F.col("upto") > F.col("last"), F.col("v"))).alias("last"))
        .collect()
    )
    return known | {r["t"]: (r["first"], r["last"]) for r in rows}
