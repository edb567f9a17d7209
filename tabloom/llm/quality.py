"""Quality rules: gradient-boosted trees over document statistics.

Documents are measured by exact statistics (words, symbols, repeated lines and word windows). Two plain rules reject short
and repetitive texts; a boosted-tree model trained on labelled documents judges the rest. The trees are grown on the
driver from a bounded sample, flattened into numpy node arrays, and scored for a whole Arrow batch at once. Chosen
features carry a monotonic constraint: more symbols, capitals or repetition can only lower the score.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import BLANKS, id_and_text, text_bytes

SYMBOLS = b"#*$%&|<>"
#: Bytes that continue a code point in UTF-8.
CONTINUING = bytes(range(0x80, 0xC0))
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Labelled documents that the model is fitted to, at most; they are those with the smallest hashes of their ids.
TRAIN_ROWS = 8192

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Shares that do not depend on a text's length or language, so a clean text unlike the training sample is not at risk.
FEATURES = ("symbol_share", "dup_line_share", "repeat_share", "stutter_share", "capital_share", "exclamation_share", "digit_share")
#: +1: the score may only rise with the feature, -1: only fall, 0: free.
MONOTONE = (-1, -1, -1, -1, -1, -1, 0)

#: Odd factors that mix the word ids of a window.
FACTORS = np.random.default_rng(20240229).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """How many words lie in a window of ``width`` words that occurs twice or more in the sequence of word ids."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    wide = ids.astype(np.uint64)
    code = np.zeros(n, np.uint64)
    for k in range(width):
        code += wide[k:k + n] * FACTORS[k]
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    # The codes only propose; neighbours in the order are compared word by word, so a collision cannot count.
    left, right = order[:-1][same], order[1:][same]
    equal = np.ones(len(left), bool)
    for k in range(width):
        equal &= ids[left + k] == ids[right + k]
    edge = np.zeros(len(ids) + 1, np.int64)
    starts = np.unique(np.concatenate([left[equal], right[equal]]))
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: bytes) -> tuple[list[int], list[float]]:
    """The exact counts of one text and the features made from them."""
    words = text.split()
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    solid = text.translate(None, BLANKS)
    points = len(solid.translate(None, CONTINUING))
    n, n_lines = len(words), len(lines)
    symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    dup_lines = n_lines - len(set(lines))
    repeats = repeated_words(ids) if len(seen) < n and n > WINDOW else 0
    share = lambda chars: (len(solid) - len(solid.translate(None, chars))) / max(1, points)
    features = [symbols / max(1, points), dup_lines / max(1, n_lines), repeats / max(1, n), int((ids[1:] == ids[:-1]).sum()) / max(1, n),
                share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"!"), share(b"0123456789")]
    return [n, points, symbols, dup_lines, repeats], features


@dataclass
class Trees:
    """All trees as one set of node arrays; node 0 of tree t is ``roots[t]``, and a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """The log odds of each row of ``x``."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...] = MONOTONE, rounds: int = 60, depth: int = 3,
              rate: float = 0.2, bins: int = 64, ridge: float = 1.0, min_rows: int = 10) -> Trees:
    """Boosted trees for the log loss, grown on quantile bins.

    Constrained features take only splits whose children respect the direction, and children inherit the mid value as
    a bound, so that the whole ensemble is monotonic in them.
    """
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(len(y), base)
    nodes: list[list[float]] = []
    roots = []

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        at = len(nodes)
        g, h = grad[rows].sum(), hess[rows].sum()
        worth = float(np.clip(-g / (h + ridge), low, high))
        nodes.append([0, np.inf, at, at, worth * rate])
        best = None
        if level < depth and len(rows) >= 2 * min_rows:
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, j]
                gl, hl = (np.cumsum(np.bincount(b, weights=v[rows], minlength=len(c) + 1))[:-1] for v in (grad, hess))
                nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                wl, wr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(g - gl) / (h - hl + ridge), low, high)
                gain[(nl < min_rows) | (len(rows) - nl < min_rows) | ((wr - wl) * monotone[j] < 0)] = -np.inf
                k = int(np.argmax(gain))
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = (float(gain[k]), j, k, float(wl[k]), float(wr[k]))
        if best is None:
            score[rows] += worth * rate
            return at
        _, j, k, wl, wr = best
        goes = binned[rows, j] <= k
        middle = (wl + wr) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[monotone[j]]
        left = grow(rows[goes], level + 1, *bounds[0])
        right = grow(rows[~goes], level + 1, *bounds[1])
        nodes[at] = [j, float(cuts[j][k]), left, right, 0.0]
        return at

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    flat = np.array(nodes).reshape(-1, 5)
    return Trees(flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4],
                 np.array(roots, np.int64), base, depth)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_id: str = "doc_id",
          label_column: str = "quality", rows: int = TRAIN_ROWS) -> Trees | None:
    """Fit the trees to at most ``rows`` labelled documents; None if fewer than 50 are found or all have one label.

    A document with several labels counts with the lowest; of several rows with its id, the text with the smallest digest counts.
    Null ids and null labels are left out.
    """
    chosen = (labels.where(F.col(label_id).isNotNull() & F.col(label_column).isNotNull())
              .groupBy(F.col(label_id).cast("long").alias("label_id")).agg(F.min(F.col(label_column).cast("double")).alias("label"))
              .orderBy(F.xxhash64("label_id"), "label_id").limit(rows))
    found = id_and_text(docs, id_column, text_column).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("label_id", "label", "text")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[bytes, float, list[float]]] = {}
        for batch in batches:
            for key, label, text in zip(batch.column("label_id").to_pylist(), batch.column("label").to_pylist(), text_bytes(batch.column("text"))):
                digest = hashlib.blake2b(text, digest_size=16).digest()
                if key not in best or digest < best[key][0]:
                    best[key] = digest, label, measure(text)[1]
        columns = zip(*((k, *v) for k, v in best.items())) if best else [()] * 4
        kinds = pa.int64(), pa.binary(), pa.float64(), pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["label_id", "digest", "label", "x"])

    firsts = found.mapInArrow(measured, "label_id long, digest binary, label double, x array<double>")
    one_each = firsts.groupBy("label_id").agg(F.min(F.struct("digest", "label", "x")).alias("one")).select("one.label", "one.x")
    sample = sorted(one_each.collect(), key=lambda r: (r.label, r.x))
    y = np.array([r.label > 0.5 for r in sample], float)
    if len(y) < 50 or y.min() == y.max():
        return None
    return fit_trees(np.array([r.x for r in sample]), y)


def verdicts(trees: Trees | None, counts: list[list[int]], features: list[list[float]], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, score and kept for measured documents."""
    c = np.array(counts, np.int64).reshape(-1, len(COUNTS))
    failed = (c[:, 0] < MIN_WORDS) | (100 * c[:, 4] > MAX_REPEAT_PERCENT * c[:, 0])
    if trees is None or not len(c):
        score = np.ones(len(c))
    else:
        score = 1 / (1 + np.exp(-trees.raw(np.array(features))))
    return failed, score, ~failed & (score >= threshold)


def assess(docs: DataFrame, trees: Trees | None, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: its id, the counts, ``base_failed``, ``score`` (share of good) and ``kept``.

    Null and empty texts have no words and fail the base rules; a null id stays null; repeated rows each get their row; an
    empty table gives no rows. Without trees (no usable labels) the base rules alone decide. Other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [measure(t) for t in text_bytes(batch.column("text"))]
            failed, score, kept = verdicts(model.value, [p[0] for p in pairs], [p[1] for p in pairs], threshold)
            counts = np.array([p[0] for p in pairs], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(len(COUNTS))), pa.array(failed),
                                              pa.array(score), pa.array(kept)], ["doc_id", *COUNTS, "base_failed", "score", "kept"])

    kinds = ", ".join(f"{c} long" for c in COUNTS)
    return id_and_text(docs, id_column, text_column).mapInArrow(judged, f"doc_id long, {kinds}, base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, trees: Trees | None, text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns whatever they are called."""
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [measure(t) for t in text_bytes(batch.column(text_column).cast(pa.string()))]
            yield batch.filter(pa.array(verdicts(model.value, [p[0] for p in pairs], [p[1] for p in pairs], threshold)[2], pa.bool_()))

    return docs.mapInArrow(passed, docs.schema)
