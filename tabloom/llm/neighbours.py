"""Quality classifier: labelled neighbours vote in a latent space.

A document becomes counts of structural terms (runs of character kinds, and how far back each word stood before), weighted by
how few documents of the corpus hold a term, and projected on the leading singular directions of the labelled documents. The
vectors of those are broadcast; every document is multiplied with all of them in blocks, and the labels of the nearest vote
with the cosine as their weight.

Term weights, projection and unit vectors are rounded to integers that are small enough for every sum of products to be exact
in doubles, so that a score does not depend on how rows are batched or in which order a matrix product adds up.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import id_and_text, text_bytes

#: Terms: hashed runs of one to four kinds of characters, and the distance of a word to its last occurrence by powers of two.
RUN_TERMS = 1 << 11
GAP_TERMS = 32
TERMS = RUN_TERMS + GAP_TERMS
#: Long texts are read in slices of this many bytes, cut after white space where there is some.
SLICE = 1 << 20

#: Labelled documents that the model is fitted to, at most: those with the smallest hashes of their ids. This bounds the
#: broadcast to LABELLED x SIZE numbers and the term weights and projection to TERMS x SIZE.
LABELLED = 4096
#: Dimensions of the latent space.
SIZE = 48
NEIGHBOURS = 24
#: Documents that are multiplied with the labelled vectors at a time.
BLOCK = 256
#: Units of the integers that stand for term weights, projections and unit vectors.
WEIGHT_UNIT, AXIS_UNIT, VECTOR_UNIT = 1 << 8, 1 << 16, 1 << 20


def _kinds() -> np.ndarray:
    """The kind of each byte: letters by case, bytes beyond ASCII as small letters, digits, blanks, line feeds, and each other sign on its own."""
    kind = np.full(256, 1, np.uint8)
    kind[:33], kind[10], kind[65:91], kind[48:58] = 3, 4, 2, 5
    for k, sign in enumerate(c for c in range(33, 128) if not chr(c).isalnum()):
        kind[sign] = 6 + k
    return kind


KIND = _kinds()
#: Odd factors that mix the kinds of a run; the top bits of the sum choose its term.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def slices(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        if end < len(text):
            end = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end)) + 1 or end
        yield text[at:end]
        at = end


def term_counts(text: bytes) -> np.ndarray:
    """How often a text holds each term."""
    counts = np.zeros(TERMS, np.int64)
    ids: dict[bytes, int] = defaultdict(count().__next__)
    last, before = np.zeros(0, np.int64), 0
    for part in slices(text):
        kinds = KIND[np.frombuffer(part, np.uint8)]
        # A stretch of letters, digits or blanks of one kind counts as one sign.
        starts = np.ones(len(kinds), bool)
        starts[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] > 5)
        kinds = kinds[starts].astype(np.uint64) + np.uint64(1)
        code = np.zeros(len(kinds), np.uint64)
        for k in range(4):
            code = code[:len(kinds) - k] + kinds[k:] * MIX[k] if len(kinds) > k else code[:0]
            term = ((code ^ (code >> np.uint64(29))) * MIX[3 - k]) >> np.uint64(64 - 11)
            counts[:RUN_TERMS] += np.bincount(term.astype(np.int64), minlength=RUN_TERMS)
        words = part.split()
        if not words:
            continue
        word = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        last = np.concatenate([last, np.full(len(ids) - len(last), -1, np.int64)])
        order = np.argsort(word, kind="stable")
        ranked, place = word[order], order + before
        again = ranked[1:] == ranked[:-1]
        previous = np.empty(len(place), np.int64)
        previous[0] = last[ranked[0]]
        previous[1:] = np.where(again, place[:-1], last[ranked[1:]])
        gap = np.where(previous < 0, 0, np.frexp((place - previous).astype(float))[1])
        counts[RUN_TERMS:] += np.bincount(np.minimum(gap, GAP_TERMS - 1), minlength=GAP_TERMS)
        ends = np.append(~again, True)
        last[ranked[ends]] = place[ends]
        before += len(words)
    return counts


@dataclass
class Space:
    """Term weights, projection, and the unit vectors and labels of the labelled documents, all in whole units."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def place(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors of the rows of ``counts``; a text without terms is the zero vector."""
        z = weighted(counts, self.weights) @ self.axes
        length = np.sqrt((z * z).sum(axis=1, keepdims=True))
        return np.rint(np.divide(z, length, out=np.zeros_like(z), where=length > 0) * VECTOR_UNIT)

    def scores(self, counts: np.ndarray, most: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 among the ``most`` nearest labelled documents and all that are as near as the last of them.

        Weights are the cosines; neighbours at a cosine of zero or less have none, and without any the share of all labels counts.
        """
        cosine = np.maximum(self.place(counts) @ self.vectors.T, 0)
        most = min(most, len(self.labels))
        least = np.partition(cosine, -most, axis=1)[:, -most][:, None]
        cosine[cosine < least] = 0
        total = cosine.sum(axis=1)
        voted = cosine[:, self.labels > 0].sum(axis=1)
        return np.divide(voted, total, out=np.full(len(total), self.labels.mean()), where=total > 0)


def weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Damped and weighted counts of a document relative to its largest, in whole units."""
    x = np.log1p(counts) * weights
    top = x.max(axis=1, keepdims=True)
    return np.rint(np.divide(x, top, out=np.zeros_like(x), where=top > 0) * WEIGHT_UNIT)


def fit_space(counts: np.ndarray, labels: np.ndarray, frequency: np.ndarray, n_docs: int, size: int = SIZE) -> Space:
    """The leading right singular directions of the weighted counts, by subspace iteration from a fixed start."""
    weights = np.log((1 + n_docs) / (1 + frequency)) + 0.1
    x = weighted(counts, weights)
    axes = np.random.default_rng(20240817).standard_normal((x.shape[1], min(size, *x.shape)))
    for _ in range(12):
        axes = np.linalg.qr(x.T @ (x @ axes))[0]
    space = Space(weights, np.rint(axes * AXIS_UNIT), np.zeros((0, axes.shape[1])), labels)
    space.vectors = space.place(counts)
    return space


def counted_pairs(column: pa.Array) -> Iterator[np.ndarray]:
    for text in text_bytes(column):
        yield term_counts(text)


def document_frequency(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and how many documents there are: one small vector per task, added up."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for counts in counted_pairs(batch.column("text")):
                total[:-1] += counts > 0
                total[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(total)], ["term", "n"])

    sums = texts.select("text").mapInArrow(added, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    total = np.zeros(TERMS + 1, np.int64)
    for row in sums.collect():  # TERMS + 1 rows at most
        total[row.term] = row.n
    return total[:-1], int(total[-1])


def held_out(id_column: Column, folds: int = 5) -> Column:
    """Rows whose label is never learnt. Null for a null id."""
    return F.crc32(id_column.cast("string").cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_id: str = "doc_id",
          label_column: str = "quality", rows: int = LABELLED, folds: int = 5) -> Space | None:
    """The space of at most ``rows`` labelled documents that are not held out; None if there are fewer than 20 or only one label.

    A document with several labels counts with the lowest, several rows with its id with the text of the smallest digest.
    Null ids and labels are left out. Term weights come from all documents.
    """
    chosen = (labels.select(F.col(label_id).cast("long").alias("label_id"), F.col(label_column).cast("double").alias("label"))
              .where(F.col("label_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("label_id"), folds))
              .groupBy("label_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("label_id"), "label_id").limit(rows))
    texts = id_and_text(docs, id_column, text_column)
    found = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("label_id", "label", "text")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[bytes, float, bytes]] = {}
        for batch in batches:
            for key, label, text in zip(batch.column("label_id").to_pylist(), batch.column("label").to_pylist(), text_bytes(batch.column("text"))):
                digest = hashlib.blake2b(text, digest_size=16).digest()
                if key not in best or digest < best[key][0]:
                    best[key] = digest, label, term_counts(text).astype(np.int32).tobytes()
        columns = zip(*((k, *v) for k, v in best.items())) if best else [()] * 4
        kinds = pa.int64(), pa.binary(), pa.float64(), pa.binary()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["label_id", "digest", "label", "x"])

    firsts = found.mapInArrow(measured, "label_id long, digest binary, label double, x binary")
    one_each = firsts.groupBy("label_id").agg(F.min(F.struct("digest", "label", "x")).alias("one")).select("label_id", "one.label", "one.x")
    sample = sorted(one_each.collect(), key=lambda r: r.label_id)  # at most ``rows`` vectors of TERMS numbers
    y = np.array([r.label > 0.5 for r in sample], float)
    if len(y) < 20 or y.min() == y.max():
        return None
    counts = np.array([np.frombuffer(r.x, np.int32) for r in sample])
    return fit_space(counts, y, *document_frequency(texts))


def classify(docs: DataFrame, space: Space | None, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.3,
             folds: int = 5) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every document, read whole.

    Null and empty texts have no terms and get the share of label 1 among the labelled documents; a null id stays null, as does its
    ``held_out``; repeated rows each get their row; an empty table gives none. Without a model the score is 1. Only id and text are read.
    """
    model = docs.sparkSession.sparkContext.broadcast(space)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if model.value is None:
                    score = np.ones(part.num_rows)
                else:
                    score = model.value.scores(np.stack(list(counted_pairs(part.column("text")))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                                 ["doc_id", "held_out", "score", "predicted"])

    texts = id_and_text(docs, id_column, text_column).withColumn("held_out", held_out(F.col("doc_id"), folds))
    return texts.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")
