"""Ranked lexical search: one scan of all documents by an automaton of the terms of all items.

Every term of an item stands in an Aho-Corasick automaton between two guard bytes. A text becomes lower-case terms with one guard
between them, so that a guarded term is found exactly where it is a whole term, and the automaton counts occurrences without
an index of the documents. Its outputs are term numbers, and a table of the items of each term spreads a term's share of
the score. The automaton, the weights and that table are broadcast; their size is bounded by taking the items in blocks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import id_and_text, stored, text_bytes

#: UTF-8 bytes of item texts that one block of items holds, on average. It bounds the automaton and what a task keeps.
ITEM_BYTES = 4 << 20
#: Scores in a block of documents that are added up at a time.
BLOCK_SCORES = 1 << 21
#: Partial rankings of an item that are merged apart before the last merge.
SALTS = 32

GUARD = b"\n"


def _letters() -> bytes:
    """Letters A to Z in lower case; every other ASCII sign that is no letter or digit becomes the guard."""
    return bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else GUARD[0] for c in range(256))


LETTERS = _letters()


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def guarded(terms: list[bytes]) -> str:
    """Terms with a guard on each side, one character a byte: neighbours share the guard between them."""
    return (GUARD + GUARD.join(terms) + GUARD).decode("latin-1")


@dataclass
class Items:
    """Items, their terms, and the items of each term: those of term t are ``item[start[t]:start[t + 1]]``."""

    ids: list[int | None]
    automaton: ahocorasick.Automaton
    n_terms: int
    start: np.ndarray
    item: np.ndarray

    def counts(self, text: bytes) -> tuple[int, Counter]:
        """The number of terms of a text, and how often it holds each term of an item."""
        terms = terms_of(text)
        if not terms or not self.n_terms:
            return len(terms), Counter()
        return len(terms), Counter(map(itemgetter(1), self.automaton.iter(guarded(terms))))


def compile_items(rows: list) -> Items:
    """Rows of one ``item_id`` are one item with the terms of all of them."""
    terms: dict[bytes, int] = {}
    of_item: dict[int | None, set[int]] = {}
    for item_id, text in rows:
        of_item.setdefault(item_id, set()).update(terms.setdefault(t, len(terms)) for t in terms_of((text or "").encode()))
    automaton = ahocorasick.Automaton()
    for term, number in terms.items():
        automaton.add_word(guarded([term]), number)
    if terms:
        automaton.make_automaton()
    pairs = sorted((t, k) for k, held in enumerate(of_item.values()) for t in held)
    start = np.searchsorted([t for t, _ in pairs], np.arange(len(terms) + 1))
    return Items(list(of_item), automaton, len(terms), start, np.array([k for _, k in pairs], np.int64))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges ``start .. start + length - 1``, one range after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) + np.repeat(starts - before, lengths)


def best(scores: np.ndarray, ids: np.ndarray, valid: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest positive scores; equal ones by ascending id, null ids last."""
    at = np.flatnonzero(scores > 0)
    if len(at) > most:
        least = np.partition(scores[at], len(at) - most)[len(at) - most]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], ~valid[at], -scores[at]))[:most]]


class Ranking:
    """The best documents so far of every item, as a task sees them."""

    def __init__(self, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, most: int):
        self.items, self.weights, self.n_docs, self.n_terms, self.most = items, weights, n_docs, n_terms, most
        empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.kept = [empty] * len(items.ids)

    def add(self, ids: np.ndarray, valid: np.ndarray, n: np.ndarray, lengths: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Documents ``ids`` of ``n`` terms, each with ``lengths`` counted terms of items."""
        items = self.items
        m = 100 - 50 + (50 * n * self.n_docs) // max(self.n_terms, 1)
        share = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, lengths)))
        uses = items.start[term + 1] - items.start[term]
        doc = np.repeat(np.repeat(np.arange(len(ids)), lengths), uses)
        scores = np.zeros((len(items.ids), len(ids)), np.int64)
        np.add.at(scores, (items.item[spread(items.start[term], uses)], doc), np.repeat(share, uses))
        for k in np.flatnonzero(scores.any(axis=1)):
            old = self.kept[k]
            found = best(scores[k], ids, valid, self.most)
            joined = [np.concatenate(pair) for pair in zip(old, (scores[k][found], ids[found], valid[found]))]
            order = best(*joined, self.most)
            self.kept[k] = tuple(x[order] for x in joined)

    def rows(self) -> pa.RecordBatch:
        item = np.repeat(np.arange(len(self.kept)), [len(x[0]) for x in self.kept])
        score, ids, valid = (np.concatenate([x[j] for x in self.kept]) if self.kept else np.zeros(0, t) for j, t in enumerate((np.int64, np.int64, bool)))
        return pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=~valid), pa.array(score)], ["item", "doc_id", "score"])


def search_block(docs: DataFrame, rows: list, most: int) -> DataFrame:
    """The ranking of ``docs(doc_id, text)`` for the items of one block."""
    spark = docs.sparkSession
    items = spark.sparkContext.broadcast(compile_items(rows))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [items.value.counts(t) for t in text_bytes(batch.column("text"))]
            pairs = [sorted(c.items()) for _, c in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([[t for t, _ in p] for p in pairs], pa.list_(pa.int32())),
                 pa.array([[k for _, k in p] for p in pairs], pa.list_(pa.int32()))], ["doc_id", "n", "term", "tf"])

    held = stored(docs.mapInArrow(counted, "doc_id long, n long, term array<int>, tf array<int>"), "term-counts")
    totals = held.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    frequency = np.zeros(items.value.n_terms, np.int64)
    for row in held.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # one row a term of the block at most
        frequency[row[0]] = row[1]
    weights = np.array([math.floor(1000 * math.log((2 * totals.docs + 2) / (2 * int(df) + 1))) for df in frequency], np.int64)
    shared = spark.sparkContext.broadcast(weights)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking = Ranking(items.value, shared.value, totals.docs, totals.terms, most)
        step = max(1, BLOCK_SCORES // max(1, len(items.value.ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, term, tf = part.column("doc_id"), part.column("term"), part.column("tf")
                ranking.add(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), part.column("n").to_numpy(),
                            term.value_lengths().to_numpy().astype(np.int64), term.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64))
        yield ranking.rows()

    found = held.where(F.size("term") > 0).mapInArrow(ranked, "item long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    first = salted.withColumn("place", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("place") <= most)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= most)
    names = spark.createDataFrame(list(enumerate(items.value.ids)), "item long, item_id long")  # the items of the block
    return last.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, most: int = 50, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id",
           item_text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each item the ``most`` documents with the highest scores above 0, all documents being scored.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII; A to Z count as small letters. Equal scores
    rank by ascending id, null ids last; repeated rows are documents of their own. Null and empty documents have no terms and do
    not count among the documents; null, empty and unmatched items give no rows, and rows of one ``item_id`` are one item.
    Empty tables give no rows. Items are taken in blocks of about ``item_bytes`` bytes; other columns are not read.
    """
    texts = id_and_text(docs, id_column, text_column)
    asked = queries.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where(F.length("text") > 0)
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / item_bytes))
    result = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # a block of items
        found = search_block(texts, rows, most)
        result = found if result is None else result.unionAll(found)
    return result
