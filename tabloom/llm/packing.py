"""Mixture-controlled packing: every window is filled from the sources in the target token proportions.

Deficit round-robin: queues are visited in turn, round after round. At each visit a queue earns its share of a quantum of tokens; once it has
earned a whole one, its next ``quantum`` tokens (at its end the rest) are served and paid for, and what it has left, its
deficit, goes into the next round. Rounds run on over the ends of windows, so deficits pass from window to window, and a
queue stays within two quanta of its share (held by tests for 5 and 500 queues). Queues of one weight begin with deficits spread evenly over a quantum, so they
are not all served in the same round. A queue that runs dry leaves its share to the others.

What a queue has been served after a round follows from its weight, its first deficit and its length. So every task can compute where a
quantum of tokens stands without playing the rounds before it, and deficits carry over the borders of partitions too.

Every source has a queue. Tasks know them by their weights and lengths only: queues of one weight have earned one of two
amounts after a round, so counts of queues by weight and length give all sums. Weights add up to ``SCALE``, but for those that are raised to
one, so different weights are a few hundred at most, and different lengths are few (they add up to the tokens).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.small import small_frame
from tabloom.llm.common import id_and_text, stored, texts_of
from tabloom.llm.tokens import byte_pairs

#: Weights are rounded to parts of this; products with numbers of quanta up to 2^45 stay within 64 bits.
SCALE = 1 << 16


class Queues:
    """Deficit round-robin over queues that are numbered by ascending weight and then descending length, from how many queues have each
    weight and length.

    In a round a queue of weight w earns w parts of a quantum, of which ``SCALE`` are a whole one.
    """

    def __init__(self, weights: list[int], lengths: list[int], counts: list[int], quantum: int):
        order = np.lexsort((-np.array(lengths, np.int64), np.array(weights, np.int64)))
        weight, length, count = (np.array(x, np.int64)[order] for x in (weights, lengths, counts))
        opens = np.flatnonzero(np.r_[True, weight[1:] != weight[:-1]]) if len(weight) else np.zeros(0, np.int64)
        self.quantum, self.weight, self.groups = quantum, weight[opens], []
        for a, b in zip(opens, np.r_[opens[1:], len(weight)].astype(np.int64)):
            n, size = count[a:b], length[a:b]
            quanta = -(-int(size[0]) // quantum)
            self.groups.append((int(weight[a]), -(-quanta * SCALE // int(weight[a])), -size, np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * size)]))
        self.base = np.cumsum([0, *(int(g[3][-1]) for g in self.groups)])
        self.all = int(self.base[-1])

    def upto(self, turn: np.ndarray, queue: np.ndarray | int) -> np.ndarray:
        """Tokens that the queues before ``queue`` are served in the rounds up to ``turn``."""
        out = np.zeros(len(turn), np.int64)
        for base, (weight, last, minus, n, tokens) in zip(self.base, self.groups):
            earned = np.minimum(turn, last) * weight
            whole, part = earned // SCALE, earned % SCALE
            members = int(n[-1])
            first = np.clip(queue - base, 0, members)
            # First deficits grow with the number, so the queues from here on have one quantum more.
            ahead = np.minimum(first, np.maximum(0, -((SCALE - 2 * members * (SCALE - part)) // (2 * SCALE))))

            def served(upper: np.ndarray, quanta: np.ndarray) -> np.ndarray:
                each = np.minimum(-minus[0], quanta * self.quantum)
                cut = np.minimum(upper, n[np.searchsorted(minus, -each, side="left")])
                total = cut * each
                for end, sign in ((upper, 1), (cut, -1)):  # what is left are whole queues
                    k = np.minimum(np.searchsorted(n, end, side="right") - 1, len(minus) - 1)
                    total += sign * (tokens[k] - (end - n[k]) * minus[k])
                return total

            out += served(ahead, whole) + served(first, whole + 1) - served(ahead, whole + 1)
        return out

    def place(self, queue: np.ndarray, number: np.ndarray) -> np.ndarray:
        """How many tokens are served before the quantum of that number of a queue."""
        group = np.searchsorted(self.base, queue, side="right") - 1
        deficit = (2 * (queue - self.base[group]) + 1) * SCALE // (2 * np.diff(self.base)[group])
        turn = -((deficit - (number + 1) * SCALE) // self.weight[group])
        return self.upto(turn - 1, self.all) + self.upto(turn, queue) + number * self.quantum - self.upto(turn - 1, queue + 1)

    def pieces(self, queue: np.ndarray, begin: np.ndarray, length: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
        """Cuts stretches of queues where quanta and windows end: index of the stretch, start in it, length, window, and place in the window."""
        if not len(queue):
            return (np.zeros(0, np.int64),) * 5
        index, number = spread(begin // self.quantum, (begin + length - 1) // self.quantum)
        different, which = np.unique(np.stack([queue[index], number]), axis=1, return_inverse=True)
        start = np.maximum(begin[index], number * self.quantum)
        end = np.minimum((begin + length)[index], (number + 1) * self.quantum)
        at = self.place(*different)[which.ravel()] + start - number * self.quantum
        start -= begin[index]
        end -= begin[index]
        # Quanta that follow each other in the output as well are one piece.
        opens = np.r_[True, (index[1:] != index[:-1]) | (at[1:] != at[:-1] + (end - start)[:-1])]
        index, start, at, end = index[opens], start[opens], at[opens], end[np.r_[opens[1:], True]]
        row, sequence = spread(at // window, (at + end - start - 1) // window)
        low = np.maximum(at[row], sequence * window)
        high = np.minimum((at + end - start)[row], (sequence + 1) * window)
        return index[row], start[row] + low - at[row], high - low, sequence, low - sequence * window


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the numbers from ``first`` to ``last``: row and number."""
    times = last - first + 1
    row = np.repeat(np.arange(len(first)), times)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)


def numbered_queues(sums: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """A stored table ``(source, length, weight, queue)`` from token counts ``(source, n)``, numbered as ``Queues`` wants it.

    Ranges of queues are numbered alone and shifted by the sizes of those before.
    """
    lengths = sums.groupBy("source").agg(F.sum("n").alias("length"))
    if weights is None:
        shares = lengths.withColumn("share", F.col("length").cast("double"))
    else:
        named = small_frame(sums.sparkSession, [(k, float(v)) for k, v in weights.items()], "source string, share double")
        shares = lengths.join(F.broadcast(named), "source", "left").fillna(0.0, ["share"])
    shares = stored(shares, "queue-lengths")
    total = max(shares.agg(F.sum("share")).first()[0] or 0.0, 1e-300)
    weighted = shares.select("source", "length", F.greatest(F.lit(1), F.rint(F.col("share") / F.lit(total) * F.lit(SCALE))).cast("long").alias("weight"))
    order = ["weight", F.desc("length"), "source"]
    ranged = stored(weighted.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "queue-ranges")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    bases = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return stored(ranged.withColumn("inside", inside).join(F.broadcast(bases), "part").select("source", "length", "weight", (F.col("base") + F.col("inside")).alias("queue")), "queues")


def pack(docs: DataFrame, window: int = 2048, tokenizer: str = "byte_bpe_50k", end_id: int = 1, weights: dict[str, float] | None = None, quantum: int = 256,
         id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids`` on request).

    A document is its token ids and then ``end_id``; a null or empty text is the end id alone. Null ids stay null, repeated rows are
    packed each, a null source is a source like any other, and no rows give no pieces. ``weights`` are target shares by
    source (null: ''); sources that are not named get 0 and so come last. By default the targets are the shares of the corpus.
    ``quantum`` tokens are served at once: fewer follow the targets more closely and cut documents more often.
    All sequences but the last are full. Other columns are not read.
    """
    spark = docs.sparkSession
    source = F.coalesce(F.col(source_column).cast("string"), F.lit(""))
    texts = id_and_text(docs, id_column, text_column, source.alias("source"))

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, before = TaskContext.get().partitionId(), {}
        encode = byte_pairs(tokenizer)
        narrow = np.uint16 if encode.size <= 1 << 16 and end_id < 1 << 16 else np.uint32
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [np.array([*encode.ids(t), end_id], narrow) for t in texts_of(part.column("text"))]
                n = np.array([len(x) for x in ids], np.int64)
                begin = []
                for name, size in zip(part.column("source").to_pylist(), n.tolist()):
                    begin.append(before.get(name, 0))
                    before[name] = begin[-1] + size
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.full(len(n), block, np.int64)), part.column("source"), pa.array(n),
                                                  pa.array(begin, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                                                 ["doc_id", "block", "source", "n", "begin", "ids"])

    kept = stored(texts.mapInArrow(tokenized, "doc_id long, block long, source string, n long, begin long, ids binary"), "tokens")
    # Block totals are one row per task and source; their running sums place every block in its queues.
    sums = stored(kept.groupBy("block", "source").agg(F.sum("n").alias("n")), "queue-blocks")
    queues = numbered_queues(sums, weights)
    ahead = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("block", "source", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")).join(queues.select("source", "queue"), "source")
    alike = queues.groupBy("weight", "length").agg(F.count("*").alias("n")).collect()
    schedule = spark.sparkContext.broadcast(Queues([r.weight for r in alike], [r.length for r in alike], [r.n for r in alike], quantum))
    narrow = 2 if byte_pairs(tokenizer).size <= 1 << 16 and end_id < 1 << 16 else 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                queue, n, begin, base = (part.column(c).to_numpy() for c in ("queue", "n", "begin", "base"))
                index, start, length, sequence, offset = schedule.value.pieces(queue, base + begin, n, window)
                ids = [np.frombuffer(x.as_py(), np.dtype(f"<u{narrow}")).astype("<u4").tobytes() for x in part.column("ids")]
                own = [ids[i][4 * s:4 * (s + m)] for i, s, m in zip(index.tolist(), start.tolist(), length.tolist())]
                columns = {"doc_id": part.column("doc_id").take(pa.array(index)), "start": pa.array(start), "length": pa.array(length),
                           "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64()), "doc_tokens": pa.array(n[index]),
                           "sequence_id": pa.array(sequence), "offset": pa.array(offset), "queue": pa.array(queue[index])}
                if with_ids:
                    columns["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in own], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    placed = kept.join(stored(bases, "queue-bases"), ["block", "source"]).select("doc_id", "queue", "n", "begin", "base", "ids")
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue long"
    return placed.mapInArrow(cut, kinds + (", ids array<long>" if with_ids else ""))
