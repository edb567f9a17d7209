"""SimHash near-duplicates, with candidates pruned by the pigeonring principle.

A fingerprint has 64 bits in ``SEGMENTS`` segments on a ring. If two fingerprints differ in at most t bits, then from some
segment on every chain of l consecutive segments differs in at most l*t/SEGMENTS bits (the ring form of the pigeonhole
principle). Chains whose budget is 0 must be equal, and in the chains whose budget is 1 all segments but one must be
equal; these equalities are the join keys. Candidates with a common key must stay within the budgets of all chains
before the whole distance is counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import BLANKS, id_and_text, numbered_rows, stored, text_bytes
from tabloom.llm.components import components

SEGMENTS = 8
SEED = 42
#: Fingerprints of one key that a task compares at once; larger groups are split into pairs of blocks.
BLOCK = 2048
#: Groups up to this size give all their links, larger ones a tree that spans each linked set.
SMALL = 16
#: Bytes of a text whose shingles are hashed at once.
STRETCH = 1 << 20
BLANK = re.compile(b"[" + BLANKS + b"]")


def stretches(text: bytes) -> Iterator[bytes]:
    """A text in parts of about ``STRETCH`` bytes that end before a blank, so no word is cut."""
    at = 0
    while at < len(text):
        blank = BLANK.search(text, at + STRETCH)
        end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end


def fingerprint(text: bytes, shingle: int) -> int:
    """Bits set in more than half of the shingle hashes; 0 for a text without words. Only the words and hashes of a stretch are held."""
    digest = xxhash.xxh64_digest
    words, n, ones = [], 0, np.zeros(64, np.int64)
    for stretch in stretches(text):
        words += stretch.lower().split()
        hashes = b"".join([digest(b" ".join(w), SEED) for w in zip(*(words[k:] for k in range(shingle)))])
        if not hashes:
            continue
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        for start in range(0, len(bits), 255):  # sums of 255 bits fit into a byte
            ones += np.add.reduce(bits[start:start + 255], axis=0, dtype=np.uint8)
        n += len(bits)
        words = words[len(words) - shingle + 1:]
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs(text, ...)`` and ``fp``, the fingerprint as a signed 64-bit number."""
    schema = docs.select(*keep).schema.add("fp", "long")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp)], [*keep, "fp"])

    return docs.mapInArrow(made, schema)


def chain_budgets(distance: int, segments: int = SEGMENTS) -> list[int]:
    """Bits in which a chain of 1, 2, ... segments may differ."""
    return [length * distance // segments for length in range(1, segments + 1)]


def chain_masks(segments: int = SEGMENTS) -> np.ndarray:
    """``[start, length - 1]``: the bits of the chain of that length; segment 0 holds the lowest bits."""
    width = 64 // segments
    one = [((1 << width) - 1) << (width * k) for k in range(segments)]
    return np.array([[sum(one[(i + k) % segments] for k in range(length)) for length in range(1, segments + 1)] for i in range(segments)], np.uint64)


def key_masks(distance: int, segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """``(start, mask)`` of each join key: the bits that must be equal for the chains from ``start`` to keep their budgets."""
    if not 0 <= distance < segments or 64 % segments:
        raise ValueError("the distance must be smaller than the number of segments, which divides 64")
    budgets, masks, width = chain_budgets(distance, segments), chain_masks(segments), 64 // segments
    still = sum(b == 0 for b in budgets)
    once = sum(b <= 1 for b in budgets)
    keys = []
    for i in range(segments):
        whole = int(masks[i, once - 1])
        spare = [((1 << width) - 1) << (width * ((i + k) % segments)) for k in range(still, once)]
        keys += [(i, whole & ~s) for s in spare] or [(i, whole)]
    return keys if distance else keys[:1]


def as_signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def within(a: np.ndarray, b: np.ndarray, start: np.ndarray, distance: int, segments: int = SEGMENTS) -> np.ndarray:
    """Which pairs keep the budget of every chain from ``start`` on and then the whole distance."""
    differ = a ^ b
    masks, good = chain_masks(segments), np.ones(len(differ), bool)
    for length, budget in enumerate(chain_budgets(distance, segments)[:-1]):
        good &= np.bitwise_count(differ & masks[start, length]) <= budget
    good[good] = np.bitwise_count(differ[good]) <= distance
    return good


def spanning(fps: np.ndarray, start: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join each set of linked fingerprints to its first member; every fingerprint is expanded once."""
    left, right = [], []
    todo = np.arange(len(fps))
    while len(todo):
        root, todo = todo[0], todo[1:]
        front = [root]
        while front and len(todo):
            node = front.pop()
            near = within(np.broadcast_to(fps[node], len(todo)), fps[todo], np.full(len(todo), start), distance)
            found = todo[near]
            if len(found):
                left.append(np.full(len(found), fps[root]))
                right.append(fps[found])
                front.extend(found.tolist())
                todo = todo[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def links_of_sorted(unit: np.ndarray, start: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among neighbours in sorted rows with an equal ``unit``."""
    edges = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(unit) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[edges, len(unit)])
    size_of = np.repeat(sizes, sizes)
    left, right = [], []
    for step in range(1, SMALL):
        if step >= len(unit):
            break
        pair = np.flatnonzero((unit[step:] == unit[:-step]) & (size_of[step:] <= SMALL))
        good = pair[within(fps[pair], fps[pair + step], start[pair], distance)]
        left.append(fps[good])
        right.append(fps[good + step])
    for at, size in zip(edges[sizes > SMALL], sizes[sizes > SMALL]):
        a, b = spanning(fps[at:at + size], int(start[at]), distance)
        left.append(a)
        right.append(b)
    none = np.zeros(0, np.uint64)
    return np.concatenate(left) if left else none, np.concatenate(right) if right else none


def links(distinct: DataFrame, distance: int) -> DataFrame:
    """``(a, b)`` between distinct fingerprints ``fp``, at least enough to span each linked set.

    Keys that two or more fingerprints share are found by an aggregate; only those rows are dealt out. A key shared by
    more than ``BLOCK`` fingerprints is split into pairs of blocks, so a task holds two blocks at most and the pairs of
    a large group are compared in many tasks, without ever being written out.
    """
    keys = key_masks(distance)
    keyed = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(as_signed(m))) for _, m in keys))).alias("k", "v"))
    shared = keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    rows = keyed.join(shared, ["k", "v"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    rows = rows.select("fp", "k", "v", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = rows.select("k", "v", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    starts = np.array([i for i, _ in keys])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in _with_end(batches):
            part = pa.Table.from_batches([batch]) if batch is not None else None
            rows_now = part if kept is None else kept if part is None else pa.concat_tables([kept, part])
            if rows_now is None:
                return
            k, v, lo, hi = (rows_now.column(c).to_numpy() for c in ("k", "v", "lo", "hi"))
            new = np.r_[True, (k[1:] != k[:-1]) | (v[1:] != v[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
            end = len(new) if part is None else int(np.flatnonzero(new)[-1])
            kept = rows_now.slice(end) if part is not None else None
            a, b = links_of_sorted(np.cumsum(new[:end]), starts[k[:end]], rows_now.column("fp").to_numpy()[:end].astype(np.int64).view(np.uint64), distance)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    dealt = rows.repartition("k", "v", "lo", "hi").sortWithinPartitions("k", "v", "lo", "hi", "fp")
    return dealt.mapInArrow(linked, "a long, b long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches that have rows, then None."""
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(rows: DataFrame, shingle: int, distance: int) -> DataFrame:
    """``(row, doc_id, fp, root, component_id)`` for each row of ``rows(row, doc_id, text)``, which must be a stored table.

    ``component_id`` is the smallest document id among all rows that can be reached over links of at most ``distance`` bits.
    Null and empty texts have fingerprint 0 and link like any other; rows with an equal fingerprint, repeated rows included,
    are one node; null ids are never the smallest, and a component without any id has null. No rows give no rows.
    """
    marked = stored(fingerprints(rows, shingle, "row", "doc_id"), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(distinct, distance))
    least = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = stored(least, "roots")
    ids = least.groupBy("root").agg(F.min("first").alias("component_id"))
    final = least.select("fp", "root").join(ids, "root").select("fp", "root", "component_id")
    return marked.join(final, "fp").select("row", "doc_id", "fp", "root", "component_id")


def simhash(docs: DataFrame, shingle: int = 3, distance: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each document; see ``near_duplicates``."""
    source = id_and_text(docs, id_column, text_column).withColumn("row", F.lit(0).cast("long"))
    return near_duplicates(source, shingle, distance).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, with one document of each component: that with the smallest id.

    If several rows have this id, or none has any, the first of them as stored stays.
    """
    names = docs.columns
    packed = numbered_rows(docs, "documents", F.struct(*(F.col(f"`{c}`") for c in names)).alias("own"))
    rows = packed.select("row", F.col("own").getField(id_column).cast("long").alias("doc_id"), F.col("own").getField(text_column).cast("string").alias("text"))
    found = near_duplicates(rows, shingle, distance)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("row").alias("row"))
    return packed.join(stay.select("row"), "row", "left_semi").select(*(F.col("own").getField(c).alias(c) for c in names))
