"""Document fingerprints: one-permutation MinHash with optimal densification, in columns only.

The hashes of a text's word shingles fall into ``BINS`` bins by their top byte, and every bin keeps its smallest hash. An
empty bin copies a non-empty one: it tries bins given by 2-universal hashes of its own number and the attempt, and after
``ATTEMPTS`` misses takes the non-empty bin that comes first in its own pseudo-random order, so that it always is filled.
A fingerprint stores the low byte of each bin. Two bytes agree by chance in one of 256 cases; the likeness corrects for it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import id_and_text
from tabloom.llm.sharding import range_of

BINS = 256
ATTEMPTS = 6
SHINGLE = 5
PRIME = (1 << 31) - 1
LOW = (1 << 56) - 1
BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

_draws = np.random.default_rng(53).integers(1, PRIME, (2 + 2 * ATTEMPTS, BINS))
#: For each attempt, the bin that each empty bin tries: (a * bin + b) mod PRIME mod BINS with its own a and b.
TRIES = [((_draws[2 + 2 * t] * np.arange(BINS) + _draws[3 + 2 * t]) % PRIME % BINS).tolist() for t in range(ATTEMPTS)]
#: Factors and shifts of the orders in which a bin takes any non-empty bin.
ORDERS = _draws[:2].tolist()

#: Documents for each range of the id order, and ranges at most.
RANGE_ROWS, MOST_RANGES = 2048, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and wherever ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def numbers(values: list[int], kind: str) -> Column:
    return F.array(*(F.lit(v).cast(kind) for v in values))


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """Hashes of the shingles of ``width`` words; of the whole sequence if it is shorter; none without words."""
    words = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)), BLANK)
    hashed = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))
    return let(hashed, lambda h: F.when(F.size(h) == 0, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(h) - (width - 1))), lambda i: F.xxhash64(F.slice(h, i, width)))))


def bins(hashes: Column) -> Column:
    """The smallest hash of every bin, densified; null for no hashes."""
    marks = numbers([((b << 56) | LOW) for b in range(-BINS // 2, BINS // 2)], "long")
    empty = lambda x: x.bitwiseAND(F.lit(LOW)) == F.lit(LOW)
    number = lambda x: F.shiftright(x, 56) + BINS // 2
    ranked = F.sort_array(F.concat(hashes, marks))
    least = let(ranked, lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(s, i - 1), 56))))

    def filled(m: Column, full: Column) -> Column:
        a, b = (numbers(v, "long") for v in ORDERS)

        def of(x: Column, j: Column) -> Column:
            tried = [F.get(m, F.get(numbers(t, "int"), j)) for t in TRIES]
            found = F.coalesce(*(F.when(~empty(t), t) for t in tried))
            order = F.array_min(F.transform(full, lambda y: F.shiftleft((F.get(a, j) * number(y) + F.get(b, j)) % PRIME, 8).bitwiseOR(number(y))))
            return F.when(~empty(x), x).otherwise(F.coalesce(found, F.get(m, order.bitwiseAND(F.lit(255)).cast("int"))))

        return F.transform(m, of)

    dense = let(least, lambda m: let(F.filter(m, lambda x: ~empty(x)), lambda full: F.when(F.size(full) > 0, filled(m, full))))
    return F.when(F.size(hashes) > 0, dense)


def packed(text: Column, width: int = SHINGLE) -> Column:
    """The fingerprint of a text as 256 bytes (an array, signed); null for a text without words."""
    return let(shingle_hashes(text, width), lambda h: F.transform(bins(h), lambda x: (x.bitwiseAND(F.lit(255)) - 128).cast("byte")))


def as_text(fp: Column) -> Column:
    """The packed bytes as hex; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x.cast("long") + 128), 2, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets: the share of equal bytes, without those equal by chance, from 0 to 1."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    true = F.greatest(F.lit(0.0), (equal - 1 / 256) / (1 - 1 / 256))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(true)


def with_next(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, fp)`` with ``next_text`` and ``next_fp`` of the next document by descending id; after the last comes the first.

    Null ids come last, rows with equal ids in the order of their texts. The id order is cut into ranges by quantiles; each range is
    sorted by itself, with a copy of the rows that begin the following range behind its own.
    """
    n = docs.count()
    if not n:
        return docs.select("*", F.lit(None).cast("string").alias("next_text"), F.lit(None).cast("array<tinyint>").alias("next_fp"))
    ranges = min(MOST_RANGES, -(-n // RANGE_ROWS))
    cuts = [k / ranges for k in range(1, ranges)]
    found = docs.agg(F.percentile_approx("doc_id", cuts, 20 * ranges)).first()[0] if cuts else []
    bounds = sorted(set(found or []))
    part = (F.when(F.col("doc_id").isNull(), -1).otherwise(range_of(F.col("doc_id"), numbers(bounds, "long"), len(bounds))) if bounds
            else F.when(F.col("doc_id").isNull(), -1).otherwise(0))
    ranged = docs.withColumn("part", part)
    heads = dict(ranged.select("part", "doc_id").groupBy("part").agg(F.max("doc_id")).collect())  # a row for each range
    order = sorted(heads, reverse=True)
    before = dict(zip(order, order[-1:] + order[:-1]))
    table = docs.sparkSession.createDataFrame([(p, heads[p], before[p]) for p in order], "part int, head long, before int")
    at_home = F.struct(F.col("part"), F.lit(0).alias("guest"))
    copies = F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(at_home, F.struct(F.col("before").alias("part"), F.lit(1).alias("guest")))).otherwise(F.array(at_home))
    ranged = ranged.join(F.broadcast(table), "part")
    spread = ranged.select("doc_id", "text", "fp", F.explode(copies).alias("at")).select("doc_id", "text", "fp", "at.part", "at.guest")
    line = Window.partitionBy("part").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    led = spread.select("*", F.lead("text").over(line).alias("next_text"), F.lead("fp").over(line).alias("next_fp"))
    return led.where("guest = 0").drop("part", "guest")


def fingerprint(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = SHINGLE) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` per document.

    The edited text has the last half of its characters replaced by as many of the next document (or all of it). Null and
    empty texts have no shingles: their fingerprint is the empty string, and they are alike (1) to each other and unlike (0) all else.
    Repeated rows each get their row; the next document of the only one is itself; an empty table gives no rows. Other columns are not read.
    """
    texts = id_and_text(docs, id_column, text_column).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    led = with_next(texts.withColumn("fp", packed(F.col("text"), width)))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    made = led.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    made = made.select("doc_id", "n_chars", "fp", "next_fp", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), packed(F.col("edited"), width).alias("edited_fp"))
    return made.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
                       likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
