"""Sampled splitters: records are dealt to shards of nearly equal bytes by ranges of a key.

The key is (hash of the text, id, row number): equal texts stand next to each other, yet a group of copies of any size can
be cut. Key samples are drawn with probabilities in proportion to size, their quantiles bound many more ranges than there
are shards, and the ranges are measured exactly. Ranges go to shards in key order; a range that overfills its shard is
subdivided where the running sum of bytes reaches the shard's end. Only ids, sizes and hashes are shuffled, and a
task holds one range, which is a small part of a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import id_and_text, numbered_rows, stored

#: Ranges for each shard, and key samples for each range. Together they bound what reaches the driver: 16 shards take 8,192 samples.
RANGES = 32
SAMPLES = 16


def splitters(rows: DataFrame, key: list[str], size: str, count: int) -> list[tuple]:
    """At most ``count`` boundaries of the ranges, in key order, from a size-weighted sample without replacement.

    A row's draw is the logarithm of a uniform number over its size; the largest draws form the sample, so every task keeps
    only that many rows.
    """
    uniform = (F.pmod(F.xxhash64(*key, F.lit(77)), F.lit(1 << 53)) + F.lit(0.5)) / F.lit(float(1 << 53))
    # Nulls stay nulls in a sample; they are less than any other value, as in Spark's order.
    sample = rows.select(*key, (F.log(uniform) / F.col(size)).alias("draw")).orderBy(F.desc("draw"), *key).limit(count * SAMPLES)
    numbered = sample.withColumn("n", F.row_number().over(Window.orderBy(*key)))
    return [tuple(r[:len(key)]) for r in numbered.where(F.col("n") % SAMPLES == 0).orderBy("n").select(*key).collect()]


def range_of(key: Column, bounds: Column, n: int) -> Column:
    """How many of the ``n`` sorted bounds are not above the key, by binary search in the bounds."""
    steps, step = [], 1
    while step <= n:
        steps.insert(0, step)
        step *= 2
    if not steps:
        return F.lit(0)
    walk = F.array(*(F.lit(s) for s in steps))
    return F.aggregate(walk, F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(bounds, at + s - 1) <= key), at + s).otherwise(at))


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` per document.

    ``size`` is the UTF-8 length of the text plus 1. The law is ``bytes``: the shards are stretches of the key order, and a record
    belongs to the shard in which the middle of its bytes falls, so a shard is off the mean by at most one record's size.
    Slots number the records of a shard in key order without gaps. The result depends on the records alone, not on the
    sample. Null texts count as empty, null ids come first among equal texts, repeated rows are each dealt, and an empty table
    gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = numbered_rows(id_and_text(docs, id_column, text_column), "shard-keys", "doc_id", F.xxhash64(text).alias("h"),
                         (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = ["h", "doc_id", "row"]
    bounds = splitters(rows, key, "size", shards * RANGES - 1)
    listed = F.array(*(F.struct(*(F.lit(v).cast("long").alias(k) for k, v in zip(key, b))) for b in bounds))
    ranged = stored(rows.withColumn("part", range_of(F.struct(*key), listed, len(bounds))), "shard-ranges")
    # The ranges are a bounded table: their sizes are summed up in key order.
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    whole = Window.partitionBy()
    starts = sums.select("part", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("rows_before"),
                         F.sum("bytes").over(whole).alias("total"))
    inside = Window.partitionBy("part").orderBy(*key)
    placed = (ranged.select("part", "size", "text_crc32", *key, F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
                            F.row_number().over(inside).alias("nth"))
              .join(F.broadcast(starts), "part"))
    # Twice the middle of the record over twice the total, in whole numbers beyond 64 bits.
    wide = lambda c: c.cast("decimal(38,0)")
    middle = 2 * wide(F.col("bytes_before") + F.col("upto")) - wide(F.col("size"))
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * wide(F.col("total")))).cast("int"))
    placed = placed.select("doc_id", "size", "text_crc32", "part", shard.alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("place"))
    placed = stored(placed, "shard-places")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                                                           (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
