"""Text columns: detection, synonym augmentation, quality score, and rows anchored to real examples."""

from __future__ import annotations

import hashlib
import math
import sys
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import draws
from tabloom.functions.kinds import INTEGER, STRING, kinds
from tabloom.functions.quantiles import value_at_rank
from tabloom.functions.small import small_frame
from tabloom.operators.frequencies import class_counts
from tabloom.operators.indexing import dense_index, with_row_key
from tabloom.operators.keyed_copula import CHUNK, with_starts
from tabloom.session import materialize, working_copy

# Limits of text detection and strengths of augmentation.
SENTENCE_WORDS, CODE_SHARE, CODE_CHARS = 3.0, 0.95, 12
PHRASE_WORDS, PHRASE_SHARE, PHRASE_CHARS = 1.5, 0.30, 6
STRENGTH = {"low": 0.1, "medium": 0.2, "high": 0.3}
LENGTH_WEIGHT, DIVERSITY_WEIGHT, DIVERSITY_SCALE = 0.6, 0.4, 500.0

SALTS = 16
DRAWS_PER_ROW = 10_000
#: A lexicon of so many bytes or less is broadcast; an entry and each synonym count so many beside their text.
TABLE_BYTES = 32 << 20
ENTRY_BYTES = 100
#: Bytes of new texts that a task hands over at a time, and words it remembers.
BLOCK_BYTES, REMEMBERED = 4 << 20, 100_000
WORDS_OR_GAPS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def words(text: Column) -> Column:
    """Whitespace-separated words, none for a blank text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def text_columns(df: DataFrame, unique_share: dict[str, float], first_rows: int | None = None, order_by: list[str] | None = None) -> DataFrame:
    """(column, avg_words, avg_chars, uniqueness, is_text) for string columns, from one aggregate over all rows.

    ``first_rows`` restricts the averages to the first non-null texts of each column in the order of ``order_by``.
    """
    columns = [c for c, k in kinds(df).items() if k == STRING]
    schema = "column string, avg_words double, avg_chars double, uniqueness double"
    if first_rows is None:
        averages = [x for i, c in enumerate(columns) for x in (F.avg(F.size(words(F.col(f"`{c}`")))).alias(f"w{i}"), F.avg(F.length(F.col(f"`{c}`"))).alias(f"c{i}"))]
        row = df.agg(*averages).first() if columns else None
    else:
        row = {}
        for i, c in enumerate(columns):
            head = df.where(F.col(f"`{c}`").isNotNull()).orderBy(*(order_by or [])).limit(first_rows)
            row[f"w{i}"], row[f"c{i}"] = head.agg(F.avg(F.size(words(F.col(f"`{c}`")))), F.avg(F.length(F.col(f"`{c}`")))).first()
    parts = small_frame(df.sparkSession, [(c, row[f"w{i}"], row[f"c{i}"], float(unique_share[c])) for i, c in enumerate(columns)], schema)
    code = (F.col("uniqueness") > CODE_SHARE) & (F.col("avg_chars") < CODE_CHARS)
    phrase = ((F.col("avg_words") >= PHRASE_WORDS) & (F.col("uniqueness") >= PHRASE_SHARE)
              & (F.col("avg_chars") >= PHRASE_CHARS))
    return parts.withColumn("is_text", F.coalesce((F.col("avg_words") >= SENTENCE_WORDS) | (~code & phrase), F.lit(False)))


def unique_shares(profile) -> dict[str, float]:
    return {r["column"]: r["num_unique"] / r["n_rows"] if r["n_rows"] else 0.0 for r in profile.rows}


def frequent_word_lexicon(df: DataFrame, column: str, size: int = 200, min_letters: int = 4) -> DataFrame:
    """A lexicon made from the texts themselves, for tests and demos without a thesaurus: each of the most frequent
    words maps to the next frequent one."""
    with working_copy(df.select(F.col(f"`{column}`"))) as texts:
        tokens = texts.select(F.explode(F.regexp_extract_all(F.lower(f"`{column}`"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word"))
    top = tokens.where(F.length("word") >= min_letters).groupBy("word").count().orderBy(F.desc("count"), "word").limit(size)
    ranked = [r["word"] for r in top.collect()]
    return small_frame(df.sparkSession, list(zip(ranked, ranked[1:] + ranked[:1])), "word string, synonym string")


def augment_text(df: DataFrame, columns: list[str], keys: list[str], lexicon: DataFrame, strength: str = "medium",
                 seed: int = 42, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Replace a share of the words found in ``lexicon`` (word, synonym); everything between words is kept as it is.

    Draws depend on (seed, keys, word position), so whether a word is drawn is known before the lexicon is asked. A lexicon
    of at most ``table_bytes`` bytes, which is measured first, is broadcast, and texts stay where they are; a larger one is joined with the drawn words.
    Both give the same rows. ``keys`` identify rows; rows with equal keys get equal draws.
    """
    choices = lexicon.groupBy(F.lower("word").alias("word")).agg(F.array_sort(F.collect_set("synonym")).alias("synonyms"))
    entry = ENTRY_BYTES + F.octet_length("word") + F.aggregate("synonyms", F.lit(0), lambda n, x: n + ENTRY_BYTES + F.octet_length(x))
    if (choices.agg(F.sum(entry.cast("long"))).first()[0] or 0) <= table_bytes:
        return _augment_in_place(df, columns, keys, choices, STRENGTH[strength], seed)
    return _augment_by_join(df, columns, keys, choices, STRENGTH[strength], seed)


class SwapTask:
    """Task side of augmentation with a lexicon at hand."""

    def __init__(self, order: list[str], columns: list[str], synonyms, share: float, seed: int):
        self.order, self.columns, self.synonyms, self.seed = order, columns, synonyms, seed
        self.seen: dict[str, list[str] | None] = {}
        # A draw of 13 hex digits is below the share if the number they spell is below this.
        self.least = math.ceil(share * draws.SCALE - 0.5)

    def __call__(self, batches):
        for batch in batches:
            at, texts, size = 0, {c: [] for c in self.columns}, 0
            pieces = [(c, batch.column(f"_key{i}"), batch.column(f"_first{i}"), _Pieces(batch.column(f"_parts{i}"))) for i, c in enumerate(self.columns)]
            for row in range(batch.num_rows):
                for c, keys, firsts, parts in pieces:
                    text = self._text(keys[row].as_py(), firsts[row].as_py(), *parts.of(row)) if parts.valid[row] else None
                    texts[c].append(text)
                    size += len(text or b"")
                if size >= BLOCK_BYTES or row + 1 == batch.num_rows:
                    made = {c: pa.array(t, pa.binary()).cast(pa.string()) for c, t in texts.items()}
                    yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c).slice(at, row + 1 - at) for c in self.order], names=self.order)
                    at, texts, size = row + 1, {c: [] for c in self.columns}, 0

    def _text(self, key: str, first: int, raw: bytes, ends: list[int]) -> bytes:
        """Only words of the lexicon are drawn; the draws of all others change nothing."""
        known, seen, least, md5 = self.synonyms.value, self.seen, self.least, hashlib.md5
        start, out, done = f"{self.seed}|word|{key}|".encode(), [], 0
        for at in range(first, len(ends) - 1, 2):
            word = raw[ends[at]:ends[at + 1]]
            if word in seen:
                found = seen[word]
            else:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                found = seen[word] = known.get(word.decode().lower())
            if found is None:
                continue
            digest = md5(start + b"%d" % at).digest()
            if int.from_bytes(digest[:7], "big") >> 4 < least:
                second = (int.from_bytes(digest[6:13], "big") & (1 << 52) - 1) + 0.5
                out += raw[done:ends[at]], found[math.floor(second / draws.SCALE * len(found))].encode()
                done = ends[at + 1]
        return b"".join([*out, raw[done:]])


class _Pieces:
    """The words and gaps of each row as the bytes of the whole text and the places where they end, without a string for each."""

    def __init__(self, lists: pa.ListArray):
        self.valid, self.rows = lists.is_valid().to_pylist(), lists.offsets.to_numpy()
        texts = lists.values
        _, ends, self.data = texts.buffers()
        self.ends = np.frombuffer(ends, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset:] if ends else np.zeros(1, np.int32)

    def of(self, row: int) -> tuple[bytes, list[int]]:
        ends = self.ends[self.rows[row]:self.rows[row + 1] + 1]
        first = int(ends[0])
        raw = self.data.slice(first, int(ends[-1]) - first).to_pybytes() if self.data else b""
        return raw, (ends - first).tolist()


def _augment_in_place(df: DataFrame, columns: list[str], keys: list[str], choices: DataFrame, share: float, seed: int) -> DataFrame:
    """Words and gaps alternate, so only the place of the first word goes along with the pieces of a text."""
    synonyms = df.sparkSession.sparkContext.broadcast({r["word"]: r["synonyms"] for r in choices.collect()})  # its bytes are checked
    task = SwapTask(df.columns, columns, synonyms, share, seed)
    pieces = {}
    for i, c in enumerate(columns):
        parts = F.regexp_extract_all(F.col(f"`{c}`"), F.lit(WORDS_OR_GAPS), F.lit(0))
        first = F.when(F.col(f"`{c}`").rlike(r"^[\p{L}\p{N}]"), 0).otherwise(1)
        pieces |= {f"_key{i}": _key(keys, c), f"_parts{i}": parts, f"_first{i}": first}
    with working_copy(df) as rows:
        return rows.withColumns(pieces).drop(*columns).mapInArrow(lambda batches: task(batches), df.schema)


def _augment_by_join(df: DataFrame, columns: list[str], keys: list[str], choices: DataFrame, share: float, seed: int) -> DataFrame:
    """Only drawn words are exploded and joined, and their synonyms are put back into the pieces of the text by position. A word
    is spread over salts, since a common one would meet in one task; the lexicon is repeated per salt."""
    choices = choices.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    order = df.columns
    for c in columns:
        key = _key(keys, c)
        drawn = F.filter(_words_with_draws(c, key, seed), lambda p: draws._unit(p["digest"], 1) < share)
        keyed = df.withColumns({"_key": key, "_hash": F.xxhash64(F.col(f"`{c}`"))})
        words_of = keyed.select("_key", "_hash", F.explode(drawn).alias("p")).select("_key", "_hash", "p.*")
        salted = words_of.withColumn("salt", F.pmod(F.xxhash64("_key", "at"), F.lit(SALTS)).cast("int"))
        pick = F.floor(draws._unit(F.col("digest"), 14) * F.size("synonyms")).cast("int")
        found = salted.join(choices, ["word", "salt"]).select("_key", "_hash", "at", F.get("synonyms", pick).alias("piece"))
        swaps = found.groupBy("_key", "_hash").agg(F.map_from_entries(F.collect_set(F.struct("at", "piece"))).alias("_swaps"))
        joined = keyed.join(swaps, ["_key", "_hash"], "left")
        parts = F.regexp_extract_all(F.col(f"`{c}`"), F.lit(WORDS_OR_GAPS), F.lit(0))
        swapped = F.array_join(F.transform(parts, lambda p, i: F.coalesce(F.element_at("_swaps", i), p)), "")
        df = joined.withColumn(c, F.when(F.col("_swaps").isNull(), F.col(f"`{c}`")).otherwise(swapped)).select(*[F.col(f"`{o}`") for o in order])
    return df


def _words_with_draws(column: str, key: Column, seed: int) -> Column:
    """The words of a text in lower case, each with its place among words and gaps and a digest that holds its draws."""
    parts = F.regexp_extract_all(F.col(f"`{column}`"), F.lit(WORDS_OR_GAPS), F.lit(0))
    placed = F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("at"), F.lower(p).alias("word"))), lambda p: p["word"].rlike(r"^[\p{L}\p{N}]"))
    digest = lambda p: F.md5(F.concat_ws("|", F.lit(f"{seed}|word"), key, p["at"].cast("string")))
    return F.transform(placed, lambda p: F.struct(p["at"].alias("at"), p["word"].alias("word"), digest(p).alias("digest")))


def _key(keys: list[str], column: str) -> Column:
    return F.concat_ws("|", F.lit(column), *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keys])


def augment_dataset(df: DataFrame, columns: list[str], n: int, key: str, lexicon: DataFrame, strength: str = "medium",
                    seed: int = 42) -> DataFrame:
    """The originals (``variant`` 0) plus augmented copies until ``n`` rows: every row gets the same number of copies, in
    order of the integer ``key``, until the total is reached. Only the key value where copying ends is looked up, so
    rows are neither numbered nor sorted. Where keys are null or the last key is repeated, copies are counted out by
    stored row keys instead, so the total is always ``n``."""
    if kinds(df)[key] != INTEGER:
        raise ValueError("augment_dataset needs an integer key (see with_row_key)")
    size, keyed = df.agg(F.count(F.lit(1)), F.count(f"`{key}`")).first()
    originals = df.withColumn("variant", F.lit(0))
    if n <= size or size == 0:
        return originals
    per_row = math.ceil((n - size) / size)
    full, rest = divmod(n - size, per_row)
    rank_by, last = key, value_at_rank(df, F.col(f"`{key}`"), full)
    if keyed < size or (last is not None and df.where(F.col(f"`{key}`") == last).limit(2).count() > 1):
        rank_by, df = "_row", with_row_key(df, "_row")
        last = value_at_rank(df, F.col(rank_by), full)
        originals = df.drop("_row").withColumn("variant", F.lit(0))
    copies = F.lit(per_row)
    if last is not None:
        copies = F.when(F.col(f"`{rank_by}`") < last, per_row).when(F.col(f"`{rank_by}`") == last, rest).otherwise(0)
    variants = df.withColumn("_copies", copies).where("_copies > 0").withColumn(
        "variant", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies", "_row")
    return originals.unionByName(augment_text(variants, columns, [key, "variant"], lexicon, strength, seed))


def text_quality(original: DataFrame, augmented: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: average lengths, length preservation, share of new words, and their blend. Pass only new rows as
    ``augmented`` to score them undiluted. Both tables are read twice, so an expensive one should be written first."""
    def lengths(df: DataFrame, name: str) -> DataFrame:
        return _long(df, columns).groupBy("column").agg(F.avg(F.length("text")).alias(name))

    def vocabulary(df: DataFrame) -> DataFrame:
        exploded = _long(df, columns).select("column", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("word"))
        return exploded.where("word <> ''").distinct()

    with working_copy(original.select(*[F.col(f"`{c}`") for c in columns])) as copy:
        original = copy
    known, used = materialize(vocabulary(original)), vocabulary(augmented)
    known_n = known.groupBy("column").agg(F.count(F.lit(1)).alias("known"))
    fresh_n = used.join(known, ["column", "word"], "left_anti").groupBy("column").agg(F.count(F.lit(1)).alias("fresh"))
    rows = lengths(original, "before").join(lengths(augmented, "after"), "column", "left").join(
        known_n, "column", "left").join(fresh_n, "column", "left").fillna(0, ["known", "fresh"])
    drift = F.when(F.col("before") > 0, F.abs(F.col("before") - F.col("after")) / F.nullif("before", F.lit(0.0)) * 100).otherwise(0.0)
    kept = F.greatest(F.lit(0.0), 100 - F.coalesce(drift, F.lit(100.0)))
    new = F.least(F.lit(100.0), F.col("fresh") / F.greatest(F.lit(1), "known") * DIVERSITY_SCALE)
    return rows.select(
        "column", F.round(kept * LENGTH_WEIGHT + new * DIVERSITY_WEIGHT, 1).alias("score"),
        F.round(kept, 1).alias("length_preservation"), F.round(new, 1).alias("vocabulary_diversity"),
        F.round("before", 1).alias("original_avg_length"), F.round("after", 1).alias("augmented_avg_length"))


def text_grade(per_column: DataFrame) -> DataFrame:
    overall = per_column.agg(F.coalesce(F.round(F.avg("score"), 1), F.lit(0.0)).alias("overall_score"))
    return overall.withColumns({
        "grade": F.when(F.col("overall_score") >= 80, "Excellent").when(F.col("overall_score") >= 60, "Good").otherwise("Fair"),
        "color": F.when(F.col("overall_score") >= 80, "green").when(F.col("overall_score") >= 60, "yellow").otherwise("red")})


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns]).unpivot([], columns, "column", "text").where("text is not null")


def anchored_rows(df: DataFrame, n: int, keys: list[str], label: str | None = None, counts: dict[str, int] | DataFrame | None = None,
                  seed: int = 42) -> DataFrame:
    """``n`` output rows (``row_id``), each a whole copy of a random real row.

    Without ``counts`` labels follow the real distribution, which is the same as drawing any real row. With ``counts``, a dict or for any
    number of labels a table (value, rows), each label gets its number of rows (in the order of the dict, or of the values), drawn from the
    real rows of that label; a label no real row has draws from all.
    """
    if label is None or counts is None or isinstance(counts, dict) and not counts:
        whole = small_frame(df.sparkSession, [("", n, 0)], "value string, rows long, start long")
        return _draw(df, whole, keys, None, seed)
    if isinstance(counts, dict):
        wanted = [(str(v), int(m)) for v, m in counts.items() if m > 0]
        starts = accumulate([0, *(m for _, m in wanted)])
        plan = small_frame(df.sparkSession, [(*w, start) for w, start in zip(wanted, starts)], "value string, rows long, start long")
    else:
        plan = with_starts(counts.where("rows > 0").select(F.col("value").cast("string").alias("value"), F.col("rows").cast("long").alias("rows")))
    labelled = df.withColumn("_label", F.col(f"`{label}`").cast("string"))
    found = class_counts(df, label).select("value", F.lit(True).alias("_real"))
    plan = materialize(plan.join(found, "value", "left"))
    answer = _draw(labelled, plan.where("_real").drop("_real"), keys, "_label", seed)
    strangers = plan.where(F.col("_real").isNull()).drop("_real")
    return answer if strangers.isEmpty() else answer.unionByName(_draw(df, strangers, keys, None, seed))


def _draw(df: DataFrame, plan: DataFrame, keys: list[str], pool: str | None, seed: int) -> DataFrame:
    """Join each output row of ``plan`` (value, rows, start) to the real row of a drawn number within its pool. Where few real rows serve many
    output rows, the real rows are repeated over salts so that their draws spread over tasks."""
    if pool is not None:
        df = df.join(plan.select(F.col("value").alias(pool)), pool, "left_semi")
    indexed, sizes = dense_index(df, keys, within=pool)
    if pool is None:
        size = sizes.first()
        sized = plan.withColumn("_n", F.lit(size["size"] if size else 0).cast("long"))
        needed = F.lit(plan.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    else:
        sized = plan.join(sizes.select(F.col(pool).alias("value"), F.col("size").cast("long").alias("_n")), "value")
        needed = F.col("rows")
    sized = materialize(sized.withColumn("_salts", (1 + F.floor(needed / (F.greatest(F.lit(1), "_n") * DRAWS_PER_ROW))).cast("int")))
    jobs = sized.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / CHUNK))))
    low = F.col("start") + F.col("_k") * CHUNK
    # Ranges of row ids are dealt out before they become rows.
    ranges = jobs.select("value", "_n", "_salts", low.alias("low"), F.least(F.col("start") + F.col("rows"), low + CHUNK).alias("high")).repartition("low")
    ids = ranges.select("value", "_n", "_salts", F.explode(F.sequence("low", F.col("high") - 1)).alias("row_id"))
    u = draws.uniform(seed, "anchor", F.col("row_id"))
    drawn = ids.select("row_id", "value", F.floor(u * F.col("_n")).alias("idx"), F.pmod(F.col("row_id"), F.col("_salts")).cast("int").alias("_salt"))
    on = ["idx", "_salt"]
    if pool is None:
        drawn, copies = drawn.drop("value"), F.lit(sized.agg(F.coalesce(F.max("_salts"), F.lit(1))).first()[0])
    else:
        drawn, on = drawn.withColumnRenamed("value", pool), [pool, *on]
        many = sized.where("_salts > 1").select(F.col("value").alias(pool), "_salts")
        copies = F.lit(1)
        if not many.isEmpty():
            indexed, copies = indexed.join(many, pool, "left"), F.coalesce("_salts", F.lit(1))
    rows = indexed.withColumn("_salt", F.explode(F.sequence(F.lit(0), (copies - 1).cast("int"))))
    return drawn.join(rows, on).select("row_id", *[F.col(f"`{c}`") for c in df.columns if c != pool])


def hybrid_generate(df: DataFrame, columns: list[str], n: int, keys: list[str], lexicon: DataFrame,
                    label: str | None = None, counts: dict[str, int] | DataFrame | None = None, strength: str = "medium",
                    seed: int = 42) -> DataFrame:
    """Anchored rows whose text columns are augmented; every other value stays that of the real row."""
    rows = anchored_rows(df, n, keys, label, counts, seed)
    return augment_text(rows, columns, ["row_id"], lexicon, strength, seed)
