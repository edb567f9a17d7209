"""Queries of text operators, the run ledger and contact intake."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tabloom.operators import ledger, text
from tabloom.operators.profile import profile_table
from tabloom.plans import runs
from tabloom.queries.common import Book, table, union_sql, unit_sql
from tabloom.session import materialize, shared_folder

BOOK = Book()
SEED = 42

# Text detection

_TEXTS = {"documents": (["doc_id"], ["text", "lang", "source"], 2), "conversations": (["conv_id", "turn"], ["role", "text"], 2),
          "part": (["p_partkey"], ["p_name", "p_brand", "p_type"], 3), "customer": (["c_custkey"], ["c_name", "c_mktsegment"], 3)}


def _detect_sql(name: str) -> str:
    _, columns, _ = _TEXTS[name]
    parts = []
    for c in columns:
        parts.append(f"""SELECT '{name}' AS table_name, '{c}' AS "column", w AS avg_words, k AS avg_chars, u AS uniqueness,
            w >= 3 OR (NOT (u > 0.95 AND k < 12) AND w >= 1.5 AND u >= 0.3 AND k >= 6) AS is_text FROM (
            SELECT avg(len(list_filter(string_split_regex(x, '\\s+'), lambda t: t <> ''))) AS w, avg(length(x)) AS k,
                (SELECT count(DISTINCT {c}) / count(*) FROM {name}) AS u
            FROM (SELECT {c} AS x FROM {name} WHERE {c} IS NOT NULL))""")
    return union_sql(parts)


def _detected(spark, folder, name: str):
    df = table(spark, folder, name)
    found = text.text_columns(df, text.unique_shares(profile_table(df)))
    return found.withColumn("table_name", F.lit(name))


@BOOK.add("detect_text_columns", "SELECT table_name, \"column\", round(avg_words, 6) AS avg_words, round(avg_chars, 6) AS avg_chars,"
          f" round(uniqueness, 6) AS uniqueness, is_text FROM ({union_sql([_detect_sql(n) for n in _TEXTS])})")
def detect_text_columns(spark, folder):
    found = reduce(lambda a, b: a.unionByName(b), [_detected(spark, folder, n) for n in _TEXTS])
    return found.withColumns({c: F.round(c, 6) for c in ("avg_words", "avg_chars", "uniqueness")})


@BOOK.add("text_profile", union_sql([
    f"""SELECT '{n}' AS table_name, count(*) FILTER (is_text) AS text_column_count,
        count(*) FILTER (NOT is_text) + (SELECT count(*) FROM (DESCRIBE {n})) - count(*) AS other_column_count,
        bool_or(is_text) AS is_text_dataset FROM ({_detect_sql(n)})""" for n in ("documents", "part")]))
def text_profile(spark, folder):
    parts = []
    for n in ("documents", "part"):
        width = len(table(spark, folder, n).columns)
        parts.append(_detected(spark, folder, n).groupBy("table_name").agg(
            F.count_if("is_text").alias("text_column_count"), (F.lit(width) - F.count_if("is_text")).alias("other_column_count"),
            F.bool_or("is_text").alias("is_text_dataset")))
    return parts[0].unionByName(parts[1])


# Augmentation

LEXICON = """lexicon AS MATERIALIZED (SELECT word, coalesce(lead(word) OVER (ORDER BY n DESC, word), first(word) OVER (ORDER BY n DESC, word)) AS synonym
    FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM documents)
        WHERE length(word) >= 4 GROUP BY word ORDER BY n DESC, word LIMIT 200))"""


def _augmented_sql(source: str, keys: list[str], share: float) -> str:
    """Rows of ``source`` (keys, text) with drawn words replaced; a one-entry lexicon row leaves no choice to draw."""
    names = ", ".join(keys)
    return f"""(SELECT {names}, string_agg(CASE WHEN synonym IS NOT NULL AND {unit_sql(SEED, 'word', *["'text'"], *keys, 'pos')} < {share}
            THEN synonym ELSE piece END, '' ORDER BY pos) AS text
        FROM (SELECT {names}, unnest(pieces) AS piece, unnest(range(len(pieces))) AS pos FROM (
            SELECT {names}, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS pieces FROM {source}))
        LEFT JOIN lexicon ON lower(piece) = word GROUP BY {names})"""


def _lexicon(spark, folder):
    return text.frequent_word_lexicon(table(spark, folder, "documents"), "text")


@BOOK.add("augment_text", f"WITH {LEXICON} SELECT doc_id, text FROM {_augmented_sql('documents', ['doc_id'], 0.2)}")
def augment_text(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return text.augment_text(documents, ["text"], ["doc_id"], _lexicon(spark, folder), seed=SEED)


@BOOK.add("augment_text_joined", f"WITH {LEXICON} SELECT doc_id, text FROM {_augmented_sql('documents', ['doc_id'], 0.3)}")
def augment_text_joined(spark, folder):
    """The highest strength."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return text.augment_text(documents, ["text"], ["doc_id"], _lexicon(spark, folder), "high", SEED)


_VARIANTS = """(SELECT doc_id, unnest(range(1, copies + 1)) AS variant, text FROM (SELECT doc_id, text,
    least(k, greatest(0, need - (row_number() OVER (ORDER BY doc_id) - 1) * k)) AS copies
    FROM documents, (SELECT need, ceil(need / n)::BIGINT AS k FROM (SELECT count(*) AS n, (count(*) * 3 // 2 + 7) AS need FROM documents)))
    WHERE copies > 0)"""


def _augmented(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    n = documents.count()
    return documents, text.augment_dataset(documents, ["text"], n + n * 3 // 2 + 7, "doc_id", _lexicon(spark, folder), "low", SEED)


@BOOK.add("augment_dataset", f"""WITH {LEXICON} SELECT doc_id, 0 AS variant, text FROM documents
    UNION ALL SELECT doc_id, variant::INTEGER, text FROM {_augmented_sql(_VARIANTS, ['doc_id', 'variant'], 0.1)}""")
def augment_dataset(spark, folder):
    return _augmented(spark, folder)[1]


_WIDE = "(SELECT doc_id + 1152921504606846976 AS doc_id, text FROM documents)"


@BOOK.add("augment_dataset_wide_keys", f"""WITH {LEXICON}, wide AS MATERIALIZED {_WIDE} SELECT doc_id, 0 AS variant, text FROM wide
    UNION ALL SELECT doc_id, variant::INTEGER, text FROM {_augmented_sql(_VARIANTS.replace("FROM documents, ", "FROM wide, "), ['doc_id', 'variant'], 0.1)}""")
def augment_dataset_wide_keys(spark, folder):
    """Keys beyond 2^53 keep their order and number."""
    documents = table(spark, folder, "documents").select((F.col("doc_id") + 2**60).alias("doc_id"), "text")
    n = documents.count()
    return text.augment_dataset(documents, ["text"], n + n * 3 // 2 + 7, "doc_id", _lexicon(spark, folder), "low", SEED)


_WORDS = "unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda t: t <> ''))"


_QUALITY = f"""WITH {LEXICON}, a AS MATERIALIZED {_augmented_sql(_VARIANTS, ['doc_id', 'variant'], 0.1)},
    k AS (SELECT DISTINCT {_WORDS} AS w FROM documents), f AS (SELECT DISTINCT {_WORDS} AS w FROM a),
    s AS (SELECT (SELECT avg(length(text)) FROM documents) AS b, (SELECT avg(length(text)) FROM a) AS e,
        (SELECT count(*) FROM k) AS known, (SELECT count(*) FROM f ANTI JOIN k USING (w)) AS fresh),
    p AS (SELECT *, greatest(0, 100 - abs(b - e) / b * 100) AS kept, least(100, fresh / known * 500) AS new FROM s)
    SELECT 'text' AS "column", round(kept * 0.6e0 + new * 0.4e0, 1) AS score, round(kept, 1) AS length_preservation,
    round(new, 1) AS vocabulary_diversity, round(b, 1) AS original_avg_length, round(e, 1) AS augmented_avg_length FROM p"""


@BOOK.add("text_quality", _QUALITY)
def text_quality(spark, folder):
    """Only the new rows are scored."""
    documents, grown = _augmented(spark, folder)
    return text.text_quality(documents, materialize(grown.where("variant > 0")), ["text"])


@BOOK.add("text_grade", f"""SELECT overall_score, CASE WHEN overall_score >= 80 THEN 'Excellent' WHEN overall_score >= 60 THEN 'Good'
    ELSE 'Fair' END AS grade, CASE WHEN overall_score >= 80 THEN 'green' WHEN overall_score >= 60 THEN 'yellow' ELSE 'red' END AS color
    FROM (SELECT round(avg(score), 1) AS overall_score FROM ({_QUALITY}))""")
def text_grade(spark, folder):
    documents, grown = _augmented(spark, folder)
    return text.text_grade(text.text_quality(documents, materialize(grown.where("variant > 0")), ["text"]))


# Rows anchored to real examples

_PAIRED = "(SELECT doc_id, text, lang, coalesce(quality, 2) AS quality FROM documents LEFT JOIN labels USING (doc_id))"
_ANCHORS = f"""(WITH base AS (SELECT *, md5(cast(doc_id AS VARCHAR)) AS h FROM {_PAIRED}),
    p AS (SELECT *, cast(quality AS VARCHAR) AS pool, row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) - 1 AS idx FROM base
        UNION ALL SELECT *, '5' AS pool, row_number() OVER (ORDER BY h, doc_id) - 1 AS idx FROM base),
    z AS (SELECT pool, count(*) AS size FROM p GROUP BY pool),
    n AS (SELECT count(*) AS n FROM documents),
    d AS (SELECT row_id, CASE WHEN row_id < n THEN '0' WHEN row_id < n + n // 2 THEN '1' ELSE '5' END AS pool
        FROM (SELECT unnest(range(n + n // 2 + 50)) AS row_id, n FROM n))
    SELECT d.row_id, p.doc_id, p.text, p.lang, p.quality FROM d JOIN z USING (pool)
    JOIN p ON p.pool = d.pool AND p.idx = floor({unit_sql(SEED, 'anchor', 'd.row_id')} * z.size)::BIGINT)"""


def _anchored(spark, folder):
    """All documents with their labels (2: none), and how many rows each label gets (label 5 does not occur)."""
    documents = table(spark, folder, "documents")
    n = documents.count()
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    paired = documents.select("doc_id", "text", "lang").join(labels, "doc_id", "left").withColumn("quality", F.coalesce("quality", F.lit(2)))
    return paired, {"0": n, "1": n // 2, "5": 50}


@BOOK.add("anchor_rows", f"SELECT row_id, doc_id, lang, quality FROM {_ANCHORS}")
def anchor_rows(spark, folder):
    paired, counts = _anchored(spark, folder)
    rows = text.anchored_rows(paired, sum(counts.values()), ["doc_id"], "quality", counts, SEED)
    return rows.select("row_id", "doc_id", "lang", "quality")


@BOOK.add("hybrid_anchor", f"""WITH {LEXICON}, r AS MATERIALIZED {_ANCHORS}
    SELECT row_id, doc_id, lang, quality, a.text FROM r JOIN {_augmented_sql('r', ['row_id'], 0.2)} a USING (row_id)""")
def hybrid_anchor(spark, folder):
    paired, counts = _anchored(spark, folder)
    return text.hybrid_generate(paired, ["text"], sum(counts.values()), ["doc_id"], _lexicon(spark, folder), "quality",
                                counts, seed=SEED)


@BOOK.add("hybrid_natural_labels", f"""WITH base AS (SELECT doc_id, quality, row_number() OVER (ORDER BY md5(cast(doc_id AS VARCHAR)), doc_id) - 1 AS idx
        FROM {_PAIRED}), n AS (SELECT count(*) AS n FROM base)
    SELECT d.row_id, base.doc_id, base.quality FROM (SELECT unnest(range(2 * n)) AS row_id, n FROM n) d
    JOIN base ON base.idx = floor({unit_sql(SEED, 'anchor', 'd.row_id')} * n)::BIGINT""")
def hybrid_natural_labels(spark, folder):
    """Without counts the labels keep their real shares."""
    paired, _ = _anchored(spark, folder)
    rows = text.anchored_rows(paired, 2 * paired.count(), ["doc_id"], "quality", None, SEED)
    return rows.select("row_id", "doc_id", "quality")


@BOOK.add("generate_text_rows", """SELECT lang, n, true AS real_source, true AS scored FROM (SELECT 'en' AS lang, count(*) AS n FROM documents
    UNION ALL SELECT 'de', count(*) // 2 FROM documents)""")
def generate_text_rows(spark, folder):
    """The text run: profile, text columns, rows anchored to real ones by language, augmented and scored."""
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    n = documents.count()
    rows, quality = runs.generate_text_rows(documents, n + n // 2, "doc_id", _lexicon(spark, folder), "lang", {"en": n, "de": n // 2}, seed=SEED)
    sources = [r[0] for r in documents.select("source").distinct().collect()]
    scored = all(0 <= r["score"] <= 100 for r in quality.collect()) and "text" in {r["column"] for r in quality.collect()}
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("source").isin(*sources)).alias("real_source")).withColumn("scored", F.lit(scored))


# Run ledger and contacts


def _runs(spark, folder):
    """The event log read as a log of runs."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("kind"), (F.floor(F.col("value") * 10) - 20).alias("rows"),
        F.col("value").alias("score"))


_RUNS = "(SELECT event_id AS run_id, event_type AS kind, floor(value * 10)::BIGINT - 20 AS \"rows\", value AS score FROM events)"


@BOOK.add("run_ledger_totals", f"""SELECT (coalesce(sum("rows") FILTER ("rows" > 0), 0) + 18450)::BIGINT AS total_rows,
    count(*) + 47 AS total_datasets FROM {_RUNS}""")
def run_ledger_totals(spark, folder):
    return ledger.totals(_runs(spark, folder))


@BOOK.add("recent_runs", f"SELECT * FROM {_RUNS} ORDER BY run_id DESC LIMIT 5")
def recent_runs(spark, folder):
    return ledger.recent_runs(_runs(spark, folder), "run_id", ["kind", "rows", "score"])


_CONTACTS = """(SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN c_name || ' at home'
    ELSE '  ' || c_mktsegment || '.' || (c_custkey % 200) || '@Example.ORG ' END AS email,
    ' ' || repeat(c_name || ' ', 6) AS interest FROM customer)"""
_CLEAN = f"""(SELECT c_custkey, CASE WHEN e = '' OR NOT regexp_full_match(e, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') THEN NULL ELSE e END AS email,
    left(trim(interest), 80) AS interest, e = '' OR regexp_full_match(e, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') AS valid
    FROM (SELECT *, lower(trim(coalesce(email, ''))) AS e FROM {_CONTACTS}))"""


def _contacts(spark, folder):
    """Contact requests derived from the customers: some without an address, some malformed, many repeated."""
    key = F.col("c_custkey")
    address = F.concat(F.lit("  "), "c_mktsegment", F.lit("."), (key % 200).cast("string"), F.lit("@Example.ORG "))
    return table(spark, folder, "customer").select(
        "c_custkey", F.when(key % 11 == 0, None).when(key % 7 == 0, F.concat("c_name", F.lit(" at home"))).otherwise(address).alias("email"),
        F.concat(F.lit(" "), F.repeat(F.concat("c_name", F.lit(" ")), F.lit(6))).alias("interest"))


@BOOK.add("validate_contacts", f"SELECT * FROM {_CLEAN}")
def validate_contacts(spark, folder):
    return ledger.validate_contacts(_contacts(spark, folder))


_KNOWN = f"(SELECT DISTINCT email FROM {_CLEAN} WHERE c_custkey % 5 = 0 AND email IS NOT NULL)"
_APPENDED = f"""(SELECT c_custkey, email, interest, email IS NOT NULL AND (email IN (SELECT email FROM {_KNOWN})
    OR row_number() OVER (PARTITION BY email ORDER BY c_custkey) > 1) AS already FROM {_CLEAN} WHERE valid AND c_custkey % 5 <> 0)"""


def _appended(spark, folder):
    contacts = _contacts(spark, folder)
    known = ledger.validate_contacts(contacts.where("c_custkey % 5 = 0")).where("email is not null").select("email").distinct()
    return ledger.new_contacts(contacts.where("c_custkey % 5 <> 0"), known, ["c_custkey"])


@BOOK.add("append_if_new", f"SELECT * FROM {_APPENDED}")
def append_if_new(spark, folder):
    return _appended(spark, folder)


@BOOK.add("append_if_new_repeated", f"""SELECT c_custkey // 3 AS day, email, interest, email IS NOT NULL AND (email IN (SELECT email FROM {_KNOWN})
    OR row_number() OVER (PARTITION BY email ORDER BY c_custkey // 3, interest) > 1) AS already FROM {_CLEAN} WHERE valid AND c_custkey % 5 <> 0""")
def append_if_new_repeated(spark, folder):
    """Three contacts arrive on each day, so the arrival does not tell them apart."""
    contacts = _contacts(spark, folder)
    known = ledger.validate_contacts(contacts.where("c_custkey % 5 = 0")).where("email is not null").select("email").distinct()
    batch = contacts.where("c_custkey % 5 <> 0").select(F.floor(F.col("c_custkey") / 3).alias("day"), "email", "interest")
    return ledger.new_contacts(batch, known, ["day"])


@BOOK.add("contact_summary", f"SELECT count(*) AS contact_count, count(*) >= 25 AS visible FROM {_APPENDED} WHERE NOT already")
def contact_summary(spark, folder):
    return ledger.summary(_appended(spark, folder).where("not already"))


@BOOK.add("run_ledger_append", f"""SELECT (coalesce(sum("rows") FILTER ("rows" > 0), 0) + 18450)::BIGINT AS total_rows, count(*) + 47 AS total_datasets,
    count(DISTINCT kind) AS batches FROM {_RUNS}""")
def run_ledger_append(spark, folder):
    """Runs appended in a batch for each kind, two batches twice; the totals are read back from the table."""
    log, place = _runs(spark, folder), shared_folder(spark, "ledger")
    kinds = sorted(r[0] for r in log.select("kind").distinct().collect())
    for kind in [*kinds, kinds[0], kinds[-1]]:
        ledger.commit(log.where(F.col("kind") == kind), place, kind)
    entered = ledger.committed(spark, place, log.schema)
    return ledger.totals(entered).withColumn("batches", entered.agg(F.count_distinct(ledger.BATCH)).scalar())


@BOOK.add("run_ledger_entries", """SELECT run_id, strategy, n AS "rows", total_rows, total_datasets FROM
    (SELECT count(*) AS n, 18450 + count(*) + count(*) * 2 AS total_rows, 49::BIGINT AS total_datasets FROM nation),
    (VALUES ('first', 'bootstrap'), ('second', 'bootstrap')) r(run_id, strategy) WHERE run_id = 'first'
    UNION ALL SELECT 'second', 'bootstrap', 2 * count(*), 18450 + count(*) + count(*) * 2, 49::BIGINT FROM nation""")
def run_ledger_entries(spark, folder):
    """Two whole runs on one ledger, the first repeated under its name."""
    nation, place = table(spark, folder, "nation"), shared_folder(spark, "ledger")
    n = nation.count()
    for name, rows in (("first", n), ("second", 2 * n), ("first", n)):
        runs.generate_rows(nation, rows, ["n_nationkey"], seed=SEED, ledger_path=place, run_id=name)
    entered = ledger.committed(spark, place, ledger.RUNS)
    return entered.drop(ledger.BATCH).crossJoin(F.broadcast(ledger.totals(entered)))


_ARRIVED = f"""(SELECT c_custkey, email, interest, c_custkey % 5 AS day, row_number() OVER (PARTITION BY email ORDER BY c_custkey % 5, c_custkey) AS rank FROM {_CLEAN} WHERE valid)"""


@BOOK.add("append_contacts", f"SELECT c_custkey, email, interest, 'day-' || day AS batch FROM {_ARRIVED} WHERE email IS NULL OR rank = 1")
def append_contacts(spark, folder):
    """Contacts appended in a batch a day, two days twice; the table is read back."""
    contacts, place = _contacts(spark, folder), shared_folder(spark, "contacts")
    for day in (0, 1, 2, 1, 3, 4, 0):
        ledger.append_contacts(contacts.where(F.col("c_custkey") % 5 == day), place, f"day-{day}", ["c_custkey"])
    return ledger.committed(spark, place, contacts.schema)
