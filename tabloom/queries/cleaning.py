"""Queries of fixes, automatic cleaning and the transforms around a generator."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import draws
from tabloom.functions.small import small_frame
from tabloom.operators import clean, issues, transforms
from tabloom.operators.fixes import Fix, apply_fixes, fixes_from_report
from tabloom.operators.numeric import numeric_facts
from tabloom.operators.profile import profile_table
from tabloom.queries.common import DIRTY, Book, dirty_orders, table, union_sql, unit_sql

BOOK = Book()


def _rounded(df, *columns, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _with_text_date(df):
    return df.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


# Approved fixes

_MEDIAN = f"(SELECT quantile_cont(o_totalprice, 0.5) FROM {DIRTY})"
_MODE = f"(SELECT note FROM {DIRTY} WHERE note IS NOT NULL GROUP BY note ORDER BY count(*) DESC, note LIMIT 1)"
_NONZERO = f"(SELECT quantile_cont(discount_amt, 0.5) FROM {DIRTY} WHERE discount_amt <> 0)"


@BOOK.add("fix_fill_missing", f"""SELECT o_orderkey, round(coalesce(o_totalprice, {_MEDIAN}), 6) AS o_totalprice,
    coalesce(note, {_MODE}) AS note FROM {DIRTY}""")
def fix_fill_missing(spark, folder):
    """The empty column cannot be filled and is dropped."""
    fixed = apply_fixes(dirty_orders(spark, folder), [Fix(c, issues.FILL) for c in ("o_totalprice", "note", "empty_col")])
    assert "empty_col" not in fixed.columns
    return _rounded(fixed, "o_totalprice").select("o_orderkey", "o_totalprice", "note")


@BOOK.add("fix_zeros", f"""SELECT o_orderkey, round(CASE WHEN discount_amt = 0 THEN {_NONZERO} ELSE discount_amt END, 6)
    AS discount_amt FROM {DIRTY}""")
def fix_zeros(spark, folder):
    fixed = apply_fixes(dirty_orders(spark, folder), [Fix("discount_amt", issues.ZEROS)])
    return _rounded(fixed, "discount_amt").select("o_orderkey", "discount_amt")


def _cap_sql(source: str, column: str, key: str) -> str:
    return f"""WITH s AS {source}, q AS (SELECT quantile_cont({column}, 0.25) AS a, quantile_cont({column}, 0.75) AS b FROM s)
        SELECT {key}, round(CASE WHEN {column} < a - 1.5 * (b - a) THEN a - 1.5 * (b - a)
            WHEN {column} > b + 1.5 * (b - a) THEN b + 1.5 * (b - a) ELSE {column} END, 6) AS {column} FROM s, q"""


@BOOK.add("fix_cap_outliers", _cap_sql("(SELECT event_id, value FROM events)", "value", "event_id"))
def fix_cap_outliers(spark, folder):
    fixed = apply_fixes(table(spark, folder, "events").select("event_id", "value"), [Fix("value", issues.CAP)])
    return _rounded(fixed, "value")


@BOOK.add("fix_drop_column", f"SELECT o_orderkey, note, rare_cat, flag FROM {DIRTY}")
def fix_drop_column(spark, folder):
    gone = ("o_totalprice", "discount_amt", "empty_col", "const_col", "free_key", "o_orderdate")
    return apply_fixes(dirty_orders(spark, folder), [Fix(c, issues.DROP) for c in gone])


@BOOK.add("apply_all_fixes", f"""WITH filled AS (SELECT o_orderkey, coalesce(o_totalprice, {_MEDIAN}) AS o_totalprice,
        CASE WHEN discount_amt = 0 THEN {_NONZERO} ELSE discount_amt END AS discount_amt, coalesce(note, {_MODE}) AS note,
        rare_cat, cast(o_orderdate AS VARCHAR) AS o_orderdate, flag FROM {DIRTY}),
    q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM filled)
    SELECT round(CASE WHEN o_totalprice < a - 1.5 * (b - a) THEN a - 1.5 * (b - a)
        WHEN o_totalprice > b + 1.5 * (b - a) THEN b + 1.5 * (b - a) ELSE o_totalprice END, 6) AS o_totalprice,
        round(discount_amt, 6) AS discount_amt, note, rare_cat, o_orderdate, flag FROM filled, q""")
def apply_all_fixes(spark, folder):
    """Every reported issue fixed, in table order: gaps before outliers of the same column."""
    dirty = dirty_orders(spark, folder)
    report = issues.issue_report(profile_table(dirty).frame)
    return _with_text_date(_rounded(apply_fixes(dirty, fixes_from_report(report)), "o_totalprice", "discount_amt"))


# Automatic cleaning


@BOOK.add("drop_ids", f"""SELECT o_totalprice, discount_amt, note, empty_col, const_col, rare_cat,
    cast(o_orderdate AS VARCHAR) AS o_orderdate, flag FROM {DIRTY}""")
def drop_ids(spark, folder):
    dirty = dirty_orders(spark, folder)
    return _with_text_date(clean.drop_identifiers(dirty, profile_table(dirty)))


@BOOK.add("drop_empty", f"""SELECT o_orderkey, o_totalprice, discount_amt, note, const_col, free_key, rare_cat,
    cast(o_orderdate AS VARCHAR) AS o_orderdate, flag FROM {DIRTY}""")
def drop_empty(spark, folder):
    return _with_text_date(clean.drop_empty(dirty_orders(spark, folder)))


@BOOK.add("drop_constant", f"""SELECT o_orderkey, o_totalprice, discount_amt, note, empty_col, free_key, rare_cat,
    cast(o_orderdate AS VARCHAR) AS o_orderdate, flag FROM {DIRTY}""")
def drop_constant(spark, folder):
    return _with_text_date(clean.drop_constant(dirty_orders(spark, folder)))


@BOOK.add("expand_datetime", """SELECT l_orderkey, l_linenumber, cast(year(l_shipdate) AS INTEGER) AS l_shipdate_year,
    cast(month(l_shipdate) AS INTEGER) AS l_shipdate_month, cast(day(l_shipdate) AS INTEGER) AS l_shipdate_day,
    cast(isodow(l_shipdate) - 1 AS INTEGER) AS l_shipdate_dayofweek FROM lineitem""")
def expand_datetime(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return clean.expand_datetimes(rows, profile_table(rows))


@BOOK.add("fill_by_type", f"""SELECT o_orderkey, round(coalesce(o_totalprice, {_MEDIAN}), 6) AS o_totalprice,
    coalesce(note, {_MODE}) AS note FROM {DIRTY}""")
def fill_by_type(spark, folder):
    rows = dirty_orders(spark, folder).select("o_orderkey", "o_totalprice", "note")
    return _rounded(clean.fill_by_type(rows, profile_table(rows)), "o_totalprice")


@BOOK.add("group_rare", f"""WITH s AS {DIRTY}, f AS (SELECT rare_cat, count(*) / (SELECT count(rare_cat) FROM s) AS share
    FROM s GROUP BY rare_cat) SELECT o_orderkey, CASE WHEN share < 0.01 THEN 'Other' ELSE rare_cat END AS rare_cat
    FROM s JOIN f USING (rare_cat)""")
def group_rare(spark, folder):
    return clean.group_rare(dirty_orders(spark, folder).select("o_orderkey", "rare_cat"), ["rare_cat"])


@BOOK.add("auto_clean", f"""WITH s AS {DIRTY}, f AS (SELECT rare_cat, count(*) / (SELECT count(rare_cat) FROM s) AS share
    FROM s GROUP BY rare_cat)
    SELECT round(coalesce(o_totalprice, {_MEDIAN}), 6) AS o_totalprice, round(discount_amt, 6) AS discount_amt,
    coalesce(note, {_MODE}) AS note, CASE WHEN share < 0.01 THEN 'Other' ELSE rare_cat END AS rare_cat, flag,
    cast(year(o_orderdate) AS INTEGER) AS o_orderdate_year, cast(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
    cast(day(o_orderdate) AS INTEGER) AS o_orderdate_day, cast(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_dayofweek
    FROM s JOIN f USING (rare_cat)""")
def auto_clean(spark, folder):
    dirty = dirty_orders(spark, folder)
    return _rounded(clean.auto_clean(dirty, profile_table(dirty), target="flag"), "o_totalprice", "discount_amt")


# Transforms

_SKEWS = {"events": ("user_id", "value"), "documents": ("n_chars",), "lineitem": ("l_quantity", "l_tax")}


@BOOK.add("detect_skewed", union_sql([
    f"""SELECT '{t}' AS table_name, '{c}' AS "column", round(skewness({c}), 6) AS skew,
        count(DISTINCT {c}) > 2 AND abs(skewness({c})) > 1 AND min({c}) >= 0 AS skewed FROM {t}"""
    for t, cs in _SKEWS.items() for c in cs]))
def detect_skewed(spark, folder):
    rows = []
    for t, columns in _SKEWS.items():
        facts = numeric_facts(table(spark, folder, t), list(columns))
        found = transforms.skewed_columns(facts)
        rows += [(t, c, facts[c].skew, c in found) for c in columns]
    frame = small_frame(spark, rows, "table_name string, column string, skew double, skewed boolean")
    return _rounded(frame, "skew")


@BOOK.add("log_transform", "SELECT event_id, round(ln(1e0 + value), 9) AS value FROM events")
def log_transform(spark, folder):
    return _rounded(transforms.log_transform(table(spark, folder, "events").select("event_id", "value"), ["value"]),
                    "value", digits=9)


@BOOK.add("reverse_log", """SELECT event_id, round(exp(CASE WHEN ln(1e0 + value) * 1.2e0 - 0.3e0 < ln(1e0 + lo) THEN ln(1e0 + lo)
    WHEN ln(1e0 + value) * 1.2e0 - 0.3e0 > ln(1e0 + hi) THEN ln(1e0 + hi) ELSE ln(1e0 + value) * 1.2e0 - 0.3e0 END) - 1e0, 6) AS value
    FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)""")
def reverse_log(spark, folder):
    """Values stretched on the log scale come back inside the real range."""
    events = table(spark, folder, "events").select("event_id", "value")
    logged = transforms.log_transform(events, ["value"]).withColumn("value", F.col("value") * 1.2 - 0.3)
    return _rounded(transforms.reverse_log(logged, ["value"], numeric_facts(events, ["value"])), "value")


_WHOLE = {"lineitem": ("l_orderkey", "l_quantity", "l_discount"), "events": ("user_id", "value")}


@BOOK.add("integer_like", union_sql([
    f"""SELECT '{t}' AS table_name, '{c}' AS "column", bool_and({c} = floor({c})) AS whole FROM {t}"""
    for t, cs in _WHOLE.items() for c in cs]))
def integer_like(spark, folder):
    rows = []
    for t, columns in _WHOLE.items():
        facts = numeric_facts(table(spark, folder, t), list(columns))
        rows += [(t, c, facts[c].whole) for c in columns]
    return small_frame(spark, rows, "table_name string, column string, whole boolean")


@BOOK.add("encode_discrete", """SELECT l_orderkey, cast(l_linenumber AS VARCHAR) AS l_linenumber, l_quantity, l_returnflag
    FROM lineitem""")
def encode_discrete(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return transforms.encode_discrete(rows, transforms.discrete_codes(profile_table(rows), rows.columns))


@BOOK.add("decode_discrete", """SELECT l_orderkey, CASE WHEN l_orderkey % 7 = 0
    THEN (SELECT l_linenumber FROM lineitem GROUP BY l_linenumber ORDER BY count(*) DESC, l_linenumber LIMIT 1)
    ELSE l_linenumber END::BIGINT AS l_linenumber FROM lineitem""")
def decode_discrete(spark, folder):
    """Unreadable codes become the most frequent value."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    codes = rows.withColumn("l_linenumber", F.when(F.col("l_orderkey") % 7 == 0, "?").otherwise(
        F.col("l_linenumber").cast("string")))
    return transforms.decode_discrete(codes, ["l_linenumber"], rows)


_NOISY = unit_sql(11, "noise", "c_custkey")
_PLACES = """(SELECT least(4, floor(quantile_cont(greatest(1, length(rtrim(split_part(cast(cast(abs(c_acctbal) AS DECIMAL(38, 12))
    AS VARCHAR), '.', 2), '0'))), 0.5)))::INTEGER FROM customer)"""


def _noisy_customers(spark, folder):
    noise = draws.uniform(11, "noise", F.col("c_custkey"))
    return table(spark, folder, "customer").select(
        "c_custkey", (F.col("c_nationkey") * 1.4 + noise * 3 - 2).alias("c_nationkey"),
        (F.col("c_acctbal") * 1.3 + noise * 100 - 500).alias("c_acctbal"))


@BOOK.add("restore_dtypes", f"""WITH n AS (SELECT c_custkey, c_nationkey * 1.4e0 + {_NOISY} * 3 - 2 AS a,
        c_acctbal * 1.3e0 + {_NOISY} * 100 - 500 AS b FROM customer),
    r AS (SELECT min(c_nationkey) AS al, max(c_nationkey) AS ah, min(c_acctbal) AS bl, max(c_acctbal) AS bh FROM customer)
    SELECT c_custkey, round_even(least(greatest(a, al), ah), 0)::BIGINT AS c_nationkey,
    round(least(greatest(b, bl), bh), {_PLACES}) AS c_acctbal FROM n, r""")
def restore_dtypes(spark, folder):
    real = table(spark, folder, "customer")
    facts = numeric_facts(real, ["c_nationkey", "c_acctbal"])
    places = transforms.decimal_places(real, ["c_acctbal"])
    return transforms.restore_types(_noisy_customers(spark, folder), facts, places)


_BROKEN = """(SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'inf'::DOUBLE WHEN event_id % 13 = 0 THEN NULL
    ELSE value END AS value FROM events)"""


@BOOK.add("safe_int", f"""SELECT event_id, round_even(coalesce(CASE WHEN isinf(value) THEN NULL ELSE value END,
    (SELECT quantile_cont(value, 0.5) FROM {_BROKEN} WHERE NOT isinf(value))), 0)::BIGINT AS value FROM {_BROKEN}""")
def safe_int(spark, folder):
    broken = F.when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).when(F.col("event_id") % 13 == 0, None).otherwise(F.col("value"))
    rows = table(spark, folder, "events").select("event_id", broken.alias("value"))
    return transforms.safe_integer(rows, ["value"])


_DOMAIN = """(SELECT p_partkey, p_size AS age, p_size AS mileage, p_size / 50e0 AS ratio, p_retailprice AS price,
    p_size AS item_count, p_retailprice / 7 AS discount, cast(p_size > 25 AS INTEGER) AS flag, p_size - 30 AS shift FROM part)"""


def _stretched(c: str) -> str:
    return f"({c} * 3e0 - 20)"


@BOOK.add("domain_constraints", f"""WITH r AS {_DOMAIN},
    f AS (SELECT min(age) AS lo, max(age) AS hi, stddev_samp(age) AS sd, stddev_samp(discount) AS dsd, min(discount) AS dlo,
        max(discount) AS dhi, min(shift) AS slo, max(shift) AS shi FROM r)
    SELECT p_partkey, round_even(least(greatest({_stretched('age')}, greatest(1, lo)), least(150, hi + sd)), 0)::BIGINT AS age,
    round_even(least(greatest({_stretched('mileage')}, greatest(0, lo - 3 * sd)), hi + 3 * sd), 0)::BIGINT AS mileage,
    round(least(greatest({_stretched('ratio')}, 0), 1), 6) AS ratio, round(greatest({_stretched('price')}, 0), 6) AS price,
    round_even(greatest({_stretched('item_count')}, 0), 0)::BIGINT AS item_count,
    round(least(greatest({_stretched('discount')}, greatest(0, dlo - 3 * dsd)), dhi + 3 * dsd), 6) AS discount,
    round(least(greatest({_stretched('flag')}, 0), 1), 6) AS flag,
    round_even(least(greatest({_stretched('shift')}, slo - 3 * sd), shi + 3 * sd), 0)::BIGINT AS shift FROM r, f""")
def domain_constraints(spark, folder):
    """Whole name parts decide, so mileage is no age and discount no count."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    real = table(spark, folder, "part").select(
        "p_partkey", size.alias("age"), size.alias("mileage"), (size / 50.0).alias("ratio"), price.alias("price"),
        size.alias("item_count"), (price / 7).alias("discount"), (size > 25).cast("int").alias("flag"),
        (size - 30).alias("shift"))
    names = [c for c in real.columns if c != "p_partkey"]
    stretched = real.withColumns({c: F.col(c) * 3.0 - 20 for c in names})
    fixed = transforms.domain_constraints(stretched, numeric_facts(real, names))
    return _rounded(fixed, "ratio", "price", "discount", "flag")
