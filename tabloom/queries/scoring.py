"""Queries of realism scores, distribution and correlation comparison, and ML readiness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tabloom.functions.small import small_frame
from tabloom.operators import readiness, scoring
from tabloom.operators.profile import profile_table
from tabloom.queries.common import (COLUMNS, DIRTY, OTHER_HALF, REAL_HALF, ROW_KEYS, Book, dirty_orders, facts_sql,
                                    halves, table, union_sql, unit_sql)

BOOK = Book()
SCORED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "rev", "big"]


def _pairs(spark, folder):
    """The two halves, and lineitem against its rows of small quantity."""
    a, b = halves(spark, folder)
    lines = table(spark, folder, "lineitem").select(*SCORED[:4])
    return {"halves": (a.select(*SCORED), b.select(*SCORED)), "truncated": (lines, lines.where("l_quantity <= 25"))}


_PAIR_SQL = {"halves": (REAL_HALF, OTHER_HALF, SCORED),
             "truncated": ("lineitem", "(SELECT * FROM lineitem WHERE l_quantity <= 25)", SCORED[:4])}


def _moments(rel: str, columns) -> str:
    return union_sql([f"""SELECT '{c}' AS "column", avg({c}) AS m, stddev_samp({c}) AS s, min({c}) AS lo, max({c}) AS hi FROM {rel}"""
                      for c in columns])


def _paired(pair: str) -> str:
    real, synth, columns = _PAIR_SQL[pair]
    return f"""(SELECT r."column", r.m AS rm, r.s AS rs, r.lo AS rlo, r.hi AS rhi, s.m AS sm, s.s AS ss, s.lo AS slo, s.hi AS shi
        FROM ({_moments(real, columns)}) r JOIN ({_moments(synth, columns)}) s USING ("column"))"""


def _over_pairs(spark, folder, score):
    parts = [score(*p).withColumn("pair", F.lit(n)) for n, p in _pairs(spark, folder).items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@BOOK.add("statistical_similarity", union_sql([
    f"""SELECT '{p}' AS pair, round(avg((greatest(0, 1 - abs(rm - sm) / abs(rm)) + greatest(0, 1 - abs(rs - ss) / abs(rs))) / 2) * 100, 1)
        AS statistical_score FROM {_paired(p)}""" for p in _PAIR_SQL]))
def statistical_similarity(spark, folder):
    return _over_pairs(spark, folder, scoring.statistical_similarity)


@BOOK.add("coverage", union_sql([
    f"""SELECT '{p}' AS pair, round(avg(CASE WHEN rhi = rlo THEN 1 ELSE greatest(0, least(rhi, shi) - greatest(rlo, slo)) / (rhi - rlo) END) * 100, 1)
        AS coverage_score FROM {_paired(p)}""" for p in _PAIR_SQL]))
def coverage(spark, folder):
    return _over_pairs(spark, folder, scoring.coverage)


@BOOK.add("column_quality", union_sql([
    f"""SELECT '{p}' AS pair, "column", md AS mean_diff_pct, sd AS std_diff_pct, round(raw, 1) AS score,
        CASE WHEN raw >= 80 THEN 'Excellent' WHEN raw >= 60 THEN 'Good' WHEN raw >= 40 THEN 'Fair' ELSE 'Poor' END AS grade
        FROM (SELECT *, greatest(0, 100 - (md + sd) / 2) AS raw FROM (SELECT "column", round(abs(rm - sm) / abs(rm) * 100, 1) AS md,
        round(abs(rs - ss) / abs(rs) * 100, 1) AS sd FROM {_paired(p)}))""" for p in _PAIR_SQL]))
def column_quality(spark, folder):
    return _over_pairs(spark, folder, scoring.column_quality)


@BOOK.add("distinguishability")
def distinguishability(spark, folder):
    """About 100 for two halves of one table, low for a truncated one."""
    a, b = halves(spark, folder)
    cut = a.withColumn("rev", F.col("rev") * 1.5)
    scores = [(n, scoring.distinguishability(a, s.drop("price_cents"), real_keys=ROW_KEYS, synthetic_keys=ROW_KEYS[:4]))
              for n, s in (("halves", b), ("shifted", cut))]
    return small_frame(spark, scores, "pair string, distinguishability_score double")


_SCORES = """(SELECT c_custkey, cast(c_custkey * 7 % 101 AS DOUBLE) AS distinguishability_score,
    cast(c_custkey * 13 % 101 AS DOUBLE) AS statistical_score, cast(c_custkey * 29 % 101 AS DOUBLE) AS coverage_score,
    c_nationkey % 2 = 0 AS is_imbalanced, c_nationkey / 24e0 AS imbalance_ratio FROM customer)"""
_REALISM = f"""(SELECT *, round(distinguishability_score * 0.2e0 + statistical_score * 0.5e0 + coverage_score * 0.3e0, 1) AS final_score FROM {_SCORES})"""


def _score_rows(spark, folder):
    """Scores spread over their whole range, taken from the customers' keys."""
    def spread(k):
        return (F.col("c_custkey") * k % 101).cast("double")

    return table(spark, folder, "customer").select(
        "c_custkey", spread(7).alias("distinguishability_score"), spread(13).alias("statistical_score"),
        spread(29).alias("coverage_score"), (F.col("c_nationkey") % 2 == 0).alias("is_imbalanced"),
        (F.col("c_nationkey") / 24.0).alias("imbalance_ratio"))


@BOOK.add("realism_score", f"""SELECT c_custkey, final_score,
    CASE WHEN final_score >= 80 THEN 'Excellent' WHEN final_score >= 60 THEN 'Good' ELSE 'Fair' END AS grade,
    CASE WHEN final_score >= 80 THEN 'green' WHEN final_score >= 60 THEN 'yellow' ELSE 'red' END AS color FROM {_REALISM}""")
def realism_score(spark, folder):
    return scoring.realism(_score_rows(spark, folder)).select("c_custkey", "final_score", "grade", "color")


@BOOK.add("score_diagnosis", f"""SELECT c_custkey, CASE WHEN final_score >= 80 THEN 'excellent' WHEN final_score >= 60 THEN 'good'
    WHEN is_imbalanced AND imbalance_ratio >= 0.9 THEN 'low: extreme class imbalance' WHEN coverage_score < 30 THEN 'low: poor coverage'
    WHEN statistical_score < 40 THEN 'low: distributions differ' ELSE 'fair' END AS verdict,
    CASE WHEN distinguishability_score < 60 THEN 'distinguishability' WHEN statistical_score < 60 THEN 'statistical similarity'
    WHEN coverage_score < 60 THEN 'coverage' ELSE 'none' END AS weakest FROM {_REALISM}""")
def score_diagnosis(spark, folder):
    return scoring.diagnosis(scoring.realism(_score_rows(spark, folder))).select("c_custkey", "verdict", "weakest")


# Distributions


def _histogram_sql(c: str) -> str:
    return f"""(WITH r AS (SELECT {c} AS x FROM {REAL_HALF}), s AS (SELECT {c} AS x FROM {OTHER_HALF}),
        e AS (SELECT min(x) AS lo, max(x) AS hi FROM (SELECT x FROM r UNION ALL SELECT x FROM s)),
        rb AS (SELECT least(floor((x - lo) / (hi - lo) * 20), 19)::INTEGER AS bin, count(*) AS n FROM r, e GROUP BY 1),
        sb AS (SELECT least(floor((x - lo) / (hi - lo) * 20), 19)::INTEGER AS bin, count(*) AS n FROM s, e GROUP BY 1)
        SELECT '{c}' AS "column", b.bin::INTEGER AS bin, round(lo + (hi - lo) / 20 * b.bin, 2) AS bin_start,
        round(coalesce(rb.n, 0) / (SELECT count(x) FROM r) * 100, 2) AS real_pct,
        round(coalesce(sb.n, 0) / (SELECT count(x) FROM s) * 100, 2) AS synth_pct,
        (SELECT round(avg(x), 3) FROM r) AS real_mean, (SELECT round(avg(x), 3) FROM s) AS synth_mean,
        (SELECT round(stddev_samp(x), 3) FROM r) AS real_std, (SELECT round(stddev_samp(x), 3) FROM s) AS synth_std
        FROM e, (SELECT unnest(range(20)) AS bin) b LEFT JOIN rb USING (bin) LEFT JOIN sb USING (bin))"""


@BOOK.add("distribution_numeric", union_sql([f"SELECT * FROM {_histogram_sql(c)}" for c in SCORED[:5]]))
def distribution_numeric(spark, folder):
    a, b = (h.select(*SCORED) for h in halves(spark, folder))
    return scoring.numeric_distributions(a, b)


def _share_sql(rel: str, c: str) -> str:
    return f"""(SELECT cast({c} AS VARCHAR) AS category, round(count(*) / (SELECT count({c}) FROM {rel}) * 100, 2) AS pct
        FROM {rel} WHERE {c} IS NOT NULL GROUP BY 1)"""


def _categories_sql(real: str, synth: str, columns) -> str:
    return union_sql([f"""SELECT '{c}' AS "column", category, r.pct AS real_pct, coalesce(s.pct, 0) AS synth_pct
        FROM {_share_sql(real, c)} r LEFT JOIN {_share_sql(synth, c)} s USING (category)""" for c in columns])


@BOOK.add("distribution_binary", _categories_sql(REAL_HALF, OTHER_HALF, ["big"]))
def distribution_binary(spark, folder):
    a, b = (h.select(*SCORED) for h in halves(spark, folder))
    return scoring.binary_distributions(a, b)


_CHANGED = """(SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority
    FROM orders WHERE o_orderstatus <> 'P')"""


@BOOK.add("distribution_categorical", _categories_sql("orders", _CHANGED, ["o_orderstatus", "o_orderpriority"]))
def distribution_categorical(spark, folder):
    """One real category is missing on the other side, which has one of its own."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    changed = orders.where("o_orderstatus <> 'P'").withColumn(
        "o_orderstatus", F.when(F.col("o_orderkey") % 50 == 0, "new").otherwise(F.col("o_orderstatus")))
    return scoring.categorical_distributions(orders.drop("o_orderkey"), changed.drop("o_orderkey"))


def _correlation_sql() -> str:
    parts = []
    for i, a in enumerate(SCORED):
        for b in SCORED[i + 1:]:
            parts.append(f"""SELECT '{a}' AS a, '{b}' AS b, (SELECT round(corr({a}, {b}), 3) FROM {REAL_HALF}) AS real,
                (SELECT round(corr({a}, {b}), 3) FROM {OTHER_HALF}) AS synth""")
    return f"SELECT *, round(abs(real - synth), 3) AS diff FROM ({union_sql(parts)})"


@BOOK.add("correlation_compare", _correlation_sql())
def correlation_compare(spark, folder):
    a, b = (h.select(*SCORED) for h in halves(spark, folder))
    return scoring.correlations(a, b)


def _wide_sql(k: int) -> str:
    return f"((l_orderkey * {k + 1} + l_partkey) % {k + 11}) * 1e0 + l_quantity * {k % 7}"


_WIDE = 300
_WIDE_PAIRS = [(0, 1), (0, 299), (6, 13), (255, 256), (254, 298), (256, 263), (298, 299)]


@BOOK.add("correlation_wide", union_sql([f"""SELECT 'x{i}' AS a, 'x{j}' AS b, r AS real, s AS synth, round(abs(r - s), 3) AS diff FROM
    (SELECT round(corr({_wide_sql(i)}, {_wide_sql(j)}), 3) AS r FROM {REAL_HALF}), (SELECT round(corr({_wide_sql(i)}, {_wide_sql(j)}), 3) AS s FROM {OTHER_HALF})"""
    for i, j in _WIDE_PAIRS]))
def correlation_wide(spark, folder):
    """Three hundred columns, made in strips; a few of all pairs are compared."""
    a, b = (half.select(*[F.expr(_wide_sql(k)).alias(f"x{k}") for k in range(_WIDE)]) for half in halves(spark, folder))
    wanted = [(F.col("a") == f"x{i}") & (F.col("b") == f"x{j}") for i, j in _WIDE_PAIRS]
    return scoring.correlations(a, b).where(reduce(lambda x, y: x | y, wanted))


@BOOK.add("correlation_summary", f"""SELECT avg_diff, CASE WHEN avg_diff < 0.1 THEN 'Excellent' WHEN avg_diff < 0.2 THEN 'Good'
    WHEN avg_diff < 0.3 THEN 'Fair' ELSE 'Poor' END AS grade FROM (SELECT round(avg(diff), 3) AS avg_diff FROM ({_correlation_sql()}))""")
def correlation_summary(spark, folder):
    return scoring.correlation_summary(correlation_compare(spark, folder))


# ML readiness

_LEARN = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "big"]


_FEATURES = """l_orderkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, cast(l_returnflag = 'N' AS DOUBLE) AS "l_returnflag_N",
    cast(l_returnflag = 'R' AS DOUBLE) AS "l_returnflag_R" """


@BOOK.add("prepare_features", f"""SELECT {_FEATURES}, 0e0 AS "l_returnflag_new" FROM {REAL_HALF}
    UNION ALL SELECT {_FEATURES.replace("l_returnflag =", "l_partkey % 9 <> 0 AND l_returnflag =")}, cast(l_partkey % 9 = 0 AS DOUBLE) FROM {OTHER_HALF}""")
def prepare_features(spark, folder):
    """Both sides, one of which has a category of its own."""
    a, b = halves(spark, folder)
    b = b.withColumn("l_returnflag", F.when(F.col("l_partkey") % 9 == 0, "new").otherwise(F.col("l_returnflag")))
    made = readiness.feature_columns(a.select(*_LEARN), b.select(*_LEARN), "big")
    return a.unionByName(b).select("l_orderkey", "l_partkey", *[x.alias(n) for n, x in made.items()])


@BOOK.add("encode_labels", """SELECT value, cast(row_number() OVER (ORDER BY value) - 1 AS DOUBLE) AS label FROM (
    SELECT o_orderstatus AS value FROM orders UNION SELECT 'new' FROM orders)""")
def encode_labels(spark, folder):
    """Labels over the union of both tables, one of which has a class of its own."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    changed = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 50 == 0, "new").otherwise(F.col("o_orderstatus")))
    return readiness.label_index(orders, changed, "o_orderstatus")


@BOOK.add("encode_many_labels", """SELECT value, cast(row_number() OVER (ORDER BY value) - 1 AS DOUBLE) AS label FROM (
    SELECT DISTINCT cast(o_custkey AS VARCHAR) AS value FROM orders)""")
def encode_many_labels(spark, folder):
    """Far more than a hundred labels."""
    orders = table(spark, folder, "orders").select("o_custkey")
    return readiness.label_index(orders, orders, "o_custkey")


@BOOK.add("stratified_split", f"""SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {unit_sql(42, 'split', 'o_orderkey')}, o_orderkey)
    <= round(count(*) OVER (PARTITION BY o_orderstatus) * 0.3e0) AS is_test FROM orders""")
def stratified_split(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return readiness.stratified_split(orders, "o_orderstatus", ["o_orderkey"])


_PICKS = {"labels": "labels", "lineitem": "lineitem", "dirty": DIRTY}


@BOOK.add("pick_tstr_target", union_sql([
    f"""SELECT '{n}' AS table_name, (SELECT "column" FROM ({facts_sql(rel, COLUMNS[n])}) WHERE num_unique = 2 ORDER BY ordinal LIMIT 1) AS target"""
    for n, rel in _PICKS.items()]))
def pick_tstr_target(spark, folder):
    rows = []
    for n in _PICKS:
        df = dirty_orders(spark, folder) if n == "dirty" else table(spark, folder, n)
        unique = {r["column"]: r["num_unique"] for r in profile_table(df).rows}
        rows.append((n, readiness.pick_target(df, unique)))
    return small_frame(spark, rows, "table_name string, target string")


def _tstr(spark, folder, target: str, regression: bool):
    a, b = halves(spark, folder)
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", target]
    return readiness.tstr(a.select(*ROW_KEYS, *columns), b.select(*columns), target, ROW_KEYS, regression)


@BOOK.add("tstr_classification")
def tstr_classification(spark, folder):
    return _tstr(spark, folder, "big", False)


@BOOK.add("tstr_regression")
def tstr_regression(spark, folder):
    return _tstr(spark, folder, "rev", True)


@BOOK.add("tstr_inconclusive")
def tstr_inconclusive(spark, folder):
    """A target the features say nothing about."""
    return _tstr(spark, folder, "l_linestatus", False)


@BOOK.add("tstr_properties", """SELECT kind, true AS available, true AS close, true AS scored FROM (VALUES ('classification'), ('regression')) v(kind)""")
def tstr_properties(spark, folder):
    """The other half of a table trains as well as the first: the scores are within 6 points and far above guessing."""
    parts = [r.select(F.lit(kind).alias("kind"), "available", (F.abs("gap") <= 6).alias("close"), (F.col("real_score") > 60).alias("scored"))
             for kind, r in (("classification", tstr_classification(spark, folder)), ("regression", tstr_regression(spark, folder)))]
    return parts[0].unionByName(parts[1])


@BOOK.add("distinguishability_properties", "SELECT true AS alike, true AS apart")
def distinguishability_properties(spark, folder):
    """Two halves of the customers cannot be told apart; customers with other balances can."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    odd, even = customers.where("c_custkey % 2 = 1"), customers.where("c_custkey % 2 = 0")
    alike = scoring.distinguishability(odd, even, 42, ["c_custkey"], ["c_custkey"])
    apart = scoring.distinguishability(odd, even.withColumn("c_acctbal", F.col("c_acctbal") + 20000), 42, ["c_custkey"], ["c_custkey"])
    return small_frame(spark, [(alike >= 80, apart <= 20)], "alike boolean, apart boolean")


@BOOK.add("grade_tstr", """WITH s AS (SELECT p_partkey, p_size % 2 = 0 AS is_regression, p_size * 2e0 AS real_score,
        cast(p_partkey % 101 AS DOUBLE) AS synth_score, cast(p_partkey % 60 AS DOUBLE) AS majority_rate FROM part),
    g AS (SELECT *, round(real_score - synth_score, 1) AS gap, round(abs(real_score - synth_score) / real_score * 100, 1) AS gap_pct,
        CASE WHEN is_regression THEN real_score < 10 ELSE real_score <= majority_rate + 2 END AS weak FROM s)
    SELECT p_partkey, gap, gap_pct, CASE WHEN weak THEN 'Inconclusive' WHEN synth_score > real_score OR gap_pct <= 10 THEN 'Excellent'
        WHEN gap_pct <= 20 THEN 'Good' WHEN gap_pct <= 35 THEN 'Fair' ELSE 'Poor' END AS grade,
        CASE WHEN weak THEN 'neutral' WHEN synth_score > real_score OR gap_pct <= 10 THEN 'green' WHEN gap_pct <= 35 THEN 'yellow'
        ELSE 'red' END AS color, synth_score <= 30 AS low_signal FROM g""")
def grade_tstr(spark, folder):
    """Scores spread over the parts, graded like results of a run."""
    size, key = F.col("p_size"), F.col("p_partkey")
    rows = table(spark, folder, "part").select(
        "p_partkey", F.lit(True).alias("available"), F.lit(None).cast("string").alias("reason"), (size % 2 == 0).alias("is_regression"),
        (size * 2.0).alias("real_score"), (key % 101).cast("double").alias("synth_score"), (key % 60).cast("double").alias("majority_rate"))
    return readiness.graded(rows).select("p_partkey", "gap", "gap_pct", "grade", "color", "low_signal")
