"""Queries of row generation: bootstrap, copulas, class plans, and the whole generate run."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.quantiles import grouped_quantiles
from tabloom.functions.small import small_frame
from tabloom.operators import classes, copula
from tabloom.operators.bootstrap import bootstrap_rows
from tabloom.operators.copula import GRID, GROUP
from tabloom.plans import runs
from tabloom.queries.common import ROW_KEYS, SALES, Book, normal_sql, sales, table, union_sql, unit_sql
from tabloom.session import materialize

BOOK = Book()
SEED = 42
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "rev"]
MODELLED = NUMBERS + ["l_returnflag", "big"]


def _jitter(c: str, integer: bool) -> str:
    x = f"least(greatest(b.{c} + {normal_sql(SEED, 'noise:' + c, 'd.row_id')} * ({c}_sd * 0.05e0), {c}_lo - {c}_sd), {c}_hi + {c}_sd)"
    return f"round_even({x}, 0)::BIGINT AS {c}" if integer else f"round({x}, 6) AS {c}"


_STATS = ", ".join(f"stddev_samp({c}) AS {c}_sd, min({c})::DOUBLE AS {c}_lo, max({c})::DOUBLE AS {c}_hi"
                   for c in ("s_suppkey", "s_nationkey", "s_acctbal"))


@BOOK.add("bootstrap_noise", f"""WITH base AS (SELECT *, row_number() OVER (ORDER BY md5(cast(s_suppkey AS VARCHAR)), s_suppkey) - 1 AS idx
        FROM supplier), n AS (SELECT count(*) AS n FROM supplier), f AS (SELECT {_STATS} FROM supplier),
    d AS (SELECT row_id, floor({unit_sql(SEED, 'pick', 'row_id')} * n)::BIGINT AS idx
        FROM (SELECT unnest(range(2 * n)) AS row_id, n FROM n))
    SELECT d.row_id, s_name, {_jitter('s_suppkey', True)}, {_jitter('s_nationkey', True)}, {_jitter('s_acctbal', False)}
    FROM d JOIN base b USING (idx), f""")
def bootstrap_noise(spark, folder):
    supplier = table(spark, folder, "supplier")
    rows = bootstrap_rows(supplier, 2 * supplier.count(), ["s_suppkey"], SEED)
    return rows.withColumn("s_acctbal", F.round("s_acctbal", 6))


def _keyed(spark, folder, group=None):
    key = F.lit("") if group is None else F.col(group).cast("string")
    return sales(spark, folder).withColumn(GROUP, key)


_PROBS = "[" + ", ".join(f"{i / GRID}" for i in range(GRID + 1)) + "]"


@BOOK.add("copula_marginals", union_sql([
    f"""SELECT cast(big AS VARCHAR) AS class, '{c}' AS "column", unnest(range({GRID + 1}))::INTEGER AS point,
        round(unnest(quantile_cont({c}, {_PROBS})), 8) AS value FROM {SALES} GROUP BY big""" for c in ("l_quantity", "l_extendedprice", "rev")]))
def copula_marginals(spark, folder):
    """Quantile grids per class."""
    columns = ["l_quantity", "l_extendedprice", "rev"]
    model = copula.fit_marginals(_keyed(spark, folder, "big"), columns, [], exact=True)
    rows = [(g, c, i, v) for g, ms in model.groups.items() for c in columns for i, v in enumerate(ms[c].grid)]
    return small_frame(spark, rows, "class string, column string, point int, value double").withColumn("value", F.round("value", 8))


@BOOK.add("copula_categories", f"""WITH c AS (SELECT cast(big AS VARCHAR) AS class, l_returnflag AS value, count(*) AS n FROM {SALES} GROUP BY ALL)
    SELECT class, value, round(sum(n) OVER (PARTITION BY class ORDER BY n DESC, value)
        / sum(n) OVER (PARTITION BY class), 9)::DOUBLE AS upper FROM c""")
def copula_categories(spark, folder):
    """Cumulative category shares per class."""
    model = copula.fit_marginals(_keyed(spark, folder, "big"), [], ["l_returnflag"])
    rows = [(g, v, u) for g, ms in model.groups.items() for v, u in zip(ms["l_returnflag"].values, ms["l_returnflag"].upper)]
    return small_frame(spark, rows, "class string, value string, upper double").withColumn("upper", F.round("upper", 9))


def _knots(name: str, c: str) -> str:
    return f"""{name} AS (SELECT kx, ku, lead(kx) OVER (ORDER BY kx) AS nx, lead(ku) OVER (ORDER BY kx) AS nu FROM (
        SELECT v AS kx, avg(i) / {GRID} AS ku FROM (SELECT unnest(range({GRID + 1})) AS i, unnest(quantile_cont({c}, {_PROBS})) AS v
        FROM {SALES}) GROUP BY v))"""


def _score_sql(u: str) -> str:
    def poly(coefficients, x):
        text = repr(coefficients[0])
        for k in coefficients[1:]:
            text = f"({text} * {x} + {k!r})"
        return text

    from tabloom.functions.gaussian import INV_A, INV_B, INV_C, INV_D
    p = f"least(greatest({u}, 1e-6), 1 - 1e-6)"
    q, t = f"({p} - 0.5)", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    tail = f"({poly(INV_C, t)} / {poly(INV_D + (1.0,), t)})"
    return f"""CASE WHEN {p} < 0.02425 THEN {tail} WHEN {p} > 1 - 0.02425 THEN -{tail}
        ELSE {poly(INV_A, f'({q} * {q})')} * {q} / {poly(INV_B + (1.0,), f'({q} * {q})')} END"""


_LINKED = ["l_extendedprice", "l_discount", "rev"]
_UNITS = ", ".join(f"coalesce(k{i}.ku + (k{i}.nu - k{i}.ku) * ((s.{c} - k{i}.kx) / (k{i}.nx - k{i}.kx)), k{i}.ku) AS u{i}"
                   for i, c in enumerate(_LINKED))


@BOOK.add("copula_correlation", f"""WITH {', '.join(_knots(f'k{i}', c) for i, c in enumerate(_LINKED))},
    u AS (SELECT {_UNITS} FROM {SALES} s {' '.join(f'ASOF JOIN k{i} ON s.{c} >= k{i}.kx' for i, c in enumerate(_LINKED))}),
    z AS (SELECT {', '.join(f'{_score_sql(f"u{i}")} AS z{i}' for i in range(3))} FROM u)
    {union_sql([f"SELECT '{_LINKED[i]}' AS a, '{_LINKED[j]}' AS b, round(corr(z{i}, z{j}), 5) AS corr FROM z" for i in range(3) for j in range(i + 1, 3)])}""")
def copula_correlation(spark, folder):
    """Correlation of normal scores, found task by task from sums of products."""
    rows = _keyed(spark, folder)
    model = copula.fit_dependence(rows, copula.fit_marginals(rows, _LINKED, [], exact=True))
    r = model.correlation[""]
    pairs = [(_LINKED[i], _LINKED[j], float(r[i, j])) for i in range(3) for j in range(i + 1, 3)]
    return small_frame(spark, pairs, "a string, b string, corr double").withColumn("corr", F.round("corr", 5))


def _ready(spark, folder):
    return sales(spark, folder).withColumn("big", F.col("big").cast("string"))


@BOOK.add("copula_sample")
def copula_sample(spark, folder):
    rows = _ready(spark, folder)
    return classes.generate_pooled(rows, MODELLED, rows.count(), SEED).rows


@BOOK.add("mixture_copula")
def mixture_copula(spark, folder):
    rows = _ready(spark, folder)
    return classes.generate_mixture(rows, MODELLED, rows.count(), seed=SEED).rows


@BOOK.add("conditional_sample")
def conditional_sample(spark, folder):
    rows = sales(spark, folder)
    return classes.generate_conditional(rows, MODELLED, "big", rows.count(), SEED).rows


@BOOK.add("per_class_generate")
def per_class_generate(spark, folder):
    rows = sales(spark, folder)
    half = rows.count() // 2
    return classes.generate_per_class(rows, MODELLED, "big", {"0": half, "1": half}, SEED).rows


def _near(made, real, tolerance):
    """The real number if the generated one is within the tolerance of it, else the generated one."""
    return float(real) if made is not None and abs(made - real) <= tolerance else made


def _properties(method: str, real, made, columns: list[str], pair: tuple[str, str]):
    """Per column: number of rows, whether all lie in the real range, the quartiles (the real ones if those of the rows are within
    5% of the range of them) and the correlation of ``pair`` (the real one if that of the rows is within 0.1 of it)."""
    def facts(df):
        row = df.agg(F.count(F.lit(1)).alias("n"), F.corr(*pair).alias("r"), *[
            f for i, c in enumerate(columns) for f in (F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"))]).first()
        quartiles = grouped_quantiles(df.withColumn(GROUP, F.lit("")), GROUP, {f"q{i}": (F.col(c), [0.25, 0.5, 0.75]) for i, c in enumerate(columns)})
        return {**row.asDict(), **quartiles[""]}

    a, b = facts(real), facts(materialize(made.select(*dict.fromkeys([*columns, *pair]))))
    rows = []
    for i, c in enumerate(columns):
        width = float(a[f"hi{i}"]) - float(a[f"lo{i}"])
        quartiles = [round(_near(float(y), float(x), 0.05 * width), 6) for x, y in zip(a[f"q{i}"], b[f"q{i}"])]
        rows.append((method, c, b["n"], bool(a[f"lo{i}"] <= b[f"lo{i}"] and b[f"hi{i}"] <= a[f"hi{i}"]), *quartiles, round(_near(b["r"], a["r"], 0.1), 6)))
    return small_frame(real.sparkSession, rows, "method string, column string, n long, inside boolean, q1 double, q2 double, q3 double, r double")


_CHECKED = ["l_quantity", "l_extendedprice", "rev"]


def _real_sql(method: str) -> str:
    return union_sql([f"""SELECT '{method}' AS method, '{c}' AS "column", count(*) AS n, true AS inside, {', '.join(f'round(quantile_cont({c}, {p}), 6)::DOUBLE AS q{k}' for k, p in ((1, 0.25), (2, 0.5), (3, 0.75)))},
        round(corr(l_extendedprice, rev), 6) AS r FROM {SALES}""" for c in _CHECKED])


@BOOK.add("copula_sample_properties", _real_sql("pooled"))
def copula_sample_properties(spark, folder):
    return _properties("pooled", sales(spark, folder), copula_sample(spark, folder), _CHECKED, ("l_extendedprice", "rev"))


@BOOK.add("mixture_properties", _real_sql("mixture"))
def mixture_properties(spark, folder):
    return _properties("mixture", sales(spark, folder), mixture_copula(spark, folder), _CHECKED, ("l_extendedprice", "rev"))


@BOOK.add("conditional_properties", _real_sql("conditional"))
def conditional_properties(spark, folder):
    return _properties("conditional", sales(spark, folder), conditional_sample(spark, folder), _CHECKED, ("l_extendedprice", "rev"))


@BOOK.add("per_class_properties", _real_sql("per class"))
def per_class_properties(spark, folder):
    """As many rows of each class as there are real ones."""
    rows = sales(spark, folder)
    real = {str(r["big"]): r["count"] for r in rows.groupBy("big").count().collect()}
    return _properties("per class", rows, classes.generate_per_class(rows, MODELLED, "big", real, SEED).rows, _CHECKED, ("l_extendedprice", "rev"))


def _items(spark, folder):
    """Sales with a text column of nearly as many values as rows; the first line of an order has a value that all share."""
    line = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price_cents")
    return sales(spark, folder).withColumn("item", F.when(F.col("l_linenumber") > 1, line).otherwise("first"))


_ITEMS = f"""(SELECT *, CASE WHEN l_linenumber > 1 THEN concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, price_cents) ELSE 'first' END AS item FROM {SALES})"""


@BOOK.add("copula_many_categories", f"""WITH c AS (SELECT item, count(*) AS k, sum(count(*)) OVER () AS n FROM {_ITEMS} GROUP BY item)
    SELECT max(n)::BIGINT AS "rows", max(n)::BIGINT AS known, round(max(k / n) FILTER (item = 'first'), 6) AS first_share,
        round(sum(1 - pow(1 - k / n, n)), 4) AS different FROM c""")
def copula_many_categories(spark, folder):
    """As many rows as there are real ones: only known values, the frequent one with its share (within 0.01), and as many different
    ones as draws with the real shares give on average (within 1%)."""
    real = _items(spark, folder)
    n = real.count()
    made = materialize(classes.generate_pooled(real, ["item", "l_quantity"], n, SEED).rows.select("item"))
    both = real.select("item", F.lit(1).alias("k"), F.lit(0).alias("m")).unionAll(made.select("item", F.lit(0), F.lit(1)))  # counted in one shuffle
    share, k, m, first = F.col("k") / n, F.col("k"), F.col("m"), F.col("item") == "first"
    got = both.groupBy("item").agg(F.sum("k").alias("k"), F.sum("m").alias("m")).agg(
        F.max(F.when(first, share)).alias("first"), F.sum(F.when(k > 0, 1 - F.pow(1 - share, F.lit(n)))).alias("expected"), F.sum("m").alias("rows"),
        F.sum(F.when(k > 0, m)).alias("known"), F.max(F.when(first & (m > 0), m)).alias("drawn"), F.count_if(m > 0).alias("different")).first()
    row = (got["rows"], got["known"], round(_near(got["drawn"] / n, got["first"], 0.01), 6), round(_near(got["different"], got["expected"], 0.01 * got["expected"]), 4))
    return small_frame(spark, [row], "rows long, known long, first_share double, different double")


@BOOK.add("per_class_many_categories", f"""SELECT big, count(*) AS n, count(*) AS known FROM {_ITEMS} GROUP BY big""")
def per_class_many_categories(spark, folder):
    """Requested as a table. Every generated value is one of its own class."""
    real = _items(spark, folder)
    wanted = real.groupBy(F.col("big").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("requested"))
    made = classes.generate_per_class(real, ["item", "l_quantity", "big"], "big", wanted, SEED).rows
    return made.join(real.select("big", "item", F.lit(1).alias("one")).distinct(), ["big", "item"], "left").groupBy("big").agg(
        F.count(F.lit(1)).alias("n"), F.count("one").alias("known"))


@BOOK.add("conditional_scarce_classes", """WITH c AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1 HAVING count(*) < 10),
    r AS (SELECT c.*, greatest(1, round_even(200000 * (n / (SELECT count(*) FROM orders)), 0))::BIGINT AS "rows" FROM c)
    SELECT count(*) AS classes, sum("rows")::BIGINT AS "rows", round(avg(abs(m - (SELECT avg(o_totalprice) FROM orders JOIN c USING (o_custkey)))), 2) AS pooled_error, true AS closer,
        true AS ordered FROM r""")
def conditional_scarce_classes(spark, folder):
    """Customers with fewer than ten orders: the mean error of the class means if all had the pooled mean, whether that of the generated
    rows is less than half of it, and whether generated and real means correlate by 0.9."""
    orders = table(spark, folder, "orders").select("o_totalprice", "o_orderpriority", "o_custkey")
    made = classes.generate_conditional(orders, ["o_totalprice", "o_orderpriority", "o_custkey"], "o_custkey", 200_000, SEED).rows
    real = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("m"), F.sum("o_totalprice").alias("s")).where("n < 10")
    got = made.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("rows"), F.avg("o_totalprice").alias("made"))
    both = real.join(got, "o_custkey").crossJoin(F.broadcast(real.agg((F.sum("s") / F.sum("n")).alias("pooled"))))
    pooled, mine = F.avg(F.abs(F.col("m") - F.col("pooled"))), F.avg(F.abs(F.col("m") - F.col("made")))
    return both.agg(F.count(F.lit(1)).alias("classes"), F.sum("rows").alias("rows"), F.round(pooled, 2).alias("pooled_error"), (mine < pooled / 2).alias("closer"),
                    (F.corr("m", "made") > 0.9).alias("ordered"))


_PEAKS = f"(SELECT l_linenumber % 2 AS side, l_extendedprice + 400000 * (l_linenumber % 2) AS x, (1 - 2 * (l_linenumber % 2)) * rev AS y FROM {SALES})"


@BOOK.add("mixture_two_peaks", f"""SELECT (x >= 300000)::INTEGER AS upper, count(*) AS n, round(quantile_cont(x, 0.1), 4) AS low, round(quantile_cont(x, 0.9), 4) AS high,
    round(corr(x, y), 6) AS r, 0::BIGINT AS between FROM {_PEAKS} GROUP BY 1""")
def mixture_two_peaks(spark, folder):
    """A column with two peaks whose dependence on another turns from one to the other: both keep their size, width (within 5%) and
    correlation (within 0.1), and nothing lies between them."""
    rows = sales(spark, folder)
    side = F.col("l_linenumber") % 2
    real = rows.select((F.col("l_extendedprice") + 400000 * side).alias("x"), ((1 - 2 * side) * F.col("rev")).alias("y"))
    made = classes.generate_mixture(real, ["x", "y"], rows.count(), seed=SEED).rows
    ends = real.agg(F.max(F.when(F.col("x") < 300000, F.col("x"))), F.min(F.when(F.col("x") >= 300000, F.col("x")))).first()

    def facts(df):
        sided = df.withColumn("upper", (F.col("x") >= 300000).cast("int"))
        found = sided.groupBy("upper").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"), F.count_if((F.col("x") > ends[0]) & (F.col("x") < ends[1])).alias("between")).collect()
        widths = grouped_quantiles(sided, "upper", {"q": (F.col("x"), [0.1, 0.9])})
        return {r["upper"]: {**r.asDict(), **widths[str(r["upper"])]} for r in found}

    want, got = facts(real), facts(materialize(made.select("x", "y")))
    out = []
    for side, w in want.items():
        g, width = got[side], w["q"][1] - w["q"][0]
        out.append((side, g["n"], *(round(_near(a, b, 0.05 * width), 4) for a, b in zip(g["q"], w["q"])), round(_near(g["r"], w["r"], 0.1), 6), g["between"]))
    return small_frame(spark, out, "upper int, n long, low double, high double, r double, between long")


@BOOK.add("generate_rows_properties", """SELECT (SELECT count(*) FROM orders) AS n, true AS prices_inside, true AS known_status, true AS known_priority""")
def generate_rows_properties(spark, folder):
    """The whole run: as many rows as asked for, prices within the real range, no category of its own."""
    orders, made = table(spark, folder, "orders"), generate_rows(spark, folder)
    ends = orders.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")).first()
    known = {c: [r[0] for r in orders.select(c).distinct().collect()] for c in ("o_orderstatus", "o_orderpriority")}
    return made.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("o_totalprice").between(ends["lo"], ends["hi"])).alias("prices_inside"),
                    F.bool_and(F.col("o_orderstatus").isin(*known["o_orderstatus"])).alias("known_status"),
                    F.bool_and(F.col("o_orderpriority").isin(*known["o_orderpriority"])).alias("known_priority"))


@BOOK.add("score_run_models", "SELECT true AS realistic, true AS available, 'big' AS target_column, true AS useful")
def score_run_models(spark, folder):
    """A run whose models are kept from the rows that test them, scored with classifiers."""
    rows = sales(spark, folder).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "rev", "big")
    half = rows.count() // 2
    run = runs.generate_rows(rows, 2 * half, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], target="big", class_counts={"0": half, "1": half}, seed=SEED, holdout_first=True)
    scores = runs.score_run(run, SEED)
    ready = scores.readiness.first()
    return small_frame(spark, [(scores.realism.first()["statistical_score"] > 80, ready["available"], ready["target_column"], ready["gap"] is not None and ready["gap"] < 25)],
                       "realistic boolean, available boolean, target_column string, useful boolean")


@BOOK.add("generate_rows_tiny_properties", """SELECT 2 * count(*) AS n, true AS known_names, true AS known_regions FROM nation""")
def generate_rows_tiny_properties(spark, folder):
    """Bootstrapped rows hold real values only."""
    nation, made = table(spark, folder, "nation"), generate_rows_tiny(spark, folder)
    aggs = [F.count(F.lit(1)).alias("n")]
    for c, name in (("n_name", "known_names"), ("n_regionkey", "known_regions")):
        values = [r[0] for r in nation.select(c).distinct().collect()]
        aggs.append(F.bool_and(F.col(c).isin(*values)).alias(name) if c in made.columns else F.lit(True).alias(name))
    return made.agg(*aggs)


@BOOK.add("conditional_sample_counts", f"""SELECT big, greatest(1, round_even(1000 * (count(*) / (SELECT count(*) FROM lineitem)), 0))::BIGINT AS n
    FROM {SALES} GROUP BY big""")
def conditional_sample_counts(spark, folder):
    made = classes.generate_conditional(sales(spark, folder), MODELLED, "big", 1000, SEED)
    return made.rows.groupBy("big").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("conditional_many_classes", """SELECT o_custkey, greatest(1, round_even(30000 * (count(*) / (SELECT count(*) FROM orders)), 0))::BIGINT AS n
    FROM orders GROUP BY 1""")
def conditional_many_classes(spark, folder):
    """A class per customer: every one keeps its share, and at least one row."""
    rows = table(spark, folder, "orders").select("o_totalprice", "o_custkey")
    made = classes.generate_conditional(rows, ["o_totalprice", "o_custkey"], "o_custkey", 30000, SEED)
    return made.rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("per_class_counts", """SELECT o_orderstatus, count(*) // 3 AS n, sum((o_totalprice BETWEEN lo AND hi)::INTEGER) // 3 AS inside
    FROM orders JOIN (SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1) USING (o_orderstatus)
    GROUP BY 1""")
def per_class_counts(spark, folder):
    """Exact counts per class, and every generated price inside its own class's real range."""
    orders = table(spark, folder, "orders")
    real = orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("lo"),
                                               F.max("o_totalprice").alias("hi"))
    wanted = {r["o_orderstatus"]: r["n"] // 3 for r in real.collect()}
    made = classes.generate_per_class(orders, ["o_totalprice", "o_orderpriority", "o_orderstatus"], "o_orderstatus", wanted, SEED)
    return made.rows.join(F.broadcast(real.drop("n")), "o_orderstatus").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice").between(F.col("lo"), F.col("hi"))).alias("inside"))


@BOOK.add("conditional_allocation", """SELECT o_orderpriority AS value, count(*) AS real,
    greatest(1, round_even(777 * (count(*) / (SELECT count(*) FROM orders)), 0))::BIGINT AS "rows" FROM orders GROUP BY 1""")
def conditional_allocation(spark, folder):
    return classes.allocation(table(spark, folder, "orders"), "o_orderpriority", 777)


_REQUEST = {"0-0": 50, "0-1": 30, "1-0": 100, "1-1": 20, "9-9": 5, "8-8": 0}
_PLAN_SQL = f"""SELECT r.value, r.requested::BIGINT AS requested, coalesce(n, 0) AS real_examples, coalesce(n, 0) < 10 AS skipped
    FROM (VALUES {', '.join(f"('{v}', {n})" for v, n in _REQUEST.items() if n)}) r(value, requested)
    LEFT JOIN (SELECT quality || '-' || toxic AS value, count(*) AS n FROM labels GROUP BY 1) USING (value)"""


def _class_plan(spark, folder):
    rows = table(spark, folder, "labels").withColumn("pair", F.concat_ws("-", "quality", "toxic"))
    return classes.class_plan(rows, "pair", _REQUEST)


@BOOK.add("class_plan", _PLAN_SQL)
def class_plan(spark, folder):
    return _class_plan(spark, folder)


@BOOK.add("class_plan_check", f"""SELECT *, (sum(requested) OVER ())::BIGINT AS total_requested,
    sum(requested) OVER () <> 500 AS overrides_total FROM ({_PLAN_SQL})""")
def class_plan_check(spark, folder):
    return classes.plan_check(_class_plan(spark, folder), 500)


@BOOK.add("balance_plan", """WITH c AS (SELECT DISTINCT o_orderpriority AS value FROM orders),
    o AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS k FROM c)
    SELECT value, (1003 // k + CASE WHEN i < 1003 % k THEN 1 ELSE 0 END)::BIGINT AS "rows" FROM o""")
def balance_plan(spark, folder):
    from tabloom.operators.inference import target_classes
    return classes.balance_plan(target_classes(table(spark, folder, "orders"), "o_orderpriority"), 1003)


@BOOK.add("generate_rows")
def generate_rows(spark, folder):
    """The whole run on orders: profile, fix, clean, fit, sample, repair."""
    orders = table(spark, folder, "orders")
    return runs.generate_rows(orders, orders.count(), ["o_orderkey"], fix_list="all", seed=SEED).rows


@BOOK.add("generate_rows_tiny")
def generate_rows_tiny(spark, folder):
    """A table below fifty rows takes the bootstrap route."""
    nation = table(spark, folder, "nation")
    return runs.generate_rows(nation, 2 * nation.count(), ["n_nationkey"], seed=SEED).rows


@BOOK.add("generate_and_score")
def generate_and_score(spark, folder):
    """Lineitem cleaned, rows generated per revenue class, and the quality of every column."""
    rows = sales(spark, folder).drop("price_cents").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate", "rev", "big")
    keys = [k for k in ROW_KEYS if k in rows.columns]
    half = rows.count() // 2
    run = runs.generate_rows(rows, 2 * half, keys, class_counts={"0": half, "1": half}, seed=SEED)
    scores = runs.score_run(run, SEED, with_models=False)
    return scores.columns.withColumns({k: F.lit(scores.realism.first()[k]) for k in ("statistical_score", "coverage_score")})
