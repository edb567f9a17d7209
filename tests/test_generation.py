import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabloom.functions import draws, gaussian
from tabloom.operators import classes, copula, indexing, keyed_copula, modes, moments, scoring, tails, transforms
from tabloom.operators.fixes import Fix, apply_fixes
from tabloom.operators.indexing import dense_index, with_row_key
from tabloom.operators.numeric import Facts, numeric_facts
from tabloom.plans import runs
from tabloom.queries.common import sales


def test_normal_functions_invert_each_other():
    z = np.linspace(-4, 4, 401)
    assert np.abs(gaussian.inverse_cdf(gaussian.cdf(z)) - z).max() < 2e-3
    assert abs(gaussian.cdf(np.array([1.959963984540054]))[0] - 0.975) < 1e-6
    assert np.isnan(gaussian.inverse_cdf(np.array([np.nan, 0.5]))[0])


def test_array_draws_are_uniform_and_uncorrelated():
    ids = np.arange(200_000)
    a, b = (draws.array_normal(1, s, ids) for s in ("a", "b"))
    assert abs(a.mean()) < 0.01 and abs(a.std() - 1) < 0.01 and abs(np.corrcoef(a, b)[0, 1]) < 0.01
    assert abs(np.corrcoef(a[1:], a[:-1])[0, 1]) < 0.01


def test_column_draws_do_not_depend_on_partitions(spark):
    df = spark.range(1000)
    u = draws.uniform(3, "s", F.col("id"))
    one = df.coalesce(1).select("id", u.alias("u")).orderBy("id").collect()
    many = df.repartition(7).select("id", u.alias("u")).orderBy("id").collect()
    assert one == many and abs(np.mean([r["u"] for r in one]) - 0.5) < 0.03


def test_dense_index_counts_every_pool(spark):
    df = spark.range(500).withColumn("g", F.when(F.col("id") < 400, "hot").otherwise("cold"))
    rows, sizes = dense_index(df, ["id"], within="g")
    found = {(r["g"], r["idx"]) for r in rows.collect()}
    assert found == {("hot", i) for i in range(400)} | {("cold", i) for i in range(100)}
    assert dict(map(tuple, sizes.collect())) == {"hot": 400, "cold": 100}


def test_row_key_is_stable(spark):
    keyed = with_row_key(spark.range(50).repartition(3).select((F.col("id") % 5).alias("v")))
    assert keyed.select("row_key").distinct().count() == 50
    assert sorted(map(tuple, keyed.collect())) == sorted(map(tuple, keyed.repartition(2).collect()))


@pytest.fixture(scope="module")
def lines(spark, folder):
    return sales(spark, folder).persist()


COLUMNS = ["l_quantity", "l_extendedprice", "rev", "l_returnflag", "big"]


def test_per_class_marginals_and_dependence(spark, lines):
    made = classes.generate_per_class(lines, COLUMNS, "big", {"0": 4000, "1": 2000, "7": 3})
    assert made.skipped == [{"class_value": "7", "requested": 3, "real_examples": 0}]
    measure = [F.avg("l_extendedprice"), F.stddev("l_extendedprice"), F.corr("l_extendedprice", "rev"), F.count("*")]
    real = {r[0]: r[1:] for r in lines.groupBy("big").agg(*measure).collect()}
    synth = {r[0]: r[1:] for r in made.rows.groupBy("big").agg(*measure).collect()}
    assert {k: v[3] for k, v in synth.items()} == {0: 4000, 1: 2000}
    for k in real:
        assert abs(synth[k][0] / real[k][0] - 1) < 0.03 and abs(synth[k][1] / real[k][1] - 1) < 0.05
        assert abs(synth[k][2] - real[k][2]) < 0.04


def test_sampling_does_not_depend_on_partitions(spark, lines):
    model = copula.fit_copula(lines, COLUMNS)
    task = copula.SampleTask(model, {"": 1000}, 5)
    whole = copula.sample_copula(spark, model, {"": 1000}, 5).orderBy("row_id").toPandas()
    import pyarrow as pa
    parts = [pa.RecordBatch.from_arrays([pa.array(range(a, b))], names=["id"]) for a, b in ((0, 3), (3, 700), (700, 1000))]
    pieces = pa.Table.from_batches(list(task(parts))).to_pandas()
    assert np.allclose(whole["rev"], pieces["rev"]) and list(whole["l_returnflag"]) == list(pieces["l_returnflag"])


def test_missing_values_keep_their_share(spark, lines):
    gappy = lines.withColumn("rev", F.when(F.col("l_partkey") % 4 != 0, F.col("rev")))
    share = gappy.where("rev is null").count() / gappy.count()
    rows = classes.generate_pooled(gappy, ["rev", "l_returnflag"], 4000).rows
    assert abs(rows.where("rev is null").count() / 4000 - share) < 0.03


def test_conditional_gives_small_classes_their_rows(spark):
    df = spark.range(500).selectExpr("id * 1.0 AS x", "CASE WHEN id < 4 THEN 'few' WHEN id < 6 THEN 'two' ELSE 'many' END AS c")
    rows = classes.generate_conditional(df, ["x", "c"], "c", 1000).rows
    assert {r["c"]: r["count"] for r in rows.groupBy("c").count().collect()} == {"few": 8, "two": 4, "many": 988}


def test_conditional_keeps_classes_off_the_driver(spark, monkeypatch):
    df = spark.range(3000).selectExpr("IF(id % 50 = 0, NULL, pow(id % 97, 2) + id % 7) AS x", "concat('t', id % 13) AS t", "id % 97 AS y", "IF(id < 1200, 7, IF(id < 2900, id % 120, id)) AS c")
    plan = {r["value"]: (r["real"], r["rows"]) for r in classes.allocation(df, "c", 30_000).orderBy("value").collect()}
    kind, most = type(df), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: most.append(collect(self)) or most[-1])
    made = classes.generate_conditional(df, ["x", "t", "y", "c"], "c", 30_000)
    assert max(map(len, most)) <= 100 < len(plan)
    monkeypatch.undo()
    got = made.rows.orderBy("row_id").toPandas()

    own = [v for v, (real, _) in plan.items() if real >= classes.MIN_CLASS_ROWS]
    key = F.col("c").cast("string")
    model = copula.fit_copula(df.where(key.isin(own)), ["x", "t", "y"], key)
    starts = dict(zip(plan, np.cumsum([0, *(m for _, m in plan.values())]).tolist()))
    want = copula.sample_copula(spark, model, {v: plan[v][1] for v in own}, 42, starts=starts).orderBy("row_id").toPandas()
    assert got["c"].astype(str).value_counts().to_dict() == {v: m for v, (_, m) in plan.items()} and list(got["row_id"]) == list(range(len(got)))
    got = got[got["c"].astype(str).isin(own)].reset_index()
    assert list(got["row_id"]) == list(want["row_id"]) and list(got["c"].astype(str)) == list(want[copula.GROUP])
    assert all(np.allclose(got[k], want[k], equal_nan=True) for k in ("x", "y")) and list(got["t"]) == list(want["t"])


def test_scarce_classes_keep_their_place(spark):
    """Classes of five rows each with means far apart; two columns that follow them, one against the other."""
    df = spark.range(1000).selectExpr("id AS k", "cast(id % 200 AS string) AS c", "(id % 200) * 10D + id % 5 AS x", "5000 - (id % 200) * 20D + (id * 7) % 11 AS y", "concat('v', id % 3) AS t")
    made = classes.generate_conditional(df, ["x", "y", "t", "c"], "c", 20_000)
    means = [F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")]
    real, got = (d.groupBy("c").agg(*means).toPandas().set_index("c").sort_index() for d in (df, made.rows))
    assert list(got["n"]) == [100] * 200
    for k in "xy":
        assert np.corrcoef(real[k], got[k])[0, 1] > 0.99
        assert abs(got[k] - real[k]).mean() < 0.1 * abs(real[k] - real[k].mean()).mean()
    again = classes.generate_conditional(df.repartition(5), ["x", "y", "t", "c"], "c", 20_000).rows.orderBy("row_id").toPandas()
    first = made.rows.orderBy("row_id").toPandas()
    assert all(np.allclose(first[k], again[k]) for k in "xy") and list(first["c"]) == list(again["c"]) and list(first["t"]) == list(again["t"])


def test_a_class_alone(spark):
    df = spark.range(40).selectExpr("IF(id < 30, 'a', concat('b', id)) AS c")
    rows = classes.generate_conditional(df, ["c"], "c", 400).rows
    assert {r["c"]: r["count"] for r in rows.groupBy("c").count().collect()} == {"a": 300} | {f"b{i}": 10 for i in range(30, 40)}


@pytest.fixture
def short_head(monkeypatch):
    monkeypatch.setattr(tails, "HEAD", 8)


def _shares(df, column):
    n = df.where(f"{column} IS NOT NULL").count()
    return {r[0]: r["count"] / n for r in df.where(f"{column} IS NOT NULL").groupBy(column).count().collect()}


def test_tail_values_keep_their_shares(spark, short_head):
    """One value has half of the rows, 39 rare ones have shares from 1 to 39 parts, a twentieth is missing."""
    df = spark.range(20_000).selectExpr("id * 1.0 AS x", "CASE WHEN id % 20 = 0 THEN NULL WHEN id % 2 = 0 THEN 'hot' ELSE concat('v', floor(sqrt(id % 1600))) END AS v")
    model = copula.fit_copula(df, ["x", "v"])
    assert model.groups[""]["v"].values == ["hot"] and model.groups[""]["v"].tail_values == 39 and model.wide == ["v"]
    made = classes.generate_pooled(df, ["x", "v"], 40_000).rows
    assert made.count() == 40_000 and made.select("row_id").distinct().count() == 40_000
    assert abs(made.where("v IS NULL").count() / 40_000 - 0.05) < 0.005
    real, got = _shares(df, "v"), _shares(made, "v")
    assert set(got) == set(real) and max(abs(real[v] - got[v]) for v in real) < 0.012


def test_tails_of_many_classes(spark, short_head):
    """Every class has values of its own, by each of the three ways a class is modelled."""
    df = spark.range(6000).selectExpr("id % 7 * 1.0 AS x", "CASE WHEN id < 3000 THEN 'big' WHEN id < 5900 THEN concat('m', id % 145) ELSE concat('s', id % 20) END AS c", "id").selectExpr("x", "c", "concat(c, '-', id % 30) AS v")
    made = classes.generate_conditional(df, ["x", "v", "c"], "c", 12_000)
    bad = made.rows.where("v IS NULL OR (c NOT LIKE 's%' AND NOT startswith(v, concat(c, '-')))").count()
    assert bad == 0 and made.rows.count() == 12_000 and len(made.model.parts) == 2
    assert made.rows.join(df.select("v").distinct(), "v", "left_anti").isEmpty()
    own = classes.generate_per_class(df, ["x", "v", "c"], "c", {"big": 500, "m1": 300, "s1": 4})
    assert own.skipped == [{"class_value": "s1", "requested": 4, "real_examples": 5}]
    assert {r["c"]: r["count"] for r in own.rows.groupBy("c").count().collect()} == {"big": 500, "m1": 300}
    assert own.rows.where("NOT startswith(v, concat(c, '-'))").isEmpty()


def test_request_as_a_table(spark):
    df = spark.range(4000).selectExpr("id % 9 * 1.0 AS x", "concat('c', id % 300) AS c")
    wanted = spark.range(310).selectExpr("concat('c', id) AS value", "id % 4 AS requested")
    made = classes.generate_per_class(df, ["x", "c"], "c", wanted)
    assert {r["c"]: r["count"] for r in made.rows.groupBy("c").count().collect()} == {f"c{i}": i % 4 for i in range(300) if i % 4}
    assert sorted(r["class_value"] for r in made.skipped.collect()) == sorted(f"c{i}" for i in range(300, 310) if i % 4)


def test_running_sums(spark):
    df = spark.range(1000).selectExpr("id % 10 AS a", "id AS b", "id % 7 AS n")
    rows = sorted(map(tuple, indexing.with_running_sum(df, ["a", "b"], "n", "s").collect()))
    assert [r[3] for r in rows] == np.cumsum([0, *(r[2] for r in rows)])[:-1].tolist()


def test_modes():
    rng = np.random.default_rng(5)
    quantiles = lambda x: np.quantile(x, (np.arange(1000) + 0.5) / 1000)
    assert modes.dips(quantiles(rng.normal(0, 1, 50_000))) == []
    assert modes.dips(quantiles(rng.uniform(0, 1, 50_000))) == []
    assert modes.dips(quantiles(rng.exponential(1, 50_000))) == []
    assert modes.dips(np.full(1000, 3.0)) == [] and modes.dips(np.zeros(0)) == []
    (cut,) = modes.dips(quantiles(np.concatenate([rng.normal(0, 1, 30_000), rng.normal(10, 2, 20_000)])))
    assert 2 < cut < 7
    first, second = modes.dips(quantiles(np.concatenate([rng.normal(0, 1, 30_000), rng.normal(10, 1, 9_000), rng.uniform(40, 50, 20_000)])))
    assert 2 < first < 8 and 13 < second < 40


def test_mixture_follows_peaks_and_turns(spark):
    """Two peaks with opposite dependence on another column: a single copula would see none."""
    df = spark.range(8000).selectExpr("IF(id % 2 = 0, 0, 1000) + (id * 7919) % 101 AS x", "IF(id % 2 = 0, 1, -1) * ((id * 7919) % 101) + (id * 31) % 17 AS y", "(id * 13) % 97 AS z")
    made = classes.generate_mixture(df, ["x", "y", "z"], 8000)
    assert len(made.model.sizes) == 2 and made.rows.count() == 8000
    assert made.rows.where("x > 110 AND x < 990").count() == 0
    for side, sign in (("x < 500", 1), ("x > 500", -1)):
        want, got = (d.where(side).agg(F.count("*"), F.corr("x", "y")).first() for d in (df, made.rows))
        assert got[0] == want[0] and sign * got[1] > 0.9 and abs(got[1] - want[1]) < 0.05


def test_mixture_without_modes_is_one_copula(spark):
    df = spark.range(500).selectExpr("(id * 37) % 500 * 1.0 AS x", "cast(NULL AS double) AS e", "'k' AS t")
    made = classes.generate_mixture(df, ["x", "e", "t"], 300)
    assert list(made.model.sizes.values()) == [500] and made.rows.count() == 300


def test_proportional_counts_are_exact():
    counts = copula.proportional_counts({"a": 1, "b": 1, "c": 1}, 10)
    assert sum(counts.values()) == 10 and max(counts.values()) - min(counts.values()) == 1


def test_integer_classes_of_several_values_are_not_skipped(spark):
    df = spark.range(300).selectExpr("id AS k", "rand(1) * id AS x", "cast(3 + id % 3 AS int) AS grade")
    run = runs.generate_rows(df, 60, ["k"], target="grade", class_counts={"3": 20, "5": 40})
    assert run.skipped == [] and run.strategy == "per_class"
    assert {r["grade"]: r["count"] for r in run.rows.groupBy("grade").count().collect()} == {3: 20, 5: 40}


def test_generated_rows_stay_in_range_and_keep_types(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    run = runs.generate_rows(orders, 500, ["o_orderkey"], fix_list="all", holdout_first=True)
    real, synth = numeric_facts(run.cleaned), numeric_facts(run.rows.drop("row_id"))
    assert "o_orderkey" not in synth and run.rows.count() == 500
    for c, f in synth.items():
        assert f.low >= real[c].low and f.high <= real[c].high and f.whole == real[c].whole
    kinds = {r[0] for r in run.rows.select("o_orderstatus").distinct().collect()}
    assert kinds <= {r[0] for r in orders.select("o_orderstatus").distinct().collect()}
    scores = runs.score_run(run, with_models=False)
    assert scores.realism.first()["statistical_score"] > 85


def test_table_against_itself_scores_full(spark, folder):
    part = spark.read.parquet(f"{folder}/part.parquet")
    assert scoring.statistical_similarity(part, part).first()[0] == 100.0
    assert scoring.coverage(part, part).first()[0] == 100.0
    assert scoring.correlation_summary(scoring.correlations(part, part)).first()["avg_diff"] == 0.0
    texts = part.select("p_name")
    assert scoring.statistical_similarity(texts, texts).first()[0] == 50.0


def test_correlation_with_gaps_constants_and_offsets(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(1e8, 1, 400), rng.normal(0, 1, 400)
    rows = [(float(a), float(a - 1e8 + b) if i % 3 else None, 5.0) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    found = {(r["a"], r["b"]): r["real"] for r in scoring.correlations(df, df).collect()}
    keep = np.arange(400) % 3 != 0
    assert abs(found["a", "b"] - np.corrcoef(x[keep], (x - 1e8 + y)[keep])[0, 1]) < 1e-3
    assert found["a", "c"] == 0.0 and found["b", "c"] == 0.0


def test_strips_give_the_same_matrix(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 11)) @ rng.normal(size=(11, 11)) + 1e6
    x[rng.random(x.shape) < 0.1] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"c{i} double" for i in range(11)))
    whole = {(r["a"], r["b"]): r["real"] for r in scoring.correlations(df, df).collect()}
    monkeypatch.setattr(moments, "TILE", 4)
    monkeypatch.setattr(moments, "CELLS", 100)
    monkeypatch.setattr(moments, "BLOCK", 7)
    strips = {(r["a"], r["b"]): r["real"] for r in scoring.correlations(df, df).collect()}
    assert len(strips) == 55 and strips == whole
    for i, j in ((0, 1), (3, 9), (10, 4)):
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert abs(strips[f"c{min(i, j)}", f"c{max(i, j)}"] - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 6e-4


def test_one_scan_makes_strips_with_the_products_of_gaps_alone():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 7))
    x[rng.random(200) < 0.3, 2] = np.nan
    x[rng.random(200) < 0.3, 5] = np.nan
    task = moments.MomentTask(lambda _, t: x, "grp", 7, [(0, 3), (3, 7)])
    batch = pa.RecordBatch.from_pydict({"grp": [""] * 200})
    found = {(r["a"], r["b"]): r for out in task([batch]) for r in out.to_pylist()}
    assert sorted(found) == [(i, j) for i in range(7) for j in range(i + 1, 7)]
    for (i, j), r in found.items():
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        a, b = x[both, i], x[both, j]
        want = [both.sum(), a.sum(), b.sum(), (a * a).sum(), (b * b).sum(), (a * b).sum()]
        assert np.allclose([r[k] for k in ("n", "sa", "sb", "saa", "sbb", "sab")], want)


def test_long_tails_get_their_totals_by_broadcast_or_by_group(spark, monkeypatch):
    counts = spark.range(5000).selectExpr("concat('g', id % 2) AS _group", "'c' AS column", "concat('v', id) AS value", "1 + id % 3 AS n")
    present = counts.groupBy("_group", "column").agg(F.sum("n").alias("present"))
    order = ["_group", "column", "value", "slice"]
    want = [tuple(r) for r in tails.tail_table(counts, present).orderBy(order).collect()]
    monkeypatch.setattr(tails, "FEW_TAILS", 0)
    assert [tuple(r) for r in tails.tail_table(counts, present).orderBy(order).collect()] == want and len(want) >= 5000


def test_sampling_a_wide_table_in_parts(spark, monkeypatch):
    df = spark.range(400).selectExpr(*[f"(id * {k + 3}) % 101 + id AS c{k}" for k in range(9)], "concat('t', id % 3) AS t")
    want = classes.generate_pooled(df, df.columns, 500).rows.orderBy("row_id").toPandas()
    for module, name, value in ((copula, "CELLS", 70), (copula, "SCAN_COLUMNS", 4), (moments, "TILE", 3)):
        monkeypatch.setattr(module, name, value)
    got = classes.generate_pooled(df, df.columns, 500).rows.orderBy("row_id").toPandas()
    assert all(np.allclose(want[c], got[c]) for c in df.columns[:-1]) and list(want["t"]) == list(got["t"])


def _facts(low, high, std=1.0, whole=False, between=5):
    return Facts(10, 0, (low + high) / 2, std, low, high, 0.0, whole, whole, between)


def test_domain_rules():
    assert transforms.domain_rule("mileage", _facts(0, 500.0, 10)) == (0.0, 530.0, False)
    assert transforms.domain_rule("mileage", _facts(0, 500.0, 10), "substring")[2] is True
    assert transforms.domain_rule("age", _facts(3, 90, 10)) == (3, 100, True)
    assert transforms.domain_rule("win_ratio", _facts(-1, 0.5)) == (0.0, 1.0, False)
    assert transforms.domain_rule("price", _facts(5, 50)) == (0.0, None, False)
    assert transforms.domain_rule("price", _facts(-5, 50)) == (-8.0, 53.0, False)
    assert transforms.domain_rule("x", _facts(2, 9, whole=True, between=0)) == (2, 9, False)


def test_fixes_run_in_order_and_reject_nonsense(spark):
    df = spark.createDataFrame([(0, None), (0, "b"), (4, "a"), (8, "b"), (None, "a")], "n int, s string")
    fixed = apply_fixes(df, [Fix("n", "fix_zeros"), Fix("n", "fill_missing"), Fix("s", "fill_missing"), Fix("n", "drop_column", False)])
    assert [tuple(r) for r in fixed.collect()] == [(6, "a"), (6, "b"), (4, "a"), (8, "b"), (6, "a")]
    with pytest.raises(ValueError):
        apply_fixes(df, [Fix("missing", "fill_missing")])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False).map(lambda v: round(v, 3))), min_size=2, max_size=30))
def test_scores_stay_between_0_and_100(spark, values):
    a = spark.createDataFrame([(v, float(i)) for i, v in enumerate(values)], "x double, i double")
    b = a.withColumn("x", F.col("x") * 3 + 1)
    for score in (scoring.statistical_similarity, scoring.coverage):
        got = score(a, b).first()[0]
        assert got is None or 0 <= got <= 100


def test_rows_to_tell_apart_are_kept_as_plain_numbers(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(scoring, "materialize", lambda df, put=scoring.materialize: kept.append(df.dtypes) or put(df))
    rows = spark.range(3000).select("id", (F.col("id") % 97).alias("a"), F.sin("id").alias("b"), F.lit(2.5).alias("c"))
    assert scoring.distinguishability(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), 42, ["id"], ["id"]) > 85
    assert scoring.distinguishability(rows, rows.withColumn("b", F.col("b") + 3), 42, ["id"], ["id"]) < 5
    assert kept == [[("label", "double"), ("fold", "int"), ("x0", "double"), ("x1", "double"), ("x2", "double")]] * 2


def test_parameters_and_factors_of_many_groups_at_once():
    numbers = pa.list_(pa.float64())
    kind = pa.struct([("name", pa.string()), ("size", pa.int64()), ("grids", pa.list_(numbers)), ("present", pa.list_(pa.int64())), ("factor", numbers)])
    rows = [{"name": n, "size": 3, "grids": [[1.0, 2.0, k], [0.5]][:k], "present": [3], "factor": [1.0] * k} for n, k in (("a", 1), ("b", 2), ("c", 0))]
    column = pa.array(rows[:1] * 2 + rows, kind).slice(2).take(pa.array([0, 2, 1]))
    assert [r | {"factor": list(r["factor"])} for r in keyed_copula.plain_params(column)] == [rows[0], rows[2], rows[1]]
    x = np.random.default_rng(1).normal(size=(5, 40, 3))
    x[1, :, 0], x[2, :5, 1] = 7.0, np.nan
    sums = [moments.MomentTask._sums(one) for one in x]
    alone = [copula.cholesky_factor(keyed_copula.correlation(one)) for one in sums]
    assert np.allclose(copula.cholesky_factor(keyed_copula.correlation(np.stack(sums, axis=1))), alone, atol=1e-12)


def test_classes_over_many_blocks_are_those_of_one(spark, monkeypatch):
    rows = spark.range(900).select(F.concat(F.lit("c"), F.col("id") % 45).alias("c"), F.sin("id").alias("x"), F.cos("id").alias("y"))
    found = []
    for stack in (1, keyed_copula.STACK):
        monkeypatch.setattr(keyed_copula, "STACK", stack)
        monkeypatch.setattr(classes, "LARGE_CLASSES", 2)
        made = classes.generate_conditional(rows, ["x", "y", "c"], "c", 500, 7)
        found.append([(r["row_id"], r["c"], round(r["x"], 9), round(r["y"], 9)) for r in made.rows.orderBy("row_id").collect()])
    assert found[0] == found[1] and len(found[0]) == 495
