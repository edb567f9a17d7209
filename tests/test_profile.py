import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions.kinds import flat_table, name_matches
from tabloom.functions.quantiles import exact_quantiles, value_at_rank
from tabloom.operators import inference, issues
from tabloom.operators.profile import datetime_formats, profile_table


def _types(spark, rows, schema):
    return profile_table(spark.createDataFrame(rows, schema)).types


def test_bracketed_quantiles_equal_sorting(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.lognormal(3, 2, 4000), np.full(2500, 7.0), [-1e9, 1e9]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = exact_quantiles(df, {"x": (F.col("x"), probs), "none": (F.lit(None).cast("double"), [0.5])},
                            value_budget=10, bracket_limit=50, accuracy=50)
    assert np.allclose(found["x"], np.quantile(x, probs), rtol=1e-12)
    assert found["none"] == [None]


def test_value_at_rank(spark):
    df = spark.range(1000).select((F.col("id") * 3).alias("k"))
    assert [value_at_rank(df, F.col("k"), r) for r in (0, 7, 999)] == [0, 21, 2997]
    wide = spark.range(1000).select((F.lit(2**60) + F.col("id")).alias("k")).union(spark.createDataFrame([(-(2**62),), (None,), (2**60 + 5,)], "k long"))
    assert [value_at_rank(wide, F.col("k"), r) for r in (0, 1, 6, 7, 8, 1001, 1002)] == [-(2**62), 2**60, 2**60 + 5, 2**60 + 5, 2**60 + 6, 2**60 + 999, None]
    assert value_at_rank(df, F.col("k"), 1000) is None


@pytest.mark.parametrize("distinct, kind", [(3, "numerical_discrete"), (20, "numerical_discrete"), (21, "numerical_continuous")])
def test_integer_types(spark, distinct, kind):
    assert _types(spark, [(i % distinct,) for i in range(100)], "n long") == {"n": kind}


def test_boolean_forms(spark):
    rows = [(i % 2, float(i % 2), bool(i % 2), ["yes", "no"][i % 2], ["no", "true"][i % 2], 1 + i % 2) for i in range(30)]
    types = _types(spark, rows, "a int, b double, c boolean, d string, e string, f int")
    assert [types[c] for c in "abcdef"] == ["boolean"] * 5 + ["numerical_discrete"]


def test_ids_floats_and_text_ratios(spark):
    rows = [(i, i + 0.5, f"k{i}", f"v{i % 60}", f"w{i % 50}") for i in range(100)]
    types = _types(spark, rows, "i long, f double, s string, high string, low string")
    assert types == {"i": "id_column", "f": "numerical_continuous", "s": "id_column", "high": "categorical_high",
                     "low": "categorical_low"}
    assert _types(spark, rows[:20], "i long, f double, s string, high string, low string")["i"] == "numerical_discrete"


def test_numeric_names_are_no_dates_unless_asked(spark):
    df = spark.createDataFrame([(i % 7, 1.5 * i) for i in range(50)], "runtime int, update_count double")
    assert set(profile_table(df).types.values()) == {"numerical_discrete", "numerical_continuous"}
    assert set(profile_table(df, numeric_names_as_dates=True).types.values()) == {"datetime"}


def test_datetime_texts_need_one_layout(spark):
    rows = [("2024-01-05", "01/05/2024", "2024-01-05", "a1"), ("2024-02-25", "02/25/2024", "25.02.2024", "b2")]
    df = spark.createDataFrame(rows, "iso string, us string, mixed string, code string")
    found = datetime_formats(df, df.columns)
    assert found["iso"] == "yyyy-MM-dd" and found["us"] == "MM/dd/yyyy" and set(found) == {"iso", "us"}


def test_edge_columns(spark):
    rows = [(None, 1.0, float("nan"), "x"), (None, 1.0, 2.0, "x"), (None, 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "empty double, same double, gaps double, text string")
    profile = profile_table(df)
    assert profile.fact("gaps")["num_missing"] == 1 and profile.fact("empty")["num_unique"] == 0
    found = {(r["column"], r["fix_type"]) for r in issues.issue_report(profile.frame).collect()}
    assert ("empty", "drop_column") in found and ("same", "drop_column") in found and ("gaps", "fill_missing") in found
    one = profile_table(df.limit(1)).frame
    assert inference.usability(one).where("refused and rule = 'min_rows'").count() == 1


def test_zero_rows(spark):
    frame = profile_table(spark.createDataFrame([], "a int, b string")).frame
    assert inference.usability(frame).where("refused").count() == 1


def test_nested_columns_are_rejected_with_a_reason(spark):
    flat, rejected = flat_table(spark.createDataFrame([(1, [1.0])], "a int, v array<double>"))
    assert flat.columns == ["a"] and "array" in rejected["v"]


def test_hints_match_whole_name_parts():
    assert name_matches("event_type", ("type",)) and name_matches("isActive", ("active",))
    assert not name_matches("salary", ("y",)) and name_matches("salary", ("y",), "substring")
    assert not name_matches("discount", ("count",)) and not name_matches("mileage", ("age",))
    assert name_matches("y", ("y",)) and name_matches("total_sales", ("sales",))


def test_target_order_and_override(spark):
    rows = [(i, i % 3, i * 1.5, i % 2, f"t{i}") for i in range(60)]
    profile = profile_table(spark.createDataFrame(rows, "id long, grp int, price double, bit int, last string"))
    assert inference.suggest_target(profile.frame).first()["column"] == "price"
    assert inference.suggest_target(profile.frame, "substring").first()["target_type"] == "regression"
    dataset, note = inference.override_target(profile, "grp")
    assert dataset.first()["target_type"] == "classification" and note is None
    constant = profile_table(spark.createDataFrame([(1, i) for i in range(9)], "c int, x int"))
    dataset, note = inference.override_target(constant, "c")
    assert note and dataset.first()["target_column"] is None


def test_all_unique_needs_ten_rows(spark):
    for n, refused in ((9, False), (10, True)):
        frame = profile_table(spark.range(n).selectExpr("id", "concat('k', id) AS s")).frame
        assert inference.usability(frame).where("rule = 'all_unique'").first()["refused"] is refused
