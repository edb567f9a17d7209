"""Realism scores of a synthetic table against the real one.

The scores need only per-column moments and extremes of both tables, so each table is scanned once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import draws
from tabloom.functions.kinds import FLOAT, INTEGER, STRING, kinds, numeric_columns
from tabloom.functions.small import small_frame
from tabloom.operators.frequencies import value_frequencies
from tabloom.operators.moments import centers, number_rows, pairwise_moments
from tabloom.operators.numeric import SCAN_WIDTH, numeric_facts
from tabloom.session import materialize

# Weights, bands and defaults of the scores.
WEIGHTS = (0.2, 0.5, 0.3)
NO_COLUMNS = 50.0
BINS, FOLDS, MAX_ITERATIONS, TOLERANCE = 20, 3, 1000, 1e-4
SIMILAR = ((0.1, "Excellent"), (0.2, "Good"), (0.3, "Fair"))


def shared_numeric(real: DataFrame, synthetic: DataFrame) -> list[str]:
    other = set(numeric_columns(synthetic))
    return [c for c in numeric_columns(real) if c in other]


def moments_frame(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, std, low, high); a few columns per aggregation, each reading only its own (see
    ``profile.SCAN_WIDTH``)."""
    parts = []
    for start in range(0, len(columns), SCAN_WIDTH):
        names = [f"s{i}" for i in range(len(columns[start:start + SCAN_WIDTH]))]
        aggs = []
        for name, c in zip(names, columns[start:start + SCAN_WIDTH]):
            x = F.col(f"`{c}`").cast("double")
            aggs.append(F.struct(F.lit(c).alias("column"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                                 F.min(x).alias("low"), F.max(x).alias("high")).alias(name))
        parts.append(df.agg(*aggs).select(F.explode(F.array(*names)).alias("s")).select("s.*"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _paired(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    left, right = moments_frame(real, columns), moments_frame(synthetic, columns)
    return left.select("column", *[F.col(c).alias(f"real_{c}") for c in ("mean", "std", "low", "high")]).join(
        right.select("column", *[F.col(c).alias(f"synth_{c}") for c in ("mean", "std", "low", "high")]), "column")


def _closeness(name: str) -> Column:
    """1 for equal values, falling with their relative difference; without a base 1 if both are 0, else one half."""
    real, synth = F.col(f"real_{name}"), F.col(f"synth_{name}")
    relative = F.greatest(F.lit(0.0), 1 - F.abs(real - synth) / F.nullif(F.abs(real), F.lit(0.0)))
    return F.when(real != 0, relative).when(synth == 0, 1.0).otherwise(0.5)


def _empty_score(df: DataFrame, name: str) -> DataFrame:
    return small_frame(df.sparkSession, [(NO_COLUMNS,)], f"{name} double")


def statistical_similarity(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    columns = shared_numeric(real, synthetic)
    if not columns:
        return _empty_score(real, "statistical_score")
    each = (_closeness("mean") + _closeness("std")) / 2
    return _paired(real, synthetic, columns).agg(F.round(F.avg(each) * 100, 1).alias("statistical_score"))


def coverage(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    columns = shared_numeric(real, synthetic)
    if not columns:
        return _empty_score(real, "coverage_score")
    width = F.col("real_high") - F.col("real_low")
    overlap = F.least("real_high", "synth_high") - F.greatest("real_low", "synth_low")
    each = F.when(width == 0, 1.0).otherwise(F.greatest(F.lit(0.0), overlap) / F.nullif(width, F.lit(0.0)))
    return _paired(real, synthetic, columns).agg(F.round(F.avg(each) * 100, 1).alias("coverage_score"))


def column_quality(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Per column the relative differences of mean and std, a score and a grade, best first."""
    columns = shared_numeric(real, synthetic)
    if not columns:
        return small_frame(real.sparkSession, [],
                           "column string, score double, grade string, mean_diff_pct double, std_diff_pct double")

    def gap(name: str) -> Column:
        base = F.col(f"real_{name}")
        return F.when(base != 0, F.round(F.abs(base - F.col(f"synth_{name}")) / F.nullif(F.abs(base), F.lit(0.0)) * 100, 1)
                      ).otherwise(F.lit(0.0))

    scored = _paired(real, synthetic, columns).withColumns(
        {"mean_diff_pct": gap("mean"), "std_diff_pct": gap("std")}
    ).withColumn("raw", F.greatest(F.lit(0.0), 100 - (F.col("mean_diff_pct") + F.col("std_diff_pct")) / 2))
    grade = F.when(F.col("raw") >= 80, "Excellent").when(F.col("raw") >= 60, "Good").when(F.col("raw") >= 40, "Fair").otherwise("Poor")
    return scored.select("column", F.round("raw", 1).alias("score"), grade.alias("grade"), "mean_diff_pct",
                         "std_diff_pct").orderBy(F.desc("score"), "column")


def distinguishability(real: DataFrame, synthetic: DataFrame, seed: int = 42,
                       real_keys: list[str] | None = None, synthetic_keys: list[str] | None = None) -> float:
    """How hard a logistic regression finds it to tell both tables apart: 100 when it can only guess.

    Folds and the thinning of a larger real table are decided per row by a hash of the row's key (of its numbers
    where no key is named).
    """
    skip = set((real_keys or []) + (synthetic_keys or []))
    columns = [c for c in shared_numeric(real, synthetic) if c not in skip]
    if not columns:
        return NO_COLUMNS

    def side(df: DataFrame, keys: list[str] | None, label: float) -> DataFrame:
        ids = [F.col(f"`{k}`") for k in (keys or columns)]
        return df.select(F.lit(label).alias("label"), draws.uniform(seed, "thin", *ids).alias("thin"),
                         F.floor(draws.uniform(seed, "fold", *ids) * FOLDS).cast("int").alias("fold"),
                         *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(columns)])

    real_n, synth_n = real.select(F.count(F.lit(1)).alias("n")).unionAll(synthetic.select(F.count(F.lit(1)))).collect()
    real_n, synth_n = real_n["n"], synth_n["n"]
    rows = side(real, real_keys, 1.0)
    if real_n > synth_n:
        rows = rows.where(F.col("thin") < F.lit(synth_n / real_n))
    rows = rows.unionByName(side(synthetic, synthetic_keys, 0.0))
    names = [f"x{i}" for i in range(len(columns))]
    rows = materialize(rows.select("label", "fold", *names))  # plain numbers: draws are made once, and vectors only where a fit reads them
    n, hits = rows.count(), []
    facts = {}
    for at in range(0, len(names), SCAN_WIDTH):
        batch = names[at:at + SCAN_WIDTH]
        facts |= rows.agg(*[F.avg(x).alias(f"m{x}") for x in batch], *[F.stddev_samp(x).alias(f"s{x}") for x in batch]).first().asDict()
    scaled = rows.select("label", "fold", *[((F.col(x) - F.lit(facts[f"m{x}"])) * F.lit(1 / facts[f"s{x}"] if facts[f"s{x}"] else 0.0)).alias(x) for x in names])
    features = VectorAssembler(inputCols=names, outputCol="features").transform(scaled).select("label", "fold", "features")
    tested = features
    for k in range(FOLDS):  # a fit keeps its own blocks of rows in memory
        fitted = LogisticRegression(maxIter=MAX_ITERATIONS, tol=TOLERANCE, regParam=1.0 / n, standardization=False).fit(
            features.where(F.col("fold") != k))
        tested = fitted.setPredictionCol(f"p{k}").setRawPredictionCol("").setProbabilityCol("").transform(tested)
        hits.append(F.avg(F.when(F.col("fold") == k, (F.col(f"p{k}") == F.col("label")).cast("double"))).alias(f"h{k}"))
    hits = tested.agg(*hits).first()  # all folds are tested in one scan
    accuracy = sum(hits) / FOLDS
    return round(max(0.0, min(100.0, (1 - (accuracy - 0.5) * 2) * 100)), 1)


def realism(scores: DataFrame) -> DataFrame:
    """Weighted score, grade and colour for rows with the three part scores."""
    parts = ("distinguishability_score", "statistical_score", "coverage_score")
    final = F.round(reduce(lambda a, b: a + b, [F.col(p) * w for p, w in zip(parts, WEIGHTS)]), 1)
    scored = scores.withColumn("final_score", final)
    return scored.withColumns({
        "grade": F.when(F.col("final_score") >= 80, "Excellent").when(F.col("final_score") >= 60, "Good").otherwise("Fair"),
        "color": F.when(F.col("final_score") >= 80, "green").when(F.col("final_score") >= 60, "yellow").otherwise("red"),
    })


def diagnosis(scored: DataFrame) -> DataFrame:
    """Cause of a low score and the weakest part. Needs the part scores, ``final_score``, ``is_imbalanced`` and
    ``imbalance_ratio``."""
    lopsided = F.col("is_imbalanced") & (F.col("imbalance_ratio") >= 0.9)
    verdict = (
        F.when(F.col("final_score") >= 80, "excellent").when(F.col("final_score") >= 60, "good")
        .when(lopsided, "low: extreme class imbalance").when(F.col("coverage_score") < 30, "low: poor coverage")
        .when(F.col("statistical_score") < 40, "low: distributions differ").otherwise("fair"))
    weakest = (
        F.when(F.col("distinguishability_score") < 60, "distinguishability")
        .when(F.col("statistical_score") < 60, "statistical similarity")
        .when(F.col("coverage_score") < 60, "coverage").otherwise("none"))
    return scored.withColumns({"verdict": verdict, "weakest": weakest})


def numeric_distributions(real: DataFrame, synthetic: DataFrame, bins: int = BINS) -> DataFrame:
    """Shared-range histograms: (column, bin, bin_start, real_pct, synth_pct, real_mean, ...). Columns with two real
    values are left to ``binary_distributions``; a column constant over both tables has none."""
    columns = shared_numeric(real, synthetic)
    a, b = numeric_facts(real, columns), numeric_facts(synthetic, columns)
    plotted = {}
    for c in columns:
        if a[c].n and b[c].n and not a[c].binary:
            low, high = min(a[c].low, b[c].low), max(a[c].high, b[c].high)
            if low < high:
                plotted[c] = (low, high)
    spark = real.sparkSession
    edges = small_frame(spark, [
        (c, k, low + (high - low) / bins * k, float(a[c].n), float(b[c].n), a[c].mean, b[c].mean, a[c].std, b[c].std)
        for c, (low, high) in plotted.items() for k in range(bins)
    ], "column string, bin int, start double, rn double, sn double, rm double, sm double, rs double, ss double")
    if not plotted:
        counted = small_frame(spark, [], "column string, bin int, real long, synth long")
    else:
        counted = _binned(real, plotted, bins, "real").unionByName(
            _binned(synthetic, plotted, bins, "synth"), allowMissingColumns=True
        ).groupBy("column", "bin").agg(F.sum("real").alias("real"), F.sum("synth").alias("synth"))
    share = {s: F.round(F.coalesce(F.col(s), F.lit(0)) / F.col(f"{s[0]}n") * 100, 2) for s in ("real", "synth")}
    return edges.join(counted, ["column", "bin"], "left").select(
        "column", "bin", F.round("start", 2).alias("bin_start"), share["real"].alias("real_pct"),
        share["synth"].alias("synth_pct"), F.round("rm", 3).alias("real_mean"), F.round("sm", 3).alias("synth_mean"),
        F.round("rs", 3).alias("real_std"), F.round("ss", 3).alias("synth_std"))


def _binned(df: DataFrame, ranges: dict[str, tuple[float, float]], bins: int, side: str) -> DataFrame:
    """Counts per (column, bin) in one scan; the last bin is closed."""
    cells = []
    for c, (low, high) in ranges.items():
        place = F.floor((F.col(f"`{c}`").cast("double") - F.lit(low)) / F.lit(high - low) * bins)
        cells.append(F.least(place, F.lit(bins - 1)).cast("int").alias(c))
    return df.select(*cells).unpivot([], list(ranges), "column", "bin").where("bin is not null").groupBy(
        "column", "bin").agg(F.count(F.lit(1)).alias(side))


def category_shares(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """Percentages of each real category on both sides; categories only the synthetic table has are left out."""
    def side(df: DataFrame, name: str) -> DataFrame:
        counts = value_frequencies(df, columns).withColumn("category", F.coalesce("value", F.col("number").cast("string")))
        totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
        return counts.join(F.broadcast(totals), "column").select(
            "column", "category", F.round(F.col("n") / F.col("total") * 100, 2).alias(name))

    return side(real, "real_pct").join(side(synthetic, "synth_pct"), ["column", "category"], "left").select(
        "column", "category", "real_pct", F.coalesce("synth_pct", F.lit(0.0)).alias("synth_pct"))


def categorical_distributions(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    columns = [c for c, k in kinds(real).items() if k == STRING and c in synthetic.columns]
    return category_shares(real, synthetic, columns)


def binary_distributions(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Shares of the values of numeric columns with two real values."""
    facts = numeric_facts(real, shared_numeric(real, synthetic))
    columns = [c for c, f in facts.items() if f.binary]
    if not columns:
        return small_frame(real.sparkSession, [], "column string, category string, real_pct double, synth_pct double")
    real, synthetic = (d.withColumns({c: _as_whole(d, c, facts[c].whole) for c in columns}) for d in (real, synthetic))
    return category_shares(real, synthetic, columns)


def _as_whole(df: DataFrame, column: str, whole: bool) -> Column:
    """Whole-number categories are compared as integers on both sides (1 and 1.0 are one category)."""
    x = F.col(f"`{column}`")
    if not whole or kinds(df)[column] == INTEGER:
        return x
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def correlations(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(a, b, real, synth, diff) for each pair of shared numeric columns; undefined correlations count as 0."""
    columns = shared_numeric(real, synthetic)
    if len(columns) < 2:
        return small_frame(real.sparkSession, [], "a string, b string, real double, synth double, diff double")
    def side(df: DataFrame, name: str) -> DataFrame:
        wide = number_rows(df, columns, F.lit("").alias("grp"))
        return pairwise_moments(wide, centers(df, columns), "grp", len(columns)).select("a", "b", F.round(F.coalesce("corr", F.lit(0.0)), 3).alias(name))

    spark, d = real.sparkSession, len(columns)
    pairs = spark.range(d * d).select(F.floor(F.col("id") / d).cast("int").alias("a"), (F.col("id") % d).cast("int").alias("b")).where("a < b")
    both = pairs.join(side(real, "real"), ["a", "b"], "left").join(side(synthetic, "synth"), ["a", "b"], "left").fillna(0.0)
    names = small_frame(spark, list(enumerate(columns)), "i int, name string")  # a row for each column
    for k in "ab":
        both = both.join(F.broadcast(names.toDF(k, f"name_{k}")), k)
    return both.select(F.col("name_a").alias("a"), F.col("name_b").alias("b"), "real", "synth",
                       F.round(F.abs(F.col("real") - F.col("synth")), 3).alias("diff"))


def correlation_summary(pairs: DataFrame) -> DataFrame:
    mean = F.round(F.avg("diff"), 3)
    band = None
    for limit, word in SIMILAR:
        band = F.when(F.col("avg_diff") < limit, word) if band is None else band.when(F.col("avg_diff") < limit, word)
    return pairs.agg(mean.alias("avg_diff")).withColumn("grade", band.otherwise("Poor"))
