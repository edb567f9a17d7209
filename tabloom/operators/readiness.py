"""ML readiness: train on synthetic rows, test on real ones, and compare with training on real rows."""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import draws
from tabloom.functions.kinds import BOOLEAN, FLOAT, INTEGER, kinds, numeric_columns
from tabloom.functions.small import small_frame
from tabloom.operators.frequencies import class_counts
from tabloom.operators.indexing import with_running_sum
from tabloom.session import materialize

# Target names, forest size, test share and limits.
TARGET_NAMES = ("target", "label", "class", "outcome", "y", "output", "result")
TREES, SEED, TEST_SHARE, MAX_CATEGORIES, MIN_ROWS = 50, 42, 0.3, 20, 10
WEAK_R2, WEAK_MARGIN, LOW_SCORE = 10.0, 2.0, 30.0
DEPTH = 10
#: Bins of a feature, as many as Spark's trees tell apart by themselves.
BINS, ACCURACY = 32, 10_000
#: More rows than this are given to a forest as weighted cells of bins.
ROW_BUDGET = 1_000_000
#: Rows that fall into the same bins with the same label are drawn for a tree in so many lots at most.
LOTS = 8
#: Features whose bins are found in one scan.
SCAN_COLUMNS = 50
#: Rows that are ranked together for the split, about.
PART_ROWS = 100_000

RESULT = """available boolean, reason string, target_column string, is_regression boolean, real_score double,
    synth_score double, majority_rate double"""


def pick_target(real: DataFrame, unique: dict[str, int], given: str | None = None) -> str | None:
    """The given target, else a column with a usual target name, else the first one with two values."""
    if given is not None:
        return given if given in real.columns else None
    named = [c for c in real.columns if c.lower() in TARGET_NAMES]
    paired = [c for c in real.columns if unique.get(c) == 2]
    return (named + paired + [None])[0]


def category_values(real: DataFrame, column: str, most: int = MAX_CATEGORIES) -> list[str] | None:
    """Sorted values of a categorical feature, or None if the real table has more than ``most``."""
    values = [r["value"] for r in class_counts(real, column).limit(most + 1).collect()]
    return sorted(values) if len(values) <= most else None


def feature_columns(real: DataFrame, synthetic: DataFrame, target: str, most: int = MAX_CATEGORIES) -> dict[str, Column]:
    """Feature expressions valid on both tables: numbers with gaps as 0, and one indicator for each category of either table
    but the first. Columns with more than ``most`` real categories are no features (see ``left_out``); if the synthetic
    table has more than ``most`` of its own, these share one indicator, so the width never depends on its data."""
    by_kind = kinds(real)
    made: dict[str, Column] = {}
    for c in real.columns:
        if c == target or c not in synthetic.columns:
            continue
        col = F.col(f"`{c}`")
        if by_kind[c] in (INTEGER, FLOAT, BOOLEAN):
            made[c] = F.coalesce(col.cast("double"), F.lit(0.0))
            continue
        values = category_values(real, c, most)
        if not values:
            continue
        own = [r["value"] for r in class_counts(synthetic, c).where(~F.col("value").isin(*values)).limit(most + 1).collect()]
        if len(own) > most:
            made[f"{c}_unseen"] = F.coalesce((~col.cast("string").isin(*values)).cast("double"), F.lit(0.0))
            own = []
        for v in sorted([*values, *own])[1:]:
            made[f"{c}_{v}"] = F.coalesce((col.cast("string") == v).cast("double"), F.lit(0.0))
    return made


def left_out(real: DataFrame, synthetic: DataFrame, target: str, features: dict[str, Column]) -> list[str]:
    """Columns that no feature is made of."""
    used = {c for c in real.columns for f in features if f == c or f.startswith(f"{c}_")}
    return [c for c in real.columns if c != target and c not in used]


def label_index(real: DataFrame, synthetic: DataFrame, target: str) -> DataFrame:
    """(value, label): every target value of either table, numbered in text order. Ranges of values are numbered apart and shifted."""
    both = class_counts(real, target).select("value").union(class_counts(synthetic, target).select("value")).distinct()
    return with_running_sum(both.withColumn("_one", F.lit(1)), ["value"], "_one", "label").select("value", F.col("label").cast("double").alias("label"))


def stratified_split(df: DataFrame, target: str | None, keys: list[str], seed: int = SEED) -> DataFrame:
    """Add ``is_test``: in every class (of the whole table without a target) the 30% of rows with the smallest draws, to the row.

    Draws are hashes of the keys, or of all columns without keys. A class is ranked in buckets of the draw that are numbered
    apart and shifted by the buckets before them, so none is gathered in one place. Null targets are a class.
    """
    ids = [F.col(f"`{k}`") for k in (keys or df.columns)]
    label = F.lit("") if target is None else F.coalesce(F.concat(F.lit("="), F.col(f"`{target}`").cast("string")), F.lit(""))
    drawn = df.withColumns({"_draw": draws.uniform(seed, "split", *ids), "_class": label})
    drawn = drawn.withColumn("_part", F.floor(F.col("_draw") * (1 + df.count() // PART_ROWS)))
    sizes = drawn.groupBy("_class", "_part").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_class")
    ahead = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_class", "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"),
                          F.round(F.sum("_n").over(whole) * F.lit(TEST_SHARE)).alias("_quota"))
    ranked = drawn.withColumn("_rank", F.row_number().over(Window.partitionBy("_class", "_part").orderBy("_draw", *ids)))
    return ranked.join(starts, ["_class", "_part"]).withColumn("is_test", F.col("_before") + F.col("_rank") <= F.col("_quota")).select(
        *[F.col(f"`{c}`") for c in df.columns], "is_test")


def _vectors(df: DataFrame, features: dict[str, Column], label: Column, *more: Column) -> DataFrame:
    named = [x.alias(f"f{i}") for i, x in enumerate(features.values())]
    wide = df.select(label, *more, *named).where(F.col("label").isNotNull())
    assembled = VectorAssembler(inputCols=[f"f{i}" for i in range(len(named))], outputCol="features").transform(wide)
    return assembled.drop(*[f"f{i}" for i in range(len(named))])


def _numbers(df: DataFrame, width: int) -> DataFrame:
    """The label and the features as ``f0``, ``f1``, ..."""
    return df.select("label", vector_to_array("features").alias("x")).select("label", *[F.col("x")[i].alias(f"f{i}") for i in range(width)])


def bin_cuts(df: DataFrame, columns: list[str]) -> list[list[float]]:
    """Where the bins of each column begin: between all its values if they are at most ``BINS``, else at quantiles of a sketch."""
    found: list[list[float]] = []
    for start in range(0, len(columns), SCAN_COLUMNS):
        batch = columns[start:start + SCAN_COLUMNS]
        row = df.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(batch)],
                     *[F.percentile_approx(c, [k / BINS for k in range(1, BINS)], ACCURACY).alias(f"q{i}") for i, c in enumerate(batch)]).first()
        few = [i for i in range(len(batch)) if row[f"d{i}"] <= 2 * BINS]
        values: dict[str, list[float]] = {}
        if few:
            long = df.select(*[batch[i] for i in few]).unpivot([], [batch[i] for i in few], "column", "value").distinct()
            for r in long.collect():  # at most about 2 * BINS for each column
                values.setdefault(r["column"], []).append(r["value"])
        for i, c in enumerate(batch):
            own = sorted(values.get(c, []))
            middles = [a + (b - a) / 2 for a, b in zip(own, own[1:])]
            cuts = middles if 0 < len(own) <= BINS else row[f"q{i}"] or []
            found.append(sorted({x for x in cuts if math.isfinite(x)}))
    return found


def cells(df: DataFrame, cuts: list[list[float]], regression: bool) -> DataFrame:
    """Rows that fall into the same bins as one row: ``features`` (the numbers of the bins), ``label``, how many rows there are (``n``), and
    for a regression, whose label is their mean, the sum of squared distances from it (``spread``)."""
    names, bins = [f"f{i}" for i in range(len(cuts))], [f"b{i}" for i in range(len(cuts))]
    cut = Bucketizer(splitsArray=[[-math.inf, *c, math.inf] if c else [-math.inf, 0.0, math.inf] for c in cuts], inputCols=names, outputCols=bins).transform(df)
    cut = cut.select("label", *[F.col(b).cast("byte").alias(b) for b in bins])
    if regression:
        grouped = cut.groupBy(*bins).agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("label"), (F.var_pop("label") * F.count(F.lit(1))).alias("spread"))
    else:
        grouped = cut.groupBy(*bins, "label").agg(F.count(F.lit(1)).alias("n")).withColumn("spread", F.lit(0.0))
    return VectorAssembler(inputCols=bins, outputCol="features").transform(grouped.sortWithinPartitions(*bins, "label")).select("features", "label", "n", "spread")


def _trained(training: DataFrame, tested: DataFrame, estimator, regression: bool, label: Column) -> DataFrame:
    """``tested`` with the prediction of a forest fitted to all rows of ``training``, and for how many rows (``n``) a row stands.

    A forest reads a feature only as one of ``BINS`` bins, so the rows of a cell of bins are all the same to it. Beyond ``ROW_BUDGET`` rows
    they are weighted instead of repeated; for the bootstrap a cell is split into as many lots as it has rows, up to ``LOTS``, which are
    drawn on their own. Smaller tables are learnt row by row.
    """
    if training.count() <= ROW_BUDGET:
        return estimator.fit(training).transform(tested).withColumns({"n": F.lit(1), "spread": F.lit(0.0)})
    width = len(training.first()["features"])
    training, tested = _numbers(training, width), _numbers(tested, width)
    cuts = bin_cuts(training, [f"f{i}" for i in range(width)])
    lots = F.least(F.col("n"), F.lit(LOTS))
    drawn = cells(training, cuts, regression).select("features", "label", (F.col("n") / lots).alias("weight"), F.explode(F.sequence(F.lit(1).cast("long"), lots)).alias("lot"))
    model = estimator.setWeightCol("weight").fit(materialize(drawn).select("features", label, "weight"))
    return model.transform(cells(tested, cuts, regression))


def _refused(df: DataFrame, reason: str) -> DataFrame:
    return small_frame(df.sparkSession, [(False, reason, None, None, None, None, None)], RESULT)


def _unavailable(df: DataFrame, reason: str) -> DataFrame:
    return graded(_refused(df, reason).withColumn("left_out", F.lit(None).cast("string")))


def tstr(real: DataFrame, synthetic: DataFrame, target: str | None, keys: list[str], regression: bool = False,
         seed: int = SEED, trees: int = TREES, ignore: tuple[str, ...] = (), depth: int = DEPTH, most: int = MAX_CATEGORIES) -> DataFrame:
    """One graded row. ``keys`` identify real rows for the split; they and ``ignore`` are not used as features. Trees end at
    ``depth`` levels (Spark allows 30), and text columns with more than ``most`` values are listed in ``left_out``."""
    drop = [c for c in (*keys, *ignore) if c != target]
    bare, synthetic = real.drop(*drop), synthetic.drop(*drop)
    if target is None or target not in real.columns:
        return _unavailable(real, "no target column")
    if target not in synthetic.columns:
        return _unavailable(real, "the synthetic table lacks the target column")
    numbers = [c for c in numeric_columns(bare) if c != target]
    if not numbers:
        return _unavailable(real, "no numeric feature column")
    if not set(numbers) & set(numeric_columns(synthetic)):
        return _unavailable(real, "no matching numeric feature column in the synthetic table")
    features = feature_columns(bare, synthetic, target, most)
    tested = stratified_split(real, None if regression else target, keys, seed)
    missing = ", ".join(left_out(bare, synthetic, target, features)) or None
    if regression:
        label = F.col(f"`{target}`").cast("double").alias("label")
    else:
        index = materialize(label_index(bare, synthetic, target))
        # With the number of labels declared, a forest takes any number of classes.
        label = F.col("label").alias("label", metadata={"ml_attr": {"name": "label", "type": "nominal", "num_vals": max(2, index.count())}})
        tested, synthetic = (t.drop("value", "label").join(index, F.col(f"`{target}`").cast("string") == F.col("value")) for t in (tested, synthetic))
    on_real = materialize(_vectors(tested, features, label, F.col("is_test")))
    on_synthetic = materialize(_vectors(synthetic, features, label))
    more = (trees, seed, depth)
    scores = _regression(on_real, on_synthetic, target, *more) if regression else _classification(on_real, on_synthetic, target, label, *more)
    return graded(scores.withColumn("left_out", F.lit(missing).cast("string")))


def _classification(real: DataFrame, synthetic: DataFrame, target: str, label: Column, trees: int, seed: int, depth: int) -> DataFrame:
    tested = real.where("is_test")
    counts = {r["label"]: r["n"] for r in tested.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if real.select("label").distinct().limit(2).count() < 2:
        return _refused(real, "the target has a single class")
    if not counts or real.where("not is_test").isEmpty() or synthetic.isEmpty():
        return _refused(real, "not enough rows")
    scores = []
    for training in (real.where("not is_test"), synthetic):
        forest = RandomForestClassifier(numTrees=trees, seed=seed, maxDepth=depth, cacheNodeIds=True)
        hits = F.sum(F.when(F.col("prediction") == F.col("label"), F.col("n")).otherwise(0)) / F.sum("n")
        scores.append(round(_trained(training, tested, forest, False, label).agg(hits).first()[0] * 100, 1))
    majority = round(max(counts.values()) / sum(counts.values()) * 100, 1)
    return small_frame(real.sparkSession, [(True, None, target, False, *scores, majority)], RESULT)


def _regression(real: DataFrame, synthetic: DataFrame, target: str, trees: int, seed: int, depth: int) -> DataFrame:
    if real.limit(MIN_ROWS).count() < MIN_ROWS or synthetic.limit(MIN_ROWS).count() < MIN_ROWS:
        return _refused(real, "not enough rows")
    tested = real.where("is_test")
    every = tested.agg(F.var_samp("label") * (F.count("label") - 1)).first()[0]
    scores = []
    for training in (real.where("not is_test"), synthetic):
        forest = RandomForestRegressor(numTrees=trees, seed=seed, maxDepth=depth, cacheNodeIds=True)
        rest = F.sum(F.col("n") * (F.col("label") - F.col("prediction")) ** 2 + F.col("spread"))
        rest = _trained(training, tested, forest, True, F.col("label")).agg(rest).first()[0]
        fit = 1 - rest / every if every else 0.0
        scores.append(round(max(0.0, min(1.0, fit)) * 100, 1))
    return small_frame(real.sparkSession, [(True, None, target, True, *scores, None)], RESULT)


def graded(results: DataFrame) -> DataFrame:
    """Gap, grade, colour and a note for rows of scores."""
    real, synth = F.col("real_score"), F.col("synth_score")
    gap = F.round(real - synth, 1)
    gap_pct = F.when(real > 0, F.round(F.abs(gap) / F.nullif(real, F.lit(0.0)) * 100, 1)).otherwise(F.lit(0.0))
    weak = F.when(F.col("is_regression"), real < WEAK_R2).otherwise(real <= F.col("majority_rate") + WEAK_MARGIN)
    rows = results.withColumns({"gap": gap, "gap_pct": gap_pct, "weak": weak})
    grade = (
        F.when(~F.col("available"), F.lit(None))
        .when(F.col("weak"), "Inconclusive").when(synth > real, "Excellent").when(F.col("gap_pct") <= 10, "Excellent")
        .when(F.col("gap_pct") <= 20, "Good").when(F.col("gap_pct") <= 35, "Fair").otherwise("Poor"))
    note = (
        F.when(~F.col("available"), F.col("reason"))
        .when(F.col("weak"), "even the model trained on real rows barely predicts the target")
        .when(synth > real, "training on synthetic rows did better than on real ones")
        .when(F.col("gap_pct") <= 5, "nearly as good as real rows").when(F.col("gap_pct") <= 10, "very close to real rows")
        .when(F.col("gap_pct") <= 20, "usable for training and tests").when(F.col("gap_pct") <= 35, "usable for first experiments")
        .otherwise("needs more data-quality fixes before training"))
    color = (
        F.when(F.col("grade") == "Excellent", "green").when(F.col("grade").isin("Good", "Fair"), "yellow")
        .when(F.col("grade") == "Poor", "red").when(F.col("grade") == "Inconclusive", "neutral"))
    return rows.withColumn("grade", grade).withColumns({
        "color": color, "note": note, "low_signal": F.coalesce(synth <= LOW_SCORE, F.lit(False)),
    }).drop("weak")
