"""The three whole runs: analyse a table, generate rows with scores, and generate text rows."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.kinds import FLOAT, INTEGER, flat_table, kinds
from tabloom.functions.small import small_frame
from tabloom.operators import classes, clean, fixes, inference, issues, ledger, readiness, scoring, text, transforms
from tabloom.operators.bootstrap import bootstrap_rows
from tabloom.operators.numeric import numeric_facts
from tabloom.operators.profile import BOOLEAN_TYPE, TableProfile, profile_table
from tabloom.plans.routing import BOOTSTRAP_ROWS, select_strategy, table_traits
from tabloom.session import materialize, working_copy

ROW_KEY = "row_key"


class UnusableTable(ValueError):
    """The table has nothing to learn from."""


@dataclass
class Analysis:
    table: DataFrame
    profile: TableProfile
    issues: DataFrame
    dataset: DataFrame
    text_columns: list[str]
    rejected: dict[str, str]


def analyse(df: DataFrame, keys: list[str], target: str | None = None, check: bool = True) -> Analysis:
    """Profile, issues, dataset facts with the chosen route, and text columns."""
    table, rejected = flat_table(df)
    profile = profile_table(table.drop(*[k for k in keys if k == ROW_KEY]))
    found = text.text_columns(table, text.unique_shares(profile))
    texts = [r["column"] for r in found.where("is_text").collect()]
    if check:
        refused = inference.usability(profile.frame, bool(texts)).where("refused").collect()
        if refused:
            raise UnusableTable(refused[0]["reason"])
    report = issues.issue_report(profile.frame)
    return Analysis(table, profile, report, _dataset(profile, report, target), texts, rejected)


def _dataset(profile: TableProfile, report: DataFrame, target: str | None) -> DataFrame:
    """Facts of the table with the chosen route, for the target found or given."""
    traits = table_traits(profile.frame, report).first()
    if target is None:
        dataset = inference.dataset_profile(profile.frame)
    else:
        dataset, _ = inference.override_target(profile, target)
    return select_strategy(dataset.withColumns({k: F.lit(traits[k]) for k in ("all_numeric", "clean")}))


@dataclass
class Run:
    rows: DataFrame
    cleaned: DataFrame
    strategy: str
    skipped: list[dict]
    target: str | None
    target_type: str | None


def generate_rows(df: DataFrame, n: int, keys: list[str], analysis: Analysis | None = None, target: str | None = None,
                  fix_list: list[fixes.Fix] | str | None = None, class_counts: dict[str, int] | None = None,
                  seed: int = 42, holdout_first: bool = False, ledger_path: str | None = None, run_id: str | None = None) -> Run:
    """Clean, fit, sample and repair. ``keys`` identify rows (they are never modelled); ``fix_list='all'`` applies
    every reported issue's fix. A ``target`` counts also where an ``analysis`` has found another. ``rows`` is lazy and keyed by ``row_id``. With ``holdout_first`` the rows on which
    ``score_run`` later tests models take no part in the fit. With a ``ledger_path`` the rows are written once, counted, and
    the run is entered there under its ``run_id``."""
    if ledger_path is not None and not run_id:
        raise ValueError("a run is entered under its run_id")
    table = analysis.table if analysis else flat_table(df)[0]
    with working_copy(table) as copy:
        if analysis is None:
            analysis = analyse(copy, keys, target)
        elif target is not None:
            analysis = replace(analysis, dataset=_dataset(analysis.profile, analysis.issues, target))
        run = _generate(copy, n, keys, analysis, fix_list, class_counts, seed, holdout_first)
        return run if ledger_path is None else replace(run, rows=_entered(run.rows, run.strategy, ledger_path, run_id))


def _entered(rows: DataFrame, strategy: str, ledger_path: str, run_id: str) -> DataFrame:
    """The rows, written once, after the run has been entered in the ledger."""
    rows = materialize(rows)
    entry = small_frame(rows.sparkSession, [(run_id, strategy, rows.count())], ledger.RUNS)
    ledger.commit(entry, ledger_path, run_id)
    return rows


def _generate(table: DataFrame, n: int, keys: list[str], analysis: Analysis, fix_list: list[fixes.Fix] | str | None,
              class_counts: dict[str, int] | None, seed: int, holdout_first: bool) -> Run:
    facts_row = analysis.dataset.first()
    target, target_type = facts_row["target_column"], facts_row["target_type"]
    wanted = fixes.fixes_from_report(analysis.issues) if fix_list == "all" else (fix_list or [])
    held = [k for k in keys if k in table.columns]
    key_copies = {f"_key{i}": F.col(f"`{k}`") for i, k in enumerate(held)}
    fixed = fixes.apply_fixes(table.withColumns(key_copies), wanted)
    cleaned = clean.auto_clean(fixed, analysis.profile, target)
    columns = [c for c in cleaned.columns if c not in key_copies and c not in held]
    if target not in columns:
        target, target_type = None, None
    fitted = cleaned
    if holdout_first:
        by_class = target if target_type == "classification" else None
        fitted = readiness.stratified_split(cleaned, by_class, list(key_copies), seed).where("not is_test").drop("is_test")
    with working_copy(fitted.select(*columns, *key_copies)) as real:
        made = _sample(real, columns, list(key_copies), analysis, facts_row["strategy"], target, target_type, n,
                       class_counts, seed)
    return Run(made.rows, cleaned.select(*columns, *key_copies), made.strategy, made.skipped, target, target_type)


def _sample(real: DataFrame, columns: list[str], keys: list[str], analysis: Analysis, strategy: str,
            target: str | None, target_type: str | None, n: int, class_counts: dict[str, int] | None,
            seed: int) -> classes.Generated:
    by_kind = kinds(real)
    numeric = [c for c in columns if by_kind[c] in (INTEGER, FLOAT)]
    facts = numeric_facts(real, numeric)
    uneven = [c for c in numeric if not facts[c].whole and not facts[c].integer]
    places = transforms.decimal_places(real, uneven)
    if target_type == "regression":
        class_counts = None
    if analysis.profile.n_rows < BOOTSTRAP_ROWS and not class_counts:
        rows = bootstrap_rows(real, n, keys or columns, seed, columns=columns)
        return classes.Generated(_repair(rows, real, facts, places, {}), None, "bootstrap", [])
    codes = transforms.discrete_codes(analysis.profile, columns, target)
    codes += [c for c in numeric if analysis.profile.types.get(c) == BOOLEAN_TYPE and c not in codes]
    if target_type == "classification" and target in numeric and target not in codes:
        codes.append(target)
    skewed = [c for c in transforms.skewed_columns({c: facts[c] for c in numeric if c not in codes}, target)]
    ready = transforms.log_transform(transforms.encode_discrete(real.select(*columns), codes), skewed)
    made = _strategy(ready, columns, target, target_type, strategy, n, class_counts, seed)
    fills = {c: made.model.median(c) for c in numeric if c in made.model.numeric}
    rows = transforms.reverse_log(made.rows, skewed, facts)
    rows = transforms.decode_discrete(rows, codes, real)
    rows = _repair(rows, real, facts, places, fills)
    return classes.Generated(rows, made.model, made.strategy, made.skipped)


def _strategy(ready: DataFrame, columns: list[str], target: str | None, target_type: str | None, strategy: str, n: int,
              class_counts: dict[str, int] | None, seed: int) -> classes.Generated:
    skipped: list[dict] = []
    if class_counts and target and target_type == "classification":
        made = classes.generate_per_class(ready, columns, target, class_counts, seed)
        if made.rows is not None:
            return made
        skipped = made.skipped
    if strategy == "conditional" and target and target_type == "classification":
        made = classes.generate_conditional(ready, columns, target, n, seed)
    elif strategy == "copula":
        made = classes.generate_pooled(ready, columns, n, seed)
    else:
        made = classes.generate_mixture(ready, columns, n, seed=seed)
    made.skipped = skipped
    return made


def _repair(rows: DataFrame, real: DataFrame, facts: dict, places: dict[str, int], fills: dict[str, float]) -> DataFrame:
    rows = transforms.restore_types(rows, facts, places, fills)
    return transforms.domain_constraints(rows, facts, fills=fills)


@dataclass
class Scores:
    realism: DataFrame
    columns: DataFrame
    readiness: DataFrame | None


def score_run(run: Run, seed: int = 42, with_models: bool = True) -> Scores:
    """Score a run. The synthetic rows feed many actions, so they are written once first."""
    synthetic = materialize(run.rows)
    keys = [c for c in run.cleaned.columns if c.startswith("_key")]
    real, bare = run.cleaned.drop(*keys), synthetic.drop("row_id")
    parts = (
        scoring.distinguishability(run.cleaned, synthetic, seed, keys or None, ["row_id"]) if with_models else None,
        scoring.statistical_similarity(real, bare).first()[0], scoring.coverage(real, bare).first()[0])
    frame = small_frame(real.sparkSession, [parts],
                        "distinguishability_score double, statistical_score double, coverage_score double")
    ready = None
    if with_models:
        ready = readiness.tstr(run.cleaned, bare, run.target, keys, run.target_type == "regression", seed)
    return Scores(scoring.realism(frame), scoring.column_quality(real, bare), ready)


def generate_text_rows(df: DataFrame, n: int, key: str, lexicon: DataFrame, label: str | None = None,
                       counts: dict[str, int] | DataFrame | None = None, strength: str = "medium", seed: int = 42,
                       ledger_path: str | None = None, run_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Text rows and their quality per column, entered in the ledger as ``generate_rows`` does. A table with text columns only gets augmented copies of its rows; any
    other gets rows anchored to real ones, by label if there is one."""
    analysis = analyse(df, [key])
    if not analysis.text_columns:
        raise UnusableTable("no text column: use generate_rows")
    others = [c for c in analysis.table.columns if c not in analysis.text_columns and c != key]
    if not others:
        size = analysis.profile.n_rows
        rows = text.augment_dataset(analysis.table, analysis.text_columns, size + n, key, lexicon, strength, seed)
        rows = rows.where("variant > 0")
    else:
        label = label or analysis.dataset.first()["target_column"]
        rows = text.hybrid_generate(analysis.table, analysis.text_columns, n, [key], lexicon, label, counts, strength, seed)
    rows = materialize(rows) if ledger_path is None else _entered(rows, "text" if not others else "hybrid text", ledger_path, run_id)
    return rows, text.text_quality(analysis.table, rows, analysis.text_columns)
