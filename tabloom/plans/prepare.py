"""The preparation in its fixed order, fitted step by step.

Each step computes the statistics of all its columns together and becomes plain
expressions over the input, so consecutive steps collapse into one projection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from tabloom.errors import PrepareError
from tabloom.operators import balance, encode, knn_impute, missing, outliers, reduce, scale, select, transform
from tabloom.plans.steps import FittedPreparation, Step
from tabloom.session import working_copy
from tabloom.types import dtype_of, is_numeric, nan_to_null

# fixed values: steps in the order they run, each with its operations by precedence
STEPS = {
    "drop_columns": ["remove_duplicates", "drop_attr"],
    "missing_values": ["drop_rows", "knn", "mean", "median", "mode", "constant"],
    "outliers": ["iqr", "zscore", "replace_mean", "replace_median", "replace_mode", "replace_constant"],
    "encoding": ["onehot", "label", "target", "freq", "ordinal"],
    "scaling": ["minmax", "zscore_scale", "standard", "robust", "maxabs"],
    "transformations": ["log", "sqrt", "reciprocal", "yeojohnson", "boxcox", "binning", "discretization"],
    "feature_selection": ["low_variance", "kbest", "correlation_threshold", "tree_importance", "chi2"],
    "data_reduction": ["pca", "lda", "ica"],
    "imbalanced_data": ["smote", "class_weights"],
}


@dataclass
class PrepareResult:
    df: DataFrame
    step_log: DataFrame
    fitted: FittedPreparation
    artifacts: dict[str, DataFrame] = field(default_factory=dict)


class _Run:
    def __init__(self, df: DataFrame, attributes: Sequence[str], target: str | None):
        self.df = df
        self.attributes = [a for a in attributes if a in df.columns]
        self.target = target
        self.steps: list[Step] = []

    def add(self, step: Step) -> None:
        self.steps.append(step)
        self.df = step.apply(self.df, fitting=True)

    def numeric(self, names: Sequence[str] | None = None) -> list[str]:
        names = self.attributes if names is None else names
        return [a for a in names if a in self.df.columns and is_numeric(dtype_of(self.df, a))]

    def categorical(self) -> list[str]:
        return [a for a in self.attributes if a in self.df.columns and not is_numeric(dtype_of(self.df, a))]

    def present(self) -> list[str]:
        return [a for a in self.attributes if a in self.df.columns]

    def require_numeric(self, step: str, words: str) -> None:
        for a in self.present():
            if not is_numeric(dtype_of(self.df, a)):
                raise PrepareError(step, None, f"Attribute '{a}' is not numeric. {words} numeric data.")

    def has_target(self) -> bool:
        return bool(self.target) and self.target in self.df.columns


def prepare(
    df: DataFrame,
    operations: Mapping[str, Sequence[str]],
    attributes: Sequence[str],
    target: str | None = None,
    strict: bool = True,
    values: Mapping[str, object] | None = None,
    seed: int = 42,
    max_categories: int = encode.MAX_ONEHOT,
) -> PrepareResult:
    """Fit and apply the chosen operations to the chosen attributes.

    ``values`` gives the constant per column for ``constant`` and ``replace_constant``.
    With ``strict`` unknown steps and operations are errors; otherwise they are skipped.
    """
    chosen = {s: [o for o in ops if o] for s, ops in operations.items()}
    if not attributes or not any(chosen.values()):
        raise PrepareError("request", None, "No attributes or operations selected")
    for step, ops in chosen.items():
        for op in ops:
            if strict and op not in STEPS.get(step, ()):
                raise PrepareError(step, op, "Unknown operation.")
    asked = lambda step: [o for o in STEPS[step] if o in chosen.get(step, ())]

    clean = nan_to_null(df)
    artifacts: dict[str, DataFrame] = {}
    # steps that build rows are computed once, so their result is kept as it is
    builds_rows = "knn" in asked("missing_values") or "smote" in asked("imbalanced_data")
    if builds_rows:
        run = _Run(clean, attributes, target)
        _fit(run, asked, values, max_categories, seed, artifacts)
        out = run.df
    else:
        with working_copy(clean) as held:
            run = _Run(held, attributes, target)
            _fit(run, asked, values, max_categories, seed, artifacts)
        out = clean
        for step in run.steps:
            out = step.apply(out, fitting=True)
        if "class_weights" in artifacts:
            artifacts["class_weights"] = balance.class_weights(out, target)

    now = datetime.now(timezone.utc).replace(tzinfo=None)
    log = [(step, op, list(attributes), now) for step, ops in chosen.items() for op in ops]
    schema = "step_type string, op_name string, attributes array<string>, ts timestamp_ntz"
    step_log = df.sparkSession.createDataFrame(log, schema)
    return PrepareResult(out, step_log, FittedPreparation(run.steps), artifacts)


def _fit(run: _Run, asked, values, max_categories: int, seed: int, artifacts: dict[str, DataFrame]) -> None:
    _drop(run, asked("drop_columns"))
    numeric, categorical = run.numeric(), run.categorical()
    _missing(run, asked("missing_values"), numeric, values)
    _outliers(run, asked("outliers"), numeric, values)
    _encoding(run, asked("encoding"), categorical, max_categories)
    numeric = run.numeric()
    _scaling(run, asked("scaling"), numeric)
    _transformations(run, asked("transformations"), numeric)
    numeric = _selection(run, asked("feature_selection"), numeric, seed)
    numeric = _reduction(run, asked("data_reduction"), numeric, seed)
    _imbalance(run, asked("imbalanced_data"), numeric, seed, artifacts)


def _drop(run: _Run, ops: list[str]) -> None:
    if "remove_duplicates" in ops:
        run.add(Step("drop_columns", "remove_duplicates", rows_only_in_fit=lambda d: d.dropDuplicates()))
    if "drop_attr" in ops:
        run.add(Step("drop_columns", "drop_attr", drop=run.present()))
        run.attributes = []


def _missing(run: _Run, ops: list[str], numeric: list[str], values) -> None:
    if not ops:
        return
    if "drop_rows" in ops:
        if run.present():
            run.add(missing.drop_rows(run.df, run.present()))
    elif "knn" in ops and numeric:
        run.add(Step("missing_values", "knn", fill=knn_impute.NeighbourFill.fit(run.df)))
    else:
        for op in ("mean", "median", "mode", "constant"):
            if op in ops:
                run.add(missing.fit_fill(run.df, run.present(), op, values))
                break


def _outliers(run: _Run, ops: list[str], numeric: list[str], values) -> None:
    if not ops:
        return
    if run.categorical():
        raise PrepareError("outliers", ops[0], "Attribute is not numeric")
    if numeric:
        run.add(outliers.fit_outliers(run.df, numeric, ops[0], values))


def _encoding(run: _Run, ops: list[str], categorical: list[str], max_categories: int) -> None:
    if not ops:
        return
    for a in run.numeric():
        raise PrepareError("encoding", ops[0], f"Attribute '{a}' is not categorical. Encoding requires categorical data.")
    if "onehot" in ops and categorical:
        run.add(encode.fit_onehot(run.df, categorical, max_categories))
        categorical = []
    if "label" in ops:
        if not categorical:
            raise PrepareError("encoding", "label", "Label encoding requires at least one categorical column to be selected.")
        run.add(encode.fit_label(run.df, categorical))
    if "target" in ops and categorical:
        if not run.has_target():
            raise PrepareError("encoding", "target", "Target Encoding requires a target column to be selected.")
        run.add(encode.fit_target(run.df, categorical, run.target))
    if "freq" in ops and categorical:
        run.add(encode.fit_freq(run.df, categorical))
    if "ordinal" in ops and categorical:
        run.add(encode.fit_ordinal(run.df, categorical))


def _scaling(run: _Run, ops: list[str], numeric: list[str]) -> None:
    if ops:
        run.require_numeric("scaling", "Scaling requires")
        if numeric:
            run.add(scale.fit_scale(run.df, numeric, ops[0]))


def _transformations(run: _Run, ops: list[str], numeric: list[str]) -> None:
    if not ops or not numeric:
        return
    run.require_numeric("transformations", "Transformations require")
    shaping = [o for o in ops if o not in ("binning", "discretization")]
    if shaping:
        run.add(transform.fit_transform(run.df, numeric, shaping[0]))
    if len(shaping) < len(ops):
        run.add(transform.fit_binning(run.df, numeric))


def _selection(run: _Run, ops: list[str], numeric: list[str], seed: int) -> list[str]:
    if not ops:
        return numeric
    run.require_numeric("feature_selection", "Feature selection requires")
    if not numeric:
        raise PrepareError("feature_selection", ops[0], "No numeric columns selected. Feature selection requires numeric data.")
    for op in ops:
        if op == "low_variance":
            step = select.fit_low_variance(run.df, numeric)
        elif op == "kbest":
            step = select.fit_kbest(run.df, numeric, run.target)
        elif op == "correlation_threshold":
            step = select.fit_correlation(run.df, numeric)
        elif op == "tree_importance":
            step = select.fit_tree(run.df, numeric, run.target, seed=seed)
        else:
            step = select.fit_chi2(run.df, numeric, run.target)
        run.add(step)
        numeric = [c for c in numeric if c not in step.drop]
    return numeric


def _reduction(run: _Run, ops: list[str], numeric: list[str], seed: int) -> list[str]:
    if not ops:
        return numeric
    if not numeric:
        raise PrepareError("data_reduction", ops[0], "Data reduction requires at least 2 numeric columns.")
    run.require_numeric("data_reduction", "Data reduction requires")
    if "pca" in ops:
        step = reduce.fit_pca(run.df, numeric)
    elif "lda" in ops:
        if not run.has_target():
            raise PrepareError("data_reduction", "lda", "LDA requires a target column.")
        step = reduce.fit_lda(run.df, numeric, run.target)
    else:
        step = reduce.fit_ica(run.df, numeric, seed=seed)
    run.add(step)
    return list(step.projection.names)


def _imbalance(run: _Run, ops: list[str], numeric: list[str], seed: int, artifacts: dict) -> None:
    if not ops:
        return
    features = [c for c in numeric if c != run.target]
    target = balance.check_target(run.df, features, run.target)
    if "smote" in ops:
        run.add(balance.fit_smote(features, target, seed))
    if "class_weights" in ops:
        artifacts["class_weights"] = balance.class_weights(run.df, target)
