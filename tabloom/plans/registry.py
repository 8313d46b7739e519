"""Algorithms, their hyperparameters, and the grids searched over them."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import product

from tabloom.errors import TrainError

# fixed values: algorithm and its task
TASKS = {
    "LinearRegression": "regression",
    "LogisticRegression": "classification",
    "DecisionTree": "classification",
    "RandomForest": "classification",
    "KNeighborsClassifier": "classification",
    "KNeighborsRegressor": "regression",
    "KMeans": "clustering",
    "SVC": "classification",
    "SVR": "regression",
    "Lasso": "regression",
    "Ridge": "regression",
    # regressors of the tree family
    "DecisionTreeRegressor": "regression",
    "RandomForestRegressor": "regression",
}

# fixed values: parameter, type and default of each algorithm
PARAMETERS: dict[str, list[tuple[str, str, object]]] = {
    "LinearRegression": [
        ("fit_intercept", "bool", True),
        ("normalize", "bool", False),
        ("copy_X", "bool", True),
        ("n_jobs", "int", None),
        ("positive", "bool", False),
    ],
    "LogisticRegression": [
        ("C", "float", 1.0),
        ("penalty", "str", "l2"),
        ("solver", "str", "lbfgs"),
        ("max_iter", "int", 100),
        ("multi_class", "str", "auto"),
        ("l1_ratio", "float", None),
    ],
    "DecisionTree": [
        ("max_depth", "int", None),
        ("min_samples_split", "int", 2),
        ("min_samples_leaf", "int", 1),
        ("max_features", "str", None),
        ("criterion", "str", "gini"),
    ],
    "RandomForest": [
        ("n_estimators", "int", 100),
        ("max_depth", "int", None),
        ("min_samples_split", "int", 2),
        ("min_samples_leaf", "int", 1),
        ("max_features", "str", "sqrt"),
        ("bootstrap", "bool", True),
    ],
    "KNeighborsClassifier": [
        ("n_neighbors", "int", 5),
        ("weights", "str", "uniform"),
        ("metric", "str", "minkowski"),
        ("p", "int", 2),
        ("algorithm", "str", "auto"),
    ],
    "KNeighborsRegressor": [
        ("n_neighbors", "int", 5),
        ("weights", "str", "uniform"),
        ("metric", "str", "minkowski"),
        ("p", "int", 2),
        ("leaf_size", "int", 30),
    ],
    "KMeans": [
        ("n_clusters", "int", 8),
        ("init", "str", "k-means++"),
        ("max_iter", "int", 300),
        ("n_init", "int", 10),
        ("tol", "float", 0.0001),
    ],
    "SVC": [
        ("C", "float", 1.0),
        ("kernel", "str", "rbf"),
        ("gamma", "str", "scale"),
        ("degree", "int", 3),
        ("class_weight", "str", None),
    ],
    "SVR": [
        ("C", "float", 1.0),
        ("kernel", "str", "rbf"),
        ("epsilon", "float", 0.1),
        ("gamma", "str", "scale"),
        ("degree", "int", 3),
    ],
    "Lasso": [
        ("alpha", "float", 1.0),
        ("max_iter", "int", 1000),
        ("tol", "float", 0.0001),
        ("fit_intercept", "bool", True),
        ("selection", "str", "cyclic"),
    ],
    "Ridge": [
        ("alpha", "float", 1.0),
        ("fit_intercept", "bool", True),
        ("solver", "str", "auto"),
        ("max_iter", "int", None),
        ("tol", "float", 0.001),
    ],
    "DecisionTreeRegressor": [
        ("max_depth", "int", None),
        ("min_samples_split", "int", 2),
        ("min_samples_leaf", "int", 1),
        ("max_features", "str", None),
    ],
    "RandomForestRegressor": [
        ("n_estimators", "int", 100),
        ("max_depth", "int", None),
        ("min_samples_split", "int", 2),
        ("min_samples_leaf", "int", 1),
        ("max_features", "str", "sqrt"),
        ("bootstrap", "bool", True),
    ],
}

# fixed values: grid axes that change the result; solvers, tolerances and search
# structures are left out because they reach the same optimum
GRIDS: dict[str, list[dict[str, list]]] = {
    "LinearRegression": [{"fit_intercept": [True, False], "positive": [True, False]}],
    "LogisticRegression": [
        {"C": [0.01, 0.1, 1.0, 10.0, 100.0], "penalty": ["l2"], "max_iter": [100, 500]},
        {"C": [0.01, 0.1, 1.0, 10.0, 100.0], "penalty": ["l1"], "max_iter": [100, 500]},
        {"C": [0.01, 0.1, 1.0, 10.0, 100.0], "penalty": ["elasticnet"], "max_iter": [100, 500], "l1_ratio": [0.25, 0.5, 0.75]},
    ],
    "DecisionTree": [
        {
            "max_depth": [None, 5, 10, 20],
            "min_samples_split": [2, 5, 10],
            "min_samples_leaf": [1, 2, 5],
            "criterion": ["gini", "entropy"],
            "max_features": [None, "sqrt", "log2"],
        }
    ],
    "RandomForest": [
        {
            "n_estimators": [50, 100, 200],
            "max_depth": [None, 5, 10],
            "min_samples_split": [2, 5, 10],
            "min_samples_leaf": [1, 2, 5],
            "max_features": ["sqrt", "log2"],
            "bootstrap": [True, False],
        }
    ],
    "KNeighborsClassifier": [
        {"n_neighbors": [3, 5, 7, 11, 15], "weights": ["uniform", "distance"], "metric": ["euclidean", "manhattan"]}
    ],
    "KNeighborsRegressor": [
        {"n_neighbors": [3, 5, 7, 11, 15], "weights": ["uniform", "distance"], "metric": ["euclidean", "manhattan"]}
    ],
    "SVC": [
        {"C": [0.1, 1.0, 10.0, 100.0], "kernel": ["linear"], "class_weight": [None, "balanced"]},
        {"C": [0.1, 1.0, 10.0, 100.0], "kernel": ["rbf", "sigmoid"], "gamma": ["scale", "auto", 0.001, 0.01, 0.1], "class_weight": [None, "balanced"]},
        {"C": [0.1, 1.0, 10.0, 100.0], "kernel": ["poly"], "gamma": ["scale", "auto"], "class_weight": [None, "balanced"], "degree": [2, 3, 4]},
    ],
    "SVR": [
        {"C": [0.1, 1.0, 10.0, 100.0], "kernel": ["linear"], "epsilon": [0.01, 0.1, 0.5]},
        {"C": [0.1, 1.0, 10.0, 100.0], "kernel": ["rbf", "sigmoid"], "epsilon": [0.01, 0.1, 0.5], "gamma": ["scale", "auto"]},
        {"C": [0.1, 1.0, 10.0, 100.0], "kernel": ["poly"], "epsilon": [0.01, 0.1, 0.5], "gamma": ["scale", "auto"], "degree": [2, 3, 4]},
    ],
    "Lasso": [{"alpha": [0.0001, 0.001, 0.01, 0.1, 1.0, 10.0], "max_iter": [1000, 5000, 10000], "fit_intercept": [True, False]}],
    "Ridge": [{"alpha": [0.0001, 0.001, 0.01, 0.1, 1.0, 10.0, 100.0], "fit_intercept": [True, False]}],
}


def task_of(algorithm: str) -> str:
    if algorithm not in TASKS:
        raise TrainError(f"Model '{algorithm}' is not supported.")
    return TASKS[algorithm]


def parameters(algorithm: str) -> dict[str, tuple[str, object]]:
    """{name: (type, default)}"""
    task_of(algorithm)
    return {name: (kind, default) for name, kind, default in PARAMETERS[algorithm]}


def cast(kind: str, value):
    """A hyperparameter given as text or as a value, in its declared type."""
    if value is None or value == "None":
        return None
    if kind == "bool":
        return value.lower() in ("true", "1", "yes") if isinstance(value, str) else bool(value)
    if kind == "int":
        return int(value)
    if kind == "float":
        return float(value)
    return value


def resolve(algorithm: str, given: Mapping[str, object] | None) -> dict:
    """Defaults overlaid by the given values. Unknown names pass through."""
    known = parameters(algorithm)
    out = {name: cast(kind, default) for name, (kind, default) in known.items()}
    for name, value in (given or {}).items():
        if name not in known:
            out[name] = value
            continue
        try:
            out[name] = cast(known[name][0], value)
        except (TypeError, ValueError) as e:
            raise TrainError(f"{algorithm}: {name}={value!r} is not a {known[name][0]}") from e
    return out


def grid(algorithm: str) -> list[dict]:
    """All parameter combinations to search."""
    if task_of(algorithm) == "clustering":
        raise TrainError(f"Auto-Tune is not supported for clustering models like '{algorithm}'.")
    out = []
    for axes in GRIDS.get(algorithm, [{}]):
        out += [dict(zip(axes, values)) for values in product(*axes.values())]
    return out
