"""Decision trees and forests grown by levels from histograms, with explicit stop rules.

Features are cut into bins once; a split is a cut between bins. A node that holds many rows is
split by one aggregate per level: tasks add up label statistics per node, feature and bin, and
the best cut of a node is chosen where its bins meet. As soon as a node holds no more than
LOCAL_ROWS rows, its whole subtree is grown by the same rule in one task, so depth costs no
further passes. Every node stops by the rules given: depth, rows to split, rows per leaf, or
labels that are all alike. The trees are flat arrays.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.plans.features import FEATURES
from tabloom.session import materialize

MAX_BINS = 256
CUT_ROWS = 20_000  # rows, drawn by hash, that cuts are taken from; smaller tables give all
LOCAL_ROWS = 100_000
NAMES = {"feature": int, "threshold": float, "left": int, "right": int, "value": float, "rows": int}
HISTOGRAM_NUMBERS = 4_000_000  # of the nodes of one pass, per task
COUNTED = 50_000  # rows, about, that are added to the histograms at once


@dataclass(frozen=True)
class Rules:
    task: str
    classes: int = 0
    criterion: str = "gini"
    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    max_features: str | float | None = None
    bootstrap: bool = False
    seed: int = 42

    @property
    def width(self) -> int:
        """Numbers kept per bin: rows, then weights per class or weight, sum and sum of squares."""
        return 1 + (self.classes if self.task == "classification" else 3)

    def chosen(self, d: int) -> int:
        if self.max_features is None or self.max_features == "all":
            return d
        if self.max_features == "sqrt":
            return max(1, int(d**0.5))
        if self.max_features == "log2":
            return max(1, int(np.log2(d))) if d > 1 else 1
        value = float(self.max_features)
        return max(1, min(d, int(value) if value > 1 else int(value * d)))

    def impurity(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight, weighted impurity) of statistics [..., width]."""
        if self.task == "classification":
            w = s[..., 1:].sum(-1)
            p = s[..., 1:] / np.maximum(w, 1e-300)[..., None]
            if self.criterion == "gini":
                return w, w * (1 - np.square(p).sum(-1))
            return w, -w * (p * np.log2(np.where(p > 0, p, 1.0))).sum(-1)
        w = s[..., 1]
        return w, np.maximum(s[..., 3] - s[..., 2] ** 2 / np.maximum(w, 1e-300), 0.0)

    def value(self, s: np.ndarray) -> list[float]:
        if self.task == "classification":
            return (s[1:] / max(s[1:].sum(), 1e-300)).tolist()
        return [float(s[2] / max(s[1], 1e-300))]


def mixed(*parts: int) -> int:
    """A number that stands for a node, from the numbers of its tree and of its path."""
    x = 0
    for p in parts:
        x = ((x ^ (p & (1 << 64) - 1)) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1
        x ^= x >> 29
    return x & (1 << 62) - 1


def best_cut(histogram: np.ndarray, rules: Rules, node: int) -> tuple[int, int, int, np.ndarray, np.ndarray] | None:
    """(feature, last bin on the left, first with rows on the right, statistics left, right) of the cut that
    leaves least impurity, the first of equal ones; None where no cut is allowed. ``histogram``:
    [features, bins, width]."""
    whole = histogram[0].sum(0)
    left = histogram.cumsum(1)[:, :-1]
    right = whole - left
    rows_left, rows_right = left[..., 0], right[..., 0]
    able = (rows_left >= max(1, rules.min_samples_leaf)) & (rows_right >= max(1, rules.min_samples_leaf))
    d, most = len(histogram), rules.chosen(len(histogram))
    if most < d:
        # features that are not constant here, in an order drawn for the node
        order = np.random.default_rng(mixed(rules.seed, node)).permutation(d)
        differ = ((rows_left > 0) & (rows_right > 0)).any(1)
        kept = order[differ[order]][:most]
        outside = np.ones(d, bool)
        outside[kept] = False
        able[outside] = False
    if not able.any():
        return None
    cost = np.where(able, rules.impurity(left)[1] + rules.impurity(right)[1], np.inf)
    # costs that differ by rounding only count as equal
    at = int((cost <= cost.min() + 1e-9 * max(1.0, abs(float(rules.impurity(whole)[1])))).ravel().argmax())
    j, b = divmod(at, cost.shape[1])
    beyond = b + 1 + int((histogram[j, b + 1 :, 0] > 0).argmax())
    return j, b, beyond, left[j, b], right[j, b]


def statistics(y: np.ndarray, w: np.ndarray, rules: Rules) -> np.ndarray:
    """[n, width] of single rows."""
    out = np.zeros((len(y), rules.width))
    out[:, 0] = 1
    if rules.task == "classification":
        out[np.arange(len(y)), 1 + y.astype(int)] = w
    else:
        out[:, 1], out[:, 2], out[:, 3] = w, w * y, w * y * y
    return out


def stops(whole: np.ndarray, depth: int, rules: Rules) -> bool:
    weight, impurity = rules.impurity(whole)
    deep = rules.max_depth is not None and depth >= rules.max_depth
    return bool(deep or whole[0] < max(2, rules.min_samples_split) or impurity <= 1e-9 * max(float(weight), 1e-300))


def settled(side: np.ndarray, depth: int, rules: Rules) -> bool:
    """Whether a child stops by its depth or rows alone, so that its part of its parent's histogram says all."""
    return bool((rules.max_depth is not None and depth >= rules.max_depth) or side[0] < max(2, rules.min_samples_split))


def grow_here(bins: np.ndarray, y: np.ndarray, w: np.ndarray, rules: Rules, node: int, depth: int, sizes: np.ndarray) -> list[tuple]:
    """The subtree of a node as (feature, bin, left, right, value, bin beyond, rows) in order of place; leaves
    have feature -1."""
    stats = statistics(y, w, rules)
    top, d = int(sizes.max(initial=1)), bins.shape[1]
    shift = np.arange(d) * top
    out: list[tuple] = [()]
    todo = [(0, np.arange(len(y)), node, depth)]
    while todo:
        place, rows, name, level = todo.pop()
        whole = stats[rows].sum(0)
        found = None
        if not stops(whole, level, rules):
            cell = (bins[rows] + shift).ravel()
            parts = [np.bincount(cell, np.repeat(stats[rows, k], d), d * top) for k in range(rules.width)]
            found = best_cut(np.stack(parts, -1).reshape(d, top, rules.width), rules, name)
        if found is None:
            out[place] = (-1, 0, -1, -1, rules.value(whole), 0, int(whole[0]))
            continue
        j, b, beyond, _, _ = found
        low = bins[rows, j] <= b
        out[place] = (j, b, len(out), len(out) + 1, rules.value(whole), beyond, int(whole[0]))
        out += [(), ()]
        todo += [(out[place][2], rows[low], mixed(name, 1), level + 1), (out[place][3], rows[~low], mixed(name, 2), level + 1)]
    return out


@dataclass
class Trees:
    """Flat arrays of all trees: feature (-1 for a leaf), threshold (left if not above), left, right, value, and
    how many rows a node was made from."""

    feature: list[np.ndarray]
    threshold: list[np.ndarray]
    left: list[np.ndarray]
    right: list[np.ndarray]
    value: list[np.ndarray]
    rows: list[np.ndarray]
    task: str

    def stopped(self, max_depth: int | None, min_samples_split: int, count: int) -> Trees:
        """The trees that stricter rules would have given: neither rule changes which cut a node takes, and
        trees do not depend on how many there are."""
        feature = []
        for t in range(count):
            level, new = np.zeros(len(self.feature[t]), int), self.feature[t].copy()
            for k in range(len(level)):  # children come after their parents
                if new[k] >= 0:
                    level[self.left[t][k]] = level[self.right[t][k]] = level[k] + 1
                if self.rows[t][k] < max(2, min_samples_split) or (max_depth is not None and level[k] >= max_depth):
                    new[k] = -1
            feature.append(new)
        return Trees(feature, *[x[:count] for x in (self.threshold, self.left, self.right, self.value, self.rows)], self.task)

    @property
    def count(self) -> int:
        return len(self.feature)

    @property
    def depth(self) -> int:
        most = 0
        for t in range(self.count):
            level = np.zeros(len(self.feature[t]), int)
            for k in range(len(level)):  # children come after their parents
                if self.feature[t][k] >= 0:
                    level[self.left[t][k]] = level[self.right[t][k]] = level[k] + 1
            most = max(most, int(level.max(initial=0)))
        return most

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees of the leaves' values [rows, outputs]."""
        total = 0.0
        for t in range(self.count):
            at = np.zeros(len(x), int)
            while True:
                j = self.feature[t][at]
                inner = np.flatnonzero(j >= 0)
                if not len(inner):
                    break
                here = at[inner]
                low = x[inner, j[inner]] <= self.threshold[t][here]
                at[inner] = np.where(low, self.left[t][here], self.right[t][here])
            total = total + self.value[t][at]
        return total / self.count

    def predict(self, df: DataFrame) -> DataFrame:
        trees = self

        @F.pandas_udf("array<double>")
        def outputs(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(trees.outputs(np.stack(x.to_numpy()).astype(float))))

        out = df.withColumn("_p", outputs(vector_to_array(FEATURES)))
        if self.task == "regression":
            return out.withColumn("prediction", F.get("_p", F.lit(0))).drop("_p")
        return out.withColumn("prediction", (F.array_position("_p", F.array_max("_p")) - 1).cast("double"))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [
            (t, json.dumps({name: getattr(self, name)[t].tolist() for name in NAMES}))
            for t in range(self.count)
        ]
        spark.createDataFrame([(self.task, *r) for r in rows], "task string, tree int, nodes string").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Trees:
        rows = spark.read.parquet(path).orderBy("tree").collect()  # one row per tree
        parts = [json.loads(r["nodes"]) for r in rows]
        return cls(*[[np.array(p[n], k) for p in parts] for n, k in NAMES.items()], rows[0]["task"])


def scores(models: list[Trees], data: DataFrame, label: str) -> list[float]:
    """Accuracy, or r2, of several models over rows (features, label): one pass, and one row per task."""
    rows = data.select(vector_to_array(FEATURES).alias("x"), F.col(label).cast("double").alias("y"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(models))
        for b in batches:
            if len(b):
                x, y = np.stack(b["x"].to_numpy()).astype(float), b["y"].to_numpy()
                for k, m in enumerate(models):
                    p = m.outputs(x)
                    total[k] += (p.argmax(1) == y).sum() if m.task == "classification" else np.square(p[:, 0] - y).sum()
        yield pd.DataFrame({"k": np.arange(len(models)), "v": total})

    sums = {r["k"]: r["v"] for r in rows.mapInPandas(judge, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.var_pop("y").alias("s")).first()
    if models[0].task == "classification":
        return [sums[k] / whole["n"] for k in range(len(models))]
    return [1 - sums[k] / (whole["n"] * whole["s"]) for k in range(len(models))]


def cuts_of(rows: DataFrame, n: int, bins: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(cuts, least, greatest value of each bin) per feature: cuts lie in the middle between neighbouring
    values, or where there are too many values between equally frequent ones, of a bounded number of
    rows. In the latter case bins reach from cut to cut."""
    drawn = rows if n <= CUT_ROWS else rows.where(F.pmod(F.xxhash64("x", "id"), F.lit(1 << 30)) < int((1 << 30) * CUT_ROWS / n))
    x = np.stack([np.asarray(r["x"], float) for r in drawn.select("x").limit(2 * CUT_ROWS).collect()])
    out = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        if len(values) <= bins and n <= CUT_ROWS:
            out.append(((values[1:] + values[:-1]) / 2, values, values))
            continue
        ordered = np.sort(x[:, j])
        values = np.unique(ordered[np.linspace(0, len(ordered) - 1, bins).astype(int)])
        cuts = (values[1:] + values[:-1]) / 2
        out.append((cuts, np.append(values[:1], cuts), np.append(cuts, values[-1:])))
    return out


def fit_trees(data: DataFrame, label: str, rules: Rules, trees: int = 1, bins: int = MAX_BINS, local_rows: int = LOCAL_ROWS) -> Trees:
    """Trees over rows (features, label). With ``bootstrap`` every tree weighs the rows by a Poisson draw
    from their number; rows drawn zero times take no part."""
    rows = data.select(F.monotonically_increasing_id().alias("id"), vector_to_array(FEATURES).alias("x"), F.col(label).cast("double").alias("y"))
    rows = materialize(rows)
    n = rows.count()
    known_bins = cuts_of(rows, n, bins)
    cuts = [c for c, _, _ in known_bins]
    d, sizes = len(cuts), np.array([len(c) + 1 for c in cuts])
    top = int(sizes.max(initial=1))

    def bin_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["x"].to_numpy()).astype(float)
                held = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]).astype(np.uint16)
                yield pd.DataFrame({"id": b["id"], "y": b["y"], "bins": [row.tobytes() for row in held]})

    binned = materialize(rows.mapInPandas(bin_rows, "id long, y double, bins binary"))

    def weights(ids: np.ndarray, t: int) -> np.ndarray:
        if not rules.bootstrap:
            return np.ones(len(ids))
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(mixed(rules.seed, t, 77))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        share = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)
        return np.searchsorted(np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)])), share).astype(float)

    # the upper part of every tree: nodes as [feature, bin, left, right, value, bin beyond, rows, name, depth]
    upper: list[list[list]] = [[[-2, 0, -1, -1, None, 0, 0, mixed(rules.seed, t, 1), 0]] for t in range(trees)]

    def arrays(t: int) -> tuple[np.ndarray, ...]:
        return tuple(np.array([node[k] for node in upper[t]]) for k in range(4))

    def places(known: tuple[np.ndarray, ...], held: np.ndarray) -> np.ndarray:
        feature, cut, left, right = known
        ends, own = feature < 0, np.arange(len(feature))
        asked = np.where(ends, 0, feature)
        goal = np.column_stack([np.where(ends, own, left), np.where(ends, own, right)]).ravel()  # a leaf leads to itself
        cells, rows = held.ravel(), np.arange(len(held)) * d
        at = np.zeros(len(held), int)
        while not ends[at].all():
            at = goal[2 * at + (cells[rows + asked[at]] > cut[at])]
        return at

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The batches, several of them as one."""
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= COUNTED:
                yield pd.concat(held)
                held, n = [], 0
        if n:
            yield pd.concat(held)

    def table(b: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(b["bins"]), np.uint16).reshape(len(b), d)

    large = [(t, 0) for t in range(trees)] if n > local_rows else []
    while large:
        step = max(1, HISTOGRAM_NUMBERS // (d * top * rules.width))
        asked, large = large[:step], large[step:]
        wanted: dict[int, list[int]] = {}
        for t, k in asked:
            wanted.setdefault(t, []).append(k)
        known = {t: arrays(t) for t in wanted}

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = {t: np.zeros((rules.width, len(ks) * d * top)) for t, ks in wanted.items()}
            for b in together(batches):
                held, y, ids = table(b), b["y"].to_numpy(), b["id"].to_numpy()
                for t, ks in wanted.items():
                    w = weights(ids, t)
                    slot = np.full(len(known[t][0]), -1)
                    slot[ks] = np.arange(len(ks))
                    own = slot[places(known[t], held)]
                    use = np.flatnonzero((own >= 0) & (w > 0))
                    cell = (own[use] * (d * top) + (np.arange(d) * top)[:, None] + held[use].T).ravel()
                    stats = statistics(y[use], w[use], rules)
                    for k in range(rules.width):
                        total[t][k] += np.bincount(cell, np.tile(stats[:, k], d), len(total[t][k]))
            for t, ks in wanted.items():
                used = np.flatnonzero(total[t][0])
                if not len(used):  # a task may hold no row of these nodes, and Arrow knows no empty column of arrays
                    continue
                node, rest = np.divmod(used, d * top)
                yield pd.DataFrame({"tree": t, "node": np.array(ks)[node], "cell": rest, "stats": list(total[t][:, used].T)})

        def choose(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            t, k = key
            histogram = np.zeros((d * top, rules.width))
            np.add.at(histogram, frame["cell"].to_numpy(), np.stack(frame["stats"].to_numpy()))
            histogram = histogram.reshape(d, top, rules.width)
            whole = histogram[0].sum(0)
            name, depth = names[(t, k)]
            found = None if stops(whole, depth, rules) else best_cut(histogram, rules, name)
            j, b, beyond, left, right = found or (-1, 0, 0, np.zeros(1), np.zeros(1))
            ends = [rules.value(side) if found and settled(side, depth + 1, rules) else [] for side in (left, right)]
            row = {"tree": t, "node": k, "j": j, "b": b, "beyond": beyond, "left": left[0], "right": right[0], "rows": whole[0], "value": rules.value(whole)}
            return pd.DataFrame([{**row, "left_value": ends[0], "right_value": ends[1]}])

        names = {(t, k): (upper[t][k][7], upper[t][k][8]) for t, k in asked}
        slots = binned.mapInPandas(count, "tree int, node int, cell int, stats array<double>")
        # partial sums of a node's bins: one row per task and bin
        summed = slots.groupBy("tree", "node", "cell").agg(
            F.array(*[F.sum(F.get("stats", F.lit(k))) for k in range(rules.width)]).alias("stats")
        )
        kinds = "tree int, node int, j int, b int, beyond int, left double, right double, rows double, value array<double>, left_value array<double>, right_value array<double>"
        split = summed.groupBy("tree", "node").applyInPandas(choose, kinds)
        for r in split.collect():
            node = upper[r["tree"]][r["node"]]
            node[4], node[6] = list(r["value"]), int(r["rows"])
            node[0] = r["j"] if r["j"] >= 0 else -1
            if r["j"] < 0:
                continue
            node[1], node[2], node[3], node[5] = r["b"], len(upper[r["tree"]]), len(upper[r["tree"]]) + 1, r["beyond"]
            for side, size, value in ((1, r["left"], r["left_value"]), (2, r["right"], r["right_value"])):
                if size > local_rows and len(value):  # a leaf, whose value is known without another pass
                    upper[r["tree"]].append([-1, 0, -1, -1, list(value), 0, int(size), mixed(node[7], side), node[8] + 1])
                    continue
                upper[r["tree"]].append([-2, 0, -1, -1, None, 0, 0, mixed(node[7], side), node[8] + 1])
                if size > local_rows:
                    large.append((r["tree"], len(upper[r["tree"]]) - 1))
    # whatever is not settled holds few rows: its subtree is grown in one task
    known = {t: arrays(t) for t in range(trees)}
    opened = {(t, k): (node[7], node[8]) for t in range(trees) for k, node in enumerate(upper[t]) if node[0] == -2}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            held, ids = table(b), b["id"].to_numpy()
            for t in range(trees):
                w, at = weights(ids, t), places(known[t], held)
                use = (w > 0) & (known[t][0][at] == -2)
                if use.any():
                    out = b.loc[use, ["id", "y", "bins"]].copy()
                    out["tree"], out["node"], out["w"] = t, at[use], w[use]
                    yield out

    def finish(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        t, k = key
        frame = frame.sort_values("id")
        name, depth = opened[(t, k)]
        made = grow_here(table(frame).astype(np.int64), frame["y"].to_numpy(), frame["w"].to_numpy(), rules, name, depth, sizes)
        return pd.DataFrame([{"tree": t, "node": k, "made": json.dumps(made)}])

    dealt = binned.mapInPandas(deal, "id long, y double, bins binary, tree int, node int, w double")
    for r in dealt.groupBy("tree", "node").applyInPandas(finish, "tree int, node int, made string").collect() if opened else []:
        nodes, made = upper[r["tree"]], json.loads(r["made"])
        base = len(nodes) - 1  # place 0 of the subtree is the node itself
        for k, (j, b, left, right, value, beyond, size) in enumerate(made):
            new = [j, b, left + base if left >= 0 else -1, right + base if right >= 0 else -1, value, beyond, size, 0, 0]
            if k == 0:
                nodes[r["node"]] = new
            else:
                nodes.append(new)
    out: list[list[np.ndarray]] = [[] for _ in range(6)]
    empty = [0.0] * (rules.classes or 1)
    for t in range(trees):
        feature, cut, left, right = arrays(t)
        feature = np.where(feature == -2, -1, feature)  # a tree that drew no row
        out[0].append(feature)
        beyond = [node[5] for node in upper[t]]
        out[1].append(np.array([(known_bins[j][2][b] + known_bins[j][1][k]) / 2 if j >= 0 else 0.0 for j, b, k in zip(feature, cut, beyond)]))
        out[2].append(left)
        out[3].append(right)
        out[4].append(np.array([node[4] or empty for node in upper[t]], float))
        out[5].append(np.array([node[6] for node in upper[t]]))
    return Trees(*out, rules.task)
