"""A start for large kernel machines: the dual over few coordinates, and an interior solver for working sets.

Smooth kernels over few features have a small numerical rank: the kernel of all rows is that of some pivot
rows, up to a remainder that is checked for every row. In these coordinates the dual with a logarithmic
barrier is a function of as many numbers as there are pivots, and every multiplier follows from them, so no
state of a row is kept: Newton steps are passes that add up one matrix per task. The multipliers found are a
start only; whoever uses them checks and finishes against the kernel itself.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.ordered import hashed_values
from tabloom.session import materialize

PIVOTS = 600  # more coordinates than this are no gain
CANDIDATES = 4000  # rows, drawn by hash, that the first pivots come from
ROUNDS = 8  # of pivots taken from the worst rows
FIRST = 1500  # of them that tell most kernels without a small rank
WORST = 1000  # rows with the largest remainder that may become pivots next
REMAINDER = 1e-8  # of a row's kernel with itself, relative to the largest one
CHECKED = 1e-6  # a remainder up to here is due to rounding
NARROW = 8  # the barrier falls by this factor
STEPS = np.append(2.0 ** -np.arange(0, 12, 0.5), [1.5, 2.0])
ROWS = 4096  # of a task compared with the pivots at once
LAYOUT = "x binary, at binary, y binary, p binary, c binary, d int"


def pivots(of, x: np.ndarray, most: int) -> tuple[list[int], float]:
    """Rows of a Cholesky factorisation that takes the largest remainder next, and the largest one left."""
    left = of.diagonal(x)
    scale, z, found = max(float(left.max(initial=0.0)), 1e-300), np.zeros((len(x), most)), []
    for k in range(min(most, len(x))):
        i = int(left.argmax())
        if left[i] <= REMAINDER * scale:
            break
        z[:, k] = (of(x, x[i : i + 1])[:, 0] - z[:, :k] @ z[i, :k]) / np.sqrt(left[i])
        left = left - z[:, k] ** 2
        left[i] = 0.0
        found.append(i)
    return found, float(left.max(initial=0.0)) / scale


@dataclass(frozen=True)
class Coordinates:
    """``of(x, points) @ turn`` are coordinates whose products are the kernel."""

    of: object
    points: np.ndarray
    turn: np.ndarray

    @classmethod
    def over(cls, of, points: np.ndarray) -> Coordinates:
        gram = of(points, points)
        lower = np.linalg.cholesky(gram + 1e-13 * gram.diagonal().max() * np.eye(len(points)))
        return cls(of, points, np.linalg.inv(lower).T)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.of(x, self.points) @ self.turn


def in_a_task(spark: SparkSession, fn):
    """What a function returns, called in a task: algebra that would otherwise hold up the driver."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"v": [pickle.dumps(fn())]})

    return pickle.loads(spark.range(0, 1, 1, 1).mapInPandas(call, "v binary").first()["v"])


def of_pivots(of, held: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    if len(held) > FIRST and pivots(of, held[:FIRST], PIVOTS)[1] > REMAINDER:
        return None
    found, left = pivots(of, held, PIVOTS)
    if not found or left > REMAINDER:
        return None
    try:
        z = Coordinates.over(of, held[found])
        return z.points, z.turn
    except np.linalg.LinAlgError:
        return None


def coordinates(problem: DataFrame, of, n: int) -> Coordinates | None:
    """None where the kernel of the rows has no small rank."""
    if of.name == "sigmoid":  # no products of coordinates
        return None
    rows = problem.select("x")
    held = np.array(hashed_values(rows, "x", CANDIDATES, n), dtype=float)
    for _ in range(ROUNDS):
        basis = in_a_task(problem.sparkSession, lambda: of_pivots(of, held))
        if basis is None:
            return None
        z = Coordinates(of, *basis)

        def worst(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for k in range(0, len(b), ROWS):
                    x = np.stack(b["x"].to_numpy()[k : k + ROWS]).astype(float)
                    whole = of.diagonal(x)
                    rest = whole - (z(x) ** 2).sum(1)
                    at = np.argsort(-rest)[:WORST]
                    yield pd.DataFrame({"x": [v.tolist() for v in x[at]], "rest": rest[at], "whole": whole[at]})

        seen = rows.mapInPandas(worst, "x array<double>, rest double, whole double")
        got = seen.orderBy(F.col("rest").desc()).limit(WORST).toPandas()
        if not len(got) or float(got["rest"].max()) <= CHECKED * float(got["whole"].max()):
            return z
        bad = got[got["rest"] > 10 * REMAINDER * got["whole"].max()]
        more = np.unique(np.stack(bad["x"].to_numpy()).astype(float), axis=0)
        held = np.vstack([z.points, more])
    return None


def packed(problem: DataFrame) -> DataFrame:
    """Rows of a batch side by side, each vector once; for passes that read all of them again and again."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                ids, first, at = np.unique(b["id"].to_numpy(), return_index=True, return_inverse=True)
                x = np.stack(b["x"].to_numpy()[first]).astype(float)
                cells = {name: [b[name].to_numpy(dtype=float).tobytes()] for name in ("y", "p", "c")}
                yield pd.DataFrame({"x": [x.tobytes()], "at": [at.astype(np.int32).tobytes()], **cells, "d": [x.shape[1]]})

    held = problem.select("id", "x", "y", "p", "c").mapInPandas(pack, LAYOUT)
    return materialize(held.coalesce(problem.sparkSession.sparkContext.defaultParallelism))


def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, ...]]:
    for b in batches:
        for x, at, y, p, c, d in zip(b["x"], b["at"], b["y"], b["p"], b["c"], b["d"]):
            yield np.frombuffer(x).reshape(-1, d), np.frombuffer(at, np.int32), np.frombuffer(y), np.frombuffer(p), np.frombuffer(c)


def multiplier(u: np.ndarray, c: np.ndarray, mu: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, the distance to the nearer bound) of the a between 0 and c that makes a u + mu log(a (c - a)) largest."""
    near = 2 * mu * c / (np.sqrt(u * u * c * c + 4 * mu * mu) + np.abs(u) * c + 2 * mu)
    return np.where(u <= 0, near, c - near), near


def _gain(u: np.ndarray, c: np.ndarray, mu: float) -> np.ndarray:
    a, near = multiplier(u, c, mu)
    return a * u + mu * (np.log(near / c) + np.log1p(-near / c))


def _value(z: Coordinates, x: np.ndarray, at: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Values [rows, columns of w] of the machines whose weights, with an intercept below, are the columns."""
    blocks = [z(x[k : k + ROWS]) @ w[:-1] for k in range(0, len(x), ROWS)]
    return (np.concatenate(blocks) + w[-1])[at]


def machine(problem: DataFrame, z: Coordinates, n: int, tolerance: float) -> tuple[np.ndarray, float]:
    """Weights of the coordinates, the intercept below them, and the barrier, which is all but gone."""
    rows, width = packed(problem), len(z.points)

    def total(fn, size: int, then):
        """What ``then`` makes of the sum of what ``fn`` adds up, in a task."""

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc = np.zeros(size)
            for part in unpacked(batches):
                fn(acc, *part)
            yield pd.DataFrame({"v": [acc.tobytes()]})

        def add(frame: pd.DataFrame) -> pd.DataFrame:
            out = np.zeros(size)
            for v in frame["v"]:
                out += np.frombuffer(v)
            return pd.DataFrame({"v": [pickle.dumps(then(out))]})

        summed = rows.mapInPandas(partial, "v binary").groupBy(F.lit(0).alias("all")).applyInPandas(add, "v binary")
        return pickle.loads(summed.first()["v"])

    def newton(w: np.ndarray, mu: float) -> tuple[float, np.ndarray, float]:
        """The loss, the step, and by how much it promises to lower the loss twice."""
        size = width + 1

        def add(acc, x, at, y, p, c):
            square, slope = acc[1 + size :].reshape(size, size), acc[1 : 1 + size]
            for k in range(0, len(x), ROWS):
                own = z(x[k : k + ROWS])
                own = np.column_stack([own, np.ones(len(own))])
                use = np.flatnonzero((at >= k) & (at < k + ROWS))
                f = (own @ w)[at[use] - k]
                yu, cu = y[use], c[use]
                u = -(p[use] + yu * f)
                a, near = multiplier(u, cu, mu)
                acc[0] += (a * u + mu * (np.log(near / cu) + np.log1p(-near / cu))).sum()
                slope += own.T @ np.bincount(at[use] - k, a * yu, len(own))
                bend = np.bincount(at[use] - k, 1.0 / (mu / near**2 + mu / (cu - near) ** 2), len(own))
                keep = np.flatnonzero(bend > 1e-9)
                square += own[keep].T @ (own[keep] * bend[keep, None])

        def solved(got: np.ndarray) -> tuple[float, np.ndarray, float]:
            slope, square = -got[1 : 1 + size], got[1 + size :].reshape(size, size)
            square[np.arange(width), np.arange(width)] += 1.0
            slope[:width] += w[:width]
            try:
                step = -np.linalg.solve(square, slope)
            except np.linalg.LinAlgError:
                step = np.full(size, np.nan)
            return got[0] + 0.5 * float(w[:width] @ w[:width]), step, -float(slope @ step)

        return total(add, 1 + size + size * size, solved)

    def losses(w: np.ndarray, step: np.ndarray, mu: float) -> np.ndarray:
        tried = w[:, None] + STEPS * step[:, None]

        def add(acc, x, at, y, p, c):
            f = _value(z, x, at, np.column_stack([w, step]))
            for k, size in enumerate(STEPS):
                acc[k] += _gain(-(p + y * (f[:, 0] + size * f[:, 1])), c, mu).sum()

        return total(add, len(STEPS), lambda v: v) + 0.5 * np.square(tried[:width]).sum(0)

    first = problem.agg(F.avg(F.col("c") * F.abs("p")).alias("m"), F.avg("c").alias("c")).first()
    w, mu, end = np.zeros(width + 1), max(first["m"], 1e-300), tolerance * 1e-5 * first["c"]
    while True:
        for _ in range(30):
            loss, step, fall = newton(w, mu)
            if not np.isfinite(fall) or fall < 1e-3 * n * mu or fall < 1e-11 * abs(loss):
                break
            tried = losses(w, step, mu)
            best = int(tried.argmin())
            if not tried[best] < loss:
                break
            w = w + STEPS[best] * step
        if mu <= end:
            return w, mu
        mu = max(end, mu / NARROW)


def started(problem: DataFrame, z: Coordinates, n: int, tolerance: float) -> DataFrame:
    """The problem with a feasible ``alpha`` close to the optimum: rows clearly on one side of the margin have
    none or the largest; those at the margin are drawn together until both sides balance."""
    w, mu = machine(problem, z, n, tolerance)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, c = np.stack(b["x"].to_numpy()).astype(float), b["c"].to_numpy(dtype=float)
                f = _value(z, x, np.arange(len(x)), w[:, None])[:, 0]
                u = -(b["p"].to_numpy(dtype=float) + b["y"].to_numpy(dtype=float) * f)
                b["alpha"] = np.where(u < -tolerance, 0.0, np.where(u > tolerance, c, multiplier(u, c, mu)[0]))
            yield b

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in problem.schema.fields)
    out = materialize(problem.mapInPandas(place, fields + ", alpha double"))
    free = (F.col("alpha") > 0) & (F.col("alpha") < F.col("c"))
    side = lambda y, which: F.coalesce(F.sum(F.when((F.col("y") == y) & which, F.col("alpha"))), F.lit(0.0))
    got = out.agg(side(1, F.lit(True)).alias("a"), side(-1, F.lit(True)).alias("b"), side(1, free).alias("fa"), side(-1, free).alias("fb")).first()
    over, y = got["a"] - got["b"], 1.0 if got["a"] > got["b"] else -1.0
    most, some = (got["a"], got["fa"]) if y > 0 else (got["b"], got["fb"])
    if over:
        which = (F.col("y") == y) & (free if some > 2 * abs(over) else F.lit(True))
        kept = 1.0 - abs(over) / (some if some > 2 * abs(over) else most)
        out = out.withColumn("alpha", F.when(which, F.col("alpha") * kept).otherwise(F.col("alpha")))
    return out


def interior(gram: np.ndarray, y: np.ndarray, q: np.ndarray, c: np.ndarray, start: np.ndarray, tolerance: float, rounds: int = 60) -> np.ndarray | None:
    """The optimum of a' Q a / 2 + q' a over 0 <= a <= c and y' a as at the start, by predictor and corrector
    steps; Q is y y' gram. What a bound's price holds there is put on it. None where rounding stops the way."""
    n, held = len(y), float(y @ start)
    big = np.outer(y, y) * gram
    scale = max(1.0, float(np.abs(q).max(initial=0.0)))
    a, b = np.clip(start, 0.01 * c, 0.99 * c), 0.0
    slope = big @ a + q
    low, top = np.maximum(slope, 0) + 0.01 * scale, np.maximum(-slope, 0) + 0.01 * scale
    for _ in range(rounds):
        room = c - a
        dual, even = big @ a + q + b * y - low + top, float(y @ a) - held
        gap = float(low @ a + top @ room)
        if gap <= 1e-7 * tolerance * float(c.sum()) and np.abs(dual).max() <= 1e-3 * tolerance:
            break
        system = big + np.diag(low / a + top / room)

        def direction(to_low: np.ndarray, to_top: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
            one, other = np.linalg.solve(system, np.column_stack([y, to_low / a - to_top / room - dual])).T
            db = (float(y @ other) + even) / float(y @ one)
            da = other - db * one
            return da, db, (to_low - low * da) / a, (to_top + top * da) / room

        def reach(da: np.ndarray, dl: np.ndarray, dt: np.ndarray) -> float:
            ways = [-v[dv < 0] / dv[dv < 0] for v, dv in ((a, da), (room, -da), (low, dl), (top, dt))]
            return min(1.0, *(float(w.min(initial=1.0)) for w in ways))

        try:
            da, _, dl, dt = direction(-low * a, -top * room)
            far = reach(da, dl, dt)
            after = float((low + far * dl) @ (a + far * da) + (top + far * dt) @ (room - far * da))
            centre = (after / gap) ** 3 * gap / (2 * n)
            da, db, dl, dt = direction(centre - low * a - dl * da, centre - top * room + dt * da)
        except np.linalg.LinAlgError:
            return None
        far = 0.995 * reach(da, dl, dt)
        if not np.isfinite(far) or far < 1e-8:
            break
        a, b, low, top = a + far * da, b + far * db, low + far * dl, top + far * dt
    out = np.where((low > tolerance / 20) & (a < c / 2), 0.0, np.where((top > tolerance / 20) & (a > c / 2), c, a))
    # what rounding to the bounds left is evened out by the free ones
    free, off = np.flatnonzero((out > 0) & (out < c)), held - float(y @ out)
    share = np.minimum(out[free], c[free] - out[free])
    if share.sum() > 4 * abs(off):
        out[free] += y[free] * off * share / max(share.sum(), 1e-300)
    elif abs(off) > 1e-12 * float(c.sum()):
        return None
    return out
