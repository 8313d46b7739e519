"""One-pass statistics, exact order statistics and value counts.

Everything here brings back a bounded number of rows: one row of aggregates,
or at most ``VALUE_LIMIT`` distinct values per requested order statistic.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.session import materialize
from tabloom.types import as_double, col

# up to this many rows the built-in exact `percentile` keeps every value of the
# column in one aggregation buffer; beyond it ranks are found by narrowing
SMALL_ROWS = 100_000
# most different values around the wanted ranks that may reach the driver
VALUE_LIMIT = 10_000
ACCURACY = 10_000
SKETCH_GAP = 2.0 / ACCURACY  # how far from a quantile its two sketched neighbours are
WIDE = 16  # more columns than this are aggregated below one another


def one_row(df: DataFrame, aggs: Mapping[str, Column]) -> dict:
    """Evaluate many aggregates in a single job."""
    if not aggs:
        return {}
    keys = list(aggs)
    row = df.agg(*[aggs[k].alias(f"a{i}") for i, k in enumerate(keys)]).first()
    return {k: row[i] for i, k in enumerate(keys)}


def each_column(frame: DataFrame, columns: Sequence[str], aggs: Mapping[str, Callable[[Column], Column]]) -> dict[str, dict]:
    """The same aggregates of several columns of one type in a single job. Many columns are written below
    one another: a plan of hundreds of aggregates costs the driver more than the rows cost the executors."""
    if not columns:
        return {}
    if len(columns) > WIDE:
        long = frame.select(F.posexplode(F.array(*[col(c) for c in columns])).alias("i", "v"))
        rows = long.groupBy("i").agg(*[f(F.col("v")).alias(f"a{n}") for n, f in enumerate(aggs.values())]).collect()  # one per column
        if rows:
            found = {r["i"]: r for r in rows}
            return {c: {k: found[i][f"a{n}"] for n, k in enumerate(aggs)} for i, c in enumerate(columns)}
        # no rows at all: what one column gives, all do
        return {c: one_row(frame, {k: f(col(columns[0])) for k, f in aggs.items()}) for c in columns}
    got = one_row(frame, {(c, k): f(col(c)) for c in columns for k, f in aggs.items()})
    return {c: {k: got[(c, k)] for k in aggs} for c in columns}


def at_probabilities(
    frame: DataFrame, wanted: Mapping[str, Sequence[float]], agg: Callable[[Column, list[float]], Column]
) -> dict[str, list[float] | None]:
    """An aggregate of a column and probabilities, each column at its own ones, in a single job."""
    if len(wanted) <= WIDE:
        return one_row(frame, {c: agg(col(c), list(p)) for c, p in wanted.items()})
    every = sorted({v for p in wanted.values() for v in p})
    got = each_column(frame, list(wanted), {"p": lambda x: agg(x, every)})
    return {c: got[c]["p"] and [got[c]["p"][every.index(v)] for v in p] for c, p in wanted.items()}


@dataclass
class Moments:
    rows: int
    n: int
    min: float | None
    max: float | None
    mean: float | None
    std: float | None
    var_pop: float | None
    skew_pop: float | None
    kurt_pop: float | None
    sketch: list[float] | None = None

    @property
    def nulls(self) -> int:
        return self.rows - self.n

    @property
    def std_pop(self) -> float | None:
        return None if self.var_pop is None else math.sqrt(max(self.var_pop, 0.0))


def moments(df: DataFrame, columns: Sequence[str], probs: Sequence[float] = ()) -> dict[str, Moments]:
    """Counts, extremes and the first four moments of all columns in one job. With ``probs`` a sketch
    around these quantiles comes along, for ``quantiles`` to start from."""
    around = [p for q in probs for p in (max(q - SKETCH_GAP, 0.0), min(q + SKETCH_GAP, 1.0))]
    frame = df.select(*[as_double(df, c).alias(c) for c in columns])
    aggs = {
        "rows": lambda x: F.count(F.lit(1)),
        "n": F.count,
        "min": F.min,
        "max": F.max,
        "mean": F.avg,
        "std": F.stddev_samp,
        "var_pop": F.var_pop,
        "skew_pop": F.skewness,
        "kurt_pop": F.kurtosis,
    }
    if around:
        aggs["sketch"] = lambda x: F.percentile_approx(x, around, ACCURACY)
    return {c: Moments(**found) for c, found in each_column(frame, columns, aggs).items()}


def sample_skewness(n: Column, skew: Column) -> Column:
    """Bias-corrected skewness; 0 for short or constant columns."""
    fixed = skew * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0))
    return F.when(n > 2, F.coalesce(fixed, F.lit(0.0))).otherwise(0.0)


def sample_kurtosis(n: Column, kurt: Column) -> Column:
    """Bias-corrected excess kurtosis; 0 for short or constant columns."""
    scale = (n - 1.0) / F.nullif((n - 2.0) * (n - 3.0), F.lit(0.0))
    fixed = scale * ((n + 1.0) * kurt + 6.0)
    return F.when(n > 3, F.coalesce(fixed, F.lit(0.0))).otherwise(0.0)


# --------------------------------------------------------------------------
# exact order statistics


def order_statistics(
    frame: DataFrame,
    wanted: Iterable[tuple[str, int]],
    counts: Mapping[str, int],
    value_limit: int = VALUE_LIMIT,
    accuracy: int = ACCURACY,
    sketches: Mapping[str, Sequence[float]] | None = None,
) -> dict[tuple[str, int], float]:
    """Exact k-th smallest values (0-based ranks) of DOUBLE columns, in two scans.

    The first is a sketch, unless its ``sketches`` are given: pairs of values that enclose the wanted
    ranks of a column. They cut a column into
    segments: the values themselves, which end the search where they are much repeated, and
    what lies between. The second scan counts the rows of all segments and, of those between
    two values that enclose a rank, the rows of every value: about rows / accuracy of them,
    combined in the tasks and kept as a table. The value of the rank is found there. A rank
    that a sketch did not enclose is searched again.
    """
    out: dict[tuple[str, int], float] = {}
    open_ = list(dict.fromkeys(wanted))
    while open_:
        found = _enclosed(frame, open_, counts, value_limit, accuracy, sketches)
        out.update(found)
        open_ = [w for w in open_ if w not in found]
        accuracy, sketches = max(100, accuracy // 4), None
    return out


def _enclosed(
    frame: DataFrame, wanted: Sequence[tuple[str, int]], counts: Mapping[str, int], value_limit: int, accuracy: int,
    given: Mapping[str, Sequence[float]] | None,
) -> dict[tuple[str, int], float]:
    from tabloom.functions.ordered import running_sums

    eps = 2.0 / accuracy
    probes: dict[str, list[float]] = {}
    for c, k in wanted:
        q = k / max(counts[c] - 1, 1)
        probes.setdefault(c, []).extend([max(q - eps, 0.0), min(q + eps, 1.0)])
    sketches = {c: list(given[c]) for c in probes} if given else {}
    sketches |= at_probabilities(frame, {c: p for c, p in probes.items() if c not in sketches}, lambda x, p: F.percentile_approx(x, p, accuracy))
    edges = {c: sorted(set(sketches[c])) for c in probes}
    # segment 2i + 1 is the i-th edge, 2i what lies before it
    kept = {c: set() for c in probes}
    for c, values in sketches.items():
        for lo, hi in zip(values[::2], values[1::2]):
            kept[c] |= {2 * i for i in range(edges[c].index(lo) + 1, edges[c].index(hi) + 1)}

    def segment(c: str) -> Column:
        out = F.lit(2 * len(edges[c]))
        for i in reversed(range(len(edges[c]))):
            out = F.when(col(c) < edges[c][i], 2 * i).when(col(c) == edges[c][i], 2 * i + 1).otherwise(out)
        return out

    names = list(probes)
    cells = [F.when(col(c).isNotNull(), F.struct(F.lit(i).alias("i"), segment(c).alias("s"), col(c).alias("v"))) for i, c in enumerate(names)]
    long = frame.select(F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("x")).select("x.i", "x.s", "x.v")
    inside = F.lit(False)
    for i, c in enumerate(names):
        if kept[c]:
            inside = inside | ((F.col("i") == i) & F.col("s").isin(sorted(kept[c])))
    grouped = long.groupBy("i", "s", F.when(inside, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    grouped = materialize(grouped)
    # a few segments per column
    sizes = {(r["i"], r["s"]): r["n"] for r in grouped.groupBy("i", "s").agg(F.sum("n").alias("n")).collect()}
    out, asked = {}, []
    for c, k in wanted:
        i, before = names.index(c), 0
        for s in range(2 * len(edges[c]) + 1):
            n = sizes.get((i, s), 0)
            if k < before + n:
                if s % 2:
                    out[(c, k)] = edges[c][s // 2]
                elif s in kept[c]:
                    asked.append((c, k, i, s, k - before))
                break
            before += n
    if asked:
        spans = sorted({(i, s) for _, _, i, s, _ in asked})
        some = F.lit(False)
        for i, s in spans:
            some = some | ((F.col("i") == i) & (F.col("s") == s))
        held = grouped.where(some)
        if held.count() <= value_limit:
            told = held.toPandas().sort_values(["i", "s", "v"])
            parts = {(int(i), int(s)): (p["v"].to_numpy(), p["n"].cumsum().to_numpy()) for (i, s), p in told.groupby(["i", "s"])}
            for c, k, i, s, place in asked:
                values, reached = parts[(i, s)]
                out[(c, k)] = float(values[(reached > place).argmax()])
        else:
            ranked = materialize(running_sums(held, "v", {"upto": "n"}, by=["i", "s"]))
            for c, k, i, s, place in asked:
                own = (F.col("i") == i) & (F.col("s") == s) & (F.col("upto") > place) & (F.col("upto") - F.col("n") <= place)
                out[(c, k)] = ranked.where(own).first()["v"]
    return out


def quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    counts: Mapping[str, int] | None = None,
    small_rows: int = SMALL_ROWS,
    value_limit: int = VALUE_LIMIT,
    sketches: Mapping[str, Sequence[float]] | None = None,
) -> dict[str, list[float | None]]:
    """Exact, linearly interpolated quantiles of several columns.

    ``counts`` are the non-null counts when the caller already knows them, ``sketches`` those of
    ``moments`` for the same quantiles.
    """
    wanted = {c: list(p) for c, p in wanted.items() if p}
    if not wanted:
        return {}
    frame = df.select(*[as_double(df, c).alias(c) for c in wanted])
    if counts is None:
        counts = one_row(frame, {c: F.count(col(c)) for c in wanted})
    small = [c for c in wanted if counts[c] <= small_rows]
    large = [c for c in wanted if counts[c] > small_rows]
    out: dict[str, list[float | None]] = {}
    if small:
        got = at_probabilities(frame, {c: wanted[c] for c in small}, lambda x, p: F.percentile(x, F.array(*[F.lit(float(v)) for v in p])))
        out.update({c: list(got[c]) if got[c] is not None else [None] * len(wanted[c]) for c in small})
    if large:
        ranks = {(c, p): (counts[c] - 1) * float(p) for c in large for p in wanted[c]}
        needed = [(c, k) for (c, _), pos in ranks.items() for k in {math.floor(pos), math.ceil(pos)}]
        values = order_statistics(frame, needed, counts, value_limit, sketches=sketches)
        for c in large:
            out[c] = []
            for p in wanted[c]:
                pos = ranks[(c, p)]
                lo, hi = values[(c, math.floor(pos))], values[(c, math.ceil(pos))]
                w = pos - math.floor(pos)
                out[c].append(lo if lo == hi else (1 - w) * lo + w * hi)
    return out


# --------------------------------------------------------------------------
# value counts


def melt(df: DataFrame, columns: Sequence[str], as_numbers: bool) -> DataFrame:
    """Rows (column_name, value) of the non-null cells."""
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            (as_double(df, c) if as_numbers else col(c).cast("string")).alias("value"),
        )
        for c in columns
    ]
    return (
        df.select(F.explode(F.array(*cells)).alias("cell"))
        .select("cell.column_name", "cell.value")
        .where(F.col("value").isNotNull())
    )


def value_counts(df: DataFrame, columns: Sequence[str], as_numbers: bool = False) -> DataFrame:
    """(column_name, value, n). Repeated values are combined before the shuffle."""
    return melt(df, columns, as_numbers).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def top_value(counted: DataFrame, marked: Column | None = None) -> DataFrame:
    """Per column the most frequent value, the smallest one on ties, with its count, the number of
    distinct values and, if a condition is given, of ``marked`` rows."""
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("value")))
    more = {} if marked is None else {"marked": F.coalesce(F.sum(F.when(marked, F.col("n"))), F.lit(0))}
    return (
        counted.groupBy("column_name")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("distinct_count"), *[v.alias(k) for k, v in more.items()])
        .select("column_name", F.col("best.value").alias("value"), (-F.col("best.neg")).alias("n"), "distinct_count", *more)
    )


def modes(df: DataFrame, columns: Sequence[str], as_numbers: bool) -> dict[str, object]:
    """Most frequent value per column (smallest on ties); all-null columns are absent."""
    if not columns:
        return {}
    rows = top_value(value_counts(df, columns, as_numbers)).collect()
    return {r["column_name"]: r["value"] for r in rows}


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Exact number of distinct non-null values per column."""
    counted = value_counts(df, columns).groupBy("column_name").agg(F.count(F.lit(1)).alias("n"))
    got = {r["column_name"]: r["n"] for r in counted.collect()}
    return {c: got.get(c, 0) for c in columns}


def null_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Missing cells (NULL or NaN) per column, in one job."""
    from tabloom.types import nan_to_null

    frame = nan_to_null(df.select(*[col(c) for c in columns]))
    return one_row(frame, {c: F.count_if(col(c).isNull()) for c in columns})
