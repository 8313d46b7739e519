"""An index for exact nearest neighbours: a two-level metric tree laid out as tables.

Rows live in cells. A region is the rows nearest to one of a bounded number of pivots (centres
of a hashed sample); a large region is cut again around pivots of its own, drawn by hash from
its rows, so that a cell holds about ``cell_rows`` of them whatever the table's size. Cells
only decide where rows live, never what is found.

Of every cell the index keeps the box of its coordinates, how many rows have each coordinate,
and the least and greatest distance of its rows to the pivots of region and cell. A query can
have no neighbour in a cell nearer than the gap to the box, nor, by the triangle inequality,
nearer than the gap between its own distance to a pivot and those of the cell's rows: the
first prunes narrow rows, the second wide ones. Distances over missing coordinates have no
triangle inequality; there the bound is the least mean gap over any set of coordinates that a
row of the cell may share with the query, so cells may mix patterns of missing values.

The cells are a table and meet the queries in a join by region; only the regions (a bounded
number) are known to every task. A query first searches the nearest cells that hold enough
rows, which bounds the distance of its k-th neighbour, then all cells that may hold a nearer
row. Cells are searched in chunks of bounded size on both sides, a task returns k rows per
query, and these are merged by a rank limit that Spark also applies before the shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.functions.ordered import hashed_values
from tabloom.session import materialize

CELL_ROWS = 16384
REGIONS = 256
SAMPLE = 8192
REGION_ROWS = 100_000  # rows cut by one task
FLAT_CHUNKS = 8  # a table of no more chunks is searched whole, which costs less than laying it out
QUERY_ROWS = 10_000  # queries that meet the cells of a region in one task
CELLS_AT_ONCE = 2_000
NUMBERS_AT_ONCE = 4_000_000
MANY_PATTERNS = 64  # of missing coordinates in a chunk: up to here each is a block of its own
GROUP = 64  # rows of a chunk whose least quick distance is one bound
TILE_ROWS, TILE_NUMBERS = 4096, 16_384  # of a quick distance that is summed up coordinate by coordinate: they stay in the cache
LARGEST = 1e30  # beyond this, squares or single precision may overflow
ROUNDING, SINGLE = 2.0**-52, 2.0**-23
METRICS = ("euclidean", "manhattan", "minkowski", "chebyshev", "nan_euclidean")


@dataclass(frozen=True)
class Metric:
    name: str
    p: float = 2.0

    def __post_init__(self):
        if self.name not in METRICS:
            raise ValueError(f"unknown metric {self.name!r}")

    @property
    def masked(self) -> bool:
        return self.name == "nan_euclidean"

    def of_gaps(self, gaps: Iterator[np.ndarray], dims: int) -> np.ndarray:
        """Distance from per-dimension gaps (NaN where a coordinate is missing)."""
        total, present = None, None
        for g in gaps:
            g = np.abs(g)
            if self.masked:
                here = ~np.isnan(g)
                part = np.where(here, g * g, 0.0)
                present = here.astype(float) if present is None else present + here
            elif self.name == "manhattan" or (self.name == "minkowski" and self.p == 1):
                part = g
            elif self.name == "euclidean" or (self.name == "minkowski" and self.p == 2):
                part = g * g
            elif self.name == "minkowski":
                part = g**self.p
            else:
                total = g if total is None else np.maximum(total, g)
                continue
            total = part if total is None else total + part
        if self.masked:
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.where(present > 0, np.sqrt(total * (dims / present)), np.inf)
        if self.name == "euclidean" or (self.name == "minkowski" and self.p == 2):
            return np.sqrt(total)
        if self.name == "minkowski" and self.p != 1:
            return total ** (1.0 / self.p)
        return total

    def pairwise(self, q: np.ndarray, t: np.ndarray) -> np.ndarray:
        return self.of_gaps((q[:, j, None] - t[None, :, j] for j in range(q.shape[1])), q.shape[1])

    def rowwise(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.of_gaps((a[:, j] - b[:, j] for j in range(a.shape[1])), a.shape[1])


class Screen:
    """Which rows of a chunk can be among a query's nearest: quick distances with a bound on their error
    leave a few rows, whose distances are then computed as the metric says.

    Squared Euclidean distances, also over shared coordinates, are matrix products. Sums of absolute gaps
    are added up in single precision, in tiles that stay in the cache."""

    def __init__(self, metric: Metric, t: np.ndarray):
        self.metric, self.t = metric, t
        plain = metric.name == "euclidean" or (metric.name == "minkowski" and metric.p == 2)
        size = np.abs(t).max(initial=0.0, where=np.isfinite(t))
        small = bool(size < LARGEST)
        self.products = (plain or metric.masked) and small
        self.sums = small and (metric.name == "manhattan" or (metric.name == "minkowski" and metric.p == 1))
        # rows with a coordinate that is not finite are at no finite distance, unless it counts as missing
        self.usable = np.flatnonzero((np.isfinite(t) | (np.isnan(t) if metric.masked else False)).all(1))
        x = t if len(self.usable) == len(t) else t[self.usable]
        if self.products:
            there = ~np.isnan(x)
            self.middle = np.where(there, x, 0.0).sum(0) / np.maximum(there.sum(0), 1)
            if metric.masked and not there.all():
                # rows that lack the same coordinates lie behind one another
                patterns, of = np.unique(there, axis=0, return_inverse=True)
                order = np.argsort(of.ravel(), kind="stable")
                self.usable, x, there = self.usable[order], x[order], there[order]
                self.patterns, self.starts = patterns.astype(float), np.searchsorted(of.ravel()[order], np.arange(len(patterns)))
            self.lacking = np.flatnonzero(~there.all(0)) if metric.masked else np.zeros(0, int)
            self.x = np.where(there, x - self.middle, 0.0)
            self.norms = np.square(self.x).sum(1)
            if metric.masked:
                self.squares, self.gone = np.square(self.x), (~there[:, self.lacking]).astype(float)
        elif self.sums:
            self.middle = x.mean(0) if len(x) else np.zeros(t.shape[1])
            centred = x - self.middle
            self.norms = np.abs(centred).sum(1)
            self.x = centred.astype(np.float32)
        else:
            self.x = x

    def quick(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values [queries, usable rows] that order like the distances, and how far each query's may be off."""
        d = q.shape[1]
        if self.sums:
            x = q - self.middle
            return self._summed(x.astype(np.float32)), 4 * (d + 8) * SINGLE * (np.abs(x).sum(1) + self.norms.max(initial=0.0))
        if not self.products:
            with np.errstate(all="ignore"):
                return self.metric.pairwise(q, self.x), np.zeros(len(q))
        mine = ~np.isnan(q)
        x = np.where(mine, q - self.middle, 0.0)
        top = np.square(x).sum(1) + self.norms.max(initial=0.0)
        slack = 8 * (d + 8) * ROUNDING * top
        value = x @ (-2.0 * self.x.T)
        value += np.square(x).sum(1)[:, None]
        value += self.norms
        if not self.metric.masked or (mine.all() and not len(self.lacking)):
            return value, slack
        # the squares that only one side has are taken off again: few coordinates are lacking on either side
        mute = np.flatnonzero(~mine.all(0))
        one_sided = [np.square(x[:, self.lacking]), (~mine[:, mute]).astype(float)], [self.gone, self.squares[:, mute]]
        value -= np.concatenate(one_sided[0], axis=1) @ np.concatenate(one_sided[1], axis=1).T
        patterns = self.patterns if len(self.lacking) else np.ones((1, d))
        starts = self.starts if len(self.lacking) else np.zeros(1, int)
        shared = mine.astype(float) @ patterns.T
        with np.errstate(divide="ignore", invalid="ignore"):
            if len(patterns) <= MANY_PATTERNS:
                for c, start, end in zip(range(len(patterns)), starts, [*starts[1:], len(self.x)]):
                    part = value[:, start:end]
                    part *= (d / shared[:, c])[:, None]
                    part[shared[:, c] == 0] = np.inf
            else:
                shared = np.repeat(shared, np.diff([*starts, len(self.x)]), axis=1)
                value = np.where(shared > 0, value * (d / shared), np.inf)
        return value, slack * d

    def _summed(self, q: np.ndarray) -> np.ndarray:
        """Sums of absolute gaps in single precision, by tiles."""
        value = np.empty((len(q), len(self.x)), np.float32)
        wide = max(1, min(len(self.x), TILE_ROWS))
        tall = max(1, TILE_NUMBERS // wide)
        for c in range(0, len(self.x), wide):
            columns = np.ascontiguousarray(self.x[c : c + wide].T)
            for r in range(0, len(q), tall):
                some = q[r : r + tall]
                total = np.zeros((len(some), columns.shape[1]), np.float32)
                gap = np.empty_like(total)
                for j in range(q.shape[1]):
                    np.subtract(some[:, j, None], columns[j], out=gap)
                    np.abs(gap, out=gap)
                    np.add(total, gap, out=total)
                value[r : r + tall, c : c + wide] = total
        return value

    def near(self, q: np.ndarray, k: int, need: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, rows): all pairs that may be among a query's k nearest, with the coordinate it needs."""
        fit = np.isfinite(q) | (np.isnan(q) if self.metric.masked else False)
        asked = np.flatnonzero(fit.all(1))
        if (self.products or self.sums) and np.abs(q[asked]).max(initial=0.0, where=np.isfinite(q[asked])) >= LARGEST:
            i, j = np.meshgrid(np.arange(len(q)), np.arange(len(self.t)), indexing="ij")
            return i.ravel(), j.ravel()
        value, slack = self.quick(q[asked])
        for c in np.unique(need[asked]):
            if c >= 0:
                value[np.ix_(need[asked] == c, ~here[self.usable, c])] = np.inf
        n = value.shape[1]
        whole = n - n % GROUP
        least = value[:, :whole].reshape(len(value), -1, GROUP).min(2) if whole else np.zeros((len(value), 0))
        least = np.concatenate([least, value[:, whole:]], axis=1)
        if least.shape[1] <= k:
            least = value
        bound = np.partition(least, k - 1, axis=1)[:, k - 1] if least.shape[1] > k else np.full(len(value), np.inf)
        i, j = np.nonzero(value <= (bound + 2 * slack)[:, None])
        return asked[i], self.usable[j]

    def exact(self, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        step = max(1, NUMBERS_AT_ONCE // max(1, q.shape[1]))
        with np.errstate(all="ignore"):
            parts = [self.metric.rowwise(q[i[c : c + step]], self.t[j[c : c + step]]) for c in range(0, len(i), step)]
        return np.concatenate(parts) if parts else np.zeros(0)


def vectors(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=float) for v in column], dtype=float)


def masked_bound(q: np.ndarray, low: np.ndarray, high: np.ndarray, present: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Lower bounds [q, cells] of the distance over shared coordinates, scaled up for missing ones:
    the least mean of squared gaps over the coordinates that all rows of the cell have and
    any number of those that only some have."""
    gap = np.square(np.maximum(np.maximum(low[None] - q[:, None], q[:, None] - high[None]), 0.0))
    usable = ~np.isnan(q)[:, None, :] & (present > 0)[None]
    must = usable & (present == rows[:, None])[None]
    total, n = np.where(must, gap, 0.0).sum(2), must.sum(2)
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(n > 0, total / n, np.inf)
        maybe = usable & ~must
        if maybe.any():
            spare = np.sort(np.where(maybe, gap, np.inf), axis=2)
            means = (total[:, :, None] + np.cumsum(spare, axis=2)) / (n[:, :, None] + np.arange(1, q.shape[1] + 1))
            least = np.minimum(least, means.min(2))
    return np.sqrt(least * q.shape[1])


@dataclass
class Cells:
    """What is known of some cells: arrays with one row per cell."""

    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    present: np.ndarray
    # pivots, with the least and greatest distance of the rows to them
    balls: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def bounds(self, metric: Metric, q: np.ndarray) -> np.ndarray:
        """Lower bound of the distance from each query to anything inside each cell."""
        if metric.masked:
            step = max(1, NUMBERS_AT_ONCE // max(1, self.low.size))
            return np.concatenate([masked_bound(q[k : k + step], self.low, self.high, self.present, self.rows) for k in range(0, len(q), step)])

        def gap(j: int) -> np.ndarray:
            x = q[:, j, None]
            return np.maximum(np.maximum(self.low[None, :, j] - x, x - self.high[None, :, j]), 0.0)

        out = metric.of_gaps((gap(j) for j in range(q.shape[1])), q.shape[1])
        for pivot, near, far in self.balls:
            to = metric.pairwise(q, pivot)
            slack = 1e-9 * (to + far)
            out = np.maximum(out, np.maximum(to - far, near - to) - slack)
        return out

    def home(self, bound: np.ndarray, need: np.ndarray, wanted: int) -> np.ndarray:
        """The nearest cells [q, cells] that hold ``wanted`` rows with the needed coordinate."""
        order = np.argsort(bound, axis=1, kind="stable")
        count = np.where(need[:, None] >= 0, self.present[:, np.maximum(need, 0)].T, self.rows[None, :])
        upto = np.cumsum(np.take_along_axis(count, order, 1), axis=1)
        before = np.concatenate([np.zeros((len(bound), 1)), upto[:, :-1]], axis=1)
        out = np.zeros(bound.shape, bool)
        np.put_along_axis(out, order, before < wanted, 1)
        return out


def _summary(frame: pd.DataFrame, pivot: np.ndarray, own: np.ndarray, metric: Metric) -> dict:
    x = vectors(frame["vec"])
    here = ~np.isnan(x)
    out = {"rows": len(x), "low": np.where(here, x, np.inf).min(0), "high": np.where(here, x, -np.inf).max(0), "present": here.sum(0)}
    for name, centre in (("region", pivot), ("own", own)):
        to = np.zeros(1) if metric.masked else metric.rowwise(x, np.broadcast_to(centre, x.shape))
        out[f"{name}_near"], out[f"{name}_far"] = float(to.min()), float(to.max())
    return out


SUMMARY = (
    "part string, region int, sub int, rows bigint, low array<double>, high array<double>, present array<bigint>, "
    "region_near double, region_far double, own_near double, own_far double, own array<double>"
)


def _combined(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """One row from several: of the chunks of a cell, or of the cells of a region."""
    first = frame.iloc[0]
    return pd.DataFrame(
        [
            {
                "part": first["part"], "region": first["region"], "sub": first["sub"], "rows": frame["rows"].sum(),
                "low": vectors(frame["low"]).min(0), "high": vectors(frame["high"]).max(0),
                "present": np.array([np.asarray(v) for v in frame["present"]]).sum(0),
                "region_near": frame["region_near"].min(), "region_far": frame["region_far"].max(),
                "own_near": frame["own_near"].min(), "own_far": frame["own_far"].max(), "own": first["own"],
            }
        ]
    )


def _as_cells(frame: pd.DataFrame, pivots: np.ndarray, own: bool) -> Cells:
    columns = [frame[c].to_numpy(dtype=float) for c in ("region_near", "region_far", "own_near", "own_far")]
    balls = [(pivots[frame["region"].to_numpy()], columns[0], columns[1])]
    if own:
        balls.append((vectors(frame["own"]), columns[2], columns[3]))
    present = np.array([np.asarray(v) for v in frame["present"]])
    return Cells(frame["rows"].to_numpy(), vectors(frame["low"]), vectors(frame["high"]), present, balls)


def centres(sample: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """k of the sample's points spread over it, moved to the means of their groups."""
    found = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = _closest(sample, found)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(found)
        np.add.at(sums, at, sample)
        found = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], found)
    return found


def _closest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out, norms = np.zeros(len(x), int), np.square(pivots).sum(1)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (norms - 2 * x[at : at + 4096] @ pivots.T).argmin(1)
    return out


@dataclass
class Router:
    """Where a vector goes: missing coordinates count as the sample's mean, and whether a
    coordinate is there counts as a coordinate of its own."""

    mean: np.ndarray
    spread: np.ndarray
    masked: bool

    def place(self, x: np.ndarray) -> np.ndarray:
        if not self.masked:
            return x
        here = ~np.isnan(x)
        return np.concatenate([np.where(here, x, self.mean), here * self.spread], axis=1)


def ddl(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def with_defaults(df: DataFrame, **defaults: Column) -> DataFrame:
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, value)
    return df


@dataclass
class NeighbourIndex:
    """``rows``: part, cell, chunk, tid, vec, weight, payload; ``cells``: one summary per cell. Without
    ``cells`` every query meets all of the few ``chunks``. ``regions`` and ``routes`` are bounded arrays."""

    rows: DataFrame
    metric: Metric
    cell_rows: int
    chunks: int = 1
    cells: DataFrame | None = None
    pivots: np.ndarray | None = None
    routes: np.ndarray | None = None
    router: Router | None = None
    regions: Cells | None = None
    cut: bool = False

    # ---- building ----

    @classmethod
    def build(
        cls, train: DataFrame, metric: Metric = Metric("euclidean"), cell_rows: int = CELL_ROWS, regions: int = REGIONS, flat: int = FLAT_CHUNKS
    ) -> NeighbourIndex:
        """``train``: tid, vec, and optionally part (searched apart), weight (copies the row stands
        for) and payload."""
        train = with_defaults(train, part=F.lit(""), weight=F.lit(1), payload=F.lit(None).cast("double"))
        train = train.select(
            F.col("part").cast("string").alias("part"), "tid", "vec", F.col("weight").cast("bigint").alias("weight"), "payload"
        )
        n = train.count()
        wanted = -(-n // cell_rows)
        if wanted <= flat:
            chunk = F.pmod(F.xxhash64("tid"), F.lit(max(1, wanted))).cast("int")
            rows = train.select("part", F.lit(0).cast("bigint").alias("cell"), chunk.alias("chunk"), "tid", "vec", "weight", "payload")
            return cls(rows, metric, cell_rows, max(1, wanted))
        sample = vectors(pd.Series(hashed_values(train, "vec", SAMPLE, n)))
        with np.errstate(all="ignore"):
            here = ~np.isnan(sample)
            mean = np.where(here.any(0), np.where(here, sample, 0).sum(0) / np.maximum(here.sum(0), 1), 0.0)
            spread = np.sqrt(np.where(here, np.square(sample - mean), 0).sum(0) / np.maximum(here.sum(0), 1))
        router = Router(mean, np.where(spread > 0, spread, 1.0), metric.masked)
        routes = centres(router.place(sample), min(regions, wanted, len(sample)))
        pivots = routes[:, : sample.shape[1]]
        index = cls(train, metric, cell_rows, 0, None, pivots, routes, router, None, wanted > regions)
        placed = index._placed(train, n)
        index._lay_out(placed)
        return index

    def _placed(self, train: DataFrame, n: int) -> DataFrame:
        """Rows with region, sub (the cell within the region), own (the cell's pivot)."""
        tid, pay = ddl(train, "tid"), ddl(train, "payload")
        router, routes = self.router, self.routes
        kinds = f"part string, tid {tid}, vec array<double>, weight bigint, payload {pay}, h bigint, region int"

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    batch["region"] = _closest(router.place(vectors(batch["vec"])), routes)
                    yield batch

        hashed = train.withColumn("h", F.pmod(F.xxhash64("tid"), F.lit(1 << 30)))
        placed = hashed.mapInPandas(route, kinds)
        if not self.cut:
            return placed.withColumn("sub", F.lit(0)).withColumn("own", F.lit(None).cast("array<double>"))
        placed = materialize(placed)
        # one row in cell_rows is a pivot of its region; no region is without one
        share = max(1, (1 << 30) // self.cell_rows)
        drawn = placed.where(F.pmod(F.xxhash64("h", F.lit(3)), F.lit(1 << 30)) < share)
        drawn = materialize(drawn.select(F.col("region").alias("place"), F.col("vec").alias("pivot")).distinct())
        sizes = placed.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / F.lit(REGION_ROWS)).cast("int").alias("tasks"))
        dealt = placed.join(sizes, "region").withColumn("task", F.pmod("h", F.col("tasks")).cast("int")).drop("tasks")
        tasks = sizes.select(F.col("region").alias("place"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("slot"))
        told = drawn.join(tasks, "place")

        def cut(rows: pd.DataFrame, subs: pd.DataFrame) -> pd.DataFrame:
            x = vectors(rows["vec"])
            region = int(rows["region"].iloc[0]) if len(rows) else 0
            own = vectors(subs["pivot"]) if len(subs) else np.zeros((0, x.shape[1] if len(rows) else 0))
            own = own[np.lexsort(own.T[::-1])] if len(own) > 1 else own
            if not len(rows):
                return rows.assign(sub=0, own=None).drop(columns="task")
            if not len(own):
                own, near = routes[region : region + 1, : x.shape[1]], np.zeros(len(x), int)
            else:
                near = _closest(router.place(x), router.place(own))
            rows = rows.drop(columns="task")
            rows["sub"], rows["own"] = near, [own[k] for k in near]
            return rows

        return dealt.groupBy("region", "task").cogroup(told.groupBy("place", "slot")).applyInPandas(cut, f"{kinds}, sub int, own array<double>")

    def _lay_out(self, placed: DataFrame) -> None:
        placed = materialize(placed)
        where = ["part", "region", "sub"]
        sizes = placed.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / F.lit(self.cell_rows)).cast("int").alias("chunks"))
        cell = F.shiftleft(F.col("region").cast("bigint"), 32) + F.col("sub")
        laid = placed.join(sizes, where).select("*", cell.alias("cell"), F.pmod("h", F.col("chunks")).cast("int").alias("chunk"))
        metric, pivots = self.metric, self.pivots

        def measure(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            first = frame.iloc[0]
            pivot = pivots[first["region"]]
            own = pivot if first["own"] is None else np.asarray(first["own"], float)
            row = _summary(frame, pivot, own, metric) | {"part": first["part"], "region": first["region"], "sub": first["sub"], "own": own}
            return pd.DataFrame([row])

        chunks = laid.groupBy("part", "cell", "chunk").applyInPandas(measure, SUMMARY)
        cells = materialize(chunks.groupBy(*where).applyInPandas(_combined, SUMMARY))
        # cells of a region meet the queries in blocks of bounded size
        blocks = cells.groupBy("part", "region").agg(F.ceil(F.count(F.lit(1)) / F.lit(CELLS_AT_ONCE)).cast("int").alias("blocks"))
        chunk_counts = sizes.select(*where, "chunks")
        cells = cells.join(chunk_counts, where).join(blocks, ["part", "region"])
        self.cells = materialize(cells.withColumn("block", F.pmod("sub", F.col("blocks"))))
        self.rows = laid.select("part", "cell", "chunk", "tid", "vec", "weight", "payload")
        self._read_regions()

    def _read_regions(self) -> None:
        # one row per region, of which there are REGIONS at most
        frame = self.cells.drop("chunks", "blocks", "block").groupBy("region").applyInPandas(_combined, SUMMARY).toPandas()
        frame = frame.sort_values("region", ignore_index=True)
        self.regions = _as_cells(frame, self.pivots, False)
        self.region_ids = frame["region"].to_numpy()

    # ---- keeping ----

    def save(self, path: str) -> None:
        spark = self.rows.sparkSession
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        about = {"metric": self.metric.name, "p": self.metric.p, "cell_rows": self.cell_rows, "chunks": self.chunks, "cut": self.cut}
        if self.cells is not None:
            self.cells.write.mode("overwrite").parquet(f"{path}/cells")
            about["router"] = [self.router.mean.tolist(), self.router.spread.tolist()]
            about["routes"] = self.routes.tolist()
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NeighbourIndex:
        about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
        metric = Metric(about["metric"], about["p"])
        rows = spark.read.parquet(f"{path}/rows")
        if "routes" not in about:
            return cls(rows, metric, about["cell_rows"], about["chunks"])
        mean, spread = map(np.array, about["router"])
        routes = np.array(about["routes"])
        cells = spark.read.parquet(f"{path}/cells")
        router = Router(mean, spread, metric.masked)
        index = cls(rows, metric, about["cell_rows"], 0, cells, routes[:, : len(mean)], routes, router, None, about["cut"])
        index._read_regions()
        return index

    # ---- asking ----

    def nearest(self, queries: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
        """(qid, tid, dist, weight, payload, taken) of the k nearest rows per query.

        ``queries``: qid, vec and optionally part and need (index of a coordinate that neighbours
        must have). ``taken`` is how many of a row's copies count among the k. Ties are broken by
        tid. ``skip_self`` leaves out one copy of the row whose tid equals the query's qid."""
        return self._rounds(queries, k, skip_self)[0]

    def visits(self, queries: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
        """(qid, cells): how many cells a query was compared with, row by row."""
        asked = self._rounds(queries, k, skip_self)[1]
        both = asked[0].select("qid", "cell")
        for more in asked[1:]:
            both = both.unionByName(more.select("qid", "cell"))
        return both.groupBy("qid").agg(F.countDistinct("cell").alias("cells"))

    def _rounds(self, queries: DataFrame, k: int, skip_self: bool) -> tuple[DataFrame, list[DataFrame]]:
        queries = with_defaults(queries, part=F.lit("").cast("string"), need=F.lit(-1))
        # renamed, so that queries taken from the rows themselves share no column with them
        queries = queries.select(
            F.col("qid").alias("qid"), F.col("vec").alias("vec"), F.col("part").cast("string").alias("part"), F.col("need").cast("int").alias("need")
        )
        if self.cells is None:
            asked = queries.select("*", F.lit(0).cast("bigint").alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(self.chunks - 1))).alias("chunk"))
            times = max(1, -(-queries.count() // self.cell_rows))
            cut = F.pmod(F.xxhash64("qid", "need"), F.lit(times)).cast("int")
            copies = self.rows.withColumn("qc", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
            return merged(self._search(asked.withColumn("qc", cut), copies, k, skip_self), k), [asked]
        wanted = k + (1 if skip_self else 0)
        first = materialize(self._cells_of(queries.withColumn("reach", F.lit(None).cast("double")), wanted, True))
        found = materialize(merged(self._sliced(first, k, skip_self), k))
        full = F.when(F.sum("taken") >= k, F.max("dist")).otherwise(F.lit(float("inf")))
        reach = found.groupBy("qid").agg(full.alias("reach"))
        bounded = queries.join(reach, "qid", "left").select("qid", "vec", "part", "need", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
        second = materialize(self._cells_of(bounded, wanted, False))
        more = self._sliced(second, k, skip_self)
        return merged(found.drop("taken").unionByName(more), k), [first, second]

    def _cells_of(self, queries: DataFrame, wanted: int, first: bool) -> DataFrame:
        """qid, vec, part, need, cell, chunk: the chunks to search for each query, in the first round those
        of its home cells, in the second all others that reach into its bound."""
        metric, regions, ids, pivots, own = self.metric, self.regions, self.region_ids, self.pivots, self.cut
        qid = ddl(queries, "qid")

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                bound = regions.bounds(metric, vectors(batch["vec"]))
                need = batch["need"].to_numpy()
                home = regions.home(bound, need, wanted)
                if first:
                    chosen = home
                else:
                    chosen = home | (bound <= batch["reach"].to_numpy()[:, None] * (1 + 1e-9) + 1e-12)
                    asking = need >= 0
                    chosen[asking] &= regions.present[:, need[asking]].T > 0
                row, region = np.nonzero(chosen)
                out = batch.iloc[row].reset_index(drop=True)
                out["region"], out["home"] = ids[region], home[row, region]
                yield out

        sent = queries.mapInPandas(send, f"qid {qid}, vec array<double>, part string, need int, reach double, region int, home boolean")
        sent = materialize(sent)
        load = sent.groupBy("part", "region").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_ROWS)).cast("int").alias("qn"))
        spots = self.cells.select("part", "region", "blocks").distinct().join(load, ["part", "region"])
        sent = sent.join(spots, ["part", "region"]).withColumn("qc", F.pmod(F.xxhash64("qid", "need"), F.col("qn")).cast("int"))
        sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("qn", "blocks")
        cells = self.cells.join(load, ["part", "region"]).withColumn("qc", F.explode(F.sequence(F.lit(0), F.col("qn") - 1))).drop("qn", "blocks")

        def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            columns = ["qid", "vec", "part", "need", "cell", "chunk"]
            if q.empty or c.empty:
                return pd.DataFrame(columns=columns)
            c = c.sort_values("sub", ignore_index=True)
            known = _as_cells(c, pivots, own)
            cell = (c["region"].to_numpy().astype(np.int64) << 32) + c["sub"].to_numpy()
            chunks, parts = c["chunks"].to_numpy(), []
            for at in range(0, len(q), 512):
                some = q.iloc[at : at + 512]
                bound = known.bounds(metric, vectors(some["vec"]))
                need = some["need"].to_numpy()
                home = known.home(bound, need, wanted) & some["home"].to_numpy()[:, None]
                if first:
                    chosen = home
                else:
                    chosen = ~home & (bound <= some["reach"].to_numpy()[:, None] * (1 + 1e-9) + 1e-12)
                asking = need >= 0
                chosen[asking] &= known.present[:, need[asking]].T > 0
                row, at_cell = np.nonzero(chosen)
                times = chunks[at_cell]
                row, at_cell = np.repeat(row, times), np.repeat(at_cell, times)
                out = some.iloc[row][["qid", "vec", "part", "need"]].reset_index(drop=True)
                out["cell"] = cell[at_cell]
                out["chunk"] = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                parts.append(out)
            return pd.concat(parts, ignore_index=True)

        by = ["part", "region", "block", "qc"]
        schema = f"qid {qid}, vec array<double>, part string, need int, cell bigint, chunk int"
        return sent.groupBy(*by).cogroup(cells.groupBy(*by)).applyInPandas(meet, schema)

    def _sliced(self, asked: DataFrame, k: int, skip_self: bool) -> DataFrame:
        """Search the chunks for the queries sent to them; many queries of a chunk go to several tasks."""
        keys = ["part", "cell", "chunk"]
        load = asked.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(self.cell_rows)).cast("int").alias("qn"))
        sliced = asked.join(load, keys).withColumn("qc", F.pmod(F.xxhash64("qid", "need"), F.col("qn")).cast("int")).drop("qn")
        copied = self.rows.join(load, keys).withColumn("qc", F.explode(F.sequence(F.lit(0), F.col("qn") - 1))).drop("qn")
        return self._search(sliced, copied, k, skip_self)

    def _search(self, asked: DataFrame, rows: DataFrame, k: int, skip_self: bool) -> DataFrame:
        metric = self.metric
        columns = ["qid", "tid", "dist", "weight", "payload"]

        def local(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
            if q.empty or t.empty:
                return pd.DataFrame(columns=columns)
            tx, tid, weight = vectors(t["vec"]), t["tid"].to_numpy(), t["weight"].to_numpy()
            qx, qid, need = vectors(q["vec"]), q["qid"].to_numpy(), q["need"].to_numpy()
            rank = np.empty(len(tid), dtype=int)
            rank[np.argsort(tid, kind="stable")] = np.arange(len(tid))
            # a query's own rows may be nearer than its k-th neighbour
            own = int(pd.Series(tid).value_counts().max()) if skip_self and pd.notna(tid).any() else 0
            screen = Screen(metric, tx)
            here = ~np.isnan(tx)
            out = []
            step = max(1, min(256, NUMBERS_AT_ONCE // len(tid)))
            for at in range(0, len(qx), step):
                some = need[at : at + step]
                i, j = screen.near(qx[at : at + step], k + own, some, here)
                dist = screen.exact(qx[at : at + step], i, j)
                good = np.isfinite(dist)
                if skip_self:
                    good &= weight[j] - (tid[j] == qid[at + i]) > 0
                good &= (some[i] < 0) | here[j, np.maximum(some[i], 0)]
                i, j, dist = i[good], j[good], dist[good]
                order = np.lexsort((rank[j], dist, i))
                i, j, dist = i[order], j[order], dist[order]
                count = np.bincount(i, minlength=len(some))
                best = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) < k
                i, j, dist = i[best], j[best], dist[best]
                out.append((at + i, j, dist, weight[j] - (tid[j] == qid[at + i]) if skip_self else weight[j]))
            a, b, dist, left = (np.concatenate(x) for x in zip(*out))
            payload = tx[b, need[a]] if metric.masked else t["payload"].to_numpy()[b]
            return pd.DataFrame({"qid": qid[a], "tid": tid[b], "dist": dist, "weight": left, "payload": payload})

        by = ["part", "cell", "chunk", "qc"]
        schema = f"qid {ddl(asked, 'qid')}, tid {ddl(rows, 'tid')}, dist double, weight bigint, payload {ddl(rows, 'payload')}"
        return asked.groupBy(*by).cogroup(rows.groupBy(*by)).applyInPandas(local, schema)


def merged(found: DataFrame, k: int) -> DataFrame:
    """The best k copies per query among the at most k rows per visited chunk. Every row is a copy
    at least, so its rank limits what is kept, before the shuffle and after it."""
    order = Window.partitionBy("qid").orderBy("dist", "tid")
    best = found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")
    before = F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        best.withColumn("_before", before)
        .where(F.col("_before") < k)
        .withColumn("taken", F.least("weight", F.lit(k) - F.col("_before")))
        .drop("_before")
    )
