"""Compression of vectors to short codes, with memoised grid cells.

A vector's components become integers; the vector is cut into consecutive parts, and each part is
replaced by the number of the nearest entry of its position's codebook. The codebooks start as
the parts of the vectors with the smallest ids and are improved in rounds: every part is
assigned, and each entry becomes the componentwise floor of the mean of its parts.

The nearest entry is found by way of a grid. A part lies in a coarse cell, a box of equal sides.
For a cell the least and the greatest distance of every entry to the box are computed once. An
entry whose least distance exceeds the greatest distance of some other entry is dominated across
the whole box: it is nearest to no point of it. The entries left are kept under the cell, and
only they are compared exactly with the parts of the cell. All distances are integers.

Every round is one pass over the vectors and one aggregate of sums per codebook entry; only the
codebooks pass the driver (``entries`` x components numbers).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import join_groups, map_columns, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
CELL = 128  # side of a grid cell
CELLS_KEPT = 20_000  # cells in a task's memory, per part
CELLS_AT_ONCE = 256
PAIRS_AT_ONCE = 200_000


def spans(width: int, parts: int = PARTS) -> list[slice]:
    """Consecutive parts of a vector; if they cannot be equal, the first ones are longer by one."""
    cuts = [(width * k + parts - 1) // parts for k in range(parts + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def undominated(cells: np.ndarray, side: int, book: np.ndarray) -> list[np.ndarray]:
    """For each cell [n, w] of the grid the entries of book [k, w] that may be nearest to one of
    its points, in order."""
    out = []
    for at in range(0, len(cells), CELLS_AT_ONCE):
        low = (cells[at : at + CELLS_AT_ONCE] * side)[:, None, :]
        high = low + (side - 1)
        least = np.square(np.maximum(np.maximum(low - book, book - high), 0)).sum(2)
        most = np.square(np.maximum(np.abs(book - low), np.abs(book - high))).sum(2)
        keep = least <= most.min(1)[:, None]
        out += [np.flatnonzero(row) for row in keep]
    return out


def nearest(rows: np.ndarray, book: np.ndarray, side: int, memory: dict[bytes, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the entry of book [k, w] nearest to each of rows [n, w]; ties go
    to the smaller number. ``memory``: entries by cell, kept between calls with the same book."""
    n = len(rows)
    cells = np.ascontiguousarray(rows // side)
    if cells.shape[1] == 0 or n == 0:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    named = cells.view(np.dtype((np.void, cells.shape[1] * cells.itemsize))).ravel()
    _, first, cell = np.unique(named, return_index=True, return_inverse=True)
    keys = [cells[k].tobytes() for k in first]
    missing = [k for k, key in enumerate(keys) if key not in memory]
    if len(memory) + len(missing) > CELLS_KEPT:
        memory.clear()
        missing = list(range(len(keys)))
    for k, found in zip(missing, undominated(cells[first[missing]], side, book)):
        memory[keys[k]] = found
    lists = [memory[key] for key in keys]
    sizes = np.array([len(x) for x in lists])
    starts, flat = np.cumsum(sizes) - sizes, np.concatenate(lists)
    entry, error = np.zeros(n, np.int64), np.zeros(n, np.int64)
    cell = cell.reshape(-1)
    ends = np.cumsum(sizes[cell])
    low = 0
    while low < n:
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, side="right")))
        own = cell[low:high]
        count = sizes[own]
        heads = np.cumsum(count) - count
        row = np.repeat(np.arange(low, high), count)
        asked = flat[np.arange(len(row)) - np.repeat(heads, count) + np.repeat(starts[own], count)]
        distance = np.square(rows[row] - book[asked]).sum(1)
        least = np.minimum.reduceat(distance, heads)
        number = np.where(distance == np.repeat(least, count), asked, len(book))
        entry[low:high], error[low:high] = np.minimum.reduceat(number, heads), least
        low = high
    return entry, error


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, scale: int) -> DataFrame:
    """vec_id, label, parts: the vectors without missing or non-finite components, as integers."""
    value = F.col(f"`{vector_col}`").cast("array<double>")
    good = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    label = F.lit(None).cast("int") if label_col is None else F.col(f"`{label_col}`")
    kept = vectors.where(value.isNotNull() & F.coalesce(good, F.lit(False)))
    return kept.select(
        F.col(f"`{id_col}`").alias("vec_id"), label.alias("label"), F.transform(value, lambda x: F.floor(x * scale)).alias("parts")
    )


def first_books(kept: DataFrame, entries: int, parts: int) -> list[np.ndarray]:
    """The codebooks [entries, w] at the start: parts of the vectors of smallest id. Vectors of
    one id are taken in the order of their components; those without id come last."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(entries).select("parts").collect()
    width = len(rows[0]["parts"]) if rows else 0
    table = np.array([r["parts"] for r in rows], np.int64).reshape(len(rows), width)
    return [table[:, s] for s in spans(table.shape[1], parts)]


def improved(kept: DataFrame, books: list[np.ndarray], side: int) -> list[np.ndarray]:
    """The codebooks after one round."""
    cuts = spans(sum(b.shape[1] for b in books), len(books))
    width = cuts[-1].stop

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = [{} for _ in books]
        total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            table = _matrix(batch.column(0), width)
            for p, book in enumerate(books):
                part = table[:, cuts[p]]
                entry, _ = nearest(part, book, side, memory[p])
                np.add.at(total[p], entry, np.column_stack([part, np.ones(len(part), np.int64)]))
        for p, held in enumerate(total):
            used = np.flatnonzero(held[:, -1])
            size = held.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(used) * size, p, np.int32)),
                    pa.array(np.repeat(used, size).astype(np.int32)),
                    pa.array(np.tile(np.arange(size, dtype=np.int32), len(used))),
                    pa.array(held[used].ravel()),
                ],
                names=["part", "entry", "place", "total"],
            )

    found = kept.select("parts").mapInArrow(sums, "part int, entry int, place int, total long")
    held = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
    # one number per codebook component
    for part, entry, place, total in found.groupBy("part", "entry", "place").agg(F.sum("total")).collect():
        held[part][entry, place] = total
    out = []
    for book, total in zip(books, held):
        used = total[:, -1:] > 0
        out.append(np.where(used, total[:, :-1] // np.maximum(total[:, -1:], 1), book))
    return out


def books_sha256(books: list[np.ndarray]) -> str:
    """Digest of all components in order of part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def learned(kept: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS, side: int = CELL) -> list[np.ndarray]:
    """Codebooks of the vectors of ``whole_vectors``."""
    books = first_books(kept, entries, parts)
    for _ in range(rounds):
        books = improved(kept, books, side) if len(books[0]) else books
    return books


def encoded(kept: DataFrame, books: list[np.ndarray], side: int = CELL) -> DataFrame:
    """vec_id, label, code (two hex digits per part), error (squared distance to the entries)."""
    cuts = spans(sum(b.shape[1] for b in books), len(books))
    width, digits = cuts[-1].stop, max(2, len(f"{max(len(books[0]) - 1, 0):x}"))

    def make():
        memory = [{} for _ in books]

        def work(columns: list[pa.Array]) -> list[pa.Array]:
            table = _matrix(columns[0], width)
            error, codes = np.zeros(len(table), np.int64), [""] * len(table)
            for p, book in enumerate(books):
                entry, more = nearest(table[:, cuts[p]], book, side, memory[p])
                error += more
                codes = [code + f"{k:0{digits}x}" for code, k in zip(codes, entry.tolist())]
            return [pa.array(codes, pa.string()), pa.array(error)]

        return work

    return map_columns(kept, ["parts"], [("code", T.StringType()), ("error", T.LongType())], make, keep=["vec_id", "label"])


def codes(
    vectors: DataFrame,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    parts: int = PARTS,
    scale: int = SCALE,
    side: int = CELL,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector without missing or
    non-finite components.

    ``label_error`` sums the errors of the rows of equal label, missing labels together. Fewer
    vectors than ``entries`` make smaller codebooks, repeated vectors repeated entries, of which
    the first is used. The vector of smallest id sets the dimension; vectors of another one take
    no part. Components, scaled, must stay below 2 ** 27, so that all sums are exact; larger ones
    end the job with an error. An empty table gives no rows."""
    kept = written(whole_vectors(vectors, id_col, vector_col, label_col, scale), "vectors")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "parts").select(F.size("parts").alias("n")).first()
    kept = kept.where(F.size("parts") == (0 if first is None else first["n"]))
    most = kept.agg(F.max(F.array_max(F.transform("parts", lambda x: F.abs(x)))).alias("most")).first()["most"]
    if most is not None and most >= 1 << 27:
        raise ValueError("components are too large for exact sums")
    books = learned(kept, entries, rounds, parts, side)
    rows = written(encoded(kept, books, side), "codes")
    sums = written(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "labels")
    out = join_groups(rows, sums, ["label"], "n", rows.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
