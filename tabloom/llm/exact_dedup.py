"""Exact deduplication by a tree-merge of sorted digest runs.

Texts are equal when they are identical after lower-casing A-Z; they are known by the SHA-256 of
their normalised UTF-8 and its length. Every partition sorts its digests into a run, in which
equal ones are one entry: the digest, the preferred identifier and the number of rows. The runs
are then merged as in a binomial tree: in round r the partitions that agree in all but their
lowest r bits have become one run. One exchange takes BITS of those rounds at once, so up to
2 ** BITS sorted runs meet in a multiway merge. At every level entries of equal digest are
compared by the whole digest and the length, counted together, and the preferred identifier
of them is retained.

So that the root of the tree is no single task, the digests' value range is cut into ranges of
bounded size, each of which has its own tree. A text that a third of all rows repeat is one
entry of each run. Each row learns the winner of its digest by a join in which the few hot
digests are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import fresh, join_groups, written

BITS = 3  # binomial rounds of one exchange: eight runs are merged at once
RANGE_ROWS = 400_000  # rows of one range of digests, about
RUN_ROWS = 200_000  # rows sorted at once
PIECE = 50_000  # entries of one row of a shuffled run
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# an entry is nine numbers: the digest's four words, the text's bytes, whether the identifier is
# missing, its place in the order of preference, the row it belongs to, and how often it was met
WORDS, SIZE, MISSING, PLACE, ROW, COUNT = 4, 4, 5, 6, 7, 8
FIELDS = 9
SIGN = np.uint64(1 << 63)


def merged(runs: list[np.ndarray]) -> np.ndarray:
    """One sorted run of the entries [n, FIELDS] of several sorted ones, one entry per text: the
    one that comes first in the order of preference, with the counts added up."""
    rows = np.concatenate(runs)
    # the stable sort finds the runs it is given and merges them
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    tied = np.zeros(len(rows), bool)
    tied[1:] = rows[1:, 0] == rows[:-1, 0]
    tied[:-1] |= tied[1:]
    at = np.flatnonzero(tied)
    if not len(at):
        return rows
    some = rows[at]
    rows[at] = some[np.lexsort([some[:, k] for k in (ROW, PLACE, MISSING, SIZE, 3, 2, 1, 0)])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, : SIZE + 1] != rows[:-1, : SIZE + 1]).any(1)
    heads = np.flatnonzero(new)
    out = rows[heads]
    out[:, COUNT] = np.add.reduceat(rows[:, COUNT], heads)
    return out


def normalised(text: str) -> Column:
    """The text with A-Z in lower case; NULL is empty."""
    return F.translate(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), UPPER, LOWER)


def digests(docs: DataFrame, id_col: str, text_col: str, row: Column | None = None) -> DataFrame:
    """doc_id, digest, size, row: one narrow row per document."""
    plain = normalised(text_col)
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.unhex(F.sha2(plain.cast("binary"), 256)).alias("digest"),
        F.octet_length(plain).cast("long").alias("size"),
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
    )


def winners(rows: DataFrame, largest: bool, total: int, runs: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """digest, size, keep_id, keep_row, n: one row per different text of ``rows`` (those of
    ``digests``); ``runs``: how many partitions wrote them."""
    ranges = 1
    while total > ranges * range_rows:
        ranges *= 2
    shift = 64 - (ranges.bit_length() - 1)

    def entries(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((batch.num_rows, FIELDS), np.uint64)
        words = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u8").reshape(-1, WORDS)
        out[:, :WORDS] = words
        out[:, SIZE] = batch.column(2).to_numpy(zero_copy_only=False)
        ids = batch.column(0)
        out[:, MISSING] = ids.is_null().to_numpy(zero_copy_only=False)
        place = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ SIGN
        out[:, PLACE] = ~place if largest else place
        out[:, ROW] = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        out[:, COUNT] = 1
        return out

    def pieces(run: int, rows: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
        heads = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
        for low, high in zip(heads[:-1], heads[1:]):
            for at in range(low, high, PIECE):
                blob = rows[at : min(at + PIECE, high)].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(part[low])], pa.int64()), pa.array([run], pa.int64()), pa.array([blob], pa.binary())],
                    names=["part", "run", "entries"],
                )

    def parts_of(rows: np.ndarray) -> np.ndarray:
        return (rows[:, 0] >> np.uint64(shift)).astype(np.int64) if ranges > 1 else np.zeros(len(rows), np.int64)

    def first_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sort(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            own = (rows[:, ROW] >> np.uint64(33)).astype(np.int64)
            for run in np.unique(own):
                some = rows[own == run]
                some = merged([some[np.argsort(some[:, 0], kind="stable")]])
                yield from pieces(int(run), some, parts_of(some))

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(entries(batch))
                n += batch.num_rows
            if n >= RUN_ROWS:
                yield from sort(held)
                held, n = [], 0
        if held:
            yield from sort(held)

    def meet(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        runs = [np.frombuffer(x, np.uint64).reshape(-1, FIELDS) for x in frame["entries"]]
        rows = merged(runs)
        blobs = [rows[at : at + PIECE].tobytes() for at in range(0, len(rows), PIECE)]
        return pd.DataFrame({"part": key[0], "run": key[1], "entries": blobs})

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                rows = np.frombuffer(blob, np.uint64).reshape(-1, FIELDS)
                words = rows[:, :WORDS].astype(">u8").tobytes()
                place = ~rows[:, PLACE] if largest else rows[:, PLACE]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([words[k : k + 32] for k in range(0, len(words), 32)], pa.binary()),
                        pa.array(rows[:, SIZE].view(np.int64)),
                        pa.array((place ^ SIGN).view(np.int64), mask=rows[:, MISSING] == 1),
                        pa.array(rows[:, ROW].view(np.int64)),
                        pa.array(rows[:, COUNT].view(np.int64)),
                    ],
                    names=["digest", "size", "keep_id", "keep_row", "n"],
                )

    level = rows.select("doc_id", "digest", "size", "row").mapInArrow(first_runs, "part long, run long, entries binary")
    while True:
        level = level.select("part", F.shiftright("run", BITS).alias("run"), "entries")
        level = level.groupBy("part", "run").applyInPandas(meet, "part long, run long, entries binary")
        runs = -(-runs // 2**BITS)
        if runs <= 1:
            break
    return level.select("entries").mapInArrow(apart, "digest binary, size long, keep_id long, keep_row long, n long")


def _matched(rows: DataFrame, largest: bool, range_rows: int) -> DataFrame:
    held = rows.agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("last")).first()
    runs = ((held["last"] or 0) >> 33) + 1
    found = written(winners(rows, largest, held["n"], runs, range_rows), "winners")
    return join_groups(rows, found, ["digest", "size"], "n", held["n"])


def copies(
    docs: DataFrame, largest: bool = False, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs: of equal texts the row of
    smallest (or ``largest``) id is kept.

    A NULL text is empty. Ids are integers; a missing one gives way to every other. Of rows equal
    in text and id one is kept. Other columns of docs do not matter; an empty table gives no rows."""
    matched = _matched(written(digests(docs, id_col, text_col), "digests"), largest, range_rows)
    return matched.select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(
    docs: DataFrame, largest: bool = False, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS
) -> DataFrame:
    """The rows of docs that ``copies`` keeps, with all their columns."""
    row = fresh(docs, "row_number")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows = written(digests(numbered, id_col, text_col, F.col(row)), "digests")
    stay = _matched(rows, largest, range_rows).where("row = keep_row").select(F.col("row").alias(row))
    return numbered.join(stay, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
