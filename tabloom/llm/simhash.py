"""Near duplicates by SimHash with meet-in-the-middle ball hashing.

Two fingerprints that differ in at most four bits have a common variant at a distance of two
bits or less from either. Every distinct fingerprint therefore stands for all its variants
within half the radius (2081 of 64 bits), and fingerprints that share a variant are linked.

The variants are shuffled by a hash that is linear over bits, so the hash of a variant is
that of the fingerprint combined with that of the flipped bits. A fingerprint is sent once to
every cell that holds some of its variants, and the cell's task expands those that belong
there, by parts of bounded size. What travels are 8 bytes per fingerprint and cell, not a row
per variant. All fingerprints around one variant are linked to the smallest of them: by the
triangle inequality they are within the radius of each other, which is verified again. A
task returns a spanning forest of its links, so groups of copies give no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import fresh, map_columns, written
from tabloom.llm.components import components, forest

SEED = 42
CELLS = 64  # while a cell can hold every fingerprint
CELL_FINGERPRINTS = 4_000_000  # held by one task at most, apart from chance
PART_VARIANTS = 1_000_000  # expanded at once
STRETCH = 65_536  # shingles counted at once


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """64 bits: those set in more than half of the XXH64 values of the word shingles."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    size = min(shingle, len(words))
    starts, ends = (ends - lengths)[: len(words) - size + 1], ends[size - 1 :]
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), STRETCH):
        parts = map(slice, starts[at : at + STRETCH].tolist(), ends[at : at + STRETCH].tolist())
        digests = b"".join(map(xxhash.xxh64_digest, map(joined.__getitem__, parts), repeat(SEED)))
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, name: str, text_col: str = "text", shingle: int = 4, keep: list[str] | None = None) -> DataFrame:
    """The documents with their fingerprint as a signed long."""

    def make():
        def work(columns: list[pa.Array]) -> list[pa.Array]:
            values = np.array([fingerprint(t, shingle) for t in columns[0].to_pylist()], np.uint64)
            return [pa.array(values.view(np.int64))]

        return work

    kept = docs.columns if keep is None else keep
    text = fresh(docs, "utf8")
    return map_columns(docs.withColumn(text, F.col(f"`{text_col}`").cast("binary")), [text], [(name, T.LongType())], make, keep=kept)


class Ball:
    """The variants within a radius, and a linear hash of 64 bits to ``bits`` bits."""

    def __init__(self, radius: int, bits: int):
        flips = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(64), r)]
        self.masks = np.array(flips, np.uint64)
        draw = np.random.default_rng(SEED)
        columns = draw.integers(0, 1 << bits, 64, dtype=np.int64)
        values = np.zeros((8, 256), np.int64)
        for byte in range(8):
            for i in range(8):
                has = (np.arange(256) >> i) & 1 == 1
                values[byte, has] ^= columns[8 * byte + i]
        self.table = values
        self.mask_hash = self.hash(self.masks)

    def hash(self, x: np.ndarray) -> np.ndarray:
        bytes_of = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)
        out = np.zeros(len(x), np.int64)
        for k in range(8):
            out ^= self.table[k, bytes_of[:, k]]
        return out


def _joined(fingerprints: np.ndarray, ball: Ball, cell_bits: int, cell: int, part_bits: int, radius: int):
    """Links (fingerprint, smaller fingerprint) of one cell, as a forest."""
    classes = ball.hash(fingerprints)
    order = np.argsort(classes, kind="stable")
    fingerprints, classes = fingerprints[order], classes[order]
    edges_a, edges_b = [], []
    for part in range(1 << part_bits):
        goal = cell | part << cell_bits  # the hash of all variants expanded now
        wanted = goal ^ ball.mask_hash
        low, high = np.searchsorted(classes, wanted), np.searchsorted(classes, wanted, side="right")
        used = np.flatnonzero(high > low)
        if not len(used):
            continue
        variants = np.concatenate([fingerprints[low[m] : high[m]] ^ ball.masks[m] for m in used])
        ordered = np.sort(variants)
        shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(shared):
            continue
        at = np.minimum(np.searchsorted(shared, variants), len(shared) - 1)
        where = np.flatnonzero(shared[at] == variants)
        mask = used[np.searchsorted(np.cumsum(high[used] - low[used]), where, side="right")]
        group, member = at[where], variants[where] ^ ball.masks[mask]
        by = np.lexsort((member, group))
        group, member = group[by], member[by]
        first = np.ones(len(group), bool)
        first[1:] = group[1:] != group[:-1]
        smallest = member[np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))]
        link = (member != smallest) & (np.bitwise_count(member ^ smallest) <= 2 * radius)
        a, b = forest(member[link], smallest[link])
        edges_a.append(a)
        edges_b.append(b)
    if not edges_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return forest(np.concatenate(edges_a), np.concatenate(edges_b))


def near_links(fingerprints: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): links with the same components as those between all fingerprints (one column of
    distinct longs) at most ``distance`` bits apart. ``distance`` is even."""
    if distance % 2 or not 0 <= distance <= 6:
        raise ValueError("distance must be 0, 2, 4 or 6")
    radius = distance // 2
    name = fingerprints.columns[0]
    n = fingerprints.count()
    masks = len(Ball(radius, 1).masks)
    cells = CELLS
    while n * min(1, masks / cells) > CELL_FINGERPRINTS:
        cells *= 2
    cell_bits = cells.bit_length() - 1
    part_bits = max(0, int(n * masks / cells / PART_VARIANTS).bit_length())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = Ball(radius, cell_bits + part_bits)
        to = np.unique(ball.mask_hash & (cells - 1))
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(values), 2048):
                some = values[at : at + 2048]
                goal = ((ball.hash(some) & (cells - 1))[:, None] ^ to).ravel()
                order = np.argsort(goal, kind="stable")
                goal, sent = goal[order], np.repeat(some, len(to))[order]
                heads = np.flatnonzero(np.append(True, goal[1:] != goal[:-1]))
                blobs = [part.tobytes() for part in np.split(sent, heads[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(goal[heads].astype(np.int32)), pa.array(blobs, pa.binary())], names=["cell", "held"])

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        held = np.frombuffer(b"".join(frame["held"]), np.uint64)
        ball = Ball(radius, cell_bits + part_bits)
        a, b = _joined(held, ball, cell_bits, int(frame["cell"].iloc[0]), part_bits, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    sent = fingerprints.select(F.col(name)).mapInArrow(send, "cell int, held binary")
    return sent.groupBy("cell").applyInPandas(meet, "a long, b long")


def _named(rows: DataFrame, first: Column, distance: int) -> DataFrame:
    """fp, root, first: each fingerprint of the rows with the smallest one that is reachable by
    links and the aggregate ``first`` of its own rows."""
    kinds = written(rows.groupBy("fp").agg(first.alias("first")), "kinds")
    roots = components(near_links(kinds.select("fp"), distance))
    named = kinds.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return written(named, "named")


def classes(docs: DataFrame, distance: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed long), component_id: the smallest doc_id that is reachable by links.

    A text without words and a NULL one have fingerprint zero, linked like any other. Rows
    without id take part but never name a component that has another row. Equal rows stay."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = written(with_fingerprint(narrow, "fp", "text", shingle, keep=["doc_id"]), "fingerprints")
    named = _named(rows, F.min("doc_id"), distance)
    # written, so that both sides of each join are plain shuffles, whose hot keys can be split
    smallest = written(named.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    of_kind = written(named.join(smallest, "root").select("fp", "component_id"), "of_kind")
    return rows.join(of_kind, "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hexadecimal digits, component_id."""
    found = classes(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id; all its own columns.

    A document is its id and its text, known by a 64-bit hash. Rows without id come last, and
    of one id the hash decides, so a component always keeps exactly one row."""
    row_col, own_id, own_row = fresh(docs, "row_key"), fresh(docs, "stay_id"), fresh(docs, "stay_row")
    keyed = docs.withColumn(row_col, F.xxhash64(F.col(f"`{text_col}`")))
    narrow = keyed.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(row_col).alias("row_key"), F.col(f"`{text_col}`").alias("text"))
    rows = written(with_fingerprint(narrow, "fp", "text", shingle, keep=["doc_id", "row_key"]), "fingerprints")
    named = _named(rows, F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row_key")), distance)
    heads = written(named.groupBy("root").agg(F.min("first").alias("first")), "heads")
    stay = heads.select(F.col("first.doc_id").alias(own_id), F.col("first.row_key").alias(own_row))
    met = keyed.join(stay, F.col(f"`{id_col}`").eqNullSafe(F.col(own_id)) & (F.col(row_col) == F.col(own_row)), "left_semi")
    one = met.dropDuplicates([id_col, row_col])
    return one.drop(row_col)
