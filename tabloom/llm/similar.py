"""Near duplicates of a Jaccard similarity, by ball hashing on several SimHash blocks.

Two texts whose sets of five-word shingles have a similarity of 0.8 differ in about every
seventh bit of a SimHash: ten of 64, too many for the variants of one fingerprint. So a text
gets BLOCKS independent blocks of WIDTH bits. Blocks within RADIUS * 2 bits meet in the
middle, as whole fingerprints do in ``simhash``: every block stands for all its variants
within RADIUS bits, and texts that share a variant are candidates. At a similarity of 0.8 one
block meets with a probability of about a quarter, one of eight with more than 0.9; at 0.9
all but one in a thousand pairs meet. A further 64 bits of SimHash, which travel with the
block, reject most chance meetings in the task that finds them.

All texts around a variant are first paired with the first of them, not with each other, and of the
pairs a task finds only those of a spanning forest leave it, the most similar ones first by
those 64 bits. So a group of copies gives no list of all pairs. Every pair is then verified by the exact
similarity of the shingle sets; verified pairs form groups. Texts of which a pair was left out meet a second
time: then all pairs that share a variant and lie in different groups are verified, so none is missed. Equal shingle sets are one entry from the
start. Sets and shingles are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import fresh, map_columns, tidy, written
from tabloom.llm.components import components
from tabloom.llm.simhash import CELL_FINGERPRINTS, PART_VARIANTS, SEED, STRETCH, Ball

SIMILARITY = 0.8
SHINGLE = 5
BLOCKS, WIDTH, RADIUS = 8, 40, 2
SKETCH = BLOCKS * WIDTH // 64 + 1  # numbers of 64 bits: the blocks, then the bits that travel with them
CHECK_BITS = 22  # of those at most so many differ between candidates; at 0.8 it is 10, give or take 3
CELLS = 4  # of each block, while a cell can hold every text
PAIRS_HELD = 200_000  # pairs of a task, beside those of its forest
PAIRS_AT_ONCE = 1_000_000  # compared by their travelling bits
MIX = [0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1 for k in range(1, SKETCH + 1)]


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted different XXH64 values of the word shingles, A-Z in lower case; a text of fewer words
    is one shingle, one without words has none."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    size = min(shingle, len(words))
    starts, ends = (ends - lengths)[: len(words) - size + 1], ends[size - 1 :]
    parts = map(slice, starts.tolist(), ends.tolist())
    digests = map(xxhash.xxh64_intdigest, map(joined.__getitem__, parts), repeat(SEED))
    return np.unique(np.fromiter(digests, np.uint64, len(starts)))


def sketch(hashes: np.ndarray) -> bytes:
    """SKETCH numbers of 64 bits: those set in more than half of the remixed shingle values."""
    out = []
    for odd in MIX:
        total = np.zeros(64, np.int64)
        for at in range(0, len(hashes), STRETCH):
            x = hashes[at : at + STRETCH] * np.uint64(odd)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            total += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(np.packbits(2 * total > len(hashes)).tobytes())
    return b"".join(out)


def blocks_of(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(blocks [n, BLOCKS] as numbers of WIDTH bits, travelling bits [n])."""
    raw = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, 8 * SKETCH)
    step = WIDTH // 8
    wide = np.zeros((len(raw), BLOCKS, 8), np.uint8)
    wide[:, :, :step] = raw[:, : BLOCKS * step].reshape(-1, BLOCKS, step)
    return wide.view("<u8")[:, :, 0], np.ascontiguousarray(raw[:, -8:]).view("<u8")[:, 0]


class BlockBall(Ball):
    """The variants of a block."""

    def __init__(self, bits: int):
        super().__init__(RADIUS, bits)
        keep = self.masks < np.uint64(1 << WIDTH)
        self.masks, self.mask_hash = self.masks[keep], self.mask_hash[keep]


def met_pairs(
    values: np.ndarray, check: np.ndarray, ids: np.ndarray, ball: Ball, cell_bits: int, cell: int, part_bits: int, groups: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Of the blocks whose variants fall into a cell, pairs (larger id, smaller id) that share a variant, and the ids
    of which more pairs may be wanted. Without ``groups`` the pairs are a spanning forest of those with the first id
    around a variant; with them all pairs of different groups, of which none is left out."""
    order = np.argsort(ball.hash(values), kind="stable")
    values, check, ids = values[order], check[order], ids[order]
    groups = ids if groups is None else groups[order]
    whole = groups is not ids
    classes = ball.hash(values)
    found, more = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)]

    def reduced() -> np.ndarray:
        pairs = np.unique(np.concatenate(found), axis=0)
        if whole:
            return pairs
        kept = strongest(pairs)
        if len(kept) < len(pairs):
            cut = pairs[~np.isin(_rows(pairs), _rows(kept))]
            more.append(np.unique(cut[:, :2]))
        return kept

    def add(x: np.ndarray, y: np.ndarray) -> None:
        apart = np.bitwise_count(check[x] ^ check[y]).astype(np.int64)
        good = (ids[x] != ids[y]) & (apart <= CHECK_BITS)
        if good.any():
            x, y = ids[x[good]], ids[y[good]]
            found.append(np.unique(np.column_stack([np.maximum(x, y), np.minimum(x, y), apart[good]]), axis=0))
            if sum(map(len, found)) > max(PAIRS_HELD, 2 * len(found[0])):
                found[:] = [reduced()]

    for part in range(1 << part_bits):
        wanted = (cell | part << cell_bits) ^ ball.mask_hash  # the hash of all variants expanded now
        low, high = np.searchsorted(classes, wanted), np.searchsorted(classes, wanted, side="right")
        used = np.flatnonzero(high > low)
        if not len(used):
            continue
        own = np.concatenate([np.arange(low[m], high[m]) for m in used])
        variant = values[own] ^ np.repeat(ball.masks[used], high[used] - low[used])
        by = np.lexsort((ids[own], groups[own], variant)) if whole else np.lexsort((ids[own], variant))
        own, variant = own[by], variant[by]
        first = np.ones(len(own), bool)
        first[1:] = variant[1:] != variant[:-1]
        if not whole:
            start = np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
            size = np.diff(np.append(np.flatnonzero(first), len(own)))
            more.append(np.unique(ids[own[np.repeat(size, size) > 2]]))
            add(own[~first], own[start[~first]])
            if len(more) > 64:
                more[:] = [np.unique(np.concatenate(more))]
            continue
        # everything with everything of the later groups around the variant, by bounded stretches
        next_group = first.copy()
        next_group[1:] |= groups[own[1:]] != groups[own[:-1]]
        partners = _ends(next_group)
        times = _ends(first) - partners
        upto = np.cumsum(times)
        at = 0
        while at < len(own):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
            n = times[at:stop]
            if n.any():
                x = np.repeat(np.arange(at, stop), n)
                y = np.repeat(partners[at:stop], n) + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
                add(own[x], own[y])
            at = stop
    pairs = reduced()
    return pairs, np.unique(np.concatenate(more))


def _ends(starts: np.ndarray) -> np.ndarray:
    """For every place where the run ends that it lies in; runs begin where ``starts`` is true."""
    at = np.append(np.flatnonzero(starts), len(starts))
    return np.repeat(at[1:], np.diff(at))


def _rows(pairs: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(pairs).view([("", pairs.dtype)] * pairs.shape[1]).ravel()


def strongest(pairs: np.ndarray) -> np.ndarray:
    """Of pairs (a, b, differing bits) those of a spanning forest, the most alike taken first."""
    pairs = pairs[np.argsort(pairs[:, 2], kind="stable")]
    _, at = np.unique(pairs[:, :2], return_inverse=True)
    root = list(range(int(at.max(initial=-1)) + 1))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    keep, at = [], at.reshape(-1, 2)
    for n, (a, b) in enumerate(zip(at[:, 0].tolist(), at[:, 1].tolist())):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            keep.append(n)
    return pairs[keep]


def candidates(kinds: DataFrame) -> DataFrame:
    """(a, b): different pairs of kinds (kind long, sketch binary) that may be alike, a > b. They connect all that may
    be; a kind of which other pairs may be wanted, where some of these turn out not to be alike, is there with
    itself. If kinds have a ``grp`` (long), all pairs of different groups are returned."""
    n = kinds.count()
    grouped = "grp" in kinds.columns
    masks = len(BlockBall(1).masks)
    cells = CELLS
    while n * min(1, masks / cells) > CELL_FINGERPRINTS:
        cells *= 2
    cell_bits = cells.bit_length() - 1
    part_bits = max(0, int(n * masks / cells / PART_VARIANTS).bit_length())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        ball = BlockBall(cell_bits + part_bits)
        to = np.unique(ball.mask_hash & (cells - 1))
        for batch in batches:
            ids, sketches, groups = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for at in range(0, len(ids), 2048):
                blocks, check = blocks_of(sketches[at : at + 2048])
                some, of = ids[at : at + 2048].view(np.uint64), groups[at : at + 2048].view(np.uint64)
                names, blobs = [], []
                for b in range(BLOCKS):
                    goal = ((ball.hash(blocks[:, b]) & (cells - 1))[:, None] ^ to).ravel()
                    order = np.argsort(goal, kind="stable")
                    goal, row = goal[order], np.repeat(np.arange(len(some)), len(to))[order]
                    sent = np.column_stack([blocks[row, b], check[row], some[row], of[row]][: 4 if grouped else 3])
                    heads = np.flatnonzero(np.append(True, goal[1:] != goal[:-1]))
                    names += (goal[heads] + b * cells).tolist()
                    blobs += [part.tobytes() for part in np.split(sent, heads[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["cell", "held"])

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        tidy()
        held = np.frombuffer(b"".join(frame["held"]), np.uint64).reshape(-1, 4 if grouped else 3)
        ball = BlockBall(cell_bits + part_bits)
        ids = np.ascontiguousarray(held[:, 2]).view(np.int64)
        groups = np.ascontiguousarray(held[:, 3]).view(np.int64) if grouped else None
        cell = int(frame["cell"].iloc[0]) & (cells - 1)
        pairs, more = met_pairs(held[:, 0], held[:, 1], ids, ball, cell_bits, cell, part_bits, groups)
        return pd.DataFrame({"a": np.append(pairs[:, 0], more), "b": np.append(pairs[:, 1], more)})

    sent = kinds.select("kind", "sketch", "grp" if grouped else F.col("kind").alias("grp")).mapInArrow(send, "cell int, held binary")
    return sent.groupBy("cell").applyInPandas(meet, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (kind, hashes) have at least this Jaccard similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("kind").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("kind").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def keep_one(
    docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; all its own columns.

    Groups are the components of pairs whose sets of word shingles have a Jaccard similarity of
    at least ``similarity``. Texts without words, NULL ones among them, are one group. A document
    is its id and its text, known by a 64-bit hash; rows without id come last, and of one id the
    hash decides, so a group always keeps exactly one row. An empty table gives no rows."""
    row_col, own_id, own_row = fresh(docs, "row_key"), fresh(docs, "stay_id"), fresh(docs, "stay_row")
    keyed = docs.withColumn(row_col, F.xxhash64(F.col(f"`{text_col}`")))
    narrow = keyed.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{row_col}`").alias("row_key"), F.col(f"`{text_col}`").cast("binary").alias("text")
    )

    def make():
        import xxhash

        def work(columns: list[pa.Array]) -> list[pa.Array]:
            kinds, sketches = [], []
            for text in columns[0]:
                found = shingle_set(text.as_py(), shingle)
                kinds.append(xxhash.xxh64_intdigest(found.tobytes()) if len(found) else 0)
                sketches.append(sketch(found) if len(found) else None)
            return [pa.array(np.array(kinds, np.uint64).view(np.int64)), pa.array(sketches, pa.binary())]

        return work

    def make_sets():
        return lambda columns: [pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in columns[0]], pa.binary())]

    fields = [("kind", T.LongType()), ("sketch", T.BinaryType())]
    rows = written(map_columns(narrow, ["text"], fields, make, keep=["doc_id", "row_key"]), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row_key"))
    kinds = written(rows.groupBy("kind").agg(F.first("sketch").alias("sketch"), first.alias("first")), "kinds")
    met = written(candidates(kinds.where("sketch IS NOT NULL")), "pairs")
    asked = met.select(F.col("a").alias("kind")).union(met.select(F.col("b").alias("kind"))).distinct()
    asked = kinds.join(asked, "kind", "left_semi").select("kind", F.col("first.doc_id").alias("id"), F.col("first.row_key").alias("row"))
    told = narrow.join(asked, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row_key") == F.col("row"))).select("kind", "text")
    sets = written(map_columns(told, ["text"], [("hashes", T.BinaryType())], make_sets, keep=["kind"]).dropDuplicates(["kind"]), "sets")
    pairs = met.where("a <> b")
    links = written(verified(pairs, sets, similarity), "links")
    # pairs that were left out while their ends are still apart
    open_ = kinds.join(met.where("a = b").select(F.col("a").alias("kind")), "kind", "left_semi").select("kind", "sketch")
    open_ = open_.join(components(links).withColumnRenamed("node", "kind"), "kind", "left")
    open_ = written(open_.select("kind", "sketch", F.coalesce("root", "kind").alias("grp")), "open")
    rest = written(candidates(open_).where("a <> b").join(pairs, ["a", "b"], "left_anti"), "rest")
    links = written(links.unionByName(verified(rest, sets, similarity)), "all_links")
    named = kinds.join(components(links).withColumnRenamed("node", "kind"), "kind", "left")
    heads = written(named.groupBy(F.coalesce("root", "kind").alias("root")).agg(F.min("first").alias("first")), "heads")
    stay = heads.select(F.col("first.doc_id").alias(own_id), F.col("first.row_key").alias(own_row))
    met = keyed.join(stay, F.col(f"`{id_col}`").eqNullSafe(F.col(own_id)) & (F.col(row_col) == F.col(own_row)), "left_semi")
    return met.dropDuplicates([id_col, row_col]).select(*[F.col(f"`{c}`") for c in docs.columns])
