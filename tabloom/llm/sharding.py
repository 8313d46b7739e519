"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every key hashes to a cell of a ring. Each shard owns many virtual nodes on the ring; a key
belongs to the first virtual node at or clockwise after its cell. A shard accepts rows up to
its capacity in ring order; the rows of a cell that no longer fit continue clockwise to the
next virtual node whose shard has room. The capacities add up to the rows when ``slack`` is
zero, so counts then differ by one at most; with some slack fewer rows leave their first shard.

Only the count of rows per cell (``cells`` numbers, whatever the data) passes the driver. The
rows themselves are ranked within their cell and joined with the bounded list of cell ranges.
Rows that are equal in id, size and checksum are counted before the shuffle and take a range
of ranks, so that a key with a third of all rows is not sorted row by row.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import small_table

MASK = (1 << 64) - 1


def _spread(x: int) -> int:
    """A 64-bit mix of an integer (the finaliser of SplitMix64)."""
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def ring(shards: int, vnodes: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in ring order. A shard's nodes do not depend on the
    number of shards; where two fall on one cell, the smaller shard comes first."""
    return sorted((_spread(shard * 1_000_003 + k) % cells, shard) for shard in range(shards) for k in range(vnodes))


def capacities(total: int, shards: int, slack: float) -> list[int]:
    if slack <= 0:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [-(-int(total * (1 + slack) + 1) // shards)] * shards


def allocate(counts: list[tuple[int, int]], shards: int, vnodes: int, cells: int, slack: float):
    """Ranges of ranks within the cells: (cell, from, to, shard, first slot).

    counts: (cell, rows). A loop over cells and virtual nodes, never over rows."""
    nodes = ring(shards, vnodes, cells)
    places = [cell for cell, _ in nodes]
    room = capacities(sum(n for _, n in counts), shards, slack)
    used = [0] * shards
    waiting = [(cell, 0, n, bisect_left(places, cell)) for cell, n in sorted(counts) if n]
    out = []
    while waiting:
        later = []
        for cell, start, end, at in waiting:
            while room[nodes[at % len(nodes)][1]] == 0:
                at += 1
            shard = nodes[at % len(nodes)][1]
            take = min(room[shard], end - start)
            out.append((cell, start, start + take, shard, used[shard]))
            room[shard] -= take
            used[shard] += take
            if start + take < end:
                later.append((cell, start + take, end, at + 1))
        waiting = later
    return out


def shard_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 16,
    vnodes: int = 64,
    cells: int = 16384,
    slack: float = 0.0,
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A NULL id is a key like any other; a NULL text has size 1 and the checksum of no bytes.
    Equal rows get neighbouring slots. An empty table gives an empty result."""
    if shards < 1 or vnodes < 1 or cells < 1:
        raise ValueError("shards, vnodes and cells must be positive")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    kinds = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    kinds = kinds.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(cells)).cast("int"))
    per_cell = rows.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(cells)).cast("int").alias("cell")).count()
    counts = [(r["cell"], r["count"]) for r in per_cell.collect()]  # at most `cells` rows
    ranges = allocate(counts, shards, vnodes, cells, slack)
    plan = small_table(
        docs.sparkSession,
        ranges,
        [("cell", "int"), ("from_rank", "long"), ("to_rank", "long"), ("shard", "int"), ("first_slot", "long")],
    )
    upto = F.sum("copies").over(
        Window.partitionBy("cell")
        .orderBy("doc_id", "size", "text_crc32")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = kinds.withColumn("rank_end", upto).withColumn("rank", F.col("rank_end") - F.col("copies"))
    # the plan has at most cells + vnodes * shards * passes ranges, far below any broadcast limit
    met = ranked.join(F.broadcast(plan), "cell").where("rank < to_rank AND rank_end > from_rank")
    low, high = F.greatest("rank", "from_rank"), F.least("rank_end", "to_rank")
    slots = met.withColumn("place", F.explode(F.sequence(low, high - 1)))
    return slots.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("first_slot") + F.col("place") - F.col("from_rank")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
