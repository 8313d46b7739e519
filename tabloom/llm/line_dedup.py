"""Line deduplication by a segment-partition edit join.

Lines are compared as UTF-8 bytes. Two lines link when their edit distance is at most
``min(edits, length of the shorter // bytes_per_edit)``; equal lines are one. A line that may
differ by t edits is cut into t + 1 segments: whatever those edits are, one segment stays
whole, and it lies in the other line within a window of places that depends on the segment's
number and the difference in length. So each line lists its segments under (length, number,
content), and probes the lists of its own and smaller lengths with the substrings of those
windows. Lines that meet under a key are verified by a banded bit-parallel edit distance,
computed for many pairs at once. Linked lines form classes; the first line of a class in
order of document and line number stands for it.

Keys travel as numbers, dealt to cells by hash; texts follow only for lines that met another
one. A task enumerates the pairs of a key by blocks, returns a spanning forest of the links,
and never a list of pairs. Keys under which very many lines meet are split into blocks of
lines, so that no task holds more than two blocks. Line numbers are 64-bit hashes: two lines
of a corpus of n lines are confused with a probability of about n * n / 2 ** 65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import fresh, map_columns, tidy, worker_store, written
from tabloom.llm.components import components, forest

EDITS = 2
BYTES_PER_EDIT = 10
CELL_KEYS = 1_000_000  # keys of one cell, about
MET_ROWS = 30_000  # lines verified by one task, about
BLOCK = 2048  # lines of a split key in one block
PAIRS = 200_000  # pairs enumerated at once
CHARACTERS = 2_000_000  # compared at once
LONG = 500_000  # bytes of a line that is compared by itself
STRETCH = 1 << 16  # bytes of a long line looked at together
PLANS = 5_000  # lengths whose keys a worker remembers


def lines_of(text: bytes | None) -> list[tuple[int, bytes]]:
    """(number from 0, line) of the lines that hold more than white space."""
    return [(k, line) for k, line in enumerate(text.split(b"\n")) if line and not line.isspace()] if text else []


def line_id(line: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(line)


def allowed(length: int, edits: int = EDITS, bytes_per_edit: int = BYTES_PER_EDIT) -> int:
    return min(edits, length // bytes_per_edit)


def key_plan(length: int, edits: int, bytes_per_edit: int) -> tuple[list[tuple[slice, int]], int]:
    """Slices of a line of this length with the seeds of their keys: first the segments it
    lists, then the substrings it probes with; and the number of the former."""

    def segments(n: int, t: int) -> list[tuple[int, int]]:
        short, longer = divmod(n, t + 1)
        sizes = [short] * (t + 1 - longer) + [short + 1] * longer
        return [(sum(sizes[:i]), size) for i, size in enumerate(sizes)]

    def seed(n: int, number: int) -> int:
        return n * 32 + number

    t = allowed(length, edits, bytes_per_edit)
    listed = [(slice(at, at + size), seed(length, i)) for i, (at, size) in enumerate(segments(length, t))] if t else []
    probes = []
    for n in range(max(1, length - edits), length + 1):
        t, more = allowed(n, edits, bytes_per_edit), length - n
        if not t or more > t:
            continue
        for i, (at, size) in enumerate(segments(n, t)):
            low = max(0, at - i, at + more - (t - i))
            high = min(length - size, at + i, at + more + (t - i))
            probes += [(slice(k, k + size), seed(n, i)) for k in range(low, high + 1)]
    return listed + probes, len(listed)


def banded(flat: np.ndarray, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, band: int) -> np.ndarray:
    """Edit distances of the pairs (flat[a : a + la], flat[b : b + lb]), band + 1 for larger
    ones; 0 <= lb - la <= band.

    One column of the dynamic programme is a band of 2 * band + 1 rows around the diagonal,
    held as bit vectors of vertical differences (+1 and -1) in one number per pair. The value
    on the band's lowest diagonal is carried along; at the last column the differences lead
    from it to the wanted row."""
    out = np.full(len(a), band + 1, np.int64)
    live = np.argsort(-lb, kind="stable")
    full, top = np.int64((1 << (2 * band + 1)) - 1), np.int64(1 << (2 * band))
    plus = np.full(len(a), ((1 << (band + 1)) - 1) << band, np.int64)
    minus = np.zeros(len(a), np.int64)
    score = np.full(len(a), band, np.int64)
    empty = live[lb[live] == 0]
    out[empty] = 0
    live = live[lb[live] > 0]
    plus, minus, score = plus[: len(live)], minus[: len(live)], score[: len(live)]
    column = 0
    while len(live):
        x = flat[b[live] + column]
        match = np.zeros(len(live), np.int64)
        for bit in range(2 * band + 1):
            row = column - band + bit
            if row >= 0:
                inside = row < la[live]
                match |= ((flat[np.where(inside, a[live] + row, 0)] == x) & inside).astype(np.int64) << bit
        diagonal = ((((match & plus) + plus) ^ plus) | match | minus) & full
        right_plus = (minus | ~(diagonal | plus)) & full
        right_minus = diagonal & plus
        score = score + ((diagonal & top) == 0)
        plus = (right_minus | ~((diagonal >> 1) | right_plus)) & full
        minus = (diagonal >> 1) & right_plus
        column += 1
        more = lb[live] - la[live]
        done = lb[live] == column
        if done.any():
            # rows below the wanted one: differences of bits band - more .. 2 * band - 1
            mask = ((np.int64(1) << (2 * band)) - 1) & ~((np.int64(1) << (band - more[done])) - 1)
            value = score[done] - np.bitwise_count(plus[done] & mask) + np.bitwise_count(minus[done] & mask)
            out[live[done]] = np.minimum(value, band + 1)
        # the lowest diagonal never falls, and it is above the result by band + more at most
        stay = ~done & (score <= 2 * band + more)
        if not stay.all():
            live, plus, minus, score = live[stay], plus[stay], minus[stay], score[stay]
    return out


def common_start(a: memoryview, b: memoryview, i: int, j: int) -> int:
    """How many bytes a[i:] and b[j:] begin with in common."""
    most, n = min(len(a) - i, len(b) - j), 0
    while n < most:
        size = min(STRETCH, most - n)
        differ = np.frombuffer(a[i + n : i + n + size], np.uint8) != np.frombuffer(b[j + n : j + n + size], np.uint8)
        if differ.any():
            return n + int(differ.argmax())
        n += size
    return n


def long_distance(a: bytes, b: bytes, most: int) -> int:
    """Edit distance of two long lines, most + 1 if it is larger: how far each diagonal gets with no,
    one, two, ... edits, equal stretches being skipped. Takes no memory beside the lines."""
    a, b = memoryview(a), memoryview(b)
    goal = len(b) - len(a)
    reach: dict[int, int] = {}
    for edits in range(most + 1):
        new = {}
        for d in range(-edits, edits + 1):
            ways = [reach[d] + 1] if d in reach else []  # a replaced byte
            if d + 1 in reach:
                ways.append(reach[d + 1] + 1)  # a byte of a left out
            if d - 1 in reach:
                ways.append(reach[d - 1])  # a byte of b put in
            i = min(max(ways, default=0), len(a), len(b) - d)
            if i < 0 or i + d < 0 or (edits and not ways):
                continue
            new[d] = i + common_start(a, b, i, i + d)
            if d == goal and new[d] == len(a):
                return edits
        reach = new
    return most + 1


def close_pairs(lines: list[bytes], a: np.ndarray, b: np.ndarray, limit: np.ndarray, band: int) -> np.ndarray:
    """True for the pairs of line numbers (a not longer than b) whose distance is within the
    limit. Common beginnings and ends are cut off first."""
    flat = np.frombuffer(b"".join(lines) + b"\0", np.uint8)
    lengths = np.array([len(x) for x in lines], np.int64)
    starts = np.cumsum(lengths) - lengths
    out = np.zeros(len(a), bool)
    order = np.argsort(lengths[a], kind="stable")
    while len(order) and lengths[a[order[-1]]] > LONG:
        k = order[-1]
        out[k] = long_distance(lines[a[k]], lines[b[k]], int(limit[k])) <= limit[k]
        order = order[:-1]
    low = 0
    while low < len(order):
        rows = max(1, CHARACTERS // max(1, int(lengths[a[order[min(low + 1000, len(order) - 1)]]])))
        some = order[low : low + rows]
        while len(some) > 1 and len(some) * int(lengths[a[some[-1]]]) > 2 * CHARACTERS:
            some = some[: len(some) // 2]
        low += len(some)
        la, lb, sa, sb = lengths[a[some]], lengths[b[some]], starts[a[some]], starts[b[some]]
        places = np.arange(int(la.max()) + 1)
        end = places >= la[:, None]
        last = len(flat) - 1
        ahead = (flat[np.minimum(sa[:, None] + places, last)] != flat[np.minimum(sb[:, None] + places, last)]) | end
        begin = ahead.argmax(1)
        back = (flat[np.maximum((sa + la - 1)[:, None] - places, 0)] != flat[np.maximum((sb + lb - 1)[:, None] - places, 0)]) | end
        tail = np.minimum(back.argmax(1), la - begin)
        distance = banded(flat, sa + begin, la - begin - tail, sb + begin, lb - begin - tail, band)
        out[some] = distance <= limit[some]
    return out


def _mixed(key: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    x = key ^ ((i.astype(np.uint64) << np.uint64(32)) | j.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def met_keys(keys: np.ndarray, ids: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(task, line, whether it probes) of the lines that share a key with another line; of a
    key with many lines, one task per pair of blocks."""
    order = np.argsort(keys, kind="stable")
    keys, ids, probe = keys[order], ids[order], probe[order]
    twice = np.zeros(len(keys), bool)
    twice[1:] = keys[1:] == keys[:-1]
    twice[:-1] |= twice[1:]
    keys, ids, probe = keys[twice], ids[twice], probe[twice]
    if not len(keys):
        return keys, ids, probe
    order = np.lexsort((ids, probe, keys))
    keys, ids, probe = keys[order], ids[order], probe[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]) | (probe[1:] != probe[:-1])
    keys, ids, probe = keys[new], ids[new], probe[new]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(heads, len(keys)))
    probing = np.add.reduceat(probe.astype(np.int64), heads)
    listing = sizes - probing
    least, most = np.minimum.reduceat(ids, heads), np.maximum.reduceat(ids, heads)
    good = (probing > 0) & (listing > 0) & (least != most)
    group = np.repeat(np.arange(len(heads)), sizes)
    keep = good[group]
    place = np.arange(len(keys)) - heads[group]
    place = np.where(probe, place - listing[group], place)[keep]
    group, keys, ids, probe = group[keep], keys[keep], ids[keep], probe[keep]
    blocks_listing, blocks_probing = -(-listing // BLOCK), -(-probing // BLOCK)
    times = np.where(probe, blocks_listing[group], blocks_probing[group])
    other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    own, probe, ids, keys = (np.repeat(x, times) for x in (place // BLOCK, probe, ids, keys))
    split = np.repeat((blocks_listing * blocks_probing)[group] > 1, times)
    task = np.where(split, _mixed(keys, np.where(probe, other, own), np.where(probe, own, other)), keys)
    return task, ids, probe


def verified(task: np.ndarray, probe: np.ndarray, ids: np.ndarray, lines: list[bytes], edits: int, bytes_per_edit: int):
    """Links of the lines that meet in the tasks, as a forest of (line, smaller line)."""
    order = np.lexsort((ids, probe, task))
    new = np.ones(len(order), bool)
    t, p, i = task[order], probe[order], ids[order]
    new[1:] = (t[1:] != t[:-1]) | (p[1:] != p[:-1]) | (i[1:] != i[:-1])
    order = order[new]
    t, p, i = task[order], probe[order], ids[order]
    lengths = np.array([len(lines[k]) for k in order], np.int64)
    heads = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    sizes = np.diff(np.append(heads, len(t)))
    probing = np.add.reduceat(p.astype(np.int64), heads)
    listing = sizes - probing
    ends = np.cumsum(listing * probing)
    found_a, found_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for low in range(0, int(ends[-1]), PAIRS):
        number = np.arange(low, min(low + PAIRS, int(ends[-1])))
        g = np.searchsorted(ends, number, side="right")
        k = number - (ends[g] - listing[g] * probing[g])
        a, b = heads[g] + k // probing[g], heads[g] + listing[g] + k % probing[g]
        more = lengths[b] - lengths[a]
        limit = np.minimum(edits, lengths[a] // bytes_per_edit)
        good = (i[a] != i[b]) & (more >= 0) & (more <= limit) & ((more > 0) | (i[a] < i[b]))
        a, b, limit = a[good], b[good], limit[good]
        if len(a):
            used, back = np.unique(np.concatenate([a, b]), return_inverse=True)
            texts = [lines[order[k]] for k in used]
            near = close_pairs(texts, back[: len(a)], back[len(a) :], limit, edits)
            x, y = forest(i[a[near]], i[b[near]])
            found_a.append(x)
            found_b.append(y)
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def texts(docs: DataFrame, text_col: str) -> DataFrame:
    """id, line: the different lines of each batch of documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            lines = list({line for t in batch.column(0).to_pylist() for _, line in lines_of(t)})
            ids = np.array([line_id(x) for x in lines], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lines, pa.binary())], names=["id", "line"])

    return docs.select(F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(work, "id long, line binary")


def places(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """doc_id, line_no, id of every line, and the row_key of its document if there is one."""
    own = [] if row_col is None else [F.col(f"`{row_col}`").alias("row_key")]
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *own, F.col(f"`{text_col}`").cast("binary").alias("text"))
    kind = T.ArrayType(T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("id", T.LongType())]))

    def make():
        def work(columns: list[pa.Array]) -> list[pa.Array]:
            found = [lines_of(t) for t in columns[0].to_pylist()]
            numbers = pa.array([k for f in found for k, _ in f], pa.int32())
            ids = pa.array(np.array([line_id(x) for f in found for _, x in f], np.uint64).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            rows = pa.StructArray.from_arrays([numbers, ids], ["line_no", "id"])
            return [pa.ListArray.from_arrays(pa.array(offsets), rows)]

        return work

    kept = narrow.columns[:-1]
    return map_columns(narrow, ["text"], [("lines", kind)], make, keep=kept).select(*kept, F.inline("lines"))


def links(docs: DataFrame, lines: int, text_col: str, edits: int, bytes_per_edit: int) -> DataFrame:
    """(a, b): line ids linked by the join, with the components of all links. ``lines``: how many
    lines there are, which sets the number of cells."""
    spark = docs.sparkSession
    per_line = (edits + 1) * (edits + 3)  # keys of a long line, about
    cells = 64
    while lines * per_line > cells * CELL_KEYS:
        cells *= 2

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest, known = xxhash.xxh64_intdigest, ("key plans", edits, bytes_per_edit)
        tidy(known)
        plans = worker_store().setdefault(known, {})
        for batch in batches:
            keys: list[int] = []
            ids, counts, probing = [], [], []
            for line in {line for t in batch.column(0).to_pylist() for _, line in lines_of(t)}:
                if len(line) not in plans:
                    if len(plans) >= PLANS:
                        plans.clear()
                    plans[len(line)] = key_plan(len(line), edits, bytes_per_edit)
                plan, listed = plans[len(line)]
                if plan:
                    keys += [digest(line[part], seed) for part, seed in plan]
                    ids.append(line_id(line))
                    counts.append(len(plan))
                    probing.append(listed)
            if not keys:
                continue
            key, n = np.array(keys, np.uint64), np.array(counts)
            place = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
            probe = place >= np.repeat(np.array(probing), n)
            cell = (key % np.uint64(cells)).astype(np.int32)
            order = np.argsort(cell, kind="stable")
            cell, key, probe, own = cell[order], key[order], probe[order], np.repeat(np.array(ids, np.uint64), n)[order]
            heads = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            blobs = [[part.tobytes() for part in np.split(x, heads[1:])] for x in (key, own, probe)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell[heads]), *[pa.array(x, pa.binary()) for x in blobs]], names=["cell", "keys", "ids", "probe"]
            )

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        tidy()
        keys, ids = (np.frombuffer(b"".join(frame[c]), np.uint64) for c in ("keys", "ids"))
        task, line, probe = met_keys(keys, ids, np.frombuffer(b"".join(frame["probe"]), bool))
        return pd.DataFrame({"task": task.view(np.int64), "id": line.view(np.int64), "probe": probe})

    sent = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(entries, "cell int, keys binary, ids binary, probe binary")
    met = written(sent.repartition(cells, "cell").groupBy("cell").applyInPandas(meet, "task long, id long, probe boolean"), "met")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-met.count() // MET_ROWS), 100_000))

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        tidy()
        a, b = verified(
            frame["task"].to_numpy(np.int64).view(np.uint64), frame["probe"].to_numpy(bool), frame["id"].to_numpy(np.int64).view(np.uint64),
            [bytes(x) for x in frame["line"]], edits, bytes_per_edit,
        )
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    asked = met.groupBy("id").agg(F.collect_list(F.struct("task", "probe")).alias("asked"))
    told = texts(docs, text_col).join(asked, "id")
    rows = told.select("id", "line", F.explode("asked").alias("q")).select("q.task", "q.probe", "id", "line")
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("task"), F.lit(parts)).cast("int")).repartition(parts, "cell")
    return rows.groupBy("cell").applyInPandas(verify, "a long, b long")


def _with_first(docs: DataFrame, edits: int, bytes_per_edit: int, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """The place of every line and, as a struct, the first place of its class: doc_id, line_no
    and, as the last to decide, row_key."""
    if not 0 <= edits <= 15 or bytes_per_edit <= edits:
        raise ValueError("edits must lie between 0 and 15 and be fewer than bytes_per_edit")
    found = written(places(docs, id_col, text_col, row_col), "lines")
    place = ["doc_id", "line_no", *([] if row_col is None else ["row_key"])]
    roots = components(links(docs, found.count(), text_col, edits, bytes_per_edit)).withColumnRenamed("node", "id")
    named = found.join(roots, "id", "left").select(*place, F.coalesce("root", "id").alias("class"))
    named = written(named, "named")
    # written, so that both sides of the join are plain shuffles, whose hot keys can be split
    first = written(named.groupBy("class").agg(F.min(F.struct(*place)).alias("first")), "first")
    return named.join(first, "class").select(*place, "first")


def classes(
    docs: DataFrame, edits: int = EDITS, bytes_per_edit: int = BYTES_PER_EDIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, line_no (from 0), class_doc_id, class_line_no, kept: every line that is not blank,
    with the first line of its class in order of doc_id and line_no; kept marks those.

    NULL and empty texts have no lines; a NULL id comes first. Rows that repeat a doc_id count
    as the same document, and all copies of a class's first line are kept."""
    out = _with_first(docs, edits, bytes_per_edit, id_col, text_col).select(
        "doc_id", "line_no", F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no")
    )
    same = F.col("doc_id").eqNullSafe(F.col("class_doc_id")) & (F.col("line_no") == F.col("class_line_no"))
    return out.withColumn("kept", same)


def without_repeats(
    docs: DataFrame, edits: int = EDITS, bytes_per_edit: int = BYTES_PER_EDIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents without the lines that repeat an earlier one; all columns kept. Documents
    that lose their last line that is not blank go; those that had none stay as they are.

    A document is its id and its text, known by a 64-bit hash: rows without id and different
    texts under one id lose only lines of their own; rows equal in both are treated alike."""
    row_col = fresh(docs, "row_key")
    own_id, own_row, lost_lines = fresh(docs, "lost_id"), fresh(docs, "lost_row"), fresh(docs, "lost_lines")
    keyed = docs.withColumn(row_col, F.xxhash64(F.col(f"`{text_col}`")))
    found = _with_first(keyed, edits, bytes_per_edit, id_col, text_col, row_col)
    repeats = found.where(~F.struct("doc_id", "line_no", "row_key").eqNullSafe(F.col("first")))
    gone = repeats.groupBy(F.col("doc_id").alias(own_id), F.col("row_key").alias(own_row)).agg(F.collect_set("line_no").alias(lost_lines))
    met = keyed.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(own_id)) & (F.col(row_col) == F.col(own_row)), "left")
    kept, left = fresh(docs, "kept_text"), fresh(docs, "left_over")

    def make():
        def work(columns: list[pa.Array]) -> list[pa.Array]:
            out, stays = [], []
            for text, drop in zip(*(c.to_pylist() for c in columns)):
                if text is not None and drop:
                    lost = set(drop)
                    lines = [x for k, x in enumerate(text.split(b"\n")) if k not in lost]
                    text = b"\n".join(lines)
                    stays.append(any(x and not x.isspace() for x in lines))
                else:
                    stays.append(True)
                out.append(None if text is None else text.decode())
            return [pa.array(out, pa.string()), pa.array(stays)]

        return work

    utf8 = fresh(docs, "utf8")
    rows = met.withColumn(utf8, F.col(f"`{text_col}`").cast("binary"))
    others = [c for c in docs.columns if c != text_col]
    made = map_columns(rows, [utf8, lost_lines], [(kept, T.StringType()), (left, T.BooleanType())], make, keep=others)
    return made.where(F.col(left)).select(*[F.col(kept).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
