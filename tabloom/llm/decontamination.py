"""Benchmark decontamination by suffix arrays over the training texts.

The documents of an Arrow batch form a shard: their words as numbers, one after the other.
The shard's suffixes are sorted by their first ``window`` words, and every suffix of the
benchmark is looked up in them by binary search; the range it finds are all places of the
corpus with the same words. Suffixes that follow one another in an item and in a document
join to longest verbatim matches, kept with their places.

Only suffixes whose first words (three, or as many as a short item has) begin some benchmark
window enter the array: no other suffix can be found by the search, so nothing is lost.

The benchmark is read in blocks of at most ``block_words`` words, and each block is sent to
the tasks by broadcast, so its size is bounded. More blocks mean more passes over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import fresh, map_columns, written

BLOCK_WORDS = 1_000_000
FILTER_BITS = 22

# A-Z in lower case; everything in ASCII but letters and digits separates words
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_TABLE).split() if text else []


class Vocabulary(dict):
    """Number of each benchmark word from 1 on; 0 for all others."""

    def __missing__(self, word: bytes) -> int:
        return 0


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _rows_as_keys(matrix: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings that sort like the rows."""
    return np.ascontiguousarray(matrix.astype(">u4")).view(f"S{4 * matrix.shape[1]}").ravel()


@dataclass
class Block:
    """Items of the benchmark, bounded in words."""

    window: int
    vocabulary: Vocabulary
    items: list[str]  # item_id as text
    texts: list[np.ndarray]  # an item's words as numbers
    suffix_item: np.ndarray  # of each test suffix: item, place in it, words of its window
    suffix_at: np.ndarray
    suffix_length: np.ndarray

    @classmethod
    def of(cls, window: int, rows: list[tuple[object, list[bytes]]]) -> Block:
        vocabulary = Vocabulary()
        for _, words in rows:
            for w in words:
                if w not in vocabulary:
                    vocabulary[w] = len(vocabulary) + 1
        texts = [np.array([vocabulary[w] for w in words], np.uint32) for _, words in rows]
        places = [(i, at, min(window, len(t))) for i, t in enumerate(texts) for at in range(max(len(t) - window + 1, 1))]
        made = np.array(places, np.int64).reshape(-1, 3)
        return cls(window, vocabulary, [str(i) for i, _ in rows], texts, *made.T)

    def windows(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Distinct windows padded with 0, their lengths, and the test suffixes of each."""
        matrix = np.zeros((len(self.suffix_at), self.window), np.uint32)
        for k, (i, at, n) in enumerate(zip(self.suffix_item, self.suffix_at, self.suffix_length)):
            matrix[k, :n] = self.texts[i][at : at + n]
        unique, back = np.unique(matrix, axis=0, return_inverse=True)
        order = np.argsort(back.ravel(), kind="stable")
        cuts = np.searchsorted(back.ravel()[order], np.arange(1, len(unique)))
        return unique, (unique != 0).sum(1), np.split(order, cuts) if len(unique) else []


def benchmark_blocks(items: DataFrame, window: int, id_col: str, text_col: str, block_words: int) -> Iterator[Block]:
    """Items by blocks of about ``block_words`` words; one longer item is a block of its own.
    Items without words are left out."""
    held: list[tuple[object, list[bytes]]] = []
    size = 0
    items = items.dropDuplicates([id_col, text_col])
    for row in items.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).toLocalIterator():
        words = words_of(row[1].encode() if row[1] is not None else None)
        if not words or row[0] is None:
            continue
        if held and size + len(words) > block_words:
            yield Block.of(window, held)
            held, size = [], 0
        held.append((row[0], words))
        size += len(words)
    if held:
        yield Block.of(window, held)


class Prober:
    """Looks a block's suffixes up in the suffix arrays of shards."""

    def __init__(self, block: Block):
        self.block = block
        self.matrix, self.lengths, self.members = block.windows()
        self.lookup = block.vocabulary.__getitem__
        self.low = _rows_as_keys(self.matrix)
        above = self.matrix.copy()
        above[np.arange(len(above)), self.lengths - 1] += 1
        self.high = _rows_as_keys(above)
        self.filters = []
        for m in (1, 2, 3):
            of_size = np.minimum(self.lengths, 3) == m
            if of_size.any():
                bits = np.zeros(1 << FILTER_BITS, bool)
                bits[_hash([self.matrix[of_size, k] for k in range(m)])] = True
                self.filters.append((m, bits))

    def numbers(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The shard: words as numbers, a 0 after each text; and where each text starts."""
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
        words = np.zeros(starts[-1] + self.block.window, np.uint32)
        for at, t in zip(starts, texts):
            words[at : at + len(t)] = list(map(self.lookup, t))
        return words, starts

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the shard, distinct window) of every occurrence of a window."""
        n = len(words) - self.block.window
        chosen = np.zeros(n, bool)
        for m, bits in self.filters:
            chosen |= bits[_hash([words[k : n + k] for k in range(m)])]
        places = np.flatnonzero(chosen & (words[:n] != 0))
        if not len(places):
            return places, places
        keys = _rows_as_keys(words[places[:, None] + np.arange(self.block.window)])
        order = np.argsort(keys, kind="stable")
        keys, suffixes = keys[order], places[order]
        first, last = np.searchsorted(keys, self.low), np.searchsorted(keys, self.high)
        counts = last - first
        found = np.flatnonzero(counts)
        which = np.repeat(found, counts[found])
        inner = np.arange(len(which)) - np.repeat(np.cumsum(counts[found]) - counts[found], counts[found])
        return suffixes[np.repeat(first[found], counts[found]) + inner], which

    def longest(self, places: np.ndarray, which: np.ndarray) -> tuple[int, int, int, int]:
        """(words, item, place in item, place in shard) of the longest verbatim match that the
        hits of one document form; of equals the first item, then the first places."""
        copies = np.array([len(self.members[w]) for w in which])
        suffix = np.concatenate([self.members[w] for w in which])
        at = np.repeat(places, copies)
        item, start = self.block.suffix_item[suffix], self.block.suffix_at[suffix]
        order = np.lexsort((at, at - start, item))
        at, item, start, length = at[order], item[order], start[order], self.block.suffix_length[suffix][order]
        new = np.ones(len(at), bool)
        new[1:] = (item[1:] != item[:-1]) | (start[1:] != start[:-1] + 1) | (at[1:] != at[:-1] + 1)
        heads = np.flatnonzero(new)
        words = np.diff(np.append(heads, len(at))) - 1 + length[heads]
        best = heads[np.lexsort((at[heads], start[heads], item[heads], -words))[0]]
        return int(words.max()), int(item[best]), int(start[best]), int(at[best])


FIELDS = [
    ("n_words", T.LongType()),
    ("n_hit", T.LongType()),
    ("items", T.ArrayType(T.StringType())),
    ("covered", T.BinaryType()),
    ("longest", T.LongType()),
    ("longest_item", T.StringType()),
    ("item_start", T.LongType()),
    ("doc_start", T.LongType()),
]


def _scan(docs: DataFrame, names: list[str], text_col: str, block: Block | None, window: int) -> DataFrame:
    """One pass over the texts with one block. ``names`` are the columns of FIELDS in ``docs``;
    those that an earlier pass has filled are merged."""
    # at most block_words words, as plain values: executors have no copy of the package's classes
    plain = None if block is None else {f.name: getattr(block, f.name) for f in fields(block)} | {"vocabulary": dict(block.vocabulary)}
    shared = docs.sparkSession.sparkContext.broadcast(plain)
    again = all(n in docs.columns for n in names)

    def make():
        prober = None
        if shared.value is not None:
            prober = Prober(Block(**shared.value | {"vocabulary": Vocabulary(shared.value["vocabulary"])}))

        def work(columns: list[pa.Array]) -> list[pa.Array]:
            texts = [words_of(t) for t in columns[0].to_pylist()]
            lengths = [len(t) for t in texts]
            past = [c.to_pylist() for c in columns[1:]] if again else None
            rows = [[n, 0, [], None, 0, None, None, None] for n in lengths]
            if past:
                rows = [list(r) for r in zip(*past)]
            if prober is not None:
                words, starts = prober.numbers(texts)
                places, which = prober.hits(words)
                order = np.argsort(places, kind="stable")
                places, which = places[order], which[order]
                owner = np.searchsorted(starts, places, side="right") - 1
                cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
                for d in np.unique(owner).tolist():
                    at, w = places[cuts[d] : cuts[d + 1]], which[cuts[d] : cuts[d + 1]]
                    edges = np.zeros(lengths[d] + 1, np.int64)
                    np.add.at(edges, at - starts[d], 1)
                    np.add.at(edges, at - starts[d] + prober.lengths[w], -1)
                    covered = np.cumsum(edges[:-1]) > 0
                    if rows[d][3] is not None:
                        covered |= np.unpackbits(np.frombuffer(rows[d][3], np.uint8), count=lengths[d]).astype(bool)
                    ids = {prober.block.items[i] for x in np.unique(w) for i in prober.block.suffix_item[prober.members[x]]}
                    n, item, start, place = prober.longest(at, w)
                    row = rows[d]
                    row[1], row[2], row[3] = int(covered.sum()), sorted(ids | set(row[2])), np.packbits(covered).tobytes()
                    if n > row[4]:
                        row[4:] = [n, prober.block.items[item], start, place - int(starts[d])]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]

        return work

    utf8 = fresh(docs, "utf8")
    texts = docs.withColumn(utf8, F.col(f"`{text_col}`").cast("binary"))
    keep = [c for c in docs.columns if c not in names]
    made = [(name, kind) for name, (_, kind) in zip(names, FIELDS)]
    return map_columns(texts, [utf8, *(names if again else [])], made, make, keep=keep)


def matches(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, list[str]]:
    """The documents, all columns kept, with the columns of FIELDS appended: words, words
    inside an occurrence of a benchmark window, items found, hit words as a bit set, and the
    longest verbatim match (words, item, its place in the item and in the document).

    Also returns the names of the appended columns, which differ from FIELDS where the input
    has such a column. NULL texts have no words; NULL items and items without words match
    nothing; repeated items count once; an empty benchmark hits nothing."""
    names: list[str] = [fresh(docs, name) for name, _ in FIELDS]
    found, passes = docs, 0
    for block in benchmark_blocks(items, window, item_id, item_text, block_words):
        if passes:
            found = written(found, "decontamination")
        found = _scan(found, names, text_col, block, window)
        passes += 1
    if not passes:
        found = _scan(found, names, text_col, None, window)
    return found, names


def digest(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the longest match."""
    narrowed = docs.select(F.col("doc_id"), F.col("text"))
    found, _ = matches(narrowed, items, window)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The documents in which no benchmark window occurs, with their own columns only."""
    found, names = matches(docs, items, window)
    return found.where(F.col(names[1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
