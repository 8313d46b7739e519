"""Spelling variants: words one edit apart, by pairs of trie nodes.

A word cut anywhere is a node of the forward trie (its beginning) and a node of the trie of
reversed words (its end). Once the nodes are numbered, a pair of integers stands for the two
pieces, whatever their length:

* the pairs (node of w[:i], node of w[i:]) stand for the word itself,
* the pairs (node of w[:i], node of w[i + 1:]) stand for it with position i skipped.

Two words whose skipping pairs meet differ in that one position; a skipping pair that meets a
whole one means that the shorter word lacks that position. So the groups of equal pairs give
exactly the words one replacement, insertion or deletion apart, and no strings are compared. A
group holds at most one whole word and one word per character of the alphabet.

The tries are numbered without ever being held: words are range-partitioned and sorted; the
prefix shared with the word before is all that a word has in common with earlier ones, so
every further character opens a node. A node whose words reach over a boundary of partitions
is named after the first boundary it crosses, which follows from the lengths of the prefixes
shared across and within the partitions: two integers each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import written

LETTERS = "A-Za-zÀ-ÿ"
PART_WORDS = 100_000  # words numbered by one task, about
HELD = 200_000  # words counted in a task before they are passed on
PIECE = 1 << 20  # bytes of text searched at once
RATIO = 2  # a form is so many times as frequent as its variant


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts of about PIECE bytes that end at ASCII characters other than letters."""
    if len(text) <= PIECE:
        yield text
        return
    border, at = re.compile(rb"[\x00-@\[-`{-\x7f]"), 0
    while at < len(text):
        found = border.search(text, at + PIECE)
        end = found.end() if found else len(text)
        yield text[at:end]
        at = end


def word_counts(
    docs: DataFrame, points: int = 5, least: int = 3, drop_every: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """word, n: how often each word of at least ``points`` code points occurs in all texts, from
    ``least`` on. Words are maximal runs of LETTERS with A-Z in lower case; NULL texts have none.

    ``drop_every`` plants spelling errors: a run loses the code point h % length when that number
    divides h, the CRC-32 of ``<id>:<run>`` (a missing id is empty)."""
    lower = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
    find = f"[{LETTERS.replace('A-Z', '')}]{{{points},}}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(find).findall
        crc32 = zlib.crc32
        held: dict[str, int] = {}
        size = 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                start = crc32(f"{'' if doc is None else doc}:".encode())
                for piece in pieces(text.as_buffer().to_pybytes()):
                    for word, n in Counter(runs(piece.translate(lower).decode())).items():
                        if drop_every:
                            h = crc32(word.encode(), start)
                            if h % drop_every == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < points:
                                    continue
                        if word not in held:
                            size += 1 + len(word) // 50
                        held[word] = held.get(word, 0) + n
                if size >= HELD:
                    yield told()
                    held.clear()
                    size = 0
        if held:
            yield told()

    narrow = docs.select(F.col(f"`{id_col}`").cast("string").alias("doc"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    found = narrow.mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def trie_paths(words: list[str], part: int, carried: list[int], within: list[int]) -> list[list[int]]:
    """For each of the sorted words of a partition the numbers of the trie nodes on its path, the
    root's 0 first.

    ``carried[k]``: length of the prefix that the first word of partition k shares with the word
    before it; ``within[k]``: length of the prefix that all words of partition k share. A node
    that partition k shares with k - 1, and not k - 1 with k - 2, has the negative number of
    (k, depth); every other one has the number of (partition, place in it)."""
    before = []
    for depth in range(1, carried[part] + 1):
        first = part
        while carried[first - 1] >= depth and within[first - 1] >= depth:
            first -= 1
        before.append(-((first << 32) | depth))
    ahead = carried[part + 1] if part + 1 < len(carried) else 0
    last = words[-1]
    out: list[list[int]] = []
    path, made, own = [0], 0, len(words[0])
    for k, word in enumerate(words):
        common = shared(words[k - 1], word) if k else 0
        own = min(own, common) if k else own
        left = min(own, carried[part])
        right = min(shared(word, last), ahead) if ahead else 0
        path = path[: common + 1]
        for depth in range(common + 1, len(word) + 1):
            if depth <= left:
                path.append(before[depth - 1])
            elif depth <= right:
                path.append(-((part + 1 << 32) | depth))
            else:
                made += 1
                path.append((part + 1 << 40) | made)
        out.append(path)
    return out


def numbered(words: DataFrame, column: str, place: str, nodes: str, part_words: int = PART_WORDS) -> DataFrame:
    """The different words with ``place``, a number in their order, and ``nodes``, the numbers of the
    trie nodes of their prefixes from the empty one to the word itself."""
    parts = max(1, -(-words.count() // part_words))
    ranged = words.repartitionByRange(parts, column).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    # one row per partition from here on
    ends = ranged.groupBy("part").agg(F.min(column).alias("first"), F.max(column).alias("last"))
    ends = ends.withColumn("previous", F.lag("last").over(Window.orderBy("part")))

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame(
                {
                    "part": frame["part"],
                    "carried": [0 if p is None else shared(p, f) for p, f in zip(frame["previous"], frame["first"])],
                    "within": [shared(a, b) for a, b in zip(frame["first"], frame["last"])],
                }
            )

    met = sorted(ends.mapInPandas(measure, "part int, carried int, within int").collect())
    rank = {row["part"]: k for k, row in enumerate(met)}
    carried, within = [row["carried"] for row in met], [row["within"] for row in met]

    def number(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(column, ignore_index=True)
        part = rank[key[0]]
        frame[place] = np.arange(len(frame), dtype=np.int64) + (part << 40)
        frame[nodes] = trie_paths(frame[column].tolist(), part, carried, within)
        return frame.drop(columns="part")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields)
    return ranged.groupBy("part").applyInPandas(number, f"{schema}, `{place}` long, `{nodes}` array<long>")


def dictionary(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """word, n, no, prefixes, suffixes: ``no`` numbers the words in code-point order; the nodes of
    w[:i] and w[i:] are prefixes[i] and suffixes[length - i]."""
    forward = written(numbered(words.select("word", "n"), "word", "no", "prefixes", part_words), "prefixes")
    turned = numbered(forward.select("no", F.reverse("word").alias("turned")), "turned", "back", "suffixes", part_words)
    return forward.join(turned.select("no", "suffixes"), "no")


def pairs(entries: DataFrame) -> DataFrame:
    """prefix, suffix, whole, first, no, n: the pairs of a word cut at every place and with every
    position skipped; ``first`` marks the first of equal neighbouring characters, as skipping
    any of them leaves the same word."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, no, n = (batch.column(k).to_pylist() for k in range(3))
            held = [[], [], [], []]
            times = []
            for k, text in enumerate(word):
                ahead = batch.column(3)[k].values.to_numpy()
                behind = batch.column(4)[k].values.to_numpy()[::-1]
                codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                length = len(codes)
                new = np.ones(length, bool)
                new[1:] = codes[1:] != codes[:-1]
                held[0] += [ahead, ahead[:-1]]
                held[1] += [behind, behind[1:]]
                held[2].append(np.arange(2 * length + 1) <= length)
                held[3] += [np.ones(length + 1, bool), new]
                times.append(2 * length + 1)
            if times:
                columns = [*map(np.concatenate, held), np.repeat(no, times), np.repeat(n, times)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["prefix", "suffix", "whole", "first", "no", "n"])

    rows = entries.select("word", "no", "n", "prefixes", "suffixes")
    return rows.mapInArrow(make, "prefix long, suffix long, whole boolean, first boolean, no long, n long")


def near_words(entries: DataFrame) -> DataFrame:
    """no, n_near, best: of every word with others one edit away how many they are, and as a struct
    the most frequent of them (n, back), ``back`` being its negative number."""
    own = F.struct("whole", "first", "no", "n")
    met = pairs(entries).groupBy("prefix", "suffix").agg(F.collect_list(own).alias("met")).where(F.size("met") > 1)

    def links(x: Column) -> Column:
        one = F.col("own")
        return (x["no"] != one["no"]) & F.when(x["whole"], one["first"]).when(one["whole"], x["first"]).otherwise(True)

    each = met.select(F.explode("met").alias("own"), "met").select("own", F.filter("met", links).alias("near"))
    best = F.array_max(F.transform("near", lambda x: F.struct(x["n"].alias("n"), (-x["no"]).alias("back"))))
    found = each.where(F.size("near") > 0).select(F.col("own.no").alias("no"), F.size("near").alias("k"), best.alias("best"))
    return found.groupBy("no").agg(F.sum("k").alias("n_near"), F.max("best").alias("best"))


def _ends(pointers: DataFrame) -> DataFrame:
    """no, root: the ends of chains of pointers (no, root), followed by doubling."""
    to = written(pointers, "pointers")
    while True:
        ahead = to.select(F.col("no").alias("root"), F.col("root").alias("further"))
        step = written(to.join(ahead, "root", "left").select("no", "root", "further"), "pointers")
        to = step.select("no", F.coalesce("further", "root").alias("root"))
        if step.where("further IS NOT NULL").isEmpty():
            return to


def variants(words: DataFrame, ratio: int = RATIO, part_words: int = PART_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of words (word, n), whose words are
    different.

    ``n_near`` counts the words one inserted, deleted or replaced code point away. ``form`` is the
    most frequent of them, of equal ones the first in code-point order, if it is at least
    ``ratio`` (more than 1) times as frequent as the word; ``root`` is where the forms lead.
    An empty table gives no rows."""
    entries = written(dictionary(words, part_words), "dictionary")
    found = written(near_words(entries), "near")
    known = entries.select("no", "word", "n").join(found, "no", "left")
    known = known.withColumn("form", F.when(F.col("best.n") >= ratio * F.col("n"), F.struct((-F.col("best.back")).alias("no"), F.col("best.n").alias("n"))))
    known = written(known.select("no", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form"), "known")
    roots = _ends(known.where("form IS NOT NULL").select("no", F.col("form.no").alias("root")))
    # written, so that the joins with names are plain shuffles, whose hot keys can be split
    rows = written(known.join(roots, "no", "left").select("word", "n", "n_near", F.col("form.no").alias("form_no"), F.col("form.n").alias("form_n"), "root"), "chains")
    forms = entries.select(F.col("no").alias("form_no"), F.col("word").alias("form"))
    ends = entries.select(F.col("no").alias("root"), F.col("word").alias("end"))
    changed = rows.where("root IS NOT NULL").join(forms, "form_no").join(ends, "root")
    changed = changed.select("word", "form", F.col("end").alias("root"), "n", "n_near", "form_n")
    plain = rows.where("root IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return changed.unionByName(plain)


def variants_of_texts(docs: DataFrame, points: int = 5, least: int = 3, drop_every: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``variants`` of the ``word_counts`` of all texts."""
    return variants(written(word_counts(docs, points, least, drop_every, id_col, text_col), "words"))
