"""Best-fit packing of tokenised documents into sequences of bounded length.

Large pieces (above a third of the capacity) are matched first: sizes go from the largest
down, each takes the largest remaining large piece that still fits beside it, so a sequence
holds two of them at most. Smaller pieces then go, largest first, to the fullest sequence
with room (best fit); new sequences open when none has room.

The plan is made on the histogram of lengths, at most ``capacity`` numbers whatever the data:
sequences with equal contents are one run, "these ranks of this length go to these sequences".
The pieces are ranked within their length in two steps (counts per length and bucket, then
ranks in a bucket), so that one frequent length is no single task, and joined with the plan.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import map_columns, small_table, worker_store, written

# what a worker keeps at most of encoded words and of encoded roots; beyond it, a cache starts anew
CACHED_WORDS = 600_000
CACHED_ROOTS = 800_000
TOGETHER = 128  # roots encoded by one call
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # of ASCII, without the apostrophe
LATIN = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"  # letters of ASCII and Latin-1


class WordIds(dict):
    """Word -> its token ids as little-endian 32-bit numbers.

    White space always separates tokens of this vocabulary, so a text's ids are those of its
    words. A word of a root, which is a run of letters, and a tail of marks has the ids of both: the
    vocabulary's pattern cuts between them. Words share the encoding of the lower-case root. A root's last
    token, and no other, closes a word: new roots are encoded together and cut at the closing tokens.
    Normalisation leaves lower-case Latin letters as they are and the pattern takes a run of them whole,
    so roots go to the bare model. Other words, and all words of a vocabulary of which this does not
    hold, are encoded one by one."""

    def __init__(self, model):
        super().__init__()
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = model
        self.bare = Tokenizer(model.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocab = model.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.latin = re.compile(LATIN).fullmatch
        self.roots: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {}
        upper = "".join(chr(c) for c in [*range(0x41, 0x5B), *range(0xC0, 0xDF)] if c != 0xD7)
        alone = np.array(self.bare.encode(upper.lower(), add_special_tokens=False).ids, "<u4").tobytes()
        self.parted = self.encode(upper.encode() + MARKS) == alone + self.encode(MARKS)

    def encode(self, text: bytes) -> bytes:
        ids = self.model.encode(text.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, words: Iterable[bytes]) -> None:
        """Make sure that all the words are there."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHED_WORDS:
            self.clear()
            new = words
        if len(self.roots) > CACHED_ROOTS:
            self.roots.clear()
        if len(self.tails) > CACHED_WORDS:
            self.tails.clear()
        if not self.parted:
            self.update((word, self.encode(word)) for word in new)
            return
        latin, tails = self.latin, self.tails
        of_parts: tuple[list[bytes], list[bytes], list[bytes]] = ([], [], [])
        add_word, add_root, add_tail = (part.append for part in of_parts)
        for word in new:
            root = word.rstrip(MARKS)
            tail = word[len(root) :]
            if root.isalpha():  # ASCII letters
                root = root.lower()
            elif latin(root):
                root = root.decode().lower().encode()
            else:
                self[word] = self.encode(word)
                continue
            if tail not in tails:
                tails[tail] = self.encode(tail)
            add_word(word)
            add_root(root)
            add_tail(tail)
        same, roots_of, tails_of = of_parts
        self.learn_roots(list(set(roots_of).difference(self.roots)))
        self.update(zip(same, map(add, map(self.roots.__getitem__, roots_of), map(tails.__getitem__, tails_of))))

    def learn_roots(self, unknown: list[bytes]) -> None:
        groups = [unknown[at : at + TOGETHER] for at in range(0, len(unknown), TOGETHER)]
        for group in groups:
            made = self.bare.encode_batch_fast([b" ".join(group).decode()], add_special_tokens=False)[0]
            ids = np.array(made.ids, "<u4")
            ends = (4 * np.flatnonzero(self.closes[ids]) + 4).tolist()
            if len(ends) != len(group):
                self.roots.update((root, self.encode(root)) for root in group)
            else:
                packed = ids.tobytes()
                self.roots.update((root, packed[start:end]) for root, start, end in zip(group, [0, *ends], ends))

    def of_texts(self, texts: pa.Array) -> tuple[memoryview, list[int]]:
        """The ids of all the texts behind one another, and the bytes at which each text's begin, and the end.
        A word that the batch repeats is looked up once."""
        if not len(texts):
            return memoryview(b""), [0]
        words = pc.ascii_split_whitespace(texts.cast(pa.binary()).fill_null(b"").cast(pa.string(), safe=False))
        ends = words.offsets.to_numpy()
        coded = words.values.dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        self.learn(distinct)
        ids = pa.array(list(map(self.__getitem__, distinct)), pa.large_binary()).take(coded.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)
        data = ids.buffers()[2]
        return memoryview(data if data is not None else b""), at[ends].tolist()


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents as token ids closed by ``end_id``, cut into
    pieces of ``capacity`` tokens where longer. A NULL text is an empty one: one piece of one token."""
    with open(tokenizer, encoding="utf-8") as f:
        source = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(source)  # one vocabulary file
    name = ("word ids", zlib.crc32(source.encode()))
    piece = T.StructType(
        [
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )
    kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
    closing = end_id.to_bytes(4, "little")

    def make():
        store = worker_store()
        if name not in store:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            store[name] = WordIds(Tokenizer.from_str(shared.value))
        known = store[name]

        def work(columns: list[pa.Array]) -> list[pa.Array]:
            out = []
            packed, ends = known.of_texts(columns[0])
            for start, end in zip(ends, ends[1:]):
                ids = bytes(packed[start:end]) + closing
                n, view = len(ids) // 4, memoryview(ids)
                out.append(
                    [
                        {"piece": k, "start": at, "length": min(capacity, n - at), "ids_crc32": zlib.crc32(view[4 * at : 4 * (at + capacity)])}
                        for k, at in enumerate(range(0, n, capacity))
                    ]
                )
            return [pa.array(out, kind)]

        return work

    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    made = map_columns(texts, ["text"], [("pieces", T.ArrayType(piece))], make, keep=["doc_id"], needed=name)
    return made.select("doc_id", F.inline("pieces"))


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, from rank, to rank, first sequence, pieces of the run per sequence, offset).

    counts: pieces per length, each from 1 to capacity."""
    if any(not 1 <= s <= capacity for s in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    left = {s: n for s, n in counts.items() if n}
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted; bins[g]: runs (first sequence, sequences) with g tokens free
    bins: dict[int, list[tuple[int, int]]] = {}
    opened = 0

    def leave(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in bins:
                insort(gaps, gap)
                bins[gap] = []
            bins[gap].append((first, n))

    def put(size: int, n: int, first: int, per_bin: int, offset: int) -> None:
        runs.append((size, rank[size], rank[size] + n, first, per_bin, offset))
        rank[size] += n
        left[size] -= n

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        size = large[-1]
        if not left[size]:
            large.pop()
            continue
        at = bisect_left(large, capacity - size + 1) - 1
        while at >= 0 and (left[large[at]] == 0 or (large[at] == size and left[size] < 2)):
            at -= 1
        if at < 0:
            n = left[size]
            put(size, n, opened, 1, 0)
            leave(capacity - size, opened, n)
        elif large[at] == size:
            n = left[size] // 2
            put(size, 2 * n, opened, 2, 0)
            leave(capacity - 2 * size, opened, n)
        else:
            other = large[at]
            n = min(left[size], left[other])
            put(size, n, opened, 1, 0)
            put(other, n, opened, 1, size)
            leave(capacity - size - other, opened, n)
        opened += n

    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect_left(gaps, size)
            if at == len(gaps):
                n = -(-left[size] // (capacity // size))
                leave(capacity, opened, n)
                opened += n
                continue
            gap = gaps[at]
            first, n = bins[gap].pop()
            if not bins[gap]:
                del bins[gap], gaps[at]
            fit = gap // size
            whole, rest = divmod(min(left[size], n * fit), fit)
            put(size, whole * fit + rest, first, fit, capacity - gap)
            leave(gap - fit * size, first, whole)
            if rest:
                leave(gap - rest * size, first + whole, 1)
            used = whole + (rest > 0)
            leave(gap, first + used, n - used)
    return runs


def pack(pieces: DataFrame, capacity: int = 2048, buckets: int | None = None) -> DataFrame:
    """The pieces with sequence_id and offset. Equal rows take neighbouring ranks."""
    spark = pieces.sparkSession
    n_buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = pieces.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    kinds = kinds.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_buckets)).cast("int"))
    sums = kinds.groupBy("length", "bucket").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = packing_plan(counts, capacity)  # from at most `capacity` counts
    plan = small_table(
        spark,
        runs,
        [("length", "long"), ("from_rank", "long"), ("to_rank", "long"), ("first_bin", "long"), ("per_bin", "long"), ("at", "long")],
    )
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    upto = F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = (
        kinds.withColumn("upto", upto)
        .join(firsts, ["length", "bucket"])
        .withColumn("end", F.col("first") + F.col("upto"))
        .withColumn("begin", F.col("end") - F.col("copies"))
    )
    # the plan's size depends on the capacity alone: a few runs for each length
    met = ranked.join(F.broadcast(plan), "length").where("begin < to_rank AND end > from_rank")
    low, high = F.greatest("begin", "from_rank"), F.least("end", "to_rank")
    placed = met.withColumn("place", F.explode(F.sequence(low - F.col("from_rank"), high - F.col("from_rank") - 1)))
    return placed.select(
        *columns,
        F.expr("first_bin + place div per_bin").alias("sequence_id"),
        F.expr("at + (place % per_bin) * length").alias("offset"),
    )


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokenise, cut and pack. The pieces (no texts) are written once to the shared folder,
    since the plan needs their lengths before they can be placed. An empty table packs to none."""
    return pack(written(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces"), capacity)
