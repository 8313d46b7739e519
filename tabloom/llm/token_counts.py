"""Token counts that follow edits.

A document's text is cut into pre-tokens by the vocabulary's pattern; its count is the sum of
theirs. A segment tree over the pre-tokens, kept as flat arrays, holds characters and tokens
of every subtree. An edit finds the leaves it touches by descending through the character
sums, reads the text again from a little before it until the cuts fall together with the old
ones, encodes the pre-tokens of that stretch only, and renews the sums above the leaves. A
leaf whose stretch changed holds the sum of its new pre-tokens; the others keep theirs.

The pattern looks ahead only: a pre-token depends on its own characters and on a few behind
it (``CONTEXT``). So reading may start at any old cut that is so far before the edit, and once
a new cut behind the edit falls on an old one, all later cuts are the old ones.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm import pii
from tabloom.llm.common import map_columns, worker_store

CONTEXT = 4
CACHED_PIECES = 250_000  # in a worker; beyond it the cache starts anew


class PieceCounts(dict):
    """Pre-token -> its number of tokens."""

    def __init__(self, ranks: bytes, pattern: str):
        super().__init__()
        import regex
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        self.encoding = tiktoken.Encoding(
            "own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={}
        )
        self.pattern = regex.compile(pattern)

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHED_PIECES:
            self.clear()
        n = self[piece] = len(self.encoding.encode_ordinary(piece))
        return n


class CountTree:
    """Sums of characters and tokens over the leaves of one text; both arrays have the root at
    1 and the leaves from ``size`` on."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens = chars, tokens
        self.size = len(chars) // 2

    @classmethod
    def of(cls, text: str, counts: PieceCounts) -> CountTree:
        pieces = counts.pattern.findall(text)
        size = 1 << max(0, (len(pieces) - 1).bit_length())
        out = cls(np.zeros(2 * size, np.int32), np.zeros(2 * size, np.int32))
        out.chars[size : size + len(pieces)] = np.fromiter(map(len, pieces), np.int32, len(pieces))
        out.tokens[size : size + len(pieces)] = np.fromiter(map(counts.__getitem__, pieces), np.int32, len(pieces))
        low = size
        while low > 1:
            for sums in (out.chars, out.tokens):
                sums[low // 2 : low] = sums[low : 2 * low : 2] + sums[low + 1 : 2 * low : 2]
            low //= 2
        return out

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds a character; for the place behind
        the text an empty leaf at its end, or the last leaf where all are used."""
        node, first, total = 1, 0, int(self.chars[1])
        while node < self.size:
            node *= 2
            left = int(self.chars[node])
            if place >= first + left and (left or first < total):
                first += left
                node += 1
        return node - self.size, first

    def put(self, low: int, high: int, chars: int, tokens: int) -> None:
        """Leaf ``low`` takes these sums, the leaves up to ``high`` become empty."""
        for sums, value in ((self.chars, chars), (self.tokens, tokens)):
            a, b = low + self.size, max(high, low + 1) + self.size
            sums[a:b] = 0
            sums[a] = value
            while a > 1:
                a, b = a // 2, (b - 1) // 2 + 1
                sums[a:b] = sums[2 * a : 2 * b : 2] + sums[2 * a + 1 : 2 * b : 2]


def apply_edits(text: str, tree: CountTree, edits: list[tuple[int, int, str]], counts: PieceCounts) -> tuple[str, int]:
    """The edited text and the number of pre-tokens read again; the tree is brought up to date.

    edits: (start, end, replacement) in characters of the text, in order, not overlapping."""
    parts, at = [], 0
    for start, end, new in edits:
        if not at <= start <= end <= len(text):
            raise ValueError("edits must be in order, apart and inside the text")
        parts += [text[at:start], new]
        at = end
    edited = "".join([*parts, text[at:]])
    match = counts.pattern.match
    regions: list[tuple[int, int, int, int]] = []  # leaves from, to; characters, tokens
    again, k, shift = 0, 0, 0
    while k < len(edits):
        start, end, new = edits[k]
        low, first = tree.leaf_at(max(0, start - CONTEXT))
        place = first + shift
        begin, tokens = place, 0
        shift += len(new) - (end - start)
        k += 1
        last, reach = end, end + shift  # the end of the edit in the old and in the new text
        while True:
            # edits that the stretch read so far comes near to belong to it
            while k < len(edits) and edits[k][0] - CONTEXT <= max(last, place - shift):
                start, end, new = edits[k]
                shift += len(new) - (end - start)
                last, reach = end, end + shift
                k += 1
            if place >= len(edited):
                high = tree.size
                break
            if place >= reach:
                high, ends = tree.leaf_at(place - shift)
                # a stretch with characters needs a leaf to hold them
                if ends == place - shift and (high > low or place == begin):
                    break
            piece = match(edited, place).group()
            tokens += counts[piece]
            place += len(piece)
            again += 1
        if (place, high) != (begin, low):
            regions.append((low, high, place - begin, tokens))
    for low, high, chars, tokens in regions:
        tree.put(low, high, chars, tokens)
    return edited, again


def _counts(ranks: str, pattern: str, docs: DataFrame) -> tuple[tuple, Callable[[], PieceCounts]]:
    with open(ranks, "rb") as f:
        source = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(source)  # one vocabulary file
    name = ("piece counts", zlib.crc32(source), pattern)

    def get() -> PieceCounts:
        store = worker_store()
        if name not in store:
            store[name] = PieceCounts(shared.value, pattern)
        return store[name]

    return name, get


def build(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", names: tuple[str, str] = ("n_tokens", "tree")) -> DataFrame:
    """The documents with their token count and tree (both arrays of sums, as bytes). A NULL
    text counts as an empty one."""
    name, get = _counts(ranks, pattern, docs)

    def make():
        counts = get()

        def work(columns: list[pa.Array]) -> list[pa.Array]:
            trees = [CountTree.of(t or "", counts) for t in columns[0].to_pylist()]
            blobs = [t.chars.tobytes() + t.tokens.tobytes() for t in trees]
            return [pa.array([t.total for t in trees], pa.int64()), pa.array(blobs, pa.binary())]

        return work

    return map_columns(docs, [text_col], [(names[0], T.LongType()), (names[1], T.BinaryType())], make, needed=name)


def edit(
    state: DataFrame, ranks: str, pattern: str, edits_col: str, text_col: str = "text", tree_col: str = "tree",
    names: tuple[str, str, str, str] = ("new_text", "new_tokens", "n_read", "new_tree"),
) -> DataFrame:
    """The rows of ``build`` with their text after the edits, its count, the number of pre-tokens
    that were read again, and the tree to go on with.

    edits: an array of structs (start, end, text), in order and apart; NULL for none."""
    name, get = _counts(ranks, pattern, state)

    def make():
        counts = get()

        def work(columns: list[pa.Array]) -> list[pa.Array]:
            out = []
            for text, blob, edits in zip(*(c.to_pylist() for c in columns)):
                sums = np.frombuffer(blob, np.int32).copy().reshape(2, -1)
                tree = CountTree(sums[0], sums[1])
                listed = [(e["start"], e["end"], e["text"]) for e in edits or []]
                new, again = apply_edits(text or "", tree, listed, counts)
                out.append((new, tree.total, again, tree.chars.tobytes() + tree.tokens.tobytes()))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
            return [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]

        return work

    fields = list(zip(names, [T.StringType(), T.LongType(), T.LongType(), T.BinaryType()]))
    return map_columns(state, [text_col, tree_col, edits_col], fields, make, needed=name)


def count_edits(
    docs: DataFrame, ranks: str, pattern: str, edits_col: str, text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``build`` and ``edit`` in one task, for documents whose trees are not kept: the kept
    columns (default: all) with n_tokens, n_tokens_edited and n_read."""
    name, get = _counts(ranks, pattern, docs)

    def make():
        counts = get()

        def work(columns: list[pa.Array]) -> list[pa.Array]:
            out = []
            for text, edits in zip(*(c.to_pylist() for c in columns)):
                tree = CountTree.of(text or "", counts)
                before = tree.total
                _, again = apply_edits(text or "", tree, [(e["start"], e["end"], e["text"]) for e in edits or []], counts)
                out.append((before, tree.total, again))
            return [pa.array([r[k] for r in out], pa.int64()) for k in range(3)]

        return work

    fields = [(name, T.LongType()) for name in ("n_tokens", "n_tokens_edited", "n_read")]
    return map_columns(docs, [text_col, edits_col], fields, make, keep=keep, needed=name)


def redactions(docs: DataFrame, name: str, text_col: str = "text", kinds: list[str] = pii.KINDS) -> DataFrame:
    """The documents with edits that put a mark such as <email> for every strict span of personal
    data; of spans that overlap, the first one, then the first kind."""
    found, spans = pii.with_spans(docs, text_col, kinds)
    both = F.array_sort(F.concat(*[F.transform(F.col(spans[k]), _mark_of(i, k)) for i, k in enumerate(kinds)]))
    apart = F.aggregate(
        both,
        F.struct(F.lit(0).cast("bigint").alias("end"), F.array().cast("array<struct<start:bigint,end:bigint,text:string>>").alias("kept")),
        lambda acc, s: F.when(
            s["start"] >= acc["end"],
            F.struct(s["end"].alias("end"), F.array_append(acc["kept"], F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))).alias("kept")),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )
    return found.withColumn(name, apart).drop(*spans.values())


def _mark_of(rank: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(f"<{kind}>").alias("text"))


def digest(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited, n_read: counts before and after the redaction
    of personal data."""
    rows = redactions(docs.select("doc_id", "text"), "edits").withColumn("n_edits", F.size("edits").cast("long"))
    out = count_edits(rows, ranks, pattern, "edits", keep=["doc_id", "n_edits"])
    return out.select("doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_read")
