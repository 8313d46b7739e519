from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tabloom.llm.packing import WordIds, pack, pack_documents, packing_plan

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_bins(placed, capacity):
    bins = defaultdict(list)
    for length, seq, offset in placed:
        bins[seq].append((offset, length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def expand(runs):
    return [(s, b + (r - r0) // k, at + (r - r0) % k * s) for s, r0, r1, b, k, at in runs for r in range(r0, r1)]


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 60, 2048])
    counts = Counter(min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(3000))
    runs = packing_plan(counts, capacity)
    seen = defaultdict(list)
    for s, r0, r1, *_ in runs:
        seen[s] += range(r0, r1)
    assert {s: sorted(r) for s, r in seen.items()} == {s: list(range(n)) for s, n in counts.items()}
    bins = check_bins(expand(runs), capacity)
    assert all(sum(3 * length > capacity for _, length in b) <= 2 for b in bins.values())
    total = sum(s * n for s, n in counts.items())
    assert len(bins) <= 1.05 * total / capacity + 2 or len(bins) <= 1.02 * plain_best_fit(counts, capacity)


def plain_best_fit(counts, capacity):
    gaps = []
    for s in sorted(counts.elements(), reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


def test_word_ids_equal_the_tokenizer():
    model = Tokenizer.from_file(PATH)
    ids = WordIds(model)
    texts = ["Hello, World. it's 1,234.5!", "Ñandú  été́ ß. x\x1cy  z w", "a\tb\nc\x0bd", "", "İstanbul ΟΔΟΣ, ΟΔΟΣ.", "..., .,. ,", "<|endoftext|>, end", "Ångstrom. ﬁx"]
    ids.learn({w for t in texts for w in t.encode().split()})
    for t in texts:
        got = b"".join(ids[w] for w in t.encode().split())
        assert np.frombuffer(got, "<u4").tolist() == model.encode(t, add_special_tokens=False).ids, t


def test_letters_and_marks_are_encoded_apart(monkeypatch):
    model = Tokenizer.from_file(PATH)
    ids = WordIds(model)
    whole = []
    encode = ids.encode
    monkeypatch.setattr(ids, "encode", lambda text: whole.append(text) or encode(text))
    words = ["planet", "Planet!!", "PLANET,%%%", "Été$$$", "ÀÞßÿ", "ny(", "it's", "a.b", "x2", "Σας.", "...", "naı̈ve", "e\u0301t", "×÷"]
    ids.learn([w.encode() for w in words])
    for w in words:
        assert np.frombuffer(ids[w.encode()], "<u4").tolist() == model.encode(w, add_special_tokens=False).ids, w
    assert not {b"planet", b"Planet!!", b"PLANET,%%%", "Été$$$".encode()} & set(whole)
    assert {b"planet", "été".encode()} <= set(ids.roots)


def test_ids_of_a_batch_of_texts(monkeypatch):
    model = Tokenizer.from_file(PATH)
    monkeypatch.setattr("tabloom.llm.packing.CACHED_WORDS", 40)  # the cache starts anew within the texts
    monkeypatch.setattr("tabloom.llm.packing.CACHED_ROOTS", 30)
    ids, rng = WordIds(model), random.Random(3)
    alphabet = "abcdeéÉßАя中0 1\t\n.,'!%<|>\u0301\u00a0\x1c"
    for _ in range(20):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(30)] + [None, "", "  ", "<|endoftext|>!!"]
        batch = pa.array([None if t is None else t.encode() for t in ["left out", *texts]], pa.binary()).slice(1)
        packed, ends = ids.of_texts(batch)
        assert len(ends) == len(texts) + 1
        for t, start, end in zip(texts, ends, ends[1:]):
            assert np.frombuffer(packed[start:end], "<u4").tolist() == model.encode(t or "", add_special_tokens=False).ids, t
    packed, ends = ids.of_texts(pa.array([], pa.binary()))
    assert (bytes(packed), ends) == (b"", [0])


def test_a_vocabulary_without_parts_is_encoded_word_by_word():
    model = Tokenizer.from_file(PATH)
    model.normalizer = None  # upper case stays
    ids, words = WordIds(model), [b"Planet!!", b"planet", "Été".encode()]
    ids.learn(words)
    for w in words:
        assert np.frombuffer(ids[w], "<u4").tolist() == model.encode(w.decode(), add_special_tokens=False).ids


def test_documents(spark):
    texts = ["short text", None, "", "word " * 5000, "hot copy of one text"] + [f"row {i} " * (i % 40) for i in range(200)]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(4, texts[4], 4)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = pack_documents(docs, PATH, 64).collect()
    model = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t, _ in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = check_bins([(r.length, r.sequence_id, r.offset) for r in got], 64)
    assert len(bins) <= 1.1 * sum(r.length for r in got) / 64 + 2
    assert pack_documents(docs.where("false"), PATH, 64).collect() == []


def test_ranks_do_not_depend_on_buckets(spark):
    pieces = spark.createDataFrame([(i, 0, 0, 1 + i % 3, i) for i in range(60)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    for n in (1, 4):
        assert len(check_bins([(r.length, r.sequence_id, r.offset) for r in pack(pieces, 6, n).collect()], 6)) == 20
