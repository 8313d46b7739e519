from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tabloom.llm.language import Network, digest, learned, predict, probabilities


def test_gradients_by_differences():
    net = Network.new(["a", "b", "c"], units=3)
    net.weights = {k: w.astype(np.float64) for k, w in net.weights.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (4, 7)).astype(np.uint8), np.array([0, 1, 2, 1])
    mask = (np.arange(7) < np.array([7, 5, 7, 1])[:, None]).astype(np.float64)
    run = Network.run

    def double(self, x, way, keep=False):  # the same steps in double precision
        was = np.float32
        try:
            np.float32 = np.float64
            return run(self, x, way, keep)
        finally:
            np.float32 = was

    Network.run = double
    try:
        _, slope = net.gradients(x, y, mask)
        for name, w in net.weights.items():
            flat, g = w.reshape(-1), slope[name].reshape(-1)
            used = np.flatnonzero(np.abs(g) > 1e-9)[:12]
            for k in used:
                old = flat[k]
                flat[k] = old + 1e-5
                up = net.gradients(x, y, mask)[0]
                flat[k] = old - 1e-5
                down = net.gradients(x, y, mask)[0]
                flat[k] = old
                assert (up - down) / 2e-5 == pytest.approx(g[k], rel=1e-2, abs=1e-6), name
    finally:
        Network.run = run


def test_pooling_reads_whole_texts():
    net = Network.new(["a", "b"])
    text = bytes(random.Random(1).randrange(97, 123) for _ in range(5 * 64 + 10))
    whole = probabilities(net, [text, b"", text[:64]])
    parts = [probabilities(net, [text[k : k + 64]])[0] * len(text[k : k + 64]) for k in range(0, len(text), 64)]
    assert whole[0] == pytest.approx(sum(parts) / len(text), abs=1e-5)
    assert whole[1].tolist() == [0, 0] and whole[2] == pytest.approx(parts[0] / 64, abs=1e-5)


def corpus():
    rng = random.Random(3)
    sounds = {"xx": ["sha", "the", "ing", "wh"], "yy": ["ñó", "ar", "os", "ci"], "zz": ["öß", "sch", "keit", "ung"]}
    rows = []
    for i in range(900):
        lang = rng.choice(list(sounds))
        text = " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60)))
        rows.append((i, text, lang if i % 10 else None, "lang_pred"))
    return rows


def test_held_out_accuracy_and_edge_cases(spark):
    rows = corpus()
    odd = [(1000, None, "xx", None), (1001, "", "yy", None), (1002, "12 34 !?", None, None), (None, "sha the ing", None, None), (5, rows[5][1], rows[5][2], None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string").repartition(4)
    got = digest(docs).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in got}
    held = [(r.lang_pred, rows[r.doc_id][2]) for r in got if r.held_out and r.doc_id < 900 and rows[r.doc_id][2]]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) >= 0.97
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1000, 1001, 1002))
    assert by_id[None].lang_pred == "xx" and all(0 <= r.score <= 1 for r in got)
    assert digest(docs.where("false")).collect() == []


def test_labels_of_held_out_rows_have_no_effect(spark):
    rows = corpus()[:300]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    turned = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s) for i, t, lang, s in rows]
    other = spark.createDataFrame(turned, "doc_id long, text string, lang string, score string")
    assert sorted(map(str, digest(docs).collect())) == sorted(map(str, digest(other).collect()))


def test_nothing_labelled(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert learned(docs) is None
    assert [tuple(r) for r in predict(docs, None).collect()] == [(1, "some text", None, "und", 0.0)]
