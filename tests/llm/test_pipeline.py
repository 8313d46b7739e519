"""The pipeline next to a plain version of each stage, on a small table with planted cases."""

from __future__ import annotations

import os
import random
import subprocess
import sys
from collections import Counter

import corpus_pipeline
import pytest
from test_decontamination import brute as contaminated
from test_line_dedup import brute as line_classes
from test_similar import alike, plain_set
from test_simhash import union

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table():
    rng = random.Random(11)
    sounds = {"xx": ["sha", "the", "ing", "wh", "er"], "yy": ["ñó", "ar", "os", "ci", "la"]}
    rows = []

    def line(lang, n):
        return " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 5))) for _ in range(n))

    for i in range(240):
        lang = rng.choice(list(sounds))
        text = "\n".join(line(lang, rng.randint(8, 40)) for _ in range(rng.randint(1, 4)))
        rows.append((i, text, lang if i % 6 else None, "s", len(text)))
    item = line("xx", 30)
    text = rows[7][1]
    words = rows[8][1].split(" ")
    words[len(words) // 2] = "changedword"
    near = " ".join(words)
    extra = [text, near, "first words " + item + " and so on", "12 34 !!", None, "", "same line of all pages here\n" + line("xx", 20), "same line of all pages hero\n" + line("yy", 20)]
    wide = line("xx", 60).split(" ")
    extra += [" ".join(wide), " ".join([*wide[:30], "changedword", *wide[31:]])]
    rows += [(300 + k, t, "xx", "s", 0 if t is None else len(t)) for k, t in enumerate(extra)]
    rows += [(400 + k, text, None, "hot", len(text)) for k in range(60)]
    return rows, [(1, item), (2, None), (3, "zzz qqq")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = table()
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_against_plain_versions(spark, folder):
    rows, items = table()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, folder)
        if name != "packing":
            assert docs.columns == before.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = docs.collect()
    lettered = {i for i, t, *_ in rows if t and any(map(str.isalpha, t))}
    first = {r.doc_id: r for r in seen["language"]}
    assert set(first) == lettered
    truth = {i: lang for i, t, lang, *_ in rows if lang and i < 240}
    assert sum(first[i].lang == lang for i, lang in truth.items()) >= 0.97 * len(truth)

    input_rows = sorted((r.doc_id, r.text) for r in seen["language"])
    gone = {(d, k) for d, k, _, _, kept in line_classes(input_rows) if not kept}
    want = {}
    for d, t in input_rows:
        left = [x for k, x in enumerate(t.split("\n")) if (d, k) not in gone]
        if any(x.strip() for x in left):
            want[d] = "\n".join(left)
    assert {r.doc_id: r.text for r in seen["line_dedup"]} == want
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"])
    assert 7 in want and not any(400 <= d for d in want)

    sets = {d: plain_set(t) for d, t in want.items()}
    roots = union([(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])], sets)
    least = {}
    for d in sets:
        least[roots[d]] = min(d, least.get(roots[d], d))
    assert len(least) < len(sets)
    assert {r.doc_id for r in seen["near_dedup"]} == set(least.values())

    hit = {r[0] for r in contaminated([(d, want[d]) for d in least.values()], items) if r[-1]}
    assert 302 in hit and {r.doc_id for r in seen["decontamination"]} == set(least.values()) - hit
    lengths = Counter(r.sequence_id for r in seen["packing"] for _ in range(r.length))
    assert {r.doc_id for r in seen["packing"]} == set(least.values()) - hit and max(lengths.values()) <= 2048


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 150


def test_columns_of_any_name_stay_as_they_are(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["__id", "__row", "__gone", "__lang", "__text", "row_key", "utf8", "kind", "lang_pred", "n_words"]
    for k, name in enumerate(names):
        docs = docs.selectExpr("*", f"concat('{k}-', doc_id) AS `{name}`")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        rows = docs.collect()
        assert len(rows) > 100, name
        assert all(r[n] == f"{k}-{r.doc_id}" for r in rows for k, n in enumerate(names)), name


def test_nothing_labelled_keeps_every_text_with_a_letter(spark, folder):
    docs = spark.createDataFrame([(1, "abc", None), (2, "12 !", None), (3, None, None), (4, "ж", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, docs, folder).collect()) == [1, 4]


FOREIGN = """
import sys
sys.path.insert(0, {root!r})
from tabloom.session import build_session
import corpus_pipeline
from tabloom.llm import queries
del sys.path[0]
spark = build_session("foreign", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4",
    "spark.checkpoint.dir": {scratch!r}}})
for name in ("op3_language", "op8_decontamination", "op9_line_dedup", "op11_spelling", "op12_exact_dedup"):
    assert queries.QUERIES[name](spark, {folder!r}).count() > 0, name
assert corpus_pipeline.run(spark, {folder!r}).count() > 0
print("all ran")
"""


def test_executors_need_no_copy_of_the_package(folder, tmp_path):
    """A session of its own, whose workers start in another folder and cannot import the package."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = FOREIGN.format(root=root, folder=folder, scratch=str(tmp_path))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all ran" in ran.stdout, ran.stderr[-3000:]


def test_empty_table(spark, tmp_path):
    rows, items = table()
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_a_stage_starts_without_what_others_left_in_its_workers(spark):
    import pyarrow as pa
    from pyspark.sql import types as T

    from tabloom.llm.common import map_columns, worker_store

    def leave(batches):
        worker_store()["cache of another stage"] = list(range(1000))
        worker_store()["own cache"] = [1]
        yield from batches

    def make():
        held = len(worker_store().get("cache of another stage", []))
        return lambda columns: [pa.array([held] * len(columns[0]), pa.int64())]

    rows = spark.range(0, 64, 1, 16)
    rows.mapInArrow(leave, rows.schema).count()
    seen = map_columns(rows, ["id"], [("held", T.LongType())], make, needed="own cache")
    assert [r["held"] for r in seen.select("held").distinct().collect()] == [0]
