"""The registered queries of the subpackage and the SQL that must give the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import (
    common,
    decontamination,
    exact_dedup,
    html_text,
    language,
    line_dedup,
    neighbours,
    packing,
    pii,
    sharding,
    simhash,
    spelling,
    token_counts,
    vector_codes,
)


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.digest(common.table(spark, sf_dir, "embeddings"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.digest(common.table(spark, sf_dir, "pages"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(common.table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(common.table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(common.table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return token_counts.digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(common.table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (common.table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontamination.digest(docs, items)


OP8_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
gram AS (
  SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
occ AS (SELECT doc_id, i, k, item_id FROM gram JOIN win USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.classes(common.table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH RECURSIVE line AS (
  SELECT doc_id, k - 1 AS line_no, l FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k
    FROM documents WHERE text IS NOT NULL)
  WHERE regexp_matches(l, '[^\\t\\n\\x0B\\f\\r ]')),
kind AS (SELECT DISTINCT l, strlen(l) AS n FROM line),
link AS (
  SELECT a.l AS a, b.l AS b FROM kind a JOIN kind b ON abs(a.n - b.n) <= 2 AND a.l <> b.l
  WHERE abs(a.n - b.n) <= least(2, least(a.n, b.n) // 10) AND levenshtein(a.l, b.l) <= least(2, least(a.n, b.n) // 10)),
reach AS (SELECT l AS x, l AS y FROM kind UNION SELECT x, b FROM reach JOIN link ON y = a),
place AS (SELECT l, min((doc_id, line_no)) AS p FROM line GROUP BY l),
first AS (SELECT x, min(p) AS p FROM reach JOIN place ON y = l GROUP BY x)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, p[1] AS class_doc_id, CAST(p[2] AS INTEGER) AS class_line_no,
  doc_id = p[1] AND line_no = p[2] AS kept
FROM line JOIN first ON l = x
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants_of_texts(common.table(spark, sf_dir, "documents"), drop_every=97)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(common.table(spark, sf_dir, "documents"), largest=True)


OP12_SQL = """
WITH doc AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
mark AS (
  SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS place FROM doc)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM mark
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(common.table(spark, sf_dir, "embeddings"))


def _op13_sql(rounds: int = 4) -> str:
    """The rounds one after the other: assign every part, then average the parts of each entry."""
    near = """
a{r} AS MATERIALIZED (
  SELECT vec_id, n, p, v, min(struct_pack(d := d, e := e)) AS m FROM (
    SELECT x.vec_id, x.n, x.p, x.v, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM part x JOIN b{r} b ON b.p = x.p) GROUP BY vec_id, n, p, v)"""
    mean = """
s{r} AS (
  SELECT p, e, k, sum(y)::BIGINT AS s, count(*) AS c FROM (
    SELECT p, m.e AS e, unnest(v) AS y, unnest(range(1, len(v) + 1)) AS k FROM a{r}) GROUP BY p, e, k),
m{r} AS (SELECT p, e, list((s - ((s % c) + c) % c) // c ORDER BY k) AS v FROM s{r} GROUP BY p, e),
b{n} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e)"""
    steps = [near.format(r=r) + "," + mean.format(r=r, n=r + 1) for r in range(rounds)]
    return (
        """
WITH vec AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS n, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (
  SELECT vec_id, n, p, list_slice(v, p * (len(v) // 4) + 1, (p + 1) * (len(v) // 4)) AS v FROM vec, (SELECT unnest(range(4)) AS p)),
b0 AS MATERIALIZED (SELECT p, n - 1 AS e, v FROM part WHERE n <= 256),"""
        + ",".join(steps)
        + ","
        + near.format(r=rounds)
        + f""",
book AS (
  SELECT sha256(string_agg(y, ',' ORDER BY p, e, k)) AS codebooks_sha256 FROM (
    SELECT p, e, CAST(unnest(v) AS VARCHAR) AS y, unnest(range(1, len(v) + 1)) AS k FROM b{rounds})),
code AS (SELECT vec_id, n, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, n)
SELECT code.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM code JOIN vec USING (n), book
"""
    )


OP13_SQL = _op13_sql()


QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_html_text": op2_html_text,
    "op3_language": op3_language,
    "op4_pii": op4_pii,
    "op5_simhash": op5_simhash,
    "op6_token_counts": op6_token_counts,
    "op7_sharding": op7_sharding,
    "op8_decontamination": op8_decontamination,
    "op9_line_dedup": op9_line_dedup,
    "op10_packing": op10_packing,
    "op11_spelling": op11_spelling,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES: dict[str, str] = {
    "op8_decontamination": OP8_SQL,
    "op9_line_dedup": OP9_SQL,
    "op12_exact_dedup": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
