"""The corpus pipeline: STAGES applied to documents, one after the other.

Every stage works on all that its predecessor kept. The first four return the columns of
documents, with ``n_chars`` counted again where a text changed; the last one returns the packed
pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import common, decontamination, language, line_dedup, packing, similar

# a document stays if the network gives its best language this probability, pooled over the whole text:
# at least as much as all other languages together. Fewer letters than this are no evidence against it.
LANGUAGE_SCORE = 0.5
LETTERS = 20

# the stages send whole documents to Python workers; small batches bound what an executor holds outside its heap
LEAN = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 * 1024 * 1024),
}


def lean(spark: SparkSession) -> None:
    common.prepare(spark)
    for key, value in LEAN.items():
        spark.conf.set(key, value)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages, with the predicted one as their lang. Those
    without a letter (``und``) go, and so do those that the network cannot tell: junk, mixtures
    and other languages, whose best probability is below LANGUAGE_SCORE. Texts of fewer than
    LETTERS letters stay. Where no language could be learned, every document with a letter stays
    as it is."""
    lean(spark)
    network = language.learned(docs.where(~language.held_out()))
    if network is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    label, score = common.fresh(docs, "lang_pred"), common.fresh(docs, "lang_score")
    found = language.predict(docs, network, names=(label, score))
    short = F.length(F.regexp_replace("text", r"\P{L}", "")) < LETTERS
    kept = found.where((F.col(label) != "und") & ((F.col(score) >= LANGUAGE_SCORE) | short))
    return kept.select(*[F.col(label).alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one up to two edits; those left empty go."""
    lean(spark)
    kept = line_dedup.without_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def deduplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, found by SimHash blocks and verified at a
    similarity of 0.8 of their five-word shingles: the smallest id."""
    lean(spark)
    return similar.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    items = common.table(spark, sf_dir, "benchmark")
    lean(spark)
    return decontamination.clean(docs, items)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of at most 2048."""
    lean(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("line_dedup", deduplicate_lines),
    ("near_dedup", deduplicate_documents),
    ("decontamination", decontaminate),
    ("packing", pack),
]

# the first stage is a trained network, so SQL cannot express the rows
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's result is written to the shared folder and read again by the next."""
    docs = common.table(spark, sf_dir, "documents")
    lean(spark)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
