"""From raw documents to packed sequences: quality, toxicity, near duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept.  All but the
last return the columns they were given, whatever their names; NULL texts count as empty, repeated rows are judged alike, and
an empty table stays empty.  SQL cannot express the models, so the pipeline is tested
against its stages one by one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm.jaccard_join import Rule, near_duplicates
from gaugework.llm.packing import pack_documents
from gaugework.llm.quality import quality
from gaugework.llm.shared import table, written
from gaugework.llm.toxicity import toxicity

#: Documents below this probability of being good go, documents from this one of being toxic go.
GOOD, TOXIC = 0.3, 0.7


def _unused(docs: DataFrame, name: str) -> str:
    """``name``, longer if ``docs`` has a column called so."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def _judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], keep: Callable[[Column], Column]) -> DataFrame:
    """Rows whose ``score`` by ``judge`` is to be kept, with the columns as given, one called ``score`` included."""
    aside = {c: _unused(docs, f"_own_{c}") for c in docs.columns if c.lower() == "score"}
    judged = judge(docs.withColumnsRenamed(aside))
    return judged.where(keep(F.col("score"))).select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the compression classifier rejects."""
    labels = table(spark, sf_dir, "labels")
    return _judged(docs, lambda rows: quality(rows, labels), lambda score: score >= GOOD)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the weakly supervised classifier calls toxic."""
    labels = table(spark, sf_dir, "labels")
    return _judged(docs, lambda rows: toxicity(rows, labels), lambda score: score < TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that five-word shingles link at a similarity of 0.8 or more.

    Rows are numbered by their place in the input, so rows without id and repeated ids count too.  The numbers
    are written with the rows: numbered again, another split of the input would give them to other rows.
    """
    row = _unused(docs, "_row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), Rule(n=5, part=80, whole=100))
    first = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(row))
    return numbered.join(first, row, "left_semi").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("quality_classifier", keep_good),
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("best_fit_packing", pack),
]

#: The classifiers and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
