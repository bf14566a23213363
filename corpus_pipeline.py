"""A corpus pipeline of five stages over ``documents``; each stage's rows are written and read by the next.

Every stage works on all rows that its predecessor kept and takes whole texts, however long. Extra columns of
any name pass through the first four stages; an empty table gives an empty one.

A stage's last plan is written by the caller, and Python workers get whole texts in it. So the stages leave the
session with small Arrow batches: a full one of the default size stands several times in an executor's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.llm.common import fresh, materialise, small_batches, table
from hornbeam.llm.queries import vocabulary
from hornbeam.llm.rules import words


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; those with a null or empty text have no words and go too.

    Repeated rows are judged alike; a score at the threshold is kept.
    """
    from hornbeam.llm.quality import classify

    small_batches(spark)
    verdict = fresh(docs, "quality")
    return classify(docs, out_col=verdict).where(F.col(f"{verdict}.kept")).select(*[f"`{c}`" for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of common blocks go from the later document; documents that lose all their words go.

    The smaller id is the earlier document, of one id the smaller hash of the text; a null id is the first of all.
    Repeated rows are one document. A null text has no lines and stays. ``n_chars`` is that of the text left.
    """
    from hornbeam.llm.lines import deduplicate_lines

    small_batches(spark)
    own = docs.withColumnsRenamed({c: fresh(docs, f"{c}_own") for c in ("n_lines", "n_removed") if c in docs.columns})
    out = deduplicate_lines(own)
    left = (F.col("n_removed") == 0) | (F.size(words(F.coalesce("text", F.lit("")))) > 0)
    kept = out.where(left).withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in own.columns])
    return kept.toDF(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the smallest by id (null last), then by hash of the text.

    Texts without words are no duplicates, but of rows with equal id and text one stays.
    """
    from hornbeam.llm.jaccard import one_of_each

    small_batches(spark)
    return one_of_each(docs).select(*[f"`{c}`" for c in docs.columns])


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; a null text stays null, repeated rows are treated alike, no row goes."""
    from hornbeam.llm.secrets import redact

    small_batches(spark)
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 4096, one row per piece; a null text is an empty one, repeated rows are packed each."""
    from hornbeam.llm.packing import pack_documents

    small_batches(spark)
    return pack_documents(docs, vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: No SQL can tokenise or train the stages' models; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
