"""The contract queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    out = classify(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("quality.label").alias("label"), F.col("quality.score").alias("score"), F.col("quality.kept").alias("kept"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import base_digest, scan

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(base_digest("spans"), 256).alias("base_sha256"), base_digest("spans", None).alias("spans"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    out = identify(docs.select("doc_id", "text", held_out.alias("held_out")), docs.where(~held_out).select("lang", "text"))
    return out.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    out = encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import deduplicate

    out = deduplicate(table(spark, sf_dir, "documents"), size=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=5, percent=80)


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), host="source")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import deduplicate_lines

    out = deduplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_quality": op1_quality, "op2_secrets": op2_secrets, "op3_language": op3_language, "op4_bpe": op4_bpe, "op5_substrings": op5_substrings, "op6_jaccard": op6_jaccard, "op7_rules": op7_rules, "op8_packing": op8_packing, "op9_neighbours": op9_neighbours, "op10_lines": op10_lines}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return dict(sql.ORACLES)
