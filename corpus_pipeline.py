"""A corpus from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
the documents are written as Parquet and read again, and deleted when the next
stage is written. All but the last return the columns of ``documents``.

Defined results: null, empty and blank texts fail the rules and go in the first stage; rows
without doc_id are kept by every later stage and packed with a null doc_id; of rows that repeat
a doc_id, near_dedup keeps one; an empty table passes through every stage and gives no rows;
columns beside those of ``documents`` are carried to the last stage, whatever their names; bytes of
a text that are not UTF-8 become U+FFFD in the first stage, since later ones read texts in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.llm import minhash, packing, quality, repeats, rules
from kinspark.llm.scratch import passing, settled
from kinspark.sources.shared import release


def decodable(docs: DataFrame) -> DataFrame:
    """docs with U+FFFD for what is not UTF-8 in a text; other texts stay as they are."""
    return docs.withColumn("text", F.make_valid_utf8("text"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; null, empty and blank texts have too few words."""
    return decodable(rules.accepted(docs))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant scores 0.7 or more. It learns from the table before the
    rules, which leave few documents of low quality to learn from; without labels of both kinds
    every score is the share of label 1."""
    labels, raw = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "documents"))
    return quality.accepted(docs, labels, learn_from=decodable(raw))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; rows without doc_id stay."""
    return minhash.deduplicated(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that documents of smaller doc_id have; n_chars follows. Rows without doc_id stay whole."""
    cut = repeats.without_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids with their sequences and offsets; a null text is the end id alone."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("pack", pack),
]

#: The classifier, the signatures and the tokenizer have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with passing(spark) as kept:
            after = settled(stage(spark, docs, sf_dir), name)
            kept.append(after)
        release(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
