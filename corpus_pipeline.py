"""Corpus preparation in stages; each reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatik.llm import knn_quality, packing, quality_rules, queries, simhash, suffix
from verbatik.llm.common import discard, materialize, remainder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and blank texts go; repeated rows are judged alike; empty tables stay empty."""
    trusted = quality_rules.trusted_ids(queries.table(spark, sf_dir, "labels"))
    return quality_rules.assess(docs, trusted).where("kept").select(*COLUMNS)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good; it learns from the labelled rows that op6 learns from.

    Those are rows of the whole table: the rules have taken most bad ones out of docs. Repeated rows
    are judged alike; null and blank texts get the share of good labels. Without labels of both kinds
    to learn from there is no verdict: an error, unless docs is empty.
    """
    model = knn_quality.fit(queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    if not model.usable and not docs.isEmpty():
        raise ValueError("the quality classifier has no rows of both labels to learn from")
    scored = knn_quality.score(docs, model, carry=COLUMNS[1:])
    return scored.where(F.col("score") >= knn_quality.THRESHOLD).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles have a similarity of 0.8 or more, the one of the smallest doc_id stays."""
    return simhash.keep_similar(docs, width=5, similarity=0.8).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes or more that occur elsewhere; n_chars is counted anew.

    A character that a cut runs through goes too. A document of which nothing is left stays, empty.
    """
    out = suffix.remove_repeats(docs, carry=("lang", "source"))
    text = F.translate(F.make_valid_utf8(F.col("kept").cast("string")), "\ufffd", "")
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of 2048 tokens; a null or empty text is its end id alone, repeated rows are packed each."""
    return packing.pack_documents(docs, queries.tokenizer_path(queries.PACKING_TOKENIZER), 2048)


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("simhash_near_dedup", near_dedup),
    ("suffix_dedup", repeats),
    ("best_fit_packing", best_fit_packing),
]

#: Stages call trained models and hashes that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table is deleted once the next one is written."""
    docs = queries.table(spark, sf_dir, "documents")
    made = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if made is not None:
            discard(made)
        made = docs
    out = STAGES[-1][1](spark, docs, sf_dir)  # reads the pieces that it has written
    discard(made)
    return out
