"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatik.llm import ann, knn_quality, langid, licenses, packing, quality_rules, sampling, simhash, suffix, warc
from verbatik.llm.common import remainder

#: Vocabulary file of op5, by name among the installed public tokenizers.
PACKING_TOKENIZER = "word_bpe_49k.json"
#: Model file of op4.
SAMPLING_MODEL = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = warc.archive(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample(table(spark, sf_dir, "documents"), tokenizer_path(SAMPLING_MODEL), ["doc_id"])


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(PACKING_TOKENIZER), 2048)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = knn_quality.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    out = knn_quality.score(docs, model)
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    predicted = (F.col("score") >= knn_quality.THRESHOLD).cast("int")
    return out.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.assess(docs, quality_rules.trusted_ids(table(spark, sf_dir, "labels"))).drop("text")


def file_paths(docs: DataFrame) -> DataFrame:
    """documents as a tree of files: source/group/id, the first of each group being its licence file."""
    group = F.floor(F.col("doc_id") / 40).cast("bigint")
    name = F.when(F.col("doc_id") % 40 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.withColumn("path", F.concat_ws("/", "source", (group % 32).cast("string"), group.cast("string"), name))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_tree(file_paths(table(spark, sf_dir, "documents")), carry=("doc_id",))


def op9_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.dictionaries(docs, remainder("doc_id", 3) != 1))
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_warc": op3_warc,
    "op4_sampled_segmentations": op4_sampled_segmentations,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_quality_rules": op7_quality_rules,
    "op8_license_scan": op8_license_scan,
    "op9_multiprobe_lsh": op9_multiprobe_lsh,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
            FROM pages
        ), b AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS best FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN best END AS refers_to
        FROM b
    """,
}
