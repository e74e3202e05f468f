"""SubRip cues and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatik.functions import text as tx


def _bare(name: str) -> Column:
    return tx.strip(F.coalesce(F.col(name), F.lit("")))


def cues(s: DataFrame, zh: bool = True) -> DataFrame:
    """transcript_id, n and cue: number, times, text, translation if there is one, and an empty line."""
    n = F.row_number().over(Window.partitionBy("transcript_id").orderBy("pos"))
    rows = s.withColumn("n", n)
    parts = [F.col("n").cast("string"), F.concat(tx.timestamp(F.col("start_s")), F.lit(" --> "), tx.timestamp(F.col("end_s"))), _bare("text")]
    if zh and "zh" in s.columns:
        parts.append(F.when(_bare("zh") != "", _bare("zh")))
    return rows.select("transcript_id", "n", F.concat(F.concat_ws("\n", *parts), F.lit("\n")).alias("cue"))


def documents(c: DataFrame) -> DataFrame:
    """transcript_id and srt: the cues in order, joined by a line end."""
    listed = c.groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct("n", "cue"))).alias("l"))
    return listed.select("transcript_id", F.array_join(F.transform("l", lambda x: x["cue"]), "\n").alias("srt"))


def write(c: DataFrame, path: str) -> None:
    """One table of documents: transcript_id and srt."""
    documents(c).select("transcript_id", F.regexp_replace("srt", "\n$", "").alias("srt")).write.parquet(path)


def export(c: DataFrame, path: str) -> None:
    """One subtitle file a transcript, below path/transcript_id=.../; for as many transcripts as one wants folders."""
    docs = documents(c).select("transcript_id", F.regexp_replace("srt", "\n$", "").alias("value"))
    docs.write.partitionBy("transcript_id").text(path)
