"""Refinement of transcripts as they arrive in a folder (an extension: the batch operators, run file by file)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatik.operators import refine
from verbatik.sources import segments as sg


def refine_new_files(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Refine the transcript files that are new in source, and add them to the table at target.

    A transcript is refined as a whole, in the micro-batch that its file comes in; the checkpoint
    remembers which files are done. Each micro-batch has a folder of its own that a retry writes
    anew, so none is added twice.
    """
    rows = spark.readStream.schema(sg.JSON_TRANSCRIPT).option("multiLine", True).json(source)
    rows = rows.select(F.col("_metadata.file_path").alias("transcript_id"), "text", "segments")

    def add(batch: DataFrame, number: int) -> None:
        refine.refine(sg.explode_segments(batch)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
