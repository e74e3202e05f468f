"""Speech recognition as a provider: media files in, transcripts out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbatik.functions import text as tx

#: A provider takes a file's path and bytes and gives {"text": ..., "segments": [{id, start, end, text}, ...]}.
Recognizer = Callable[[str, bytes], dict]

_SEGMENT = T.StructType().add("id", "double").add("start", "double").add("end", "double").add("text", "string")
SCHEMA = T.StructType().add("transcript_id", "string").add("text", "string").add("segments", T.ArrayType(_SEGMENT)).add("error", "string")


def transcribe(media: DataFrame, load: Callable[[], Recognizer]) -> DataFrame:
    """transcript_id (the path), text, segments and error of each file; segments keep exactly four fields.

    media: path, content. load is called once a task, so a model is loaded once and used for all of
    its files. A file that fails has its error, and the others go on.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recognize = None
        for b in batches:
            recognize = recognize or load()
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    got = recognize(path, content)
                    segs = [{"id": float(s.get("id", 0)), "start": float(s["start"]), "end": float(s["end"]), "text": s.get("text") or ""} for s in got.get("segments", [])]
                    rows.append({"transcript_id": path, "text": got.get("text") or "", "segments": segs, "error": None})
                except Exception as e:
                    rows.append({"transcript_id": path, "text": None, "segments": None, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return media.select("path", "content").mapInArrow(run, SCHEMA)


def metadata(transcripts: DataFrame, least: float = 0.01) -> DataFrame:
    """How each transcript was come by: ratio of sentence marks, and the strategy that it leads to."""
    ratio = tx.punctuation_ratio(F.coalesce("text", F.lit("")))
    strategy = F.when(F.col("error").isNotNull(), "failed").when(F.col("punctuation_ratio") >= least, "recognized").otherwise("punctuation_restored")
    return transcripts.withColumn("punctuation_ratio", ratio).select("transcript_id", "punctuation_ratio", strategy.alias("strategy"), F.size("segments").alias("segments"), "error")
