"""Sources of time-stamped segments, and the JSON form of transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbatik.functions import text as tx

#: Segments inside the engine: list order is explicit (pos), times are start_s and end_s.
SEGMENT_COLUMNS = ("transcript_id", "pos", "id", "start_s", "end_s", "text")

JSON_SEGMENT = T.StructType().add("id", "double").add("start", "double").add("end", "double").add("text", "string").add("zh", "string")
JSON_TRANSCRIPT = T.StructType().add("text", "string").add("segments", T.ArrayType(JSON_SEGMENT))

#: File suffixes of audio and video inputs.
AUDIO = (".mp3", ".wav", ".m4a", ".flac", ".aac", ".ogg")
VIDEO = (".mp4", ".avi", ".mov", ".mkv", ".wmv", ".flv")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: transcript_id (the file's path), text, segments, error.

    A file that isn't JSON of that form has its text in error, and null text and segments.
    """
    kind = T.StructType([*JSON_TRANSCRIPT.fields, T.StructField("error", T.StringType())])
    df = spark.read.schema(kind).option("multiLine", True).option("columnNameOfCorruptRecord", "error").json(path)
    return df.select(F.col("_metadata.file_path").alias("transcript_id"), "text", "segments", "error")


def explode_segments(transcripts: DataFrame) -> DataFrame:
    """Segment rows of transcripts; missing texts are empty, missing ids 0. Transcripts without segments have no rows: see without_segments()."""
    rows = transcripts.select("transcript_id", F.posexplode("segments").alias("pos", "s"))
    return rows.select("transcript_id", "pos", F.coalesce("s.id", F.lit(0.0)).alias("id"), F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"), F.coalesce("s.text", F.lit("")).alias("text"), F.col("s.zh").alias("zh"))


def without_segments(transcripts: DataFrame) -> DataFrame:
    """Transcripts that explode_segments() gives no rows for."""
    return transcripts.where(F.col("segments").isNull() | (F.size("segments") == 0))


def clean(transcripts: DataFrame) -> DataFrame:
    """Transcripts whose segments have exactly id, start, end and text."""
    return transcripts.withColumn("segments", F.transform("segments", lambda s: F.struct(s["id"].alias("id"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))))


def to_transcripts(segments: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row a transcript: text (segments' texts joined by a space) and segments, in order of pos."""
    fields = [F.col("id"), F.col("start_s").alias("start"), F.col("end_s").alias("end"), F.col("text"), *map(F.col, extra)]
    listed = segments.groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("s")))).alias("l"))
    rows = listed.select("transcript_id", F.transform("l", lambda x: x["s"]).alias("segments"))
    return rows.select("transcript_id", F.array_join(F.transform("segments", lambda s: s["text"]), " ").alias("text"), "segments")


def write_transcripts(segments: DataFrame, path: str, extra: tuple[str, ...] = ()) -> None:
    """JSON lines, one transcript each; null fields are left out."""
    to_transcripts(segments, extra).write.json(path)


def document_segments(documents: DataFrame) -> DataFrame:
    """Lines of documents as segments, with times made from their word counts.

    Every noise that speech recognition makes (blank lines, stray marks, repeats, ellipses,
    guillemets) is put in by a rule over (doc_id, pos), so that each operator has work to do.
    Times are added up in whole milliseconds; some segments step back, or end early.
    """
    lines = documents.select(F.col("doc_id").alias("transcript_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    kind = F.pmod(F.col("transcript_id") * 5 + F.col("pos") * 3, F.lit(17))
    line = F.col("line")
    first = F.split(line, " ")[0]
    text = (
        F.when(kind == 0, F.concat(F.lit(" "), line)).when(kind == 1, F.concat(line, F.lit(" !"))).when(kind == 2, F.concat(F.lit("..."), line))
        .when(kind == 3, F.concat(line, F.lit("!!!! ??"))).when(kind == 4, F.lit("... ... ...")).when(kind == 5, F.lit("  "))
        .when(kind == 6, F.array_join(F.array_repeat(first, 5), " ")).when(kind == 7, F.lit("?")).when(kind == 8, F.concat(F.lit("» "), line))
        .when(kind == 9, F.concat(line, F.lit(" »"))).when(kind == 10, F.lit("Merci.")).when(kind == 11, F.lit("3, 14")).otherwise(line)
    )
    rows = lines.withColumn("text", text)
    rows = rows.withColumn("dur", 350 * F.greatest(tx.word_count(F.col("text")), F.lit(1)).cast("bigint"))
    rows = rows.withColumn("gap", 50 * F.pmod(F.col("transcript_id") * 7 + F.col("pos") * 3, F.lit(5)))
    w = Window.partitionBy("transcript_id").orderBy("pos")
    rows = rows.withColumn("to", F.sum(F.col("dur") + F.col("gap")).over(w) - F.col("gap"))
    # recognisers step back in time now and then: a whole segment, or its end alone
    step = F.pmod(F.col("transcript_id") * 11 + F.col("pos") * 7, F.lit(23))
    back = F.when(step == 0, 1500).otherwise(0)
    early = F.when(step == 9, F.col("dur") - 40).otherwise(back)
    ms = lambda c: F.greatest(c, F.lit(0).cast("bigint")) / F.lit(1000.0)
    return rows.select("transcript_id", "pos", F.col("pos").cast("double").alias("id"), ms(F.col("to") - F.col("dur") - back).alias("start_s"), ms(F.col("to") - early).alias("end_s"), "text")


def conversation_segments(conversations: DataFrame) -> DataFrame:
    """Turns as segments of half a second a word."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", (F.row_number().over(w) - 1).alias("pos"), text.alias("text"), (500 * F.greatest(tx.word_count(text), F.lit(1)).cast("bigint")).alias("dur"))
    rows = rows.withColumn("to", F.sum("dur").over(Window.partitionBy("conv_id").orderBy("pos")))
    return rows.select(F.col("conv_id").alias("transcript_id"), "pos", F.col("pos").cast("double").alias("id"), ((F.col("to") - F.col("dur")) / F.lit(1000.0)).alias("start_s"), (F.col("to") / F.lit(1000.0)).alias("end_s"), "text")


def is_url(c: Column) -> Column:
    """Whether a text has both a scheme and a host."""
    return F.coalesce(c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+"), F.lit(False))


def input_kind(c: Column) -> Column:
    """url, audio, video or unsupported."""
    suffix = F.lower(F.regexp_extract(F.regexp_extract(c, r"[^/]*$", 0), r"\.[^.]+$", 0))
    return F.when(is_url(c), "url").when(suffix.isin(*AUDIO), "audio").when(suffix.isin(*VIDEO), "video").otherwise("unsupported")


def video_formats(info: DataFrame, json_col: str = "info") -> DataFrame:
    """title, duration and the formats that have pictures, from a downloader's JSON."""
    kind = "title string, duration double, formats array<struct<format_id:string,ext:string,height:int,vcodec:string>>"
    v = F.from_json(json_col, kind)
    return info.select(v["title"].alias("title"), v["duration"].alias("duration"), F.filter(v["formats"], lambda f: f["vcodec"] != "none").alias("formats"))


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """Audio and video files below path with their kind; contents are read only if selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.withColumn("kind", input_kind(F.col("path"))).where(F.col("kind") != "unsupported")


def newest(files: DataFrame) -> DataFrame:
    """Path of the latest modified file."""
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))
