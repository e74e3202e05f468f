"""Pipeline state as a table of events: what each step of each transcript is at, and where to go on.

Events: transcript_id, step, status, at, seq (order of events at one time), output (file or null).
State is always the latest event; nothing is rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Steps in order.
STEPS = ("download", "transcription", "refinement", "summary", "translation", "validation", "merging", "srt_generation")
EVENT = "transcript_id bigint, step string, status string, at timestamp_ntz, seq bigint, output string"


def initial(transcripts: DataFrame, with_download: bool = False) -> DataFrame:
    """A pending event for every step."""
    steps = STEPS if with_download else STEPS[1:]
    rows = transcripts.select("transcript_id", F.explode(F.array(*map(F.lit, steps))).alias("step"))
    return rows.select("transcript_id", "step", F.lit("pending").alias("status"), F.lit(None).cast("timestamp_ntz").alias("at"), F.lit(-1).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("output"))


def latest(events: DataFrame) -> DataFrame:
    """The last event of each step."""
    order = F.struct(F.coalesce("at", F.lit("0001-01-01").cast("timestamp_ntz")), "seq")
    last = F.max_by(F.struct("status", "at", "output"), order).alias("s")
    return events.groupBy("transcript_id", "step").agg(last).select("transcript_id", "step", "s.*")


def resume_point(events: DataFrame, files: DataFrame | None = None, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """The first step of each transcript that isn't done: transcript_id, step (null: all done).

    A completed step whose output is missing from files (column path) counts as not done; skipped
    steps are passed.
    """
    state = latest(events)
    place = F.array_position(F.array(*map(F.lit, steps)), F.col("step"))
    open_ = ~F.col("status").isin("completed", "skipped")
    if files is not None:
        have = files.select(F.col("path").alias("output"), F.lit(True).alias("_there")).distinct()
        state = state.join(have, "output", "left")
        open_ = open_ | ((F.col("status") == "completed") & F.col("output").isNotNull() & F.col("_there").isNull())
    rows = state.withColumn("place", place).where("place > 0")
    return rows.groupBy("transcript_id").agg(F.min_by("step", F.when(open_, F.col("place"))).alias("step"))


def missing_outputs(events: DataFrame, files: DataFrame) -> DataFrame:
    """Completed steps whose output isn't among files."""
    done = latest(events).where("status = 'completed' and output is not null")
    return done.join(files.select(F.col("path").alias("output")), "output", "left_anti").select("transcript_id", "step", "output")


def batch_counts(batch_events: DataFrame) -> DataFrame:
    """Batches by latest status per transcript: total, completed, failed. Events: transcript_id, batch_no, status, at, seq."""
    last = batch_events.groupBy("transcript_id", "batch_no").agg(F.max_by("status", F.struct("at", "seq")).alias("status"))
    one = lambda x: F.sum(F.when(F.col("status") == x, 1).otherwise(0)).alias(x)
    return last.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("total"), one("completed"), one("failed"))


def prepare_resume(events: DataFrame, now, summary: bool) -> DataFrame:
    """Events that set the resumed step running, and the summary step skipped or pending by the configuration."""
    at = F.lit(now).cast("timestamp_ntz")
    go = resume_point(events).where("step is not null").select("transcript_id", "step", F.lit("running").alias("status"), at.alias("at"), F.lit(1).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("output"))
    wrong = (F.col("status") == "skipped") if summary else ~F.col("status").isin("completed", "skipped")
    fix = latest(events).where((F.col("step") == "summary") & wrong).select("transcript_id", "step", F.lit("pending" if summary else "skipped").alias("status"), at.alias("at"), F.lit(0).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("output"))
    return events.unionByName(fix).unionByName(go)


def running(events: DataFrame) -> DataFrame:
    """Transcripts with a running step."""
    return latest(events).where("status = 'running'").select("transcript_id").distinct()


def running_tasks(spark: SparkSession, path: str) -> DataFrame:
    """The first state.json below path that says running; unreadable files are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "state.json").load(path)
    status = F.try_variant_get(F.try_parse_json(F.col("content").cast("string")), "$.pipeline_info.status", "string")
    return files.where(status == "running").select("path").orderBy("path").limit(1)


def state_json(events: DataFrame) -> DataFrame:
    """State documents: one JSON text for each transcript, made from its latest events."""
    s = latest(events)
    steps = F.map_from_entries(F.collect_list(F.struct("step", F.struct("status", "at", "output"))))
    done = F.sort_array(F.collect_set(F.when(F.col("status") == "completed", F.col("step"))))
    status = F.when(F.bool_or(F.col("status") == "failed"), "failed").when(F.bool_or(F.col("status") == "running"), "running").when(F.bool_and(F.col("status").isin("completed", "skipped")), "completed").otherwise("pending")
    rows = s.groupBy("transcript_id").agg(status.alias("status"), done.alias("completed_steps"), steps.alias("steps"))
    return rows.select("transcript_id", F.to_json(F.struct(F.struct("status").alias("pipeline_info"), "completed_steps", "steps")).alias("state"))

