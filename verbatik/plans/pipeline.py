"""The whole way of transcripts: punctuation gate, refinement, summary, translation, merging, subtitles.

Each stage is a table in a run's folder; a stage whose table is complete isn't made again, so a
run that broke off goes on where it stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatik.functions import text as tx
from verbatik.operators import punctuation, refine, subtitles, summary, translate
from verbatik.sources import segments as sg
from verbatik.sources.config import Config


class PipelineError(RuntimeError):
    """A stage that failed; details tell which, and what it had."""

    def __init__(self, message: str, details: dict | None = None):
        super().__init__(message)
        self.details = details or {}


@dataclass(frozen=True)
class Providers:
    """The models a run calls, each a function that workers can import or unpickle."""

    translate: translate.Provider
    summarize: Callable[[str, str], str] | None = None
    load_classifier: Callable[[], Callable[[str], list[dict]]] | None = None
    load_tokenizer: Callable[[], summary.Tokenizer] | None = None


class Stages:
    """Stage tables below a folder; complete ones are read, others made and written."""

    def __init__(self, spark: SparkSession, folder: str, resume: bool = True):
        self.spark, self.folder, self.resume = spark, folder.rstrip("/"), resume
        self.made: list[str] = []

    def complete(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not (self.resume and self.complete(name)):
            try:
                make().write.mode("overwrite").parquet(path)
            except Exception as e:
                raise PipelineError(f"stage {name} failed: {e}", {"stage": name, "made": list(self.made)}) from e
            self.made.append(name)
        return self.spark.read.parquet(path)


def transcribe_gate(stages: Stages, transcripts: DataFrame, config: Config, providers: Providers) -> DataFrame:
    """Transcripts, with punctuation restored where there is too little."""
    good, poor = punctuation.gate(transcripts, config.whisper.min_punctuation_ratio)
    rest = config.whisper.punctuation
    if not rest.enabled:
        bad = poor.limit(1).collect()
        if bad:
            raise PipelineError("punctuation ratio too low", {"transcript_id": bad[0].transcript_id, "ratio": bad[0].ratio})
        return sg.clean(good.drop("ratio"))
    load = providers.load_classifier or punctuation.mark_classifier
    restored = stages.table("01_punctuated", lambda: punctuation.restore(poor, load, rest.chunk_words))
    return punctuation.apply(transcripts, restored)


def _responses(stages: Stages) -> DataFrame | None:
    """The answers that earlier runs in this folder got, if any."""
    folder = stages.spark._jvm.org.apache.hadoop.fs.Path(f"{stages.folder}/05_responses")
    fs = folder.getFileSystem(stages.spark.sparkContext._jsc.hadoopConfiguration())
    if not stages.resume or not fs.exists(folder):
        return None
    parts = [str(f.getPath()) for f in fs.listStatus(folder) if fs.exists(stages.spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return stages.spark.read.parquet(*parts).select(*translate.RESPONSE) if parts else None


def run(spark: SparkSession, transcripts: DataFrame, folder: str, config: Config, providers: Providers, resume: bool = True, refining: bool = True) -> DataFrame:
    """Translated segments of all transcripts (transcript_id, text, segments); stage tables below folder.

    Writes refined segments with details of merges and splits, summaries, batches, every answer of the
    provider, translations, validation of each one, merged segments, the coverage of each transcript,
    and subtitles. A transcript of which an item can't be translated is in 05_failed only. Without
    `refining` segments are translated as they are.
    """
    stages = Stages(spark, folder, resume)
    ready = stages.table("00_transcripts", lambda: transcribe_gate(stages, transcripts, config, providers))
    raw = sg.explode_segments(ready.withColumn("segments", F.transform("segments", lambda s: s.withField("zh", F.lit(None).cast("string")))))
    stages.table("01_original_text", lambda: translate.text_counts(sg.to_transcripts(raw).select("transcript_id", "text")))
    if refining:
        cleaned = refine.cleaned(raw)
        stages.table("02_merge_details", lambda: refine.merge_details(cleaned))
        stages.table("02_split_details", lambda: refine.split_details(refine.merge_fixpoint(cleaned)))
        stages.table("02_statistics", lambda: refine.statistics(raw))
    refined = stages.table("02_refined", lambda: refine.refine(raw) if refining else raw.drop("zh"))
    items = stages.table("03_items", lambda: translate.to_items(refined))
    context = None
    batches = translate.batches(items, config.translate.batch_size)
    if config.summary.enabled:
        full = sg.to_transcripts(refined).select("transcript_id", "text")
        made = stages.table("04_summary", lambda: summary.summarize(full, providers.summarize, config.summary.chunk_max_input_tokens, config.summary.chunk_overlap_tokens, tokenizer=providers.load_tokenizer))
        batches, context = batches.join(made.select("transcript_id", "summary"), "transcript_id", "left"), F.coalesce("summary", F.lit(""))
    if config.translate.translation_prompt:
        batches = translate.prompts(batches, config.translate.translation_prompt, context)
    batches = stages.table("05_batches", lambda: batches)
    if not (resume and stages.complete("05_translations")):
        stamp = uuid.uuid4().hex

        def store(df: DataFrame, name: str) -> DataFrame:
            path = f"{stages.folder}/05_responses/{name}-{stamp}"
            df.write.parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        answers = translate.translate_batches(batches, providers.translate, config.translate.max_retries + 1, config.translate.retry_delay, _responses(stages), store)
        failed = stages.table("05_failed", lambda: answers.failed)
        stages.table("05_translations", lambda: answers.translations.join(failed.select("transcript_id").distinct(), "transcript_id", "left_anti"))
    translations, failed = stages.table("05_translations", list), stages.table("05_failed", list)
    good = translate.rekey(translate.translatable(refined)).join(failed.select("transcript_id").distinct(), "transcript_id", "left_anti")
    merged = stages.table("06_merged", lambda: translate.merge_translations(good, translations.withColumn("pos", F.col("index") - 1)))
    fr = tx.strip(F.col("text"))
    stages.table("07_validation", lambda: merged.select("transcript_id", "id", fr.alias("fr"), "zh", translate.is_valid_translation(F.col("zh"), fr).alias("valid"), translate.content_type(F.col("zh")).alias("kind")))
    stages.table("07_coverage", lambda: translate.coverage(merged))
    stages.table("08_subtitles", lambda: subtitles.documents(subtitles.cues(merged)))
    return sg.to_transcripts(merged, ("zh",))
