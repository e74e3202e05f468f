"""Queries over the test tables, one for each operator, and the SQL that gives the same rows.

Segments are made from documents by the same rule on both sides; SQL is written on its own, in
DuckDB's dialect, and shares only the character classes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatik.functions import text as tx
from verbatik.operators import punctuation, refine, state, subtitles, summary, translate
from verbatik.sources import segments as sg

WS, W = tx.WS, tx.W
_LOW, _HIGH = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TEMPLATE = "Translate.\n{context}\n---\n{segments}"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def seg(spark: SparkSession, d: str) -> DataFrame:
    return sg.document_segments(table(spark, d, "documents").select("doc_id", "text"))


def kept(spark: SparkSession, d: str) -> DataFrame:
    """Segments with text, ready to merge."""
    return refine.strip_leading(refine.drop_punctuation_only(refine.drop_empty(seg(spark, d))))


def items(spark: SparkSession, d: str) -> DataFrame:
    return translate.to_items(seg(spark, d))


def translations(spark: SparkSession, d: str) -> DataFrame:
    """Items with a stand-in translation: numbers, copies, blanks and Chinese, by a rule over the index."""
    k = F.pmod(F.col("index") + F.col("transcript_id"), F.lit(7))
    zh = F.when(k == 0, F.col("fr")).when(k == 1, F.lit("12, 5")).when(k == 2, F.lit("  ")).when(k == 3, F.translate("fr", _LOW, _HIGH)).otherwise(F.concat(F.lit("译"), F.col("fr")))
    return items(spark, d).withColumn("zh", zh)


def state_events(spark: SparkSession, d: str) -> DataFrame:
    """Step events from the events table: users are transcripts, ids pick step and status."""
    e = table(spark, d, "events")
    steps, statuses = F.array(*map(F.lit, state.STEPS)), F.array(*map(F.lit, ("pending", "running", "completed", "completed", "completed", "skipped", "failed")))
    return e.select(F.col("user_id").alias("transcript_id"), steps[F.pmod("event_id", F.lit(len(state.STEPS))).cast("int")].alias("step"), statuses[F.pmod("event_id", F.lit(7)).cast("int")].alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.lit(None).cast("string").alias("output"))


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Batches with a stand-in response each: sound, smart-quoted, wrapped, short, misnumbered, untranslated or broken."""
    b = translate.batches(items(spark, d))
    zh = lambda x: F.concat(F.lit("译"), x)
    answer = lambda n, f: F.to_json(F.transform(F.slice("items", 1, n), f))
    item = lambda x: F.struct(x["index"].alias("index"), zh(F.regexp_replace(x["fr"], r'["\\]', "")).alias("zh"))
    good = answer(F.size("items"), item)
    k = F.pmod(F.col("transcript_id") + F.col("batch_no") * 3, F.lit(8))
    raw = (
        F.when(k == 1, F.concat(F.lit("Here: "), good, F.lit(" done."))).when(k == 2, answer(F.size("items") - 1, item))
        .when(k == 3, answer(F.size("items"), lambda x: F.struct((x["index"] + 1).alias("index"), x["fr"].alias("zh")))).when(k == 4, F.lit("no list")).when(k == 5, F.replace(good, F.lit('"zh":"'), F.lit('"zh":“')))
        .when(k == 6, answer(F.size("items"), lambda x: F.struct(x["index"].alias("index"), F.lit(" ").alias("zh")))).when(k == 7, F.lit('{"index": 1}')).otherwise(good)
    )
    return b.withColumn("raw_response", raw)


def _provider(batch: dict) -> str:
    """Fails on batches of more than five items that hold a long text, so that batches get halved."""
    import json

    items = batch["items"]
    if len(items) > 5 and any(len(x["fr"]) > 300 for x in items):
        return "too long"
    return json.dumps([{"index": x["index"], "zh": "译" + x["fr"]} for x in items], ensure_ascii=False)


def _summarizer(kind: str, text: str) -> str:
    return kind + ": " + " ".join(text.split()[:20])


def q(columns: str, f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """f, with these columns of its result."""
    return lambda spark, d: f(spark, d).select(*columns.split())


def _norm_words(spark, d):
    return seg(spark, d).select("transcript_id", "pos", F.posexplode(tx.words(F.col("text"))).alias("i", "w")).select("transcript_id", "pos", "i", tx.sanitize_word(F.col("w")).alias("bare"), tx.normalize_word(F.col("w")).alias("norm"))


def _transcripts(spark, d):
    return sg.to_transcripts(seg(spark, d))


def _resume(spark, d):
    return state.resume_point(state_events(spark, d))


def _merge_k(spark, d, passes=3):
    out = kept(spark, d)
    for _ in range(passes):
        out = refine.merge_pass(out)
    return out


def _srt(spark, d):
    t = translations(spark, d).withColumn("pos", F.col("n") - 1)
    return subtitles.cues(translate.merge_translations(translate.rekey(translate.translatable(seg(spark, d))), t))


def _cached(spark, d):
    r = responses(spark, d).withColumn("attempts", F.explode(F.sequence(F.lit(0), F.lit(2))))
    raw = F.when(F.col("attempts") == 2, F.lit("[]")).otherwise(F.col("raw_response"))
    r = r.withColumn("raw_response", raw)
    r = r.withColumn("written_at", F.col("attempts")).withColumn("name", F.concat("batch_id", F.lit("_retry_"), F.col("attempts").cast("string")))
    return translate.cached_responses(r).select("transcript_id", "batch_id", "name", F.size("parsed.items").alias("n"))


def _outputs(spark, d):
    """State events whose completed steps name a file; and the files that are there, two of three."""
    name = F.concat(F.col("transcript_id").cast("string"), F.lit("/"), F.col("step"), F.lit(".json"))
    events = state_events(spark, d).withColumn("output", F.when(F.col("status") == "completed", name))
    files = events.where("output is not null and (transcript_id + seq) % 3 > 0").select(F.col("output").alias("path")).distinct()
    return events, files


def _round_trip(spark, d):
    """Segments as one JSON file a transcript in the shared folder, read again and taken apart."""
    from verbatik.plans.tables import stage_dir

    path = f"{stage_dir(spark)}/transcripts-{uuid.uuid4().hex}"
    rows = sg.to_transcripts(seg(spark, d)).select("transcript_id", "text", "segments")
    rows.select(F.to_json(F.struct("text", "segments")).alias("value"), "transcript_id").repartition("transcript_id").write.partitionBy("transcript_id").option("maxRecordsPerFile", 1).text(path)
    back = sg.explode_segments(sg.read_transcripts(spark, path))
    number = F.regexp_extract("transcript_id", "transcript_id=(-?[0-9]+)/", 1).cast("bigint")
    return back.select(number.alias("transcript_id"), "pos", "id", "start_s", "end_s", "text")


def _media(spark, d):
    return table(spark, d, "pages").select("page_id", F.to_json(F.struct(F.col("url").alias("title"), (F.col("page_id") * 1.5).alias("duration"), F.array(F.struct(F.lit("a").alias("format_id"), F.lit("none").alias("vcodec")), F.struct(F.col("page_id").cast("string").alias("format_id"), F.when(F.col("page_id") % 2 == 0, "h264").otherwise("none").alias("vcodec"))).alias("formats"))).alias("info"))


def _predictions(spark, d):
    """Word spans of segments, and marks predicted for stretches of nine characters, every seven."""
    spans = seg(spark, d).select("transcript_id", "pos", "text").withColumn("w", tx.words(F.col("text")))
    key = (F.col("transcript_id") * 100_000 + F.col("pos")).alias("transcript_id")
    ends = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.length(F.array_join(F.slice("w", F.lit(1), i), " ")))
    spans = spans.where((F.size("w") > 0) & (F.size("w") <= 60)).withColumn("e", ends)
    words = spans.select(key, F.posexplode("e").alias("word", "w_end"), "w").select("transcript_id", "word", (F.col("w_end") - F.length(F.get("w", F.col("word")))).alias("w_start"), "w_end")
    starts = spans.select(key, F.posexplode(F.sequence(F.lit(0), F.element_at("e", -1) - 1, F.lit(7))).alias("n", "start"))
    marks = F.array(*map(F.lit, (".", ",", "?", "-", ":", "LABEL_,", "LABEL_0")))
    return words, starts.select("transcript_id", "n", "start", (F.col("start") + 9).alias("end"), tx.normalize_label(F.get(marks, F.pmod("n", F.lit(7)))).alias("label"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "state_initial": lambda s, d: state.initial(state_events(s, d).select("transcript_id").distinct(), True).select("transcript_id", "step", "status"),
    "missing_outputs": lambda s, d: state.missing_outputs(*_outputs(s, d)),
    "resume_with_files": lambda s, d: state.resume_point(*_outputs(s, d)),
    "resume_prepared": lambda s, d: state.latest(state.prepare_resume(state_events(s, d), "2030-01-01", summary=False)).select("transcript_id", "step", "status"),
    "running_transcripts": lambda s, d: state.running(state_events(s, d)),
    "text_counts": lambda s, d: translate.text_counts(seg(s, d)).select("transcript_id", "pos", "n_chars_text", "n_words_text"),
    "transcript_files": _round_trip,
    "transcript_clean": lambda s, d: sg.explode_segments(sg.clean(sg.to_transcripts(seg(s, d).withColumn("zh", F.lit("x")), ("zh",))).withColumn("segments", F.transform("segments", lambda x: x.withField("zh", F.lit(None).cast("string"))))).select("transcript_id", "pos", "text", "zh"),
    "video_info": lambda s, d: sg.video_formats(_media(s, d)).select("title", "duration", F.size("formats").alias("formats")),
    "newest_file": lambda s, d: sg.newest(state_events(s, d).select(F.concat(F.lit("f"), F.col("seq").cast("string")).alias("path"), F.col("at").alias("modificationTime"))),
    "word_marks": lambda s, d: punctuation.overlap(*_predictions(s, d)),
    "split_parts": lambda s, d: refine.split_details(seg(s, d)).select("transcript_id", "pos", "id", "text", F.size("parts").alias("n"), F.array_join(F.transform("parts", lambda x: x["text"]), "|").alias("texts")),
    "fallback_summary": lambda s, d: summary.summarize(_transcripts(s, d), None),
    "validation": lambda s, d: translations(s, d).select("transcript_id", F.col("index"), translate.is_valid_translation(F.col("zh"), F.col("fr")).alias("valid")).groupBy("transcript_id").agg(F.count(F.lit(1)).alias("items"), F.sum(F.col("valid").cast("bigint")).alias("valid")),
    "seg_scan": q("transcript_id pos id start_s end_s text", seg),
    "turn_scan": q("transcript_id pos start_s end_s text", lambda s, d: sg.conversation_segments(table(s, d, "conversations"))),
    "drop_empty": q("transcript_id pos text", lambda s, d: refine.drop_empty(seg(s, d))),
    "drop_punct_only": q("transcript_id pos text", lambda s, d: refine.drop_punctuation_only(refine.drop_empty(seg(s, d)))),
    "strip_leading": q("transcript_id pos text", lambda s, d: kept(s, d)),
    "drop_duplicates4": q("transcript_id pos text", lambda s, d: refine.drop_duplicates(kept(s, d))),
    "bang_spacing": q("transcript_id pos fixed", lambda s, d: seg(s, d).withColumn("fixed", tx.strip_space_before_marks(F.col("text")))),
    "punct_normalise": q("transcript_id pos fixed", lambda s, d: seg(s, d).withColumn("fixed", tx.normalize_punctuation(tx.strip_space_before_marks(F.col("text"))))),
    "repeated_words": q("transcript_id pos text n_words_removed", lambda s, d: refine.remove_repeated_words(seg(s, d))),
    "repetitive_runs": q("transcript_id pos text n_runs_removed", lambda s, d: refine.remove_word_runs(seg(s, d))),
    "char_patterns": q("transcript_id pos text", lambda s, d: refine.remove_char_patterns(seg(s, d))),
    "merge_edges": q("transcript_id pos merge", lambda s, d: refine.merge_edges(kept(s, d))),
    "merge_pass1": q("transcript_id pos start_s end_s text", lambda s, d: refine.merge_pass(kept(s, d))),
    "merge_pass3": q("transcript_id pos start_s end_s text", _merge_k),
    "merge_fixpoint": q("transcript_id pos start_s end_s text", lambda s, d: refine.merge_fixpoint(kept(s, d))),
    "merge_report": lambda s, d: refine.merge_report(kept(s, d)),
    "split_sentences": lambda s, d: refine.with_sentences(seg(s, d)).select("transcript_id", "pos", F.posexplode("sentences").alias("i", "sentence")),
    "split_emit": q("transcript_id pos part n_parts id start_s end_s text", lambda s, d: refine.split_blocks(seg(s, d))),
    "split_report": lambda s, d: refine.split_report(seg(s, d)),
    "rebuild_text": q("transcript_id text", _transcripts),
    "refine_flagship": lambda s, d: refine.refine(seg(s, d)),
    "refine_stats": lambda s, d: refine.statistics(seg(s, d)),
    "translation_filter": q("transcript_id pos text", lambda s, d: translate.translatable(seg(s, d))),
    "ordered_rekey": q("transcript_id pos id text", lambda s, d: translate.rekey(refine.split_blocks(seg(s, d)).withColumn("pos", F.col("pos") * 10_000 + F.col("part")))),
    "translation_format": q("transcript_id index fr", items),
    "batches": lambda s, d: translate.batches(items(s, d)).select("transcript_id", "batch_no", "batch_id", F.size("items").alias("n"), F.element_at("items", 1)["index"].alias("first"), "context", "retry_context"),
    "prompts": lambda s, d: translate.prompts(translate.batches(items(s, d)), TEMPLATE).select("transcript_id", "batch_no", "prompt"),
    "batch_halves": lambda s, d: translate.halves(translate.batches(items(s, d))).select("transcript_id", "batch_id", F.size("items").alias("n")),
    "overlap_chunks": lambda s, d: summary.chunks(table(s, d, "documents").select(F.col("doc_id").alias("transcript_id"), "text"), "text", 100, 15),
    "valid_translation": lambda s, d: translations(s, d).select("transcript_id", "index", translate.is_valid_translation(F.col("zh"), F.col("fr")).alias("valid"), translate.content_type(F.col("zh")).alias("kind")),
    "all_valid": lambda s, d: translate.all_valid(translations(s, d)),
    "response_validate": q("transcript_id batch_no error_code error_pos", lambda s, d: translate.validate(responses(s, d))),
    "cached_response": _cached,
    "batch_translate": lambda s, d: translate.translate_batches(translate.batches(items(s, d)), _provider).translations,
    "merge_translations": q("transcript_id pos id text zh", lambda s, d: translate.merge_translations(translate.rekey(translate.translatable(seg(s, d))), translations(s, d).where("index % 5 != 3").withColumn("pos", F.col("n") - 1))),
    "coverage": lambda s, d: translate.coverage(translations(s, d)),
    "summaries": lambda s, d: summary.summarize(_transcripts(s, d), _summarizer, 300, 40),
    "srt_timestamps": lambda s, d: seg(s, d).select("transcript_id", "pos", tx.timestamp(F.col("start_s")).alias("start_at"), tx.timestamp(F.col("end_s")).alias("end_at")),
    "srt_cues": _srt,
    "srt_document": lambda s, d: subtitles.documents(_srt(s, d)),
    "punct_ratio": lambda s, d: table(s, d, "documents").select(F.col("doc_id").alias("transcript_id"), tx.punctuation_ratio(F.coalesce("text", F.lit(""))).alias("ratio")),
    "ratio_gate": lambda s, d: (lambda g: g[0].select("transcript_id", F.lit(True).alias("accepted")).union(g[1].select("transcript_id", F.lit(False))))(punctuation.gate(table(s, d, "documents").select(F.col("doc_id").alias("transcript_id"), "text"), 0.012)),
    "word_norm": _norm_words,
    "word_extract": lambda s, d: punctuation.words(seg(s, d)),
    "token_stream": lambda s, d: punctuation.tokens(seg(s, d)),
    "punct_rebuild": lambda s, d: punctuation.restore(_transcripts(s, d), punctuation.mark_classifier, 60).select("transcript_id", "punctuated_text", F.size("segments").alias("n"), "matched_word_count", "unmatched_output_words", F.size("chunks").alias("n_chunks")),
    "resume_point": _resume,
    "step_status": q("transcript_id step status", lambda s, d: state.latest(state_events(s, d))),
    "batch_status_latest": lambda s, d: state.batch_counts(state_events(s, d).withColumn("batch_no", F.col("seq") % 5)),
    "url_classify": lambda s, d: table(s, d, "pages").select("page_id", sg.input_kind(F.col("url")).alias("kind"), sg.input_kind(F.concat(F.lit("/in/"), F.regexp_replace("url", "[^a-z0-9]", ""), F.when(F.col("page_id") % 3 == 0, ".MP3").when(F.col("page_id") % 3 == 1, ".mkv").otherwise(""))).alias("file_kind")),
    "file_titles": lambda s, d: table(s, d, "documents").select("doc_id", tx.file_title(F.split(F.coalesce("text", F.lit("")), "\n")[0]).alias("title")),
}

# ---- SQL ----

_STRIP = lambda x: f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"
_WORDS = lambda x: f"list_filter(regexp_split_to_array({x}, '[{WS}]+'), lambda w: w <> '')"
_SEG = f"""
lines AS (
    SELECT doc_id AS transcript_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), noisy AS (
    SELECT transcript_id, pos, CASE (transcript_id * 5 + pos * 3) % 17
        WHEN 0 THEN ' ' || line WHEN 1 THEN line || ' !' WHEN 2 THEN '...' || line WHEN 3 THEN line || '!!!! ??' WHEN 4 THEN '... ... ...'
        WHEN 5 THEN '  ' WHEN 6 THEN concat_ws(' ', f, f, f, f, f) WHEN 7 THEN '?' WHEN 8 THEN '» ' || line WHEN 9 THEN line || ' »'
        WHEN 10 THEN 'Merci.' WHEN 11 THEN '3, 14' ELSE line END AS text
    FROM (SELECT *, string_split(line, ' ')[1] AS f FROM lines)
), timed AS (
    SELECT *, 350 * greatest(len({_WORDS('text')}), 1)::BIGINT AS dur, 50 * ((transcript_id * 7 + pos * 3) % 5) AS gap FROM noisy
), summed AS (
    SELECT *, (sum(dur + gap) OVER (PARTITION BY transcript_id ORDER BY pos) - gap)::BIGINT AS upto FROM timed
), seg AS (
    SELECT transcript_id, pos, pos::DOUBLE AS id, greatest(upto - dur - CASE step WHEN 0 THEN 1500 ELSE 0 END, 0) / 1000.0::DOUBLE AS start_s,
           greatest(upto - CASE step WHEN 0 THEN 1500 WHEN 9 THEN dur - 40 ELSE 0 END, 0) / 1000.0::DOUBLE AS end_s, text
    FROM (SELECT *, (transcript_id * 11 + pos * 7) % 23 AS step FROM summed)
), filled AS (
    SELECT * FROM seg WHERE {_STRIP('text')} <> ''
), spoken AS (
    SELECT * FROM filled WHERE NOT regexp_matches({_STRIP('text')}, '^[^{W}{WS}]+$')
), kept AS (
    SELECT * REPLACE (CASE WHEN starts_with(text, ' ') THEN regexp_replace(text, '^[{WS}]+', '') ELSE text END AS text) FROM spoken
), usable AS (
    SELECT * FROM seg WHERE {_STRIP('text')} <> '' AND NOT starts_with({_STRIP('text')}, '...')
), rekeyed AS (
    SELECT * REPLACE (n::DOUBLE AS id, n - 1 AS pos) FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY id, pos) AS n FROM usable)
), items AS (
    SELECT transcript_id, n::INTEGER AS n, n AS index, {_STRIP('text')} AS fr FROM rekeyed
), trans AS (
    SELECT *, CASE (index + transcript_id) % 7 WHEN 0 THEN fr WHEN 1 THEN '12, 5' WHEN 2 THEN '  ' WHEN 3 THEN translate(fr, '{_LOW}', '{_HIGH}') ELSE '译' || fr END AS zh FROM items
)"""


def _edges(source: str, name: str) -> str:
    """CTE of a segment table with the merge rule's verdict e (0 or 1) on each row and the next."""
    return f"""{name} AS (
    SELECT *, CASE WHEN ne - start_s < 8.0 AND (CASE WHEN end_s - start_s < 2.0 THEN 2 ELSE 0 END)
            + (CASE WHEN {_STRIP('text')} <> '' AND right({_STRIP('text')}, 1) NOT IN ('.', '!', '?', '。', '！', '？', '…') THEN 1 ELSE 0 END)
            + (CASE WHEN len({_WORDS('text')}) < 5 THEN 1 ELSE 0 END) + (CASE WHEN ns - end_s < 0.1 THEN 1 ELSE 0 END) >= 3 THEN 1 ELSE 0 END AS e
    FROM (SELECT *, lead(start_s) OVER w AS ns, lead(end_s) OVER w AS ne, lead(text) OVER w AS nt FROM {source} WINDOW w AS (PARTITION BY transcript_id ORDER BY pos)))"""


def _pass(source: str, name: str) -> str:
    """CTEs of one merge pass over source."""
    return f"""{_edges(source, name + 'e')}, {name}g AS (
    SELECT *, sum(1 - e) OVER (PARTITION BY transcript_id ORDER BY pos) - (1 - e) AS g FROM {name}e
), {name}k AS (
    SELECT *, (e = 1 AND sum(e) OVER (PARTITION BY transcript_id, g ORDER BY pos) % 2 = 1) AS head FROM {name}g
), {name} AS (
    SELECT transcript_id, pos, id, start_s, CASE WHEN head THEN ne ELSE end_s END AS end_s,
           CASE WHEN head THEN (CASE WHEN starts_with(text, ' ') THEN ' ' ELSE '' END) || {_STRIP('text')} || ' ' || {_STRIP('nt')} ELSE text END AS text
    FROM (SELECT *, coalesce(lag(head) OVER (PARTITION BY transcript_id ORDER BY pos), false) AS gone FROM {name}k) WHERE NOT gone
)"""


#: A word between white space without edge marks, lower-cased.
_KEY = lambda x: f"lower(regexp_replace({x}, '^[.,!?;:]+|[.,!?;:]+$', '', 'g'))"
_MARK = f"[^{W}{WS}]"


def _punct(source: str, name: str) -> str:
    """CTEs of source with its marks normalised. Where a rule repeats what it found, every run of marks in the text is tried in turn."""
    same = f"regexp_escape(g) || '(?:[{WS}]+' || regexp_escape(g) || '){{2,}}'"
    return f"""{name}0 AS (
    SELECT *, regexp_replace(regexp_replace(regexp_replace(text, '[{WS}]+([!?])', '\\1', 'g'), '[.][.][.](?:[{WS}]+[.][.][.])+', '...', 'g'), '[.]{{4,}}', '...', 'g') AS t FROM {source}
), {name}1 AS (
    SELECT *, list_reduce(list_distinct(regexp_extract_all(t, '{_MARK}+')), lambda acc, g: regexp_replace(acc, {same}, replace(g, chr(92), chr(92) || chr(92)), 'g'), t) AS u FROM {name}0
), {name}2 AS (
    SELECT *, list_reduce(list_distinct(regexp_extract_all(u, '[^{W}{WS}.]')), lambda acc, g: regexp_replace(acc, regexp_escape(g) || '{{3,}}', replace(g, chr(92), chr(92) || chr(92)), 'g'), u) AS v FROM {name}1
), {name} AS (SELECT * EXCLUDE (t, u, v) REPLACE ({_STRIP(f"regexp_replace(v, '[{WS}]{{2,}}', ' ', 'g')")} AS text) FROM {name}2)"""


def _repeated(source: str, name: str) -> str:
    """CTEs of source with frequent words once; n_words_removed."""
    return f"""{name}w AS (SELECT transcript_id, pos, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT transcript_id, pos, {_WORDS('text')} AS l FROM {source})),
    {name}c AS (SELECT *, count(*) OVER (PARTITION BY transcript_id, pos, k) AS n, row_number() OVER (PARTITION BY transcript_id, pos, k ORDER BY i) AS r FROM (SELECT *, {_KEY('w')} AS k FROM {name}w)),
    {name}a AS (SELECT transcript_id, pos, string_agg(w, ' ' ORDER BY i) FILTER (n < 4 OR r = 1) AS new, count(*) FILTER (n >= 4 AND r > 1) AS removed FROM {name}c GROUP BY transcript_id, pos),
    {name} AS (SELECT s.* REPLACE (CASE WHEN removed > 0 THEN new ELSE text END AS text), coalesce(removed, 0)::INTEGER AS n_words_removed FROM {source} s LEFT JOIN {name}a USING (transcript_id, pos))"""


def _runs(source: str, name: str) -> str:
    """CTEs of source without near-consecutive runs of a word; n_runs_removed. Only texts with a key more than five times are gone through, a run at a step."""
    m = "coalesce(list_position(list_transform(k[i + 3 :], lambda y: y <> k[i]), true) - 1, greatest(len(k) - i - 2, 0))"
    same = f"1 + coalesce(k[i + 1] = k[i], false)::INTEGER + coalesce(k[i + 2] = k[i], false)::INTEGER + {m}"
    near = "k[i] <> '' AND k[i + 3] = k[i] AND k[i + 4] = k[i]"
    return f"""{name}l AS (
    SELECT transcript_id, pos, w, list_transform(w, lambda x: lower(trim(x, ' .!?,:;'))) AS k FROM (SELECT transcript_id, pos, {_WORDS('text')} AS w FROM {source})
), {name}f AS (
    SELECT * FROM {name}l WHERE list_max(map_values(list_histogram(k))) > 5
), {name}r AS (
    SELECT transcript_id, pos, w, k, 1::BIGINT AS here, 0 AS gone FROM {name}f
    UNION ALL
    SELECT transcript_id, pos, w[: i - 1] || w[i + 3 + {m} :], k[: i - 1] || k[i + 3 + {m} :], i, gone + 1
    FROM (SELECT *, list_filter(list_filter(range(here, len(k) + 1), lambda i: {near}), lambda i: {same} > 5)[1] AS i FROM {name}r) WHERE i IS NOT NULL
), {name}e AS (
    SELECT transcript_id, pos, max(gone) AS gone, arg_max(w, gone) AS w FROM {name}r GROUP BY transcript_id, pos
), {name}n AS (
    SELECT s.* REPLACE (CASE WHEN gone > 0 THEN array_to_string(e.w, ' ') ELSE text END AS text), coalesce(gone, 0)::INTEGER AS n_runs_removed FROM {source} s LEFT JOIN {name}e e USING (transcript_id, pos)
), {name} AS (SELECT * FROM {name}n WHERE {_STRIP('text')} <> '')"""


def _patterns(source: str, name: str) -> str:
    """CTEs of source without patterns of 2 to 15 characters that come five times or more; has_pattern.

    s_p is whether a character equals the one p places on, r_p for how many characters from here that
    holds; a pattern of p characters begins where it holds for 4 p characters.
    """
    lags = ", ".join(f"coalesce(c = lead(c, {p}) OVER o, false) AS s{p}" for p in range(2, 16))
    runs = ", ".join(f"min(CASE WHEN NOT s{p} THEN i END) OVER b - i AS r{p}" for p in range(2, 16))
    first = " ".join(f"WHEN r{p} >= {4 * p} THEN {p}" for p in range(2, 16))
    run = " ".join(f"WHEN r{p} >= {4 * p} THEN r{p}" for p in range(2, 16))
    return f"""{name}c AS (
    SELECT transcript_id, pos, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (SELECT transcript_id, pos, string_split(text, '') AS l FROM {source})
), {name}s AS (
    SELECT transcript_id, pos, i, {lags} FROM {name}c WINDOW o AS (PARTITION BY transcript_id, pos ORDER BY i)
), {name}h AS (
    SELECT transcript_id, pos, i, {runs} FROM {name}s WINDOW b AS (PARTITION BY transcript_id, pos ORDER BY i DESC)
), {name}p AS (
    SELECT * FROM (SELECT transcript_id, pos, i, CASE {first} END AS p, CASE {run} END AS run FROM {name}h) WHERE p IS NOT NULL
), {name}r AS (
    SELECT transcript_id, pos, 1::BIGINT AS here, 0::BIGINT AS lo FROM (SELECT DISTINCT transcript_id, pos FROM {name}p)
    UNION ALL
    SELECT r.transcript_id, r.pos, min_by(n.i + n.p * (1 + n.run // n.p), n.i), min(n.i) FROM {name}r r JOIN {name}p n ON n.transcript_id = r.transcript_id AND n.pos = r.pos AND n.i >= r.here GROUP BY r.transcript_id, r.pos
), {name}g AS (
    SELECT transcript_id, pos, list(lo ORDER BY lo) AS los, list(here ORDER BY lo) AS ends FROM {name}r GROUP BY transcript_id, pos
), {name}t AS (
    SELECT s.*, los IS NOT NULL AS has_pattern, CASE WHEN los IS NULL THEN text ELSE
        {_STRIP(f"regexp_replace(array_to_string(list_transform(range(1, len(los) + 1), lambda n: substring(text, ends[n], coalesce(los[n + 1], length(text) + 1) - ends[n])), ''), '[{WS}]+', ' ', 'g')")} END AS new
    FROM {source} s LEFT JOIN {name}g USING (transcript_id, pos)
), {name} AS (SELECT * EXCLUDE (new) REPLACE (new AS text) FROM {name}t WHERE {_STRIP('new')} <> '')"""


def _sql(select: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join((_SEG.strip(), *ctes)) + "\n" + select


def _passes(n: int, source: str = "kept") -> list[str]:
    return [_pass(source if k == 0 else f"m{k}", f"m{k + 1}") for k in range(n)]


_STEPS = "['" + "', '".join(state.STEPS) + "']"
_EVENTS = f"""ev AS (
    SELECT user_id AS transcript_id, {_STEPS}[event_id % 8 + 1] AS step,
           ['pending', 'running', 'completed', 'completed', 'completed', 'skipped', 'failed'][event_id % 7 + 1] AS status, ts, event_id AS seq
    FROM events
), cur AS (SELECT transcript_id, step, status FROM ev QUALIFY row_number() OVER (PARTITION BY transcript_id, step ORDER BY ts DESC, seq DESC) = 1)"""
_VALID = f"""CASE WHEN b = '' THEN false WHEN regexp_matches(b, '[\\x{{4e00}}-\\x{{9fff}}]') THEN b <> fr WHEN regexp_matches(b, '^[\\p{{Nd}}{WS},.\\-:;]+$') THEN true
    WHEN len({_WORDS('b')}) <= 3 AND lower(b) = lower(fr) THEN true ELSE lower(b) <> lower(fr) END"""
_KIND = f"""CASE WHEN regexp_matches(b, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 'Chinese' WHEN regexp_matches(b, '^[\\p{{Nd}}{WS},.\\-:;]+$') THEN 'Numbers-only'
    WHEN len({_WORDS('b')}) <= 3 THEN 'Name/Expression' ELSE 'Other' END"""
_TIME = lambda x: f"printf('%02d:%02d:%02d,%03d', floor({x})::BIGINT // 3600, (floor({x})::BIGINT % 3600) // 60, floor({x})::BIGINT % 60, round_even(({x} % 1.0) * 1000, 0)::BIGINT)"
_CUES = f"""cues AS (
    SELECT r.transcript_id, row_number() OVER (PARTITION BY r.transcript_id ORDER BY r.pos)::INTEGER AS n, r.start_s, r.end_s, {_STRIP('r.text')} AS t, {_STRIP("coalesce(z.zh, '')")} AS z
    FROM rekeyed r LEFT JOIN trans z ON z.transcript_id = r.transcript_id AND z.index = r.id
), cue AS (
    SELECT transcript_id, n, n || chr(10) || {_TIME('start_s')} || ' --> ' || {_TIME('end_s')} || chr(10) || t || CASE WHEN z <> '' THEN chr(10) || z ELSE '' END || chr(10) AS cue FROM cues
)"""
_BATCH = """b0 AS (SELECT *, ((n - 1) // 10)::INTEGER AS batch_no FROM items), b AS (
    SELECT transcript_id, batch_no, printf('batch_%02d_segments_%03d_%03d', batch_no + 1, min(n), max(n)) AS batch_id, count(*)::INTEGER AS n, min(index) AS first,
           coalesce(string_agg(fr, ' ' ORDER BY index) FILTER (index < last), '') AS retry_context
    FROM (SELECT *, max(index) OVER (PARTITION BY transcript_id, batch_no) AS last FROM b0) GROUP BY transcript_id, batch_no
), bc AS (
    SELECT b.*, coalesce((SELECT string_agg(i.fr, ' ' ORDER BY i.index) FROM items i WHERE i.transcript_id = b.transcript_id AND i.index < b.first AND i.index >= b.first - 3), '') AS context FROM b
)"""
_SENT = f"""s0 AS (
    SELECT *, {_STRIP('text')} AS t FROM blocks
), s1 AS (
    SELECT *, starts_with(t, '»') AS quoted, CASE WHEN starts_with(t, '»') THEN {_STRIP('substr(t, 2)')} ELSE t END AS body FROM s0
), s2 AS (
    SELECT *, list_filter(list_transform(regexp_extract_all(body, '([^.!?»]*[.!?»])', 1), lambda x: {_STRIP('x')}), lambda x: x <> '') AS raw FROM s1
), s3 AS (
    SELECT transcript_id, pos, i, x, quoted, count(*) FILTER (x <> '»') OVER (PARTITION BY transcript_id, pos ORDER BY i) AS k
    FROM (SELECT transcript_id, pos, quoted, unnest(raw) AS x, generate_subscripts(raw, 1) AS i FROM s2)
), s4 AS (
    SELECT transcript_id, pos, (k - 1)::INTEGER AS i, (CASE WHEN k = 1 AND bool_or(quoted) THEN '» ' ELSE '' END) || string_agg(x, ' ' ORDER BY i) AS sentence
    FROM s3 WHERE k > 0 GROUP BY transcript_id, pos, k
), s5 AS (
    SELECT transcript_id, pos, count(*) AS n, bool_and(len({_WORDS('sentence')}) > 5) AS long FROM s4 GROUP BY transcript_id, pos
), s6 AS (
    SELECT s1.*, coalesce(n, 0) AS n, coalesce(n > 1 AND (long OR (contains(body, '»') AND n > 2)), false) AS cut FROM s1 LEFT JOIN s5 USING (transcript_id, pos)
), s7 AS (
    SELECT transcript_id, pos, 0 AS part, 1 AS n_parts, id, start_s, end_s, text FROM s6 WHERE NOT cut
    UNION ALL
    SELECT transcript_id, pos, s4.i AS part, n::INTEGER, id + s4.i * 0.1::DOUBLE, start_s + (end_s - start_s) * s4.i / n, start_s + (end_s - start_s) * (s4.i + 1) / n,
           CASE WHEN s4.i > 0 THEN ' ' || sentence ELSE sentence END
    FROM s6 JOIN s4 USING (transcript_id, pos) WHERE cut
)"""

_BLOCKS = "blocks AS (SELECT * FROM seg)"
#: All steps before splitting, of which blocks are the result; single is what a transcript's own copies leave.
_CLEAN = (
    f"single AS (SELECT * FROM kept QUALIFY count(*) OVER (PARTITION BY transcript_id, lower({_STRIP('text')})) < 4)", _punct("single", "marked"), _repeated("marked", "once"), _runs("once", "steady"), _patterns("steady", "plain"),
    *_passes(8, "plain"), "blocks AS (SELECT * FROM m8)", _SENT,
)
_RESPONSE = "(transcript_id + batch_no * 3) % 8"
_PER = lambda source, *aggregates: f"(SELECT transcript_id, {', '.join(aggregates)} FROM {source} GROUP BY transcript_id)"

ORACLE_SQL: dict[str, str] = {
    "punct_normalise": _sql("SELECT transcript_id, pos, text AS fixed FROM marked", _punct("seg", "marked")),
    "repetitive_runs": _sql("SELECT transcript_id, pos, text, n_runs_removed FROM steady", _runs("seg", "steady")),
    "char_patterns": _sql("SELECT transcript_id, pos, text FROM plain", _patterns("seg", "plain")),
    "merge_report": _sql("SELECT transcript_id, a - b AS merges, 2 * (a - b) AS original_segments, a - b AS net_reduction FROM (SELECT transcript_id, count(*) AS a FROM kept GROUP BY transcript_id) JOIN (SELECT transcript_id, count(*) AS b FROM m8 GROUP BY transcript_id) USING (transcript_id) WHERE a > b", *_passes(8)),
    "refine_flagship": _sql("SELECT transcript_id, (row_number() OVER (PARTITION BY transcript_id ORDER BY pos, part) - 1)::INTEGER AS pos, id, start_s, end_s, text FROM s7", *_CLEAN),
    "refine_stats": _sql(f"""SELECT transcript_id, COLUMNS(* EXCLUDE (transcript_id))::BIGINT FROM (
        SELECT t.transcript_id, coalesce(punctuation_fixed, 0) AS punctuation_fixed, coalesce(b - c, 0) AS segments_merged, coalesce(segments_split, 0) AS segments_split, empty_segments_removed,
            coalesce(runs + n4 - coalesce(n5, 0) + coalesce(patterns, 0), 0) AS repetitive_patterns_removed, coalesce(leading_spaces_removed, 0) AS leading_spaces_removed, coalesce(n2 - coalesce(n3, 0), 0) AS duplicate_segments_removed,
            coalesce(repeated_words_removed, 0) AS repeated_words_removed, total_input_segments - empty_segments_removed - coalesce(n2, 0) AS punctuation_only_segments_removed, total_input_segments, coalesce(total_output_segments, 0) AS total_output_segments
        FROM {_PER('seg', 'count(*) AS total_input_segments', f"count(*) FILTER ({_STRIP('text')} = '') AS empty_segments_removed")} t
        LEFT JOIN {_PER('spoken', 'count(*) AS n2', "count(*) FILTER (starts_with(text, ' ')) AS leading_spaces_removed")} USING (transcript_id)
        LEFT JOIN {_PER('single JOIN marked m USING (transcript_id, pos)', 'count(*) AS n3', 'count(*) FILTER (single.text <> m.text) AS punctuation_fixed')} USING (transcript_id)
        LEFT JOIN {_PER('once', 'count(*) AS n4', 'sum(n_words_removed) AS repeated_words_removed')} USING (transcript_id)
        LEFT JOIN {_PER('steadyn', 'sum(n_runs_removed) AS runs')} USING (transcript_id) LEFT JOIN {_PER('steady', 'count(*) AS n5')} USING (transcript_id)
        LEFT JOIN {_PER('plaint', 'count(*) FILTER (has_pattern) AS patterns')} USING (transcript_id) LEFT JOIN {_PER('plain', 'count(*) AS b')} USING (transcript_id)
        LEFT JOIN {_PER('m8', 'count(*) AS c')} USING (transcript_id) LEFT JOIN {_PER('s7', 'count(*) AS total_output_segments', 'count(*) FILTER (part = 0 AND n_parts > 1) AS segments_split')} USING (transcript_id))""", *_CLEAN),
    "prompts": _sql("""SELECT transcript_id, batch_no, 'Translate.' || chr(10) || context || chr(10) || '---' || chr(10) || (SELECT to_json(list({'index': i.index, 'fr': i.fr} ORDER BY i.index)) FROM b0 i WHERE i.transcript_id = bc.transcript_id AND i.batch_no = bc.batch_no) AS prompt FROM bc""", _BATCH),
    "response_validate": _sql(f"""SELECT transcript_id, batch_no, CASE {_RESPONSE} WHEN 2 THEN 'count_mismatch' WHEN 3 THEN 'index_mismatch' WHEN 4 THEN 'no_json' WHEN 6 THEN 'empty_translation' WHEN 7 THEN 'not_a_list' END AS error_code,
        CASE WHEN {_RESPONSE} IN (3, 6) THEN 0 END AS error_pos FROM b""", _BATCH),
    "cached_response": _sql(f"SELECT transcript_id, batch_id, batch_id || '_retry_1' AS name, n FROM b WHERE {_RESPONSE} IN (0, 1, 5)", _BATCH),
    "batch_translate": _sql("SELECT transcript_id, index, '译' || fr AS zh FROM items"),
    "summaries": _sql(f"""SELECT transcript_id, CASE WHEN n <= 300 THEN 'summary: ' || array_to_string(w[1:20], ' ') WHEN 21 * len(s) > 300 THEN 'reduce: chunk: ' || array_to_string(w[1:19], ' ')
            ELSE array_to_string(list_transform(s, lambda x: 'chunk: ' || array_to_string(w[x + 1 : x + 20], ' ')), chr(10) || chr(10)) END AS summary,
        CASE WHEN n <= 300 THEN 'single_pass' ELSE 'map_reduce' END AS strategy, CASE WHEN n <= 300 THEN 1 ELSE len(s) END::INTEGER AS chunk_count, (n > 300 AND 21 * len(s) > 300)::INTEGER AS reduce_passes
        FROM (SELECT *, len(w) AS n, list_filter(range(0, len(w), 260), lambda x: x = 0 OR x + 40 < len(w)) AS s FROM (SELECT transcript_id, {_WORDS("string_agg(text, ' ' ORDER BY pos)")} AS w FROM seg GROUP BY transcript_id))"""),
    "fallback_summary": _sql("SELECT transcript_id, '这是一个关于文稿的总结。原文总长度：' || length(string_agg(text, ' ' ORDER BY pos)) || '字符。' AS summary, 'mock' AS strategy, 0 AS chunk_count, 0 AS reduce_passes FROM seg GROUP BY transcript_id"),
    "token_stream": _sql(f"""SELECT transcript_id, pos, token_pos, token, kind, CASE WHEN kind = 'word' THEN (sum((kind = 'word')::INTEGER) OVER (PARTITION BY transcript_id, pos ORDER BY token_pos) - 1)::INTEGER END AS word_index
        FROM (SELECT transcript_id, pos, token_pos, token, CASE WHEN regexp_matches(token, '^[{WS}]') THEN 'space' WHEN regexp_matches(token, '^[{tx.LATIN}]') THEN 'word' ELSE 'mark' END AS kind
        FROM (SELECT transcript_id, pos, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS token_pos FROM (SELECT transcript_id, pos, regexp_extract_all(text, '{tx.TOKEN.replace("'", "''")}') AS l FROM seg)))"""),
    "split_parts": _sql("SELECT seg.transcript_id, seg.pos, seg.id, seg.text, any_value(n_parts) AS n, string_agg(s7.text, '|' ORDER BY part) AS texts FROM s7 JOIN seg USING (transcript_id, pos) WHERE n_parts > 1 GROUP BY ALL", _BLOCKS, _SENT),
    "text_counts": _sql(f"SELECT transcript_id, pos, length(text) AS n_chars_text, len({_WORDS('text')})::INTEGER AS n_words_text FROM seg"),
    "transcript_files": _sql("SELECT transcript_id, pos, id, start_s, end_s, text FROM seg"),
    "transcript_clean": _sql("SELECT transcript_id, pos, text, NULL::VARCHAR AS zh FROM seg"),
    "validation": _sql(f"SELECT transcript_id, count(*) AS items, count(*) FILTER ({_VALID}) AS valid FROM (SELECT *, {_STRIP('zh')} AS b FROM trans) GROUP BY transcript_id"),
    "video_info": "SELECT url AS title, page_id * 1.5::DOUBLE AS duration, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS formats FROM pages",
    "newest_file": f"WITH {_EVENTS} SELECT 'f' || seq AS path FROM ev ORDER BY ts DESC, 'f' || seq DESC LIMIT 1",
    "state_initial": f"WITH {_EVENTS} SELECT transcript_id, unnest({_STEPS}) AS step, 'pending' AS status FROM (SELECT DISTINCT transcript_id FROM ev)",
    "running_transcripts": f"WITH {_EVENTS} SELECT DISTINCT transcript_id FROM cur WHERE status = 'running'",
    "missing_outputs": f"WITH {_EVENTS}, there AS (SELECT DISTINCT transcript_id, step FROM ev WHERE status = 'completed' AND (transcript_id + seq) % 3 > 0) SELECT transcript_id, step, transcript_id || '/' || step || '.json' AS output FROM cur ANTI JOIN there USING (transcript_id, step) WHERE status = 'completed'",
    "resume_with_files": f"""WITH {_EVENTS}, there AS (SELECT DISTINCT transcript_id, step, true AS have FROM ev WHERE status = 'completed' AND (transcript_id + seq) % 3 > 0),
        o AS (SELECT transcript_id, min_by(step, list_position({_STEPS}, step)) AS step FROM cur LEFT JOIN there USING (transcript_id, step) WHERE status NOT IN ('completed', 'skipped') OR (status = 'completed' AND have IS NULL) GROUP BY transcript_id)
        SELECT t.transcript_id, o.step FROM (SELECT DISTINCT transcript_id FROM cur) t LEFT JOIN o USING (transcript_id)""",
    "resume_prepared": f"""WITH {_EVENTS}, o AS (SELECT transcript_id, min_by(step, list_position({_STEPS}, step)) AS go FROM cur WHERE status NOT IN ('completed', 'skipped') GROUP BY transcript_id)
        SELECT transcript_id, step, CASE WHEN step = go THEN 'running' WHEN step = 'summary' AND status NOT IN ('completed', 'skipped') THEN 'skipped' ELSE status END AS status FROM cur LEFT JOIN o USING (transcript_id)""",
    "word_marks": _sql(f"""SELECT transcript_id, word, max_by(label, n) AS label FROM (
        SELECT p.transcript_id, p.n, p.label, min(w.word) AS word FROM p JOIN w ON w.transcript_id = p.transcript_id AND p.a < w.w_end AND p.a + 9 > w.w_start GROUP BY ALL) GROUP BY transcript_id, word""", f"""
        l AS (SELECT transcript_id * 100000 + pos AS transcript_id, w FROM (SELECT transcript_id, pos, {_WORDS('text')} AS w FROM seg) WHERE len(w) BETWEEN 1 AND 60),
        w AS (SELECT transcript_id, i - 1 AS word, length(array_to_string(w[1:i], ' ')) - length(w[i]) AS w_start, length(array_to_string(w[1:i], ' ')) AS w_end FROM (SELECT transcript_id, w, unnest(range(1, len(w) + 1)) AS i FROM l)),
        p AS (SELECT transcript_id, a // 7 AS n, a, ['.', ',', '?', '-', ':', ',', ''][a // 7 % 7 + 1] AS label FROM (SELECT transcript_id, unnest(range(0, length(array_to_string(w, ' ')), 7)) AS a FROM l))"""),
    "seg_scan": _sql("SELECT * FROM seg"),
    "turn_scan": f"""WITH t AS (SELECT conv_id AS transcript_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, coalesce(text, '') AS text FROM conversations),
        u AS (SELECT *, 500 * greatest(len({_WORDS('text')}), 1) AS dur FROM t), v AS (SELECT *, (sum(dur) OVER (PARTITION BY transcript_id ORDER BY pos))::BIGINT AS upto FROM u)
        SELECT transcript_id, pos::INTEGER AS pos, (upto - dur) / 1000.0::DOUBLE AS start_s, upto / 1000.0::DOUBLE AS end_s, text FROM v""",
    "drop_empty": _sql("SELECT transcript_id, pos, text FROM filled"),
    "drop_punct_only": _sql("SELECT transcript_id, pos, text FROM spoken"),
    "strip_leading": _sql("SELECT transcript_id, pos, text FROM kept"),
    "drop_duplicates4": _sql(f"SELECT transcript_id, pos, text FROM kept QUALIFY count(*) OVER (PARTITION BY transcript_id, lower({_STRIP('text')})) < 4"),
    "bang_spacing": _sql(f"SELECT transcript_id, pos, regexp_replace(text, '[{WS}]+([!?])', '\\1', 'g') AS fixed FROM seg"),
    "repeated_words": _sql(f"""SELECT transcript_id, pos, CASE WHEN removed > 0 THEN new ELSE text END AS text, removed::INTEGER AS n_words_removed FROM r""", f"""
        w AS (SELECT transcript_id, pos, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT transcript_id, pos, {_WORDS('text')} AS l FROM seg)),
        k AS (SELECT *, lower(regexp_replace(w, '^[.,!?;:]+|[.,!?;:]+$', '', 'g')) AS k FROM w),
        c AS (SELECT *, count(*) OVER (PARTITION BY transcript_id, pos, k) AS n, row_number() OVER (PARTITION BY transcript_id, pos, k ORDER BY i) AS r FROM k),
        a AS (SELECT transcript_id, pos, string_agg(w, ' ' ORDER BY i) FILTER (n < 4 OR r = 1) AS new, count(*) FILTER (n >= 4 AND r > 1) AS removed FROM c GROUP BY transcript_id, pos),
        r AS (SELECT seg.transcript_id, seg.pos, seg.text, new, coalesce(removed, 0) AS removed FROM seg LEFT JOIN a USING (transcript_id, pos))"""),
    "merge_edges": _sql("SELECT transcript_id, pos, e = 1 AS merge FROM edges", _edges("kept", "edges")),
    "merge_pass1": _sql("SELECT transcript_id, pos, start_s, end_s, text FROM m1", *_passes(1)),
    "merge_pass3": _sql("SELECT transcript_id, pos, start_s, end_s, text FROM m3", *_passes(3)),
    "merge_fixpoint": _sql("SELECT transcript_id, pos, start_s, end_s, text FROM m8", *_passes(8)),
    "split_sentences": _sql("SELECT transcript_id, pos, i, sentence FROM s4", _BLOCKS, _SENT),
    "split_emit": _sql("SELECT * FROM s7", _BLOCKS, _SENT),
    "split_report": _sql("SELECT transcript_id, count(*) AS splits, sum(n_parts)::BIGINT AS created, sum(n_parts - 1)::BIGINT AS net_increase FROM s7 WHERE part = 0 AND n_parts > 1 GROUP BY transcript_id", _BLOCKS, _SENT),
    "rebuild_text": _sql("SELECT transcript_id, string_agg(text, ' ' ORDER BY pos) AS text FROM seg GROUP BY transcript_id"),
    "translation_filter": _sql("SELECT transcript_id, pos, text FROM usable"),
    "ordered_rekey": _sql("SELECT transcript_id, (n - 1)::INTEGER AS pos, n::DOUBLE AS id, text FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY id, pos, part) AS n FROM s7)", _BLOCKS, _SENT),
    "translation_format": _sql("SELECT transcript_id, index, fr FROM items"),
    "batches": _sql("SELECT transcript_id, batch_no, batch_id, n, first, context, retry_context FROM bc", _BATCH),
    "batch_halves": _sql("SELECT transcript_id, batch_id || h AS batch_id, CASE h WHEN '_a' THEN n // 2 ELSE n - n // 2 END::INTEGER AS n FROM b, (VALUES ('_a'), ('_b')) v(h) WHERE n > 1", _BATCH),
    "overlap_chunks": f"""WITH t AS (SELECT doc_id AS transcript_id, {_WORDS("coalesce(text, '')")} AS w FROM documents),
        c AS (SELECT transcript_id, w, len(w) AS n, unnest(range(0, greatest(len(w), 1), 85)) AS s FROM t)
        SELECT transcript_id, (s // 85 + 1)::INTEGER AS index, s::INTEGER AS token_start, least(s + 100, n)::INTEGER AS token_end, (least(s + 100, n) - s)::INTEGER AS token_count,
               coalesce(array_to_string(w[s + 1 : s + 100], ' '), '') AS text FROM c WHERE s = 0 OR s - 85 + 100 < n""",
    "valid_translation": _sql(f"SELECT transcript_id, index, {_VALID} AS valid, {_KIND} AS kind FROM (SELECT *, {_STRIP('zh')} AS b FROM trans)"),
    "all_valid": _sql(f"SELECT transcript_id, bool_and({_VALID}) AS all_valid FROM (SELECT *, {_STRIP('zh')} AS b FROM trans) GROUP BY transcript_id"),
    "merge_translations": _sql("SELECT r.transcript_id, r.pos::INTEGER AS pos, r.id, r.text, t.zh FROM rekeyed r LEFT JOIN trans t ON t.transcript_id = r.transcript_id AND t.index = r.id AND t.index % 5 <> 3"),
    "coverage": _sql(f"SELECT transcript_id, count(*) AS segments, count(*) FILTER ({_STRIP('zh')} <> '') AS translated, avg(CASE WHEN {_STRIP('zh')} <> '' THEN 1.0::DOUBLE ELSE 0 END) * 100 AS coverage FROM trans GROUP BY transcript_id"),
    "srt_timestamps": _sql(f"SELECT transcript_id, pos, {_TIME('start_s')} AS start_at, {_TIME('end_s')} AS end_at FROM seg"),
    "srt_cues": _sql("SELECT transcript_id, n, cue FROM cue", _CUES),
    "srt_document": _sql("SELECT transcript_id, string_agg(cue, chr(10) ORDER BY n) AS srt FROM cue GROUP BY transcript_id", _CUES),
    "punct_ratio": f"""SELECT doc_id AS transcript_id, CASE WHEN length(b) = 0 THEN 0.0::DOUBLE ELSE len(regexp_extract_all(replace(b, '...', '…'), '[.!?…]'))::DOUBLE / length(b) END AS ratio
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[{WS}]+', '', 'g') AS b FROM documents)""",
    "ratio_gate": f"""SELECT doc_id AS transcript_id, CASE WHEN length(b) = 0 THEN 0.0::DOUBLE ELSE len(regexp_extract_all(replace(b, '...', '…'), '[.!?…]'))::DOUBLE / length(b) END >= 0.012 AS accepted
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[{WS}]+', '', 'g') AS b FROM documents)""",
    "word_norm": _sql(f"""SELECT transcript_id, pos, i, CASE WHEN bare = '' THEN w ELSE bare END AS bare, regexp_replace(replace(lower(w), '’', ''''), '[^0-9a-zà-öø-ÿœæ'']', '', 'g') AS norm FROM x""", f"""
        w AS (SELECT transcript_id, pos, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS i FROM (SELECT transcript_id, pos, {_WORDS('text')} AS l FROM seg)),
        x AS (SELECT *, regexp_replace(w, '[,.?:;\\-…!]+$', '') AS bare FROM w)"""),
    "word_extract": _sql("""SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY pos, word_pos)::INTEGER - 1 AS global_index FROM (
        SELECT transcript_id, pos, word_pos, word, regexp_replace(replace(lower(word), '’', ''''), '[^0-9a-zà-öø-ÿœæ'']', '', 'g') AS norm FROM w)""", f"""
        w AS (SELECT transcript_id, pos, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS word_pos
              FROM (SELECT transcript_id, pos, regexp_extract_all(text, '[{tx.LATIN}]+(?:[''’\\-][{tx.LATIN}]+)*') AS l FROM seg))"""),
    "resume_point": f"""WITH {_EVENTS}, o AS (SELECT transcript_id, min_by(step, list_position({_STEPS}, step)) AS step FROM cur WHERE status NOT IN ('completed', 'skipped') GROUP BY transcript_id)
        SELECT t.transcript_id, o.step FROM (SELECT DISTINCT transcript_id FROM cur) t LEFT JOIN o USING (transcript_id)""",
    "step_status": f"WITH {_EVENTS} SELECT transcript_id, step, status FROM cur",
    "batch_status_latest": f"""WITH {_EVENTS}, l AS (SELECT transcript_id, status FROM ev QUALIFY row_number() OVER (PARTITION BY transcript_id, seq % 5 ORDER BY ts DESC, seq DESC) = 1)
        SELECT transcript_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM l GROUP BY transcript_id""",
    "url_classify": """SELECT page_id, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+') THEN 'url' ELSE 'unsupported' END AS kind,
        CASE page_id % 3 WHEN 0 THEN 'audio' WHEN 1 THEN 'video' ELSE 'unsupported' END AS file_kind FROM pages""",
    "file_titles": f"""SELECT doc_id, left(replace(regexp_replace(regexp_replace(string_split(coalesce(text, ''), chr(10))[1], '[^{W} \\-]', '', 'g'), '[{WS}]+$', ''), ' ', '_'), 50) AS title FROM documents""",
}
