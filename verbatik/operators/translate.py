"""Batches for a translation provider, validation of its answers, and merging them into segments."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbatik.functions import text as tx
from verbatik.plans.fence import fence

BATCH_SIZE = 10
#: Fixed value: the summary's place in a prompt template.
SUMMARY_BLOCK = r"\n[ \t]*全文总结（仅供理解）：\n[ \t]*\{summary\}\n?"
#: Earlier texts that a batch's first attempt gets as context.
CONTEXT = 3
#: Quotation marks that models put in place of JSON's.
SMART_QUOTES = "“”‟«»‹›「」『』‘’‛"
#: Fixed value: a text of at most so many words may stay as it is.
NAME_WORDS = 3


def translatable(s: DataFrame) -> DataFrame:
    """Segments with text that doesn't begin with three dots."""
    bare = tx.strip(F.coalesce("text", F.lit("")))
    return s.where((bare != "") & ~F.startswith(bare, F.lit("...")))


def rekey(s: DataFrame) -> DataFrame:
    """Ids 1 to n by (id, pos), ids being 0 if missing; pos follows."""
    w = Window.partitionBy("transcript_id").orderBy(F.coalesce("id", F.lit(0.0)), "pos")
    n = s.withColumn("_n", F.row_number().over(w))
    return n.withColumn("id", F.col("_n").cast("double")).withColumn("pos", F.col("_n") - 1).drop("_n")


def to_items(s: DataFrame) -> DataFrame:
    """Columns transcript_id, n (1 to ...), index and fr of the translatable segments, in order."""
    r = rekey(translatable(s))
    return r.select("transcript_id", F.col("id").cast("int").alias("n"), F.col("id").cast("bigint").alias("index"), tx.strip(F.col("text")).alias("fr"))


def batches(items: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """One row a batch: batch_no, batch_id, items (index, fr in order), context and retry_context.

    context: up to three texts before the batch, joined by a blank; retry_context: the batch's own
    texts but the last.
    """
    before = F.array_join(F.collect_list("fr").over(Window.partitionBy("transcript_id").orderBy("n").rowsBetween(-CONTEXT, -1)), " ")
    rows = items.withColumn("batch_no", F.floor((F.col("n") - 1) / size).cast("int")).withColumn("_c", before)
    out = rows.groupBy("transcript_id", "batch_no").agg(F.array_sort(F.collect_list(F.struct("n", "index", "fr"))).alias("l"), F.min_by("_c", "n").alias("context"), F.min("n").alias("first"), F.max("n").alias("last"))
    texts = F.transform("l", lambda x: x["fr"])
    batch_id = F.format_string("batch_%02d_segments_%03d_%03d", F.col("batch_no") + 1, F.col("first"), F.col("last"))
    items_ = F.transform("l", lambda x: F.struct(x["index"].alias("index"), x["fr"].alias("fr")))
    retry = F.array_join(F.slice(texts, 1, F.size(texts) - 1), " ")
    return out.select("transcript_id", "batch_no", batch_id.alias("batch_id"), items_.alias("items"), "context", retry.alias("retry_context"))


def prompts(b: DataFrame, template: str, summary: Column | None = None) -> DataFrame:
    """Adds prompt: the template with {summary}, {context} and {segments} filled in; and retry_prompt, with retry_context as context.

    Without a summary its heading and line are left out.
    """
    if summary is None:
        template = re.sub(SUMMARY_BLOCK, "\n", template).replace("{summary}", "")

    def filled(context: str) -> Column:
        prompt = F.lit(template)
        for name, value in (("{summary}", summary), ("{context}", F.col(context)), ("{segments}", F.to_json("items"))):
            if value is not None:
                prompt = F.replace(prompt, F.lit(name), value)
        return prompt

    return b.withColumn("prompt", filled("context")).withColumn("retry_prompt", filled("retry_context"))


def halves(b: DataFrame) -> DataFrame:
    """Batches of two items or more as their halves, the first the smaller; path tells which."""
    mid = F.floor(F.size("items") / 2).cast("int")
    parts = F.array(F.struct(F.lit("_a").alias("h"), F.slice("items", 1, mid).alias("i")), F.struct(F.lit("_b").alias("h"), F.slice("items", mid + 1, F.size("items") - mid).alias("i")))
    out = b.where(F.size("items") > 1).withColumn("_p", F.explode(parts))
    return out.withColumn("batch_id", F.concat("batch_id", F.col("_p.h"))).withColumn("items", F.col("_p.i")).drop("_p")


def is_valid_translation(zh: Column, fr: Column) -> Column:
    """Chinese that differs from the source, numbers, or any text that isn't a long copy of it."""
    bare = tx.strip(F.coalesce(zh, F.lit("")))
    fr = F.coalesce(fr, F.lit(""))
    return (
        F.when(bare == "", False).when(tx.has_chinese(bare), bare != fr).when(tx.numbers_only(bare), True)
        .when((tx.word_count(bare) <= NAME_WORDS) & (F.lower(bare) == F.lower(fr)), True).otherwise(F.lower(bare) != F.lower(fr))
    )


def content_type(zh: Column) -> Column:
    bare = tx.strip(F.coalesce(zh, F.lit("")))
    return F.when(tx.has_chinese(bare), "Chinese").when(tx.numbers_only(bare), "Numbers-only").when(tx.word_count(bare) <= NAME_WORDS, "Name/Expression").otherwise("Other")


def sanitize_output(output: str) -> str:
    """Quotation marks that stand for JSON's become them; marks inside texts stay."""
    done, inside, escaped = [], False, False
    # what follows each character, white space apart: found from the end, once
    follows, ahead = [""] * len(output), ""
    for i in range(len(output) - 1, -1, -1):
        follows[i] = ahead
        if not output[i].isspace():
            ahead = output[i]
    for ch, ahead in zip(output, follows, strict=True):
        smart = ch in SMART_QUOTES
        if escaped:
            escaped = False
        elif ch == "\\":
            escaped = inside
        elif ch == '"' or (smart and (not inside or ahead in ",}]:")):
            inside, ch = not inside, '"'
        done.append(ch)
    return "".join(done).replace("'}]", '"}]').replace("'}", '"}')


_ITEM = T.StructType().add("is_dict", "boolean").add("has_index", "boolean").add("index", "double").add("has_zh", "boolean").add("zh", "string")
_PARSED = T.StructType().add("error", "string").add("items", T.ArrayType(_ITEM))


def _parse(response: str | None) -> dict:
    text = sanitize_output(response or "")
    try:
        value = json.loads(text)
    except ValueError:
        inner = re.search(r"\[.*\]", text, re.DOTALL)
        if not inner:
            return {"error": "no_json", "items": None}
        try:
            value = json.loads(inner.group())
        except ValueError:
            return {"error": "bad_json", "items": None}
    if not isinstance(value, list):
        return {"error": "not_a_list", "items": None}
    items = []
    for x in value:
        d = x if isinstance(x, dict) else {}
        index, zh = d.get("index"), d.get("zh")
        number = isinstance(index, (int, float))
        items.append({"is_dict": isinstance(x, dict), "has_index": "index" in d, "index": float(index) if number else None, "has_zh": "zh" in d, "zh": zh if isinstance(zh, str) else None})
    return {"error": None, "items": items}


def parse_responses(df: DataFrame, col: str = "raw_response") -> DataFrame:
    """Adds parsed: the response as Python's json reads it (error, or items)."""
    kind = pa.struct([("error", pa.string()), ("items", pa.list_(pa.struct([("is_dict", pa.bool_()), ("has_index", pa.bool_()), ("index", pa.float64()), ("has_zh", pa.bool_()), ("zh", pa.string())])))])
    run = F.arrow_udf(lambda c: pa.array([_parse(x) for x in c.to_pylist()], kind), _PARSED)
    return df.withColumn("parsed", run(F.col(col)))


def validate(df: DataFrame) -> DataFrame:
    """Adds error_code (null if valid) and error_pos of each response to its batch's items.

    Checks are made in the order: JSON, list, count, then the first failing item's form, then the
    first failing item's translation. df: items (index, fr) and raw_response.
    """
    p = parse_responses(df)
    pairs = F.arrays_zip(F.col("parsed.items").alias("o"), F.col("items").alias("i"))
    o = lambda x: x["o"]
    form = lambda x: (
        F.when(~o(x)["is_dict"], "not_a_dictionary").when(~o(x)["has_index"], "missing_index")
        .when(~F.coalesce(o(x)["index"] == x["i"]["index"].cast("double"), F.lit(False)), "index_mismatch").when(~o(x)["has_zh"], "missing_zh").when(o(x)["zh"].isNull(), "zh_not_a_text")
    )
    sense = lambda x: F.when(tx.strip(o(x)["zh"]) == "", "empty_translation").when(~is_valid_translation(o(x)["zh"], x["i"]["fr"]), F.when(tx.has_chinese(o(x)["zh"]), "identical_to_original").otherwise("invalid_content"))
    p = p.withColumn("_count", F.col("parsed.error").isNull() & (F.size("parsed.items") != F.size("items")))
    p = p.withColumn("_form", F.when(F.col("parsed.error").isNull() & ~F.col("_count"), F.transform(pairs, form)))
    p = p.withColumn("_sense", F.when(~F.exists("_form", lambda x: x.isNotNull()), F.transform(pairs, sense)))
    first = lambda c: F.get(F.filter(F.transform(c, lambda x, i: F.struct(i.alias("i"), x.alias("e"))), lambda s: s["e"].isNotNull()), F.lit(0))
    bad = F.coalesce(first("_form"), first("_sense"))
    code = F.when(F.col("parsed.error").isNotNull(), F.col("parsed.error")).when(F.col("_count"), "count_mismatch").otherwise(F.col("_bad.e"))
    p = p.withColumn("_bad", bad).withColumn("error_code", code).withColumn("error_pos", F.col("_bad.i"))
    return fence(p.drop("_count", "_form", "_sense", "_bad"))


_BATCH = ["transcript_id", "batch_id"]


def cached_responses(responses: DataFrame) -> DataFrame:
    """The newest valid response of each batch: transcript_id, batch_id, raw_response, items, parsed.

    responses: transcript_id, batch_id, items, raw_response, written_at, name. Batch ids repeat from
    transcript to transcript.
    """
    good = validate(responses).where("error_code is null")
    w = Window.partitionBy(*_BATCH).orderBy(F.desc("written_at"), F.desc("name"))
    return good.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "error_code", "error_pos")


def _translated(c: str) -> Column:
    return F.transform(c, lambda x: F.struct(x["index"].cast("bigint").alias("index"), x["zh"].alias("zh")))


def assemble_halves(responses: DataFrame) -> DataFrame:
    """Translations of each batch that has a valid response, or valid responses of both halves.

    Columns transcript_id, batch_id, zh (array of index, zh in order). Halves may themselves be halved.
    """
    got = cached_responses(responses).select(*_BATCH, _translated("parsed.items").alias("zh"))
    depth = responses.agg(F.max(F.length(F.regexp_extract("batch_id", "((_[ab])*)$", 1)) / 2)).first()[0] or 0
    for level in range(int(depth), 0, -1):
        at = F.length(F.regexp_extract("batch_id", "((_[ab])*)$", 1)) == 2 * level
        parent = F.expr("substring(batch_id, 1, length(batch_id) - 2)")
        half = lambda x: F.max(F.when(F.endswith("batch_id", F.lit(x)), F.col("zh")))
        both = got.where(at).groupBy("transcript_id", parent.alias("batch_id")).agg(half("_a").alias("a"), half("_b").alias("b"))
        whole = both.where("a is not null and b is not null").select(*_BATCH, F.concat("a", "b").alias("zh"))
        got = got.where(~at).unionByName(whole.join(got.where(~at), _BATCH, "left_anti"))
    return got


#: A provider gets a batch, a dict of batch_id, items (index, fr), context and prompt (null without a template), and gives the model's answer.
Provider = Callable[[dict], str]
RESPONSE = ["transcript_id", "batch_id", "items", "raw_response", "written_at", "name", "depth", "attempt"]


def call_provider(b: DataFrame, provider: Provider) -> DataFrame:
    """Adds raw_response: the provider's answer, null where it raised.

    The provider is loaded with the function on each worker and called batch by batch.
    """

    def run(ids, items, context, prompt):
        out = []
        for i, x, c, p in zip(*(a.to_pylist() for a in (ids, items, context, prompt)), strict=True):
            try:
                out.append(provider({"batch_id": i, "items": x, "context": c, "prompt": p}))
            except Exception:
                out.append(None)
        return pa.array(out, pa.string())

    prompt = F.col("prompt") if "prompt" in b.columns else F.lit(None).cast("string")
    # fenced: an answer that is used twice would be asked for twice
    return fence(b.withColumn("raw_response", F.arrow_udf(run, T.StringType())(F.col("batch_id"), F.col("items"), F.col("context"), prompt)))


@dataclass(frozen=True)
class Answers:
    """translations: transcript_id, index, zh. failed: transcript_id, batch_id, error_code of single items that no attempt could do."""

    translations: DataFrame
    failed: DataFrame


def translate_batches(b: DataFrame, provider: Provider, attempts: int = 1, delay: float = 0.0, cache: DataFrame | None = None, store: Callable[[DataFrame, str], DataFrame] | None = None) -> Answers:
    """Translations of all batches. A batch that fails, by any check, is asked again after `delay` seconds; after all attempts its halves are.

    cache: responses (RESPONSE) of an earlier run. A batch with a valid one isn't asked; one whose
    halves were asked goes on with them. A failed single item fails its transcript, not the run.
    store(df, name) makes the answers of a round durable (default: a written table in the shared
    folder), so that neither a lost executor nor a resumed run asks the provider again.
    """
    from verbatik.plans.tables import written

    store = store or (lambda df, name: written(df, name))
    told = lambda v, c: v.select("transcript_id", F.explode(F.arrays_zip(F.col("items").alias("i"), F.col(c).alias("o"))).alias("x")).select("transcript_id", F.col("x.i.index").alias("index"), tx.strip(F.col("x.o.zh")).alias("zh"))
    cols, done, failed = b.columns, [], []
    for depth in count():
        todo, halved = b, None
        if cache is not None:
            known = cached_responses(cache.drop("items").join(todo.select(*_BATCH, "items"), _BATCH))
            done.append(told(known, "parsed.items"))
            todo = todo.join(known.select(*_BATCH), _BATCH, "left_anti").select(*cols)
            parents = cache.where(F.col("batch_id").rlike("_[ab]$")).select("transcript_id", F.expr("substring(batch_id, 1, length(batch_id) - 2)").alias("batch_id")).distinct()
            halved = todo.where(F.size("items") > 1).join(parents, _BATCH, "left_semi").select(*cols)
            todo = todo.join(halved.select(*_BATCH), _BATCH, "left_anti").select(*cols)
        codes = None
        for attempt in range(1, attempts + 1):
            if attempt > 1:
                if todo.isEmpty():
                    break
                time.sleep(delay)
            asked = call_provider(todo, provider)
            asked = asked.withColumns({"written_at": F.current_timestamp(), "name": F.format_string("%s_%02d", F.col("batch_id"), F.lit(attempt)), "depth": F.lit(depth), "attempt": F.lit(attempt)})
            answers = store(validate(asked), f"responses-{depth}-{attempt}")
            done.append(told(answers.where("error_code is null"), "parsed.items"))
            codes = answers.where("error_code is not null")
            # later attempts see the batch's own texts as context
            todo = codes.select(*cols)
            if "retry_prompt" in cols:
                todo = todo.withColumn("prompt", F.col("retry_prompt"))
            todo = todo.withColumn("context", F.col("retry_context"))
        failed.append(codes.where(F.size("items") == 1).select(*_BATCH, "error_code"))
        rest = todo.where(F.size("items") > 1)
        b = halves(rest if halved is None else rest.unionByName(halved)).select(*cols)
        if b.isEmpty():
            return Answers(reduce(DataFrame.union, done), reduce(DataFrame.union, failed))
    raise AssertionError


def merge_translations(s: DataFrame, translations: DataFrame) -> DataFrame:
    """Segments with zh by (transcript_id, id); of repeated translations the last (by pos) wins."""
    last = translations.groupBy("transcript_id", F.col("index").cast("double").alias("id")).agg(F.max_by("zh", "pos").alias("zh"))
    return s.join(last, ["transcript_id", "id"], "left")


def all_valid(rows: DataFrame) -> DataFrame:
    """Per transcript, whether every translation (zh, fr) is valid."""
    return rows.groupBy("transcript_id").agg(F.bool_and(is_valid_translation(F.col("zh"), F.col("fr"))).alias("all_valid"))


def coverage(s: DataFrame) -> DataFrame:
    """Per transcript: segments, those with a translation, and their percentage (null for none)."""
    has = tx.strip(F.coalesce("zh", F.lit(""))) != ""
    return s.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("segments"), F.sum(has.cast("bigint")).alias("translated"), (F.avg(has.cast("double")) * 100).alias("coverage"))


def text_counts(df: DataFrame, col: str = "text") -> DataFrame:
    """Adds n_chars_text and n_words_text."""
    return df.withColumn("n_chars_text", F.length(col)).withColumn("n_words_text", tx.word_count(F.col(col)))
