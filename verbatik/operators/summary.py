"""Summaries of long transcripts: overlapping token chunks, a provider for each, and reduction."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbatik.functions import text as tx
from verbatik.plans.fence import fence
from verbatik.plans.tables import written

CHUNK_TOKENS = 60_000
OVERLAP_TOKENS = 5_000


class Tokenizer(Protocol):
    """What a tokenizer has to do; encode gives a list of ids."""

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


def window_starts(n: int, size: int, overlap: int) -> list[int]:
    """Starts of the windows over n tokens: the first window that reaches the end is the last."""
    if size <= 0:
        return [0]
    step = max(size - min(max(overlap, 0), size - 1), 1)
    return [s for s in range(0, max(n, 1), step) if s == 0 or s - step + size < n]


def token_count(c: Column, tokenizer: Callable[[], Tokenizer] | None = None) -> Column:
    """Tokens of a text: of the tokenizer that `tokenizer` loads on the worker, or between white space."""
    if tokenizer is None:
        return tx.word_count(c)

    def run(column):
        t = tokenizer()
        return pa.array([len(t.encode(x or "")) for x in column.to_pylist()], pa.int32())

    return F.arrow_udf(run, T.IntegerType())(c)


def chunks(df: DataFrame, text_col: str = "text", size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, tokenizer: Callable[[], Tokenizer] | None = None) -> DataFrame:
    """A row for each window of `size` tokens: text_col's place is taken by index (from 1),
    token_start, token_end, token_count and text.

    Neighbours share `overlap` tokens; the first window that reaches the end is the last. A size of
    0 gives one window of everything, a text without tokens one empty window. Tokens are those of
    the tokenizer, or what stands between white space.
    """
    if tokenizer is not None:
        kind = T.StructType().add("index", "integer").add("token_start", "integer").add("token_end", "integer").add("token_count", "integer").add("text", "string")

        def run(column):
            t, out = tokenizer(), []
            for x in column.to_pylist():
                ids = t.encode(x or "")
                ends = [(s, min(s + size, len(ids)) if size > 0 else len(ids)) for s in window_starts(len(ids), size, overlap)]
                out.append([{"index": i, "token_start": s, "token_end": e, "token_count": e - s, "text": t.decode(ids[s:e]) if e > s else ""} for i, (s, e) in enumerate(ends, 1)])
            return pa.array(out, pa.list_(pa.struct([("index", pa.int32()), ("token_start", pa.int32()), ("token_end", pa.int32()), ("token_count", pa.int32()), ("text", pa.string())])))

        rows = df.withColumn("_c", F.arrow_udf(run, T.ArrayType(kind))(F.col(text_col))).drop(text_col)
        return rows.select(*[c for c in rows.columns if c != "_c"], F.inline("_c"))
    rows = df.withColumn("_t", tx.words(F.coalesce(text_col, F.lit("")))).withColumn("_n", F.size("_t"))
    n = F.col("_n")
    if size <= 0:
        starts, end = F.array(F.lit(0)), lambda s: n
    else:
        step = max(size - min(max(overlap, 0), size - 1), 1)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s - step + size < n))
        end = lambda s: F.least(s + size, n)
    # tokens are looked up twice, so they stay a column of their own and aren't split anew in each window
    part = lambda s, i: F.struct((i + 1).alias("index"), s.alias("token_start"), end(s).alias("token_end"), (end(s) - s).alias("token_count"), F.when(F.size("_t") > 0, F.array_join(F.slice("_t", s + 1, end(s) - s), " ")).otherwise("").alias("text"))
    rows = fence(rows.withColumn("_c", F.transform(starts, part)).drop("_t", "_n", text_col))
    return rows.select(*[c for c in rows.columns if c != "_c"], F.inline("_c"))


def fallback(text: Column) -> Column:
    """Fixed value: the text that stands in for a summary."""
    return F.concat(F.lit("这是一个关于文稿的总结。原文总长度："), F.length(text).cast("string"), F.lit("字符。"))


def _ask(df: DataFrame, provider: Callable[[str, str], str], kind: str, col: str, out: str) -> DataFrame:
    """df with the provider's answer; null where it raised."""

    def one(text):
        try:
            return provider(kind, text or "")
        except Exception:
            return None

    run = F.arrow_udf(lambda c: pa.array([one(x) for x in c.to_pylist()], pa.string()), T.StringType())
    return fence(df.withColumn(out, run(F.col(col))))


def summarize(transcripts: DataFrame, provider: Callable[[str, str], str] | None, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, max_passes: int = 20, tokenizer: Callable[[], Tokenizer] | None = None) -> DataFrame:
    """transcript_id, summary, strategy, chunk_count, reduce_passes.

    provider(kind, text) gives a summary; kind is summary, chunk or reduce. Texts within the limit
    take one call (single_pass, one chunk); others one for each chunk, in parallel, and their joined
    summaries are reduced while they exceed the limit (map_reduce). Where the provider raises, the
    fallback text stands in (fallback); without a provider it does everywhere (mock). Each round is a
    written table, so nothing is asked twice.
    """
    rows = transcripts.select("transcript_id", F.coalesce("text", F.lit("")).alias("text"))
    if provider is None:
        return rows.select("transcript_id", fallback(F.col("text")).alias("summary"), F.lit("mock").alias("strategy"), F.lit(0).alias("chunk_count"), F.lit(0).alias("reduce_passes"))
    rows = rows.withColumn("long", token_count(F.col("text"), tokenizer) > size)
    short = _ask(rows.where("not long"), provider, "summary", "text", "summary").select("transcript_id", "summary", F.lit("single_pass").alias("strategy"), F.lit(1).alias("chunk_count"), F.lit(0).alias("reduce_passes"))
    parts = chunks(rows.where("long").select("transcript_id", "text"), "text", size, overlap, tokenizer)
    asked = _ask(parts.select("transcript_id", "index", "text"), provider, "chunk", "text", "summary")
    listed = asked.groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct("index", "summary"))).alias("l"))
    joined = F.when(~F.exists("l", lambda x: x["summary"].isNull()), F.array_join(F.transform("l", lambda x: x["summary"]), "\n\n"))
    cur = written(short.union(listed.select("transcript_id", joined.alias("summary"), F.lit("map_reduce").alias("strategy"), F.size("l").alias("chunk_count"), F.lit(0).alias("reduce_passes"))), "summary")
    for _ in range(max_passes):
        over = F.coalesce((F.col("strategy") == "map_reduce") & (token_count(F.col("summary"), tokenizer) > size), F.lit(False))
        marked = cur.withColumn("_over", over)
        if marked.where("_over").isEmpty():
            break
        again = _ask(marked.where("_over").drop("_over").withColumnRenamed("summary", "text"), provider, "reduce", "text", "summary")
        again = again.select("transcript_id", "summary", "strategy", "chunk_count", F.col("reduce_passes") + 1)
        cur = written(marked.where("not _over").drop("_over").union(again), "summary")
    failed = F.col("summary").isNull()
    whole = cur.join(rows.select("transcript_id", "text"), "transcript_id")
    return whole.select("transcript_id", F.when(failed, fallback(F.col("text"))).otherwise(F.col("summary")).alias("summary"), F.when(failed, "fallback").otherwise(F.col("strategy")).alias("strategy"), F.when(failed, 0).otherwise(F.col("chunk_count")).alias("chunk_count"), "reduce_passes")
