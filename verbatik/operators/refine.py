"""Refinement of speech segments: cleaning, de-duplication, merging of fragments, splitting of long blocks.

Functions take and return segment rows (transcript_id, pos, id, start_s, end_s, text). Order is
pos; windows are by transcript, so the stages that need one share a single shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbatik.functions import text as tx
from verbatik.plans.fence import fence

#: Fixed values of the merge rule: a joined segment's length, a short segment, a short text, a short gap.
MAX_MERGED_S = 8.0
SHORT_S = 2.0
FEW_WORDS = 5
SHORT_GAP_S = 0.1
#: Copies from which segments and words count as repeats.
COPIES = 4
#: Fixed value: a sentence of more words may stand alone.
LONG_SENTENCE_WORDS = 5



def in_order():
    """Window of a transcript's segments, in order."""
    return Window.partitionBy("transcript_id").orderBy("pos")


def drop_empty(s: DataFrame) -> DataFrame:
    return s.where(tx.strip(F.col("text")) != "")


def is_punctuation_only(text: Column) -> Column:
    return tx.strip(text).rlike(rf"^[^{tx.W}{tx.WS}]+$")


def drop_punctuation_only(s: DataFrame) -> DataFrame:
    return s.where(~is_punctuation_only(F.col("text")))


def strip_leading(s: DataFrame) -> DataFrame:
    """Leading white space goes from texts that begin with a blank."""
    return s.withColumn("text", F.when(F.startswith("text", F.lit(" ")), tx.lstrip(F.col("text"))).otherwise(F.col("text")))


def text_key(text: Column) -> Column:
    return F.lower(tx.strip(text))


def drop_duplicates(s: DataFrame, copies: int = COPIES) -> DataFrame:
    """Every copy of a text that a transcript has `copies` times or more goes, the first one too."""
    n = F.count(F.lit(1)).over(Window.partitionBy("transcript_id", text_key(F.col("text"))))
    return s.withColumn("_n", n).where(F.col("_n") < copies).drop("_n")


def fix_punctuation(s: DataFrame) -> DataFrame:
    return s.withColumn("text", tx.normalize_punctuation(tx.strip_space_before_marks(F.col("text"))))


def remove_repeated_words(s: DataFrame, copies: int = COPIES) -> DataFrame:
    """Words that a segment has `copies` times or more (by key, without case and edge marks) stay once.

    Adds n_words_removed. Frequent keys come from a sorted copy of the keys, so a line of many
    thousand words costs n log n; positions are only looked up for frequent keys.
    """
    out = s.withColumn("_w", tx.words(F.col("text"))).withColumn("_k", F.transform("_w", tx.word_key)).withColumn("_s", F.sort_array("_k"))
    out = out.withColumn("_o", F.array_distinct(F.expr(f"filter(transform(_s, (x, i) -> if(x = get(_s, i + {copies - 1}), x, null)), x -> x is not null)")))
    keep = F.expr("filter(_w, (x, i) -> not array_contains(_o, get(_k, i)) or array_position(_k, get(_k, i)) = i + 1)")
    out = out.withColumn("_r", F.when(F.size("_o") > 0, keep))
    out = out.withColumn("n_words_removed", F.when(F.col("_r").isNull(), 0).otherwise(F.size("_w") - F.size("_r")))
    out = out.withColumn("text", F.when(F.col("_r").isNull(), F.col("text")).otherwise(F.array_join("_r", " ")))
    return fence(out.drop("_w", "_k", "_s", "_o", "_r"))


_EDGE = " .!?,:;"


def _without_runs(text: str) -> tuple[str, int]:
    """Text without words that recur more than five times close together, and how many runs went."""
    words, at, gone = text.split(), 0, 0
    keys = [w.strip(_EDGE).lower() for w in words]
    while at < len(words):
        if not keys[at]:
            at += 1
            continue
        same, end = 1, at + 1
        while end < len(words) and (keys[end] == keys[at] or end < at + 3):
            same += keys[end] == keys[at]
            end += 1
        if same > 5:
            del words[at:end], keys[at:end]
            gone += 1
        else:
            at += 1
    return (" ".join(words), gone) if gone else (text, 0)


def remove_word_runs(s: DataFrame) -> DataFrame:
    """Near-consecutive runs of one word go, with what stands between; emptied segments go. Adds n_runs_removed."""
    kind = T.StructType().add("t", "string").add("n", T.IntegerType())

    def run(column):
        found = [_without_runs(t or "") for t in column.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32())], ["t", "n"])

    out = s.withColumn("_r", F.arrow_udf(run, kind)(F.col("text")))
    return drop_empty(fence(out.withColumn("text", F.col("_r.t")).withColumn("n_runs_removed", F.col("_r.n")).drop("_r")))


def remove_char_patterns(s: DataFrame) -> DataFrame:
    """Patterns of characters that repeat five times or more go; emptied segments go."""
    text = F.when(tx.has_char_pattern(F.col("text")), tx.remove_char_patterns(F.col("text"))).otherwise(F.col("text"))
    return drop_empty(fence(s.withColumn("text", text)))


def should_merge(start: Column, end: Column, text: Column, next_start: Column, next_end: Column) -> Column:
    """The merge rule of a segment and the one after it; false for the last."""
    last = F.right(tx.strip(text), F.lit(1))
    score = (
        F.when(end - start < SHORT_S, 2).otherwise(0)
        + F.when((last != "") & ~F.contains(F.lit(tx.SENTENCE_END), last), 1).otherwise(0)
        + F.when(tx.word_count(text) < FEW_WORDS, 1).otherwise(0)
        + F.when(next_start - end < SHORT_GAP_S, 1).otherwise(0)
    )
    return F.coalesce((next_end - start < MAX_MERGED_S) & (score >= 3), F.lit(False))


def merge_edges(s: DataFrame) -> DataFrame:
    """Adds merge: whether a segment and the next one fit together."""
    nxt = lambda c: F.lead(c).over(in_order())
    return s.withColumn("merge", should_merge(F.col("start_s"), F.col("end_s"), F.col("text"), nxt("start_s"), nxt("end_s")))


def merged_text(a: Column, b: Column) -> Column:
    both = F.concat_ws(" ", tx.strip(a), tx.strip(b))
    return F.when(F.startswith(a, F.lit(" ")), F.concat(F.lit(" "), both)).otherwise(both)


def merge_pass(s: DataFrame) -> DataFrame:
    """One greedy pass from left to right: the odd places of each run of fitting edges merge.

    Merged segments keep the first pos, id and start and take the last end.
    """
    e = merge_edges(s).withColumn("_e", F.col("merge").cast("int"))
    e = e.withColumn("_g", F.sum(1 - F.col("_e")).over(in_order()) - (1 - F.col("_e")))
    e = e.withColumn("_k", F.sum("_e").over(Window.partitionBy("transcript_id", "_g").orderBy("pos")))
    e = e.withColumn("_head", (F.col("_e") == 1) & (F.col("_k") % 2 == 1))
    e = e.withColumn("_gone", F.coalesce(F.lag("_head").over(in_order()), F.lit(False)))
    e = e.withColumn("_end", F.lead("end_s").over(in_order())).withColumn("_text", F.lead("text").over(in_order())).where(~F.col("_gone"))
    e = e.withColumn("end_s", F.when(F.col("_head"), F.col("_end")).otherwise(F.col("end_s")))
    e = e.withColumn("text", F.when(F.col("_head"), merged_text(F.col("text"), F.col("_text"))).otherwise(F.col("text")))
    return e.drop("merge", "_e", "_g", "_k", "_head", "_gone", "_end", "_text")


def _fits(a: dict, b: dict) -> bool:
    if b["end_s"] - a["start_s"] >= MAX_MERGED_S:
        return False
    bare = a["text"].strip()
    score = 2 * (a["end_s"] - a["start_s"] < SHORT_S) + bool(bare and bare[-1] not in tx.SENTENCE_END)
    return score + (len(a["text"].split()) < FEW_WORDS) + (b["start_s"] - a["end_s"] < SHORT_GAP_S) >= 3


def _settle(island: list[dict], merges: list | None = None) -> list[dict]:
    """Greedy passes over one island until nothing merges; n counts the parts of a segment. Merges are noted as (a, b, merged)."""
    changed = True
    while changed:
        out, at, changed = [], 0, False
        while at < len(island):
            cur = island[at]
            if at + 1 < len(island) and _fits(cur, island[at + 1]):
                a, b = cur, island[at + 1]
                lead = " " if a["text"].startswith(" ") else ""
                cur = a | {"end_s": b["end_s"], "text": lead + a["text"].strip() + " " + b["text"].strip(), "n": a["n"] + b["n"]}
                if merges is not None:
                    merges.append((a, b, cur))
                at, changed = at + 1, True
            out.append(cur)
            at += 1
        island = out
    return island


_MERGE_COLUMNS = ["transcript_id", "pos", "id", "start_s", "end_s", "text"]


def _islands(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments that merge with none, and the others as lists l, one an island.

    While times don't go backward, merging never makes an edge fit that didn't before: a longer
    segment with more words scores no higher and leaves less room. So the runs of edges that fit at
    first are islands that settle each for itself, and one shuffle does for all passes. A transcript
    in which a fitting edge steps back, in starts or in ends, is one island.
    """
    nxt = lambda c: F.lead(c).over(in_order())
    e = merge_edges(s).withColumn("_e", F.col("merge").cast("int"))
    back = F.col("merge") & ((nxt("start_s") < F.col("start_s")) | (nxt("end_s") < F.col("end_s")))
    e = e.withColumn("_back", F.coalesce(back, F.lit(False))).withColumn("_whole", F.max("_back").over(Window.partitionBy("transcript_id")))
    e = e.withColumn("_island", F.when(F.col("_whole"), -1).otherwise(F.sum(1 - F.col("_e")).over(in_order()) - (1 - F.col("_e")))).drop("merge")
    alone = ~F.col("_whole") & (F.col("_e") == 0) & F.coalesce(F.lag("_e").over(in_order()) == 0, F.lit(True))
    e = e.withColumn("_alone", alone)
    lists = e.where("not _alone").groupBy("transcript_id", "_island").agg(F.array_sort(F.collect_list(F.struct(*_MERGE_COLUMNS[1:]))).alias("l"))
    return e.where("_alone").select(*_MERGE_COLUMNS), lists.select("transcript_id", "l")


def merge_fixpoint(s: DataFrame) -> DataFrame:
    """Merge passes until nothing changes. Adds n_merged, the segments that make up each one.

    Islands of one segment, nearly all, stay in the JVM; a long transcript is many small islands.
    """
    cols = _MERGE_COLUMNS
    single, lists = _islands(s)
    schema = T.StructType([s.schema[c] for c in cols]).add("n_merged", T.IntegerType())

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, island in enumerate(b.column("l").to_pylist()):
                for seg in _settle([x | {"n": 1} for x in island]):
                    at.append(i)
                    rows.append(seg)
            arrays = [pa.array([r[c] for r in rows], b.schema.field("l").type.value_type.field(c).type) for c in cols[1:]]
            yield pa.RecordBatch.from_arrays([b.column("transcript_id").take(pa.array(at, pa.int64())), *arrays, pa.array([r["n"] for r in rows], pa.int32())], [*cols, "n_merged"])

    return single.withColumn("n_merged", F.lit(1)).union(lists.mapInArrow(run, schema))


def merge_details(s: DataFrame) -> DataFrame:
    """Every merge of two segments: transcript_id, pos (of the first), turn (order of merges at that pos), both ids, times and texts, and the merged text."""
    _, lists = _islands(s)
    seg = lambda x: [x["id"], x["start_s"], x["end_s"], x["text"]]
    names = ["pos", "turn", "first_id", "first_start_s", "first_end_s", "first_text", "second_id", "second_start_s", "second_end_s", "second_text", "merged_text"]
    schema = T.StructType([s.schema["transcript_id"], s.schema["pos"]]).add("turn", T.IntegerType())
    for name in names[2:]:
        schema = schema.add(name, "string" if name.endswith("text") else "double")

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, island in enumerate(b.column("l").to_pylist()):
                merges: list = []
                _settle([x | {"n": 1} for x in island], merges)
                turns: dict = {}
                for first, second, merged in merges:
                    turns[first["pos"]] = turn = turns.get(first["pos"], 0) + 1
                    at.append(i)
                    rows.append([first["pos"], turn, *seg(first), *seg(second), merged["text"]])
            kinds = [b.schema.field("l").type.value_type.field("pos").type, pa.int32(), *([pa.float64()] * 3 + [pa.string()]) * 2, pa.string()]
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column("transcript_id").take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["transcript_id", *names])

    return lists.mapInArrow(run, schema)


def with_sentences(s: DataFrame) -> DataFrame:
    """Adds sentences (with their marks) and quotes (a » stands in the text but at its start).

    A lone » joins the sentence before; a leading » stays on the first; what follows the last mark
    is left out. Each step is a column of its own, so that none is worked out twice.
    """
    out = s.withColumn("_bare", tx.strip(F.col("text"))).withColumn("_quoted", F.startswith("_bare", F.lit("»")))
    out = out.withColumn("_body", F.when(F.col("_quoted"), tx.strip(F.substring("_bare", 2, 2**31 - 1))).otherwise(F.col("_bare")))
    # a cut after each mark, found without trying every start of a long text that has none
    cut = F.filter(F.split("_body", "(?<=[.!?»])"), lambda x: F.contains(F.lit(".!?»"), F.right(x, F.lit(1))) & (x != ""))
    out = out.withColumn("quotes", F.contains("_body", F.lit("»"))).withColumn("_parts", F.filter(F.transform(cut, tx.strip), lambda x: x != ""))

    def step(acc: Column, x: Column) -> Column:
        last = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(" »"))))
        return F.when(x != "»", F.concat(acc, F.array(x))).when(F.size(acc) > 0, last).otherwise(acc)

    # folding copies the list at each step, so it is kept to texts that have a lone mark
    folded = F.aggregate("_parts", F.array().cast("array<string>"), step)
    out = out.withColumn("_found", F.when(F.array_contains("_parts", "»"), folded).otherwise(F.col("_parts")))
    first = F.concat(F.lit("» "), F.element_at("_found", 1))
    marked = F.concat(F.array(first), F.slice("_found", 2, 2**31 - 1))
    out = out.withColumn("sentences", F.when(F.col("_quoted") & (F.size("_found") > 0), marked).otherwise(F.col("_found")))
    return fence(out.drop("_bare", "_quoted", "_body", "_parts", "_found"))


def split_blocks(s: DataFrame) -> DataFrame:
    """Long blocks become their sentences, with equal shares of the time.

    Adds part (from 0) and n_parts. Part i has id + i * 0.1, and a leading blank if i > 0.
    """
    keep = [c for c in s.columns if c not in ("id", "start_s", "end_s", "text")]
    long = F.forall("sentences", lambda x: tx.word_count(x) > LONG_SENTENCE_WORDS)
    n = F.size("sentences")
    out = with_sentences(s).withColumn("_do", (n > 1) & (long | (F.col("quotes") & (n > 2))))
    out = out.withColumn("_p", F.when(F.col("_do"), F.col("sentences")).otherwise(F.array("text"))).withColumn("n_parts", F.size("_p"))
    out = fence(out.drop("sentences", "quotes"))
    out = out.select(*keep, "id", "start_s", "end_s", "_do", "n_parts", F.posexplode("_p").alias("part", "_t"))
    span, n, i = F.col("end_s") - F.col("start_s"), F.col("n_parts"), F.col("part")
    start = F.when(F.col("_do"), F.col("start_s") + span * i / n).otherwise(F.col("start_s"))
    end = F.when(F.col("_do"), F.col("start_s") + span * (i + 1) / n).otherwise(F.col("end_s"))
    text = F.when(i > 0, F.concat(F.lit(" "), F.col("_t"))).otherwise(F.col("_t"))
    return out.select(*keep, (F.col("id") + i * F.lit(0.1)).alias("id"), start.alias("start_s"), end.alias("end_s"), text.alias("text"), "part", "n_parts")


def renumber(s: DataFrame) -> DataFrame:
    """pos from 0, and n from 1, in order of (pos, part)."""
    w = Window.partitionBy("transcript_id").orderBy("pos", "part")
    return s.withColumn("pos", F.row_number().over(w) - 1).drop("part")


def cleaned(s: DataFrame) -> DataFrame:
    """The steps of refine() before merging."""
    s = drop_duplicates(strip_leading(drop_punctuation_only(drop_empty(s))))
    s = remove_repeated_words(fix_punctuation(s)).drop("n_words_removed")
    return remove_char_patterns(remove_word_runs(s).drop("n_runs_removed"))


def refine(s: DataFrame) -> DataFrame:
    """All steps in their fixed order; columns of segments."""
    s = split_blocks(merge_fixpoint(cleaned(s)).drop("n_merged")).drop("n_parts")
    return renumber(s).select("transcript_id", "pos", "id", "start_s", "end_s", "text")


def statistics(s: DataFrame) -> DataFrame:
    """The eleven counters of refine() for each transcript, one row each.

    Each step adds its own counter as a narrow aggregate; the sums are joined by transcript.
    """
    n = F.count(F.lit(1))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    blank = tx.strip(F.col("text")) == ""
    marks = ~blank & is_punctuation_only(F.col("text"))
    lead = ~blank & ~marks & F.startswith("text", F.lit(" "))
    first = s.groupBy("transcript_id").agg(n.alias("total_input_segments"), one(blank).alias("empty_segments_removed"), one(marks).alias("punctuation_only_segments_removed"), one(lead).alias("leading_spaces_removed"))
    s1 = strip_leading(drop_punctuation_only(drop_empty(s)))
    copies = F.count(F.lit(1)).over(Window.partitionBy("transcript_id", text_key(F.col("text"))))
    s2 = s1.withColumn("_n", copies)
    second = s2.groupBy("transcript_id").agg(one(F.col("_n") >= COPIES).alias("duplicate_segments_removed"))
    s3 = s2.where(F.col("_n") < COPIES).drop("_n")
    fixed = tx.normalize_punctuation(tx.strip_space_before_marks(F.col("text")))
    third = s3.groupBy("transcript_id").agg(one(fixed != F.col("text")).alias("punctuation_fixed"))
    s4 = remove_repeated_words(fix_punctuation(s3))
    runs = remove_word_runs(s4)
    pattern = tx.has_char_pattern(F.col("text"))
    s5 = remove_char_patterns(runs.drop("n_words_removed", "n_runs_removed"))
    fourth = s4.groupBy("transcript_id").agg(F.sum("n_words_removed").alias("repeated_words_removed"), n.alias("_in"))
    fifth = runs.groupBy("transcript_id").agg(F.sum("n_runs_removed").alias("_runs"), n.alias("_out"), one(pattern).alias("_patterns"))
    merged = merge_fixpoint(s5)
    sixth = merged.groupBy("transcript_id").agg(F.sum(F.col("n_merged") - 1).alias("segments_merged"))
    cut = split_blocks(merged)
    last = cut.groupBy("transcript_id").agg(one((F.col("part") == 0) & (F.col("n_parts") > 1)).alias("segments_split"), n.alias("total_output_segments"))
    out = first
    for other in (second, third, fourth, fifth, sixth, last):
        out = out.join(other, "transcript_id", "left")
    out = out.na.fill(0)
    names = ["punctuation_fixed", "segments_merged", "segments_split", "empty_segments_removed", "repetitive_patterns_removed", "leading_spaces_removed", "duplicate_segments_removed", "repeated_words_removed", "punctuation_only_segments_removed", "total_input_segments", "total_output_segments"]
    gone = F.col("_runs") + F.col("_in") - F.col("_out") + F.col("_patterns")
    return out.withColumn("repetitive_patterns_removed", gone).select("transcript_id", *[F.col(c).cast("bigint").alias(c) for c in names])


def merge_report(s: DataFrame) -> DataFrame:
    """Totals of merging for each transcript. A merge joins two segments, so a chain of three has two: merges, segments that went into them, net reduction."""
    m = merge_fixpoint(s).where("n_merged > 1")
    merges = F.sum(F.col("n_merged") - 1)
    return m.groupBy("transcript_id").agg(merges.alias("merges"), (2 * merges).alias("original_segments"), merges.alias("net_reduction"))


def split_details(s: DataFrame) -> DataFrame:
    """Every split: transcript_id, pos, the block (id, start_s, end_s, text) and its parts in order."""
    parts = split_blocks(s).where("n_parts > 1").groupBy("transcript_id", "pos").agg(F.array_sort(F.collect_list(F.struct("part", "id", "start_s", "end_s", "text"))).alias("parts"))
    return s.select("transcript_id", "pos", "id", "start_s", "end_s", "text").join(parts, ["transcript_id", "pos"])


def split_report(s: DataFrame) -> DataFrame:
    """Totals of splitting for each transcript: splits, segments created, net increase."""
    p = split_blocks(s).where((F.col("n_parts") > 1) & (F.col("part") == 0))
    return p.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("splits"), F.sum("n_parts").alias("created"), F.sum(F.col("n_parts") - 1).alias("net_increase"))
