"""Quality rules: counts per document, then a hashed n-gram likelihood ratio of a trusted target to the corpus.

Everything on the main path is DataFrame expressions. The n-grams are words and pairs of neighbouring
words, hashed into BUCKETS buckets; the multinomials over buckets are counted over all trusted
documents and over all documents. The target is smoothed towards the corpus (a Dirichlet prior of
PRIOR n-grams a bucket, dealt as the corpus is), so that words which a small target hasn't met say
little. A document's verdict is its mean log ratio against a fixed threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatik.llm.common import SPACE, rows_in

#: Size of the multinomials: all that the driver and the tasks hold of the corpus.
BUCKETS = 1 << 15
#: Mean log ratio (nats an n-gram) below which a document is rejected.
THRESHOLD = -0.12
#: N-grams a bucket that the target is given of the corpus's distribution; the corpus itself has 1 added to each bucket.
PRIOR = 4.0
#: Trusted ids (eight bytes each) that are broadcast at most.
BROADCAST_IDS = 1_000_000
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
_BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space; null: none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def _hashed(w: str) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _grams() -> Column:
    """Hashes of a document's n-grams: from _h, its words' hashes, these and those of pairs of neighbours."""
    pairs = F.expr("transform(sequence(1, size(_h) - 1), i -> xxhash64(get(_h, i - 1), get(_h, i)))")
    return F.concat(F.col("_h"), F.when(F.size("_h") > 1, pairs).otherwise(F.array().cast("array<bigint>")))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Column id: all ids whose every label says quality 1."""
    return labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("q")).where("q = 1").select("id")


def bucket_counts(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns bucket, corpus, target: n-grams over all rows and over those of trusted ids.

    One scan; counts are combined before the shuffle. Up to BROADCAST_IDS trusted ids are broadcast; when
    there are more, the join shuffles ids and buckets (two bytes an n-gram), not texts.
    """
    flags = trusted.select(F.col("id").alias("_id"), F.lit(1).alias("_good")).distinct()
    if rows_in(flags) <= BROADCAST_IDS:
        flags = F.broadcast(flags)
    hashed = docs.select(F.col(id_col).alias("_id"), words(F.col(text_col)).alias("_w")).withColumn("_h", _hashed("_w"))
    marked = hashed.select("_id", F.transform(_grams(), _bucket).cast("array<smallint>").alias("_b")).join(flags, "_id", "left")
    grams = marked.select("_good", F.explode_outer("_b").alias("bucket"))
    # explode() would add a filter on the array's size, pushed down with all that makes the array
    return grams.where("bucket is not null").groupBy(F.col("bucket").cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("corpus"), F.count("_good").alias("target"))


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR) -> list[float]:
    """log(target / corpus) of each bucket; at most BUCKETS rows reach the driver."""
    counts = {r.bucket: (r.target, r.corpus) for r in bucket_counts(docs, trusted, id_col, text_col).collect()}
    target, corpus = (sum(c[side] for c in counts.values()) for side in range(2))
    out = []
    for b in range(BUCKETS):
        t, c = counts.get(b, (0, 0))
        share = (c + 1) / (corpus + BUCKETS)
        out.append(math.log((t + prior * BUCKETS * share) / (target + prior * BUCKETS) / share))
    return out


def profile(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed (and _h, the words' hashes).

    Null and blank texts have no words, so all counts are 0 and base_failed is true. Windows of
    five words are compared by two chained 64-bit hashes. No cap on length.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumn("_w", words(F.col(text_col)))
    out = out.withColumn("_l", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("bigint"))
    out = out.withColumn("n_symbols", F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint"))
    out = out.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint"))
    out = out.withColumn("_h", _hashed("_w")).withColumn("n_words", F.size("_h").cast("bigint"))
    windows = "transform(sequence(0, size(_h) - 5), i -> xxhash64(get(_h, i), get(_h, i + 1), get(_h, i + 2), get(_h, i + 3), get(_h, i + 4)))"
    out = out.withColumn("_x", F.when(F.col("n_words") > 5, F.expr(windows)))
    # the hot path ends here: most texts repeat no window
    repeats = F.size(F.array_distinct("_x")) < F.size("_x")
    out = out.withColumn("_s", F.when(repeats, F.expr("sort_array(transform(_x, (x, i) -> struct(x, i)))")))
    twice = "filter(transform(_s, (s, k) -> if(s.x = get(_s, k - 1).x or s.x = get(_s, k + 1).x, s.i, -1)), i -> i >= 0)"
    out = out.withColumn("_p", F.expr(f"sort_array({twice})"))
    cover = "aggregate(transform(_p, (p, k) -> least(5, coalesce(get(_p, k + 1), p + 5) - p)), 0L, (a, n) -> a + n)"
    out = out.withColumn("n_repeat_words", F.coalesce(F.expr(cover), F.lit(0).cast("bigint")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_w", "_l", "_x", "_s", "_p")


def assess(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, prior: float = PRIOR) -> DataFrame:
    """docs with the columns of profile(), llr (mean log ratio of its n-grams) and kept.

    trusted: the target's ids (trusted_ids()), any number; a target of far fewer n-grams than the
    prior's rejects little, so lower `prior` for one. kept is false if base_failed, else
    llr >= threshold. A text without words has llr 0. With no trusted rows every ratio is 0, and only
    the base rules reject.
    Rows are judged one by one: repeats get equal verdicts, other columns (also of clashing names)
    stay as they are, but a column with a result's name is replaced by it.
    """
    ratios = ",".join(f"{x:.4f}" for x in log_ratios(docs, trusted, id_col, text_col, prior))
    weights = F.split(F.lit(ratios), ",").cast("array<float>")
    both = profile(docs, text_col)
    total = F.aggregate(_grams(), F.lit(0.0), lambda a, h: a + F.get(weights, _bucket(h)))
    n = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    out = both.withColumn("llr", F.round(total / n, 9)).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    # results pass through a generator: a filter on them is then not pushed into, and doubled over, what makes them
    out = out.withColumn("_r", F.explode(F.array(F.struct(*RESULTS))))
    return out.select(*[F.col(c) for c in docs.columns if c not in RESULTS], "_r.*")
