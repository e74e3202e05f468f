"""The pipeline: each stage's decisions take effect on what the one before kept."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before, seen = {r.doc_id for r in docs.select("doc_id").collect()}, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, str(DATA)), name)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before
        before, docs = set(ids), out
        seen.append(len(ids))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == before
    assert seen[0] < 200 and seen[-1] == seen[-2] > 80


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, blanks, repeats, a long text, clashing names, an empty table: every stage by itself."""
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choices("abcdeilmnorstu", k=rng.randint(2, 8))) for _ in range(n)).capitalize() + "."
    junk = lambda: " ".join("".join(rng.choices("#*$%&|<>AB12", k=rng.randint(2, 8))) for _ in range(40))
    texts = [prose(60) for _ in range(60)] + [junk() for _ in range(40)] + [None, "", " \n", prose(20_000)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], (500, texts[6], None, None, None), (None, texts[7], "en", "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60)) for i in range(100)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("fp", "id", "key", "score", "kept", "kid", "t", "n", "piece", "salt"):
        docs = docs.withColumn(name, F.lit("x"))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        out[name] = got.collect()
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    ids = {name: sorted((r.doc_id for r in rows_ if r.doc_id is not None)) for name, rows_ in out.items()}
    assert ids["quality_rules"].count(5) == 2 and 500 in ids["quality_rules"] and not {100, 101, 102} & set(ids["quality_rules"])
    assert set(range(60)) <= set(ids["quality_classifier"]) and not set(range(60, 100)) & set(ids["quality_classifier"])
    # of 5 and its repeat, of 6 and its copy, of the three wordless texts one stays; rows of null id stay
    assert ids["simhash_near_dedup"] == [*range(101), 103] and sum(r.doc_id is None for r in out["simhash_near_dedup"]) == 2
    repeats = {(r.doc_id, r.text) for r in out["suffix_dedup"]}
    assert len(out["suffix_dedup"]) == len(rows) and (5, "") in repeats and (500, "") in repeats and (8, texts[8]) in repeats and (103, texts[103]) in repeats
    assert ids["best_fit_packing"].count(100) == 1 and ids["best_fit_packing"].count(103) > 10 and ids["best_fit_packing"].count(5) == 2


def test_classifier_without_labels(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text", "en", "s", 9)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    with pytest.raises(ValueError):
        corpus_pipeline.classifier(spark, docs, str(tmp_path))
    assert corpus_pipeline.classifier(spark, docs.limit(0), str(tmp_path)).count() == 0
