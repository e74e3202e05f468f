"""Operators on cases that a part of the job would miss."""

import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from pyspark.sql import functions as F  # noqa: E402

from verbatik.llm import ann, common, components, knn_quality, licenses, packing, quality_rules, queries, sampling, simhash, suffix  # noqa: E402

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in texts], COLUMNS)


def prose(rng, n):
    return [rng.choice("bcdfgh") + rng.choice("aeiou") + str(rng.randint(0, 400)) for _ in range(n)]


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_dedup_keeps_no_pair_of_similarity(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 8)
    rng, texts = random.Random(3), []
    for group in range(12):
        base = prose(rng, 250)
        for copy in range(30 if group == 0 else 4):
            w = list(base)
            for _ in range(rng.randint(0, 6) if copy else 0):
                w[rng.randrange(len(w))] = "new" + str(rng.randrange(10**6))
            texts.append(" ".join(w))
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (1002, texts[5]), (1003, "two words"), (1004, "two  words")]
    kept = {r.doc_id: r.text for r in corpus_pipeline.near_dedup(spark, table(spark, rows), "").collect()}
    assert 1000 in kept and 1001 not in kept and 1002 not in kept and 1003 in kept and 1004 not in kept
    plain = {i: t for i, t in kept.items() if i < 1000}
    assert all(jaccard(a, b) < 0.8 for i, a in plain.items() for j, b in plain.items() if i < j)
    near = {i: [j for j in range(len(texts)) if j != i and jaccard(texts[i], texts[j]) >= 0.8] for i in range(len(texts))}
    assert len(plain) >= 12 and all(near[i] for i in range(len(texts)) if i not in plain) and all(i in plain for i in near if not near[i])
    assert simhash.keep_similar(table(spark, []), "doc_id").count() == 0


def test_classifier_learns_from_what_the_rules_rejected(spark, tmp_path):
    rng = random.Random(5)
    sentence = lambda: " ".join("".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 9))) for _ in range(12)).capitalize() + "."
    junk = lambda: " ".join("".join(rng.choices("#*$%&|<>ABC123", k=rng.randint(2, 9))) for _ in range(60))
    rows = [(i, " ".join(sentence() for _ in range(8))) for i in range(200)] + [(i, junk()) for i in range(200, 300)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    # 160 good and 60 bad ids are labelled; the rules have rejected all labelled junk
    labels = [(i, int(i < 200)) for i in (*range(160), *range(200, 260))]
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id < 200 or doc_id >= 260")
    kept = {r.doc_id for r in corpus_pipeline.classifier(spark, docs, str(tmp_path)).collect()}
    assert not any(i >= 260 for i in kept) and len(kept) >= 190


@pytest.mark.parametrize("most", [100, 1_000_000])
def test_target_covers_every_trusted_document(spark, monkeypatch, most):
    monkeypatch.setattr(quality_rules, "BROADCAST_IDS", most)
    n = 60_000
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    texts = spark.range(n + 1000).select(F.col("id").alias("doc_id"), F.lit("aaa bbb").alias("text"))
    counts = quality_rules.bucket_counts(texts, quality_rules.trusted_ids(labels)).collect()
    assert sum(r.target for r in counts) == 3 * n and sum(r.corpus for r in counts) == 3 * (n + 1000)


def test_op4_samples_documents(spark):
    got = queries.op4_sampled_segmentations(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "sample", "ids", "log_prob", "inclusion"]


def test_statements_within_longer_lines(spark):
    rng = random.Random(4)
    files = [(f"d/{i}.txt", " ".join(prose(rng, 40)) + " the of and to in was") for i in range(300)]
    files += [
        ("a/1", "Copyright (c) 2020 Jane Doe. Released under the MIT License."), ("a/2", "Copyright 2021 Acme Inc. All rights reserved."), ("a/3", "Released under the MIT License. The of and to in was."),
        ("a/4", " ".join(prose(rng, 300)) + " licensed under the Apache License, Version 2.0 " + " ".join(prose(rng, 300))), ("a/5", "words before\nLicensed under the Apache\nLicense, Version 2.0\nwords after"), ("a/6", "the version of the work in the source was free"),
    ]
    df = spark.createDataFrame(files, "path string, text string")
    got = {r.path: r.own_license for r in licenses.scan_tree(df).collect()}
    assert [got[f"a/{i}"] for i in range(1, 7)] == ["MIT", "All-Rights-Reserved", "MIT", "Apache-2.0", "Apache-2.0", None]
    assert not any(got[f"d/{i}.txt"] for i in range(300))
    scanner = licenses.fit(df)
    assert scanner.frequency["copyright"] == 2 and abs(scanner.idf("was") - (np.log(307 / 303) + 1)) < 1e-9


def test_classifier_collects_a_row_for_each_id(spark, monkeypatch):
    rows = [(i, f"text {'word' if i else '## $$'} number {i}") for i in range(4)]
    labels = spark.createDataFrame([(i, int(i > 0)) for i in range(4)], "doc_id bigint, quality int")
    once = knn_quality.fit(table(spark, rows), labels, F.lit(True))
    seen, collect = [], type(labels).collect
    monkeypatch.setattr(type(labels), "collect", lambda df: seen.append(collect(df)) or seen[-1])
    again = knn_quality.fit(table(spark, rows * 500).repartition(8), labels, F.lit(True))
    assert max(map(len, seen)) == 4
    assert np.array_equal(once.vectors, again.vectors) and np.array_equal(once.labels, again.labels)


def test_units_built_together_are_those_built_alone():
    one = sampling.Sampler(queries.tokenizer_path(queries.SAMPLING_MODEL))
    rng = random.Random(8)
    units = ["▁the", "x", "日本語", "🙂🙂b", "▁", "\x00\x01", "é" * 60, *("".join(rng.choices("abceinorst▁Z7🙂", k=n)) for n in (1, 3, 9, 30, 200))]
    last = {u: one.unit(u) for u in dict.fromkeys(units)}
    one.settle()
    lat = one.lattices
    for u, node in last.items():
        begin = node + 1 - len(u)
        for at, (starts, pieces, p) in enumerate(one.edges(u)):
            e = np.arange(lat.count.data[begin + at]) + lat.first.data[begin + at]
            assert [int(x) + 1 - begin if x >= 0 else 0 for x in lat.to.data[e]] == starts
            assert np.allclose(lat.log_p.data[e], np.log(p), rtol=0, atol=1e-9)
            assert [tuple(lat.ids.data[a : a + n].tolist()) for a, n in zip(lat.ids_at.data[e], lat.ids_n.data[e], strict=True)] == [tuple(x) for x in pieces]


def test_near_dedup_writes_few_files_of_small_tables(spark, monkeypatch):
    rng, written = random.Random(6), []
    base = [prose(rng, 120) for _ in range(20)]
    rows = [(i, " ".join([*base[i % 20], f"end{i}"])) for i in range(120)]
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in held}
    put = simhash.materialize

    def seen(df, name):
        out = put(df, name)
        written.append((name, len(list(Path(out._verbatik_path.removeprefix("file:")).glob("part-*")))))
        return out

    monkeypatch.setattr(simhash, "materialize", seen)
    monkeypatch.setattr(components, "materialize", seen)
    try:
        for name, value in held.items():
            spark.conf.set(name, value)
        kept = {r.doc_id for r in simhash.keep_similar(table(spark, rows)).collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert kept == set(range(20))
    assert len(written) > 5 and all(n <= 2 for name, n in written if name != "near-signatures")


@pytest.mark.parametrize("at_once", [0, 900, 10_000])
def test_components_settled_on_the_driver(spark, at_once):
    rng = random.Random(9)
    edges = [(rng.randrange(700), rng.randrange(700)) for _ in range(400)] + [(i + 1, i) for i in range(1000, 1500)] + [(3, 3), (None, 4)]
    root = {}
    for u, v in edges:
        if u is not None and u != v:
            a, b = root.setdefault(u, u), root.setdefault(v, v)
            root.update({x: min(a, b) for x, r in list(root.items()) if r in (a, b)})
    got = components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint"), at_once=at_once)
    assert {r.node: r.root for r in got.collect()} == root and got.dtypes == [("node", "bigint"), ("root", "bigint")]
    none = spark.createDataFrame([], "u bigint, v bigint")
    assert components.connected_components(none, at_once=at_once).count() == 0


def test_copies_of_queries_are_searched_once(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(4)
    distinct = rng.standard_normal((50, 8)).astype(np.float32)
    rows = [(i, distinct[i % 50].tolist()) for i in range(2000)] + [(40, distinct[40].tolist())] * 30  # a row that is repeated
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    search = ann._by_cell

    def counted(index, k):
        inner = search(index, k)

        def run(batches):
            seen = list(batches)
            n = sum(sum(b.column("kind").to_pylist()) for b in seen)
            (tmp_path / str(random.SystemRandom().random())).write_text(str(n))
            return inner(iter(seen))

        return run

    monkeypatch.setattr(ann, "_by_cell", counted)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 5  # ids divisible by 20 have 5 of the 50 vectors
    assert len(got) == 100
    score = distinct.astype(np.float64) @ distinct.astype(np.float64).T
    for q, some in got.items():
        best = sorted(((-score[q % 50, i % 50], i) for i in range(2000) if i != q))[:20]
        assert [i for i, _ in some] == [i for _, i in best]
        assert np.allclose([s for _, s in some], [-x for x, _ in best], rtol=0, atol=1e-9)


def test_texts_are_taken_block_by_block():
    """A function that gets 1,200 rows in one batch holds the texts of 500 of them, and returns every row."""
    spans = pa.array([[{"lo": 0, "hi": 2}]] * 1200, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200)), pa.array([f"text {i}" for i in range(1200)]), spans], ["doc_id", "_t", "spans"])
    out = list(suffix._cut(200)([batch]))
    assert max(b.num_rows for b in out) <= 500
    assert [(r["doc_id"], r["kept"]) for b in out for r in b.to_pylist()] == [(i, f"xt {i}".encode()) for i in range(1200)]
    assert list(suffix._cut(200)([batch.slice(0, 0)])) == []


def test_idle_worker_forgets_words(monkeypatch):
    """What a worker remembers goes when no task uses it for a while, but not while one does."""
    monkeypatch.setattr(common, "IDLE_S", 0.2)
    monkeypatch.setattr(packing, "_WORKER", {"path": "words"})
    common.forget_when_idle("tokenizers", packing._WORKER)
    common.in_use("tokenizers")
    time.sleep(0.5)
    assert packing._WORKER
    common.forget_when_idle("tokenizers", packing._WORKER)
    time.sleep(0.6)
    assert not packing._WORKER
