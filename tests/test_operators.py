import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

from verbatik.functions import punctuate as pn
from verbatik.functions import text as tx
from verbatik.operators import punctuation, refine, state, subtitles, summary, translate
from verbatik.plans import pipeline
from verbatik.sources import config
from verbatik.sources import segments as sg

SEG = "transcript_id bigint, pos int, id double, start_s double, end_s double, text string"


def segs(spark, texts, times=None):
    times = times or [(10.0 * i, 10.0 * i + 5) for i in range(len(texts))]
    return spark.createDataFrame([(1, i, float(i), *times[i], t) for i, t in enumerate(texts)], SEG)


def texts(df):
    return [r.text for r in df.orderBy("pos", *(["part"] if "part" in df.columns else [])).collect()]


def test_cleaning_steps(spark):
    assert texts(refine.drop_empty(segs(spark, ["a", "   ", ""]))) == ["a"]
    assert texts(refine.drop_punctuation_only(segs(spark, ["!", "?", "...", "@#$", "- -", "é!"]))) == ["- -", "é!"]
    assert texts(refine.strip_leading(segs(spark, ["  \ta", "\ta"]))) == ["a", "\ta"]
    assert texts(refine.drop_duplicates(segs(spark, ["Thank you.", "thank you.", " THANK YOU.", "Thank you.", "x", "x"]))) == ["x", "x"]


@pytest.mark.parametrize(("before", "after"), [("Bravo !", "Bravo!"), ("Hello , world .", "Hello , world ."), ("... ... ... ... ...", "..."), ("Wait!!!!!! Why???", "Wait! Why?"), ("a....b  c", "a...b c")])
def test_punctuation(spark, before, after):
    assert texts(refine.fix_punctuation(segs(spark, [before]))) == [after]


def test_repeats(spark):
    got = refine.remove_repeated_words(segs(spark, ["Trump Trump Trump Trump test.", "Word, word, word, word, word.", "a a a b", ""]))
    assert [(r.text, r.n_words_removed) for r in got.orderBy("pos").collect()] == [("Trump test.", 3), ("Word,", 4), ("a a a b", 0), ("", 0)]
    runs = refine.remove_word_runs(segs(spark, ["no x no no no no no yes", "ha ha ha ha ha ha"])).orderBy("pos").collect()
    assert [(r.text, r.n_runs_removed) for r in runs] == [("yes", 1)]
    assert texts(refine.remove_char_patterns(segs(spark, ["abababababab x", "xyxyxyxyxy"]))) == ["x"]


def test_merge_goldens(spark):
    parts = segs(spark, ["Part one", "part two", "part three.", "New sentence here."], [(0.0, 1.0), (1.0, 2.0), (2.0, 3.0), (3.0, 4.0)])
    got = refine.merge_fixpoint(parts).collect()
    assert [(r.text, r.start_s, r.end_s, r.n_merged) for r in got] == [("Part one part two part three. New sentence here.", 0.0, 4.0, 4)]
    assert refine.merge_fixpoint(segs(spark, ["Short fragment", "completion."], [(0.0, 1.0), (7.0, 8.1)])).count() == 2


def test_merge_against_fold(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for t in range(60):
        at, mine = 0.0, []
        for p in range(rng.randint(0, 25)):
            dur = rng.choice([0.5, 1.0, 2.5])
            text = " ".join(["w"] * rng.randint(1, 6)) + rng.choice(["", ".", ","])
            mine.append({"pos": p, "id": float(p), "start_s": at, "end_s": at + dur, "text": text})
            at += dur + rng.choice([0.0, 0.05, 0.5])
        rows += [(t, *r.values()) for r in mine]
        while True:
            out, i = [], 0
            while i < len(mine):
                a, b = mine[i], mine[i + 1] if i + 1 < len(mine) else None
                score = b and 2 * (a["end_s"] - a["start_s"] < 2.0) + (a["text"][-1] not in ".!?") + (len(a["text"].split()) < 5) + (b["start_s"] - a["end_s"] < 0.1)
                if b and score >= 3 and b["end_s"] - a["start_s"] < 8.0:
                    a, i = a | {"end_s": b["end_s"], "text": f"{a['text']} {b['text']}"}, i + 1
                out.append(a)
                i += 1
            if len(out) == len(mine):
                break
            mine = out
        want[t] = [(r["pos"], r["end_s"], r["text"]) for r in mine]
    df = spark.createDataFrame(rows, SEG)
    loop = df
    for _ in range(6):
        loop = refine.merge_pass(loop)
    for result in (refine.merge_fixpoint(df), loop):
        got: dict = {t: [] for t in want}
        for r in result.orderBy("transcript_id", "pos").collect():
            got[r.transcript_id].append((r.pos, r.end_s, r.text))
        assert got == want


def test_split(spark):
    long = "This is the first long sentence here. And this is the second long sentence."
    got = refine.split_blocks(segs(spark, [long, "Short one. Another short.", "» a b. c » d. e"], [(0.0, 10.0)] * 3)).orderBy("pos", "part").collect()
    assert [(r.text, r.start_s, r.end_s) for r in got] == [
        ("This is the first long sentence here.", 0.0, 5.0), (" And this is the second long sentence.", 5.0, 10.0),
        ("Short one. Another short.", 0.0, 10.0), ("» a b.", 0.0, 10 / 3), (" c »", 10 / 3, 20 / 3), (" d.", 20 / 3, 10.0),
    ]
    assert [r.sentences for r in refine.with_sentences(segs(spark, ["a. » b", "»", "no mark"])).orderBy("pos").collect()] == [["a. »"], [], []]


def test_refine_and_statistics(spark):
    df = segs(spark, ["", "!", " Hi there !", "ok ok ok ok now.", *["Merci."] * 4])
    assert texts(refine.refine(df)) == ["Hi there!", "ok now."]
    s = refine.statistics(df).first()
    assert (s.total_input_segments, s.empty_segments_removed, s.punctuation_only_segments_removed, s.leading_spaces_removed, s.duplicate_segments_removed, s.punctuation_fixed, s.repeated_words_removed, s.total_output_segments) == (8, 1, 1, 1, 4, 1, 3, 2)


def test_timestamps_and_srt(spark):
    got = spark.createDataFrame([(x,) for x in (5.627, 65.123, 3661.999, 0.001, 59.9996)], "s double").select(tx.timestamp(F.col("s")).alias("t")).collect()
    assert [r.t for r in got] == ["00:00:05,627", "00:01:05,123", "01:01:01,999", "00:00:00,001", "00:00:59,1000"]
    df = segs(spark, [" Bonjour ", "Salut"], [(0.0, 1.0), (1.0, 2.5)]).withColumn("zh", F.when(F.col("pos") == 0, "你好"))
    assert subtitles.documents(subtitles.cues(df)).first().srt == "1\n00:00:00,000 --> 00:00:01,000\nBonjour\n你好\n\n2\n00:00:01,000 --> 00:00:02,500\nSalut\n"


def test_items_batches_context(spark):
    df = segs(spark, ["...mais", "", *[f" t{i} " for i in range(12)]])
    b = translate.batches(translate.to_items(df), 5).orderBy("batch_no").collect()
    assert [len(x["items"]) for x in b] == [5, 5, 2] and b[1].context == "t2 t3 t4" and b[0].context == "" and b[2].retry_context == "t10"
    assert b[1].batch_id == "batch_02_segments_006_010"
    h = translate.halves(translate.batches(translate.to_items(df), 5)).orderBy("batch_id").collect()
    assert [(x.batch_id[-2:], len(x["items"])) for x in h] == [("_a", 2), ("_b", 3), ("_a", 2), ("_b", 3), ("_a", 1), ("_b", 1)]


def test_chunks(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i"), (2, ""), (3, None)], "transcript_id int, text string")
    got = summary.chunks(df, "text", 4, 1).orderBy("transcript_id", "index").collect()
    assert [(r.transcript_id, r.text) for r in got] == [(1, "a b c d"), (1, "d e f g"), (1, "g h i"), (2, ""), (3, "")]


def test_validity(spark):
    cases = [("你好", "bonjour", True), ("你好", "你好", False), ("12, 5", "x", True), ("Paris", "paris", True), ("un deux trois quatre", "Un deux trois quatre", False), ("", "x", False), ("other text", "x", True)]
    got = spark.createDataFrame(cases, "zh string, fr string, ok boolean").select(translate.is_valid_translation(F.col("zh"), F.col("fr")).alias("v"), "ok").collect()
    assert all(r.v == r.ok for r in got)


def test_responses(spark):
    items = [{"index": 1, "fr": "un"}, {"index": 2, "fr": "deux"}]
    good = [{"index": 1, "zh": "一"}, {"index": 2.0, "zh": "二"}]
    cases = [
        (json.dumps(good), None, None), ("x " + json.dumps(good) + " y", None, None), ("nothing", "no_json", None), ("[1,", "no_json", None), ("[1,]", "bad_json", None), ("{}", "not_a_list", None), ("[]", "count_mismatch", None),
        ('[1, {"index": 2}]', "not_a_dictionary", 0), ('[{"index": 1, "zh": "一"}, {"zh": "二"}]', "missing_index", 1), ('[{"index": 2, "zh": "一"}, {"index": 2}]', "index_mismatch", 0), ('[{"index": 1}, {}]', "missing_zh", 0),
        ('[{"index": 1, "zh": "一"}, {"index": 2, "zh": " "}]', "empty_translation", 1), ("[{“index”: 1, “zh”: “一”}, {“index”: 2, “zh”: “二”}]", None, None), (None, "no_json", None),
    ]
    df = spark.createDataFrame([(i, items, c[0]) for i, c in enumerate(cases)], "n int, items array<struct<index:bigint,fr:string>>, raw_response string")
    got = translate.validate(df).orderBy("n").collect()
    assert [(r.error_code, r.error_pos) for r in got] == [(c[1], c[2]) for c in cases]
    assert translate.sanitize_output('[{"zh": "“你好”"}]') == '[{"zh": "“你好”"}]'
    assert translate.sanitize_output('[{"zh": "她。”}]') == '[{"zh": "她。"}]'


def test_cache_and_halves(spark):
    items = [{"index": 1, "fr": "un"}]
    ok, bad = '[{"index": 1, "zh": "一"}]', "[]"
    rows = [(1, "b_a", items, bad, 2, "r1"), (1, "b_a", items, ok, 1, "r0"), (1, "b_b", items, ok, 1, "r0"), (1, "c_a", items, ok, 1, "r0"), (2, "b_a", items, ok, 1, "r0")]
    df = spark.createDataFrame(rows, "transcript_id int, batch_id string, items array<struct<index:bigint,fr:string>>, raw_response string, written_at int, name string")
    assert sorted((r.transcript_id, r.batch_id) for r in translate.cached_responses(df).collect()) == [(1, "b_a"), (1, "b_b"), (1, "c_a"), (2, "b_a")]
    assert {(r.transcript_id, r.batch_id): len(r.zh) for r in translate.assemble_halves(df).collect()} == {(1, "b"): 2}


def test_merge_translations_last_wins(spark):
    t = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b")], "transcript_id bigint, index bigint, pos int, zh string")
    got = translate.merge_translations(segs(spark, ["x", "y"]), t).orderBy("pos").collect()
    assert [r.zh for r in got] == ["b", None]
    cover = translate.coverage(translate.merge_translations(segs(spark, ["x", "y"]), t)).first()
    assert (cover.segments, cover.translated, cover.coverage) == (2, 1, 50.0)


def test_punctuation_rules():
    assert pn.normalize_output("bonjour,, monde ... il dit: oui. ok") == "Bonjour, monde. Il dit oui. Ok"
    assert pn.rebuild(["bonjour monde", "ça va"], "Bonjour monde. Ça va?")[0] == ["Bonjour monde.", "Ça va?"]
    assert pn.rebuild(["bonjour\nmonde"], "")[0] == ["Bonjour\nmonde"]
    found = pn.align(["a", "bonjour", "c"], ["a", "bonjours", "x", "c"])
    assert found == {0: 0, 1: 1, 3: 2}
    assert pn.second_last_end("A. B. C.") == 5 and pn.second_last_end("A.") is None
    text, reports = pn.punctuate(lambda t: [{"entity_group": ".", "start": 0, "end": 1, "score": 0.5}], " ".join(f"w{i}" for i in range(10)), 4)
    assert sum(r["advance"] for r in reports) == 10 and text.startswith("W0.")


def test_ratio_gate_restore(spark):
    df = spark.createDataFrame([(1, "Bonjour monde.", [(0.0, 0.0, 1.0, "Bonjour monde.")]), (2, " ".join(["mot"] * 20), [(0.0, 0.0, 5.0, " ".join(["mot"] * 20))]), (3, None, None)], "transcript_id bigint, text string, segments array<struct<id:double,start:double,end:double,text:string>>")
    good, poor = punctuation.gate(df)
    assert [r.ratio for r in good.collect()] == [1 / 13] and poor.count() == 2
    new = punctuation.restore(poor, punctuation.mark_classifier)
    assert {r.transcript_id: r.segment_count for r in new.collect()} == {2: 1, 3: 0}
    applied = {r.transcript_id: r for r in punctuation.apply(df, new).collect()}
    assert applied[1].text == "Bonjour monde." and "," in applied[2].segments[0].text


def test_overlap(spark):
    spans = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 6, 200)], "transcript_id int, word int, w_start int, w_end int")
    preds = spark.createDataFrame([(1, 0, 0, 3, "."), (1, 1, 4, 10, ","), (1, 2, 150, 160, "?")], "transcript_id int, n int, start int, end int, label string")
    assert {(r.word, r.label) for r in punctuation.overlap(spans, preds).collect()} == {(0, ","), (1, "?")}


def test_state(spark):
    start = state.initial(spark.createDataFrame([(1,), (2,)], "transcript_id bigint"))
    more = spark.createDataFrame([(1, "transcription", "completed", 1, "a.json"), (1, "refinement", "failed", 2, None), (2, "transcription", "completed", 1, "b.json")], "transcript_id bigint, step string, status string, seq bigint, output string").withColumn("at", F.lit("2024-01-01").cast("timestamp_ntz")).select(*start.columns)
    events = start.union(more)
    assert {r.transcript_id: r.step for r in state.resume_point(events).collect()} == {1: "refinement", 2: "refinement"}
    files = spark.createDataFrame([("a.json",)], "path string")
    assert {r.transcript_id: r.step for r in state.resume_point(events, files).collect()} == {1: "refinement", 2: "transcription"}
    assert state.missing_outputs(events, files).count() == 1
    again = state.prepare_resume(events, "2024-01-02", summary=False)
    assert {r.step: r.status for r in state.latest(again).where("transcript_id = 1").collect()} | {} == {"transcription": "completed", "refinement": "running", "summary": "skipped", "translation": "pending", "validation": "pending", "merging": "pending", "srt_generation": "pending"}
    assert json.loads(state.state_json(again).where("transcript_id = 1").first().state)["pipeline_info"]["status"] == "running"


def test_running_tasks(spark, tmp_path):
    for name, text in (("a", "{bad"), ("b", '{"pipeline_info": {"status": "running"}}'), ("c", '{"pipeline_info": {"status": "done"}}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "state.json").write_text(text)
    assert state.running_tasks(spark, str(tmp_path)).first().path.endswith("b/state.json")


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"text": "x", "segments": [{"id": 3, "start": 0.5, "end": 1.0, "text": " x"}, {"start": 1.0, "end": 2.0}]}))
    rows = sg.explode_segments(sg.read_transcripts(spark, str(tmp_path))).orderBy("pos").collect()
    assert [(r.transcript_id.rsplit("/", 1)[1], r.id, r.text) for r in rows] == [("a.json", 3.0, " x"), ("a.json", 0.0, "")]
    kinds = spark.createDataFrame([("http://h/x.mp3",), ("/d/a.MP3",), ("b.mkv",), ("c.txt",), (None,)], "p string").select(sg.input_kind(F.col("p")).alias("k")).collect()
    assert [r.k for r in kinds] == ["url", "audio", "video", "unsupported", "unsupported"]
    info = spark.createDataFrame([('{"title": "t", "duration": 2, "formats": [{"vcodec": "none"}, {"vcodec": "h264", "height": 720}]}',)], "info string")
    assert len(sg.video_formats(info).first().formats) == 1


def test_config():
    c = config.resolve({"whisper": {"model_path": ["", "m"], "punctuation": {"enabled": False}}, "translation": {"batch_size": 4, "summary": {"enabled": False}}, "min_ram_gb": 2.5})
    assert (c.whisper.model_path, c.whisper.punctuation.enabled, c.translate.batch_size, c.summary.enabled, c.system.min_ram_gb) == ("m", False, 4, False, 2.5)


def _translator(batch):
    """Notes each call in the file that the prompt names first."""
    path, _, rest = batch["prompt"].partition("|")
    with open(path, "a") as f:
        f.write(json.dumps([batch["batch_id"], rest]) + "\n")
    if any("raise" in x["fr"] for x in batch["items"]):
        raise ValueError("no answer")
    if any("never" in x["fr"] for x in batch["items"]) or len(batch["items"]) > 2:
        return json.dumps([{"index": x["index"], "zh": x["fr"]} for x in batch["items"]])
    return json.dumps([{"index": x["index"], "zh": "译" + x["fr"]} for x in batch["items"]])


def _short(kind, text):
    return "SUMMARY " + text[:10]


def test_pipeline_asks_with_prompts_and_resumes(spark, tmp_path):
    segment = lambda i, t: (float(i), 10.0 * i, 10.0 * i + 9, t)
    data = [
        (1, "Bonjour le monde. Salut.", [segment(0, "Bonjour le monde entier, mes amis."), segment(1, "Salut à tous les gens ici."), segment(2, "Encore une phrase pour finir.")]),
        (2, "Un. Deux.", [segment(0, "Il ne sera never traduit, celui-ci."), segment(1, "Mais son voisin le sera bien.")]),
    ]
    df = spark.createDataFrame(data, "transcript_id bigint, text string, segments array<struct<id:double,start:double,end:double,text:string>>")
    log = tmp_path / "calls"
    cfg = config.resolve({"translation": {"translation_prompt": f"{log}|{{summary}}~{{context}}~{{segments}}", "max_retries": 1, "retry_delay": 0}})
    providers = pipeline.Providers(_translator, _short)
    folder = str(tmp_path / "run")
    out = pipeline.run(spark, df, folder, cfg, providers).collect()
    assert [r.transcript_id for r in out] == [1] and all(s.zh == "译" + s.text.strip() for s in out[0].segments) and len(out[0].segments) == 3
    failed = spark.read.parquet(f"{folder}/05_failed").collect()
    assert [(r.transcript_id, r.batch_id, r.error_code) for r in failed] == [(2, "batch_01_segments_001_002_a", "invalid_content")]
    calls = [json.loads(x) for x in log.read_text().splitlines()]
    first = [c for i, c in calls if i == "batch_01_segments_001_003"]
    # two attempts, the second with the batch's own texts as context; then the halves
    assert len(first) == 2 and first[0].startswith("SUMMARY Bonjour le~~[{") and first[1].startswith("SUMMARY Bonjour le~Bonjour le monde entier, mes amis. Salut à tous les gens ici.~[{")
    assert {i for i, _ in calls} == {"batch_01_segments_001_003", "batch_01_segments_001_003_a", "batch_01_segments_001_003_b", "batch_01_segments_001_002", "batch_01_segments_001_002_a", "batch_01_segments_001_002_b"}
    # a run that broke off before its translations were whole asks nothing again that was answered
    for name in ("05_translations", "05_failed", "06_merged", "07_coverage"):
        shutil.rmtree(f"{folder}/{name}")
    again = pipeline.run(spark, df, folder, cfg, providers).collect()
    assert again == out
    new = [json.loads(x)[0] for x in log.read_text().splitlines()][len(calls):]
    assert set(new) == {"batch_01_segments_001_002_a"}
    stages = pipeline.Stages(spark, folder)
    assert stages.complete("08_subtitles") and not stages.complete("09")
    assert pipeline.run(spark, df.limit(0), folder, cfg, providers).count() == 1


def test_provider_errors_and_cache(spark):
    b = spark.createDataFrame([(1, 0, "b", [(1, "un mot de plus")], "", "")], "transcript_id int, batch_no int, batch_id string, items array<struct<index:bigint,fr:string>>, context string, retry_context string")
    got = translate.translate_batches(b, _raises, 2)
    assert got.translations.count() == 0 and [r.error_code for r in got.failed.collect()] == ["no_json"]
    cache = spark.createDataFrame([(1, "b", '[{"index": 1, "zh": "一"}]', 1, "n")], "transcript_id int, batch_id string, raw_response string, written_at int, name string")
    got = translate.translate_batches(b, _raises, 1, cache=cache.withColumn("items", F.lit(None)))
    assert [r.zh for r in got.translations.collect()] == ["一"] and got.failed.count() == 0


def _raises(batch):
    raise RuntimeError("model")


def test_summaries(spark):
    df = spark.createDataFrame([(1, "a b"), (2, " ".join("abcdefghij")), (3, "boom"), (4, None)], "transcript_id int, text string")

    got = {r.transcript_id: (r.summary, r.strategy, r.chunk_count, r.reduce_passes) for r in summary.summarize(df, _summary_or_error, 4, 1).collect()}
    assert got == {1: ("summary:a b", "single_pass", 1, 0), 2: ("reduce:chunk:a", "map_reduce", 3, 1), 3: ("这是一个关于文稿的总结。原文总长度：4字符。", "fallback", 0, 0), 4: ("summary:", "single_pass", 1, 0)}
    assert {r.strategy for r in summary.summarize(df, None).collect()} == {"mock"}
    letters = summary.chunks(df.where("transcript_id = 2"), "text", 8, 2, _letters).orderBy("index").collect()
    assert [(r.token_start, r.token_end, r.text) for r in letters] == [(0, 8, "a b c d "), (6, 14, "d e f g "), (12, 19, "g h i j")]


class _Letters:
    def encode(self, text):
        return [ord(c) for c in text]

    def decode(self, ids):
        return "".join(map(chr, ids))


def _letters():
    return _Letters()


def _summary_or_error(kind, text):
    if "boom" in text:
        raise ValueError("boom")
    return f"{kind}:{text[:3]}".rstrip() if kind == "summary" else f"{kind}:{text.split()[0]}" + (" x y" if kind == "chunk" else "")


def test_merge_when_times_go_back(spark):
    """Against greedy passes over the whole list."""
    from verbatik.operators.refine import _settle

    rng = random.Random(11)
    rows, want, merges = [], {}, {}
    for t in range(300):
        at, segments = 0.0, []
        for pos in range(rng.randint(1, 12)):
            start = max(0.0, at + rng.choice([0, 0, 0.05, 0.5, -0.4, -2.0]))
            end = start + rng.choice([0.3, 0.8, 1.5, 3.0])
            at = end if rng.random() < 0.8 else start
            segments.append({"pos": pos, "id": float(pos), "start_s": start, "end_s": end, "text": " ".join(rng.choices(["mot", "fin.", "oui"], k=rng.randint(1, 6)))})
        rows += [(t, *s.values()) for s in segments]
        noted: list = []
        want[t] = [(s["pos"], s["start_s"], s["end_s"], s["text"], s["n"]) for s in _settle([s | {"n": 1} for s in segments], noted)]
        merges[t] = [(a["id"], b["id"], m["text"]) for a, b, m in noted]
    df = spark.createDataFrame(rows, "transcript_id int, pos int, id double, start_s double, end_s double, text string")
    got: dict = {}
    for r in refine.merge_fixpoint(df).orderBy("transcript_id", "pos").collect():
        got.setdefault(r.transcript_id, []).append((r.pos, r.start_s, r.end_s, r.text, r.n_merged))
    assert got == want
    details: dict = {}
    for r in refine.merge_details(df).collect():
        details.setdefault(r.transcript_id, []).append((r.first_id, r.second_id, r.merged_text))
    assert {t: sorted(m) for t, m in details.items()} == {t: sorted(m) for t, m in merges.items() if m}
    report = {r.transcript_id: (r.merges, r.original_segments, r.net_reduction) for r in refine.merge_report(df).collect()}
    assert report == {t: (len(m), 2 * len(m), len(m)) for t, m in merges.items() if m}


def test_streaming(spark, tmp_path):
    from verbatik.streaming.refine import refine_new_files

    source = tmp_path / "in"
    source.mkdir()
    for n in range(2):
        (source / f"{n}.json").write_text(json.dumps({"text": "", "segments": [{"id": 0, "start": 0.0, "end": 1.0, "text": f"Texte {n} !"}]}))
        refine_new_files(spark, str(source), str(tmp_path / "out"), str(tmp_path / "check"))
    assert {r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"Texte 0!", "Texte 1!"}


def test_text_functions_match_python(spark):
    import re

    rng = random.Random(5)
    alphabet = " \t\n \u0085.,!?é²aAb'…-«»你3_"
    cases = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = df.select("i", tx.strip(F.col("t")).alias("s"), tx.word_count(F.col("t")).alias("n"), tx.normalize_punctuation(F.col("t")).alias("p"), tx.punctuation_ratio(F.col("t")).alias("r")).orderBy("i").collect()
    for r, c in zip(got, cases, strict=True):
        p = re.sub(r"\.\.\.(?:\s+\.\.\.)+", "...", c)
        for pattern, new in ((r"\.{4,}", "..."), (r"([^\w\s]+)(\s+\1){2,}", r"\1"), (r"([^\w\s.])\1{2,}", r"\1"), (r"\s{2,}", " ")):
            p = re.sub(pattern, new, p)
        bare = "".join(c.split())
        ratio = len(re.findall("[.!?…]", bare.replace("...", "…"))) / len(bare) if bare else 0.0
        assert (r.s, r.n, r.p, r.r) == (c.strip(), len(c.split()), p.strip(), ratio)


def _recognizer():
    def run(path, content):
        if not content:
            raise ValueError("empty")
        return {"text": "Oui.", "segments": [{"id": 0, "start": 0, "end": 1, "text": "Oui.", "tokens": [1]}]}

    return run


def test_transcribe(spark):
    from verbatik.sources import transcribe

    media = spark.createDataFrame([("a.wav", b"x"), ("b.wav", b"")], "path string, content binary")
    out = transcribe.transcribe(media, _recognizer)
    got = {r.transcript_id: r for r in out.collect()}
    assert got["a.wav"].segments[0].asDict() == {"id": 0.0, "start": 0.0, "end": 1.0, "text": "Oui."} and got["b.wav"].error == "ValueError: empty"
    assert {r.strategy for r in transcribe.metadata(out).collect()} == {"recognized", "failed"}


def test_guard(spark, tmp_path):
    from verbatik.plans import guard

    (tmp_path / "state.json").write_text('{"pipeline_info": {"status": "running"}}')
    slept = []
    settings = config.System(min_ram_gb=0, task_check_interval=60, max_wait_time_minutes=2)
    assert not guard.ready(spark, str(tmp_path), settings, slept.append) and len(slept) == 3
    (tmp_path / "state.json").write_text('{"pipeline_info": {"status": "completed"}}')
    assert guard.ready(spark, str(tmp_path), settings, slept.append)


def test_transcripts_are_read_again(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"text": "x", "segments": []}')
    for _ in range(2):
        assert [(r.text, r.error) for r in sg.read_transcripts(spark, str(tmp_path)).collect()] == [("x", None)]
