"""The operators for training data against brute force, round trips and held-out rows."""

import gzip
import hashlib
import random
import re
import struct
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from verbatik.llm import ann, components, knn_quality, langid, licenses, packing, quality_rules, sampling, simhash, suffix, warc  # noqa: E402

DOCS = "doc_id bigint, text string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def odd_texts():
    """Nulls, blanks, copies, ties, and a long text."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 5)))
    base = [" ".join(word() for _ in range(60)) for _ in range(6)]
    long = " ".join(word() for _ in range(6000))
    return [None, "", " \t\n", "a", "a", *base, base[0], base[1] + " end", long]


def clash(df):
    """Extra columns with the names that operators use."""
    for name in ("fp", "kid", "h", "t", "score", "kept", "piece", "salt", "rank", "id", "i"):
        df = df.withColumn(name, F.lit("x"))
    return df


# ---- op 1 ----


def simhash_brute(text, width=3):
    w = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_brute(fp):
    root = {i: i for i in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fp}


def test_simhash(spark):
    rows = list(enumerate(odd_texts()))
    got = simhash.near_duplicates(clash(docs(spark, rows))).collect()
    fp = {i: simhash_brute(t) for i, t in rows}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{x:016x}" for i, x in fp.items()}
    assert {r.doc_id: r.component_id for r in got} == classes_brute(fp)
    kept = simhash.keep_one(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes_brute(fp).values()))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    twice = simhash.near_duplicates(docs(spark, [(3, "x y z"), (3, "x y z"), (None, "x y z"), (2, "q")])).collect()
    assert Counter((r.doc_id, r.component_id) for r in twice) == Counter([(3, 3), (3, 3), (None, 3), (2, 2)])


@pytest.mark.parametrize(("radius", "bucket_rows"), [(1, 4000), (2, 4000), (2, 5), (3, 4000), (7, 8)])
def test_links_connect_all_near_fingerprints(spark, monkeypatch, radius, bucket_rows):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket_rows)
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds[:20]:
        x = int(s)
        for _ in range(8):  # chains and clusters
            x ^= 1 << int(rng.integers(64))
            fps.add(x if rng.random() < 0.8 else x ^ (1 << int(rng.integers(64))))
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.links(docs(spark, [(x,) for x in signed], "fp bigint"), radius)
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in zip(fps, signed, strict=True):
        for b, y in zip(fps, signed, strict=True):
            if (a ^ b).bit_count() <= radius:
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
    assert {x: got.get(x, x) for x in signed} == {x: find(x) for x in signed}


def test_bucket_links_span_what_pairs_connect():
    rng = np.random.default_rng(9)
    fps = np.unique(rng.integers(0, 1 << 9, 120, dtype=np.uint64))
    own = rng.random(len(fps)) < 0.5
    u, v = simhash.bucket_links(fps, own, 1)
    pair = lambda a, b: (int(fps[a]) ^ int(fps[b])).bit_count() <= 1 and (own[a] or own[b])
    assert all(pair(a, b) for a, b in zip(u, v, strict=True)) and len(u) < len(fps)

    def classes(edges):
        root = list(range(len(fps)))
        for _ in root:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert classes(list(zip(u.tolist(), v.tolist(), strict=True))) == classes([(a, b) for a in range(len(fps)) for b in range(a) if pair(a, b)])


def test_wide_candidates_hold_all_pairs_within_the_radius():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 63, (200, 4), dtype=np.uint64)
    p = simhash.plan(fps, 10**6, 20, [12, 16])
    for row in fps[:40]:
        other = simhash.bit_matrix(row[None])[0]
        other[rng.choice(256, 20, replace=False)] ^= 1
        pair = np.stack([row, np.packbits(other, bitorder="little").view("<u8")])
        keys, own = simhash.probe_keys(pair, p)
        assert set(keys[0]) & set(keys[1][own]) or set(keys[1]) & set(keys[0][own])


def test_plan_spends_the_radius():
    rng = np.random.default_rng(0)
    for total in (100, 10**6, 10**10):
        p = simhash.plan(rng.integers(0, 2**63, (500, 1), dtype=np.uint64), total, 2)
        assert sum(t + 1 for t in p.thresholds) == 3 and sorted(b for x in p.parts for b in x) == list(range(64))


# ---- op 2 ----


def repeats_brute(texts, n):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + n] for d in data for p in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - n + 1):
            if seen[d[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        spans = sum(1 for k in range(len(d)) if gone[k] and not (k and gone[k - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("length", [20, 200])
def test_suffix(spark, length):
    rng = random.Random(7)
    passages = ["".join(rng.choices("abé \n", k=rng.randint(length // 2, 2 * length))) for _ in range(8)]
    texts = odd_texts() + ["x" * 3 * length, "ab" * length]
    for _ in range(60):
        texts.append("".join(rng.choice(passages)[rng.randint(0, 5) :] + "".join(rng.choices("abc", k=rng.randint(0, 30))) for _ in range(rng.randint(1, 5))))
    got = suffix.remove_repeats(clash(docs(spark, list(enumerate(texts)))), length=length).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == repeats_brute(texts, length)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)
    assert suffix.remove_repeats(docs(spark, [])).count() == 0


def test_suffix_sort_orders():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 99, 600).astype(np.uint8)
    start = np.arange(400)
    bucket = rng.integers(0, 5, 400)
    order = suffix.suffix_sort(text, suffix.prefix_hashes(text), start, bucket, 50)
    assert order.tolist() == sorted(range(400), key=lambda i: (bucket[i], bytes(text[i : i + 50]), i))


def test_segments_cross_slices(monkeypatch):
    data = bytes(np.random.default_rng(3).integers(97, 100, 5000).astype(np.uint8))
    whole = suffix.segments(data)
    starts = lambda s: {int(p): int(h) for f, e, _, h, _ in s.T for p in range(int(f), int(e) + 1)}
    monkeypatch.setattr(suffix, "SLICE", 700)
    assert starts(suffix.segments(data)) == starts(whole) and len(starts(whole)) == 4801


# ---- op 3 ----


def test_warc(spark, tmp_path):
    big, huge = "<p>é\r\n\r\n</p>" * 100, "z" * 300_000
    rows = [(1, "http://www.a.org/x", big), (5, "https://a.org/x#f", big), (3, None, big), (2, "http://b.a.org:81/?b=2&a=1", huge), (4, "::bad", None), (6, "", "small"), (7, "", "small"), (None, "http://c", "q" * 1000), (9, "u", "t" * 2000), (9, "v", "t" * 2000)]
    pages = docs(spark, rows, "page_id bigint, url string, html string").withColumn("kind", F.lit(1)).withColumn("n", F.lit(2))
    back, path = warc.archive(pages, str(tmp_path / "w"))
    got = {(r.page_id, r.url): (r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in back.collect()}
    for i, u, h in rows:
        kind, _, n, digest = got[i, u]
        assert (n, digest) == (len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest())
    kinds = {k: v[:2] for k, v in got.items()}
    assert kinds[5, rows[1][1]] == ("response", None) and kinds[1, rows[0][1]] == kinds[3, None] == ("revisit", 5)
    assert kinds[6, ""] == kinds[7, ""] == ("response", None) and sorted([kinds[9, "u"], kinds[9, "v"]]) == [("response", None), ("revisit", 9)]
    assert back.count() == len(rows)
    heads = [gzip.decompress(f[a : a + n]).split(b"\r\n\r\n")[0] for p in sorted((tmp_path / "w" / "archive").glob("part-*")) for f in [p.read_bytes()] for a, n, raw in warc.members(f) if raw]
    assert len({re.search(rb"WARC-Record-ID: (\S+)", h)[1] for h in heads}) == len(rows)
    index = warc.CaptureIndex(spark, f"{path}/index")
    urls = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    found = index.captures(urls("http://a.org/x", "HTTP://A.org/x", rows[3][1], "http://nowhere/"))
    assert sorted(r.page_id for r in found.collect()) == [1, 2, 5]
    fetched = {r.page_id: r for r in index.fetch(found).collect()}
    assert bytes(fetched[5].payload).decode() == big and fetched[1].record_type == "revisit" and bytes(fetched[2].payload).decode() == huge
    assert index.captures(urls("http://nowhere/")).count() == 0 and index.fetch(index.captures(urls("http://nowhere/"))).count() == 0
    assert {bytes(r.payload).decode() for r in warc.read(spark, f"{path}/archive").where("page_id = 2").collect()} == {huge}
    assert warc.archive(pages.limit(0), str(tmp_path / "e"))[0].count() == 0


@pytest.mark.parametrize("schemes", [("file",), ()])
def test_capture_index_finds_and_reads_only_what_is_asked(spark, tmp_path, monkeypatch, schemes):
    """Small blocks and parts, and one URL that many blocks share; ranges read by tasks, or whole files through Spark."""
    monkeypatch.setattr(warc, "RANGE_SCHEMES", schemes)
    rows = [(i, f"http://h{i % 7}.org/{i % 50}" if i % 3 else "http://hot.org/", "p" * (i % 90)) for i in range(900)]
    pages = docs(spark, rows, "page_id bigint, url string, html string")
    path = str(tmp_path / "w")
    warc.write(pages, f"{path}/archive", per_file=100)
    warc.build_index(warc.read(spark, f"{path}/archive", with_payload=False), f"{path}/index", lines=16, part_lines=100)
    index = warc.CaptureIndex(spark, f"{path}/index")
    assert len(index.parts) > 4 and index.directory.count() > 50
    for asked in (["http://hot.org/"], ["http://h1.org/1", "http://h2.org/2", "http://h2.org/99"], [r[1] for r in rows]):
        urls = spark.createDataFrame([(x,) for x in asked], "url string")
        want = sorted(r[0] for r in rows if r[1] in asked)
        captures = index.captures(urls)
        got = index.fetch(captures).collect()
        assert sorted(r.page_id for r in captures.collect()) == sorted(r.page_id for r in got) == want
        assert all(bytes(r.payload).decode() == rows[r.page_id][2] for r in got)
    few = spark.createDataFrame([("http://h1.org/1",)], "url string")
    assert index.blocks(few).count() <= 3


def test_files_are_bounded_by_bytes(spark, tmp_path):
    pages = docs(spark, [(i, "http://a/", "".join(random.Random(i).choices("abcdefgh", k=9000))) for i in range(40)], "page_id bigint, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "a"), file_bytes=50_000)
    sizes = [p.stat().st_size for p in (tmp_path / "a").glob("part-*")]
    assert len(sizes) >= 8 and max(sizes) <= 50_000 and warc.read(spark, str(tmp_path / "a")).count() == 40


def test_url_key():
    assert warc.url_key("HTTP://www.B.example.com:80/P?z=1&a=2#f") == "com,example,b)/p?a=2&z=1"
    assert warc.url_key(None) == ")/"


# ---- op 4 ----

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def lattice_brute(s, text):
    """All segmentations of a text by its pieces, and their log probabilities."""
    norm = s.model.normalize(text)

    def ways(at):
        if at == len(norm):
            return [((), 1.0)]
        out = []
        for end in range(at + 1, len(norm) + 1):
            hit = s.pieces.get(norm[at:end]) or (s._fallback(norm[at]) if end == at + 1 else None)
            out += [(hit[0] + ids, hit[1] * p) for ids, p in ways(end)] if hit else []
        return out

    found = ways(0)
    return {ids: np.log(p / sum(x for _, x in found)) for ids, p in found}


def test_sampling_is_unbiased_and_distinct():
    s = sampling.sampler(MODEL)
    p = lattice_brute(s, "the cat")
    assert abs(sum(map(np.exp, p.values())) - 1) < 1e-9
    first, weighted, n = Counter(), Counter(), 4000
    for i in range(n):
        got = s.sample("the cat", 3, b"%d" % i)
        assert len({tuple(x[0]) for x in got}) == 3
        first[tuple(got[0][0])] += 1
        for ids, log_p, inclusion in got:
            assert abs(p[tuple(ids)] - log_p) < 1e-9
            weighted[tuple(ids)] += np.exp(log_p) / inclusion
    for ids, log_p in p.items():
        assert abs(first[ids] / n - np.exp(log_p)) < 0.04 and abs(weighted[ids] / n - np.exp(log_p)) < 0.04
    later = Counter(tuple(s.sample("the cat", 2, b"x%d" % i)[1][0]) for i in range(n))
    p_all = {ids: np.exp(x) for ids, x in p.items()}
    for ids, x in p_all.items():  # the second of two draws without replacement
        assert abs(later[ids] / n - sum(y * x / (1 - y) for other, y in p_all.items() if other != ids)) < 0.04
    for text in ("a,b! é", "😀x  .", "1990s-"):  # characters without a piece, cuts inside words
        ways = lattice_brute(s, text)
        got = s.sample(text, 10_000, b"q")
        assert {tuple(ids.tolist()) for ids, _, _ in got} == set(ways) and len(got) == len(ways)
        assert all(abs(ways[tuple(ids.tolist())] - log_p) < 1e-9 for ids, log_p, _ in got)
    every = s.sample("the cat", 10_000, b"k")
    assert len(every) == len(p) and all(x[2] == 1.0 for x in every)


def test_sample_encode_decode(spark):
    texts = ["Hello wörld, 你好 \U0001f600  x\ny", "", None, "a", "a", "word " * 3000]
    df = docs(spark, list(enumerate(texts))).withColumn("sample", F.lit("clash"))
    got = sampling.sample(df, MODEL, ["doc_id"], k=4)
    back = sampling.decode(got, MODEL).collect()
    by = Counter(r.doc_id for r in back)
    assert all(r.text == (texts[r.doc_id] or "") for r in back) and by[0] == by[5] == 4 and by[1] == by[2] == 1
    again = sampling.sample(df.repartition(3), MODEL, ["doc_id"], k=4)
    key = lambda d: sorted((r.doc_id, r["sample"], tuple(r.ids)) for r in d.collect())
    assert key(got) == key(again)
    enc = sampling.encode(df, MODEL).orderBy("doc_id").collect()
    assert enc[2].ids is None and enc[1].ids == [] and enc[3].ids
    assert sampling.sample(df.limit(0), MODEL, ["doc_id"]).count() == 0


# ---- op 5 ----

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_tokenizer_is_exact():
    from tokenizers import Tokenizer

    plain, fast = Tokenizer.from_file(WORDS), packing.WordTokenizer(WORDS, cache_words=40)
    rng = random.Random(2)
    alphabet = "abZÉß́'’.,!?19 \t\n\x0b\x1c œΣς你#<|>"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(400)] + ["<|endoftext|> don't DON'T it's", "Çà, Straße.", "x" * 3000]
    for t, ids in zip(texts, fast.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORDS)
    texts = odd_texts() + [f"word{i} " * (i % 40) for i in range(120)]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    got = packing.pack_documents(clash(docs(spark, rows)), WORDS, 256).collect()
    want = Counter()
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs: dict = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in got)
    assert len(seqs) <= -(-total // 256) + 1
    assert packing.pack_documents(docs(spark, []), WORDS).count() == 0


def test_plan_matches_best_fit():
    rng = random.Random(5)
    for _ in range(30):
        lengths = [rng.randint(1, 50) for _ in range(rng.randint(1, 300))]
        slots, opened = packing.plan_slots(dict(Counter(lengths)), 50)
        rooms: list[int] = []
        for n in sorted(lengths, reverse=True):
            fit = [r for r in rooms if r >= n]
            if fit:
                rooms[rooms.index(min(fit))] -= n
            else:
                rooms.append(50 - n)
        assert sum(s.n for s in slots) == len(lengths) and abs(opened - len(rooms)) <= 1


# ---- op 6 and op 10: held-out rows ----


def junk_and_prose(n):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("aeinrst", k=rng.randint(2, 8)))
    good = [". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(rng.randint(2, 6))) + "." for _ in range(n)]
    bad = [" ".join(word() + rng.choice(["***", "&&&", "###"]) for _ in range(30)) for _ in range(n // 2)] + [" ".join([word()] * 9 + [word()] * 9) for _ in range(n // 2)]
    return good, bad


def test_quality_classifier(spark):
    good, bad = junk_and_prose(120)
    rows = list(enumerate(good + bad)) + [(1000, None), (1001, ""), (1002, "x " * 20_000)]
    labels = docs(spark, [(i, int(i < 120)) for i in range(240)] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    df = clash(docs(spark, rows))
    model = knn_quality.fit(df, labels, F.col("doc_id") % 3 != 0)
    got = {r.doc_id: r.score for r in knn_quality.score(df, model).collect()}
    assert len(got) == 243 and all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001] == model.prior
    held = [i for i in range(240) if i % 3 == 0]
    assert np.mean([(got[i] >= 0.7) == (i < 120) for i in held]) > 0.95
    assert knn_quality.score(docs(spark, []), model).count() == 0
    none = knn_quality.fit(df, labels.limit(0), F.lit(True))
    assert {r.score for r in knn_quality.score(docs(spark, [(1, "a")]), none).collect()} == {0.5}


def test_neighbours_are_exact():
    rng = np.random.default_rng(0)
    counts = rng.poisson(1.0, (40, knn_quality.TERMS)).astype(np.float32)
    m = knn_quality.train(counts, rng.integers(0, 2, 40), 8)
    text = "Some text, of 3 lines\nand\nmore."
    v = knn_quality._unit(knn_quality._weigh(knn_quality.term_counts(text)[None], m.idf) @ m.projection)[0]
    cos = m.vectors @ v
    best = np.argsort(-cos)[: knn_quality.NEIGHBOURS]
    w = np.maximum(cos[best], 0) ** knn_quality.SHARPNESS + 1e-9
    assert abs(m.score([text])[0] - (w * m.labels[best]).sum() / w.sum()) < 1e-6


def test_language_id(spark):
    rng = random.Random(3)
    kinds = {"xx": "the of and whing ther".split(), "yy": "der und schei ung zwi".split()}
    rows = [(i, " ".join(rng.choice(kinds[k]) + rng.choice(["", "a", "o"]) for _ in range(40)), k) for i in range(120) for k in [("xx", "yy")[i % 2]]]
    rows += [(200, None, "xx"), (201, "", None), (202, "12 ## 34", "yy"), (203, "the " * 5000, None), (None, "der und", "yy")]
    df = docs(spark, rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit(1))
    raw = langid.dictionaries(df, F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r for r in langid.identify(df, raw).collect()}
    assert list(raw) == ["xx", "yy"] and all(got[i].lang_pred == langid.UNKNOWN and got[i].score == 0 for i in (200, 201, 202)) and got[203].lang_pred == "xx"
    held = [r for r in rows if r[0] is not None and r[0] < 200 and r[0] % 3 == 1]
    assert all(got[i].lang_pred == k and 0.5 < got[i].score <= 1 for i, _, k in held)
    # each dictionary: whole texts of its language, one for each bucket
    texts = {t: k for i, t, k in rows if i is not None and i % 3 != 1 and k}
    for k, d in raw.items():
        parts = d.decode().split("\n")[:-1]
        assert len(parts) == len(set(parts)) > 20 and all(texts[x] == k for x in parts)
    # sizes: all blocks of the whole text, each compressed on its own
    text = rows[0][1].upper() * 40
    data, sizes = text.lower().encode(), {}
    for k, d in raw.items():
        params = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, write_checksum=0, write_content_size=0, write_dict_id=0)
        coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
        sizes[k] = sum(len(coder.compress(data[i : i + langid.BLOCK_BYTES])) for i in range(0, len(data), langid.BLOCK_BYTES))
    odds = {k: np.exp(-langid.SHARPNESS * n / len(data)) for k, n in sizes.items()}
    lang, score, rejected = langid.Compressor(raw).predict(text)
    assert lang == min(sizes, key=sizes.get) == "xx" and abs(score - odds["xx"] / sum(odds.values())) < 1e-9 and rejected == (sizes["yy"] - sizes["xx"] < langid.MARGIN * sizes["xx"])
    only_long = docs(spark, [(1, "the " * 5000, "xx"), (2, "the " * 3000, "xx"), (3, "x", "zz")], "doc_id bigint, text string, lang string")
    assert langid.dictionaries(only_long, F.lit(True)) == {"xx": b"the " * 3000 + b"\n", "zz": b"x\n"}
    with pytest.raises(ValueError):
        langid.dictionaries(spark.range(600).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.col("id").cast("string").alias("lang")), F.lit(True))
    assert langid.dictionaries(df.limit(0), F.lit(True)) == {} and langid.identify(docs(spark, [(1, "abc")]), {}).first().lang_pred == langid.UNKNOWN


# ---- op 7 ----


def rules_brute(text):
    w = SPACE.findall(text or "")
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    cover = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_rules(spark):
    good, bad = junk_and_prose(60)
    texts = odd_texts() + ["a b c d e a b c d e", "x x x x x x x", "l\nl\n\n \nm\r\nl#*", "\x0b\x1c é é"] + good + bad
    rows = list(enumerate(texts))
    df = clash(docs(spark, rows)).drop("kept")
    first = len(texts) - len(good) - len(bad)
    trusted = quality_rules.trusted_ids(docs(spark, [(i, 1) for i in range(first, first + 40)] + [(first, 0), (None, 1)], "doc_id bigint, quality int"))
    ids = {r.id for r in trusted.collect()}
    assert ids == set(range(first + 1, first + 40))
    out = quality_rules.assess(df, trusted, prior=0.01)
    got = {r.doc_id: r for r in out.collect()}
    for i, t in rows:
        r, want = got[i], rules_brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)
    kept = {r.doc_id for r in out.where("kept").collect()}
    assert kept >= ids and not kept & set(range(first + len(good), first + len(good) + 30))
    assert quality_rules.assess(docs(spark, []), trusted).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def gram_buckets(text):
    """Buckets of words and pairs of neighbours, by XXH64 as Spark chains it."""
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in SPACE.findall(text or "")]
    chained = lambda a, b: xxhash.xxh64_intdigest(struct.pack("<Q", b), xxhash.xxh64_intdigest(struct.pack("<Q", a), 42))
    return [x % quality_rules.BUCKETS for x in h + [chained(a, b) for a, b in zip(h, h[1:])]]  # noqa: B905


def test_log_ratios_of_documents(spark):
    """Counts, ratios and every document's mean ratio against plain Python."""
    good, bad = junk_and_prose(30)
    rows = list(enumerate(odd_texts() + good + bad)) + [(3, "a repeated id"), (None, "no id at all")]
    first = len(odd_texts())
    trusted = docs(spark, [(i,) for i in (*range(first, first + 20), 3)], "id bigint")
    target, corpus = Counter(), Counter()
    for i, t in rows:
        corpus.update(gram_buckets(t))
        if i == 3 or (i is not None and first <= i < first + 20):
            target.update(gram_buckets(t))
    n, share = quality_rules.BUCKETS, lambda b: (corpus[b] + 1) / (corpus.total() + quality_rules.BUCKETS)
    ratio = lambda b: np.log((target[b] + quality_rules.PRIOR * n * share(b)) / (target.total() + quality_rules.PRIOR * n) / share(b))
    counts = {r.bucket: (r.corpus, r.target) for r in quality_rules.bucket_counts(docs(spark, rows), trusted).collect()}
    assert counts == {b: (c, target[b]) for b, c in corpus.items()}
    got = quality_rules.assess(docs(spark, rows), trusted).collect()
    want = {t: np.mean([ratio(b) for b in gram_buckets(t)] or [0.0]) for _, t in rows}
    assert len(got) == len(rows) and all(abs(r.llr - want[r.text]) < 1e-4 for r in got)
    none = quality_rules.assess(docs(spark, rows), trusted.limit(0)).collect()
    assert all(r.llr == 0 for r in none) and all(r.kept == (not r.base_failed) for r in none)


# ---- op 8 ----


def test_licenses(spark):
    files = [
        ("src/LICENSE", "MIT License text\nReleased under the MIT License."), ("src/a.txt", "prose without any"), ("src/sub/deep/b.txt", None), ("src/sub/c.txt", "Licensed under the Apache License, Version 2.0.\ncode"),
        ("src/gpl/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("src/gpl/x/d.txt", "a version of the license of the work"), ("other/e.txt", "long " * 5000 + "\nLicensed under CC BY-NC 4.0."), ("f.txt", ""), (None, "x"), ("src/gpl/copy", "same"), ("src/gpl/copy", "same"),
    ]
    df = docs(spark, files, "path string, text string").withColumn("anc", F.lit(1)).withColumn("dir", F.lit(2)).withColumn("license", F.lit(3))
    out = licenses.scan_tree(df)
    got = {r.path: (r.own_license, r.license, r.inherited_from) for r in out.collect()}
    assert out.count() == len(files)
    assert got["src/a.txt"] == (None, "MIT", "src") and got["src/sub/deep/b.txt"] == (None, "MIT", "src") and got["src/sub/c.txt"] == ("Apache-2.0", "Apache-2.0", None)
    assert got["src/gpl/x/d.txt"] == (None, "GPL-3.0", "src/gpl") and got["other/e.txt"][0] == "CC-BY-NC-4.0" and got["f.txt"] == got[None] == (None, None, None) and got["src/gpl/copy"][1] == "GPL-3.0"
    assert licenses.scan_tree(df.limit(0)).count() == 0


def licenses_brute(files):
    """Own licence and similarity of each (path, text), without the sieve and with every term counted."""
    find = lambda t: licenses._WORD.findall((t or "").lower())
    sets = [set(licenses.terms(t or "")) for _, t in files]
    n, df = sum(bool(find(t)) for _, t in files), Counter(x for s in sets for x in s)
    idf = lambda t: np.log((1 + n) / (1 + df[t])) + 1

    def unit(counts):
        v = {t: c * idf(t) for t, c in counts.items()}
        norm = np.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    cos = lambda a, b: sum(x * b.get(t, 0.0) for t, x in a.items())
    templates = [(name, unit(licenses.terms(s)), k) for k, (name, s) in enumerate(licenses.TEMPLATES)]
    out = []
    for path, text in files:
        low, w = (text or "").lower(), find(text)
        parts = [p for x in low.split("\n") for p in (x, *licenses._SENTENCE.split(x))]
        if re.match(licenses.LICENSE_FILE, path.rsplit("/", 1)[-1]):
            parts.append(low)
        found = [(cos(unit(licenses.terms(p)), u), name, k) for p in parts for name, u, k in templates]
        found += [(cos(unit(licenses._terms(w[i : i + licenses.LENGTHS[k]])), u), name, k) for name, u, k in templates for i in range(max(0, len(w) - licenses.LENGTHS[k]) + 1)]
        _, c, name = max([(round(min(1.0, c), 9) * licenses.LENGTHS[k] ** 0.5, c, name) for c, name, k in found if c >= licenses.THRESHOLD], default=(0, 0.0, None))
        out.append((name, min(1.0, c)))
    return out


BSD_HEADER = """Copyright (c) 2011, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice."""
BSD_CLAUSE = """3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""


def test_licenses_equal_unsieved_scan(spark):
    rng = random.Random(6)
    words = [w for w in licenses.VOCABULARY if isinstance(w, str)] + [f"w{i}" for i in range(60)]
    files = [(f"d/{i}.c", "\n".join(" ".join(rng.choices(words, k=rng.randint(1, 14))) for _ in range(rng.randint(1, 4)))) for i in range(60)]
    for i, (_, statement) in enumerate(licenses.TEMPLATES):
        w = statement.split()
        w.insert(len(w) // 2, "\n * ")
        files += [(f"t/{i}.c", f"some code {statement} and more"), (f"t/{i}.h", "/* " + " ".join(w) + " */"), (f"t/{i}/LICENSE", statement)]
    files += [("b/LICENSE", BSD_HEADER + "\n" + BSD_CLAUSE), ("b2/LICENSE", BSD_HEADER), ("e", None)]
    df = docs(spark, files, "path string, text string")
    scanner = licenses.fit(df, width=1 << 22)  # wide enough that no two terms share a count
    got = {r.path: (r.own_license, r.similarity) for r in licenses.scan(df, scanner).collect()}
    for (path, _), (name, cos) in zip(files, licenses_brute(files), strict=True):
        assert got[path][0] == name and abs(got[path][1] - cos) < 1e-9, path
    assert got["b/LICENSE"][0] == "BSD-3-Clause" and got["b2/LICENSE"][0] == "BSD-2-Clause"
    assert [(i, x, name, got[f"t/{i}{x}"]) for i, (name, _) in enumerate(licenses.TEMPLATES) for x in (".c", ".h", "/LICENSE") if got[f"t/{i}{x}"][0] != name] == []


def test_sketch_counts_no_term_too_low(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{int(rng.expovariate(0.02))}" for _ in range(30)) for _ in range(200)] + ["license", None, ""]
    scanner = licenses.fit(docs(spark, list(enumerate(texts))), width=1 << 14)
    df = Counter(t for x in texts for t in set(licenses.terms(x or "")))
    assert scanner.files == 201 and scanner.frequency["license"] == 1
    exact = {t: np.log(202 / (1 + n)) + 1 for t, n in df.items()}
    assert all(scanner.idf(t) <= x + 1e-9 for t, x in exact.items())
    assert np.mean([abs(scanner.idf(t) - x) < 1e-9 for t, x in exact.items()]) > 0.9


@pytest.mark.parametrize("name", ["Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0"])
def test_real_license_files(spark, name):
    path = Path("/usr/share/common-licenses") / name
    if not path.exists():
        pytest.skip("no licence files here")
    text = path.read_text()
    files = [("p/LICENSE", text), ("q/LICENSE", text[:1500]), *((f"d/{i}", "plain words about other things " + str(i)) for i in range(40))]
    got = {r.path: r.own_license for r in licenses.scan_tree(docs(spark, files, "path string, text string")).collect()}
    assert got["p/LICENSE"].startswith(name) and got["q/LICENSE"].startswith(name) and sum(v is not None for v in got.values()) == 2


def test_license_sieve_loses_nothing():
    rng = random.Random(8)
    words = [w for w in licenses.VOCABULARY if isinstance(w, str)]
    s = licenses.Scanner(1000, {w: rng.randint(0, 900) for w in licenses.VOCABULARY}, np.zeros((2, 8), np.int64))
    vectors, wanted = s.prepared()
    for _ in range(3000):
        line = " ".join(rng.choices(words, k=rng.randint(1, 12)))
        if any(licenses._cosine(s.vector(line), u) >= licenses.THRESHOLD for _, u in vectors):
            assert not wanted.isdisjoint(licenses._WORD.findall(line.lower()))


# ---- op 9 ----


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    centers = rng.standard_normal((12, 16))
    x = (centers[rng.integers(0, 12, 1500)] + 0.6 * rng.standard_normal((1500, 16))) * rng.uniform(0.5, 2, (1500, 1))
    x[100:160] = x[40]  # copies
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(5001, None), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [None] * 16), (5005, [1.0] * 3), (None, [1.0] * 16)]
    df = docs(spark, rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1)).withColumn("keys", F.lit(1))
    got: dict = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    full = np.array([v for _, v in rows[:1500]])
    hit = n = 0
    for q in range(0, 1500, 20):
        s = ann.dots(full, np.broadcast_to(full[q], full.shape))
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -s))[:20]
        assert [r["rank"] for r in got[q]] == list(range(1, 21)) and all(r.score == s[r.vec_id] for r in got[q])
        assert [(-r.score, r.vec_id) for r in got[q]] == sorted((-r.score, r.vec_id) for r in got[q])
        hit, n = hit + len({r.vec_id for r in got[q]} & set(want.tolist())), n + 20
    assert set(got) == set(range(0, 1500, 20)) and hit / n >= 0.9
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    assert [r.vec_id for r in ann.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()].__len__() == 2


def test_probes_are_the_most_successful_buckets():
    """Against all buckets of three projections: those visited are the first by success, and reach the target."""
    f, distance = np.array([[0.5, 0.1, 7.3]]), 1.3
    slots, p = ann._slot_chances(f, distance)
    every = sorted(((p[0, 0, a] * p[0, 1, b] * p[0, 2, c], (slots[0, 0, a], slots[0, 1, b], slots[0, 2, c])) for a in range(p.shape[2]) for b in range(p.shape[2]) for c in range(p.shape[2])), reverse=True)
    for target in (0.1, 0.6, 0.999):
        row, keys = ann.probes(f, np.array([4]), distance, target)
        first = np.array([x[1] for x in every[: len(keys)]])
        assert not row.any() and sum(x[0] for x in every[: len(keys)]) >= target
        places = np.zeros((len(first), 5, 3))
        places[:, 4] = first + 0.5
        assert set(keys.tolist()) == set(ann.bucket_keys(places)[:, 4].tolist())
    with pytest.raises(ValueError):
        ann.probes(f, np.array([0]), distance, 1.0)


def test_tolerance_grows_with_the_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8)) * 1e9
    x[1:120] = x[0] * (1 + 1e-15 * rng.standard_normal((119, 1)))
    index = ann.Index(8, float(np.linalg.norm(x, axis=1).max()), 1.0, 4, 3, 0.5)
    shard = ann.Shard(index, np.arange(300), x)
    ids, score = shard.search(x[:1], 10)[0]
    at = shard.candidates(x[:1], 10)[0]
    exact = ann.dots(x[at], x[0])
    assert ids.tolist() == at[np.lexsort((at, -exact))[:10]].tolist() and score.tolist() == sorted(exact, reverse=True)[:10]


# ---- components ----


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 10), (10, 11), (11, 12), (3, 1)] + [(100, k) for k in range(101, 160)]
    got = {r.node: r.root for r in components.connected_components(docs(spark, edges, "u bigint, v bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, **dict.fromkeys((8, 9, 10, 11, 12), 8), **dict.fromkeys(range(100, 160), 100)}
    assert components.connected_components(docs(spark, [], "u bigint, v bigint")).count() == 0
