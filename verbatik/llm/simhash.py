"""SimHash near-duplicate detection by the general pigeonhole principle, for any radius.

Bits that vary together are grouped into partitions. A dynamic programme gives each partition its
own threshold (-1: unused) so that the thresholds plus one add up to radius + 1; a pair within the
radius then agrees within the threshold in at least one partition. Every fingerprint is put down
under its own key of each partition and probes the keys within the threshold; what meets in a
bucket is verified there.

Fingerprints have any number of 64-bit words. near_duplicates() links 64-bit ones by their distance.
keep_similar() finds copies by the similarity of their shingles: their fingerprints are wide, as
64 bits don't tell a similarity of 0.8 (such pairs differ in 3 to 14 of them), and candidates are
verified by their shingles.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbatik.llm.common import blocks, discard, in_files, materialize, rows_in
from verbatik.llm.components import connected_components

BITS = 64
#: Fingerprints that the plan of partitions and thresholds is estimated from; every one is probed.
PLAN_SAMPLE = 20_000
WIDE_PLAN_SAMPLE = 4_000
#: Cost of verifying a candidate, in probe keys.
VERIFY_COST = 2.0
#: Candidates of a fingerprint that cost more: beyond these they are links of one group, found with few comparisons.
MOST_CANDIDATES = 2.0
#: Partitions by which groups of near copies are found first; only what stays is put down under the others.
FIRST_PARTS = 12
#: A bucket of more fingerprints is divided by further keys, over tasks, for at most so many rounds.
BUCKET_ROWS = 4_000
DIVISIONS = 6
#: Words of wide fingerprints, and the radius within which every pair of them is a candidate. Pairs of
#: similarity 0.8 differ in about 270 of the 1792 bits; chances of being a candidate: README.
WIDE_WORDS = 28
WIDE_RADIUS = 79
#: Bits that a partition of wide fingerprints has beyond the logarithm of their number.
SPARE_BITS = 4
#: Candidates whose first words differ in more bits aren't as similar as 0.8, but for a chance in 10^4.
WIDE_FIRST_WORD = 21
#: Buckets of at most so many rows are compared pair by pair at once.
SMALL = 32
#: Up to so many ids (eight bytes each) are broadcast to pick out their rows; beyond, texts are dealt by id.
BROADCAST_IDS = 1_000_000
#: Ids that occur more than once, up to so many, are kept apart; beyond, all rows are dealt by id.
REPEATED_IDS = 1_000
#: Links of near copies that are collected to find their groups; of more, groups are found round by round.
LINKS_AT_ONCE = 200_000
_FACTORS = np.random.Generator(np.random.Philox(key=7)).integers(1 << 62, size=1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased: runs of anything but ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many rows of a matrix of 64-bit hashes have each bit, for each column.

    Counts are kept as planes of bits, so that one operation adds 64 of them; the halves of the
    rows are added up until one row is left.
    """
    planes = [hashes]
    while len(planes[0]) > 1:
        if len(planes[0]) % 2:
            planes = [np.concatenate((p, np.zeros((1, p.shape[1]), np.uint64))) for p in planes]
        half, carry, out = len(planes[0]) // 2, None, []
        for p in planes:
            a, b = p[:half], p[half:]
            differ = a ^ b
            out.append(differ if carry is None else differ ^ carry)
            carry = a & b if carry is None else (a & b) | (differ & carry)
        planes = [*out, carry]
    bits = [np.unpackbits(p[0].astype("<u8").view(np.uint8), bitorder="little").astype(np.int64) << k for k, p in enumerate(planes)]
    return sum(bits).reshape(-1, BITS)


def fingerprint(text: str | None, width: int = 3, chunk: int = 1 << 16) -> int:
    """64-bit SimHash of word shingles as a signed integer; null or wordless text gives 0."""
    words = words_of(text)
    if not words:
        return 0
    count, total = np.zeros(BITS, np.int64), max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, chunk):
        part = words[at : at + chunk + width - 1]
        grams = zip(*(part[i:] for i in range(width)), strict=False) if len(words) > width else [words]
        count += bit_counts(np.array([[digest(b" ".join(g), 42)] for g in grams], np.uint64))[0]
    return int(np.packbits(2 * count > total, bitorder="little").view("<i8")[0])


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted hashes of the different word shingles; of fewer words than width, all are one; null or wordless: none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    grams = zip(*(words[i:] for i in range(width)), strict=False) if len(words) > width else [words]
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams], np.uint64))


def wide_fingerprint(hashes: np.ndarray, words: int = WIDE_WORDS, chunk: int = 1 << 12) -> np.ndarray:
    """SimHash of 64-bit hashes in that many words: for each word the hashes are mixed anew."""
    if not len(hashes):
        return np.zeros(words, np.uint64)
    count = np.zeros((words, BITS), np.int64)
    for at in range(0, len(hashes), chunk):
        part = hashes[at : at + chunk]
        mixed = (part ^ (part >> np.uint64(29)))[:, None] * _FACTORS[:words]
        count += bit_counts(mixed ^ (mixed >> np.uint64(32)))
    return np.packbits(2 * count > len(hashes), axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Columns doc_id and fp (bigint) for every row; other columns are not read."""
    schema = docs.select(F.col(id_col).alias("doc_id")).schema
    kind = schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in blocks(batches):
            fp = [fingerprint(t, width) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, fp bigint")


@dataclass(frozen=True)
class Plan:
    """Partitions (lists of bit numbers) and the threshold of each (-1: not probed)."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def _groups(bits: np.ndarray, m: int) -> list[list[int]]:
    """Deal the bits into m equal partitions, each grown from a seed by its most correlated bits."""
    n = bits.shape[1]
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.nan_to_num(np.abs(np.corrcoef(bits.T)) if len(bits) > 1 else np.eye(n))
    free, parts = np.ones(n, bool), []
    for k in range(m):
        want = int(free.sum()) // (m - k)
        part = [int(np.argmax(free))]
        free[part] = False
        near = corr[part[0]].copy()
        while len(part) < want:
            best = int(np.argmax(np.where(free, near, -1.0)))
            part.append(best)
            free[best] = False
            near += corr[best]
        parts.append(sorted(part))
    return parts


def bit_matrix(fps: np.ndarray) -> np.ndarray:
    """Fingerprints (rows of uint64 words) as rows of bits."""
    return np.unpackbits(np.ascontiguousarray(fps).astype("<u8").view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")


def _project(bits: np.ndarray, part) -> np.ndarray:
    """The part's bits of each row as one number (parts of at most 64 bits)."""
    packed = np.packbits(bits[:, list(part)], axis=1, bitorder="little")
    wide = np.zeros((len(bits), 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view("<u8").ravel()


def _share(keys: np.ndarray, width: int, t: int) -> float:
    """Estimated share of ordered pairs within t bits: those of the sample, but at least by chance of independent bits."""
    n_keys = len(keys)
    keys, n = np.unique(keys, return_counts=True)
    pairs, flips = float((n * (n - 1.0)).sum()), 1
    for d in range(1, t + 1):
        for flip in itertools.combinations(range(width), d):
            other = keys ^ np.uint64(sum(1 << f for f in flip))
            at = np.minimum(np.searchsorted(keys, other), len(keys) - 1)
            pairs += float((n * np.where(keys[at] == other, n[at], 0)).sum())
            flips += 1
    return max(pairs / max(1.0, n_keys * (n_keys - 1.0)), flips / 2.0**width)


def plan(sample: np.ndarray, total: int, radius: int, counts: list[int] | None = None, most: int = 1) -> Plan:
    """Cheapest partitions and thresholds for `total` different fingerprints; sample: rows of uint64 words.

    Cost of a partition at threshold t: its probe keys plus the candidates expected from the share
    of the sample's pairs that meet. For each number of partitions a dynamic programme spends the
    radius + 1 units over them; the cheapest of all is taken. Thresholds are at most `most` where
    that suffices.
    """
    bits = bit_matrix(sample)
    n_bits = bits.shape[1]
    counts = counts or sorted({m for m in (2, 3, 4, 5, 6, 8, radius + 1) if -(-n_bits // 64) <= m <= n_bits})
    best: tuple[float, Plan] | None = None
    for m in counts:
        parts, cost = _groups(bits, m), []
        limit = max(most, -(-(radius + 1) // m) - 1)
        for p in parts:
            row, keys = [0.0], _project(bits, p)
            for t in range(min(radius, limit, len(p)) + 1):
                row.append(total * (1 + sum(math.comb(len(p), d) for d in range(1, t + 1)) + VERIFY_COST * min(total * _share(keys, len(p), t), MOST_CANDIDATES)))
            cost.append(row)
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for row in cost:
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (c, ts) in table.items():
                for t1, extra in enumerate(row):
                    u = used + t1
                    if u <= radius + 1 and (u not in step or c + extra < step[u][0]):
                        step[u] = (c + extra, (*ts, t1 - 1))
            table = step
        if radius + 1 in table and (best is None or table[radius + 1][0] < best[0]):
            c, ts = table[radius + 1]
            best = (c, Plan(tuple(map(tuple, parts)), ts))
    if best is None:
        raise ValueError(f"no plan for radius {radius} of {n_bits} bits")
    return best[1]


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def probe_keys(fps: np.ndarray, p: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Keys that each fingerprint is put down under (columns), and which columns are its own keys, not its flips'."""
    bits, keys, own = bit_matrix(fps), [], []
    for i, (part, t) in enumerate(zip(p.parts, p.thresholds, strict=True)):
        if t >= 0:
            base = _project(bits, part)
            for d in range(t + 1):
                for flip in itertools.combinations(range(len(part)), d):
                    keys.append(_mix(base ^ np.uint64(sum(1 << f for f in flip)), (i + 1) << 32))
                    own.append(d == 0)
    return np.stack(keys, axis=1), np.array(own)


def _signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64).view(np.int64)


def _unsigned(column) -> np.ndarray:
    return np.array(column, dtype=np.int64).view(np.uint64)


def bucket_links(fps: np.ndarray, own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within a bucket that connect what its verified pairs connect: at most one for each fingerprint.

    Breadth first: what is found is compared with all that is not yet, so nothing is paired twice.
    A pair counts if its distance is at most `radius` and one of it is here under its own key.
    """
    left, u, v = np.arange(len(fps)), [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= radius
            if not own[at]:
                near &= own[left]
            hit = left[near]
            left = left[~near]
            queue += hit.tolist()
            u.append(hit)
            v.append(np.full(len(hit), at))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *u]), np.concatenate([none, *v])


def _by_bucket(radius: int):
    """Links of every bucket; rows are sorted by key, and a bucket may go on in the next batch."""

    def whole(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rest: tuple = ()
        for b in batches:
            now = (np.array(b.column("key")), _unsigned(b.column("fp")), np.array(b.column("own")))
            now = tuple(map(np.concatenate, zip(rest, now, strict=True))) if rest else now
            if not len(now[0]):
                continue
            last = int(np.searchsorted(now[0], now[0][-1]))
            yield tuple(x[:last] for x in now)
            rest = tuple(x[last:] for x in now)
        if rest:
            yield rest

    def run(batches):
        for key, fp, own in whole(batches):
            cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            us, vs = [], []
            for lo, hi in itertools.pairwise(cuts.tolist()):
                if hi - lo > 1 and own[lo:hi].any():
                    u, v = bucket_links(fp[lo:hi], own[lo:hi], radius)
                    us.append(fp[lo:hi][u])
                    vs.append(fp[lo:hi][v])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(us))), pa.array(_signed(np.concatenate(vs)))], ["u", "v"])

    return run


def links(fps: DataFrame, radius: int = 2, sample: int = PLAN_SAMPLE) -> DataFrame:
    """Links u, v between different fingerprints (column fp, distinct 64-bit) that give their components.

    Every component under "at most `radius` bits apart" is connected by the links, and every link is
    such a pair. A bucket of more than BUCKET_ROWS is divided: its fingerprints are put down anew under
    the bucket's key and each of radius + 1 groups of all bits, in one of which any of its pairs agrees.
    """
    if not 0 < radius < BITS:
        raise ValueError("radius must be from 1 to 63")
    total = rows_in(fps)
    if total < 2:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where("false")
    some = _unsigned([r.fp for r in fps.orderBy(F.xxhash64("fp")).limit(sample).collect()])
    p = plan(some[:, None], total, radius)

    def put(batches):
        for b in batches:
            fp = _unsigned(b.column(0))
            if len(fp):
                keys, own = probe_keys(fp[:, None], p)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(keys.ravel())), pa.array(_signed(np.repeat(fp, keys.shape[1]))), pa.array(np.tile(own, len(fp)))], ["key", "fp", "own"])

    def divide(turn: int):
        order = np.random.default_rng(turn).permutation(BITS)
        groups = np.array_split(order, min(radius + 1, BITS))

        def run(batches):
            for b in batches:
                key, fp = _unsigned(b.column("key")), _unsigned(b.column("fp"))
                if len(fp):
                    bits = bit_matrix(fp[:, None])
                    keys = np.stack([_mix(_project(bits, g) ^ _mix(key, turn), i + 1) for i, g in enumerate(groups)], axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(keys.ravel())), pa.array(_signed(np.repeat(fp, len(groups)))), pa.array(np.repeat(np.array(b.column("own")), len(groups)))], ["key", "fp", "own"])

        return run

    schema, out = "key bigint, fp bigint, own boolean", None
    rows = fps.select("fp").mapInArrow(put, schema)
    for turn in range(DIVISIONS + 1):
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("met")).where("n > 1 and met")
        sizes = materialize(sizes.select("key", (F.col("n") > BUCKET_ROWS).alias("large")), "simhash-buckets")
        met = rows.join(sizes, "key")
        more = turn < DIVISIONS and not sizes.where("large").isEmpty()
        small = (met.where("not large") if more else met).select("key", "fp", "own")
        found = small.repartition("key").sortWithinPartitions("key").mapInArrow(_by_bucket(radius), "u bigint, v bigint")
        found = materialize(found.distinct(), "simhash-links")
        out = found if out is None else out.union(found)
        if not more:
            return out
        rows = materialize(met.where("large").select("key", "fp", "own").mapInArrow(divide(turn), schema), "simhash-divided")
    raise AssertionError


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """Near-duplicate class of every row.

    Returns doc_id, fingerprint (16 lowercase hex digits) and component_id, the smallest doc_id
    among all rows whose fingerprints are reachable over links of at most `radius` bits.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows and
    ids stay, each with its class; null ids count for no minimum (a class of null ids only has a
    null component_id). Extra columns are ignored. An empty table gives an empty result.
    """
    fp = materialize(fingerprints(docs, id_col, text_col, width), "simhash-fp")
    first = materialize(fp.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-first")
    roots = connected_components(links(first.select("fp"), radius))
    joined = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = joined.select("fp", "root").join(least, "root").select("fp", "component_id")
    out = fp.join(classes, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """The rows of docs that are their class's representative: one row for each class.

    The representative has the smallest id; ids are taken to be unique, so of repeated rows of an
    id one stays. Rows of null id can't be told apart and all stay.
    """
    classes = near_duplicates(docs, id_col, text_col, width, radius)
    return without(docs, classes.where("doc_id <> component_id").select(F.col("doc_id").alias("id")), id_col)


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """docs without the ids in gone, and of repeated rows of an id only one; only the ids of docs are shuffled, unless ids repeat."""
    left = docs.join(gone.select(F.col("id").alias("_id")).distinct(), F.col(id_col) == F.col("_id"), "left_anti")
    ids = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id")
    twice = ids.collect() if rows_in(ids.limit(REPEATED_IDS + 1)) <= REPEATED_IDS else None
    if twice == []:
        return left
    if twice is None:
        return left.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).union(left.where(F.col(id_col).isNull()))
    repeated = F.coalesce(F.col(id_col).isin([r[0] for r in twice]), F.lit(False))
    return left.where(~repeated).union(left.where(repeated).dropDuplicates([id_col]))


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """id, number and digest of the different shingles, and the wide fingerprint, from id and t."""

    def run(batches):
        for part in blocks(batches, 256):
            sets = [shingles(t, width) for t in part.column("t").to_pylist()]
            fps = np.concatenate([_signed(wide_fingerprint(s)) for s in sets])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * WIDE_WORDS, pa.int32()), pa.array(fps))
            cols = [pa.array([len(s) for s in sets], pa.int32()), pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()), lists]
            yield pa.RecordBatch.from_arrays([part.column("id"), *cols], ["id", "n", "digest", "fp"])

    return docs.mapInArrow(run, "id bigint, n int, digest binary, fp array<bigint>")


def _wide_keys(sig: DataFrame, p: Plan) -> DataFrame:
    """key, own, id, n and the first word of each fingerprint's keys."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                fps = _unsigned(part.column("fp").flatten()).reshape(part.num_rows, -1)
                keys, own = probe_keys(fps, p)
                row = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(_signed(keys.ravel())), pa.array(np.tile(own, part.num_rows)), part.column("id").take(row), part.column("n").take(row), pa.array(np.repeat(_signed(fps[:, 0]), keys.shape[1]))], ["key", "own", "id", "n", "word"])

    return sig.select("id", "n", "fp").mapInArrow(run, "key bigint, own boolean, id bigint, n int, word bigint")


def _repeated_keys(keys: DataFrame) -> DataFrame:
    """The rows of keys whose key another row has too: one shuffle, of which no group is held."""
    names = keys.columns

    def run(batches):
        held, alike = None, False  # the last row so far, and whether the one before it has its key
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if held is None else [held, b])
            key = np.array(t.column("key"))
            same = key[1:] == key[:-1]
            keep = np.concatenate(([alike], same)) | np.concatenate((same, [False]))
            yield from t.slice(0, len(key) - 1).filter(pa.array(keep[:-1])).to_batches()
            held, alike = t.slice(len(key) - 1).combine_chunks().to_batches()[0], bool(keep[-1])
        if held is not None and alike:
            yield held

    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(run, keys.schema)


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id and the hashes of the shingles, of the rows (id, t) whose id is among ids."""

    def run(batches):
        for b in blocks(batches):
            sets = [_signed(shingles(t, width)) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])

    total = rows_in(ids)
    wanted = docs.join(F.broadcast(ids) if total <= BROADCAST_IDS else ids, "id", "left_semi")
    return in_files(wanted.mapInArrow(run, "id bigint, s array<bigint>").dropDuplicates(["id"]), total, 4_000)


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (u, v) whose shingles are as similar."""
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("s").alias("b")), "v")
    met = both.select("u", "v", F.size("a").alias("m"), F.size("b").alias("n"), F.size(F.array_intersect("a", "b")).alias("k"))
    return met.where(F.col("k") + 1e-9 >= similarity * (F.col("m") + F.col("n") - F.col("k"))).select("u", "v")


def keep_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = WIDE_RADIUS) -> DataFrame:
    """docs without near copies: of candidates that stay no two have that similarity, and what goes is linked to a smaller id.

    A link is a pair of at least that similarity of the sets of shingles; links may go over rows that
    go too. Candidates are all pairs whose wide fingerprints are within the radius, and those beyond
    that agree in a partition by chance. Equal sets of shingles, and wordless texts, are copies. Ids
    are bigint and taken to be unique; of repeated rows of an id at most one stays. Rows of null id
    can't be told apart and all stay. An empty table gives an empty result.

    In a large bucket all are compared with one leader, round by round, and what is linked to a smaller
    id leaves; when buckets are small, or leaders find little more, all pairs of a bucket are compared.
    No bucket is cut or capped. Large groups are found by the first partitions, so that few of their
    members are put down under the many others.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    sig = materialize(_signatures(rows, width), "near-signatures")
    heads = sig.groupBy("digest").agg(F.min_by(F.struct("id", "n", "fp"), "id").alias("r")).select("r.*")
    heads = materialize(in_files(heads, rows_in(sig), 8_000), "near-heads")
    copies = sig.select("id").join(heads.select("id"), "id", "left_anti").distinct()
    real = heads.where("n > 0")
    total = rows_in(real)
    some = [r.fp for r in real.select("fp").orderBy(F.xxhash64("fp")).limit(WIDE_PLAN_SAMPLE).collect()]
    if total < 2:
        return without(docs, copies, id_col)
    # partitions wide enough that unlike fingerprints seldom meet, at any number of them
    wide = math.ceil(math.log2(total)) + SPARE_BITS
    p = plan(_unsigned(some), total, radius, [min(WIDE_WORDS * BITS, max(WIDE_WORDS, WIDE_WORDS * BITS // wide))])
    used = [(part, t) for part, t in zip(p.parts, p.thresholds, strict=True) if t >= 0]
    gone = copies
    leader = F.struct(F.col("id").alias("_i"), F.col("n").alias("_n"), F.col("word").alias("_w"))
    # sets whose sizes differ by more can't be as similar
    near = (F.col("id") != F.col("_i")) & (F.least("n", "_n") + 1e-9 >= similarity * F.greatest("n", "_n")) & (F.bit_count(F.col("word").bitwiseXOR(F.col("_w"))) <= WIDE_FIRST_WORD)
    for some_parts in (used[:FIRST_PARTS], used[FIRST_PARTS:]):
        if not some_parts:
            break
        keys = _wide_keys(real.join(gone, "id", "left_anti"), Plan(*map(tuple, zip(*some_parts, strict=True))))
        left, before = materialize(in_files(_repeated_keys(keys), total * len(some_parts)), "near-keys"), None
        in_left = rows_in(left)
        for turn in itertools.count():
            sizes = left.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max("own").alias("o")).where("c > 1 and o")
            sizes = materialize(in_files(sizes.select("key", "c"), in_left // 2), "near-sizes")
            most, more = sizes.agg(F.max("c"), F.coalesce(F.sum(F.when(F.col("c") > 2, F.col("c"))), F.lit(0))).first()
            if most is None:
                break
            last = most <= SMALL or (before is not None and more > 0.8 * before)
            before = more
            own = left.where("own").select("key", leader.alias("_l"), "id")
            if not last:
                own = own.groupBy("key").agg(F.min_by("_l", F.struct(F.xxhash64("id", F.lit(turn)), "id")).alias("_l"))
            pairs = left.join(own.select("key", "_l.*"), "key").where(near)
            pairs = pairs.select(F.greatest("id", "_i").alias("u"), F.least("id", "_i").alias("v")).distinct()
            pairs = materialize(in_files(pairs, in_left), "near-pairs")
            sets = materialize(_sets(rows, pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct(), width), "near-sets")
            found = materialize(in_files(_similar(pairs, sets, similarity), rows_in(pairs), 20_000), "near-links")
            discard(sets)
            out = None
            if found.head(1):
                linked = connected_components(found, at_once=LINKS_AT_ONCE).where("node != root").select(F.col("node").alias("id"))
                out = materialize(in_files(linked, rows_in(found)), "near-gone")
                gone = gone.union(out)
            if not last:  # buckets of two are done with
                rest = left.join(sizes.where("c > 2").select("key"), "key", "left_semi")
                rest = rest if out is None else rest.join(out, "id", "left_anti")
                fewer = materialize(in_files(rest.select(*left.columns), in_left), "near-keys")
                discard(left)
                left, in_left = fewer, rows_in(fewer)
            discard(sizes)
            if last:
                break
        discard(left)
    out = materialize(in_files(gone.distinct(), rows_in(gone)), "near-gone")
    for x in (sig, heads):
        discard(x)
    return without(docs, out, id_col)
