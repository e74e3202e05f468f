"""Removal of long byte strings that occur more than once, by a hash-compared suffix sort.

Every string of `length` bytes picks an anchor: of its 64-byte grams, the one with the least
mixed hash. Equal strings pick equal anchors at equal places, so candidates meet by the anchor's
hash. Consecutive starts with one anchor form a segment, about one for 70 bytes of text.

1. Segments that equal another one wholly (same gram hash, and same hash of all their bytes) are
   repeats at every start. Within a task they are found and combined before the shuffle, so a
   passage in very many texts sends one row a task.
2. The others whose anchor occurs again fetch their bytes. Their starts are sorted as suffixes:
   a merge sort whose comparisons find the common extension of two suffixes by binary search
   over prefix polynomial hashes; neighbours that share `length` bytes, verified byte by byte,
   are repeats. Each start is placed by the anchor and the half of its surroundings that reaches
   further, so only strings of over 130 bytes meet in a group.
3. Intervals are gathered per text, joined to it and merged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbatik.llm.common import blocks, materialize

LENGTH = 200
GRAM = 64
#: Starts are found in slices of a text of so many bytes (and the overlap), so memory stays bounded.
SLICE = 1 << 19
#: Suffixes that are sorted together; a group of equal keys stays whole.
SORT_ROWS = 4_000
_BASE = 0x9E3779B97F4A7C15
_POS_BITS = np.uint64(20)
_POS_MASK = np.uint64((1 << 20) - 1)


class Powers:
    """Powers of a base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                a = np.full(size, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


POWERS = Powers(_BASE)
#: For the hash of whole segments, with values of bytes of its own.
OTHER = Powers(0xC2B2AE3D27D4EB4F)
_OTHER_BYTES = np.random.Generator(np.random.Philox(key=3)).integers(1 << 63, size=256, dtype=np.uint64)


def prefix_hashes(data: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """Polynomial hashes of all prefixes: entry i covers data[:i]."""
    up, _ = powers.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1) if powers is POWERS else _OTHER_BYTES[data]) * up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, n, powers: Powers = POWERS) -> np.ndarray:
    """Hash of n bytes from each start, alike wherever the bytes stand."""
    return (prefix[start + n] - prefix[start]) * powers.get(len(prefix))[1][start]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Segments of a text: rows (first start, last start, anchor, anchor hash, whole hash), uint64."""
    rows = []
    window = length - gram + 1
    for at in range(0, max(0, len(data) - length + 1), SLICE):
        part = np.frombuffer(data[at : at + SLICE + length - 1], np.uint8)
        if len(part) < length:
            break
        prefix = prefix_hashes(part)
        grams = len(part) - gram + 1
        place = np.arange(grams)
        h = mixed((prefix[gram:] - prefix[:grams]) * POWERS.get(grams)[1])
        least = (h & ~_POS_MASK) | place.astype(np.uint64)
        span = 1
        while 2 * span <= window:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < window:
            least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
        anchor = (least & _POS_MASK).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        last = np.concatenate((first[1:] - 1, [len(anchor) - 1]))
        a = anchor[first]
        shape = (a - first).astype(np.uint64) * np.uint64(1 << 32) + (last - first).astype(np.uint64)
        whole = mixed(range_hash(prefix_hashes(part, OTHER), first, last - first + length, OTHER) ^ mixed(shape + np.uint64(1)))
        rows.append(np.stack([(first + at).astype(np.uint64), (last + at).astype(np.uint64), (a + at).astype(np.uint64), h[a], whole]))
    return np.concatenate(rows, axis=1) if rows else np.zeros((5, 0), np.uint64)


def common_extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Bytes that suffixes a and b share from their start, at most `most`, by binary search on hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
    whole = range_hash(prefix, a, most) == range_hash(prefix, b, most)
    low[whole] = most
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_] + 1) // 2
        same = range_hash(prefix, a[open_], mid) == range_hash(prefix, b[open_], mid)
        low[open_[same]] = mid[same]
        high[open_[~same]] = mid[~same] - 1


def _before(text, prefix, a, b, most, ties):
    """Whether suffix a sorts before suffix b in their first `most` bytes; equal ones: ties."""
    n = common_extension(prefix, a, b, most)
    at = np.minimum(n, most - 1)
    return np.where(n == most, ties, text[a + at] < text[b + at])


def suffix_sort(text: np.ndarray, prefix: np.ndarray, start: np.ndarray, bucket: np.ndarray, most: int) -> np.ndarray:
    """Stable order of the suffixes at `start` by (bucket, first `most` bytes).

    Merge sort of all buckets side by side: in a round, each suffix finds its rank in the sibling
    run by binary search, with hash-compared suffixes.
    """
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    head = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    size = np.diff(np.concatenate((head, [len(b)])))
    base, full = np.repeat(head, size), np.repeat(size, size)
    within = np.arange(len(b)) - base
    run = 1
    while run < size.max(initial=1):
        mine = within // run
        other = mine ^ 1
        low = np.minimum(other * run, full)
        high = np.minimum(low + run, full)
        begin, lo, hi = low.copy(), low.copy(), high.copy()
        right = (mine & 1).astype(bool)  # of equal suffixes the left run's come first
        s = start[order]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            less = _before(text, prefix, s[base[open_] + mid], s[open_], most, right[open_])
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        place = base + np.minimum(mine, other) * run + (within - mine * run) + (lo - begin)
        merged = np.empty_like(order)
        merged[place] = order
        order = merged
        run *= 2
    return order


def repeated(text: np.ndarray, start: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix shares its first `length` bytes with another of its bucket."""
    out = np.zeros(len(start), bool)
    if len(start) < 2:
        return out
    prefix = prefix_hashes(text)
    order = suffix_sort(text, prefix, start, bucket, length)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(bucket[a] == bucket[b])
    near = near[range_hash(prefix, start[a[near]], length) == range_hash(prefix, start[b[near]], length)]
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    for at in range(0, len(near), 1 << 15):  # hashes may collide
        k = near[at : at + (1 << 15)]
        k = k[(view[start[a[k]]] == view[start[b[k]]]).all(axis=1)]
        out[a[k]] = out[b[k]] = True
    return out


def _signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64).view(np.int64)


_SEGMENTS = pa.schema([("kid", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("anchor", pa.int64()), ("h", pa.int64()), ("c", pa.int64()), ("m", pa.int32())])
#: Rows gathered before repeats within the task are combined.
_COMBINE_ROWS = 500_000


def _find_segments(length: int, gram: int):
    def flush(kids, found):
        kid = np.concatenate(kids)
        first, last, anchor, h, c = np.concatenate(found, axis=1)
        order = np.lexsort((c, h))
        hs, cs = h[order], c[order]
        new = np.concatenate(([True], (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])))
        size = np.diff(np.concatenate((np.flatnonzero(new), [len(hs)])))
        # m: 1 for a segment met once; 2 for one that stands for several here; 0 for those it stands for
        m = np.empty(len(h), np.int32)
        m[order] = np.where(new, np.minimum(np.repeat(size, size), 2), 0)
        arrays = [pa.array(_signed(x)) for x in (first, last, anchor, h, c)]
        yield from pa.Table.from_arrays([pa.array(kid), *arrays, pa.array(m)], schema=_SEGMENTS).to_batches(max_chunksize=100_000)

    def run(batches):
        kids, found, n = [], [], 0
        for batch in blocks(batches):
            for kid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = segments((text or "").encode("utf-8", "replace"), length, gram)
                if s.shape[1]:
                    kids.append(np.full(s.shape[1], kid, np.int64))
                    found.append(s)
                    n += s.shape[1]
            if n > _COMBINE_ROWS:
                yield from flush(kids, found)
                kids, found, n = [], [], 0
        if n:
            yield from flush(kids, found)

    return run


_BYTES = "key bigint, kid bigint, first bigint, back int, known boolean, bytes binary"


def _fetch(length: int, gram: int):
    """Bytes of the two halves of each wanted segment: starts far before the anchor, and the others.

    key places a half; back is the distance of its first start from the anchor.
    """
    half = (length - gram) // 2
    names = ["key", "kid", "first", "back", "known", "bytes"]

    def run(batches):
        for batch in blocks(batches):
            rows = []
            for text, kid, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = text.encode("utf-8", "replace")
                prefix = None
                if not wanted:
                    continue
                prefix = prefix_hashes(np.frombuffer(data, np.uint8))
                f, e, a = (np.array([w[x] for w in wanted], np.int64) for x in ("first", "last", "anchor"))
                far = np.flatnonzero(a - f >= half)
                close = np.flatnonzero(a - e < half)
                far_key = mixed(range_hash(prefix, a[far] - half, half + gram) + np.uint64(1))
                reach = length - half + 1
                close_key = mixed(range_hash(prefix, a[close], np.minimum(reach, len(data) - a[close])) + np.uint64(2))
                for k, key in zip(far, _signed(far_key), strict=True):
                    lo, hi = int(f[k]), int(min(e[k], a[k] - half))
                    rows.append((int(key), kid, lo, int(a[k]) - lo, wanted[k]["known"], data[lo : hi + length]))
                for k, key in zip(close, _signed(close_key), strict=True):
                    lo, hi = int(max(f[k], a[k] - half + 1)), int(e[k])
                    rows.append((int(key), kid, lo, int(a[k]) - lo, wanted[k]["known"], data[lo : hi + length]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return run


def _runs(start: np.ndarray, owner: np.ndarray, length: int):
    """Merge consecutive starts of one owner into (owner, from, to)."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)))
    at = np.flatnonzero(new)
    end = np.concatenate((at[1:] - 1, [len(start) - 1]))
    return owner[at], start[at], start[end] + length


def _resolve(length: int):
    """Repeated starts among rows sorted by key; known rows only serve as partners."""

    def solve(rows):
        if not rows:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, ["kid", "lo", "hi"])
        kid, first, back, known = (np.array([r[i] for r in rows]) for i in (1, 2, 3, 4))
        text = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        size = np.array([len(r[5]) for r in rows], np.int64)
        offset = np.concatenate(([0], np.cumsum(size)[:-1]))
        key = np.array([r[0] for r in rows], np.int64)
        group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        starts = size - length + 1
        row = np.repeat(np.arange(len(rows)), starts)
        step = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(starts)[:-1])), starts)
        bucket = group[row].astype(np.int64) * (2 * length) + back[row] - step + length
        # a start whose bucket holds no other can't repeat
        _, inverse, n = np.unique(bucket, return_inverse=True, return_counts=True)
        use = np.flatnonzero(n[inverse] > 1)
        hit = use[repeated(text, offset[row[use]] + step[use], inverse[use], length)]
        hit = hit[~known[row[hit]]]
        owner, lo, hi = _runs(first[row[hit]] + step[hit], row[hit], length)
        return pa.RecordBatch.from_arrays([pa.array(kid[owner] if len(owner) else [], pa.int64()), pa.array(lo), pa.array(hi)], ["kid", "lo", "hi"])

    def run(batches):
        waiting: list = []
        for batch in blocks(batches, SORT_ROWS):
            waiting += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            if len(waiting) >= SORT_ROWS:
                cut = len(waiting)
                while cut and waiting[cut - 1][0] == waiting[-1][0]:
                    cut -= 1
                if cut:
                    yield solve(_paired(waiting[:cut]))
                    waiting = waiting[cut:]
        if waiting:
            yield solve(_paired(waiting))

    return run


def _paired(rows: list) -> list:
    """The rows whose key another row has too."""
    return [r for i, r in enumerate(rows) if (i and rows[i - 1][0] == r[0]) or (i + 1 < len(rows) and rows[i + 1][0] == r[0])]


def _cut(length: int):
    def run(batches):
        for b in blocks(batches):
            out = []
            for text, spans in zip(b.column("_t").to_pylist(), b.column("spans").to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "replace")
                kept, at, removed, n = [], 0, 0, 0
                for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
                    if lo > at or not n:
                        n += 1
                        kept.append(data[at:lo])
                        removed, at = removed + hi - lo, hi
                    elif hi > at:
                        removed, at = removed + hi - at, hi
                kept.append(data[at:])
                whole = b"".join(kept)
                out.append((len(data), removed, n, hashlib.sha256(whole).hexdigest(), whole))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            new = [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()], strict=True)]
            keep = [i for i, name in enumerate(b.schema.names) if name not in ("_t", "spans")]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + new, [b.schema.names[i] for i in keep] + ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove every byte covered by a `length`-byte string that also starts elsewhere in the texts.

    Returns doc_id, the columns named in `carry`, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256 and kept (the remaining bytes, binary). Strings are judged on the input:
    every copy goes, the first one too; matches never cross texts.

    Null texts count as empty: nothing removed. Texts under `length` bytes stay whole. Repeated
    rows are copies of each other. Very long texts are searched whole, in slices. Other columns
    are ignored. An empty table gives an empty result.
    """
    gram = min(GRAM, max(1, length // 3))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    rows = rows.withColumn("kid", F.xxhash64("doc_id", "_t"))
    schema = "kid bigint, first bigint, last bigint, anchor bigint, h bigint, c bigint, m int"
    long = rows.select("kid", "_t").where(F.octet_length("_t") >= length)
    found = materialize(long.mapInArrow(_find_segments(length, gram), schema), "suffix-segments")
    by_h, by_hc = Window.partitionBy("h"), Window.partitionBy("h", "c")
    met = found.where("m > 0").withColumn("n", F.sum("m").over(by_h)).withColumn("nc", F.sum("m").over(by_hc))
    met = met.withColumn("mixed", F.min("c").over(by_h) != F.max("c").over(by_h)).withColumn("k", F.row_number().over(by_hc.orderBy("kid", "first")))
    met = materialize(met.where("n > 1").select("kid", "first", "last", "anchor", (F.col("nc") > 1).alias("known"), (F.col("mixed") & ((F.col("nc") == 1) | (F.col("k") == 1))).alias("wanted")), "suffix-met")
    whole = found.where("m = 0").select("kid", "first", "last").union(met.where("known").select("kid", "first", "last"))
    wanted = met.where("wanted").groupBy("kid").agg(F.collect_list(F.struct("first", "last", "anchor", "known")).alias("w"))
    texts = rows.join(wanted, "kid").select("_t", "kid", "w", "doc_id", *[f"_c{i}" for i in range(len(carry))])
    halves = texts.mapInArrow(_fetch(length, gram), _BYTES)
    partial = halves.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_resolve(length), "kid bigint, lo bigint, hi bigint")
    spans = whole.select("kid", F.col("first").alias("lo"), (F.col("last") + length).alias("hi")).union(partial)
    spans = spans.groupBy("kid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    joined = rows.join(spans, "kid", "left").select("doc_id", "_t", *[F.col(f"_c{i}") for i in range(len(carry))], "spans")
    fields = [joined.schema["doc_id"], *[joined.schema[f"_c{i}"] for i in range(len(carry))]]
    new = T.StructType().add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("kept", "binary")
    out = joined.mapInArrow(_cut(length), T.StructType([*fields, *new.fields]))
    return out.withColumnsRenamed({f"_c{i}": c for i, c in enumerate(carry)})
