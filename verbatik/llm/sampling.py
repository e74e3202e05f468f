"""SentencePiece encoding, decoding and sampled segmentations without replacement.

Samples come from a perturbed best-first search over the lattice of a text's segmentations. The
lattice is a chain of decisions: from the end of a unit (a word, where no piece goes on after a
gap) each decision picks the piece that ends at a node, by its conditional probability, until the
unit begins. The whole lattice gets a Gumbel variate. Following one segmentation splits what is left
of a region into smaller ones, each "the same decisions up to here, then another piece"; a region's
variate is a Gumbel variate of its probability, cut off at its parent's. So segmentations come out
in the order of independent Gumbel variates, which samples them without replacement. Randomness is
seeded by the row key alone: results don't depend on partitions, order or retries.
"""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLES = 3
#: Exponent on piece probabilities.
ALPHA = 1.0
SEED = 0
#: Edges of unit lattices that a worker remembers.
CACHE_EDGES = 4_000_000
#: Bytes of the texts that are sampled together, but for the last one's.
PART_BYTES = 1 << 19
_GAP = "▁"
_WORKER: dict = {}


class Table:
    """Numbers that grow at the end, as one array."""

    def __init__(self, kind):
        self.data, self.n = np.empty(1 << 12, kind), 0

    def add(self, values) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.resize(self.data, max(2 * len(self.data), self.n + len(values)))
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class Lattices:
    """Unit lattices, all in flat tables.

    A node's edges are the pieces that end there: consecutive places from first[node], count[node]
    of them. Of an edge: to, the node it begins at (-1: the unit's start); log_p, its log
    probability among the node's edges; others, that of all the others together; keep and alias,
    by which one uniform variate draws an edge; ids_at and ids_n, its ids in ids.
    """

    KINDS = {"first": np.int64, "count": np.int64, "to": np.int32, "alias": np.int32, "ids_at": np.int32, "ids_n": np.int32, "log_p": np.float64, "others": np.float64, "keep": np.float64, "ids": np.int32}

    def __init__(self):
        for name, kind in self.KINDS.items():
            setattr(self, name, Table(kind))
        self.nodes = 0  # given out, of which the tables may not have the last yet

    def add(self, count, to, p, ids_n, ids) -> None:
        """Add nodes by their numbers of edges, and the edges in order: to, probability, number of ids, ids."""
        wide = np.zeros((len(count), count.max()))
        used = np.arange(wide.shape[1]) < count[:, None]
        wide[used] = p
        row, top = np.arange(len(count)), wide.argmax(axis=1)
        others, rest = 1 - wide, wide.copy()
        rest[row, top] = 0
        others[row, top] = rest.sum(axis=1)  # what is left beside a near certainty isn't a difference
        keep, alias = _alias(wide, used)
        first = self.to.n + np.cumsum(count) - count
        with np.errstate(divide="ignore"):
            self.others.add(np.log(others[used]))
        self.log_p.add(np.log(p))
        self.keep.add(keep[used])
        self.alias.add((alias + first[:, None])[used])
        self.ids_at.add(self.ids.n + np.cumsum(ids_n) - ids_n)
        self.ids.add(ids)
        self.ids_n.add(ids_n)
        self.first.add(first)
        self.count.add(count)
        self.to.add(to)


def _alias(p: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Alias tables, one a row: a used place i is kept with chance keep[i], else alias[i] is taken."""
    left, open_ = p * used.sum(axis=1, keepdims=True), used.copy()
    keep, alias = np.ones(p.shape), np.broadcast_to(np.arange(p.shape[1]), p.shape).copy()
    row = np.arange(len(p))
    while len(row):
        some = np.where(open_[row], left[row], np.nan)
        row = row[~np.isnan(some).all(axis=1)]
        some = np.where(open_[row], left[row], np.inf)
        low = some.argmin(axis=1)
        high = np.where(open_[row], left[row], -np.inf).argmax(axis=1)
        short = (some[np.arange(len(row)), low] < 1) & (low != high)
        row, low, high = row[short], low[short], high[short]
        keep[row, low], alias[row, low] = left[row, low], high
        left[row, high] -= 1 - left[row, low]
        open_[row, low] = False
    return keep, alias


class Trie:
    """The prefixes of pieces, by number; the empty one is 0."""

    def __init__(self, pieces: list[str]):
        number = {"": 0}
        for p in pieces:
            for i in range(1, len(p) + 1):
                number.setdefault(p[:i], len(number))
        step = sorted((number[x[:-1]] << 21 | ord(x[-1]), n) for x, n in number.items() if x)
        self.keys, self.next = np.array([k for k, _ in step], np.int64), np.array([n for _, n in step], np.int64)
        self.first = np.full(0x110000, -1, np.int32)
        self.first[[ord(x) for x in number if len(x) == 1]] = [n for x, n in number.items() if len(x) == 1]
        #: Place among the pieces, or -1.
        self.piece = np.full(len(number), -1, np.int64)
        self.piece[[number[p] for p in pieces]] = np.arange(len(pieces))

    def found(self, codes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places where a piece begins and ends (its last character), and the piece; none goes on to stop (for each place)."""
        start = np.arange(len(codes))
        at, state, out = start, self.first[codes].astype(np.int64), []
        while True:
            on = state >= 0
            start, at, state = start[on], at[on], state[on]
            if not len(start):
                break
            piece = self.piece[state]
            hit = piece >= 0
            out.append((start[hit], at[hit], piece[hit]))
            at = at + 1
            on = at < stop[start]
            start, at = start[on], at[on]
            want = state[on] << 21 | codes[at]
            place = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            state = np.where(self.keys[place] == want, self.next[place], -1)
        return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, np.int64),) * 3


def _cut_off(g: float, phi, rng) -> np.ndarray:
    """Gumbel variates of the log masses phi, cut off at g; -inf where there is no mass."""
    return -np.logaddexp(-g, -(phi + rng.gumbel(size=np.shape(phi))))


class Sampler:
    """Encodes with a SentencePiece model, and samples segmentations of its pieces.

    A piece's weight is its unigram log probability in a unigram model; for a merge-ordered model,
    whose scores are ranks, it is -log(1 + rank). A character without a piece is one edge of its
    byte pieces (or the unknown piece).
    """

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, n = self.model, self.model.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        score = {i: sp.get_score(i) for i in normal}
        ranks = min(score.values()) < -100
        weight = {i: -math.log(1 + max(0.0, -s)) if ranks else s for i, s in score.items()}
        total = math.log(sum(math.exp(w) for w in weight.values())) if ranks else 0.0
        self.pieces = {sp.id_to_piece(i): ((i,), math.exp(alpha * (w - total))) for i, w in weight.items()}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.rare = math.exp(alpha * (min(weight.values()) - total))
        self.longest = max(map(len, self.pieces))
        self.trie = Trie(list(self.pieces))
        #: Weights and ids of the pieces, and after them of the characters without one.
        self.weights, self.entries, self.odd = [w for _, w in self.pieces.values()], [i for i, _ in self.pieces.values()], {}
        self.piece_ids = np.array([i for (i,) in self.entries])
        #: Units of more bytes may have masses too small for a number.
        self.most_bytes = int(600 / max(1e-9, -math.log(self.rare))) // (1 if self.bytes else 2)
        self.cut = not any(_GAP in p.lstrip(_GAP) for p in self.pieces)
        #: Neighbouring characters inside a piece.
        self.joints = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.forget()

    def forget(self) -> None:
        self.lattices, self.units, self.words, self.new = Lattices(), {}, {}, []

    def _fallback(self, ch: str) -> tuple[tuple[int, ...], float]:
        data = ch.encode("utf-8", "replace")
        if self.bytes:
            return tuple(self.bytes[b] for b in data), self.rare ** len(data)
        return (self.model.unk_id(),), self.rare**2

    def edges(self, text: str) -> list[tuple[list[int], list[tuple[int, ...]], list[float]]]:
        """For each node 1, 2, ... of a unit its edges: starts, ids, and probabilities among the ways to the node.

        Masses of nodes are relative: only those within a piece's length are compared, and they are
        scaled up before they get too small. An edge too unlikely to be told from none is left out.
        """
        mass, out, known, longest = [1.0], [], self.pieces, self.longest
        for end in range(1, len(text) + 1):
            starts, pieces, p = [], [], []
            for start in range(end - longest if end > longest else 0, end):
                hit = known.get(text[start:end])
                if hit:
                    starts.append(start)
                    pieces.append(hit[0])
                    p.append(mass[start] * hit[1])
            if not starts or starts[-1] != end - 1:
                ids, w = self._fallback(text[end - 1])
                starts.append(end - 1)
                pieces.append(ids)
                p.append(mass[end - 1] * w)
            total = sum(p)
            mass.append(total)
            p = [x / total for x in p]
            if 0.0 in p:
                some = [i for i, x in enumerate(p) if x]
                starts, pieces, p = ([x[i] for i in some] for x in (starts, pieces, p))
            out.append((starts, pieces, p))
            if total < 1e-100:
                mass[-longest:] = [x / total for x in mass[-longest:]]
        return out

    def unit(self, text: str) -> int:
        """The last node of a unit's lattice; a new one is built by settle()."""
        last = self.units.get(text)
        if last is None:
            self.new.append(text)
            self.lattices.nodes += len(text)
            self.units[text] = last = self.lattices.nodes - 1
        return last

    def settle(self) -> None:
        """Build the lattices of the new units, in order."""
        for short, texts in itertools.groupby(self.new, key=lambda t: len(t.encode("utf-8", "replace")) <= self.most_bytes):
            if short:
                self._build(list(texts))
            else:
                for text in texts:
                    nodes, base = self.edges(text), self.lattices.count.n - 1
                    to = [base + s if s else -1 for starts, _, _ in nodes for s in starts]
                    ids = [i for _, pieces, _ in nodes for i in pieces]
                    self.lattices.add(np.array([len(p) for _, _, p in nodes]), np.array(to), np.array([x for _, _, p in nodes for x in p]), np.array(list(map(len, ids))), np.array([i for x in ids for i in x]))
        self.new = []

    def _build(self, texts: list[str]) -> None:
        """Add the lattices of short units, as edges() has them, all at once."""
        size = np.array(list(map(len, texts)))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin = np.repeat(np.cumsum(size) - size, size)  # of each character's unit
        start, end, entry = self.trie.found(codes, begin + np.repeat(size, size))
        alone = np.ones(len(codes), bool)
        alone[start[start == end]] = False
        odd = np.flatnonzero(alone)
        for c in np.unique(codes[odd]).tolist():
            if c not in self.odd:
                ids, w = self._fallback(chr(c))
                self.odd[c] = len(self.entries)
                self.entries.append(ids)
                self.weights.append(w)
        start, end = np.concatenate((start, odd)), np.concatenate((end, odd))
        entry = np.concatenate((entry, np.array([self.odd[c] for c in codes[odd].tolist()], np.int64)))
        order = np.argsort(end * (self.longest + 1) + self.longest - (end - start))  # by node, then by start
        start, end, entry = start[order], end[order], entry[order]
        weight, mass, p = np.array(self.weights)[entry], np.ones(len(codes)), np.empty(len(entry))
        within = (end - begin[end]).astype(np.int16)
        turns = np.split(np.argsort(within, kind="stable"), np.cumsum(np.bincount(within))[:-1])
        inner = start > begin[start]
        for e in turns:
            x = np.where(inner[e], mass[start[e] - 1], 1.0) * weight[e]
            node = np.cumsum(np.concatenate(([0], end[e][1:] != end[e][:-1])))
            total = np.bincount(node, x)
            p[e] = x / total[node]
            mass[end[e]] = total[node]
        count = np.bincount(end, minlength=len(codes))
        to = np.where(inner, self.lattices.count.n + start - 1, -1)
        if len(odd):
            ids = [self.entries[i] for i in entry.tolist()]
            self.lattices.add(count, to, p, np.array(list(map(len, ids))), np.array([i for x in ids for i in x]))
        else:
            self.lattices.add(count, to, p, np.ones(len(entry), np.int64), self.piece_ids[entry])

    def word(self, text: str) -> list[int]:
        """The last nodes of the units of a word: it is cut wherever no piece goes across."""
        cuts = [0, *(i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.joints), len(text)]
        self.words[text] = found = [self.unit(text[a:b]) for a, b in itertools.pairwise(cuts)]
        return found

    def nodes(self, text: str) -> np.ndarray:
        """The last nodes of a text's units, in order."""
        norm = self.model.normalize(text)
        if not norm:
            return np.zeros(0, np.int64)
        words = [norm]
        if self.cut:  # no piece goes on after a gap
            first, *rest = norm.split(_GAP)
            words, gaps = ([first] if first else []), ""
            for w in rest:
                gaps += _GAP
                if w:
                    words.append(gaps + w)
                    gaps = ""
            if gaps:
                words.append(gaps)
        known, word = self.words.get, self.word
        return np.array([n for w in words for n in (known(w) or word(w))], np.int64)

    def _follow(self, nodes: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
        """Draw decisions from the nodes on, each to its unit's start: edges, and the place in nodes that each belongs to."""
        lat, place, edges, places = self.lattices, np.arange(len(nodes)), [], []
        while len(nodes):
            u = rng.random(len(nodes)) * lat.count.data[nodes]
            k = u.astype(np.int64)
            e = lat.first.data[nodes] + k
            e = np.where(u - k < lat.keep.data[e], e, lat.alias.data[e])
            edges.append(e)
            places.append(place)
            nodes = lat.to.data[e]
            on = nodes >= 0
            nodes, place = nodes[on], place[on]
        if not edges:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.concatenate(places)
        order = np.argsort(place, kind="stable")
        return np.concatenate(edges)[order], place[order]

    def sample(self, text: str, k: int, key: bytes) -> list[tuple[np.ndarray, float, float]]:
        """Up to k different segmentations: (ids, log probability, inclusion score), in sampled order.

        All segmentations, each with score 1, if there are at most k. The score is the chance to
        be among those above the next one's variate, for unbiased weighting.
        """
        return self.sample_all([text], k, [key])[0]

    def sample_all(self, texts: list[str], k: int, keys: list[bytes]) -> list[list[tuple[np.ndarray, float, float]]]:
        """sample() of each text; new units are settled at once."""
        if self.lattices.to.n > CACHE_EDGES:
            self.forget()
        nodes = [self.nodes(t) for t in texts]
        self.settle()
        return [self._search(n, k, key) for n, key in zip(nodes, keys, strict=True)]

    def _search(self, nodes: np.ndarray, k: int, key: bytes) -> list[tuple[np.ndarray, float, float]]:
        lat = self.lattices
        rng = np.random.Generator(np.random.Philox(key=xxhash.xxh128_intdigest(key)))
        order = itertools.count()
        # a region: (-variate, tie, log mass, edges before it, their places, its own place, its node's edges left)
        none = np.zeros(0, np.int64)
        heap: list = [(-float(rng.gumbel()), next(order), 0.0, none, none, -1, none)]
        done: list[tuple[float, float, np.ndarray, np.ndarray]] = []
        bound = -math.inf
        while heap:
            neg, _, phi, before, owner, at, left = heapq.heappop(heap)
            g = -neg
            if len(done) == k:
                bound = g
                break
            log_p = lat.log_p.data
            stay = float(log_p[before].sum())
            if at < 0:
                head, rest, shift = none, nodes, 0
            else:  # pick one of the edges left; what is left of them is a region again
                w = np.exp(log_p[left] - log_p[left].max())
                pick = min(int(np.searchsorted(np.cumsum(w), rng.random() * w.sum(), side="right")), len(left) - 1)
                head, left = left[pick : pick + 1], np.delete(left, pick)
                if len(left):
                    more = stay + float(np.logaddexp.reduce(log_p[left]))
                    heapq.heappush(heap, (-float(_cut_off(g, more, rng)), next(order), more, before, owner, at, left))
                on = lat.to.data[head]
                rest, shift = np.concatenate((on[on >= 0], nodes[at + 1 :])), at if on[0] >= 0 else at + 1
            edges, place = self._follow(rest, rng)
            path = np.concatenate((before, head, edges))
            whose = np.concatenate((owner, np.full(len(head), at, np.int64), place + shift))
            sums = np.cumsum(log_p[path])
            new = len(before) + len(head)
            if len(edges):  # the regions beside the decisions just drawn
                mass = np.concatenate(([0.0], sums))[new:-1] + lat.others.data[edges]
                value = _cut_off(g, mass, rng)
                need = k - len(done)  # to complete the samples and bound them
                best = np.argpartition(-value, need - 1)[:need] if len(value) > need else np.arange(len(value))
                for i in best.tolist():
                    if value[i] > -math.inf:
                        node = int(np.searchsorted(lat.first.data[: lat.first.n], edges[i], side="right")) - 1
                        there = np.arange(lat.first.data[node], lat.first.data[node] + lat.count.data[node])
                        heapq.heappush(heap, (-float(value[i]), next(order), float(mass[i]), path[: new + i], whose[: new + i], int(whose[new + i]), there[there != edges[i]]))
            done.append((g, float(sums[-1]) if len(sums) else 0.0, path, whose))
        return [(self._ids(path, whose), p, 1.0 if bound == -math.inf else -math.expm1(-math.exp(min(700.0, p - bound)))) for _, p, path, whose in done]

    def _ids(self, path: np.ndarray, whose: np.ndarray) -> np.ndarray:
        """Ids of decisions, each unit's being in order from its end."""
        if not len(path):
            return np.zeros(0, np.int32)
        lat = self.lattices
        first = np.flatnonzero(np.concatenate(([True], whose[1:] != whose[:-1])))
        size = np.diff(np.concatenate((first, [len(path)])))
        e = path[np.repeat(2 * first + size - 1, size) - np.arange(len(path))]
        n = lat.ids_n.data[e]
        if n.max() == 1:
            return lat.ids.data[lat.ids_at.data[e]]
        at = np.arange(n.sum()) + np.repeat(lat.ids_at.data[e] - (np.cumsum(n) - n), n)
        return lat.ids.data[at]


def sampler(path: str, alpha: float = ALPHA) -> Sampler:
    """This worker's sampler for a model file, loaded once."""
    if (path, alpha) not in _WORKER:
        _WORKER[path, alpha] = Sampler(path, alpha)
    return _WORKER[path, alpha]


def encode(df: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """df with the model's own encoding (array of int) of each text; null gives null, empty an empty array."""

    def run(column):
        sp = sampler(model_path).model
        return pa.array([None if t is None else sp.encode(t) for t in column.to_pylist()], pa.list_(pa.int32()))

    return df.withColumn(out_col, F.arrow_udf(run, T.ArrayType(T.IntegerType()))(F.col(text_col)))


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """df with the text of each array of ids; null gives null."""

    def run(column):
        sp = sampler(model_path).model
        return pa.array([None if i is None else sp.decode(i) for i in column.to_pylist()], pa.string())

    return df.withColumn(out_col, F.arrow_udf(run, T.StringType())(F.col(ids_col)))


def _parts(sizes: list[int | None]):
    """Runs of texts, start and stop, that end when they reach PART_BYTES."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n or 0
        if total >= PART_BYTES or i + 1 == len(sizes):
            yield start, i + 1
            start, total = i + 1, 0


def sample(df: DataFrame, model_path: str, keys: list[str], text_col: str = "text", k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """Up to k different segmentations of every text, one row each.

    Columns: the key columns, sample (from 1, in sampled order), ids, log_prob, inclusion. A text
    with fewer than k segmentations has them all. Null counts as empty: one empty segmentation.
    Rows of equal keys and texts get equal samples. Texts are sampled whole, however long; other
    columns are ignored.
    """
    rows = df.select(*[F.col(c) for c in keys], F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in keys], F.lit(str(seed))).alias("_key"), F.col(text_col).alias("_t"))
    schema = T.StructType([rows.schema[c] for c in keys]).add("sample", T.IntegerType()).add("ids", T.ArrayType(T.IntegerType())).add("log_prob", "double").add("inclusion", "double")

    def packed(b, at, out):
        ids, p, q = zip(*out, strict=True)
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
        rows = pa.array([i for i, _ in at], pa.int64())
        return pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in keys), pa.array([n for _, n in at], pa.int32()), lists, pa.array(p, pa.float64()), pa.array(q, pa.float64())], [*keys, "sample", "ids", "log_prob", "inclusion"])

    def run(batches):
        for b in batches:
            for start, stop in _parts(pc.binary_length(b.column("_t")).to_pylist()):
                part = b.slice(start, stop - start)
                found = sampler(model_path, alpha).sample_all([t or "" for t in part.column("_t").to_pylist()], k, [x.encode() for x in part.column("_key").to_pylist()])
                at = [(start + i, n) for i, some in enumerate(found) for n in range(1, len(some) + 1)]
                yield packed(b, at, [one for some in found for one in some])

    return rows.mapInArrow(run, schema)
