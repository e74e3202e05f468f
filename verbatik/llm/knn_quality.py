"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

Terms of a text are its 4-grams of byte classes and a few repetition terms, so they tell how a
text is written rather than in which language. A term-document matrix of a bounded sample of
labelled rows gives inverse document frequencies and, by its singular vectors, a latent space.
The sample's vectors go to every task; each document is compared with all of them, block by
block, and its nearest vote with their labels, weighted by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbatik.llm.common import blocks

#: Labelled rows that the space and the votes are learned from; chosen by hash of the id.
SAMPLE_ROWS = 4096
DIMENSIONS = 48
NEIGHBOURS = 15
#: Similarities are raised to this power as weights.
SHARPNESS = 8
#: Rows a matrix product takes at once.
BLOCK_ROWS = 256
THRESHOLD = 0.7

_CLASSES = 8
_GRAMS = _CLASSES**4
#: After the 4-grams: word equal to the one before, word met before, line met before, word.
TERMS = _GRAMS + 4


def _classes() -> np.ndarray:
    c = np.full(256, 6, np.int64)  # other symbols
    c[128:] = 0  # letters beyond ASCII
    c[ord("a") : ord("z") + 1] = 0
    c[ord("A") : ord("Z") + 1] = 1
    c[ord("0") : ord("9") + 1] = 2
    c[[9, 11, 12, 13, 32]] = 3
    c[10] = 4
    c[[ord(x) for x in ".,;:'"]] = 5
    c[[ord(x) for x in "#*$%&|<>!"]] = 7
    return c


_CLASS = _classes()


def term_counts(text: str | None) -> np.ndarray:
    """Counts of the TERMS terms over the whole text (float32)."""
    out = np.zeros(TERMS, np.float32)
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return out
    c = _CLASS[np.frombuffer(b"\n" + data + b"\n\n", np.uint8)]
    out[:_GRAMS] = np.bincount(((c[:-3] * 8 + c[1:-2]) * 8 + c[2:-1]) * 8 + c[3:] if len(c) > 3 else [], minlength=_GRAMS)
    words = data.split()
    if words:
        again = sum(map(bytes.__eq__, words[1:], words[:-1]))
        lines = [x for x in data.split(b"\n") if x.strip()]
        copied = len(b" ".join(lines).split()) - sum(len(x.split()) for x in set(lines))
        out[_GRAMS:] = (again, len(words) - len(set(words)), copied, len(words))
    return out


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Square roots of term frequencies times idf, for each row of counts."""
    total = np.maximum(counts[:, :_GRAMS].sum(axis=1, keepdims=True), 1)
    w = np.sqrt(counts / total)
    w[:, _GRAMS:] *= 2.0
    return w * idf


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    """idf (TERMS), projection (TERMS x DIMENSIONS), unit vectors and labels of the sample, prior."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    @property
    def usable(self) -> bool:
        """Whether it has learned from rows of both labels."""
        return len(set(self.labels.tolist())) > 1

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts), BLOCK_ROWS):
            counts = np.stack([term_counts(t) for t in texts[at : at + BLOCK_ROWS]])
            cos = _unit(_weigh(counts, self.idf) @ self.projection) @ self.vectors.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cos, near, axis=1), 0) ** SHARPNESS + 1e-9
            found = (w * self.labels[near]).sum(axis=1) / w.sum(axis=1)
            out[at : at + BLOCK_ROWS] = np.where(counts.any(axis=1), found, self.prior)
        return np.clip(out, 0.0, 1.0)


def train(counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Model:
    """Model of labelled term counts, one row each; without rows every score is 0.5, and usable is false."""
    if not len(labels):
        return Model(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    idf = np.log((1 + len(labels)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    x = _weigh(counts, idf).astype(np.float32)
    used = np.flatnonzero(x.any(axis=0))
    if len(labels) < len(used):  # the smaller of the two Gram matrices
        values, left = np.linalg.eigh(x @ x.T)
        right = x.T @ left / np.sqrt(np.maximum(values, 1e-9))
    else:
        values, part = np.linalg.eigh(x[:, used].T @ x[:, used])
        right = np.zeros((TERMS, len(used)), np.float32)
        right[used] = part
    projection = np.ascontiguousarray(right[:, np.argsort(-values)[:dimensions]], dtype=np.float32)
    return Model(idf, projection, _unit(x @ projection).astype(np.float32), labels.astype(np.float64), float(labels.mean()))


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from labelled documents where train_rows (over labels) holds.

    The sample is at most `rows` ids, the first by hash of the id; their counts are made on the
    executors, and those that aren't zero go to the driver. An id with different labels isn't learned
    from, nor are null ids, labels or texts; of an id that is repeated the greatest text counts, once.
    """
    kind = labels.schema[id_col].dataType.simpleString()
    known = labels.where(train_rows & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("i")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z")).where("y = z").select("i", "y")
    chosen = known.orderBy(F.xxhash64("i"), "i").limit(rows)
    sample = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "i")
    sample = sample.groupBy("i", "y").agg(F.max("t").alias("t"))

    def run(batches):
        for b in blocks(batches):
            counts = [term_counts(t) for t in b.column("t").to_pylist()]
            used = [np.flatnonzero(c) for c in counts]
            found = [pa.array([x.astype("<u2").tobytes() for x in used], pa.binary()), pa.array([c[x].astype("<f4").tobytes() for c, x in zip(counts, used, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("y").cast(pa.int32()), *found], ["i", "y", "at", "c"])

    rows_ = sorted(sample.mapInArrow(run, f"i {kind}, y int, at binary, c binary").collect(), key=lambda r: r.i)
    counts = np.zeros((len(rows_), TERMS), np.float32)
    for row, r in zip(counts, rows_, strict=True):
        row[np.frombuffer(r.at, "<u2")] = np.frombuffer(r.c, "<f4")
    return train(counts, np.array([r.y for r in rows_]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Columns doc_id, those named in `carry`, and score (0 to 1) for every row.

    Null and empty texts get the sample's share of good labels; repeated rows get equal scores;
    other columns are ignored. The model is a broadcast variable of bounded size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    names = ["doc_id", *(f"_c{i}" for i in range(len(carry)))]

    def run(batches):
        for b in blocks(batches, BLOCK_ROWS):
            scores = shared.value.score(b.column("_t").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(scores, pa.float64())], [*names, "score"])

    schema = T.StructType([rows.schema[c] for c in names]).add("score", T.DoubleType())
    return rows.mapInArrow(run, schema).withColumnsRenamed({f"_c{i}": c for i, c in enumerate(carry)})
