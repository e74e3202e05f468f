"""Best-fit packing of token pieces into fixed-length sequences, planned over a length histogram.

Only the histogram of piece lengths (at most `capacity` numbers) reaches the driver. Best-fit
decreasing runs over its counts: sequences with the same room left are one range of sequence
numbers, and a step places as many pieces of a length as fit into a whole range. The outcome is a
table of slots (length, first rank, how many, first sequence, offset); a piece finds its slot by
its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbatik.llm.common import blocks, forget_when_idle, in_use, materialize, rows_in, shards

#: Words whose ids one Python worker remembers; the oldest half goes when it is full.
CACHE_WORDS = 500_000
#: A slot table of more rows than this isn't broadcast.
BROADCAST_SLOTS = 100_000
#: Lower-case Latin letters, then punctuation other than an apostrophe.
PLAIN = re.compile(r"([a-zß-öø-ÿœ]+)([!-&(-/:-@\[-`{-~]*)")
#: The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next from 256.
_PRINTS = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
BYTE_CHARS = [chr(b if b in _PRINTS else 256 + sum(x not in _PRINTS for x in range(b))) for b in range(256)]
_WORKER: dict = {}


class WordTokenizer(dict):
    """Ids of texts by a tokenizer that drops white space and never merges across it.

    A text's ids are then its words' ids one after another. The dict holds the ids of words met
    (little-endian unsigned 32-bit), in two generations so that memory stays bounded. A plain word,
    letters with punctuation after them, skips the normalizers: its lower-cased letters and its
    punctuation are separate units for the split pattern of word_bpe_49k.json.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.old: dict[str, bytes] = {}
        self.half = cache_words // 2

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            low = word.lower()
            plain = PLAIN.fullmatch(low)
            if not plain:
                ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
            elif plain[2] or low != word:
                ids = self[plain[1]] + (self[plain[2]] if plain[2] else b"")
            else:
                spelt = word if word.isascii() else "".join(map(BYTE_CHARS.__getitem__, word.encode()))
                ids = np.array([t.id for t in self.model.tokenize(spelt)], "<u4").tobytes()
        self[word] = ids
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        out = []
        for t in texts:
            out.append(b"".join(map(self.__getitem__, (t or "").replace("\n", " ").replace("\t", " ").split(" "))))
            if len(self) > self.half:
                self.old = dict(self)
                self.clear()
        return out


def tokenizer(path: str) -> WordTokenizer:
    """This worker's tokenizer for the file, loaded once."""
    if path not in _WORKER:
        _WORKER[path] = WordTokenizer(path)
    return _WORKER[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every document's ids (its tokens, then end_id) into pieces of at most capacity.

    Columns doc_id, piece, start, length, ids_crc32 and ids (little-endian unsigned 32-bit, binary).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        in_use("tokenizers")
        enc = tokenizer(tokenizer_path)
        for b in blocks(batches):
            rows = []
            for i, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
        forget_when_idle("tokenizers", _WORKER)

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Slot:
    """Pieces of `length` with rank in [rank, rank + n) go to sequence `sequence` + (their rank - rank) // per."""

    length: int
    rank: int
    n: int
    sequence: int
    per: int
    offset: int


def plan_slots(histogram: dict[int, int], capacity: int) -> tuple[list[Slot], int]:
    """Best-fit decreasing over counts. Returns the slots and the number of sequences."""
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges (first sequence, how many)
    order: list[int] = []  # the rooms there are, ascending
    slots: list[Slot] = []
    opened = 0

    def put(room: int, first: int, n: int) -> None:
        if room:
            if room not in rooms:
                bisect.insort(order, room)
            rooms.setdefault(room, []).append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                per = capacity // length
                full, rest = divmod(left, per)
                for n, each in ((full, per), (1 if rest else 0, rest)):
                    if n:
                        slots.append(Slot(length, rank, n * each, opened, each, 0))
                        put(capacity - each * length, opened, n)
                        opened, rank, left = opened + n, rank + n * each, left - n * each
                continue
            room = order[at]
            first, n = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], order[at]
            per = min(room // length, left)
            use = min(n, left // per)
            slots.append(Slot(length, rank, use * per, first, per, capacity - room))
            put(room - per * length, first, use)
            if n > use:
                put(room, first + use, n - use)
            rank, left = rank + use * per, left - use * per
    return slots, opened


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Give every piece a sequence_id and an offset in it; sequences hold at most capacity tokens.

    pieces: columns doc_id, piece, start, length (1 to capacity), ids_crc32; others pass through.
    Pieces lie gapless from offset 0. Equal rows get different places; an empty table gives an
    empty result.

    Ranks within a length are dealt in two steps: pieces are numbered within (length, salt), with
    salts enough that no task numbers more than about 100,000 pieces, and each salt starts where
    the counts of the salts before it end; so a length that very many pieces share isn't sorted in
    one task.
    """
    spark = pieces.sparkSession
    salts = shards(spark, rows_in(pieces))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("length").agg(F.sum("n").alias("n"))
    slots, _ = plan_slots({r.length: r.n for r in sizes.collect()}, capacity)
    table = spark.createDataFrame([(s.length, s.rank, s.n, s.sequence, s.per, s.offset) for s in slots], "s_length bigint, s_rank bigint, s_n bigint, s_sequence bigint, s_per bigint, s_offset bigint")
    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("rank", rank).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    slot = F.broadcast(table) if len(slots) <= BROADCAST_SLOTS else table
    at = (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("s_rank")) & (F.col("rank") < F.col("s_rank") + F.col("s_n"))
    step = F.col("rank") - F.col("s_rank")
    packed = ranked.join(slot, at).withColumn("sequence_id", F.col("s_sequence") + F.floor(step / F.col("s_per")).cast("bigint"))
    packed = packed.withColumn("offset", F.col("s_offset") + F.pmod(step, F.col("s_per")) * F.col("length"))
    return packed.drop("salt", "rank", "base", "s_length", "s_rank", "s_n", "s_sequence", "s_per", "s_offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty (one piece of the end id alone). Very long texts are cut into as many
    pieces as they need; nothing is dropped. Repeated rows are packed each. Columns other than the
    id and the text are ignored. The token ids themselves: pieces().
    """
    cut = pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col).drop("ids")
    return pack(materialize(cut, "pieces"), capacity)
