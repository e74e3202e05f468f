"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of whole sample texts. A text is cut into
blocks, every block is compressed with every dictionary, and the language whose blocks take the
fewest bytes in all wins; `rejected` marks texts whose margin to the next language is narrow.
"""

from __future__ import annotations

import math

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sample documents of a language: at most this many, one from each bucket of a hash of the id.
SAMPLE_PER_LANGUAGE = 64
#: Sample documents have at most so many bytes, so that a dictionary (128 KB at most) holds them whole.
SAMPLE_BYTES = 2 << 10
#: And at least so many characters.
SAMPLE_CHARS = 40
#: More languages than this are an error: their samples and dictionaries are held at once.
MAX_LANGUAGES = 512
#: Block of text that is compressed on its own, so that a long text can't become its own dictionary.
BLOCK_BYTES = 2 << 10
LEVEL = 6
#: Saved share of the best language's bytes below which a prediction is marked rejected.
MARGIN = 0.01
#: Bits a byte to log-odds.
SHARPNESS = 40.0
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def encoded(text: str) -> bytes:
    """What is compressed of a text: the whole of it, lower-cased."""
    return text.lower().encode("utf-8", "replace")


def dictionaries(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, sample_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Raw dictionary of every language among the rows where `train` holds, most frequent first.

    A dictionary is the sample's texts, whole, one after another. The sample is bounded: in each of
    per_language buckets of a language, the first id by hash among texts of 40 characters to
    sample_bytes bytes. A language without any such text learns from its shortest one, whole. Rows
    whose id, text or language is null aren't learned from.
    """
    rows = docs.where(train & F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.octet_length(text_col).alias("n"))
    h = F.xxhash64("i")
    often = {r.l: r for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.min_by("i", F.struct("n", "i")).alias("i")).limit(MAX_LANGUAGES + 1).collect()}
    if len(often) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not often:
        return {}
    fit = rows.where((F.col("n") <= sample_bytes) & (F.length("t") >= SAMPLE_CHARS))
    chosen = fit.groupBy("l", F.pmod(h, F.lit(per_language)).alias("b")).agg(F.min_by("i", F.struct(h, "i")).alias("i")).collect()
    have = {r.l for r in chosen}
    wanted = {(r.l, r.i) for r in chosen} | {(lang, r.i) for lang, r in often.items() if lang not in have}
    wanted = docs.sparkSession.createDataFrame(sorted(wanted), rows.select("l", "i").schema)
    found = rows.join(F.broadcast(wanted), ["l", "i"], "left_semi")
    found = found.where(((F.col("n") <= sample_bytes) & (F.length("t") >= SAMPLE_CHARS)) | ~F.col("l").isin(*have)).select("l", "i", "t").distinct().collect()
    out: dict[str, bytes] = {}
    for r in sorted(found, key=lambda r: (r.l, r.i, r.t)):
        out[r.l] = out.get(r.l, b"") + encoded(r.t) + b"\n"
    return {lang: out[lang] for lang in sorted(out, key=lambda x: (-often[x].n, x))}


class Compressor:
    """Sizes of texts under each language's dictionary."""

    def __init__(self, raw: dict[str, bytes]):
        self.langs = list(raw)
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_checksum=0, write_content_size=0, write_dict_id=0)
        self.coders = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(raw[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (its share of the languages' odds) and whether the margin is narrow."""
        if text is None or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        data = encoded(text)
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.coders]
        best = min(sizes)
        odds = [math.exp(-SHARPNESS * (s - best) / len(data)) for s in sizes]
        rest = sorted(sizes)[1] if len(sizes) > 1 else math.inf
        return self.langs[sizes.index(best)], 1.0 / sum(odds), rest - best < MARGIN * best


def identify(docs: DataFrame, raw: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, lang_pred, score and rejected for every row.

    Null texts and texts without a letter get `und`, score 0, rejected; so does every text if
    there are no dictionaries. Ties go to the language learned from most documents. The whole of a text
    counts, however long; other columns are ignored. raw: a few dictionaries of bounded size.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = Compressor(raw)
        for b in batches:
            found = [coder.predict(t) for t in b.column(1).to_pylist()]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
