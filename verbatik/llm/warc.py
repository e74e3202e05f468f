"""WARC archives: writing, reading back, and a two-level capture index.

Records are gzip members of their own. Spark's text writer puts them into files: its line
separator is an empty gzip member, which readers of concatenated members pass over, so files are
committed, retried and placed like any other output of Spark's, on any file system.

The capture index sorts lines by reversed-host URL key over range partitions and packs them into
blocks, gzip members of index parts that are written the same way. Its directory has the first and
last key and the byte range of each block. A lookup goes down two levels: the parts' key ranges,
then, in the tasks, a binary search among a part's blocks; only the blocks found are read, by their
byte ranges, and then only the byte ranges of the captures found in them.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbatik.llm.common import discard, materialize, new_path, rows_in, shards

#: Payloads under this many bytes are never made revisits.
REVISIT_BYTES = 1000
#: A file has at most this many records, and fewer if the longest payload is such that they could
#: exceed FILE_BYTES; a single longer record has a file of its own.
RECORDS_PER_FILE = 5_000
FILE_BYTES = 512 << 20
#: Lines of an index block; lines that a part is planned for.
BLOCK_LINES = 3_000
PART_LINES = 300_000
#: Byte ranges of one file that one task reads, in one go or not.
RUN_BYTES = 32 << 20
#: Schemes whose byte ranges tasks read themselves; files of others come whole through Spark's reader.
RANGE_SCHEMES = ("file", "hdfs", "s3", "s3a", "gs")
#: An empty gzip member.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
_HEADER_END = b"\r\n\r\n"
_HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + _HEADER_END
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
RECORD = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, file string, offset bigint, length bigint, payload binary"
_NAMES = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "file", "offset", "length", "payload"]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, digest: str, refers_to: int | None, number: str = "0") -> bytes:
    """A response or revisit record as one gzip member; number makes its id unique in the archive.

    A response holds an HTTP response with the payload as its body. A revisit holds its head only
    and tells the payload's length. Page ids have header fields of their own; null has none.
    """
    body = _HTTP_HEAD + (b"" if kind == "revisit" else payload)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:capture:{number}>", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", "", url))
    if kind == "revisit":
        head.append(f"WARC-Profile: {_REVISIT_PROFILE}")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    raw = "\r\n".join(head).encode("utf-8", "replace") + _HEADER_END + body + _HEADER_END
    return gzip.compress(raw, compresslevel=4, mtime=0)


def parse(raw: bytes) -> dict | None:
    """Fields of one uncompressed record; None for an empty member."""
    if not raw:
        return None
    head, _, rest = raw.partition(_HEADER_END)
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    payload = rest[: int(fields["content-length"])]
    if fields.get("content-type", "").startswith("application/http"):
        payload = payload.partition(_HEADER_END)[2]
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "payload": payload,
        "payload_bytes": int(fields.get("x-payload-length", len(payload))), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "refers_to": number("x-refers-to-page-id"),
    }


def members(data: bytes):
    """(offset, length, content) of each gzip member."""
    at = 0
    while at < len(data):
        d = zlib.decompressobj(31)
        content = d.decompress(data[at:at + (1 << 16)])
        fed = min(len(data), at + (1 << 16))
        parts = [content]
        while not d.eof:
            if fed >= len(data):
                raise ValueError("truncated member")
            parts.append(d.decompress(data[fed : fed + (1 << 20)]))
            fed = min(len(data), fed + (1 << 20))
        length = fed - at - len(d.unused_data)
        yield at, length, b"".join(parts)
        at += length


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """Columns page_id, url, payload (binary), digest, kind, refers_to for every row.

    Of rows with equal payloads of at least `least` bytes the one with the largest id is the
    response (of repeated rows of that id, one; a null id counts as smallest), the others are
    revisits that refer to its id. Null payloads are empty. Payloads are compared by SHA-1 and length.

    A payload's best row comes from a map-side combined maximum; only payloads that occur more
    than once are joined back, and that join can be split where a page is very common. Repeated
    rows of a best id, looked for first, cost a window over those rows alone.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(payload_col, F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    same = rows.where(F.col("n") >= least).groupBy("digest", "n", "page_id").agg(F.count(F.lit(1)).alias("rows"))
    best = F.max_by("rows", F.coalesce("page_id", F.lit(-(2**63))))
    keyed = same.groupBy("digest", "n").agg(F.max("page_id").alias("best"), best.alias("ties"), F.sum("rows").alias("copies")).where("copies > 1").drop("copies")
    keyed = materialize(keyed, "warc-copies")
    joined = rows.join(keyed, ["digest", "n"], "left")
    is_best = F.col("ties").isNotNull() & F.col("page_id").eqNullSafe(F.col("best"))
    out = ["page_id", "url", "payload", "digest", "kind", "refers_to"]
    decided = joined.withColumn("kind", F.when(F.col("ties").isNull() | is_best, "response").otherwise("revisit"))
    decided = decided.withColumn("refers_to", F.when(F.col("kind") == "revisit", F.col("best")))
    if keyed.where("ties > 1").isEmpty():
        return decided.select(*out)
    tied = is_best & (F.col("ties") > 1)
    number = F.row_number().over(Window.partitionBy("digest", "n").orderBy("url"))
    ranked = decided.where(tied).withColumn("number", number)
    ranked = ranked.withColumn("kind", F.when(F.col("number") == 1, "response").otherwise("revisit"))
    ranked = ranked.withColumn("refers_to", F.when(F.col("number") > 1, F.col("best")))
    return decided.where(~tied).select(*out).union(ranked.select(*out))


def _write_members(rows: DataFrame, path: str, per_file: int = 0) -> None:
    """Write the gzip members of the column value, in order, as files (.txt in name) below path."""
    writer = rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1")
    writer.option("maxRecordsPerFile", per_file).text(path)


def write(pages: DataFrame, path: str, per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES, **columns) -> None:
    """Write one record for each row of pages into WARC files under path."""

    def run(batches):
        task, n = TaskContext.get(), 0
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(6)), strict=True)
            out = [record(*r, number=f"{task.partitionId()}-{k}") for k, r in enumerate(rows, n)]
            n += len(out)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    longest = pages.agg(F.max(F.octet_length(columns.get("payload_col", "html")))).first()[0] or 0
    rows = decide(pages, **columns).select("page_id", "url", "payload", "kind", "digest", "refers_to")
    _write_members(rows.mapInArrow(run, "value binary"), path, max(1, min(per_file, file_bytes // (longest + 2_000))))


def _checked(file: str, offset: int, length: int, raw: bytes, with_payload: bool) -> list | None:
    """A record's fields; None for an empty member. A response that doesn't fit its digest and length is an error."""
    r = parse(raw)
    if r is None:
        return None
    if r["record_type"] == "response" and (hashlib.sha1(r["payload"]).hexdigest(), len(r["payload"])) != (r["payload_digest"], r["payload_bytes"]):
        raise ValueError(f"bad payload in {file} at {offset}")
    return [*(r[c] for c in _NAMES[:6]), file, offset, length, r["payload"] if with_payload else None]


def _batches(rows: Iterator[list | None], most: int = 500, most_bytes: int = 32 << 20):
    out, size = [], 0
    for r in rows:
        if r is not None:
            out.append(r)
            size += len(r[9] or b"")
            if len(out) >= most or size >= most_bytes:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record below path, by a scan of all files: page_id, url, record_type, payload_bytes, payload_digest, refers_to, file, offset, length, payload.

    A response's payload is checked against its digest and length; a mismatch is an error.
    """

    def run(batches):
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from _batches(_checked(file, at, n, raw, with_payload) for at, n, raw in members(data))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, RECORD)


def url_key(url: str | None) -> str:
    """Reversed-host key: com,example)/path?query; without scheme, port of the scheme, fragment or leading www."""
    try:
        u = urlsplit((url or "").strip())
        host = re.sub(r"^www\d*\.", "", (u.hostname or "").lower())
        port = f":{u.port}" if u.port and (u.scheme, u.port) not in (("http", 80), ("https", 443)) else ""
    except ValueError:
        return (url or "").strip().lower()
    query = "?" + "&".join(sorted(u.query.lower().split("&"))) if u.query else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (u.path.lower() or "/") + query


class Ranges:
    """Byte ranges of files, read through pyarrow's file systems; a file stays open until the next one."""

    def __init__(self):
        self.path, self.file = None, None

    def read(self, path: str, offset: int, length: int) -> bytes:
        from pyarrow import fs

        if path != self.path:
            self.close()
            if path.startswith("file:"):
                system, name = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
            else:
                system, name = fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", path))
            self.path, self.file = path, system.open_input_file(name)
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def _with_bytes(wanted: DataFrame, use, schema: str, example: str | None) -> DataFrame:
    """use(rows) over rows (columns of wanted, bytes) of byte ranges: columns file, offset, length, and others.

    Ranges of one file are dealt in runs of RUN_BYTES, so that a file isn't one task's alone. All
    files are in the folder of the file `example`; there are no rows if that is None.
    """
    spark, names = wanted.sparkSession, wanted.columns
    if example is None:
        return spark.createDataFrame([], schema)
    run_of = F.floor(F.col("offset") / RUN_BYTES)
    if example.split(":")[0] in RANGE_SCHEMES:

        def run(batches):
            ranges = Ranges()
            for b in batches:
                rows = (dict(zip(names, r, strict=True)) for r in zip(*(b.column(c).to_pylist() for c in names), strict=True))
                yield from use((r, ranges.read(r["file"], r["offset"], r["length"])) for r in rows)
            ranges.close()

        return wanted.repartition("file", run_of).sortWithinPartitions("file", "offset").mapInArrow(run, schema)

    def whole(batches):
        for b in batches:
            for asked, data in zip(b.column("asked").to_pylist(), b.column("content").to_pylist(), strict=True):
                yield from use((r, data[r["offset"] : r["offset"] + r["length"]]) for r in asked)

    listed = wanted.groupBy("file").agg(F.collect_list(F.struct(*names)).alias("asked"))
    files = spark.read.format("binaryFile").load(example.rsplit("/", 1)[0]).select(F.col("path").alias("file"), "content")
    return files.join(listed, "file").select("asked", "content").mapInArrow(whole, schema)


_LINE = ["key", "url", "page_id", "record_type", "payload_digest", "file", "offset", "length"]
_LINE_SCHEMA = "key string, url string, page_id bigint, record_type string, payload_digest string, file string, offset bigint, length bigint"


def with_keys(rows: DataFrame, cols: list[str]) -> DataFrame:
    """The columns named, the first of them a URL, after the column key."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column(0).to_pylist()], pa.string()), *b.columns], ["key", *b.schema.names])

    rows = rows.select(*cols)
    return rows.mapInArrow(run, "key string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))


def build_index(records: DataFrame, path: str, lines: int = BLOCK_LINES, part_lines: int = PART_LINES) -> None:
    """Write the capture index of records (as read() gives them) below path.

    blocks/ has the index parts; directory/ the blocks: part, first_key, last_key, n, offset, length.
    """

    def blocks(batches):
        rows: list[tuple] = []

        def packed(part):
            return pa.RecordBatch.from_arrays([pa.array([gzip.compress("\n".join(map(json.dumps, part)).encode(), mtime=0)], pa.binary())], ["value"])

        for b in batches:
            rows += zip(*(c.to_pylist() for c in b.columns), strict=True)
            while len(rows) >= lines:
                yield packed(rows[:lines])
                rows = rows[lines:]
        if rows:
            yield packed(rows)

    def entries(batches):
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = []
                for offset, length, raw in members(data):
                    if raw:
                        rows = raw.split(b"\n")
                        found.append((part, json.loads(rows[0])[0], json.loads(rows[-1])[0], len(rows), offset, length))
                if found:
                    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["part", "first_key", "last_key", "n", "offset", "length"])

    parts = shards(records.sparkSession, rows_in(records), part_lines)
    # the page id joins the range key, so that one URL's captures can be spread over partitions
    ordered = with_keys(records, _LINE[1:]).repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    _write_members(ordered.mapInArrow(blocks, "value binary"), f"{path}/blocks")
    files = records.sparkSession.read.format("binaryFile").load(f"{path}/blocks").select("path", "content")
    files.mapInArrow(entries, "part string, first_key string, last_key string, n bigint, offset bigint, length bigint").write.parquet(f"{path}/directory")


class CaptureIndex:
    """Look up captures of many URLs at once, and read them by their byte ranges.

    The driver holds only the key range of each part, of which there is one for PART_LINES records.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.directory = spark, spark.read.parquet(f"{path}/directory")
        self.parts = sorted(tuple(r) for r in self.directory.groupBy("part").agg(F.min("first_key").alias("a"), F.max("last_key").alias("b")).select("a", "b", "part").collect())

    def blocks(self, urls: DataFrame) -> DataFrame:
        """The blocks that can have captures of the URLs (first column): file, offset, length, and the keys asked of each."""
        lows, parts = [p[0] for p in self.parts], self.parts

        def ask(batches):
            for b in batches:
                out = []
                for key in b.column(0).to_pylist():
                    k = bisect.bisect_right(lows, key) - 1
                    while k >= 0 and parts[k][1] >= key:
                        out.append((key, parts[k][2]))
                        k -= 1
                cols = list(zip(*out, strict=True)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["key", "part"])

        def search(asked: pa.Table, found: pa.Table) -> pa.Table:
            rows = sorted(found.to_pylist(), key=lambda r: (r["first_key"], r["last_key"], r["offset"])) if asked.num_rows else []
            first, last, keys = [r["first_key"] for r in rows], [r["last_key"] for r in rows], {}
            for key in asked.column("key").to_pylist():
                k = bisect.bisect_right(first, key) - 1
                while k >= 0 and last[k] >= key:
                    keys.setdefault(k, []).append(key)
                    k -= 1
            hit = [rows[k] for k in keys]
            return pa.table([pa.array([r["part"] for r in hit], pa.string()), pa.array([r["offset"] for r in hit], pa.int64()), pa.array([r["length"] for r in hit], pa.int64()), pa.array(list(keys.values()), pa.list_(pa.string()))], ["file", "offset", "length", "keys"])

        keys = with_keys(urls, urls.columns[:1]).select("key").distinct().mapInArrow(ask, "key string, part string")
        pairs = keys.groupBy("part").cogroup(self.directory.groupBy("part"))
        return pairs.applyInArrow(search, "file string, offset bigint, length bigint, keys array<string>")

    def captures(self, urls: DataFrame) -> DataFrame:
        """Index lines of all captures of the URLs, each once: key, url, page_id, record_type, payload_digest, file, offset, length."""

        def use(rows):
            for r, raw in rows:
                lines = [json.loads(x) for x in gzip.decompress(raw).split(b"\n")]
                out = []
                for key in r["keys"]:
                    out += lines[bisect.bisect_left(lines, key, key=lambda x: x[0]) : bisect.bisect_right(lines, key, key=lambda x: x[0])]
                if out:
                    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], _LINE)

        return _with_bytes(self.blocks(urls), use, _LINE_SCHEMA, self.parts[0][2] if self.parts else None)

    def fetch(self, captures: DataFrame, with_payload: bool = True) -> DataFrame:
        """The records of captures (file, offset, length), as read() gives them."""

        def use(rows):
            return _batches(_checked(r["file"], r["offset"], r["length"], gzip.decompress(raw), with_payload) for r, raw in rows)

        first = captures.first()
        return _with_bytes(captures.select("file", "offset", "length"), use, RECORD, first and first.file)


def archive(pages: DataFrame, path: str | None = None, **columns) -> tuple[DataFrame, str]:
    """Write pages as archives and their index below path (default: a new shared folder).

    Returns the records of all pages, looked up by their URLs in the index and read back by byte
    ranges, and path. Every row gives one record: repeated rows too, null urls have no target URI,
    null payloads are empty. Very long payloads are whole. An empty table gives no records.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write(pages, f"{path}/archive", **columns)
    lines = materialize(read(spark, f"{path}/archive", with_payload=False), "warc-lines")
    build_index(lines, f"{path}/index")
    discard(lines)
    index = CaptureIndex(spark, f"{path}/index")
    return index.fetch(materialize(index.captures(pages.select(columns.get("url_col", "url"))), "warc-captures"), with_payload=False), path
