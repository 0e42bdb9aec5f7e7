"""WARC archives of web pages with a two-level capture index.

Pages are sorted by their capture key, the URL with its host reversed (``com,example,www)/path``), and
every task writes its range as gzipped WARC records, one member a record, so that a record can be read
by its offset alone.  Beside them it writes its part of the index: the sorted captures (key, page, file,
offset, length) in compressed blocks of ``LINES``, and behind the blocks a sparse directory with the first
capture of each.  A lookup finds the part by binary search in the list of parts (one row per range, so its
length is a parameter, not a matter of the data), the block by binary search in the part's directory, and
the capture by binary search in the block; then it reads that range of the archive.  Lookups are sorted by
key too, so a task reads neighbouring blocks and records one after the other.

Of pages with equal payloads of at least ``least`` bytes the one with the smallest id is written whole, as a
response, the others as revisits that refer to it; only responses carry a payload.  Payloads shared by
very many pages are told to their rows by broadcast (``lookup_join``), so no task gathers a group of copies.

Files go to a folder that all executors reach, through the Arrow file systems (local and mounted paths,
S3, GCS, HDFS); where the folder's URI needs another one, name a ``folder``.  A task that is run again writes files
of its own, and only those that the finished task reports are indexed.

Defined results: a null payload is empty, a null URL is the empty URL; a null page id comes first among
the captures of a key and is the last choice as a response (a group without any id is all responses);
rows that repeat the smallest id of their group are responses too; repeated rows are captures of their own
and all returned; very long payloads are archived whole; an empty table gives an archive without
captures; other columns are ignored.
"""

from __future__ import annotations

import gzip
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadquarry.operators.skew import lookup_join
from leadquarry.session import WRITING, discard, settings, shared_folder, spool

#: Captures in a block of the index.
LINES = 256
#: A task begins a new archive after so many bytes.
ARCHIVE_BYTES = 1 << 30
#: Bytes of payload that are returned at a time.
BATCH_BYTES = 8 << 20
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
#: WARC and its profile of revisits: fixed values.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "page_id long, url string, record_type string, payload binary, payload_digest string, refers_to long, file string, offset long, length long"


def capture_key(url: Column) -> Column:
    """The URL by reversed host: ``https://www.Example.com:80/a?b`` is ``com,example,www:80)/a?b``."""
    url = F.coalesce(url, F.lit(""))
    where = F.regexp_extract(url, SCHEME + r"(?:[^/?#@]*@)?([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(where, r"^([^:]*)", 1))
    port = F.regexp_extract(where, r"(:[0-9]+)$", 1)
    rest = F.regexp_replace(url, SCHEME + r"[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest))


@dataclass(frozen=True)
class Part:
    """A range of the index: its first and last capture, where its blocks are, and where their directory."""
    first: list
    last: list
    path: str
    offset: int
    length: int


@dataclass(frozen=True)
class Archive:
    spark: SparkSession
    folder: str

    def parts(self) -> list[Part]:
        rows = self.spark.read.schema("part string").parquet(f"{self.folder}/parts").collect()  # one per range of the write
        return sorted((Part(**json.loads(r.part)) for r in rows), key=lambda p: _order(p.first))

    def remove(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _order(capture: list) -> tuple:
    """Sorts as the write does: by key, then by page, none first."""
    return capture[0], capture[1] is not None, capture[1] or 0


def _head(fields: dict[str, object]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None).encode() + b"\r\n"


def _safe(value: str | None) -> str | None:
    """A header value on one line."""
    return None if value is None else json.dumps(value, ensure_ascii=False) if any(c < " " or c == "\x7f" for c in value) or value[:1] == '"' or value != value.strip() else value


def _plain(value: str | None) -> str | None:
    return json.loads(value) if value and value[0] == '"' else value


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, refers_to: int | None,
           target: str | None, date: str) -> bytes:
    """One WARC record, not compressed; without ``payload`` a revisit of the page ``refers_to``."""
    kind = "response" if payload is not None else "revisit"
    http = b"HTTP/1.1 200 OK\r\n" + _head({"Content-Type": "text/html; charset=utf-8", "Content-Length": None if payload is None else len(payload)})
    block = http + (payload or b"")
    name = lambda page: f"<urn:page:{'-' if page is None else page}>"
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}>", "WARC-Concurrent-To": name(page_id), "WARC-Date": date,
        "WARC-Target-URI": _safe(url), "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block)}
    if kind == "revisit":
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": name(refers_to), "WARC-Refers-To-Target-URI": _safe(target), "WARC-Refers-To-Date": date}
    return f"{VERSION}\r\n".encode() + _head(fields) + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record; the payload follows the HTTP head of its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a {VERSION} record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


class _Writer:
    """The archives and the part of the index that one task writes."""

    def __init__(self, folder: str, date: str):
        self.fs, self.root = pa.fs.FileSystem.from_uri(folder)
        self.name, self.date, self.archives = uuid.uuid4().hex, date, 0
        self.archive, self.blocks, self.lines, self.directory, self.at = None, None, [], [], 0
        self.last = None

    def add(self, key: str, page_id: int | None, *rest) -> None:
        raw = gzip.compress(record(page_id, *rest, self.date), 6, mtime=0)
        if self.archive is None or self.archive.tell() >= ARCHIVE_BYTES:
            if self.archive is not None:
                self.archive.close()
            self.file, self.archives = f"{self.name}-{self.archives}.warc.gz", self.archives + 1
            self.archive = self.fs.open_output_stream(f"{self.root}/{self.file}", compression=None)
        self.lines.append([key, page_id, self.file, self.archive.tell(), len(raw)])
        self.archive.write(raw)
        if len(self.lines) == LINES:
            self.flush()

    def flush(self) -> None:
        if self.blocks is None:
            self.path = f"{self.name}.index"
            self.blocks = self.fs.open_output_stream(f"{self.root}/{self.path}", compression=None)
        packed = zlib.compress("\n".join(json.dumps(x) for x in self.lines).encode())
        self.directory.append([self.lines[0][:2], self.blocks.tell(), len(packed)])
        self.blocks.write(packed)
        self.last, self.lines = self.lines[-1][:2], []

    def close(self) -> list[str]:
        """The part, if there is one."""
        if self.archive is None:
            return []
        if self.lines:
            self.flush()
        offset, packed = self.blocks.tell(), zlib.compress(json.dumps(self.directory).encode())
        self.blocks.write(packed)
        self.blocks.close()
        self.archive.close()
        part = Part(self.directory[0][0], self.last, self.path, offset, len(packed))
        return [json.dumps(part.__dict__)]


def write(pages: DataFrame, folder: str | None = None, least: int = 100, parts: int | None = None, page_id: str = "page_id",
          url: str = "url", html: str = "html", date: datetime | str = "2000-01-01T00:00:00Z") -> Archive:
    """Archive ``pages`` below ``folder`` (in the shared folder by default), in ``parts`` ranges of keys."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    date = date if isinstance(date, str) else date.strftime("%Y-%m-%dT%H:%M:%SZ")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fs, root = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(root)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"key": capture_key(F.col("url")), "digest": F.sha2("payload", 256)})
    shared = F.when(F.octet_length("payload") >= least, F.col("digest"))
    groups = spool(rows.select(shared.alias("group"), "page_id", "url").where("group IS NOT NULL").groupBy("group").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1"))
    known = groups.select("group", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("target"))
    told = lookup_join(rows.withColumn("group", shared), known, ["group"], counts=groups.select("group", "n"))
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    told = told.select("key", "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "digest",
                       F.when(again, F.col("first_id")).alias("refers_to"), F.when(again, F.col("target")).alias("target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(folder, date)
        for batch in batches:
            key, page, url, payload, *rest = batch.columns
            payload = payload.cast(pa.binary())
            for i in range(batch.num_rows):
                out.add(key[i].as_py(), page[i].as_py(), url[i].as_py(), payload[i].as_py(), *[c[i].as_py() for c in rest])
        yield pa.RecordBatch.from_arrays([pa.array(out.close(), pa.string())], ["part"])

    ranged = told.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")
    with settings(spark, WRITING):
        ranged.mapInArrow(run, "part string").write.parquet(f"{folder}/parts")
    discard(groups)
    return Archive(spark, folder)


class _Reader:
    """Binary searches in the index and reads of ranges, with the last directory, block and archive at hand."""

    def __init__(self, folder: str, parts: list[Part]):
        self.fs, self.root = pa.fs.FileSystem.from_uri(folder)
        self.parts, self.firsts = parts, [_order(p.first) for p in parts]
        self.open: dict[str, object] = {}
        self.directories: dict[str, tuple] = {}
        self.block_at, self.block = None, None

    def range(self, path: str, offset: int, length: int) -> bytes:
        if path not in self.open:
            if len(self.open) >= 8:
                self.open.pop(next(iter(self.open))).close()
            self.open[path] = self.fs.open_input_file(f"{self.root}/{path}")
        return self.open[path].read_at(length, offset)

    def directory(self, part: Part) -> tuple:
        if part.path not in self.directories:
            if len(self.directories) >= 4:
                self.directories.pop(next(iter(self.directories)))
            rows = json.loads(zlib.decompress(self.range(part.path, part.offset, part.length)))
            self.directories[part.path] = [_order(r[0]) for r in rows], rows
        return self.directories[part.path]

    def lines(self, part: Part, offset: int, length: int) -> tuple:
        if self.block_at != (part.path, offset):
            rows = [json.loads(x) for x in zlib.decompress(self.range(part.path, offset, length)).split(b"\n")]
            self.block_at, self.block = (part.path, offset), ([_order(r) for r in rows], rows)
        return self.block

    def captures(self, low: tuple, high: tuple) -> Iterator[list]:
        """Captures whose order lies from ``low`` to ``high``, both included."""
        for p in range(max(0, bisect_left(self.firsts, low) - 1), bisect_right(self.firsts, high)):
            part = self.parts[p]
            if _order(part.last) < low:
                continue
            firsts, rows = self.directory(part)
            for b in range(max(0, bisect_left(firsts, low) - 1), bisect_right(firsts, high)):
                orders, lines = self.lines(part, *rows[b][1:])
                yield from lines[bisect_left(orders, low):bisect_right(orders, high)]

    def read(self, capture: list) -> tuple:
        _, page_id, file, offset, length = capture
        fields, payload = parse(gzip.decompress(self.range(file, offset, length)))
        kind, refers = fields["WARC-Type"], fields.get("WARC-Refers-To")
        return (page_id, _plain(fields.get("WARC-Target-URI")), kind, payload if kind == "response" else None,
                fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(refers[len("<urn:page:"):-1]) if refers else None,
                file, offset, length)


def lookup(archive: Archive, wanted: DataFrame, url: str = "url", page_id: str | None = None) -> DataFrame:
    """The captures of every wanted URL, or with ``page_id`` of every wanted URL and page, as read from the archives.

    Columns: page_id, url, record_type, payload (null for revisits), payload_digest as recorded, refers_to,
    file, offset, length.  Rows of ``wanted`` that ask for the same captures ask once.
    """
    parts = archive.parts()
    told = archive.spark.sparkContext.broadcast((archive.folder, parts))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
                        ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()),
                        ("length", pa.int64())])
    whole = page_id is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows, held = _Reader(*told.value), [], 0
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
        for batch in batches:
            for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low, high = ((key, False, 0), (key, True, float("inf"))) if whole else (_order([key, page]),) * 2
                for capture in reader.captures(low, high):
                    rows.append(reader.read(capture))
                    held += len(rows[-1][3] or b"") + 200
                    if held >= BATCH_BYTES:
                        yield made(rows)
                        rows, held = [], 0
        if rows:
            yield made(rows)

    asked = wanted.select(capture_key(F.col(url)).alias("key"), (F.lit(None) if whole else F.col(page_id)).cast("long").alias("page")).distinct()
    n = int(archive.spark.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.repartitionByRange(n, "key", "page").sortWithinPartitions("key", "page")
    return asked.mapInArrow(run, CAPTURE)


def resolved(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: of the full payload, revisits through their response.

    Digests of responses are taken from the payloads as read; one that differs from its record, or a revisit
    whose response is not there, ends the query with an error.
    """
    digest = F.sha2("payload", 256)
    right = F.when(digest == F.col("payload_digest"), digest).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: "), "file")))
    rows = spool(captures.select("page_id", "record_type", F.octet_length("payload").cast("long").alias("own_bytes"), "refers_to",
                                 F.when(F.col("payload").isNull(), F.col("payload_digest")).otherwise(right).alias("payload_digest")))
    whole, again = rows.where("record_type = 'response'"), rows.where("record_type = 'revisit'")
    responses = whole.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("own_bytes").alias("payload_bytes"))
    found = lookup_join(again, responses, ["refers_to", "payload_digest"]).withColumn("payload_bytes", F.coalesce(
        "payload_bytes", F.raise_error(F.concat(F.lit("no response of page "), F.col("refers_to").cast("string"))).cast("long")))
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return whole.withColumn("payload_bytes", F.col("own_bytes")).select(*out).unionByName(found.select(*out))
