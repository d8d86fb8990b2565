"""WARC archives with a two-level capture index.

Writing: each page is one WARC record (a gzip member of its own) in an archive file of the shared
folder. Of records with equal payloads of ``least`` bytes or more, the one with the largest id
is the response; the others are revisits that name it and hold no payload. A task writes its
archives under names of its own; only names in rows that Spark committed are ever read.

Index: a capture's key is its URL with the host reversed (com,example,blog)/path, then its id.
Captures are sorted by key over the cluster, and each stretch of ``per_block`` lines is one
compressed block in an index file. The directory is sparse: the first capture, offset and length of each block, at the end
of its index file; one row per index file, of which there are as many as shuffle partitions, tells its first capture and where its directory is. A lookup
is dealt to its index file by these rows, binary-searches the file's directory, range-reads one block,
binary-searches its lines, and range-reads the records they name. Lookups of a file are sorted, so that
its directory and each block are read once.

Files are written and read with pyarrow's file systems, from the URI of the shared folder.

Defined results: a null page text is an empty payload. A null URL is the URL ``about:blank``; a
malformed one is kept as it is, with an empty host. A null id is smaller than any other and named '' in the record; of
equal payloads without any id each is a response. Pages with
the same id are separate records; if they share the largest id and the payload, each is a response, and a lookup of one finds all. Line breaks in URLs are percent-encoded. Extra columns are ignored; an empty
table gives an empty archive.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.staging import materialise, new_path, picked

LEAST, PER_BLOCK, ARCHIVE_BYTES = 1000, 1000, 256 << 20
_CAPTURE = "key string, id long, file string, offset long, length long"
_DATE = "2020-01-01T00:00:00Z"  # pages carry no time of capture


def url_key(url: str | None) -> str:
    """The URL with its host reversed, for sorting: http://blog.example.com/a -> com,example,blog)/a."""
    try:
        parts = urlsplit((url or "about:blank").strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return ")" + (url or "")
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + path.lower()


def record(page: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed. A revisit keeps the response's headers and leaves its payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Target-URI: {quote(url or 'about:blank', safe=_SAFE)}", f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head[4:4] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


_SAFE = "".join(map(chr, range(33, 127)))


@dataclass(frozen=True)
class Read:
    """What a record says, and its payload (none for a revisit)."""

    page: int | None
    url: str
    type: str
    digest: str
    size: int
    refers_to: int | None
    payload: bytes | None


def parse(raw: bytes) -> Read:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    of = lambda x: int(x[10:-1]) if x[10:-1] else None
    declared = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Type"] == "revisit":
        return Read(of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], "revisit", declared, size, of(fields["WARC-Refers-To"]), None)
    if len(payload) != size or hashlib.sha1(payload).hexdigest() != declared:
        raise ValueError(f"record of page {fields['WARC-Record-ID']} doesn't hold the payload it declares")
    return Read(of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], "response", declared, size, None, payload)


def _gzip(data: bytes, level: int = 1) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


class _Files:
    """Opens files under a URI, one at a time kept open."""

    def __init__(self, root: str):
        self.fs, self.root = pafs.FileSystem.from_uri(root if "://" in root else "file://" + root)
        self.name, self.file = None, None

    def create(self, name: str):
        self.fs.create_dir(self.root, recursive=True)
        return self.fs.open_output_stream(f"{self.root}/{name}", compression=None)

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.file:
                self.file.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.root}/{name}")
        return self.file.read_at(length, offset)


def roles(pages: DataFrame, key: str, url: str, text: str, least: int) -> DataFrame:
    """Rows (id, url, payload, digest, refers_to): which record each page becomes. Decided without the payloads, by the digests that several pages have."""
    own = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("payload"))
    sized = own.withColumn("digest", F.sha1("payload"))
    latest = sized.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = picked(sized, materialise(latest, "repeated"), ["digest"], "left")
    return joined.select("id", "url", "payload", "digest", F.when(~F.col("last").eqNullSafe(F.col("id")), F.col("last")).alias("refers_to"))


def write(pages: DataFrame, root: str, key: str = "page_id", url: str = "url", text: str = "html", least: int = LEAST) -> DataFrame:
    """Write the archives under ``root``; the captures (key, id, file, offset, length), materialised."""
    decided = roles(pages, key, url, text, least).select("id", "url", "payload", "digest", "refers_to")

    def run(batches):
        files, out, name, at, number = _Files(root), None, "", 0, 0
        mine = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        for batch in batches:
            rows = ([], [], [], [], [])
            for page, target, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at > ARCHIVE_BYTES:
                    if out:
                        out.close()
                    number += 1
                    name, at = f"{mine}-{number:05d}.warc.gz", 0
                    out = files.create(name)
                packed = _gzip(record(page, target, payload, bytes.fromhex(digest), refers_to))
                out.write(packed)
                for column, x in zip(rows, (url_key(target), page, name, at, len(packed))):
                    column.append(x)
                at += len(packed)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "id", "file", "offset", "length"])
        if out:
            out.close()

    return materialise(decided.mapInArrow(run, _CAPTURE), "captures")


def index(captures: DataFrame, root: str, per_block: int = PER_BLOCK) -> DataFrame:
    """Write the sorted captures as compressed blocks and sparse directories under ``root``; a row (first key and id, file, offset and length of its directory, blocks) for each index file, materialised."""
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id")

    def run(batches):
        files, out, at, lines, first, held = _Files(root), None, 0, [], None, []
        mine = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.cdx.gz"

        def block():
            nonlocal out, at, lines, first
            if out is None:
                out = files.create(mine)
            packed = _gzip("".join(lines).encode(), 6)
            out.write(packed)
            held.append((*first, at, len(packed)))
            at, lines, first = at + len(packed), [], None

        for batch in batches:
            for key, page, file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                first = (key, page) if first is None else first
                lines.append(json.dumps([key, page, file, offset, length], ensure_ascii=True) + "\n")
                if len(lines) == per_block:
                    block()
        if lines:
            block()
        if out:
            packed = _gzip("".join(json.dumps(x) + "\n" for x in held).encode(), 6)
            out.write(packed)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*held[0][:2], mine, at, len(packed), len(held)), (pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 3))], ["first", "first_id", "file", "offset", "length", "blocks"])

    return materialise(ordered.mapInArrow(run, "first string, first_id long, file string, offset long, length long, blocks long"), "directory")


def captures_of(files: _Files, file: str, offset: int, length: int) -> list[tuple]:
    """The captures of one index block, or the blocks of a directory, in the order of their keys."""
    return [tuple(json.loads(x)) for x in zlib.decompress(files.read(file, offset, length), 31).decode().splitlines()]


def _order(key: str, page: int | None) -> tuple:
    """Sorts captures as Spark does, a null id first."""
    return key, page is not None, page or 0


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _batch(got: list[Read], texts: bool) -> pa.RecordBatch:
    columns = [pa.array([r.page for r in got], pa.int64()), pa.array([r.url for r in got], pa.string()), pa.array([r.size for r in got], pa.int64()), pa.array([r.digest for r in got], pa.string()), pa.array([r.type for r in got], pa.string()), pa.array([r.refers_to for r in got], pa.int64())]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([*columns, pa.array([r.payload for r in got], pa.binary())] if texts else columns, [*names, "payload"] if texts else names)


def wanted(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """The captures (key, id) of pages."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(url_key, batch.column(1).to_pylist()), pa.string()), batch.column(0)], ["key", "id"])

    return pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url")).mapInArrow(run, "key string, id long")


def lookup(captures: DataFrame, directory: DataFrame, root: str, texts: bool = False) -> DataFrame:
    """The records of captures (key, id): page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked, the payload.

    Each capture's index file is found by binary search among the files' first captures, its block by binary search in the file's directory, its line by one in the block."""
    spark = captures.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = sorted((*_order(r["first"], r["first_id"]), r["file"], r["offset"], r["length"]) for r in directory.collect())  # a row an index file, one for each partition that wrote
    shared = spark.sparkContext.broadcast(([r[:3] for r in rows], [r[3:] for r in rows]))

    def about(firsts: list[tuple], own: tuple) -> range:
        """Where captures equal to one may begin: from the last place before it on."""
        return range(max(0, bisect.bisect_left(firsts, own) - 1), bisect.bisect_right(firsts, own))

    def find(batches):
        firsts, places = shared.value
        for batch in batches:
            out = [(*places[at], key, page) for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for at in about(firsts, _order(key, page))]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["file", "offset", "length", "key", "id"])

    def fetch(batches):
        files, last, at_block, firsts, blocks, lines = _Files(root), None, None, [], [], []
        for batch in batches:
            got = []
            for file, offset, length, key, page in zip(*(c.to_pylist() for c in batch.columns)):
                if file != last:
                    last, at_block, blocks = file, None, captures_of(files, file, offset, length)
                    firsts = [_order(*x[:2]) for x in blocks]
                own = _order(key, page)
                for nth in about(firsts, own):
                    if nth != at_block:
                        at_block, lines = nth, captures_of(files, file, *blocks[nth][2:])
                    at = bisect.bisect_left(lines, own, key=lambda c: _order(*c[:2]))
                    while at < len(lines) and lines[at][0] == key and lines[at][1] == page:
                        got.append(tuple(lines[at][2:]))
                        at += 1
            records = [parse(zlib.decompress(files.read(*place), 31)) for place in sorted(got)]
            yield _batch(records, texts)

    found = captures.distinct().mapInArrow(find, "file string, offset long, length long, key string, id long")
    return found.repartition(parts, "file").sortWithinPartitions("file", "key", F.asc_nulls_first("id")).mapInArrow(fetch, _RECORD + ", payload binary" * texts)


def archive(spark: SparkSession, pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html", least: int = LEAST, per_block: int = PER_BLOCK) -> tuple[DataFrame, str]:
    """Write archives and index of the pages; the directory and the folder of the files."""
    root = new_path(spark, "warc")
    return index(write(pages, root, key, url, text, least), root, per_block), root
