"""WARC archives: writing, normalising a monolithic gzip stream, and reading by offset.

`write_archives` writes one record per page; each task writes one archive that is a single gzip stream, as crawlers'
naive compressors leave it. `normalise` inflates each stream once, rewrites every record as its own gzip member and
writes a sidecar index (JSON lines: offset and length of each member). `read_records` reads members by that index, many
tasks to an archive, and checks every payload against its digest.

Of records with equal payloads of at least MIN_BYTES bytes that with the largest page_id is the response; the others are
revisits without payload that refer to it. Equal payloads are found by SHA-1 in Spark: a sum with a map-side part gives
the few digests that occur twice or more; payloads are not shuffled unless those are too many to broadcast, and then by a
hash of the row, so that no payload is a hot key.

Files go to the shared folder (any file system that pyarrow knows by its URI) under names made from the task's
partition, are written under a temporary name and moved, so that a repeated task replaces its own file. A task holds one
record at a time.

Defined results: a null html is an empty payload. A null page_id is smaller than any other and is written without one;
rows that share the largest page_id of their payload are all responses, and so is every row of a group of null ids.
Line breaks and controls in a url are percent-encoded; a null url is left out. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import json
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm._common import is_small, join_salted, map_arrow, shared_dir, slices, table

MIN_BYTES = 0
CHUNK = 1 << 20
#: Bytes of an archive whose records are read by one task, about.
READ_RUN = 4 << 20
#: Repeated digests that are broadcast.
MAX_COPIES = 500_000
#: Fixed value: records of synthetic pages have no capture time.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, type string, page_id long, digest string, url string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").removeprefix("urn:x-page:")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit if `refers_to` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(quote(c) if c < " " or c == "\x7f" else c for c in url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def header_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip stream of one or more members."""
    stream = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            yield stream.decompress(chunk)
            chunk = b""
            if stream.eof:
                chunk, stream = stream.unused_data, zlib.decompressobj(31)
    yield stream.flush()


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an uncompressed archive; holds one record and one chunk."""
    held, parts = bytearray(), iter(chunks)

    def more() -> bool:
        piece = next(parts, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        searched = 0
        while (end := held.find(b"\r\n\r\n", max(0, searched - 3))) < 0:
            searched = len(held)
            if not more():
                if held.strip():
                    raise ValueError("the archive ends inside a header")
                return
        size = end + 4 + int(header_fields(bytes(held[:end]))["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield bytes(held[:size])
        del held[:size]


class _Output:
    """A file that appears under its name when it is complete."""

    def __init__(self, folder: str, name: str):
        self.fs, self.folder = open_fs(folder)
        self.name, self.draft = f"{self.folder}/{name}", f"{self.folder}/.{name}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
        self.fs.create_dir(self.folder, recursive=True)

    def __enter__(self):
        self.file = self.fs.open_output_stream(self.draft, compression=None)
        return self.file

    def __exit__(self, kind, *_):
        self.file.close()
        if kind is None:
            self.fs.move(self.draft, self.name)


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    name, count = f"part-{TaskContext.get().partitionId():06d}.warc.gz", 0
    parts = slices(batches, "html")
    first = next(parts, None)
    if first is None:
        return
    with _Output(folder, name) as out:
        deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
        for part in itertools.chain([first], parts):
            for page_id, url, source, refers_to in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                out.write(deflate.compress(record(page_id, url, (source or "").encode("utf-8", "surrogatepass"), refers_to)))
            count += len(part)
        out.write(deflate.flush())
    yield pa.RecordBatch.from_pylist([{"archive": name, "records": count}])


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> list[str]:
    """Write a record per row of `pages` (page_id, url, html) and return the names of the archives in `folder`."""
    payload = F.coalesce("html", F.lit(""))
    hashed = pages.select("page_id", "url", "html", F.sha1(payload).alias("sha1"), (F.octet_length(payload) >= min_bytes).alias("large"))
    copies = hashed.where("large").groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select("sha1", "last", F.lit(True).alias("large"))
    if is_small(copies, MAX_COPIES):
        found = hashed.join(F.broadcast(copies), ["sha1", "large"], "left")
    else:
        keyed = hashed.withColumn("row", F.xxhash64("page_id", "url", "sha1"))
        narrow = join_salted(keyed.where("large").select("row", "sha1"), copies.drop("large"), "sha1", F.col("row")).select("row", "last").distinct()
        found = keyed.join(narrow, "row", "left")
    refers_to = F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to")
    written = map_arrow(found.select("page_id", "url", "html", refers_to), partial(_write, folder=folder), "archive string, records long")
    return sorted(r.archive for r in written.collect())


def _normalise(batches: Iterator[pa.RecordBatch], source: str, folder: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name in batch.column("archive").to_pylist():
            files, base = open_fs(source)
            offset, count = 0, 0
            with files.open_input_stream(f"{base}/{name}", compression=None) as stream, _Output(folder, name) as out, _Output(folder, f"{name}.idx") as index:
                for whole in split_records(inflate(iter(lambda s=stream: s.read(CHUNK), b""))):
                    fields = header_fields(whole[: whole.index(b"\r\n\r\n")])
                    member = gzip.compress(whole, 6, mtime=0)
                    out.write(member)
                    row = {"archive": name, "offset": offset, "length": len(member), "type": fields["warc-type"], "page_id": _page_of(fields["warc-record-id"])}
                    row |= {"digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "url": fields.get("warc-target-uri")}
                    index.write(json.dumps(row).encode() + b"\n")
                    offset, count = offset + len(member), count + 1
            yield pa.RecordBatch.from_pylist([{"archive": name, "records": count}])


def normalise(spark: SparkSession, archives: list[str], source: str, folder: str) -> int:
    """Rewrite archives of `source` into `folder`, a gzip member a record, with an index beside each; returns the records."""
    if not archives:
        return 0
    names = spark.createDataFrame([(x,) for x in archives], "archive string").repartition(len(archives))
    done = map_arrow(names, partial(_normalise, source=source, folder=folder), "archive string, records long")
    return done.agg(F.sum("records")).first()[0]


def parse_record(whole: bytes) -> dict:
    """The columns of RECORDS from one uncompressed record; raises ValueError if a payload doesn't have its digest."""
    split = whole.index(b"\r\n\r\n")
    fields = header_fields(whole[:split])
    block = whole[split + 4 : split + 4 + int(fields["content-length"])]
    at = block.index(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block[:at].decode().split("\r\n")[1:])}
    payload, said = block[at + 4 :], fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (digest_of(payload) != said or len(payload) != int(http["content-length"])):
        raise ValueError(f"damaged payload of {fields['warc-record-id']}")
    return {
        "page_id": _page_of(fields["warc-record-id"]), "payload_bytes": int(http["content-length"]), "payload_digest": said,
        "record_type": fields["warc-type"], "refers_to": _page_of(fields.get("warc-refers-to")), "url": fields.get("warc-target-uri"),
    }


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes", "refers_to") else pa.string()) for n in (x.split()[0] for x in RECORDS.split(", "))])
    files, base = open_fs(folder)
    for batch in batches:
        rows, name, stream = [], None, None
        for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
            if archive != name:
                name, stream = archive, files.open_input_file(f"{base}/{archive}")
            rows.append(parse_record(gzip.decompress(stream.read_at(length, offset))))
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of all indexed records of a folder."""
    index = spark.read.schema(INDEX).json(f"{folder}/*.idx")
    total = index.agg(F.sum("length")).first()[0] or 0
    run = F.floor(F.col("offset") / READ_RUN).alias("run")
    tasks = 2 * (total // READ_RUN) + 1  # a number of its own: the index alone looks too small to be dealt
    dealt = index.select("archive", "offset", "length", run).repartition(tasks, "archive", "run").sortWithinPartitions("archive", "offset")
    return map_arrow(dealt.select("archive", "offset", "length"), partial(_read, folder=folder), RECORDS)


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write, normalise and read back the records of `pages` (page_id, url, html)."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    archives = write_archives(pages, f"{folder}/monolithic", min_bytes)
    if not normalise(spark, archives, f"{folder}/monolithic", f"{folder}/members"):
        return spark.createDataFrame([], RECORDS)
    return read_records(spark, f"{folder}/members")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BITS = "array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(instr('123456789abcdef', substr(sha, i::int, 1))), 4, '0')), '')"
_BASE32 = (
    "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    "(16 * substr(bits, (5 * i + 1)::int, 1)::int + 8 * substr(bits, (5 * i + 2)::int, 1)::int + 4 * substr(bits, (5 * i + 3)::int, 1)::int "
    "+ 2 * substr(bits, (5 * i + 4)::int, 1)::int + substr(bits, (5 * i + 5)::int, 1)::int + 1)::int, 1)), '')"
)
SQL = f"""
with hashed as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as sha from pages),
bits as (select *, {_BITS} as bits from hashed),
told as (select page_id, strlen(payload) as payload_bytes, {_BASE32} as payload_digest, max(page_id) over (partition by sha) as last from bits)
select page_id, payload_bytes, payload_digest, case when page_id = last then 'response' else 'revisit' end as record_type,
  case when page_id <> last then last end as refers_to
from told
"""
