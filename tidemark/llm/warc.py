"""WARC archives: written as one gzip stream each, then normalised to one member a record.

* ``write_archives`` writes pages as WARC records; every task streams its records into
  archives of about ``ARCHIVE_BYTES`` that are a single gzip member each.
* ``normalise`` inflates each such archive once, as a stream, writes every record as a gzip
  member of its own, and beside the archive a sidecar index with a line per record:
  offset, length, record id, type. The index also comes back as a table.
* ``read_records`` fetches records by offset and length alone and digests their payloads.

Files lie in the session's shared folder and are opened through ``pyarrow.fs`` by their
URI. A file's name holds the attempt that wrote it, and only files named by a finished task
are used, so a lost executor leaves unused files behind and nothing else.

Null payloads are empty, null or odd URLs are written percent-encoded. Pages that repeat
an id and a payload have a numbered record each; revisits name the first of them. A null
page id is written as no id and comes back null.
An empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import equal_groups
from tidemark.llm.rows import null_safe, small_batches
from tidemark.operators.ordered import durable, shared_folder

#: Payloads of at least this many bytes are written once; equal ones become revisits.
LEAST_REVISIT = 1000
#: Bytes of records after which a task begins its next archive.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20

# ------------------------------------------------------------- fixed values of the format
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

_WRITTEN = "path string, records bigint, bytes bigint"
_INDEX = "path string, offset bigint, length bigint, record_id string, record_type string"
_READ = (
    "record_id string, page_id bigint, record_type string, refers_to string, "
    "payload_bytes bigint, payload_digest string"
)


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {digest}')}>"


def _record(
    page: int | None, url: str | None, payload: bytes, digest: str, winner: int | None, first: bool, again: str = ""
) -> bytes:
    """One WARC record: a response with the payload, or a revisit that names its response.

    ``again`` tells records of one page and payload apart; it is empty for the one revisits name.
    """
    block = HTTP_HEAD + (payload if first else b"")
    base32 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = {
        "WARC-Type": "response" if first else "revisit",
        "WARC-Record-ID": record_id(page, digest + again),
        "WARC-Date": DATE,
        "WARC-Target-URI": quote(url or "", safe="/:?&=%#~@!$'()*+,;[]"),
        "Content-Type": "application/http;msgtype=response",
        "WARC-Payload-Digest": f"sha1:{base32}",
    }
    if page is not None:
        head["Page-ID"] = str(page)
    if not first:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(winner, digest)}
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{name}: {value}\r\n" for name, value in head.items())
    return f"{VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def _attempt() -> str:
    context = TaskContext.get()
    return f"{context.partitionId():05d}-{context.taskAttemptId()}"


def _writer(folder: str, size: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        made, out, pack = [], None, None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{_attempt()}-{len(made):04d}.warc.gz"
                    out, pack = store.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                    made.append([name, 0, 0])
                payload = (row["html"] or "").encode()
                record = _record(row["page_id"], row["url"], payload, row["digest"], row["winner"], row["first"], row["again"])
                out.write(pack.compress(record))
                made[-1][1] += 1
                made[-1][2] += len(record)
                if made[-1][2] >= size:
                    out.write(pack.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(pack.flush())
            out.close()
        names, records, lengths = zip(*made) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(records, pa.int64()), pa.array(lengths, pa.int64())],
            names=["path", "records", "bytes"],
        )

    return write


def inflated_records(store: fs.FileSystem, path: str) -> Iterator[bytes]:
    """The records of a gzip archive, inflated once as a stream; one record is held at a time."""
    with store.open_input_stream(path, compression=None) as source:
        unpack, held = zlib.decompressobj(31), bytearray()
        need, more = None, True
        while more or held:
            chunk = source.read(CHUNK) if more else b""
            more = bool(chunk)
            while chunk:
                held += unpack.decompress(chunk)
                chunk = unpack.unused_data
                if unpack.eof:
                    unpack = zlib.decompressobj(31)
            at = 0
            while True:
                if need is None:
                    end = held.find(b"\r\n\r\n", at)
                    if end < 0:
                        break
                    fields, _ = _parse(bytes(held[at : end + 4]) )
                    need = end + 4 - at + int(fields["content-length"]) + 4
                if len(held) - at < need:
                    break
                yield bytes(held[at : at + need])
                at, need = at + need, None
            del held[:at]
            if not more and held:
                raise ValueError(f"{path} ends inside a record")


def _normaliser(source: str, target: str):
    def normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, origin = fs.FileSystem.from_uri(source)
        _, base = fs.FileSystem.from_uri(target)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                name = f"{path.removesuffix('.warc.gz')}-{TaskContext.get().taskAttemptId()}.warc.gz"
                rows, offset = [], 0
                with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                    for record in inflated_records(store, f"{origin}/{path}"):
                        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = pack.compress(record) + pack.flush()
                        out.write(member)
                        fields, _ = _parse(record)
                        rows.append((name, offset, len(member), fields["warc-record-id"], fields["warc-type"]))
                        offset += len(member)
                names = ["path", "offset", "length", "record_id", "record_type"]
                with store.open_output_stream(f"{base}/{name}.idx") as out:
                    for row in rows:
                        out.write((json.dumps(dict(zip(names[1:], row[1:]))) + "\n").encode())
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = zip(*rows) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return normalised


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        opened, source = None, None
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))):
                if path != opened:
                    if source is not None:
                        source.close()
                    opened, source = path, store.open_input_file(f"{base}/{path}")
                member = source.read_at(length, offset)
                fields, block = _parse(zlib.decompress(member, 31))
                page = fields.get("page-id")
                _, _, payload = block.partition(b"\r\n\r\n")
                rows.append(
                    (
                        fields["warc-record-id"], int(page) if page is not None else None, fields["warc-type"],
                        fields.get("warc-refers-to"), len(payload), hashlib.sha1(payload).hexdigest(),
                    )
                )
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            columns = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["record_id", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"],
            )
        if source is not None:
            source.close()

    return read


def _folder(df: DataFrame, name: str) -> str:
    """A fresh folder below the shared one, as a URI."""
    base = shared_folder(df.sparkSession)
    uri = f"{base if ':' in base else f'file://{base}'}/{name}-{uuid.uuid4().hex}"
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)
    return uri


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """Write ``pages(page_id, url, html)``; returns the folder and the archives' table.

    Of equal payloads of ``LEAST_REVISIT`` bytes or more the largest page id is the response.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = small_batches(pages).select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.sha1(html).alias("digest"),
        F.octet_length(html).alias("size"),
    )
    known = durable(
        rows.groupBy("page_id", "digest", "size").agg(F.min(F.coalesce("url", F.lit(""))).alias("first_url"))
    )
    large = durable(known.filter(F.col("size") >= LEAST_REVISIT).select("digest", "page_id", "first_url"))
    facts = ["page_id", "digest", "first_url", "winner"]
    groups = equal_groups(large, "digest", "page_id").select(*facts)
    small = known.filter(F.col("size") < LEAST_REVISIT).withColumn("winner", F.col("page_id")).select(*facts)
    told = groups.unionByName(small)
    told = told.select(null_safe(F.col("page_id"), F.col("digest")).alias("key"), "first_url", "winner")
    named = rows.withColumn("key", null_safe(F.col("page_id"), F.col("digest")))
    # One key for the join and for what repeats, so that the payloads are shuffled once.
    held = ["page_id", "html", "digest", "first_url", "winner"]
    joined = named.join(told, "key").groupBy("key", F.coalesce("url", F.lit("")).alias("url")).agg(
        *[F.first(name).alias(name) for name in held], F.count(F.lit(1)).alias("times")
    )
    # Equal rows meet as one with their number, and are told apart again here.
    each = joined.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    known_as = (F.col("url") == F.col("first_url")) & (F.col("time") == 1)
    again = F.when(known_as, "").otherwise(F.concat_ws(" ", F.lit(""), F.col("time").cast("string"), "url"))
    folder = _folder(pages, "warc")
    ready = each.select(
        "page_id", "url", "html", "digest", "winner",
        F.col("page_id").eqNullSafe(F.col("winner")).alias("first"), again.alias("again"),
    )
    return folder, durable(ready.mapInArrow(_writer(folder, archive_bytes), _WRITTEN))


def normalise(folder: str, archives: DataFrame) -> tuple[str, DataFrame]:
    """Rewrite single-stream archives record by record; returns the folder and the index."""
    target = _folder(archives, "members")
    files = archives.filter("records > 0").select("path").repartition(max(1, archives.count()), "path")
    return target, durable(files.mapInArrow(_normaliser(folder, target), _INDEX))


def read_records(folder: str, index: DataFrame) -> DataFrame:
    """Fetch every record by its place in the index; revisits get their response's payload facts."""
    placed = index.repartitionByRange("path", "offset").sortWithinPartitions("path", "offset")
    read = durable(placed.mapInArrow(_reader(folder), _READ))
    responses = read.filter("record_type = 'response'").select(
        F.col("record_id").alias("response_id"),
        F.col("page_id").alias("response_page"),
        F.col("payload_bytes").alias("response_bytes"),
        F.col("payload_digest").alias("response_digest"),
    )
    revisits = read.filter("record_type = 'revisit'").join(responses, F.col("refers_to") == F.col("response_id"), "left")
    facts = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (
        read.filter("record_type = 'response'")
        .withColumn("refers_to", F.lit(None).cast("bigint"))
        .select(*facts)
        .unionByName(
            revisits.select(
                "page_id",
                F.col("response_bytes").alias("payload_bytes"),
                F.col("response_digest").alias("payload_digest"),
                "record_type",
                F.col("response_page").alias("refers_to"),
            )
        )
    )


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back ``pages``: one row per page."""
    folder, archives = write_archives(pages)
    return read_records(*normalise(folder, archives))
