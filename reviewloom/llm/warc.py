"""WARC archives: written as one gzip member per record, read back in byte ranges of any size.

Writing and reading go through Spark's file sources, so archives can lie wherever Spark can read and write, and lost tasks are
run again without harm. A row of the text writer is the bytes of one record plus a separator. The last byte
of a gzip member is the top byte of its length, zero for records under 16 MB: that byte is the separator. (A
longer record is followed by an empty member, which also ends in zero.) So files are gzip members and nothing else.

The reader takes any archive whose records are gzip members of their own, as is usual. It cuts files at the three bytes
that begin a gzip member, wherever Spark splits the file; a task owns what begins inside its range. Those bytes also occur
inside compressed data. A candidate is a record only if its head inflates and starts with a WARC version; else its bytes
belong to the record before. A record that such bytes cut at the end of a range is put together from the few pieces of its
file that are left over. Spark unpacks files by the ending of their names, and cannot split them then; a file that has such
an ending is read through a mount table, an option of the read, under a name without one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.session import durable

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
LEAST_REVISIT = 100  # payload bytes from which an equal payload becomes a revisit
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "page_id long, record_id string, url string, record_type string, payload binary, payload_bytes long, "
    "payload_digest string, refers_to long, refers_to_id string, file string, begins long, part long, piece binary"
)
KEPT = RECORDS.replace(" long", "").replace(" string", "").replace(" binary", "").split(", ")[:9]
REVISIT_ROWS = 1_000_000  # revisits, 100 bytes each, up to which their list is broadcast
PACKED = re.compile(r"\.(gz|gzip|bz2|deflate|snappy|lz4|zst)$")  # endings by which files are unpacked
HEAD = 64  # compressed bytes that are enough to see a version line


def planned(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Pages with their payload's bytes and digest, and the page that a revisit refers to.

    Equal payloads of at least ``least`` bytes: the smallest page_id is the response, others revisit it. That is decided on
    ids and digests alone; payloads move only if there are more than ``REVISIT_ROWS`` revisits, when both sides
    of the last join are shuffled by page and digest, of which a row has its own.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
    ).withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2("html", 256))
    slim = durable(rows.where(F.col("payload_bytes") >= least).select("page_id", "payload_digest"))
    first = slim.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    first = first.where("copies > 1").select("payload_digest", "first")
    revisits = durable(
        slim.join(first, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
        .select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("first").alias("refers_to")).distinct()
    )
    if revisits.count() <= REVISIT_ROWS:
        revisits = F.broadcast(revisits)
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest"))
    return rows.join(revisits, same, "left").drop("_page", "_digest")


def _line(value: str) -> str:
    return "".join(" " if c in "\r\n" else c for c in value)


def _record(page_id, url, html, n_bytes, digest, refers_to, date) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {date}"]
    # an id of the page's own; a page without id gets a name from its content, as the header is mandatory
    own = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest}')}"
    lines.append(f"WARC-Record-ID: <{own}>")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    block = b""
    if refers_to is None:
        payload = html.encode("utf-8", "surrogatepass")
        block = (
            f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
        ).encode() + payload
        lines.append("Content-Type: application/http; msgtype=response")
    else:
        # the length is a field of this writer's own: a revisit has no payload to take it from
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}", f"X-Payload-Length: {n_bytes}"]
    lines.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    """One gzip member that ends in a zero byte."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    packed = packer.compress(record) + packer.flush()
    if packed[-1]:
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        packed += packer.compress(b"") + packer.flush()
    return packed


def _members(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to")]
            for start in range(0, batch.num_rows, 256):
                rows = zip(*(c.slice(start, 256).to_pylist() for c in columns), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([member(_record(*row, date))[:-1] for row in rows], pa.binary())], names=["value"]
                )

    return run


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages`` (page_id, url, html) to gzip members under ``path``.

    Null html is an empty payload. A null url has no header; a page without page_id gets a record id made of its url and
    payload. ``date`` is when the pages were fetched, as they do not say. Line ends in a url become blanks.
    Rows that repeat the smallest page_id of equal payloads are all responses. Other columns are not written.
    """
    packed = planned(pages).select("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to")
    packed = packed.mapInArrow(_members(date), "value binary")
    (
        packed.select(F.col("value").cast("string").alias("value"))
        .write.option("lineSep", "\0").option("compression", "none").mode("errorifexists").text(path)
    )


def inflated(data: bytes) -> tuple[bytes, bool, bytes]:
    """(bytes, whether the member ends inside ``data``, what follows it). Raises zlib.error on bytes that are no member."""
    unpacker = zlib.decompressobj(31)
    out = unpacker.decompress(data) + unpacker.flush()
    return out, unpacker.eof, unpacker.unused_data


def is_record(data: bytes) -> bool:
    """Whether a member that holds a record begins here."""
    unpacker = zlib.decompressobj(31)
    try:
        head = unpacker.decompress(data[:HEAD], len(VERSION))
        if len(head) < len(VERSION) and len(data) > HEAD:
            head += unpacker.decompress(unpacker.unconsumed_tail + data[HEAD : 64 * HEAD], len(VERSION))
    except zlib.error:
        return False
    return head.startswith(VERSION)


def _bare(value: str | None) -> str | None:
    return value.strip().removeprefix("<").removesuffix(">") if value is not None else None


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"urn:page:(-?\d+)", name or "")
    return int(found[1]) if found else None


def _agrees(stated: str, data: bytes) -> bool:
    """Whether a digest header is that of the data; kinds and spellings that are not known are taken on trust."""
    kind, _, value = stated.strip().partition(":")
    kind = kind.lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha256", "sha512"):
        return True
    digest = hashlib.new(kind, data).digest()
    if len(value) == 2 * len(digest):
        return value.lower() == digest.hex()
    return value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


def parsed(record: bytes, payload: bool = True) -> tuple:
    """(page_id, record_id, url, record_type, payload, payload_bytes, payload_digest, refers_to, refers_to_id) of a record.

    The payload is the body of an HTTP message, and the block of any other record.
    """
    head, _, rest = record.partition(b"\r\n\r\n")
    fields: dict[str, str] = {}
    for line in head.decode("utf-8", "surrogateescape").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and fields:  # a header that goes on
            name = next(reversed(fields))
            fields[name] = f"{fields[name]} {line.strip()}".strip()
        else:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
    kind, block = fields.get("warc-type", ""), rest[: int(fields.get("content-length", len(rest)))]
    stated = fields.get("warc-payload-digest")
    body: bytes | None = None
    if kind == "revisit":
        n_bytes = int(fields["x-payload-length"]) if "x-payload-length" in fields else None
        digest = stated.removeprefix("sha256:") if stated else None
    else:
        body = block
        if fields.get("content-type", "").lower().startswith("application/http"):
            body = block.partition(b"\r\n\r\n")[2]
        n_bytes, digest = len(body), hashlib.sha256(body).hexdigest()
        if stated and not _agrees(stated, body):
            raise ValueError(f"damaged payload in {fields.get('warc-record-id')}")
    own, other = _bare(fields.get("warc-record-id")), _bare(fields.get("warc-refers-to"))
    text = [None if v is None else v.encode("utf-8", "surrogateescape").decode("utf-8", "replace") for v in (own, _bare(fields.get("warc-target-uri")), other)]
    return _page(own), text[0], text[1], kind, body if payload else None, n_bytes, digest, _page(other), text[2]


class _Out:
    """Rows of RECORDS, handed on in small batches."""

    names = [f.split()[0] for f in RECORDS.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]] for f in RECORDS.split(", ")]

    def __init__(self):
        self.rows, self.bytes = [], 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.bytes += len(row[4] or b"") + len(row[12] or b"") + 200

    def full(self) -> bool:
        return self.bytes > 4 << 20

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * len(self.names)
        arrays = [pa.array(c, t) for c, t in zip(columns, self.types, strict=True)]
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays(arrays, names=self.names)


def _whole(data: bytes) -> bytes | None:
    """The record that begins at ``data``, or None if it goes on after it."""
    try:
        record, ended, _ = inflated(data)
    except zlib.error as e:
        raise ValueError("damaged archive") from e
    return record if ended else None


BLANK = (None,) * len(KEPT)


def _owned(payload: bool):
    """Records that begin in each range; what cannot be settled in a range is passed on as pieces.

    Rows are the bytes between two magics, in the order of the file. A piece with part 0 is a record that is
    cut at the end of its range; others are false starts at a range's beginning.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, range_, part, opened = _Out(), None, 0, None
        for batch in batches:
            files, begins = batch.column("file").to_pylist(), batch.column("begins").to_pylist()
            for i, value in enumerate(batch.column("value")):
                here = (files[i], begins[i])
                if here != range_:
                    if opened is not None:
                        out.add(*BLANK, *range_, 0, opened)
                    range_, part, opened = here, 0, None
                piece = value.as_py()
                if not piece:
                    continue  # what lies before the first magic of a file
                data = MAGIC + piece
                if opened is not None:
                    opened += data
                elif is_record(data):
                    opened = data
                else:
                    part += 1
                    out.add(*BLANK, *range_, part, data)
                    continue
                record = _whole(opened)
                if record is not None:
                    out.add(*parsed(record, payload), range_[0], None, None, None)
                    opened = None
                if out.full():
                    yield out.batch()
        if opened is not None:
            out.add(*BLANK, *range_, 0, opened)
        yield out.batch()

    return run


def _stitched(payload: bool):
    def run(pieces: pa.Table) -> pa.Table:
        """Records of one file put together from cut ones and the false starts that follow them."""
        out, opened = _Out(), None
        rows = sorted(
            zip(*(pieces[c].to_pylist() for c in ("begins", "part", "piece")), strict=True),
            # false starts of a range come before the record that is cut at its end
            key=lambda r: (r[0], r[1] == 0, r[1]),
        )
        file = pieces["file"][0].as_py()
        for _, part, piece in rows:
            opened = piece if part == 0 else (opened + piece if opened is not None else None)
            record = _whole(opened) if opened is not None else None
            if record is not None:
                out.add(*parsed(record, payload), file, None, None, None)
                opened = None
        if opened is not None:
            raise ValueError(f"the last record of {file} is cut off")
        return pa.Table.from_batches([out.batch()])

    return run


def _raw(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The bytes between magics of all files under ``path``, and the names of files that are not empty."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = [r[0] for r in listed.where("length > 0").select("path").collect()]
    options = {"lineSep": MAGIC.decode("latin-1"), "encoding": "ISO-8859-1"}
    names = list(files)
    if any(PACKED.search(f) for f in files):
        host = f"archives{uuid.uuid4().hex}"
        for i, file in enumerate(files):
            options[f"fs.viewfs.mounttable.{host}.link./{i}"] = file
        names = [f"viewfs://{host}/{i}" for i in range(len(files))]
    return spark.read.options(**options).text(names or path), names


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """(page_id, record_id, url, record_type, payload, payload_bytes, payload_digest, refers_to, refers_to_id) per record.

    All files under ``path`` are read, whatever their names; records must be gzip members of their own. Records of all
    types are returned. page_id and refers_to are those of ``write_archives`` and null for others' records, which have
    record_id and refers_to_id. Bytes and SHA-256 digest are computed from the payload and checked against the header, whose
    digest may be of another kind. A revisit carries the digest that its header states (bare if it is SHA-256), the bytes if
    stated, and a null payload. With ``payload`` false payloads are checked but left out, and none is written on the way.
    Records are in no order. Empty files give no rows; a file without any record, or with a damaged one, is an error.
    """
    raw, names = _raw(spark, path)
    pieces = raw.select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("begins"),
    )
    read = durable(pieces.mapInArrow(_owned(payload), RECORDS))
    seen = read.where("piece is null or part = 0").agg(F.count_distinct("file")).first()[0]
    if seen < len(names):
        raise ValueError(f"{len(names) - seen} of {len(names)} files under {path} hold no record")
    cut = read.where("piece is not null").groupBy("file").applyInArrow(_stitched(payload), RECORDS)
    return read.where("piece is null").select(KEPT).unionByName(cut.select(KEPT))
