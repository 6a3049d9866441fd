"""WARC archives: one gzip member per record, written and read by tasks in the shared folder.

A task writes its rows to archives of bounded size. The reader is sequential: it inflates a member piece by piece, frames
the block by Content-Length, and checks the digests on the way, so a record is never larger in memory than its payload.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomprep.llm.common import written

ARCHIVE_BYTES = 32 << 20  # of compressed records, after which a task opens its next archive
READ_BYTES = 1 << 18
LONGEST_HEAD = 1 << 20
DATE = "2020-01-01T00:00:00Z"
RECORD = "urn:page:"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "page_id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string"


def base32_sha1(octets: bytes) -> str:
    return base64.b32encode(hashlib.sha1(octets).digest()).decode()


def named(page: object) -> str:
    return f"<{RECORD}{urllib.parse.quote(str(page), safe='')}>"


def page_of(record: str) -> str | None:
    inner = record.strip("<>")
    return urllib.parse.unquote(inner[len(RECORD) :]) if inner.startswith(RECORD) else None


def member(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One compressed record."""
    lines = [("WARC-Type", kind), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode()) + squeeze.compress(block) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def page_record(page: object, url: str | None, html: str, first: object) -> bytes:
    """Record of a page; ``first`` names the page that holds the same payload, else null."""
    payload = html.encode("utf-8", "surrogatepass")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if first is not None else head + payload
    fields = [("WARC-Record-ID", named(page))] if page is not None else [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>")]
    if url is not None:
        fields.append(("WARC-Target-URI", urllib.parse.quote(url, safe="/:?#[]@!$&'()*+,;=%~")))
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
    fields.append(("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"))
    if first is not None:
        fields += [("WARC-Refers-To", named(first)), ("WARC-Profile", SAME_PAYLOAD)]
    return member("revisit" if first is not None else "response", fields, block)


class Members:
    """The inflated bytes of an archive, member after member."""

    def __init__(self, stream: object):
        self.stream, self.rest, self.held, self.inflate = stream, b"", b"", None

    def open(self) -> bool:
        """Go to the next member; false at the end of the archive."""
        self.rest = self.rest or self.stream.read(READ_BYTES)
        self.inflate, self.held = zlib.decompressobj(31), b""
        return bool(self.rest)

    def more(self) -> bool:
        """Inflate another piece; false once the member has ended."""
        if self.inflate.eof:
            return False
        if not self.rest:
            self.rest = self.stream.read(READ_BYTES)
            if not self.rest:
                raise ValueError("the archive ends within a record")
        self.held += self.inflate.decompress(self.rest, READ_BYTES)
        self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def head(self) -> dict[str, str]:
        """Header lines up to the empty line, by lower-case name; the first line under the empty name."""
        while b"\r\n\r\n" not in self.held:
            if len(self.held) > LONGEST_HEAD or not self.more():
                raise ValueError("a record has no end of header")
        text, self.held = self.held.split(b"\r\n\r\n", 1)
        first, *lines = text.decode("utf-8").split("\r\n")
        return {"": first, **{k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}}

    def block(self, length: int) -> Iterator[bytes]:
        """The next ``length`` bytes, in pieces."""
        while length:
            if not self.held and not self.more():
                raise ValueError("a record is shorter than its Content-Length")
            piece, self.held = self.held[:length], self.held[length:]
            length -= len(piece)
            yield piece

    def close(self) -> None:
        while self.more():
            pass
        if self.held != b"\r\n\r\n":
            raise ValueError("a record does not end after its Content-Length")


def checked(digest: object, said: str | None, what: str) -> None:
    if said and said.upper() != "SHA1:" + base64.b32encode(digest.digest()).decode():
        raise ValueError(f"{what} digest {said} does not match")


def records(stream: object, payloads: bool = True) -> Iterator[dict[str, object]]:
    """The page records of an archive, in order. Other kinds of record are framed, checked and passed over."""
    members = Members(stream)
    while members.open():
        head = members.head()
        if not head[""].startswith("WARC/"):
            raise ValueError("not a WARC record")
        whole, own, kept, size, lead = hashlib.sha1(), hashlib.sha1(), [], 0, b""
        http = None if head.get("content-type", "").startswith("application/http") else {}
        for piece in members.block(int(head["content-length"])):
            whole.update(piece)
            if http is None:
                lead += piece
                if b"\r\n\r\n" not in lead:
                    continue
                top, piece = lead.split(b"\r\n\r\n", 1)
                lines = (line.partition(":") for line in top.decode("latin-1").split("\r\n")[1:])
                http = {k.strip().lower(): v.strip() for k, _, v in lines}
            own.update(piece)
            size += len(piece)
            if payloads:
                kept.append(piece)
        members.close()
        checked(whole, head.get("warc-block-digest"), "block")
        kind = head["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        if kind == "response":
            checked(own, head.get("warc-payload-digest"), "payload")
        url = head.get("warc-target-uri")
        yield {
            "page_id": page_of(head["warc-record-id"]),
            "url": urllib.parse.unquote(url) if url is not None else None,
            "record_type": kind,
            "refers_to": page_of(head["warc-refers-to"]) if "warc-refers-to" in head else None,
            "payload_bytes": size if kind == "response" else int((http or {}).get("content-length", 0)),
            "payload_digest": head.get("warc-payload-digest", "").rpartition(":")[2] or None,
            "payload": b"".join(kept) if payloads and kind == "response" else None,
        }


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0
) -> DataFrame:
    """Write a record per row below ``folder``; returns (path, records), one row per archive of the tasks that counted.

    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the smallest id are responses and the others
    revisit it. A null html is an empty payload. Rows with a null id are never revisited: they revisit the smallest id of
    their payload, or are responses where there is none, and read back with a null id. Rows that repeat an id and a
    payload have equal records. No rows give no archives. A task that is run again writes other archives; the manifest
    names those of the attempt that counted.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    slim = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest")
    )
    large = F.octet_length("html") >= least_bytes
    groups = slim.where(large).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = written(groups.where("n > 1 and first is not null").drop("n"), "warc-firsts")
    joined = slim.join(firsts, "digest", "left").select(
        "id", "url", "html", F.when(large & (F.col("id").isNull() | (F.col("id") != F.col("first"))), F.col("first")).alias("first")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done, out, size, name = [], None, 0, ""
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    size += out.write(member("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    done.append([f"{folder}/{name}", 0])
                size += out.write(page_record(*row))
                done[-1][1] += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return written(joined.mapInArrow(run, "path string, records bigint"), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """A row per page record of the archives named in ``path``: ids as text, digests checked, payload null for revisits."""
    names = [f.split()[0] for f in FIELDS.split(", ")] + ["payload"] * payloads
    schema = FIELDS + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_stream(place, compression=None) as stream:
                    rows, size = [], 0
                    for record in records(stream, payloads):
                        rows.append(record)
                        size += 200 + len(record["payload"] or b"")
                        if size > READ_BYTES * 16:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

    spread = manifest.select("path").repartition(max(1, manifest.count()))
    return spread.mapInArrow(run, schema)


def archives_of(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the archives in a folder that some other program wrote, listed by Spark."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder)
    return found.select("path")
