"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; a bundle ends with the seek table of
the public seekable format, and an index maps each record to its frame and the
offset within it. Bundles are rows of a table in the shared folder, so any store
that Spark can write to holds them.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwalk.llm.common import checked_broadcast, cut, map_columns, shared_folder

#: Payload bytes after which a frame, and compressed bytes after which a bundle is closed.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 8 << 20
#: Fixed values of the seekable format: magic of the skippable frame and of the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BUNDLE_SCHEMA = "bundle string, data binary, records array<struct<record_id:string,frame:int,offset:long,length:long>>"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing frame, from the compressed and the plain size of each frame."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """Start, compressed and plain size of each frame."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    width = 12 if flags & 0x80 else 8
    at, out = 0, []
    for i in range(n):
        packed, plain = struct.unpack_from("<II", data, len(data) - 9 - (n - i) * width)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(data: bytes, frame: int) -> bytes:
    """One frame, without reading any other."""
    at, packed, plain = read_seek_table(data)[frame]
    return zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=plain)


def read_record(data: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record by its place in the index."""
    return read_frame(data, frame)[offset : offset + length]


def digest32(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def record(rid: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response, or a revisit if ``refers_to`` names a record."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{quote(rid, safe='-')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if url:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{quote(refers_to, safe='-')}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(plain: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a frame."""
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record must begin with its version")
        head = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        start = end + 4
        stop = start + int(head["content-length"])
        yield head, plain[start:stop]
        at = stop + 4


class BundleWriter:
    """Gathers records; ``add`` and ``close`` return the bundles that became full."""

    def __init__(self, name: str, frame_bytes: int, bundle_bytes: int):
        self.name, self.frame_bytes, self.bundle_bytes, self.number = name, frame_bytes, bundle_bytes, 0
        self.packer = zstandard.ZstdCompressor(level=3)
        self._fresh()

    def _fresh(self) -> None:
        self.frames, self.sizes, self.index = [], [], []
        self.open, self.plain = [], 0

    def _end_frame(self) -> None:
        if self.open:
            packed = self.packer.compress(b"".join(self.open))
            self.frames.append(packed)
            self.sizes.append((len(packed), self.plain))
            self.open, self.plain = [], 0

    def add(self, rid: str, data: bytes) -> list[dict]:
        self.index.append({"record_id": rid, "frame": len(self.frames), "offset": self.plain, "length": len(data)})
        self.open.append(data)
        self.plain += len(data)
        if self.plain >= self.frame_bytes:
            self._end_frame()
        return self.close() if sum(p for p, _ in self.sizes) >= self.bundle_bytes else []

    def close(self) -> list[dict]:
        self._end_frame()
        if not self.index:
            return []
        out = {"bundle": f"{self.name}-{self.number:05d}", "data": b"".join(self.frames) + seek_table(self.sizes), "records": self.index}
        self.number += 1
        self._fresh()
        return [out]


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """``(id, url, payload, sha1, refers_to)``: of rows with equal payloads of at least ``least`` bytes, all refer to the largest id but itself.

    Payloads aren't gathered: only their digests are grouped, and only digests
    that occur twice are joined back.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha1"))
    twice = cut(
        rows.where(F.octet_length("payload") >= least)
        .groupBy("sha1")
        .agg(F.max("id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("sha1", "first")
    )
    refers = F.when(F.col("id").isNull() | (F.col("id") != F.col("first")), F.col("first"))
    return rows.join(checked_broadcast(twice), "sha1", "left").select("id", "url", "payload", "sha1", refers.alias("refers_to"))


def write_archives(marked: DataFrame, path: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """Bundles of the records, with their indexes, as a table at ``path``."""

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = _parse_datatype_string(BUNDLE_SCHEMA)
    arrow = to_arrow_schema(out)

    def run(batches):
        writer = BundleWriter(f"part-{TaskContext.get().partitionId():05d}", frame_bytes, bundle_bytes)
        for batch in batches:
            for i in range(batch.num_rows):
                rid, url, payload, sha1, refers = (c[i].as_py() for c in batch.columns)
                data = record(rid or "", url, payload.encode("utf-8", "surrogatepass"), digest32(sha1), refers)
                for bundle in writer.add(rid or "", data):
                    yield pa.RecordBatch.from_pylist([bundle], schema=arrow)
        for bundle in writer.close():
            yield pa.RecordBatch.from_pylist([bundle], schema=arrow)

    texts = marked.withColumns({"id": F.col("id").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    texts.select("id", "url", "payload", "sha1", "refers_to").mapInArrow(run, out).write.parquet(path)


def read_archives(bundles: DataFrame) -> DataFrame:
    """``(record_id, payload_bytes, payload_digest, record_type, refers_to, bundle, frame)`` of every record.

    The digest of a response is computed from its payload and must equal its header.
    """
    from urllib.parse import unquote

    def name(uri: str | None) -> str | None:
        return (unquote(uri[len("<urn:page:") : -1]) or None) if uri else None

    def start():
        def work(rows):
            out = {k: [] for k in ("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "frame")}
            for bundle, data in zip(rows["bundle"], rows["data"], strict=True):
                for frame in range(len(read_seek_table(data))):
                    for head, block in parse_records(read_frame(data, frame)):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        if head["warc-type"] == "response":
                            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                                raise ValueError(f"{bundle}: the payload of {head['warc-record-id']} differs from its digest")
                            size = len(payload)
                        else:
                            size = int(http.rpartition(b"Content-Length: ")[2])
                        out["record_id"].append(name(head["warc-record-id"]))
                        out["payload_bytes"].append(size)
                        out["payload_digest"].append(digest)
                        out["record_type"].append(head["warc-type"])
                        out["refers_to"].append(name(head.get("warc-refers-to")))
                        out["bundle"].append(bundle)
                        out["frame"].append(frame)
            return out

        return work

    return map_columns(
        bundles.select("bundle", "data"),
        start,
        "record_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, bundle string, frame int",
    )


def archive(pages: DataFrame, path: str | None = None, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a WARC record for each row of ``pages`` to a table of bundles at ``path``, and reads the records back.

    Without ``path`` the table goes to a new folder in the shared one and stays
    there. A null payload is empty; a null URL has no target header; a null id is
    written as an empty name, and its row refers to another if one with its
    payload has an id. Rows that repeat the largest id are all responses. Other
    columns are ignored, and an empty table gives an empty result.
    Very long payloads are records of their own size.
    """
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(mark_revisits(pages, id_col, url_col, payload_col, least), path)
    return read_archives(spark.read.parquet(path))
