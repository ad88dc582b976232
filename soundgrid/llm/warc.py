"""WARC archives: writing, normalising and reading back.

``write`` puts pages into monolithic archives (one gzip stream each). ``normalise`` inflates each archive once as a
stream, writes every record as a gzip member of its own and a sidecar index of offsets, and ``read`` fetches records by
that index. Files lie in the folder given, under names of their own; a task writes to a temporary name and renames at
the end, so a task that is run again leaves nothing half-written that anything would read.

Of records with equal payloads of at least ``least_bytes`` bytes, those with the smallest page_id are responses, the
others revisits of it without the payload; repeated rows of the smallest page_id are all responses. A null html is an
empty payload. A null page_id is larger than any other and kept as null. Line breaks in a url become spaces; a null url
is empty. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, new_path, remove, written

GZIP = 31
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, type string, record_id string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").rstrip(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """One WARC record; its block is an HTTP response without the payload for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _urn(page_id),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": " ".join((url or "").splitlines()),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "Content-Type": "application/http; msgtype=response",
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _urn(first)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode("utf-8", "replace").split("\r\n")[1:])}


class Output:
    """A file that gets its name when it is complete."""

    def __init__(self, folder: str, suffix: str):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}{suffix}"
        self.uri, self.path, self.temp = f"{folder}/{name}", f"{root}/{name}", f"{root}/.{name}.part"
        self.out = self.fs.open_output_stream(self.temp)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.path)


def inflated(source, size: int = CHUNK) -> Iterator[bytes]:
    """Pieces, of that size at most, of a gzip stream of one or more members."""
    z = zlib.decompressobj(GZIP)
    while data := source.read(size):
        more = True
        while data or more:
            if z.eof:
                z = zlib.decompressobj(GZIP)
            piece = z.decompress(data, size)
            yield piece
            data, more = (z.unused_data, False) if z.eof else (z.unconsumed_tail, len(piece) == size)
    if not z.eof:
        raise ValueError("the gzip stream ends early")


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an uncompressed WARC stream; holds one record and one piece at a time."""
    held = bytearray()
    need = 0
    for piece in pieces:
        held += piece
        while True:
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(headers(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("the archive ends within a record")


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def write(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = 256 << 20) -> DataFrame:
    """archive, n_records of the monolithic archives that hold a record per page."""
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.sha2(F.encode(html, "UTF-8"), 256).alias("key"))
    first = keyed.select("page_id", "key").groupBy("key").agg(F.min("page_id").alias("first"))
    placed = keyed.join(first, "key").drop("key")
    kind = pa.schema([("archive", pa.string()), ("n_records", pa.int64())])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, made, n, size = None, [], 0, 0

        def close() -> None:
            out.out.write(z.flush())
            out.close()
            made.append((out.uri, n))

        for page_id, url, page, least in arrow_rows(batches, "page_id", "url", "html", "first"):
            if out is None:
                out, z, n, size = Output(folder, ".warc.gz"), zlib.compressobj(6, zlib.DEFLATED, GZIP), 0, 0
            payload = page.encode()
            raw = record(page_id, url, payload, least, len(payload) >= least_bytes and page_id != least)
            out.out.write(z.compress(raw))
            n, size = n + 1, size + len(raw)
            if size >= archive_bytes:
                close()
                out = None
        if out is not None:
            close()
        yield _batch(kind, made)

    return written(placed.mapInArrow(store, "archive string, n_records long"), "warc-archives")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """The index (INDEX) of normalised archives, one for each archive; also written beside each as .cdxj."""
    kind = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("record_id", pa.string())])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (uri,) in arrow_rows(batches, "archive"):
            fs, path = pafs.FileSystem.from_uri(uri)
            out, rows, at = Output(folder, ".warc.gz"), [], 0
            with fs.open_input_stream(path, compression=None) as source:
                for raw in records(inflated(source)):
                    head = headers(raw[: raw.index(b"\r\n\r\n")])
                    z = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                    member = z.compress(raw) + z.flush()
                    out.out.write(member)
                    rows.append((out.uri, at, len(member), head["warc-type"], head["warc-record-id"]))
                    at += len(member)
            out.close()
            side = Output(folder, ".cdxj")
            for row in rows:
                side.out.write((json.dumps(dict(zip(kind.names, row, strict=True))) + "\n").encode())
            side.close()
            yield _batch(kind, rows)

    each = archives.repartition(max(1, archives.count()), "archive")
    return written(each.mapInArrow(rewrite, INDEX), "warc-index")


def parse(raw: bytes) -> tuple:
    """A record's row: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = headers(head)
    http, _, payload = rest[: int(h["content-length"])].partition(b"\r\n\r\n")
    if h["warc-type"] == "response":
        return _page(h["warc-record-id"]), len(payload), digest(payload), "response", None
    return _page(h["warc-record-id"]), int(headers(http)["content-length"]), h["warc-payload-digest"].removeprefix("sha1:"), "revisit", _page(h["warc-refers-to"])


def read(index: DataFrame) -> DataFrame:
    """RECORD rows, each record fetched by its place in the index."""
    kind = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source, rows = None, None, []
        for uri, offset, length in arrow_rows(batches, "archive", "offset", "length"):
            if uri != opened:
                if source:
                    source.close()
                fs, path = pafs.FileSystem.from_uri(uri)
                opened, source = uri, fs.open_input_file(path)
            source.seek(offset)
            rows.append(parse(zlib.decompress(source.read(length), GZIP)))
            if len(rows) == 1024:
                yield _batch(kind, rows)
                rows = []
        yield _batch(kind, rows)

    return index.mapInArrow(fetch, RECORD)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages written, normalised and read back; the archives stay in the shared folder, under warc-*."""
    folder = new_path(pages.sparkSession, "warc")
    archives = write(pages, f"{folder}/whole", least_bytes)
    index = normalise(archives, f"{folder}/normal")
    remove(archives)
    return read(index)
