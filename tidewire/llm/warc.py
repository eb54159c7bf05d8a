"""WARC: archives of pages, Zstandard records with a dictionary per file.

Each task deals its pages into files of a bounded size. The dictionary of a
file is built from the file's own records, stored in a skippable frame at
its head (magic 0x184D2A5D, as the WARC-Zstandard specification has it),
and each record is a Zstandard frame of its own, so records can be read
alone by offset. The first record is a ``warcinfo``. Of pages with equal
payloads the one with the smallest id is archived as a response; the others
become revisit records that refer to it and hold headers only.

Who revisits whom is found from ids and digests alone; pages are then
joined with that by id, so copies of one page are spread over all tasks.

A dictionary is trained on spread samples. Where a file's records are too
few or too alike for the trainer, the same samples themselves are the
dictionary (raw content). Only a file whose records are all empty has none.

Defined cases: null HTML is an empty payload; a null URL leaves out the
target URI. A URL with spaces, controls or other characters that a URI can't
have is written percent-encoded, and as it is, in JSON, in a field of its
own, so every URL is read back equal. A null page id is written without a
number and read back as null; such a page is never referred to. Payloads
under ``MIN_REVISIT`` bytes are always responses. Repeated rows with the
same id and payload: all are responses, as a record doesn't revisit itself.
A payload beyond ``FILE_BYTES`` has a file of its own. An empty table
writes no file. Only the id, URL and HTML columns are read.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import get, new_folder, put, scratch, written

MIN_REVISIT = 100
#: Bytes of records held before a file is written.
FILE_BYTES = 32 << 20
DICT_BYTES = 32 << 10
#: The dictionary of a file is built from records of so many bytes at most, evenly spread.
DICT_SAMPLE_BYTES = 2 << 20
LEVEL = 3
#: Bytes of a file that the decompressor is fed at once.
PIECE = 4096
SKIPPABLE = 0x184D2A5D
URN = "urn:page:"
#: Characters that a URI can have, the percent sign included.
_PLAIN = re.compile(r"[!#-;=?-\[\]_a-z~]*")
#: Copies of a page are told apart from the first in so many parts of their ids.
PARTS = 64

FILES = "path string, records long, bytes long"
RECORDS = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, payload binary"


def http_block(length: int, payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n%s" % (length, payload)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record."""
    revisit = refers_to is not None
    block = http_block(len(payload), b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{URN}{f'none:{uuid.uuid4().hex}' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        if _PLAIN.fullmatch(url):
            head.append(f"WARC-Target-URI: {url}")
        else:
            head += [f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._' + chr(39), errors='surrogatepass')}", f"Page-URL: {json.dumps(url)}"]
    if revisit:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_record(date: str) -> bytes:
    """The record that says what the file is."""
    block = b"software: tidewire\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _number(urn: str) -> int | None:
    rest = urn[len(URN) + 1 : -1]
    return None if rest.startswith("none:") else int(rest)


def parse(raw: bytes) -> dict | None:
    """What a record holds, None for a ``warcinfo``; for a response, digest and length come from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    kind = fields["WARC-Type"]
    if kind == "warcinfo":
        return None
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    url = json.loads(fields["Page-URL"]) if "Page-URL" in fields else fields.get("WARC-Target-URI")
    out = {"page_id": _number(fields["WARC-Record-ID"]), "record_type": kind, "url": url}
    if kind == "revisit":
        length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
        return out | {"payload_bytes": length, "payload_digest": said, "refers_to": _number(fields["WARC-Refers-To"]), "payload": None}
    digest = hashlib.sha256(payload).hexdigest()
    if digest != said:
        raise ValueError(f"record {out['page_id']}: its payload doesn't match its digest")
    return out | {"payload_bytes": len(payload), "payload_digest": digest, "refers_to": None, "payload": payload}


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from evenly spread records: 16 or more where there are so
    many, long ones cut as samples."""
    step = max(1, min(sum(map(len, records)) // DICT_SAMPLE_BYTES, len(records) // 16))
    samples = records[::step]
    most = max(1, DICT_SAMPLE_BYTES // max(1, len(samples)))
    samples = [r[:most] for r in samples if r]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, samples)) // 8)), samples, level=LEVEL, threads=0).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few, too short or too alike for the trainer
        return b"".join([r[: max(1, DICT_BYTES // len(samples))] for r in samples])[:DICT_BYTES] if samples else b""


def encode_file(records: list[bytes]) -> bytes:
    data = build_dictionary(records)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data) if data else None)
    return b"".join([struct.pack("<II", SKIPPABLE, len(data)), data, *map(packer.compress, records)])


def decode_file(raw: bytes) -> Iterator[bytes]:
    """The records of a file, one frame after the other."""
    magic, size = struct.unpack_from("<II", raw)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame at the head")
    data = raw[8 : 8 + size]
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
    view, at = memoryview(raw), 8 + size
    while at < len(raw):
        frame, out = unpacker.decompressobj(), []
        while not frame.eof:
            if at >= len(raw):
                raise ValueError("the last frame isn't whole")
            # Fed in pieces, as what is left of one after a frame is copied.
            piece = view[at : at + PIECE]
            out.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(out)


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, html, digest, refers_to)``.

    The first page of each repeated payload comes from an aggregation of ids
    and digests. Ids are told their first in ``PARTS`` parts a digest, so a
    hot payload is in no single task; pages are joined with that by id.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256))
    long = rows.where(F.octet_length("html") >= MIN_REVISIT).select("page_id", "digest", F.pmod(F.xxhash64("page_id"), F.lit(PARTS)).alias("part"))
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    firsts = written(firsts.select("digest", "first_id"), "warc-firsts")
    told = long.where("page_id is not null").join(firsts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))), ["digest", "part"])
    revisits = told.where("page_id <> first_id").select("page_id", "digest", "first_id").distinct()
    # Hashed on both, so repeated ids with other payloads have their own decision.
    known = rows.where("page_id is not null").join(revisits.hint("merge"), ["page_id", "digest"], "left")
    # Pages without an id: by digest and url, since they have no other key.
    spread = F.pmod(F.xxhash64("url"), F.lit(PARTS))
    nameless = rows.where("page_id is null").withColumn("part", spread).join(firsts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))), ["digest", "part"], "left")
    long_enough = F.when(F.octet_length("html") >= MIN_REVISIT, F.col("first_id"))
    out = ("page_id", "url", "html", "digest", long_enough.alias("refers_to"))
    return known.select(*out).union(nameless.select(*out))


def write_archives(pages: DataFrame, folder: str, **cols: str) -> DataFrame:
    """Write a record per page; a written table ``(path, records, bytes)`` of the files."""
    date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, done, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal done, held, size
            path = f"{folder}/{task:06d}-{done:04d}.warc.zst"
            put(path, data := encode_file([info_record(date), *held]))
            out = pa.RecordBatch.from_pydict({"path": [path], "records": [len(held)], "bytes": [len(data)]})
            done, held, size = done + 1, [], 0
            return out

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                page_id, url, html, digest, refers_to = (v.as_py() for v in row)
                held.append(record(page_id, url, html.encode(), digest, refers_to, date))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield flush()
        if held:
            yield flush()

    with scratch(pages.sparkSession):
        return written(mark_revisits(pages, **cols).mapInArrow(write, FILES), "warc-files", keep=True)


def read_archives(files: DataFrame) -> DataFrame:
    """The records of the files ``(path)``, read back one file at a time.

    Files are dealt evenly over ``spark.sql.shuffle.partitions`` tasks: they
    are of about one size, and a fixed number of tasks isn't coalesced.
    """
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for raw in decode_file(get(path)):
                    if (found := parse(raw)) is not None:
                        rows.append(found)
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path").repartition(n).mapInArrow(read, RECORDS)


def archive_roundtrip(pages: DataFrame, folder: str | None = None, **cols: str) -> DataFrame:
    """Write the archives, then the records as read back from them."""
    return read_archives(write_archives(pages, folder or new_folder(pages.sparkSession, "warc"), **cols))
