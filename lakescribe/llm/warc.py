"""WARC archives of pages: a Zstandard dictionary in front, every record a frame of its own.

An archive begins with a skippable frame that holds the dictionary, itself
compressed; every record after it is one Zstandard frame made with that
dictionary, so a record can be read by itself. Payloads that were archived
before are written as revisits, which carry the digest and the length of the
full payload but not its bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyarrow import fs

from lakescribe.session import materialized, shared_dir

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
_RECORD_ID = re.compile(r"<urn:page:(-?\d*)>")

#: Payload bytes after which a task begins another archive.
ARCHIVE_BYTES = 24 << 20
#: A dictionary's size, and the bytes of evenly spaced records of its archive it is trained on.
DICTIONARY_BYTES, SAMPLE_BYTES = 64 << 10, 2 << 20
#: Bytes that are read from an archive at once.
READ_BYTES = 32 << 10

ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payload_digest(payload: bytes) -> str:
    """SHA-1 of a payload in upper-case base32, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(text: str | None) -> int | None:
    found = _RECORD_ID.fullmatch(text or "")
    return int(found[1]) if found and found[1] else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, else a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:  # a line break in an address would begin another field
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + _END + block + _END


def _fields(lines: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in lines.decode().split("\r\n")[1:] if ": " in line)


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Fields of a record, fields of the HTTP message in it, and the payload it carries."""
    head, _, rest = data.partition(_END)
    fields = _fields(head)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != _END:
        raise ValueError(f"record {fields.get('WARC-Record-ID')} doesn't end where its length says")
    http, _, payload = block.partition(_END)
    return fields, _fields(http), payload


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary for the records of one archive, from evenly spaced ones of them.

    Where they are too few or too small to train one, the bytes of the sample
    are the dictionary as they are, so that every archive has one.
    """
    step = -(-sum(map(len, records)) // SAMPLE_BYTES) or 1
    sample = records[::step]
    size = sum(map(len, sample))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, size // 4), sample, k=256, d=8)
    except (zstandard.ZstdError, ValueError):
        raw = b"".join(sample)[-DICTIONARY_BYTES:]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write_archive(path: str, records: list[bytes], level: int = 3) -> int:
    """Write one archive; its bytes."""
    trained = train(records)
    store, name = _store(path)
    # Left to itself the library packs what goes to a name like this once more.
    with store.open_output_stream(name, compression=None) as out:
        packed = zstandard.ZstdCompressor(level=level).compress(trained.as_bytes())
        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)))
        out.write(packed)
        compressor = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
        for one in records:
            out.write(compressor.compress(one))
        return out.tell()


def read_archive(path: str) -> Iterator[bytes]:
    """The records of an archive, one by one."""
    store, name = _store(path)
    with store.open_input_stream(name, compression=None) as data:
        magic, size = struct.unpack("<II", data.read(8))
        if magic != DICTIONARY_MAGIC:
            raise ValueError(f"{path} doesn't begin with a dictionary")
        trained = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data.read(size)))
        held = b""
        decompressor = zstandard.ZstdDecompressor(dict_data=trained)
        while held or (held := data.read(READ_BYTES)):
            frame, parts = decompressor.decompressobj(), []
            while not frame.eof:
                if not held and not (held := data.read(READ_BYTES)):
                    raise ValueError(f"{path} ends within a record")
                parts.append(frame.decompress(held))
                held = frame.unused_data
            yield b"".join(parts)


def link(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: the smallest page_id with the same payload, null where it is the row's own.

    Payloads below ``least_bytes`` refer to nothing. Of the html only its
    digest and length are grouped; rows are joined to the payloads that occur
    more than once.
    """
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")
    ).withColumns({"digest": F.unhex(F.sha2("html", 256)), "size": F.octet_length("html")})
    first = (
        own.filter(F.col("size") >= least_bytes)
        .groupBy("digest", "size")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
        .filter("rows > 1 and first is not null")
        .drop("rows")
    )
    return own.join(first, ["digest", "size"], "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archive every row of ``pages``; the table of finished archives (path, records, bytes).

    ``pages`` needs page_id, url and html; other columns are ignored. A null
    html is an empty payload, a null url leaves the address out, a null
    page_id is archived under an empty name. Rows with the page_id that others
    refer to are all responses. An empty table gives no archive. Archives of
    attempts that failed are in no row of the result.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")

    def archive(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, name = _store(folder)
        store.create_dir(name, recursive=True)
        task = TaskContext.get().partitionId()

        def finish(records: list[bytes]) -> pa.RecordBatch:
            path = f"{folder}/part-{task:06d}-{uuid.uuid4().hex}.warc.zst"
            size = write_archive(path, records)
            return pa.RecordBatch.from_pydict({"path": [path], "records": [len(records)], "bytes": [size]})

        held, size = [], 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*batch.columns):
                one = record(page_id.as_py(), url.as_py(), html.as_py().encode(), refers_to.as_py(), date)
                held.append(one)
                size += len(one)
                if size >= ARCHIVE_BYTES:
                    yield finish(held)
                    held, size = [], 0
        if held:
            yield finish(held)

    return materialized(link(pages, least_bytes).mapInArrow(archive, "path string, records long, bytes long"), "warc-list")


def read(archives: DataFrame) -> DataFrame:
    """A row per record of the archives in ``archives`` (path): what its headers and payload say.

    The digest of every payload is computed again; a record whose payload
    doesn't fit its digest or length ends the read.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in ROW.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = []
                for data in read_archive(path):
                    fields, http, payload = parse(data)
                    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
                    if fields["WARC-Type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
                        raise ValueError(f"{path}: payload of {fields['WARC-Record-ID']} is damaged")
                    found.append((_page(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], _page(fields.get("WARC-Refers-To"))))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(parts, "path").mapInArrow(rows, ROW)
