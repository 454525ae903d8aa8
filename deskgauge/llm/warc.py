"""WARC archives compressed with Zstandard, one frame per record and the dictionary in a leading skippable frame.

An archive is a row with its bytes in ``content``; a table of them is written and read as Parquet in the shared folder, and
``spark.read.format("binaryFile")`` of real files has the same column. Archives are cut at ``ARCHIVE_BYTES``.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskgauge.llm.common import text_or_empty

#: Magic number of the skippable frame that holds the dictionary, and of a Zstandard frame (fixed values of the format).
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
#: Bytes of records after which an archive is closed, of payload samples that make its dictionary, and payloads from which on
#: equal ones are revisits.
ARCHIVE_BYTES, DICT_BYTES, LEAST = 8 << 20, 32 << 10, 0
DATE = "2024-01-01T00:00:00Z"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def _header_value(x: str) -> str:
    """A value on one line: control characters and blanks are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in x)


def _record(page_id: int | None, url: str | None, payload: bytes, response_id: int | None, date: str) -> bytes:
    digest = _base32(hashlib.sha1(payload).digest())
    revisit = response_id is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _record_id(page_id, digest),
        "WARC-Date": date,
        "WARC-Target-URI": _header_value(url or ""),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{_base32(hashlib.sha1(block).digest())}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _record_id(response_id, digest), "X-Refers-To-Page-Id": str(response_id)}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def _archive(records: list[bytes]) -> bytes:
    """The dictionary is raw content: the starts of the first records, which share headers and page frames."""
    share = max(DICT_BYTES // max(len(records), 1), 1024)
    content = b"".join(r[:share] for r in records)[:DICT_BYTES]
    packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=True)
    return b"".join([struct.pack("<II", DICT_MAGIC, len(content)), content, *map(packer.compress, records)])


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """One row (content binary) per archive, with a record for every page.

    Of the pages whose payload (the html in UTF-8, null: empty) is equal and has ``least`` bytes or more, the one with the
    largest id is a response and the others are revisits of it; shorter payloads are all responses, and so are pages without
    an id and repeated rows of the largest id. The largest id is found from digests; a payload itself moves to no group.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), text_or_empty(html).alias("html"))
    keyed = rows.withColumn("digest", F.unhex(F.sha2("html", 256)))
    largest = keyed.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("own"), "largest")
    joined = keyed.join(largest, F.col("digest") == F.col("own"), "left")
    marked = joined.select("page_id", "url", "html", F.when(F.col("page_id") < F.col("largest"), F.col("largest")).alias("response_id"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        size = 0
        for batch in batches:
            for i, u, h, r in zip(*(batch.column(k) for k in range(4)), strict=True):
                records.append(_record(i.as_py(), u.as_py(), h.as_py().encode(), r.as_py(), date))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([_archive(records)], pa.binary())], names=["content"])
                    records, size = [], 0
        if records:
            yield pa.RecordBatch.from_arrays([pa.array([_archive(records)], pa.binary())], names=["content"])

    return marked.mapInArrow(pack, "content binary")


def _frame_end(data: memoryview, at: int) -> int:
    """End of the Zstandard frame at ``at``, from its block headers."""
    if struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise ValueError(f"no Zstandard frame at byte {at}")
    checksum = zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
    at += zstandard.frame_header_size(data[at : at + 18])
    while True:
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)  # a run-length block stores one byte
        if head & 1:
            break
    end = at + 4 * checksum
    if end > len(data):
        raise ValueError("the last frame is cut off")
    return end


def _dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary and where the records start; an archive may also have none. It may itself be compressed."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICT_MAGIC:
        return None, 0
    size = struct.unpack_from("<I", data, 4)[0]
    content = bytes(data[8 : 8 + size])
    if len(content) < size:
        raise ValueError("the dictionary is cut off")
    if content[:4] == struct.pack("<I", FRAME_MAGIC):
        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    return zstandard.ZstdCompressionDict(content), 8 + size


def parse_record(raw: bytes) -> dict:
    """Fields of one record; ``error`` says what is wrong with it, or is null."""
    out: dict = dict.fromkeys(("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "error"))
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k: v for k, _, v in (x.partition(": ") for x in lines[1:])}
    missing = [k for k in REQUIRED if not fields.get(k)]
    out["record_type"] = fields.get("WARC-Type")
    if not found or not lines[0].startswith("WARC/1."):
        out["error"] = "no version line"
    elif missing:
        out["error"] = f"missing {missing[0]}"
    elif not fields["Content-Length"].isdigit() or len(rest) != int(fields["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        out["error"] = "length"
    if out["error"]:
        return out
    block = rest[:-4]
    if "WARC-Block-Digest" in fields and fields["WARC-Block-Digest"] != f"sha1:{_base32(hashlib.sha1(block).digest())}":
        return out | {"error": "block digest"}
    http, found, payload = block.partition(b"\r\n\r\n")
    sizes = [x.split(b":", 1)[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if not found or not sizes or not sizes[0].isdigit():
        return out | {"error": "http head"}
    out |= {"url": fields.get("WARC-Target-URI"), "payload_bytes": int(sizes[0]), "payload_digest": digest}
    out |= {k: int(fields[n]) for k, n in (("page_id", "X-Page-Id"), ("refers_to", "X-Refers-To-Page-Id")) if n in fields}
    if fields["WARC-Type"] == "response":
        out["payload"] = payload
        if len(payload) != out["payload_bytes"] or _base32(hashlib.sha1(payload).digest()) != digest:
            out["error"] = "payload"
    return out


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, error string"


def read_archives(archives: DataFrame, content: str = "content", payloads: bool = True) -> DataFrame:
    """One row per record of the archives in the binary column ``content``.

    ``error`` is null for a record whose version, required headers, lengths and digests hold. A frame that can't be found
    or decompressed gives one row with ``error`` and ends its archive. Null and empty archives have no records. Revisits have
    no payload but the length and digest of the full one.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(n, types.get(n, pa.string())) for n in names])

    def records(data: bytes) -> Iterator[dict]:
        view = memoryview(data)
        try:
            words, at = _dictionary(view)
            reader = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
            while at < len(view):
                end = _frame_end(view, at)
                yield parse_record(reader.decompressobj().decompress(view[at:end]))
                at = end
        except (ValueError, IndexError, struct.error, zstandard.ZstdError) as e:
            yield dict.fromkeys(names) | {"error": f"archive: {e}"}

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for row in records(data.as_py() or b""):
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    size += 500 + len(row["payload"] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select(F.col(content).cast("binary")).mapInArrow(unpack, RECORD)


def payload_text(payload: Column) -> Column:
    """The payload of a response as text."""
    return F.decode(payload, "UTF-8")
