"""WARC archives in Zstandard form with a shared dictionary.

An archive is the leading skippable frame (magic 0x184D2A5D) that holds the dictionary, then one Zstandard frame per record.  Tasks write
archives of at most about ``ARCHIVE_BYTES`` of payload each; an archive is one row (path, content), the shape of Spark's ``binaryFile``
source, so ``read_archives(spark.read.format("binaryFile").load(...))`` reads ``.warc.zst`` files and the written table alike.  The
dictionary is trained on one piece of at most ``PIECE`` characters, cut at a place that its hash chooses, of each of the ``SAMPLE`` pages with the smallest
hash (documented bounds; they change the size of archives only, never what is written or read); pages are
deduplicated by payload digest with a hash aggregate, so no window collects the copies of a page, and each archive stands alone.

The reader checks frame and record layout: record length against ``Content-Length``, mandatory headers, block digest, and payload length.  A frame that
fails is reported in the ``error`` column and does not hide the records after it.

Defined results.  Null html is an empty payload.  Payloads under ``MIN_BYTES`` are always responses.  A null ``page_id`` is written as an
empty id and never chosen while the payload has another id; if all copies have null ids all are responses.  Rows that repeat the
smallest ``page_id`` of a payload are all responses.  An empty table gives no archive and no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, functions as F

from gaugeframe.llm.common import smallest_hashes, stored

# Frame magics of the WARC Zstandard format.
DICTIONARY_FRAME, ZSTD_FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
MIN_BYTES, ARCHIVE_BYTES = 100, 8 << 20
SAMPLE, PIECE, DICTIONARY_BYTES = 256, 16 << 10, 64 << 10

_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, error string"
# Fixed value: the revisit profile of the WARC 1.1 format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample; empty when the sample is too small to train on."""
    some = pages.where("octet_length(html) > 0").select("html", F.xxhash64("page_id", "html").alias("h"))
    begin = F.pmod(F.col("h"), F.greatest(F.length("html") - PIECE, F.lit(0)) + 1).cast("int")
    pieces = smallest_hashes(some, F.col("h"), SAMPLE, some.count()).select("h", F.substring("html", begin + 1, F.lit(PIECE)).alias("piece"))
    texts = [r["piece"].encode() for r in pieces.orderBy("h", "piece").limit(SAMPLE).collect()]
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstd.ZstdError:
        return b""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: an HTTP response, or a revisit that keeps the HTTP headers only."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    name = "" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_line(url)}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _line(url: str | None) -> str:
    """Header values hold no line breaks; percent signs keep the escape reversible."""
    return (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def parse_record(data: bytes) -> dict:
    """Validate and take apart one record; raises ValueError."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC header")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"):
        if name not in fields:
            raise ValueError(f"header {name} is missing")
    length = int(fields["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {length}, the record has {len(rest) - 4}")
    block = rest[:length]
    if "WARC-Block-Digest" in fields and fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("the block does not have its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    inner = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:] if ": " in x)
    size, digest = int(inner.get("Content-Length", len(payload))), fields.get("WARC-Payload-Digest", "").removeprefix("sha256:")
    if fields["WARC-Type"] == "response":
        if size != len(payload):
            raise ValueError(f"the payload has {len(payload)} bytes, its header says {size}")
        own = hashlib.sha256(payload).hexdigest()
        if digest and digest != own:
            raise ValueError("the payload does not have its digest")
        digest = own
    uri = fields.get("WARC-Target-URI", "").replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return {"page_id": _page(fields["WARC-Record-ID"]), "url": uri, "payload_bytes": size, "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": _page(fields.get("WARC-Refers-To", "")), "error": None}


def _page(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name.lstrip("-").isdigit() else None


def frames(content: bytes) -> Iterator[bytes | ValueError]:
    """Records of one archive, decoded one frame at a time with the dictionary of the leading skippable frame."""
    at, known = 0, None
    if len(content) >= 8:
        magic, size = struct.unpack("<II", content[:8])
        if magic == DICTIONARY_FRAME:
            raw = content[8 : 8 + size]
            if raw.startswith(ZSTD_FRAME):  # the format allows a compressed dictionary
                raw = zstd.ZstdDecompressor().decompressobj().decompress(raw)
            known, at = zstd.ZstdCompressionDict(raw), 8 + size
    while at < len(content):
        if not content.startswith(ZSTD_FRAME, at):
            yield ValueError(f"no frame begins at byte {at}")
            at = content.find(ZSTD_FRAME, at + 1)
            if at < 0:
                return
            continue
        reader = zstd.ZstdDecompressor(dict_data=known).decompressobj() if known else zstd.ZstdDecompressor().decompressobj()
        try:
            # feed small pieces: memory stays with one record, not with the rest of the archive
            out, step, pos = [], 64 << 10, at
            while not reader.eof and pos < len(content):
                out.append(reader.decompress(content[pos : pos + step]))
                pos += step
            if not reader.eof:
                raise zstd.ZstdError("the last frame is cut off")
            at = min(pos, len(content)) - len(reader.unused_data)
            yield b"".join(out)
        except zstd.ZstdError as e:
            yield ValueError(str(e))
            at = content.find(ZSTD_FRAME, at + 1)
            if at < 0:
                return


def write_archives(pages: DataFrame) -> DataFrame:
    """Archives (path, content) of ``pages(page_id, url, html)``, written to the shared folder."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    first = rows.where(F.octet_length("html") >= MIN_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"))
    marked = rows.join(first, "digest", "left").select(
        "page_id", "url", "html", "digest",
        F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"),
    )
    dictionary = train_dictionary(pages)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstd.ZstdCompressionDict(dictionary) if dictionary else None
        writer = zstd.ZstdCompressor(level=3, dict_data=known, write_content_size=True)
        lead = struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary if dictionary else b""
        open_, size = [lead], 0

        def done() -> pa.RecordBatch:
            content = b"".join(open_)
            return pa.record_batch({"path": pa.array([hashlib.sha256(content).hexdigest() + ".warc.zst"]), "content": pa.array([content], pa.binary())})

        for batch in batches:
            columns = [batch.column(n) for n in ("page_id", "url", "html", "digest", "refers_to")]
            for row in zip(*columns):
                page_id, url, html, digest, refers_to = (x.as_py() for x in row)
                payload = html.encode()
                open_.append(writer.compress(record(page_id, url, payload, digest, refers_to)))
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    yield done()
                    open_, size = [lead], 0
        if len(open_) > 1:
            yield done()

    return stored(marked.mapInArrow(pack, "path string, content binary"))


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of archives (content), with what the record's own headers and payload say."""
    names = [x.split()[0] for x in _RECORD.split(", ")]
    kinds = [pa.string() if x.split()[1] == "string" else pa.int64() for x in _RECORD.split(", ")]

    def rows(found: list[dict]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x.get(n) for x in found], k) for n, k in zip(names, kinds)], names=names)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                found: list[dict] = []
                for data in frames(content.as_py() or b""):
                    try:
                        if isinstance(data, ValueError):
                            raise data
                        found.append(parse_record(data))
                    except ValueError as e:
                        found.append({"error": str(e)})
                    if len(found) == 1000:
                        yield rows(found)
                        found = []
                yield rows(found)

    return archives.select("content").mapInArrow(unpack, _RECORD)


def op9(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back."""
    return read_archives(write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
