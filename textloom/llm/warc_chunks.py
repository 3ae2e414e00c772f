"""Operator 10, WARC as a chunked record table.

A record is never one big cell on its way: its payload travels as rows (record_id, chunk_no, chunk) with the digest of all bytes so far.
Archives are written the same way, as numbered pieces of their byte stream in a table in the shared scratch folder (their concatenation in
order is a ``.warc.gz`` file, one gzip member a record), and read back by a parser that holds a buffer and one chunk, whatever the
record's length. A piece holds whole records and is read where it lies; only a record beyond a piece's size spreads over several, which meet in one task in order.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK, PIECE, ARCHIVE, LEAST, LEVEL = 1 << 20, 4 << 20, 32 << 20, 100, 1
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Fixed texts of the format.
VERSION, PROFILE, DATE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "2024-01-01T00:00:00Z"


def record_uri(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page-{page_id}')}>"


def record_parts(row: dict) -> Iterator[bytes]:
    """The bytes of a record, in parts of at most a chunk."""
    payload = common.text_or_empty(row["html"]) if row["record_type"] == "response" else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    one_line = " ".join((row["url"] or "").split())
    head = [VERSION, f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_uri(row['page_id'])}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {one_line}", f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"X-Page-ID: {'' if row['page_id'] is None else row['page_id']}"]
    if row["refers_to"] is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uri(row['refers_to'])}", f"X-Refers-To-Page: {row['refers_to']}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}", "", ""]
    yield "\r\n".join(head).encode() + http
    for i in range(0, len(payload), CHUNK):
        yield payload[i : i + CHUNK]
    yield b"\r\n\r\n"


def compressed(parts: Iterator[bytes]) -> Iterator[bytes]:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    for part in parts:
        if out := packer.compress(part):
            yield out
    yield packer.flush()


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type and refers_to of every row.

    Payloads are compared by size and digest in a table without them; html itself is dealt out by page, so a page that many share meets no other.
    """
    p = pages.select("page_id", "url", "html", F.length(F.encode(F.coalesce("html", F.lit("")), "utf-8")).cast("long").alias("payload_bytes"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("payload_digest"))
    digests = common.written(p.where(F.col("payload_bytes") >= LEAST).select("page_id", "payload_digest"), "warc-digests")
    firsts = digests.groupBy("payload_digest").agg(F.min("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and response_id is not null")
    again = digests.join(firsts, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("response_id")))
    again = common.written(again.select(F.col("page_id").alias("again_id"), F.col("payload_digest").alias("again_digest"), "response_id"), "warc-revisits").distinct()
    return p.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("payload_digest") == F.col("again_digest")), "left").select(
        "page_id", "url", "html", "payload_bytes", "payload_digest", F.when(F.col("response_id").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("response_id").alias("refers_to"))


def write_archives(pages: DataFrame) -> DataFrame:
    """Write every row as a record; the table (archive, piece_no, split, piece) of the archives' bytes. An archive ends after the record with which it reaches 32 MB.

    Pieces end with a record before they exceed about 4 MB and have a null ``split``; a longer record has pieces of its own, ``split`` being the number of the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = common.block_ids()
        archive, number, total, held, size = next(ids), 0, 0, [], 0

        def piece(parts: list[bytes], split: int | None) -> pa.RecordBatch:
            nonlocal number
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([number - 1]), pa.array([split], pa.int64()), pa.array([b"".join(parts)], pa.binary())], ["archive", "piece_no", "split", "piece"])

        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                own, own_size, split = [], 0, None
                for part in compressed(record_parts({n: batch.column(k)[i].as_py() for k, n in enumerate(names)})):
                    own.append(part)
                    own_size, total = own_size + len(part), total + len(part)
                    if own_size >= PIECE:
                        if held:
                            yield piece(held, None)
                            held, size = [], 0
                        split = number if split is None else split
                        yield piece(own, split)
                        own, own_size = [], 0
                if split is not None:
                    if own:
                        yield piece(own, split)
                else:
                    if held and size + own_size > PIECE:
                        yield piece(held, None)
                        held, size = [], 0
                    held += own
                    size += own_size
                if total >= ARCHIVE:
                    if held:
                        yield piece(held, None)
                    archive, number, total, held, size = next(ids), 0, 0, [], 0
        if held:
            yield piece(held, None)

    return common.written(planned(pages).mapInArrow(run, "archive long, piece_no long, split long, piece binary"), "warc")


def unpacked(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The plain bytes of concatenated gzip members, at most a chunk at a time."""
    unpacker = zlib.decompressobj(31)
    for piece in pieces:
        while piece:
            if unpacker.eof:
                unpacker = zlib.decompressobj(31)
            out = unpacker.decompress(piece, CHUNK)
            piece = unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail
            if out:
                yield out


def record_chunks(stream: Iterator[bytes]) -> Iterator[dict]:
    """A row for each chunk of each record's payload (HTTP headers taken off): fields, chunk_no, chunk, bytes so far, digest so far, last."""
    held = bytearray()

    def more() -> bool:
        part = next(stream, None)
        if part is None:
            return False
        held.extend(part)
        return True

    def upto(mark: bytes) -> bytes | None:
        seen = 0
        while (at := held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(held)
            if not more():
                return None
        out = bytes(held[:at])
        del held[: at + len(mark)]
        return out

    while True:
        head = upto(b"\r\n\r\n")
        if head is None:
            if bytes(held).strip():
                raise ValueError("the archive ends in the middle of a record")
            return
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").strip().split("\r\n")[1:])}
        http = upto(b"\r\n\r\n")
        left = int(fields["content-length"]) - len(http) - 4
        said = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
        fields["payload-length"] = said["content-length"]
        digest, number, size = hashlib.sha256(), 0, 0
        while True:
            while len(held) < min(left, CHUNK) and more():
                pass
            chunk = bytes(held[: min(left, CHUNK)])
            if left and not chunk:
                raise ValueError("the archive ends in the middle of a record")
            del held[: len(chunk)]
            left, size = left - len(chunk), size + len(chunk)
            digest.update(chunk)
            yield {"fields": fields, "chunk_no": number, "chunk": chunk, "bytes_so_far": size, "digest_so_far": digest.hexdigest(), "last": left == 0}
            number += 1
            if not left:
                break
        while len(held) < 4 and more():
            pass
        del held[:4]


CHUNKS = "record_id string, page_id long, target_uri string, record_type string, refers_to long, stated_digest string, stated_bytes long, chunk_no long, chunk binary, bytes_so_far long, digest_so_far string, last boolean"


def read_archives(archives: DataFrame, keep_chunks: bool = True) -> DataFrame:
    """The chunk table of all archives: pieces of whole records are read where they are; those of a longer record go to one task, in order, and stream through it."""

    def rows(streams: Iterator[Iterator[bytes]]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for stream in streams:
            for x in record_chunks(unpacked(stream)):
                f = x["fields"]
                out.append({"record_id": f["warc-record-id"], "page_id": int(f["x-page-id"]) if f["x-page-id"] else None, "target_uri": f["warc-target-uri"], "record_type": f["warc-type"], "refers_to": int(f["x-refers-to-page"]) if "x-refers-to-page" in f else None, "stated_digest": f["warc-payload-digest"].partition(":")[2], "stated_bytes": int(f["payload-length"])} | {k: x[k] for k in ("chunk_no", "bytes_so_far", "digest_so_far", "last")} | {"chunk": x["chunk"] if keep_chunks else None})
                size += len(x["chunk"])
                if len(out) >= 1024 or size >= PIECE:
                    yield pa.RecordBatch.from_pylist(out, SCHEMA)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, SCHEMA)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return rows(iter([b.column("piece")[i].as_py()]) for b in batches for i in range(b.num_rows))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (((b.column("archive")[i].as_py(), b.column("split")[i].as_py()), b.column("piece")[i].as_py()) for b in batches for i in range(b.num_rows))
        return rows((piece for _, piece in own) for _, own in groupby(pieces, key=lambda x: x[0]))

    long = archives.where("split is not null").repartition("archive", "split").sortWithinPartitions("archive", "split", "piece_no")
    return archives.where("split is null").select("piece").mapInArrow(whole, CHUNKS).unionByName(long.select("archive", "split", "piece").mapInArrow(spread, CHUNKS))


SCHEMA = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("stated_digest", pa.string()), ("stated_bytes", pa.int64()), ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_())])


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every row, from the archives read back.

    A response's length and digest are those of the bytes read; a revisit carries its response's in its headers. Null html is an empty
    payload; null urls become empty; a row with a null page_id is a revisit where another row has the same payload, else a
    response; rows that repeat a page_id with the same payload are all responses if theirs is the smallest id. An empty table gives an empty table.
    """
    last = read_archives(write_archives(pages), keep_chunks=False).where("last")
    response = F.col("record_type") == "response"
    return last.select("page_id", F.when(response, F.col("bytes_so_far")).otherwise(F.col("stated_bytes")).alias("payload_bytes"), F.when(response, F.col("digest_so_far")).otherwise(F.col("stated_digest")).alias("payload_digest"), "record_type", "refers_to")
