"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent frames, each of some records, with a seek table in a skippable frame at its end (the
seekable Zstandard format). For each record the index has its identifier, the bundle, the number of its frame there, and the record's
place in the frame: a reader finds the frame by the seek table and opens it alone. Payloads that occur again are written once; the others refer to that record,
and so only pages with the payload of another need to know of one another.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, cut, drop_rows, lookup, new_folder, row_key

#: Bytes of records in a frame, and bytes of frames in a bundle, after which the next begins.
FRAME, BUNDLE = 1 << 20, 1 << 26
#: Bytes of records that a task reads back.
READ = 1 << 26
DATE = "2000-01-01T00:00:00Z"
#: Fixed values of the seekable format: magic numbers of the skippable frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, record string, bundle string, frame int, record_at long, record_size long"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path there. s3a and s3n, Spark's names for it, are s3."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(identifier: str, url: str | None, payload: bytes | None, size: int = 0, digest: str = "", refers_to: str | None = None) -> bytes:
    """One record: a response with its payload, or, where refers_to names a response, a revisit that has the payload's size and digest alone."""
    if refers_to is None:
        size, digest = len(payload), digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{identifier}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """What the headers of a record say, under RESULT's names, with its payload (None in a revisit); it fails where they don't fit the block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if rest[len(block) :] != b"\r\n\r\n" or kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError("damaged record")
    own, other = (fields.get(x, "::").split(":")[2] for x in ("WARC-Record-ID", "WARC-Refers-To"))
    return {"page_id": int(own) if own else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": int(other) if other else None, "payload": payload if kind == "response" else None}


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """frames: compressed and plain size of each."""
    table = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(table)) + table


def read_seek_table(source) -> list[tuple[int, int]]:
    """The place and the compressed size of each frame, from the footer of an open bundle."""
    end = source.size()
    source.seek(end - 9)
    n, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    source.seek(end - 9 - 8 * n)
    sizes = [x[0] for x in struct.iter_unpack("<II", source.read(8 * n))]
    return [(sum_, size) for sum_, size in zip(accumulate(sizes, initial=0), sizes, strict=False)]


class BundleWriter:
    """Writes bundles under names that no other attempt of a task has, and tells where each record went."""

    def __init__(self, folder: str, name: str):
        import zstandard

        self.files, self.root = file_system(folder)
        self.name, self.zstd, self.n, self.out = name, zstandard.ZstdCompressor(level=3), 0, None
        self.open_rows: list[tuple[int | None, str, int, int]] = []
        self.buffer = bytearray()

    def add(self, page_id: int | None, identifier: str, raw: bytes) -> list[tuple]:
        self.open_rows.append((page_id, identifier, len(self.buffer), len(raw)))
        self.buffer += raw
        return self.close_frame() if len(self.buffer) >= FRAME else []

    def close_frame(self) -> list[tuple]:
        if not self.buffer:
            return []
        if self.out is None:
            self.bundle, self.at, self.frames = f"{self.name}-{self.n:05d}.warc.zst", 0, []
            self.out = self.files.open_output_stream(f"{self.root}/{self.bundle}", compression=None)  # the frames are compressed already
        frame = self.zstd.compress(bytes(self.buffer))
        self.out.write(frame)
        rows = [(page_id, name, self.bundle, len(self.frames), a, n) for page_id, name, a, n in self.open_rows]
        self.frames.append((len(frame), len(self.buffer)))
        self.at += len(frame)
        self.open_rows, self.buffer = [], bytearray()
        if self.at >= BUNDLE:
            self.close()
        return rows

    def close(self) -> list[tuple]:
        rows = self.close_frame()
        if self.out is not None:
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.out, self.n = None, self.n + 1
        return rows


def columns(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], x.type) for i, x in enumerate(types)], schema=types)


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """A row for each row of pages whose payload another row, its response, has: page_id, url, _k1, _k2, sha1, size, a number of its own, and _stays, the response's page_id, number and key."""
    payload, (one, two) = F.coalesce("html", F.lit("")).cast("binary"), row_key(pages)
    rows = cut(
        pages.select("page_id", "url", one.alias("_k1"), two.alias("_k2"), F.monotonically_increasing_id().alias("_row"), F.sha1(payload).alias("sha1"), F.sha2(payload, 256).alias("_sha"), F.octet_length(payload).alias("size"))
    )
    met = rows.where(F.col("size") >= least_bytes).groupBy("_sha", "size").agg(F.max(F.struct("page_id", "_row", "_k1", "_k2")).alias("_stays"), F.count("*").alias("_n"))
    return lookup(rows, met.where("_n > 1").drop("_n"), ["_sha", "size"], F.col("_row")).where("_stays._row <> _row").drop("_sha")


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes a record for each row of pages to bundles in folder, which all executors reach, and returns the index.

    Of rows with equal html (SHA-256 and size) of at least least_bytes bytes, that with the largest page_id is the response (one of them, where rows repeat) and the others revisit it; a null
    page_id is the smallest. A null html counts as empty; a page of any size is one record, held whole in its task. The index is held in the shared folder: bundles that a lost task left behind are in no index.
    """
    files, root = file_system(folder)
    files.create_dir(root, recursive=True)
    types = arrow_schema(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        writer = BundleWriter(folder, f"{context.partitionId():06d}-{context.taskAttemptId()}")
        for batch in batches:
            rows = []
            for columns_ in zip(*(batch.column(i) for i in range(7)), strict=True):
                page_id, name, url, html, size, sha1, refers = (x.as_py() for x in columns_)
                if refers is None:
                    raw = record(name, url, (html or "").encode())
                else:
                    raw = record(name, url, None, size, base64.b32encode(bytes.fromhex(sha1)).decode(), refers)
                rows += writer.add(page_id, name, raw)
            yield columns(rows, types)
        yield columns(writer.close(), types)

    def named(page_id: str, key: str, *more: Column) -> Column:
        return F.concat(F.lit("urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.lit(":"), F.hex(key), *more)

    pages = pages.select("page_id", "url", "html")
    again = cut(revisits(pages, least_bytes))
    same = (F.col("_k1") == F.col("_stays._k1")) & (F.col("_k2") == F.col("_stays._k2"))
    told = cut(again.groupBy("_k1", "_k2", same.alias("same")).count())
    first = drop_rows(pages, told.where("not same").select("_k1", "_k2"), told.where("same").select("_k1", "_k2"))
    first = first.select("page_id", "url", "html", row_key(pages)[0].alias("_k1")).select("page_id", named("page_id", "_k1").alias("name"), "url", "html", F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("sha1"), F.lit(None).cast("string").alias("refers"))
    refer = again.select("page_id", named("page_id", "_k1", F.lit("."), F.col("_row").cast("string")), "url", F.lit(None).cast("string"), F.col("size").cast("long"), "sha1", named("_stays.page_id", "_stays._k1"))
    return cut(first.union(refer).mapInArrow(run, INDEX))


def read_archive(index: DataFrame, folder: str) -> DataFrame:
    """What each record of the index says, read from its frame alone, which the bundle's seek table places. Frames are dealt to tasks by bytes; each is opened once."""
    types = arrow_schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        files, root = file_system(folder)
        zstd, held, frame, opened, source, frames = zstandard.ZstdDecompressor(), None, b"", None, None, []
        for batch in batches:
            rows = []
            for bundle, number, record_at, record_size in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bundle != opened:
                    opened, source = bundle, files.open_input_file(f"{root}/{bundle}")
                    frames = read_seek_table(source)
                if held != (bundle, number):
                    at, size = frames[number]
                    source.seek(at)
                    held, frame = (bundle, number), zstd.decompress(source.read(size))
                found = parse(frame[record_at : record_at + record_size])
                rows.append(tuple(found[x.name] for x in types))
            yield columns(rows, types)

    size = index.agg(F.sum("record_size")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-size // READ))
    at = ["bundle", "frame", "record_at", "record_size"]
    return index.select(*at).repartition(tasks, "bundle", "frame").sortWithinPartitions(*at).mapInArrow(run, RESULT)


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages to an archive in the shared folder and reads it back: page_id, payload_bytes, payload_digest, record_type and refers_to.

    One row for each row of pages, repeats included; an empty table gives no rows; other columns don't matter.
    """
    folder = new_folder(pages.sparkSession, "warc")
    return read_archive(write_archive(pages, folder, least_bytes), folder)
