"""WARC archives as seekable Zstandard bundles.

Pages become WARC records, grouped into frames of about `frame` bytes that each decompress alone; a bundle is such
frames and a footer, a skippable frame with the seek table (sizes of every frame, compressed and not) in the seekable
format. The index maps a record to its bundle, its frame and its offset within the frame, so one record costs one frame.

Of pages with equal payloads of `least` bytes or more, that with the smallest page_id is a response and the others
are revisits, which carry the payload's digest and length but no payload. Equality is that of the SHA-256, found with one
aggregation by digest, over digests and ids alone, and joined back to pages by id and digest.

Bundles are files under a folder that all executors reach; a file gets its name when whole. Rows are ordered within their
partition, so a task that is repeated after a lost executor writes the same files again. `fetch` reads records back through the
index: each task opens the bundles that its records lie in, reads their seek tables and decompresses the frames it needs. A revisit's
payload is looked up by the index as well, in the bundle of the response that it refers to. `read` reads whole bundles in turn.

Edge cases: null html is empty, null urls are empty; very long html is one record in a frame of its own; page ids may be of any type;
rows that repeat a page_id are a record each, and those with the smallest id of their payload are all responses; a null page_id
sorts after the others; an empty table gives no bundle and no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces, shared_dir

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2020-01-01T00:00:00Z"


def first_of_payload(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, html (empty for null), digest, bytes, refers_to (null for responses)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    slim = p.where(F.col("bytes") >= least).select("page_id", "digest")
    # written first, so that adaptive execution can split a payload that very many pages share
    first = cut(slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    again = slim.join(first, "digest").where("page_id <> first").select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), F.col("first").alias("refers_to")).distinct()
    return p.join(again, (F.col("page_id") == F.col("__id")) & (F.col("digest") == F.col("__digest")), "left").drop("__id", "__digest")


def record(page_id: str | None, url: str, html: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record."""
    name = lambda x: f"<urn:page:{'' if x is None else '/' + quote(x, safe='')}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(html)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (html if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_of(name: str | None) -> str | None:
    """The page id that a record id stands for."""
    return unquote(name[len("<urn:page:/") : -1]) if name and name != "<urn:page:>" else None


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the record that starts at `at`."""
    stop = raw.index(b"\r\n\r\n", at)
    head = dict(x.split(": ", 1) for x in raw[at:stop].decode().split("\r\n")[1:])
    n = int(head["Content-Length"])
    block = raw[stop + 4 : stop + 4 + n]
    return head, block.split(b"\r\n\r\n", 1)[1], stop + 8 + n


class Bundle:
    """Collects records into frames; `close` gives the bytes, with the seek table."""

    def __init__(self, frame: int = 1 << 18, level: int = 3):
        self.frame, self.packer = frame, zstandard.ZstdCompressor(level=level)
        self.open, self.held, self.frames, self.table, self.size = [], 0, [], [], 0

    def add(self, rec: bytes) -> tuple[int, int]:
        """The record's frame and offset in it."""
        if self.held and self.held + len(rec) > self.frame:
            self._end()
        at = (len(self.frames), self.held)
        self.open.append(rec)
        self.held += len(rec)
        return at

    def _end(self) -> None:
        packed = self.packer.compress(b"".join(self.open))
        self.frames.append(packed)
        self.table.append((len(packed), self.held))
        self.size += len(packed)
        self.open, self.held = [], 0

    def close(self) -> bytes:
        if self.held:
            self._end()
        body = b"".join(struct.pack("<II", *t) for t in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(body)) + body


def seek_table(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of every frame, from the footer: the bundle's end, or all of it."""
    n, flags, magic = struct.unpack("<IBI", raw[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    first, out, at = len(raw) - 9 - n * width, [], 0
    for k in range(n):
        packed, size = struct.unpack_from("<II", raw, first + k * width)
        out.append((at, packed, size))
        at += packed
    return out


def read_record(raw: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its place; decompresses its frame alone."""
    start, packed, size = seek_table(raw)[frame]
    return parse(zstandard.ZstdDecompressor().decompress(raw[start : start + packed], max_output_size=size), offset)[:2]


class Bundles:
    """Reads records by bundle, frame and offset; keeps the last few frames."""

    def __init__(self, uri: str, most: int = 16):
        self.fs, self.root = pafs.FileSystem.from_uri(uri)
        self.most, self.tables, self.frames, self.name, self.file = most, {}, OrderedDict(), None, None

    def _open(self, bundle: str):
        if self.name != bundle:
            if self.file:
                self.file.close()
            self.name, self.file = bundle, self.fs.open_input_file(f"{self.root}/{bundle}")
        return self.file

    def frame(self, bundle: str, number: int) -> bytes:
        key = (bundle, number)
        if key not in self.frames:
            f = self._open(bundle)
            if bundle not in self.tables:
                size = f.size()
                n = struct.unpack("<IBI", f.read_at(9, size - 9))[0]
                self.tables[bundle] = seek_table(f.read_at(9 + 12 * n if size > 9 + 12 * n else size, max(0, size - 9 - 12 * n)))
            start, packed, size = self.tables[bundle][number]
            self.frames[key] = zstandard.ZstdDecompressor().decompress(f.read_at(packed, start), max_output_size=size)
            while len(self.frames) > self.most:
                self.frames.popitem(last=False)
        self.frames.move_to_end(key)
        return self.frames[key]

    def record(self, bundle: str, number: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(bundle, number), offset)[:2]


def write(pages: DataFrame, uri: str, least: int = 100, bundle: int = 16 << 20, frame: int = 1 << 18) -> DataFrame:
    """Writes the archives under `uri`; the index: page_id (as text), digest, refers_to, bundle (file name), frame, offset of every record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        part, number, now, rows = TaskContext.get().partitionId(), 0, Bundle(frame), []

        def end() -> pa.RecordBatch:
            name = f"bundle-{part:05d}-{number:05d}.warc.zst"
            half = f"{root}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(half) as f:
                f.write(now.close())
            fs.move(half, f"{root}/{name}")
            ids, digests, refers, frames, offsets = zip(*rows, strict=True)
            return pa.record_batch([pa.array(ids, pa.string()), pa.array(digests, pa.string()), pa.array(refers, pa.string()), pa.array([name] * len(ids), pa.string()), pa.array(frames, pa.int32()), pa.array(offsets, pa.int32())], names=["page_id", "digest", "refers_to", "bundle", "frame", "offset"])

        for b in pieces(batches, "html"):
            cols = [b.column(k) for k in range(5)]
            for page_id, url, html, digest, refers_to in zip(cols[0].to_pylist(), cols[1].to_pylist(), cols[2].cast(pa.large_binary()).to_pylist(), cols[3].to_pylist(), cols[4].to_pylist(), strict=True):
                rows.append((page_id, digest, refers_to, *now.add(record(page_id, url, html, digest, refers_to))))
                if now.size + now.held >= bundle:
                    yield end()
                    number, now, rows = number + 1, Bundle(frame), []
        if rows:
            yield end()

    found = first_of_payload(pages, least).select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", F.col("refers_to").cast("string").alias("refers_to"))
    # a repeated task meets its rows in the same order, so it writes the same bundles again and leaves none behind
    return found.sortWithinPartitions("page_id", "digest", "url").mapInArrow(run, "page_id string, digest string, refers_to string, bundle string, frame int, offset int")


RECORD = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary, bundle string, frame int, offset int"
COLUMNS = [c.split()[0] for c in RECORD.split(", ")]


def _row(head: dict[str, str], payload: bytes, size: int, digest: str, bundle: str, frame: int, offset: int) -> tuple:
    url = head["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    kind = head["WARC-Type"]
    return page_of(head["WARC-Record-ID"]), url, kind, page_of(head.get("WARC-Refers-To")), size, digest, payload if kind == "response" else None, bundle, frame, offset


def _stated(head: dict[str, str]) -> tuple[int, str]:
    return int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:")


def read(spark, uri: str) -> DataFrame:
    """The records of RECORD in the archives under `uri` (payload null for revisits), bundle by bundle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, raw in zip(b["path"], b["content"], strict=True):
                for k, (start, packed, size) in enumerate(seek_table(raw)):
                    text, at, out = zstandard.ZstdDecompressor().decompress(raw[start : start + packed], max_output_size=size), 0, []
                    while at < len(text):
                        head, payload, end = parse(text, at)
                        if head["WARC-Type"] == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != _stated(head):
                            raise ValueError(f"damaged record in {path}")
                        out.append(_row(head, payload, *_stated(head), path.rsplit("/", 1)[-1], k, at))
                        at = end
                    yield pd.DataFrame(out, columns=COLUMNS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").schema("path string, modificationTime timestamp, length long, content binary").load(uri)
    return files.select("path", "content").mapInPandas(run, RECORD)


def located(index: DataFrame) -> DataFrame:
    """The index with of_bundle, of_frame, of_offset: where the payload lies, which for a revisit is with its response."""
    own = index.where("refers_to is null").groupBy(F.col("page_id").alias("of"), F.col("digest").alias("of_digest")).agg(F.min(F.struct("bundle", "frame", "offset")).alias("at"))
    at = cut(own.where(F.col("of").isNotNull()))
    joined = index.join(at, (F.col("refers_to") == F.col("of")) & (F.col("digest") == F.col("of_digest")), "left")
    place = lambda c: F.coalesce(F.col(f"at.{c}"), F.col(c)).alias(f"of_{c}")
    return joined.select(*index.columns, *map(place, ("bundle", "frame", "offset")))


def fetch(index: DataFrame, uri: str, most_known: int = 50_000) -> DataFrame:
    """The records of RECORD that the index names, each read at its place; payload_bytes and payload_digest are of the payload as found, for a revisit where its response lies.

    Records are dealt out by bundle and read in order of their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, others, known = Bundles(uri), Bundles(uri), {}
        for b in batches:
            out = []
            for bundle, frame, offset, *of in zip(*(c.to_pylist() for c in b.columns), strict=True):
                head, payload = mine.record(bundle, frame, offset)
                of = tuple(of)
                if of not in known:
                    whole = payload if of == (bundle, frame, offset) else others.record(*of)[1]
                    known = known if len(known) < most_known else {}
                    known[of] = len(whole), hashlib.sha256(whole).hexdigest()
                if known[of] != _stated(head):
                    raise ValueError(f"damaged record in {bundle}")
                out.append(_row(head, payload, *known[of], bundle, frame, offset))
            if out:
                kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int32(), pa.int32())
                yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=COLUMNS)

    rows = located(index).select("bundle", "frame", "offset", "of_bundle", "of_frame", "of_offset")
    return rows.repartition("bundle").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(run, RECORD)


def archived(pages: DataFrame, uri: str | None = None, least: int = 100) -> DataFrame:
    """Writes the archives, then reads every record back through the index; `uri` is by default a new folder in the shared one."""
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    root = uri or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    root = root if "://" in root or root.startswith("file:") else f"file://{root}"
    got = fetch(cut(write(pages, root, least)), root)
    return got.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
