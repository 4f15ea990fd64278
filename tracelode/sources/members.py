"""Archives by their members, of any number and depth: what an archive holds is listed first, and members are read one by one where they lie.

The first pass reads directories alone: path, place, packed size and method of each member, no content. Members are then dealt out by
the stretch of their archive in which they lie, so that one archive of very many members is work for all cores, and each task reads on. Members that
are archives themselves are unpacked to files of the shared folder and gone through in the same way, level after level, until there are none: no archive
is held in memory, at any depth. An archive that is its own ancestor (by digest) is a row with an error, so this ends.

zip and tar have members that can be read by place. Files of gz and compressed tars are streams: one task each, unpacked member by member.

Edge cases: a damaged, encrypted or unknown archive, a damaged member (its checksum is tested) and one of more than `most_bytes` are rows with an error, and
the rest is read; members whose path leads outside are left out; folders are no members; an empty archive has no rows. Two members of
one path are two rows."""

from __future__ import annotations

import bz2
import gzip
import hashlib
import io
import lzma
import os
import struct
import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .files import ARCHIVES, _parts, _safe, _split_name
from .ranges import opened
from .shared import cut, shared_dir

MOST, STRETCH, BATCH_ROWS, BATCH = 500 << 20, 256 << 10, 2000, 8 << 20
#: source: where the archive's bytes are; outer: how it is called; trail: digests of the archives around it.
_ARCHIVE = "case_name string, source string, outer string, mtime timestamp, ord string, depth int, trail array<string>"
_MEMBER = "case_name string, source string, outer string, mtime timestamp, ord string, depth int, trail array<string>, member string, at long, packed long, size long, method int, crc long, error string"
_STREAMED, _STORED, _DEFLATED, _BZIP2, _LZMA = -1, 0, 8, 12, 14


def kind_of(name: str) -> str | None:
    low = name.lower()
    return "zip" if low.endswith(".zip") else "stream" if low.endswith((".tar.gz", ".tgz", ".gz")) else "tar" if low.endswith(".tar") else None


def listed(f, name: str) -> Iterator[tuple]:
    """member, at, packed, size, method, crc of what an archive holds; only directories and headers are read."""
    kind = kind_of(name)
    if kind == "zip":
        # small ones whole: the search for the directory goes before the beginning, which not every store's file takes
        with zipfile.ZipFile(io.BytesIO(f.read()) if f.size() < 1 << 20 else f) as z:
            infos = z.infolist()
        if any(i.flag_bits & 1 for i in infos):
            raise ValueError("encrypted")
        for i in infos:
            if not i.is_dir() and _safe(i.filename):
                yield i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC
    elif kind == "tar":
        with tarfile.open(fileobj=f, mode="r:") as t:
            for m in t:
                if m.isfile() and _safe(m.name):
                    yield m.name, m.offset_data, m.size, m.size, _STORED, None
    elif kind == "stream":
        f.read(1)  # that it can be read
        yield name.rsplit("/", 1)[-1].rsplit("::", 1)[-1], 0, f.size(), 0, _STREAMED, None
    else:
        raise ValueError("no reader for this kind of archive")


def unpacked(f, zipped: bool, at: int, packed: int, size: int, method: int, crc: int | None, most: int) -> bytes:
    """The content of one member; an error for what is too large or damaged."""
    if size > most:
        raise ValueError("member too large")
    f.seek(at)
    if zipped:  # the header before the content says how long it is itself
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no member at its place")
        f.seek(at + 30 + sum(struct.unpack("<HH", head[26:30])))
    raw = f.read(packed)
    if method == _STORED:
        data = raw
    elif method == _DEFLATED:
        d = zlib.decompressobj(-15)
        data = d.decompress(raw, most + 1)
    elif method == _BZIP2:
        data = bz2.BZ2Decompressor().decompress(raw, most + 1)
    elif method == _LZMA:
        props = struct.unpack("<H", raw[2:4])[0]
        chain = [lzma._decode_filter_properties(lzma.FILTER_LZMA1, raw[4 : 4 + props])]
        data = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=chain).decompress(raw[4 + props :], most + 1)
    else:
        raise ValueError(f"compression method {method}")
    if len(data) > most:
        raise ValueError("member too large")
    if len(data) != size or crc is not None and zlib.crc32(data) != crc:
        raise ValueError("damaged member")
    return data


def streamed(f, name: str, most: int) -> Iterator[tuple[str, bytes | None, str | None]]:
    """member, content and error of a compressed tar's members, or of the one that a .gz holds."""
    if name.lower().endswith((".tar.gz", ".tgz")):
        with tarfile.open(fileobj=f, mode="r|gz") as t:
            for m in t:
                if m.isfile() and _safe(m.name):
                    yield (m.name, None, "member too large") if m.size > most else (m.name, t.extractfile(m).read(), None)
    else:
        with gzip.open(f) as g:
            data = g.read(most + 1)
        own = name.rsplit("/", 1)[-1].rsplit("::", 1)[-1][:-3]
        yield (own, None, "member too large") if len(data) > most else (own, data, None)


def _list_all(archives: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in batches:
            schema = pa.schema([*b.schema, ("member", pa.string()), ("at", pa.int64()), ("packed", pa.int64()), ("size", pa.int64()), ("method", pa.int32()), ("crc", pa.int64()), ("error", pa.string())])
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                source, outer = one.column("source")[0].as_py(), one.column("outer")[0].as_py()
                out: list[tuple] = []

                def put(out: list[tuple], one: pa.RecordBatch = one, schema: pa.Schema = schema) -> pa.RecordBatch:
                    own = [pa.concat_arrays([c] * len(out)) if len(out) != 1 else c for c in one.columns]
                    return pa.RecordBatch.from_arrays([*own, *(pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(schema)[len(own) :], strict=True))], schema=schema)

                try:
                    fs, path = opened(source)
                    with fs.open_input_file(path) as f:
                        for row in listed(f, outer):
                            out.append((*row, None))
                            if len(out) >= BATCH_ROWS:
                                yield put(out)
                                out = []
                except Exception as e:  # a damaged archive is a result, not a failure
                    out.append((None, 0, 0, 0, 0, None, str(e)[:200] or type(e).__name__))
                if out:
                    yield put(out)

    return archives.mapInArrow(run, _MEMBER)


def _read(members: DataFrame, most: int, into: str) -> DataFrame:
    """The members' contents, as `members` has them plus inner (path), content, digest; nested archives are written below `into` instead, and have their file in `source`."""
    names = ["case_name", "file_path", "mtime", "ord", "depth", "trail", "content", "error", "nested"]
    kinds = [pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.string(), pa.int32(), pa.list_(pa.string()), pa.binary(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f, out, held = None, None, [], 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        def contents(r: dict) -> Iterator[tuple[str, bytes | None, str | None]]:
            nonlocal now, f
            if r["error"] is not None:
                yield "", None, r["error"]
                return
            try:
                if now != r["source"]:
                    fs, path = opened(r["source"])
                    now, f = r["source"], fs.open_input_file(path)
                if r["method"] == _STREAMED:
                    f.seek(0)
                    yield from streamed(f, r["outer"], most)
                else:
                    yield r["member"], unpacked(f, kind_of(r["outer"]) == "zip", r["at"], r["packed"], r["size"], r["method"], r["crc"], most), None
            except Exception as e:
                yield ("" if r["method"] == _STREAMED else r["member"]), None, str(e)[:200] or type(e).__name__

        for b in batches:
            for r in b.to_pylist():
                for member, data, error in contents(r):
                    inner = f"{r['outer']}::{member}" if member else r["outer"]
                    depth, nested, trail = r["depth"] + bool(member), None, []
                    if data is not None and os.path.splitext(member)[1].lower() in ARCHIVES:
                        digest = hashlib.sha256(data).hexdigest()
                        if digest in (r["trail"] or []):
                            error, data = "archive within itself", None
                        else:
                            # named by its path, so that a repeated task writes the same file
                            nested, trail = f"{into}/{hashlib.sha256(inner.encode()).hexdigest()}{r['at']}", [*(r["trail"] or []), digest]
                            fs, path = opened(nested)
                            fs.create_dir(path.rsplit("/", 1)[0])
                            with fs.open_output_stream(path) as g:
                                g.write(data)
                            data = None
                    out.append((r["case_name"], inner, r["mtime"], r["ord"], depth, trail, data, error, nested))
                    held += len(data or b"")
                    if len(out) >= BATCH_ROWS or held >= BATCH:
                        yield batch()
                        out, held = [], 0
        if out:
            yield batch()

    return members.mapInArrow(run, "case_name string, file_path string, mtime timestamp, ord string, depth int, trail array<string>, content binary, error string, nested string")


def _dealt(members: DataFrame, stretch: int) -> DataFrame:
    """Members by the stretch of their archive in which they lie, in order: of one archive with very many there are many stretches, and a large member has one of its own."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.coalesce("at", F.lit(0)) / stretch)
    return members.withColumn("part", part).repartition(n, "source", "part").sortWithinPartitions("source", "at").drop("part")


def members(files: DataFrame, most_bytes: int = MOST, stretch: int = STRETCH) -> DataFrame:
    """What the archives among `files` (case_name, file_path, ext, mtime, ord) hold, nested ones opened in turn: case_name, file_path (`outer.zip::inner`), file_name, ext, size, mtime, content, ord, depth, error, file_class.

    Files are read where they lie; `files` needs no content."""
    spark = files.sparkSession
    into = f"{shared_dir(spark).rstrip('/')}/nested-{uuid.uuid4().hex}"
    level = files.where(F.col("ext").isin(*ARCHIVES)).select("case_name", F.col("file_path").alias("source"), F.col("file_path").alias("outer"), F.col("mtime").cast("timestamp").alias("mtime"), F.col("ord").cast("string").alias("ord"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("trail"))
    out = None
    while True:
        got = cut(_read(_dealt(_list_all(level), stretch), most_bytes, into))
        own = got.where("nested is null")
        out = own if out is None else out.unionAll(own)
        deeper = got.where("nested is not null")
        if deeper.isEmpty():
            break
        level = deeper.select("case_name", F.col("nested").alias("source"), F.col("file_path").alias("outer"), "mtime", "ord", "depth", "trail")
    name, ext = _names(F.col("file_path"))
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    return out.select("case_name", "file_path", name.alias("file_name"), ext.alias("ext"), size.alias("size"), "mtime", "content", "ord", "depth", "error", tx.file_class(ext).alias("file_class"))


def everything(files: DataFrame, most_bytes: int = MOST) -> DataFrame:
    """case_name, file_name, ord, chunk_no, text of what archives hold, by class: as `files.everything`, but member by member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["case_name", "file_name", "ord", "chunk_no", "text", "plain"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_()]
        for b in batches:
            out, held = [], 0
            for r in b.to_pylist():
                for n, k, t, p in _parts(*_split_name(r["file_path"]), r["content"]):
                    out.append((r["case_name"], n, r["ord"], k, t, p))
                    held += len(t)
                    if held >= BATCH:
                        yield pa.record_batch([pa.array(c, a) for c, a in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                        out, held = [], 0
            if out:
                yield pa.record_batch([pa.array(c, a) for c, a in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    some = members(files, most_bytes).where("error is null").select("case_name", "file_path", "ord", "content")
    got = some.mapInArrow(run, "case_name string, file_name string, ord string, chunk_no int, text string, plain boolean")
    return got.select("case_name", "file_name", "ord", "chunk_no", F.when(F.col("plain"), tx.deobfuscate("text")).otherwise(F.col("text")).alias("text"))


def _names(path):
    """File name and lower-case ending of a member's path."""
    name = F.regexp_extract(F.regexp_extract(path, r"(?s)(?:.*::)?(.*)\z", 1), r"([^/]*)$", 1)
    return name, F.lower(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1))
