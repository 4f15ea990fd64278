"""Files of any size as byte ranges: a data source whose partitions are ranges of files.

A range owns what begins in it and reads on to its end, so nothing is lost or read twice at a border, whatever the ranges:
- `bytes`: blocks of a fixed size; ranges begin at multiples of it
- `text`: lines, put together to pieces of about `piecebytes`, each of whole lines
- `mbox`: messages, each after a line that begins with `From `

A task holds one piece or message at a time. Small files share a partition. Files are opened by their URI through Arrow's file systems (local, HDFS, S3,
Google, ...), listed by them, or given as a table of path and size.

Edge cases: an empty file has no rows; a last line or message without a newline is one as well; text before an mbox's first `From `
belongs to none; a line or message longer than a range is one row, of the range in which it begins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as tx
from ..operators import extract
from . import mail
from .files import CHUNK, decode_utf8, printable
from .shared import cut

RANGE, PIECE, STEP, BATCH = 32 << 20, 4 << 20, 1 << 20, 4 << 20
SCHEMA = "file_path string, file_size long, range_no int, no long, at long, content binary"
_ARROW = pa.schema([("file_path", pa.string()), ("file_size", pa.int64()), ("range_no", pa.int32()), ("no", pa.int64()), ("at", pa.int64()), ("content", pa.binary())])


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")


@dataclass
class Piece(InputPartition):
    """Ranges of files that one task reads: (path, size, range number, start, end)."""

    ranges: list[tuple[str, int, int, int, int]]


def planned(sizes: list[tuple[str, int]], width: int) -> list[Piece]:
    """Ranges of about `width` bytes, those of small files packed together."""
    out, now, held = [], [], 0
    for path, size in sizes:
        for k in range(0, -(-size // width)):
            own = (path, size, k, k * width, min(size, (k + 1) * width))
            if now and held + own[4] - own[3] > width:
                out.append(Piece(now))
                now, held = [], 0
            now.append(own)
            held += own[4] - own[3]
    return [*out, Piece(now)] if now else out


def blocks_in(f, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    f.seek(start)
    for at in range(start, end, size):
        yield at, f.read(size)


def records_in(f, start: int, end: int, mark: bytes, begins: bytes = b"", least: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of each record that begins in [start, end), without the newline before the next: one begins after the newline of each `mark`, and
    at the file's start if that is as `begins` says. With `least`, as many of them together as have so many bytes, or as the range owns."""
    base, buf, looked = max(0, start - 1), bytearray(), 0
    f.seek(base)
    begun = None
    if start == 0:
        buf.extend(f.read(max(STEP, len(begins))))
        begun = 0 if buf and buf.startswith(begins) else None
    while True:
        if least and begun is not None:
            looked = max(looked, min(begun + least, end) - 1 - base)
        hit = buf.find(mark, looked)
        if hit >= 0:
            at = base + hit + 1
            if begun is not None:
                yield begun, bytes(buf[begun - base : hit])
            if at >= end:
                return
            del buf[: hit + 1]
            base, looked, begun = at, 0, at
            continue
        looked = max(looked, len(buf) - len(mark) + 1)
        if begun is None:  # nothing to keep but what may begin a mark
            if base + looked >= end:
                return
            gone = min(looked, len(buf))
            del buf[:gone]
            base, looked = base + gone, looked - gone
        new = f.read(STEP)
        if not new:
            break
        buf.extend(new)
    if begun is not None:
        yield begun, bytes(buf[begun - base :])


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.unit, self.width, self.block, self.piece = options["path"], options.get("unit", "bytes"), int(options.get("rangebytes", RANGE)), int(options.get("blockbytes", CHUNK)), int(options.get("piecebytes", PIECE))
        self.endings = tuple(x.strip().lower() for x in options.get("extensions", "").split(",") if x.strip())
        if self.unit not in ("bytes", "text", "mbox"):
            raise ValueError(f"no such unit: {self.unit}")
        if self.unit == "bytes":
            self.width = max(1, self.width // self.block) * self.block

    def partitions(self) -> list[Piece]:
        fs, path = opened(self.paths)
        lead = self.paths[: -len(path)] if self.paths.endswith(path) else ""
        info = fs.get_file_info(path)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        some = sorted((i.path, i.size) for i in found if i.is_file and not i.base_name.startswith(("_", ".")) and (not self.endings or i.path.lower().endswith(self.endings)))
        return planned([(lead + p, n) for p, n in some], self.width) or [Piece([])]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for path, size, number, start, end in partition.ranges:
            fs, inner = opened(path)
            with fs.open_input_file(inner) as f:
                if self.unit == "bytes":
                    rows = blocks_in(f, start, end, self.block)
                else:
                    rows = records_in(f, start, end, b"\n", least=self.piece) if self.unit == "text" else records_in(f, start, end, b"\nFrom ", b"From ")
                for no, (at, content) in enumerate(rows):
                    out.append((path, size, number, no, at, content))
                    held += len(content)
                    if held >= BATCH or len(out) >= 10_000:
                        yield self.batch(out)
                        out, held = [], 0
        if out:
            yield self.batch(out)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class EvidenceRanges(DataSource):
    """`spark.read.format("evidence_ranges").option("unit", "mbox").load(path)`, after `register`."""

    @classmethod
    def name(cls) -> str:
        return "evidence_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader({k.lower(): v for k, v in self.options.items()})


def ranges(spark: SparkSession, path: str, unit: str, **options) -> DataFrame:
    """file_path, file_size, range_no, no (within the range, from 0), at (byte), content."""
    spark.dataSource.register(EvidenceRanges)
    return spark.read.format("evidence_ranges").options(unit=unit, **{k: str(v) for k, v in options.items()}).load(path)


def _numbered(rows: DataFrame, size, name: str) -> DataFrame:
    """`rows` with `name`: the sum of `size` over the file's rows before. Windows hold a file's ranges, and a range's rows."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("__size", size)
    sums = own.groupBy("file_path", "range_no").agg(F.sum("__size").alias("__all"))
    sums = sums.withColumn("__start", F.coalesce(F.sum("__all").over(before(Window.partitionBy("file_path").orderBy("range_no"))), F.lit(0))).select(F.col("file_path").alias("__file"), F.col("range_no").alias("__range"), "__start")
    joined = own.join(sums, (F.col("file_path") == F.col("__file")) & (F.col("range_no") == F.col("__range")))
    within = F.coalesce(F.sum("__size").over(before(Window.partitionBy("file_path", "range_no").orderBy("no"))), F.lit(0))
    return joined.withColumn(name, F.col("__start") + within).drop("__size", "__file", "__range", "__start")


def mailboxes(spark: SparkSession, path: str, width: int = RANGE, extensions: str = ".mbox,.mbx") -> DataFrame:
    """The messages of .mbox and .mbx files of any size, as `mail.messages` gives them.

    A message's index counts those of the ranges before its own."""
    raw = ranges(spark, path, "mbox", rangebytes=width, extensions=extensions)
    parsed = cut(raw.mapInArrow(mail.parsed, f"archive string, range_no int, no long, {mail.FIELDS}"))
    counts = parsed.groupBy("archive", "range_no").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("archive").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("archive").alias("of"), F.col("range_no").alias("range_of"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start"))
    out = parsed.join(starts, (F.col("archive") == F.col("of")) & (F.col("range_no") == F.col("range_of")))
    fields = [f.split(" ", 1)[0].strip("`") for f in mail.FIELDS.split(", ")]
    return out.select("archive", (F.col("start") + F.col("no")).cast("int").alias("message_index"), *fields)


def texts(spark: SparkSession, path: str, width: int = RANGE, piece: int = PIECE, undo: bool = True, extensions: str = ".txt,.log,.csv,.json,.xml,.html") -> DataFrame:
    """case_name, file_name, ord, chunk_no, chunk_offset (code points before it), text of text files of any size, in pieces of whole lines: decoded, with universal newlines and, with `undo`, de-obfuscated."""
    # a piece ends before a newline: a carriage return there belongs to it
    body = tx.universal_newlines(F.regexp_replace(decode_utf8("content"), r"\r\z", ""))
    raw = ranges(spark, path, "text", rangebytes=width, piecebytes=piece, extensions=extensions)
    read = cut(raw.select("file_path", "range_no", "no", (tx.deobfuscate(body) if undo else body).alias("text")))
    placed = _numbered(read.select("file_path", "range_no", "no", F.length("text").alias("n")), F.col("n") + 1, "chunk_offset")
    placed = placed.select(F.col("file_path").alias("__f"), F.col("range_no").alias("__r"), F.col("no").alias("__n"), "chunk_offset")
    joined = read.join(placed, (F.col("file_path") == F.col("__f")) & (F.col("range_no") == F.col("__r")) & (F.col("no") == F.col("__n")))
    case = F.element_at(F.split("file_path", "/"), -2)
    return joined.select(case.alias("case_name"), F.element_at(F.split("file_path", "/"), -1).alias("file_name"), F.col("file_path").alias("ord"), F.col("range_no").alias("chunk_no"), "chunk_offset", "text")


def findings(spark: SparkSession, path: str, categories: list[str] | None = None, **how) -> DataFrame:
    """The findings of text files of any size: positions count from each file's start. A value that goes over the border of two pieces (of lines) isn't found."""
    found = extract.accepted(extract.matches(texts(spark, path, **how), categories))
    placed = found.withColumn("position", (F.col("position") + F.col("chunk_offset")).cast("long"))
    merged = extract.merged(extract.in_file(placed, "case_name", "file_name", "ord"))
    if categories is None or "Email_Addresses" in categories:
        merged = extract.drop_part_emails(cut(merged))
    return extract.described(merged)


def binary_chunks(spark: SparkSession, path: str, width: int = RANGE, size: int = CHUNK) -> DataFrame:
    """case_name, file_name (`name_chunk_n`, from 1), ord, chunk_no, text of files of any size in chunks, as `files.binary_chunks` gives them."""
    raw = ranges(spark, path, "bytes", rangebytes=width, blockbytes=size)
    name, number = F.element_at(F.split("file_path", "/"), -1), F.col("at") / size + 1
    case = F.element_at(F.split("file_path", "/"), -2)
    rows = raw.select(case.alias("case_name"), F.concat(name, F.lit("_chunk_"), number.cast("long")).alias("file_name"), F.col("file_path").alias("ord"), number.cast("int").alias("chunk_no"), printable("content").alias("text"))
    return rows.where(F.trim("text") != "")
