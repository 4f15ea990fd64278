"""Evidence files as tables: listing, decoding, archives, binary chunks, findings that were stored.

Files are read with Spark's binaryFile source, so any store that Spark reads will do; what Python must decode is decoded
file by file within tasks."""

from __future__ import annotations

import functools
import gzip
import hashlib
import io
import os
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, text as tx

FILE = "case_name string, file_path string, file_name string, ext string, file_class string, size long, mtime timestamp, content binary, ord string"
CHUNK = 8192
ARCHIVES = fixed.EXTENSIONS["archives"]


def _named(path: Column) -> tuple[Column, Column]:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return name, F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def list_files(spark: SparkSession, root: str, case_name: str | None = None) -> DataFrame:
    """Every file under a folder. The case is the given one or the first folder below the root; `ord`, by which a case's files are
    ordered, is the path itself: nothing is ranked, and no content is shuffled."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    base = "/" + root.removeprefix("file:").strip("/") if "://" not in root or root.startswith("file:") else root.rstrip("/")
    rest = F.substring(path, F.lit(len(base) + 2), F.length(path))
    case = F.lit(case_name) if case_name else F.when(F.contains(rest, F.lit("/")), F.split_part(rest, F.lit("/"), F.lit(1))).otherwise(F.lit(os.path.basename(base)))
    name, ext = _named(path)
    return raw.select(case.alias("case_name"), path.alias("file_path"), name.alias("file_name"), ext.alias("ext"), tx.file_class(ext).alias("file_class"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content", path.alias("ord"))


def valid_inputs(files: DataFrame) -> DataFrame:
    """Number and bytes of the files that exist."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def pending_cases(listing: DataFrame, done: DataFrame) -> DataFrame:
    """Folders and archives of a batch that have no report yet. `listing`: name, is_dir; `done`: case_name."""
    archive = F.lower("name").rlike(r"\.(zip|rar|7z|tar|gz|7z\.tmp)$")
    case = F.when(F.col("is_dir"), F.col("name")).otherwise(F.regexp_replace("name", r"(?i)(\.7z\.tmp|\.[^.]*)$", ""))
    return listing.where(F.col("is_dir") | archive).select(case.alias("case_name"), "name").join(done.select("case_name"), "case_name", "left_anti")


@F.pandas_udf(T.StringType())
def decode_utf8(content: pd.Series) -> pd.Series:
    """Bytes as UTF-8, bad bytes dropped."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def texts(files: DataFrame, undo: bool = True) -> DataFrame:
    """case_name, file_name, ord, text of text and mail files: decoded, with universal newlines and, with `undo`, de-obfuscated."""
    body = tx.universal_newlines(decode_utf8("content"))
    readable = (F.col("file_class") == "text") | F.col("ext").isin(".eml", ".mbox")
    return files.where(readable).select("case_name", "file_name", "ord", (tx.deobfuscate(body) if undo else body).alias("text"))


def _printable(raw: bytes) -> str:
    return "".join(c for c in raw.decode("utf-8", "ignore") if c.isprintable() or c.isspace())


@F.pandas_udf(T.StringType())
def printable(content: pd.Series) -> pd.Series:
    """Bytes as UTF-8 without bad bytes and without what is neither printable nor white space."""
    return content.map(lambda b: _printable(bytes(b or b"")))


def binary_chunks(files: DataFrame, size: int = CHUNK) -> DataFrame:
    """case_name, file_name (`name_chunk_n`, from 1), ord, chunk_no, text of each chunk of a file's bytes that holds more than white space.

    Values that span chunks are lost, and positions count from each chunk's start."""
    n = F.octet_length("content")
    each = files.where(n > 0).select("case_name", F.col("file_name").alias("own"), "ord", "content", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).alias("k"))
    cut = each.select("case_name", "own", "ord", "k", F.substring("content", F.col("k") * size + 1, F.lit(size)).alias("part"))
    return cut.select("case_name", F.concat("own", F.lit("_chunk_"), F.col("k") + 1).alias("file_name"), "ord", (F.col("k") + 1).alias("chunk_no"), printable("part").alias("text")).where(F.trim("text") != "")


def text_chunks(rows: DataFrame, size: int = 50 << 20, overlap: int = 1000) -> DataFrame:
    """Windows of long texts: chunk_no, chunk_offset and the text of each, overlapping. An option: results don't need it."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length("text") - overlap) / step), F.lit(1)).cast("int")
    each = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), n - 1)))
    return each.withColumn("chunk_offset", F.col("chunk_no") * step).withColumn("text", F.substring("text", F.col("chunk_offset") + 1, F.lit(size)))


def _safe(name: str) -> bool:
    """Whether a member's path stays inside its archive."""
    return bool(name) and not name.startswith("/") and "\x00" not in name and ".." not in name.split("/")


def _members(name: str, raw: bytes, most: int) -> Iterator[tuple[str, bytes | None]]:
    """The members of one archive; None for one of more than `most` bytes, of which no more is read."""
    low = name.lower()
    if low.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            if any(i.flag_bits & 1 for i in z.infolist()):
                raise ValueError("encrypted")
            for i in z.infolist():
                if not i.is_dir() and _safe(i.filename):
                    with z.open(i) as f:
                        data = f.read(most + 1) if i.file_size <= most else None
                    yield i.filename, None if data is None or len(data) > most else data
    elif low.endswith((".tar", ".tar.gz", ".tgz")):
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            yield from ((m.name, t.extractfile(m).read() if m.size <= most else None) for m in t if m.isfile() and _safe(m.name))
    elif low.endswith(".gz"):
        with gzip.open(io.BytesIO(raw)) as f:
            data = f.read(most + 1)
        yield os.path.basename(name)[:-3], None if len(data) > most else data
    else:
        raise ValueError("no reader for this kind of archive")


def _opened(path: str, raw: bytes, deepest: int | None, most: int, depth: int = 0, around: tuple[bytes, ...] = ()) -> Iterator[tuple[str, bytes | None, int, str | None]]:
    """(path, content, depth, error) of what an archive holds that is no archive, nested ones opened as they are met: no more than an archive of each depth is held.

    What can't be opened, is too large or is an archive within itself (by digest, `around` it) is a row with an error; the archive's other members follow."""
    try:
        if deepest is not None and depth >= deepest:
            raise ValueError("nested too deep")
        own = (*around, hashlib.sha256(raw).digest())
        for member, data in _members(path, raw, most):
            inner = f"{path}::{member}"
            if data is None:
                yield inner, None, depth + 1, "member too large"
            elif os.path.splitext(member)[1].lower() not in ARCHIVES:
                yield inner, data, depth + 1, None
            elif hashlib.sha256(data).digest() in own:
                yield inner, None, depth + 1, "archive within itself"
            else:
                yield from _opened(inner, data, deepest, most, depth + 1, own)
    except Exception as e:  # a damaged archive is a result, not a failure
        yield path, None, depth, str(e)[:200] or type(e).__name__


#: Rows leave a task in batches of so many, or of about so many bytes.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def _batched(rows: Iterator[tuple], width: int, names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as tables of a bounded size; the field `width` is what makes a row large."""
    out, held = [], 0
    for r in rows:
        out.append(r)
        held += len(r[width] or b"")
        if len(out) >= BATCH_ROWS or held >= BATCH_BYTES:
            yield pd.DataFrame(out, columns=names)
            out, held = [], 0
    if out:
        yield pd.DataFrame(out, columns=names)


def _split_name(path: str) -> tuple[str, str]:
    name = os.path.basename(path.rsplit("::", 1)[-1])
    return name, os.path.splitext(name)[1].lower()


def unpack(files: DataFrame, deepest: int | None = None, most_bytes: int = 500 << 20) -> DataFrame:
    """The members of archives, nested ones opened in turn: the columns of `files`, depth and error.

    A row per member that is no archive, its path `outer.zip::inner/path` at every level; a row with an error for what
    can't be opened. `most_bytes` bounds a member: no more than that is read of it, and its archive's other members are read none the less. An archive is
    one task here, and a row with its content; `members.members` reads large ones where they lie."""
    names = ["case_name", "file_path", "file_name", "ext", "size", "mtime", "content", "ord", "depth", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held = ((r.case_name, path, *_split_name(path), len(data or b""), r.mtime, data, r.ord, depth, error) for r in b.itertuples() for path, data, depth, error in _opened(r.file_path, bytes(r.content), deepest, most_bytes))
            yield from _batched(held, 6, names)

    some = files.where(F.col("ext").isin(*ARCHIVES)).select("case_name", "file_path", "mtime", "content", "ord")
    kind = files.schema["ord"].dataType.simpleString()
    got = some.mapInPandas(run, f"case_name string, file_path string, file_name string, ext string, size long, mtime timestamp, content binary, ord {kind}, depth int, error string")
    return got.withColumn("file_class", tx.file_class("ext"))


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _word_text(raw: bytes) -> str:
    """The paragraphs of a word-processing document's body, a line each."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    said = {f"{_WORD}t": lambda e: e.text or "", f"{_WORD}tab": lambda e: "\t", f"{_WORD}br": lambda e: "\n"}
    return "\n".join("".join(said[e.tag](e) for r in p.iter(f"{_WORD}r") for e in r if e.tag in said) for p in body.findall(f"{_WORD}p"))


def _sheet_text(raw: bytes) -> str:
    """The sheets of a workbook, each as a table under its name."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
            path, rows = targets[sheet.get(f"{_REL}id")].lstrip("/"), []
            for row in ElementTree.fromstring(z.read(path if path.startswith("xl/") else f"xl/{path}")).iter(f"{_SHEET}row"):
                cells: dict[int, object] = {}
                for c in row.iter(f"{_SHEET}c"):
                    col = functools.reduce(lambda n, x: n * 26 + ord(x) - 64, "".join(x for x in c.get("r", "A") if x.isalpha()), 0) - 1
                    value, kind = c.findtext(f"{_SHEET}v"), c.get("t", "n")
                    cells[col] = shared[int(value)] if kind == "s" and value else "".join(t.text or "" for t in c.iter(f"{_SHEET}t")) if kind == "inlineStr" else value if kind in ("str", "e") or value is None else value == "1" if kind == "b" else float(value) if "." in value or "E" in value else int(value)
                rows.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
            width = max(map(len, rows), default=0)
            rows = [r + [None] * (width - len(r)) for r in rows]
            head = [f"Unnamed: {k}" if v is None else v for k, v in enumerate(rows[0])] if rows else []
            out.append(f"Sheet: {sheet.get('name')}\n{pd.DataFrame(rows[1:], columns=head).to_string()}\n\n")
    return "".join(out)


def _document_text(ext: str, raw: bytes) -> str:
    """The text of a document; word-processing files and workbooks are read as the zipped XML that they are, pdf files with pypdf where it is installed."""
    if ext == ".pdf":
        import pypdf

        return "\n".join(p.extract_text() for p in pypdf.PdfReader(io.BytesIO(raw)).pages)
    if ext == ".docx":
        return _word_text(raw)
    if ext == ".xlsx":
        return _sheet_text(raw)
    raise ValueError("read as binary")


def documents(files: DataFrame) -> DataFrame:
    """case_name, file_name, ord, text, error of pdf, docx and xlsx files; null text and the reason for what can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                try:
                    out.append((r.case_name, r.file_name, r.ord, _document_text(r.ext, bytes(r.content)), None))
                except Exception as e:
                    out.append((r.case_name, r.file_name, r.ord, None, str(e)[:200]))
            yield pd.DataFrame(out, columns=["case_name", "file_name", "ord", "text", "error"])

    kind = files.schema["ord"].dataType.simpleString()
    return files.where("file_class = 'documents'").select("case_name", "file_name", "ext", "ord", "content").mapInPandas(run, f"case_name string, file_name string, ord {kind}, text string, error string")


def image_properties(files: DataFrame) -> DataFrame:
    """case_name, file, category, value of images, with Pillow where it is installed: time, device, software, size, format, coordinates."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            from PIL import Image
        except ImportError:
            Image = None
        for b in batches:
            out = []
            for r in b.itertuples() if Image else ():
                try:
                    with Image.open(io.BytesIO(bytes(r.content))) as im:
                        exif = im.getexif()
                        gps = exif.get_ifd(0x8825)
                        values = {"Image_Format": im.format, "Image_Resolution": f"{im.width}x{im.height}", "Timestamps": exif.get(306), "Device_Info": " ".join(str(exif[k]) for k in (271, 272) if k in exif), "Software_Info": exif.get(305)}
                        if 2 in gps and 4 in gps:
                            num = lambda v, ref: sum(float(x) / 60**k for k, x in enumerate(v)) * (1 if ref in "NE" else -1)
                            values["GPS_Coordinates"] = f"{num(gps[2], gps.get(1, 'N'))},{num(gps[4], gps.get(3, 'E'))}"
                        out += [(r.case_name, r.file_name, c, str(v)) for c, v in values.items() if v]
                except Exception:
                    continue
            yield pd.DataFrame(out, columns=["case_name", "file", "category", "value"])

    return files.where("file_class = 'images'").select("case_name", "file_name", "content").mapInPandas(run, "case_name string, file string, category string, value string")


def _parts(name: str, ext: str, raw: bytes) -> Iterator[tuple[str, int, str, bool]]:
    """(name, chunk number, text, whether it is de-obfuscated) of one file that is no archive, by its class."""
    kind = next((k for k, v in fixed.EXTENSIONS.items() if ext in v), None)
    if kind == "text" or ext in (".eml", ".mbox"):
        yield name, 0, raw.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n"), True
        return
    if kind == "documents":
        try:
            yield name, 0, _document_text(ext, raw), False
            return
        except Exception:  # read as binary
            kind = "data"
    if kind in ("data", "audio", "video") or ext == ".msg":
        for k in range(0, len(raw), CHUNK):
            text = _printable(raw[k : k + CHUNK])
            if text.strip(" "):
                yield f"{name}_chunk_{k // CHUNK + 1}", k // CHUNK + 1, text, False


def everything(files: DataFrame, deepest: int | None = None, most_bytes: int = 500 << 20) -> DataFrame:
    """case_name, file_name, ord, chunk_no, text of all files, by class: texts and mail as they are, archives by their members, the rest (and what can't be read otherwise) as binary chunks.

    One pass: each file is read and each archive opened once."""
    names = ["case_name", "file_name", "ord", "chunk_no", "text", "plain"]

    def parts(b: pd.DataFrame) -> Iterator[tuple]:
        for r in b.itertuples():
            raw = bytes(r.content)
            for path, data, _, error in _opened(r.file_path, raw, deepest, most_bytes) if r.ext in ARCHIVES else [(r.file_path, raw, 0, None)]:
                for n, k, t, p in _parts(*_split_name(path), data) if error is None else ():
                    yield r.case_name, n, r.ord, k, t, p

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from _batched(parts(b), 4, names)

    kind = files.schema["ord"].dataType.simpleString()
    got = files.select("case_name", "file_path", "ext", "ord", "content").mapInPandas(run, f"case_name string, file_name string, ord {kind}, chunk_no int, text string, plain boolean")
    return got.select("case_name", "file_name", "ord", "chunk_no", F.when(F.col("plain"), tx.deobfuscate("text")).otherwise(F.col("text")).alias("text"))


def stored_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings from stored JSON documents: case_name, category, value, context; URLs by domain are read one by one.

    The case is the path's part after the first `cases`, or else the folder two above the file."""
    raw = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("path"))
    named = F.regexp_extract("path", r"^.*?/cases/([^/]+)/", 1)
    case = F.when(named != "", named).otherwise(F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1))
    maps = raw.select(case.alias("case_name"), F.explode(F.from_json("value", "map<string,string>")).alias("category", "items"))
    flat = maps.where(~F.col("category").isin("Processing_Summary", "URLs_by_Domain")).select("case_name", "category", F.explode(F.from_json("items", "map<string,string>")).alias("value", "context"))
    urls = maps.where("category = 'URLs_by_Domain'").select("case_name", F.explode(F.from_json("items", "map<string,map<string,string>>")).alias("domain", "urls")).select("case_name", F.lit("URLs").alias("category"), F.explode("urls").alias("value", "context"))
    return flat.unionByName(urls)


def stored_summaries(spark: SparkSession, path: str) -> DataFrame:
    """case file's path, key, value of the processing summaries in stored JSON documents."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"), F.input_file_name().alias("path"))
    return raw.select("path", F.explode(F.from_json(F.try_element_at("m", F.lit("Processing_Summary")), "map<string,string>")).alias("key", "value"))
