"""Mail archives as tables of messages: an archive that is a row is split within its task (`messages`), one of any size is read in ranges (`ranges.mailboxes`); each message is parsed alone."""

from __future__ import annotations

import datetime
import email
import email.header
from collections.abc import Iterator
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE = "archive string, message_index int, from string, to string, subject string, date string, sent timestamp, body_plain string, body_html string, attachments array<struct<filename:string,size:int>>, error string"
#: What a message's own bytes give.
FIELDS = ", ".join(f"`{n}` {t}" for n, t in (f.split(" ", 1) for f in MESSAGE.split(", ")[2:]))


def mail_format(name: Column, is_dir: Column | None = None) -> Column:
    """mbox, eml, pst, msg or maildir, by extension (a folder is a maildir); null otherwise."""
    ext = F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))
    kind = F.when(ext.isin(".mbox", ".mbx"), "mbox").when(ext == ".eml", "eml").when(ext == ".pst", "pst").when(ext == ".msg", "msg")
    return kind if is_dir is None else F.when(is_dir, "maildir").otherwise(kind)


def _header(value) -> str:
    if value is None:
        return ""
    return "".join(p.decode(c or "utf-8", "ignore") if isinstance(p, bytes) else p for p, c in email.header.decode_header(value))


def _message(raw: bytes) -> tuple:
    """from, to, subject, date, sent, body_plain, body_html, attachments, error."""
    try:
        msg = email.message_from_bytes(raw)
        bodies: dict[str, str] = {}
        files = []
        for part in msg.walk() if msg.is_multipart() else [msg]:
            kind, data = part.get_content_type(), part.get_payload(decode=True)
            if msg.is_multipart() and "attachment" in str(part.get("Content-Disposition", "")):
                files.append({"filename": part.get_filename(), "size": len(data or b"")})
            elif data is not None and (kind in ("text/plain", "text/html") or not msg.is_multipart()):
                key = "text/html" if kind == "text/html" else "text/plain"
                if not bodies.get(key):
                    bodies[key] = data.decode("utf-8", "ignore")
        try:
            sent = parsedate_to_datetime(msg.get("Date")) if msg.get("Date") else None
            sent = sent if sent is None or sent.tzinfo else sent.replace(tzinfo=datetime.UTC)
        except (TypeError, ValueError):
            sent = None
        return _header(msg.get("From")), _header(msg.get("To")), _header(msg.get("Subject")), msg.get("Date"), sent, bodies.get("text/plain", ""), bodies.get("text/html", ""), files, None
    except Exception as e:  # a damaged message is a row with its reason
        return "", "", "", None, None, "", "", [], str(e)[:200]


def _split(raw: bytes) -> list[bytes]:
    """The messages of an mbox: each starts after a line that begins with `From `."""
    parts = (b"\n" + raw).split(b"\nFrom ")
    return [p.split(b"\n", 1)[1] if b"\n" in p else b"" for p in parts[1:]]


#: Messages leave a task in batches of so many, or of about so many bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_ARROW = (
    pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.string(), pa.string(),
    pa.list_(pa.struct([("filename", pa.string()), ("size", pa.int32())])), pa.string(),
)


def messages(files: DataFrame) -> DataFrame:
    """The messages of .eml and .mbox files (file_path, content), message_index from 0; other formats give a row with an error."""
    names = [f.split(" ")[0] for f in MESSAGE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(v, k) for v, k in zip(zip(*out, strict=True), _ARROW, strict=True)], names=names)

        for b in batches:
            for path, kind, raw in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                raw = raw or b""
                for i, m in enumerate([raw] if kind == "eml" else _split(raw) if kind == "mbox" else [None]):
                    out.append((path, i, *(_message(m) if m is not None else ("", "", "", None, None, "", "", [], f"format not supported: {kind}"))))
                    held += len(m or b"")
                    if len(out) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield batch()
                        out, held = [], 0
        if out:
            yield batch()

    some = files.select("file_path", mail_format(F.col("file_path")).alias("kind"), "content").where("kind is not null")
    return some.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in (f.split(" ", 1) for f in MESSAGE.split(", "))))


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """archive, range_no, no and the fields of messages that were read in ranges, each with its line `From ` ahead."""
    names = ["archive", "range_no", "no", *(f.split(" ")[0] for f in MESSAGE.split(", ")[2:])]
    for whole in batches:
        for b in (whole.slice(k, BATCH_ROWS) for k in range(0, whole.num_rows, BATCH_ROWS)):
            raw = (m.split(b"\n", 1)[1] if b"\n" in m else b"" for m in b.column("content").to_pylist())
            fields = zip(*map(_message, raw), strict=True)
            yield pa.record_batch([b.column("file_path"), b.column("range_no"), b.column("no"), *(pa.array(v, k) for v, k in zip(fields, _ARROW[2:], strict=True))], names=names)


def archives(files: DataFrame) -> DataFrame:
    """The mail archives among a case's files, each path once."""
    return files.select("case_name", "file_path", "size", mail_format(F.col("file_path")).alias("format")).where("format is not null").dropDuplicates(["file_path"])
