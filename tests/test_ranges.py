"""Files of any size in byte ranges: the same rows whatever the ranges."""

from __future__ import annotations

import io
import random

import pytest
from pyspark.sql import functions as F

from tracelode.operators import extract
from tracelode.sources import files, mail, ranges


@pytest.fixture
def small_steps(monkeypatch):
    monkeypatch.setattr(ranges, "STEP", 3)


def test_records_begin_once_whatever_the_ranges(small_steps):
    rng = random.Random(2)
    for _ in range(1500):
        raw = b"".join(rng.choice([b"From ", b"\n", b"\nFrom ", b"Fro", b"m ", b"x", b"abc\n", b"F"]) for _ in range(rng.randrange(30)))
        width, least = rng.choice([1, 2, 3, 5, 9, 1000]), rng.choice([1, 3, 10])
        parts = [(a, min(len(raw), a + width)) for a in range(0, len(raw), width)]
        mails = [r for a, z in parts for r in ranges.records_in(io.BytesIO(raw), a, z, b"\nFrom ", b"From ")]
        assert [c[5:] for _, c in mails] == (b"\n" + raw).split(b"\nFrom ")[1:] and all(raw[at:].startswith(c) for at, c in mails)
        lines = [r for a, z in parts for r in ranges.records_in(io.BytesIO(raw), a, z, b"\n", least=least)]
        assert b"\n".join(c for _, c in lines) == raw.removesuffix(b"\n")


def test_a_mailbox_from_one_range_and_from_many(spark, tmp_path):
    box, n, rng = tmp_path / "a.mbox", 200_000, random.Random(1)
    with open(box, "w") as f:
        f.write("no message\n")
        for i in range(n):
            f.write(f"From x{i}\nFrom: a{i}@b.org\nSubject: s{i}\n\nbody {'x' * rng.randrange(40)}\nFromage\n")
    some = F.sum(F.hash("message_index", "from", "subject", "body_plain"))
    out = []
    for k in (1, 32):
        got = ranges.mailboxes(spark, str(tmp_path), -(-box.stat().st_size // k))
        out.append(tuple(got.agg(F.count("*"), F.count_distinct("message_index"), F.max("message_index"), F.count_if(F.concat(F.lit("s"), F.col("message_index").cast("string")) == F.col("subject")), some).first()))
    assert out[0] == out[1] and out[0][:4] == (n, n, n - 1, n)
    assert len(ranges.RangeReader({"path": str(tmp_path), "unit": "mbox", "rangebytes": str(-(-box.stat().st_size // 32))}).partitions()) == 32


def test_small_mailboxes_as_by_rows(spark, tmp_path):
    (tmp_path / "a.mbox").write_bytes(b"From a\nSubject: =?utf-8?q?h=C3=A9?=\nContent-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/plain\n\nhello\n--b\nContent-Type: text/html\n\n<p>\n--b--\nFrom b\n\nFrom c")
    (tmp_path / "b.mbx").write_bytes(b"nothing")
    (tmp_path / "c.mbox").write_bytes(b"")
    want = mail.messages(files.list_files(spark, str(tmp_path)).where("size > 0")).orderBy("archive", "message_index").collect()
    for width in (7, 1000):
        assert ranges.mailboxes(spark, str(tmp_path), width).orderBy("archive", "message_index").collect() == want


def test_texts_and_chunks_as_of_whole_files(spark, tmp_path):
    case, rng = tmp_path / "case1", random.Random(1)
    case.mkdir()
    with open(case / "t.txt", "w", newline="") as f:
        for i in range(3000):
            f.write(f"line {i} at 8.8.{i % 250}.{i % 7} and user{i}@mail{i % 9}.org{rng.choice([chr(10), chr(13) + chr(10), chr(10) * 2])}é ")
    (case / "u.txt").write_text("ends 1.1.1.1 without a newline at 9.9.9.9")
    (case / "e.txt").write_text("")
    (case / "z.db").write_bytes(bytes(rng.randrange(256) for _ in range(50_000)))
    listed = files.list_files(spark, str(case))
    kept = ["category", "value", "file", "position"]
    want = {tuple(r) for r in extract.findings(files.texts(listed)).select(*kept).collect()}
    assert len(want) > 3000 and want == {tuple(r) for r in ranges.findings(spark, str(case), width=20_000, piece=3000).select(*kept).collect()}
    cols = ["case_name", "file_name", "chunk_no", "text"]
    want = sorted(files.binary_chunks(listed.where("ext = '.db'")).select(*cols).collect())
    assert sorted(ranges.binary_chunks(spark, str(case / "z.db"), width=17_000).select(*cols).collect()) == want
    with pytest.raises(Exception, match="no such unit"):
        ranges.ranges(spark, str(case), "pages").count()
