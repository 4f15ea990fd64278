"""Archives by their members: as whole archives give them, over all cores, at any depth."""

from __future__ import annotations

import gzip
import io
import random
import tarfile
import time
import zipfile

from pyspark.sql import functions as F

from tracelode.sources import files, members


def zipped(entries, method=zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def tarred(entries, mode="w") -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def rows(df):
    return sorted((r.file_path, r.file_name, r.ext, r.depth, bytes(r.content) if r.content is not None else None, r.error is None) for r in df.collect())


def test_members_of_all_kinds_as_of_whole_archives(spark, tmp_path):
    rng = random.Random(1)
    noise = bytes(rng.randrange(256) for _ in range(3000))
    some = [("a.txt", b"one"), ("d/b.bin", noise), ("e", b""), ("d/", b""), ("../out.txt", b"x"), ("é.TXT", b"two")]
    deep = zipped(some)
    for _ in range(4):
        deep = zipped([("in.zip", deep), ("beside.txt", b"b")])
    made = {
        "a.zip": zipped(some), "stored.zip": zipped(some, zipfile.ZIP_STORED), "bz.zip": zipped(some, zipfile.ZIP_BZIP2), "lz.zip": zipped(some, zipfile.ZIP_LZMA), "t.tar": tarred(some), "t.tar.gz": tarred(some, "w:gz"), "t.tgz": tarred(some, "w:gz"),
        "one.txt.gz": gzip.compress(b"three"), "deep.zip": deep, "mixed.tar": tarred([("x.zip", zipped([("y.tar.gz", tarred([("z.txt", b"z")], "w:gz"))]))]), "bad.zip": b"PK nothing", "bad.gz": b"nothing", "empty.zip": zipped([]), "r.rar": b"Rar!", "plain.txt": b"no archive", "none.tar": b"",
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    listed = files.list_files(spark, str(tmp_path))
    got, want = rows(members.members(listed)), rows(files.unpack(listed))
    assert got == want and len(got) > 35 and max(r[3] for r in got) == 5
    cols = ["file_name", "chunk_no", "text"]
    whole = files.everything(listed.where(F.col("ext").isin(*files.ARCHIVES))).select(*cols)
    assert sorted(members.everything(listed).select(*cols).collect()) == sorted(whole.collect())


def test_damaged_large_and_endless_members_are_rows_with_errors(spark, tmp_path, monkeypatch):
    whole = bytearray(zipped([("a.txt", b"a" * 1000), ("b.txt", bytes(random.Random(2).randrange(256) for _ in range(1000)))], zipfile.ZIP_STORED))
    at = whole.find(b"a" * 1000)
    whole[at + 5] = 0
    (tmp_path / "d.zip").write_bytes(whole)
    (tmp_path / "l.zip").write_bytes(zipped([("big.txt", b"x" * 5000), ("small.txt", b"y")]))
    got = {r.file_path.rsplit("/", 1)[-1]: (r.error, r.size) for r in members.members(files.list_files(spark, str(tmp_path)), most_bytes=2000).collect()}
    assert got == {"d.zip::a.txt": ("damaged member", 0), "d.zip::b.txt": (None, 1000), "l.zip::big.txt": ("member too large", 0), "l.zip::small.txt": (None, 1)}
    # an archive that holds itself, as it were: a reader that gives the same bytes for ever
    monkeypatch.setattr(files, "_members", lambda name, raw, most: iter([("again.zip", raw), ("t.txt", b"t")]))
    assert [(d, e) for _, _, d, e in files._opened("q.zip", b"q", None, 10)] == [(1, "archive within itself"), (1, None)]


def test_one_archive_of_very_many_members(spark, tmp_path):
    n = 50_000
    (tmp_path / "m.zip").write_bytes(zipped(((f"f{i}.txt", b"file %d" % i) for i in range(n)), zipfile.ZIP_STORED))
    listed = files.list_files(spark, str(tmp_path))
    got = members.members(listed)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # every core has some
    assert got.where(F.concat(F.lit("file "), F.regexp_extract("file_name", r"(\d+)", 1)) == F.col("content").cast("string")).count() == n
    few = tmp_path / "few"
    few.mkdir()
    (few / "w.zip").write_bytes(zipped((f"f{i}.txt", b"15 bytes of it.") for i in range(4000)))
    few = files.list_files(spark, str(few)).cache()
    few.count()
    for one in (files.unpack, files.everything):
        began = time.time()
        assert one(few).count() == 4000
        assert time.time() - began < 6  # 12 and 7 seconds with a table for each member; on an idle machine less than one
