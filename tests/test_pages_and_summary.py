"""Pages of a kept sort, and a run's measured summary."""

from __future__ import annotations

import io
import re
import zipfile

from pyspark.sql import functions as F

from tracelode.operators import extract, pages, summary, tableview
from tracelode.sources import files


def test_pages_at_any_depth_read_few_partitions(spark, tmp_path):
    path = str(tmp_path / "sorted")
    rows = spark.range(10_000).select(F.col("id"), (F.col("id") * 7919 % 1000).cast("string").alias("v"), F.lit("x").alias("first"))
    order = [*tableview.sort_keys("v", True), F.col("id")]
    pages.store(rows, order, path, 20)
    want = [r.id for r in rows.orderBy(*order).collect()]
    assert pages.pages(spark, path, 70) == 143
    for number in (1, 2, 71, 142, 143, 144):
        assert [r.id for r in pages.page(spark, path, number, 70).collect()] == want[(number - 1) * 70 : number * 70]
        assert len(pages.place(spark, path, number, 70)) <= 2
    plan = pages.page(spark, path, 142, 70)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*__part", plan)
    assert [r.id for r in pages.page(spark, path, 1, 5000).collect()] == want[:5000]  # over many partitions
    pages.store(rows.limit(0), order, path)
    assert pages.pages(spark, path) == 0 and pages.page(spark, path, 1).count() == 0


def test_summary_counts_what_failed_by_kind(spark, tmp_path):
    def zipped(entries):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in entries:
                z.writestr(name, data)
        return out.getvalue()

    damaged = bytearray(zipped([("x.txt", b"at 1.1.1.1 it was " * 9)]))
    damaged[60] ^= 255
    made = {"a.txt": b"at 8.8.8.8 now", "b.txt": b"nothing", "c.txt": b"", "d.zip": zipped([("in.txt", b"mail a@bc.org"), ("e.txt", b"none")]), "bad.zip": b"PK", "x.docx": b"no document", "dam.zip": bytes(damaged), "r.rar": b"Rar!"}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    texts = summary.read_all(files.list_files(spark, str(tmp_path)))
    found, told = summary.extracted(texts, str(tmp_path) + "-out/found")
    seconds = float(told.pop("processing_time_seconds"))
    assert seconds > 0 and told == {"files_processed": "2", "files_failed": "4", "files_failed_archive": "3", "files_failed_document": "1", "files_failed_member": "0", "files_skipped": "2"}  # an empty file is not listed
    assert {r.value for r in found.collect()} == {"8.8.8.8", "a@bc.org"}
    none, told = summary.extracted(texts.limit(0), str(tmp_path) + "-out/none")
    assert none.count() == 0 and told["files_processed"] == told["files_failed"] == told["files_skipped"] == "0"
    assert sorted(map(str, found.select("category", "value", "position").collect())) == sorted(map(str, extract.findings(texts).select("category", "value", "position").collect()))
