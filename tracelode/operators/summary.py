"""A run's summary, measured while it runs: what was read, failed and skipped, by kind, and how long it took.

The counts are observed on the rows as they pass (`DataFrame.observe`), in the same job that writes the findings: no pass of their own, and
nothing but a row of numbers reaches the driver. A stage that is repeated after a lost executor is observed once.

Edge cases: no files give zeros; empty files aren't listed by the file source, and so not counted; a file that can't be read fails once, by kind; an archive that can't be opened fails as one, and
its readable members count as files of their own; texts that are null or without a finding are skipped, not failed."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources import files as sources
from . import extract

KINDS = ("archive", "document", "member")


def read_all(files: DataFrame) -> DataFrame:
    """case_name, file_name, ord, text, failure (the kind of what can't be read, else null) of files by class: texts and mail, documents, and what archives hold of both; what is unreadable otherwise is left to the binary chunks."""
    archived = files.where(F.col("ext").isin(*sources.ARCHIVES))
    members = sources.unpack(archived)
    depth = members.select("case_name", "file_path", "file_name", "ext", "file_class", "size", "mtime", "content", F.col("ord").cast("string").alias("ord"), "depth", "error")
    direct = files.where(~F.col("ext").isin(*sources.ARCHIVES)).select("case_name", "file_path", "file_name", "ext", "file_class", "size", "mtime", "content", F.col("ord").cast("string").alias("ord"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("string").alias("error"))
    both = direct.unionByName(depth)
    # an archive's own row of error has its own name, a member's that of the member
    broken = both.where("error is not null").select("case_name", "file_name", "ord", F.lit(None).cast("string").alias("text"), F.when(F.col("ext").isin(*sources.ARCHIVES), "archive").otherwise("member").alias("failure"))
    fine = both.where("error is null")
    read = sources.texts(fine).select("case_name", "file_name", "ord", "text", F.lit(None).cast("string").alias("failure"))
    documents = sources.documents(fine).select("case_name", "file_name", "ord", "text", F.when(F.col("error").isNotNull(), "document").alias("failure"))
    return read.unionByName(documents).unionByName(broken)


def extracted(texts: DataFrame, target: str, categories: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Writes the findings of texts (case_name, file_name, ord, text and, optionally, failure) as Parquet; gives them back with the run's summary, as strings.

    Keys: files_processed (with a finding), files_failed, files_failed_<kind>, files_skipped, processing_time_seconds."""
    began = time.monotonic()
    failure = F.col("failure") if "failure" in texts.columns else F.lit(None).cast("string")
    seen, held = Observation(), Observation()
    rows = texts.withColumn("failure", failure)
    rows = rows.observe(seen, F.count("*").alias("files"), *(F.count_if(F.col("failure") == k).alias(k) for k in KINDS))
    occ = extract.accepted(extract.matches(rows.drop("failure"), categories))
    in_files = extract.in_file(occ, "case_name", "file_name", "ord")
    # one pass over the texts: what each file gave is written, and the findings settled from that
    places = extract.cut(in_files)
    per_file = places.groupBy("case_name", "file_name", "ord").agg(F.count("*").alias("n")).observe(held, F.count("*").alias("processed"))
    per_file.write.format("noop").mode("overwrite").save()
    merged = extract.merged(places)
    found = extract.described(extract.drop_part_emails(extract.cut(merged)))
    found.write.mode("overwrite").parquet(target)
    # a plan that is empty from the start runs nothing that could be observed
    counts, processed = ({k: 0 for k in ("files", *KINDS)}, 0) if texts.isEmpty() else (seen.get, held.get["processed"])
    failed = sum(counts[k] for k in KINDS)
    told = {"files_processed": processed, "files_failed": failed, **{f"files_failed_{k}": counts[k] for k in KINDS}, "files_skipped": counts["files"] - failed - processed}
    return texts.sparkSession.read.parquet(target), {**{k: str(v) for k, v in told.items()}, "processing_time_seconds": f"{time.monotonic() - began:.2f}"}
