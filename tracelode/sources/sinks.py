"""Writers: the documents, tables and files that a case leaves."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.ordered import running
from . import ranges


def nested(found: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """case_name, json: category -> value -> context, URLs one level deeper by domain, and the processing summary if given.

    One document per case is what the format asks for: its size is the case's."""
    plain = found.where("category <> 'URLs'").groupBy("case_name", "category").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "context"))))).alias("j"))
    urls = found.where("category = 'URLs'").groupBy("case_name", tx.domain_of("value").alias("d")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "context"))))).alias("u"))
    quoted = lambda k, v: F.concat(F.substring_index(F.substring(F.to_json(F.create_map(k, F.lit(0))), 2, 1 << 30), ":0}", 1), F.lit(":"), v)
    joined = lambda items: F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(items)), ","), F.lit("}"))
    by_domain = urls.groupBy("case_name").agg(joined(quoted(F.col("d"), F.col("u"))).alias("j")).select("case_name", F.lit("URLs_by_Domain").alias("category"), "j")
    all_ = plain.unionByName(by_domain)
    if summaries is not None:
        all_ = all_.unionByName(summaries.select("case_name", F.lit("Processing_Summary").alias("category"), F.to_json(F.struct(*(c for c in summaries.columns if c != "case_name"))).alias("j")))
    return all_.groupBy("case_name").agg(joined(quoted(F.col("category"), F.col("j"))).alias("json"))


def write_findings(found: DataFrame, path: str, summaries: DataFrame | None = None) -> None:
    """A JSON document per case, in a folder per case."""
    nested(found, summaries).withColumnRenamed("json", "value").write.partitionBy("case_name").mode("overwrite").text(path)


def csv_rows(found: DataFrame, most: int = 250) -> DataFrame:
    """Category, Indicator, Context: contexts on one line, cut; URLs one row per domain with all its URLs."""
    plain = found.where("category <> 'URLs'").select(F.col("category").alias("Category"), F.col("value").alias("Indicator"), "context")
    urls = found.where("category = 'URLs'").groupBy(tx.domain_of("value").alias("d")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "context"))))).alias("context"))
    rows = plain.unionByName(urls.select(F.lit("URLs_by_Domain").alias("Category"), F.col("d").alias("Indicator"), "context"))
    return rows.select("Category", "Indicator", F.left(F.replace("context", F.lit("\n"), F.lit(" ")), F.lit(most)).alias("Context"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def search_csv(hits: DataFrame, path: str) -> None:
    """Search results without the depth."""
    write_csv(hits.select("file_path", "search_string", "match_position", "context"), path)


def write_datasets(datasets: dict[str, DataFrame], path: str) -> None:
    """Each named dataset as JSON lines in a folder of its own."""
    for name, rows in datasets.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def write_files(rows: DataFrame, folder: str) -> None:
    """Each row's content as a file of its own below a folder of the shared store: rows of name (a path without `..`) and content. A repeated task writes the same files."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, path = ranges.opened(f"{folder.rstrip('/')}/{name}")
                fs.create_dir(path.rsplit("/", 1)[0])
                with fs.open_output_stream(path) as f:
                    f.write(content or b"")
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], names=["files"])

    rows.select("name", "content").mapInArrow(run, "files long").agg(F.sum("files")).collect()  # one number


def append_indicators(rows: DataFrame, path: str) -> None:
    """Appends to the master table, a folder per project."""
    rows.write.mode("append").partitionBy("project_name").parquet(path)


def collected_names(files: DataFrame, project: str) -> DataFrame:
    """file_path and new_name (`project_A.ext`, B, ... in path order) of extracted files, ranked within their case.

    The rank is a distributed one: a case of very many files is sorted and numbered over many partitions. Paths and extensions alone are shuffled."""
    ranked = running(files.select("case_name", "file_path", "ext", "ord"), ["case_name"], [F.col("ord")])
    return ranked.select("file_path", F.concat(F.lit(f"{project}_"), tx.letter_suffix(F.col("__no") - 1), "ext").alias("new_name"))


def write_metadata(spark, document: dict, path: str) -> None:
    """One small JSON document (case metadata or notes)."""
    import json

    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.mode("overwrite").text(path)
