"""Pages of a sorted table at any depth, from a sort that is kept.

The table is range-partitioned and sorted once and written, a folder a partition; how many rows each has is kept with it. A page is then read from the
one or two partitions in which its rows lie, however far down it is, and nothing is sorted or counted again.

Edge cases: a page beyond the end is empty, and so are all of an empty table; rows that are equal in all sort columns keep one order from then on; a page may
span any number of partitions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import cut


def store(rows: DataFrame, order: list[Column], path: str, partitions: int | None = None) -> None:
    """Sorts and writes a table for `page`; ties are ordered by the rows' own hash."""
    ties = [F.xxhash64(*rows.columns)]
    dealt = rows.repartitionByRange(partitions, *order, *ties) if partitions else rows.repartitionByRange(*order, *ties)
    at = cut(dealt.sortWithinPartitions(*order, *ties).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")))
    counts = at.groupBy("__part").agg(F.count("*").alias("rows"), F.min("__at").alias("first"))
    at.write.partitionBy("__part").mode("overwrite").parquet(f"{path}/rows")  # each of its tasks writes one folder
    rows.sparkSession.createDataFrame([(at.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/borders")  # a row a partition


def place(spark: SparkSession, path: str, number: int, size: int) -> list[tuple[int, int, int]]:
    """(partition, first row, rows) of a page, from page 1; rows are numbered within their partition."""
    start, end, before, out = (number - 1) * size, number * size, 0, []
    for r in spark.read.parquet(f"{path}/borders").orderBy("__part").collect():  # a row a partition
        first, last = max(start, before), min(end, before + r.rows)
        if first < last:
            out.append((r["__part"], r.first + first - before, last - first))
        before += r.rows
    return out


def page(spark: SparkSession, path: str, number: int, size: int = 50) -> DataFrame:
    """One page of a table that `store` has written, in order."""
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/schema", wholetext=True).first()[0]))
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    wanted = F.lit(False)
    for part, first, many in place(spark, path, number, size):
        wanted = wanted | ((F.col("__part") == part) & F.col("__at").between(first, first + many - 1))
    return rows.where(wanted).orderBy("__part", "__at").drop("__part", "__at")


def pages(spark: SparkSession, path: str, size: int = 50) -> int:
    """How many pages the table has."""
    return -(-(spark.read.parquet(f"{path}/borders").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]) // size)
