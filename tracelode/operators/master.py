"""The master table of indicators as a bucketed table: insert or ignore without moving what it holds.

The table is bucketed and sorted by a hash of its unique key (value, project, context), and has a partition for each run. New rows are dealt out
by the same buckets; of the table only the buckets that they fall into are read, and the join that leaves out what is known has no shuffle on the table's side.

A run has a number. Only runs before it are looked at, and its own partition is replaced when it is repeated, so a repeated run
adds what it added. `compacted` puts all runs into one, for tables of very many.

Edge cases: a null context is empty, a null value or project is a value of its own; of rows that share a key in one run the first by type is
kept; a run without new rows leaves an empty partition, and no error. The table's columns are those of its first run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut
from .links import UNIQUE

BUCKETS = 64
_AT = ["bucket_no", *UNIQUE]


def bucket_of(buckets: int = BUCKETS):
    """The bucket of a row, from its unique key."""
    return F.pmod(F.xxhash64(*UNIQUE), F.lit(buckets)).cast("int")


def _buckets(spark: SparkSession, table: str) -> int:
    """How many buckets the table was made with."""
    told = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").first()
    return int(told["data_type"])


def first_of_run(rows: DataFrame, buckets: int) -> DataFrame:
    """A row for each unique key, with its bucket."""
    rest = [c for c in rows.columns if c not in UNIQUE]
    order = ["indicator_type"] + [c for c in rest if c != "indicator_type"]
    keyed = rows.withColumn("context", F.coalesce("context", F.lit("")))
    one = keyed.groupBy(*UNIQUE).agg(F.min(F.struct(*order)).alias("f")).select(*UNIQUE, "f.*").select(*rows.columns)
    return one.withColumn("bucket_no", bucket_of(buckets))


def unknown(rows: DataFrame, table: str, run: int) -> DataFrame:
    """Of the rows of `first_of_run` those that no earlier run holds. `rows` is read twice: for the buckets that it touches, and for itself."""
    spark = rows.sparkSession
    buckets = _buckets(spark, table)
    touched = sorted(r[0] for r in rows.select("bucket_no").distinct().collect())  # as many as there are buckets, at most
    if len(touched) == 1:  # two at least: a constant would no longer be part of the join's key
        touched.append((touched[0] + 1) % buckets)
    held = spark.table(table).where((F.col("run") < run) & F.col("bucket_no").isin(touched)).select(*(F.col(c).alias(f"of_{c}") for c in _AT))
    same = F.lit(True)
    for c in _AT:
        same = same & (F.col(c) == F.col(f"of_{c}") if c == "bucket_no" else F.col(c).eqNullSafe(F.col(f"of_{c}")))
    return rows.repartition(buckets, "bucket_no").join(held.hint("merge"), same, "left_anti")


#: Tables are joined by their buckets although the key has more columns, with as many partitions as buckets.
_CONF = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


class settings:
    """Settings of the session that hold within a block."""

    def __init__(self, spark: SparkSession, **more: str):
        self.spark, self.wanted = spark, _CONF | more

    def __enter__(self):
        self.before = {k: self.spark.conf.get(k, None) for k in self.wanted}
        for k, v in self.wanted.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.before.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


def insert(rows: DataFrame, table: str, run: int, buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """Adds to the table what it doesn't hold, as this run's; gives what the run has added. `rows` as `links.indicator_rows` gives them.

    The first run makes the table, in the warehouse or at `path`."""
    spark = rows.sparkSession
    there = spark.catalog.tableExists(table)
    one = first_of_run(rows, _buckets(spark, table) if there else buckets).persist()
    try:
        with settings(spark, **{"spark.sql.shuffle.partitions": str(_buckets(spark, table) if there else buckets)}):
            if there:
                new = cut(unknown(one, table, run))  # what replaces a partition may not read the table
                columns, view = [c for c in spark.table(table).columns if c != "run"], f"new_{uuid.uuid4().hex}"
                new.select(*columns).createOrReplaceTempView(view)
                spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (run = {run}) SELECT * FROM {view}")  # even by nothing
                spark.catalog.dropTempView(view)
            else:
                at = one.withColumn("run", F.lit(run)).repartition(buckets, "bucket_no")
                made = at.write.partitionBy("run").bucketBy(buckets, "bucket_no").sortBy("bucket_no", *UNIQUE)
                (made.option("path", path) if path else made).saveAsTable(table)
    finally:
        one.unpersist()
    return added(spark, table, run)


def added(spark: SparkSession, table: str, run: int) -> DataFrame:
    """What a run has added."""
    return spark.table(table).where(F.col("run") == run).drop("bucket_no", "run")


def indicators(spark: SparkSession, table: str) -> DataFrame:
    """All rows of the table."""
    return spark.table(table).drop("bucket_no", "run")


def compacted(spark: SparkSession, table: str, into: str) -> None:
    """All runs as one run, of number 0, in a table of its own."""
    buckets = _buckets(spark, table)
    whole = spark.table(table).drop("run").withColumn("run", F.lit(0)).repartition(buckets, "bucket_no")
    whole.write.partitionBy("run").bucketBy(buckets, "bucket_no").sortBy("bucket_no", *UNIQUE).saveAsTable(into)
