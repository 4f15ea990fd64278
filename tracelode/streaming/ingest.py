"""Evidence texts that keep arriving: each micro-batch is extracted like a batch and merged into the findings by key.

Late data has no meaning in event time here, only in the files' order, so the merge keeps for each (case, category, value)
the occurrence of the highest order, and the first place it was seen. Each batch writes what it found, a row per case, category and
value, under its own number: its cost is that of the batch, however much came before. A batch that is repeated writes the same folder
again, so results are exactly once. Readers settle the batches' rows by key; `compact` puts settled rows in their place."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import validate as va
from ..operators import extract

KEPT = "case_name string, category string, value string, file_name string, ord long, position int, first_seen struct<ord:long,position:int>"


def merge_batch(old: DataFrame, texts: DataFrame, standing: Collection[str] = ()) -> DataFrame:
    """The findings table after one more batch of texts; `standing` as in `extract.matches`."""
    occ = extract.in_file(extract.accepted(extract.matches(texts, standing=standing)), "case_name", "file_name", "ord")
    new = occ.select("case_name", "category", "value", "file_name", "ord", "position", F.struct("ord", "position").alias("first_seen"))
    return settle(old.unionByName(new))


def start(texts: DataFrame, target: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts the stream; `texts` is a streaming table of case_name, file_name, ord, text. Batches stand under `target`."""

    def each(rows: DataFrame, batch: int) -> None:
        none = rows.sparkSession.createDataFrame([], KEPT)
        merge_batch(none, rows).write.mode("overwrite").parquet(f"{target}/batch={batch}")

    writer = texts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def settle(rows: DataFrame) -> DataFrame:
    """Rows of several batches as one table of findings: one shuffle, combined before it."""
    last = F.max_by(F.struct("file_name", "ord", "position"), F.struct("ord", "file_name"))
    g = rows.groupBy("case_name", "category", "value").agg(last.alias("l"), F.min("first_seen").alias("first_seen"))
    return g.select("case_name", "category", "value", "l.file_name", "l.ord", "l.position", "first_seen")


def current(spark: SparkSession, target: str) -> DataFrame:
    """The findings of all batches so far."""
    return settle(spark.read.schema(KEPT).parquet(f"{target}/batch=*"))


def compact(spark: SparkSession, target: str, into: str) -> None:
    """Writes the settled findings of all batches as the first batch of another folder, from which a stream can go on."""
    current(spark, target).write.mode("overwrite").parquet(f"{into}/batch=-1")


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type in tumbling windows; late ones are let in for as long as the watermark says. Works on streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("users")).select(F.col("w.start").alias("start"), "event_type", "events", "users")


def card_alerts(texts: DataFrame) -> DataFrame:
    """Card numbers as they arrive, with issuer; stateless, so rows go straight through."""
    found = extract.accepted(extract.matches(texts, ["Credit_Card_VisaMcDiscover", "Credit_Card_Amex"]))
    return found.select("case_name", "file_name", "value", va.issuer("value").alias("issuer"), "position")
