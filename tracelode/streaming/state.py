"""Findings of arriving texts as keyed state: of each case, category and value the occurrence that stands, and the first.

Across a case's files the last occurrence stands, in the place of the first, and within a file the first one. That is what the state holds, a row a key;
files may arrive in any order. Each micro-batch reads and writes the keys that it holds, and the current findings are the state itself: no
history is settled when they are read. Rows are put together by key within each task before they are shuffled, so a
value that very many texts hold sends few rows.

A stream that is started again with its checkpoint goes on where it ended; a batch that is repeated changes nothing. Edge cases: null and empty texts have no occurrences; a null case is a
case; the same file in two batches counts once."""

from __future__ import annotations

from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import extract

KEY = ["case_name", "category", "value"]
STATE = "file_name string, ord long, position int, first_ord long, first_position int"
ROW = f"case_name string, category string, value string, {STATE}"
_FIELDS = [f.split(" ")[0] for f in STATE.split(", ")]


def together(rows: pd.DataFrame) -> pd.DataFrame:
    """A row for each key: columns as ROW has them, on either side."""
    rows = rows.assign(file_name=rows["file_name"].fillna(""))
    last = rows.sort_values(["ord", "file_name", "position"], ascending=[False, False, True], kind="stable").drop_duplicates(KEY)
    first = rows.sort_values(["first_ord", "first_position"], kind="stable").drop_duplicates(KEY)[[*KEY, "first_ord", "first_position"]]
    return last.drop(columns=["first_ord", "first_position"]).merge(first, on=KEY)[[*KEY, *_FIELDS]]


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            yield together(b)


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    before = state.get if state.exists else None
    now = pd.DataFrame([(*key, *before)], columns=[*KEY, *_FIELDS]) if before else None
    for b in batches:
        b = b[[*KEY, *_FIELDS]].assign(**dict(zip(KEY, key, strict=True)))
        now = together(b if now is None else pd.concat([now, b]))
    own = now.iloc[0]
    held = (str(own["file_name"]), int(own["ord"]), int(own["position"]), int(own["first_ord"]), int(own["first_position"]))
    if before is None or held != tuple(before):
        state.update(held)
        yield pd.DataFrame([(*key, *held)], columns=[*KEY, *_FIELDS])


def changes(texts: DataFrame, categories: list[str] | None = None, standing: Collection[str] = ()) -> DataFrame:
    """The stream of keys whose finding has changed, of a stream of case_name, file_name, ord, text; `standing` as in `extract.matches`."""
    occ = extract.accepted(extract.matches(texts, categories, standing)).select(*KEY, "file_name", F.col("ord").cast("long").alias("ord"), "position", F.col("ord").cast("long").alias("first_ord"), F.col("position").alias("first_position"))
    return occ.mapInPandas(_combined, ROW).groupBy(*KEY).applyInPandasWithState(_step, ROW, STATE, "update", GroupStateTimeout.NoTimeout)


def start(texts: DataFrame, checkpoint: str, target: str | None = None, once: bool = False, standing: Collection[str] = ()) -> StreamingQuery:
    """Starts the stream. With `target`, each batch's changes are written below it, under the batch's number: a batch that is repeated writes the same folder again."""

    def each(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    writer = changes(texts, standing=standing).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(each) if target else writer.format("noop")
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, checkpoint: str) -> DataFrame:
    """case_name, category, value, file, position, first_seen: the state of a stream, read where it is kept."""
    held = spark.read.format("statestore").load(checkpoint)
    key, s = F.col("key"), F.col("value.groupState")
    return held.select(*(key[c].alias(c) for c in KEY), s["file_name"].alias("file"), s["position"].alias("position"), F.struct(s["first_ord"].alias("ord"), s["first_position"].alias("position")).alias("first_seen"))


def findings(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The current findings, described, as `extract.findings` gives them of all texts at once."""
    return extract.described(extract.drop_part_emails(extract.cut(current(spark, checkpoint))))
