"""A stored index for repeated searches: which texts hold which runs of three characters.

A text that holds a term, in whatever case, holds all runs of three of the term's folded characters. Postings (run, text) are stored by the run's hash, sorted, so
that a search reads those of its terms' runs alone; texts that have all of them are read from their parts of the store and searched exactly.
Rows are as `search.search` gives them. A posting is a run with the texts of one block (a few megabytes of texts) that have it: a run that all texts have is
many rows, in one part of the store, and is intersected by a count.

Terms under three characters and patterns have no runs to look up: all texts are searched. Edge cases: null and empty texts are in the
store without postings; the same path twice is searched twice; an empty list of terms finds nothing; a text may be of any length, its postings are its different
runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, spread
from . import search as exact

N, PARTS, BLOCK = 3, 64, 4 << 20


def folded(text: Column) -> Column:
    """Characters without their case: those that a search that ignores case takes for one another are one.

    Upper case says that of all but those whose lower case has another upper case."""
    return F.upper(F.translate(text, "İ\u212a\u212b\u2126ẞϴ", "IKÅΩßΘ"))


def runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The different runs of three characters of each text, as numbers (21 bits a character): runs in order, and of each the text's place, in order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(chars) < N:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = np.repeat(np.arange(len(texts)), sizes)
    inner = own[: -N + 1] == own[N - 1 :]  # a run lies in one text
    run, own = (chars[:-2] << 42 | chars[1:-1] << 21 | chars[2:])[inner], own[: -N + 1][inner]
    order = np.argsort(run, kind="stable")
    run, own = run[order], own[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (own[1:] != own[:-1])
    return run[new], own[new]


def postings(texts: DataFrame) -> DataFrame:
    """run, file_ids: for each block of the texts (file_id, text) its different runs, and the texts that have them."""

    def block(ids: list[int], texts: list[str]) -> pa.RecordBatch:
        run, own = runs(texts)
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(run)].astype(np.int32)), pa.array(np.array(ids, np.int64)[own]))
        return pa.record_batch([pa.array(run[starts]), lists], names=["run", "file_ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = [], [], 0
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1)):
                text = raw.as_py().decode("utf-8", "replace")
                ids.append(i)
                held.append(text)
                size += len(text)
                if size >= BLOCK:
                    yield block(ids, held)
                    ids, held, size = [], [], 0
        if held:
            yield block(ids, held)

    return texts.select("file_id", folded(F.col("text")).cast("binary").alias("text")).mapInArrow(run, "run long, file_ids array<long>")


def build(texts: DataFrame, path: str, parts: int = PARTS) -> None:
    """Stores texts (file_path, text and, optionally, archive_depth) and their postings below a path."""
    depth = F.col("archive_depth") if "archive_depth" in texts.columns else F.lit(0)
    own = spread(texts.select(F.xxhash64("file_path").alias("file_id"), "file_path", depth.alias("archive_depth"), "text"))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    stored = own.withColumn("part", of("file_id"))
    stored.repartition("part").sortWithinPartitions("part", "file_id").write.partitionBy("part").mode("overwrite").parquet(f"{path}/texts")
    grams = postings(own.where("text is not null").select("file_id", "text")).withColumn("part", of("run"))
    # a part of the store is written by as many tasks as its rows need: AQE splits what a frequent run makes large
    texts.sparkSession.createDataFrame([(str(parts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/parts")
    grams.hint("rebalance", "part").sortWithinPartitions("part", "run").write.partitionBy("part").mode("overwrite").parquet(f"{path}/postings")


def candidates(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """term, file_id, part of the texts that have all runs of each term of three characters or more."""
    parts = int(spark.read.text(f"{path}/parts").first()[0])
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    asked = spark.createDataFrame([(t,) for t in terms], "term string").select("term", folded(F.col("term")).alias("folded")).collect()  # the terms that are asked for
    own = {r.term: runs([r.folded])[0].tolist() for r in asked}
    held = spark.createDataFrame([(t, len(xs), x) for t, xs in own.items() for x in xs], "term string, all int, asked long")
    every = held.select("asked", part("asked").alias("part")).distinct().collect()
    wanted = spark.read.schema("run long, file_ids array<long>, part int").parquet(f"{path}/postings").where(F.col("part").isin(sorted({r.part for r in every})) & F.col("run").isin([r.asked for r in every]))
    met = wanted.select("run", F.explode("file_ids").alias("file_id")).distinct().join(F.broadcast(held), F.col("run") == F.col("asked"))
    found = met.groupBy("term", "file_id").agg(F.count("*").alias("n"), F.max("all").alias("all")).where("n = all")
    return found.select("term", "file_id", part("file_id").alias("part"))


def search(spark: SparkSession, path: str, terms: list[str], around: int = 50, regex: bool = False, read: Observation | None = None) -> DataFrame:
    """The rows of `search.search` over the stored texts. `read` is told how many texts were searched (`texts`)."""
    texts = spark.read.parquet(f"{path}/texts")
    counted = lambda rows: rows if read is None else rows.observe(read, F.count("*").alias("texts"))
    own = [] if regex else [t for t in dict.fromkeys(terms) if len(t) >= N]
    rest = terms if regex else [t for t in terms if t and len(t) < N]
    if not own:
        return exact.search(counted(texts), terms if regex else rest, around, regex=regex)
    found = cut(candidates(spark, path, own))
    parts = [r.part for r in found.select("part").distinct().collect()]  # as many as the store has, at most
    few = texts.where(F.col("part").isin(parts) if parts else F.lit(False)).drop("part")
    named = found.select(F.col("file_id").alias("of")).distinct()
    some = counted(few.join(named, F.col("file_id") == F.col("of"), "left_semi"))
    # a text that has one term's runs is read once for all terms: of one that it doesn't hold it gives no row
    out = exact.search(some, own, around)
    return out.unionAll(exact.search(texts, rest, around)) if rest else out
