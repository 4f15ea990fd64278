"""Search over a stored index: the rows of a full search, fewer texts read."""

from __future__ import annotations

import random

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tracelode.operators import search, textindex


def test_rows_of_a_full_search_and_fewer_texts_read(spark, tmp_path):
    rng = random.Random(1)
    words = ["Alpha", "beta", "GAMMA", "ΟΔΟΣ", "straße", "STRASSE", "ſecret", "a\nb", "😀 x", "\\E.x", "of", "to"]
    rows = [(f"/e/{i}.txt", None if i % 40 == 0 else "" if i % 41 == 0 else " ".join(rng.choice(words) for _ in range(rng.randrange(6))), i % 3) for i in range(400)]
    rows += [("/e/1.txt", "alpha again", 1), ("/e/long.txt", "x" * 50_000 + "needle" + "y" * 50_000, 0)]
    texts = spark.createDataFrame(rows, "file_path string, text string, archive_depth int")
    path = str(tmp_path / "index")
    textindex.build(texts, path, 16)
    for terms in (["alpha"], ["ΟΔΟΣ", "οδος"], ["SECRET", "straße", "absent"], ["of", "gamma b"], ["a\nb", "😀 x", "\\E.x"], ["needle"], [], ["none of these"]):
        want = sorted(map(str, search.search(texts, terms).collect()))
        assert sorted(map(str, textindex.search(spark, path, terms).collect())) == want, terms
    assert sorted(map(str, textindex.search(spark, path, ["al.ha"], regex=True).collect())) == sorted(map(str, search.search(texts, ["al.ha"], regex=True).collect()))
    for term, most in (("needle", 1), ("none of these", 0), ("secret", 200)):
        read = Observation()
        textindex.search(spark, path, [term], read=read).collect()
        assert read.get["texts"] <= most
    plan = textindex.candidates(spark, path, ["needle"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "In(run" in plan


def test_an_index_of_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    textindex.build(spark.createDataFrame([("/e/1.txt", None)], "file_path string, text string"), path)
    assert textindex.search(spark, path, ["any", "a"]).count() == 0


def test_postings_are_few_rows_of_many_texts(spark, tmp_path):
    """A run that all texts have is a row for a block of texts, not one for each of them; runs are those of each text alone."""
    path = str(tmp_path / "index")
    texts = spark.range(4000).select(F.format_string("/e/%d.txt", "id").alias("file_path"), F.format_string("all have this %04d", "id").alias("text"))
    textindex.build(texts, path, 4)
    stored = spark.read.parquet(f"{path}/postings")
    pairs = stored.select("run", F.explode("file_ids").alias("file_id"))
    want = texts.select(F.xxhash64("file_path").alias("file_id"), F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 2), lambda i: F.upper(F.substring("text", i, F.lit(3))))).alias("run")).distinct()
    assert pairs.count() == want.count() == pairs.distinct().count() and pairs.select("run").distinct().count() == want.select("run").distinct().count()
    assert stored.where(F.size("file_ids") > 100).count() > 0 and stored.count() < pairs.count() / 4
