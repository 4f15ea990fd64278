"""Findings as keyed state, and the bucketed master table."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracelode.operators import extract, master
from tracelode.streaming import state

TEXT = "case_name string, file_name string, ord long, text string"
ROWS = "indicator_value string, indicator_type string, project_name string, context string, position int"


def test_state_over_batches_and_a_restart_equals_all_at_once(spark, tmp_path):
    rng = random.Random(1)
    ips, mails = [f"8.8.{i}.{i}" for i in range(30)], ["ann@mail.org", "joann@mail.org", "bob@x.org"]
    texts = [(rng.choice(["a", "b", None]), f"f{i}.txt", i, rng.choice([None, "", f"{rng.choice(ips)} and {rng.choice(ips)}, {rng.choice(mails)},\n{rng.choice(ips)}", "card 4111 1111 1111 1111"])) for i in range(200)]
    rng.shuffle(texts)
    src, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    for part in range(10):
        spark.createDataFrame(texts[part * 20 : part * 20 + 20], TEXT).coalesce(1).write.mode("append").parquet(src)
        if part in (4, 9):  # stopped in between
            stream = spark.readStream.schema(TEXT).option("maxFilesPerTrigger", 1).parquet(src)
            state.start(stream, checkpoint, str(tmp_path / "changes"), once=True).awaitTermination()
    kept = ["case_name", "category", "value", "file", "position", "context"]
    whole = spark.createDataFrame(texts, TEXT)
    want = extract.findings(whole)
    assert sorted(map(str, state.findings(spark, checkpoint).select(*kept).collect())) == sorted(map(str, want.select(*kept).collect()))
    seen = extract.merged(extract.in_file(extract.accepted(extract.matches(whole)), "case_name", "file_name", "ord"))
    some = ["case_name", "category", "value", "first_seen.ord", "first_seen.position"]
    assert sorted(map(str, state.current(spark, checkpoint).select(*some).collect())) == sorted(map(str, seen.select(*some).collect()))
    # changes alone are written: settling them by key gives the same
    changed = spark.read.parquet(str(tmp_path / "changes"))
    last = changed.groupBy(*state.KEY).agg(F.max_by("ord", "batch").alias("ord"))
    assert changed.select("batch").distinct().count() == 10 and last.count() == seen.count() and changed.count() < 10 * seen.count()


@pytest.fixture
def table(spark, tmp_path):
    yield "master_of_test", str(tmp_path / "master")
    spark.sql("DROP TABLE IF EXISTS master_of_test")


def test_master_table_over_runs_and_repeated_runs(spark, table):
    name, path = table
    one = [(f"v{i}", "t", f"p{i % 3}", "c", 0) for i in range(500)] + [("v1", "s", "p1", "c", 1), (None, "t", "p1", "c", 0), ("v1", "t", "p1", None, 0), ("v2", "t", None, "c", 0)] * 2
    two = [(f"v{i}", "u", f"p{i % 3}", "c", 0) for i in range(400, 600)] + [(None, "t", "p1", "c", 0), ("new", "t", None, None, 0)]
    df = {k: spark.createDataFrame(r, ROWS) for k, r in (("one", one), ("two", two))}
    key = lambda r: (r[0], r[2], r[3] or "")
    known, new = {key(r) for r in one}, {key(r) for r in two}
    assert master.insert(df["one"], name, 1, 16, path).count() == len(known)
    for run, rows in ((2, "two"), (2, "two"), (1, "one"), (3, "two"), (3, "one")):  # repeated, and one that brings nothing
        got = master.insert(df[rows], name, run)
        assert {(r.indicator_value, r.project_name, r.context) for r in got.collect()} == {1: known, 2: new - known, 3: set()}[run]
    held = [tuple(r) for r in master.indicators(spark, name).collect()]
    assert len(held) == len(known | new) and next(r for r in held if key(r) == ("v1", "p1", "c"))[1] == "s"
    master.compacted(spark, name, "master_of_test_whole")
    try:
        assert sorted(map(str, master.indicators(spark, "master_of_test_whole").collect())) == sorted(map(str, master.indicators(spark, name).collect()))
        assert master.insert(df["two"], "master_of_test_whole", 1).count() == 0
    finally:
        spark.sql("DROP TABLE master_of_test_whole")


def test_no_exchange_stands_above_the_master_table(spark, table):
    name, path = table
    master.insert(spark.createDataFrame([(f"v{i}", "t", "p", "c", 0) for i in range(100)], ROWS), name, 1, 16, path)
    with master.settings(spark, **{"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false"}):
        plan = master.unknown(master.first_of_run(spark.createDataFrame([("v1", "t", "p", "c", 0)], ROWS), 16), name, 2)._jdf.queryExecution().executedPlan().toString()
    tables_side = plan.split("\n+- ", 1)[1]  # the join's right child
    assert plan.startswith(("SortMergeJoin", "*")) and "SortMergeJoin" in plan.splitlines()[0]
    assert "SelectedBucketsCount: 2 out of 16" in tables_side and "Exchange" not in tables_side
