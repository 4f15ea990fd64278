"""Operators that must hold for one hot key: the sweep over address blocks, anchors of addresses, ranks, links at one remove."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tracelode.operators import enrich, extract, links
from tracelode.operators.ordered import running
from tracelode.sources import sinks


def test_smallest_block_of_nested_touching_and_crossing_ones(spark):
    rng = random.Random(1)
    blocks = [(0, 2**32 - 1)]  # one around all
    for _ in range(400):
        start = rng.randrange(2**20)
        blocks.append((start, start + rng.choice([0, 1, 10, 255, 4095, 2**17])))
    blocks += [(2**21 + k * 256, 2**21 + k * 256 + 255) for k in range(50)] + [(100, 50), (7, 7), (7, 7)]
    points = sorted({rng.randrange(2**20) for _ in range(3000)} | {2**21 + k * 128 for k in range(110)} | {p for a, z in blocks for p in (a, z)})
    at = spark.createDataFrame([(a, z, k) for k, (a, z) in enumerate(blocks)], "start long, end long, id long")
    got = {r.n: r.id for r in enrich.smallest_holding(spark.createDataFrame([(p,) for p in points], "n long"), at).collect()}
    want = {p: min((z - a, a, k) for k, (a, z) in enumerate(blocks) if a <= p <= z)[2] for p in points}
    assert got == want
    assert enrich.smallest_holding(spark.createDataFrame([], "n long"), at).count() == 0 == enrich.smallest_holding(spark.createDataFrame([(5,)], "n long"), at.limit(0)).count()


def test_part_addresses_by_their_rarest_anchor(spark):
    rng = random.Random(2)
    mails = {(rng.choice(["a", "b", None]), f"{rng.choice(['noreply', 'ann', 'joann', 'x.ann', 'b'])}{rng.choice(['', '1', '12'])}@{rng.choice(['a.de', 'ma.de', 'a.den', 'bb.org'])}") for _ in range(150)}
    found = spark.createDataFrame([(c, "Email_Addresses", v) for c, v in mails] + [("a", "URLs", "ann@a.de")], "case_name string, category string, value string")
    want = {(c, v) for c, v in mails if not any(d == c and w != v and v in w for d, w in mails)}
    got = extract.drop_part_emails(found)
    assert {(r.case_name, r.value) for r in got.where("category = 'Email_Addresses'").collect()} == want and got.count() == len(want) + 1


def test_addresses_of_one_beginning_are_hardly_compared(spark):
    n = 100_000
    mails = spark.range(n).select(F.lit("a").alias("case_name"), F.concat(F.lit("noreply"), F.col("id").cast("string"), F.lit("@mail.example.org")).alias("value"))
    pairs = extract.part_pairs(mails)
    assert pairs.count() < 5 * n
    # each number is part of those that end with it: `5@mail...` of `15@mail...` isn't, for the beginning; so none is dropped
    assert pairs.where(F.contains("large", "small")).count() == 0


def test_rank_of_a_hot_case_is_in_no_window(spark):
    files = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 20).cast("string"))).alias("case_name"), F.format_string("/e/%05d.txt", "id").alias("file_path"), F.lit(".txt").alias("ext"), F.format_string("/e/%05d.txt", "id").alias("ord"))
    named = sinks.collected_names(files, "P")
    assert "Window" not in named._jdf.queryExecution().executedPlan().toString()
    hot = [r.new_name for r in named.join(files, "file_path").where("case_name = 'hot'").orderBy("file_path").collect()]
    letters = lambda k: ("" if k < 26 else letters(k // 26 - 1)) + chr(65 + k % 26)
    assert hot == [f"P_{letters(k)}.txt" for k in range(2000)]


def test_numbers_and_folds_go_on_over_partitions(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, rng.randrange(500)]), rng.randrange(50), rng.randrange(1 << 40)) for _ in range(3000)]
    got = {(r.g, r["__no"]): (r.o, r.x, r["x__run"]) for r in running(spark.createDataFrame(rows, "g long, o long, x long"), ["g"], [F.col("o"), F.col("x")], ("x",)).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        fold = 0
        for k, (_, o, x) in enumerate(sorted(r for r in rows if r[0] == g), 1):
            fold ^= x
            want[g, k] = (o, x, fold)
    assert got == want


def test_links_at_one_remove_name_the_smallest_project(spark):
    rng = random.Random(3)
    held = {(f"v{rng.randrange(12)}", f"p{rng.randrange(30):02d}") for _ in range(120)}
    got = {r.case: (r.reason, r.connected_to) for r in links.secondary(spark.createDataFrame([(*r, "") for r in held], "indicator_value string, project_name string, context string"), "v1").collect()}
    direct = {p for v, p in held if v == "v1"}
    want = {}
    for v, p in held:
        if p not in direct:
            via = [q for w, q in held if w == v and q in direct]
            if v != "v1" and via:
                want[p] = min(want.get(p, (v, min(via))), (v, min(via)))
    assert got == want and want


def test_device_texts_are_dealt_out_over_all_cores(spark):
    from tracelode.plans import queries

    assert queries.device_texts(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_points_of_pictures_step_in_batches(spark):
    from tracelode.operators import stego

    numbers = [(k, re, im) for k, (re, im) in enumerate([(-0.7, 0.27), (0.3, 0.5), (0.0, 0.0), (3.0, 3.0), (1e200, -1e200), (-0.123, 0.745)])] + [(9, None, 0.1)]
    px = stego.julia_of(spark.createDataFrame(numbers, "k long, real double, imaginary double"), 9, 7, 40)

    def plain(x, y, re, im):
        a, b = (x / 8 * 2 - 1) * 1.5, (y / 6 * 2 - 1) * 1.5
        for n in range(40):
            a, b = a * a - b * b + re, 2 * a * b + im
            if not a * a + b * b <= 4:
                return n
        return 40

    want = {(k, x, y): plain(x, y, re, im) for k, re, im in numbers if re is not None for x in range(9) for y in range(7)}
    assert {(r.k, r.x, r.y): r.steps for r in px.collect()} == want
    # no step is a row's own expression
    assert "ArrowEvalPython" in px._jdf.queryExecution().executedPlan().toString()


def test_places_of_values_that_stand_once_twice_and_within_others(spark):
    """Whether a value is looked up or found by a second pass, its place is the match's; no pass compiles its pattern for each text."""
    rng = random.Random(7)
    words = ["ab1", "ab12", "xab1", "ab1 ", "é", "😀", "\n", " ", "ab3.", "İ", "ab1ab1"]
    rows = [(i, "".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(400)] + [(400, "ab5 " * 3000), (401, None), (402, "")]
    texts = spark.createDataFrame(rows, "n long, text string")
    pattern = r"(?dimU)\bab\d\b"
    got = texts.select("n", F.inline(extract.occurrences("c", pattern))).groupBy("n").agg(F.sort_array(F.collect_list(F.struct("position", "value"))).alias("m"))
    want = {n: [(m.start(), m[0]) for m in re.finditer(r"\bab\d\b", t or "", re.I | re.M)] for n, t in rows}
    assert {r.n: [tuple(x) for x in r.m] for r in got.collect()} == {n: m for n, m in want.items() if m}
    assert "split(" not in texts.select(extract.occurrences("c", pattern))._jdf.queryExecution().optimizedPlan().toString()
