"""The pipeline's stages against plain versions of what each must do."""

import os
import random
import shutil

import corpus_pipeline
from pyspark.sql import functions as F

from tracelode.llm import decontaminate, quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing", "token-ID output"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before, now = now, stage(spark, now, SF)
        now = spark.createDataFrame(now.collect(), docs.schema)
        assert now.columns == docs.columns
        ids = [r.doc_id for r in now.collect()]
        if k == 0:
            assert all(i in ids for i, q in labels.items() if q == 1) and sum(i in ids for i, q in labels.items() if q == 0) <= 0.25 * sum(q == 0 for q in labels.values())
        if k == 1:
            groups = {r.doc_id: r.component_id for r in simhash.simhash_groups(before).collect()}
            assert sorted(ids) == sorted(i for i, c in groups.items() if i == c)
        if k == 2:
            bad = {r.doc_id for r in decontaminate.leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert sorted(ids) == sorted(r.doc_id for r in before.collect() if r.doc_id not in bad)
        if k == 3:
            assert set(ids) <= {r.doc_id for r in before.collect()}
    assert corpus_pipeline.run(spark, SF).agg(F.sum("n_tokens")).first()[0] > 0
    assert quality.FEATURES


def test_stages_on_messy_and_empty_tables(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, clashing names: nothing crashes, and what may stay stays."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, key int, a int, b int, __at int, __file int, doc_ids int"
    plain = " ".join(f"word{i % 23} and then" for i in range(60))
    texts = [(1, plain), (1, plain + " other " * 30), (2, plain), (None, "no id " + plain[::-1]), (None, None), (3, None), (4, ""), (5, "x" * 50_000), (6, plain), (6, plain)]
    rows = [(i, t, None, None if k % 3 == 0 else "s", None, 1, 2, 3, 4, 5, 6) for k, (i, t) in enumerate(texts)]
    folder = str(tmp_path / "sf")
    spark.createDataFrame(rows, kind).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        assert docs.count() > 0
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.run(spark, folder).count() > 0
    none = str(tmp_path / "none")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{none}/{name}.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0


def test_packing_keeps_the_order_of_unequal_files(spark, tmp_path):
    """Files of rising size, which reading takes largest first: packed rows still rise with the position."""
    folder, start, rng = str(tmp_path / "mixed"), 0, random.Random(3)
    for k, n in enumerate((20, 60, 150, 400)):
        rows = [(start + i, " ".join(str(rng.random()) for _ in range(40))) for i in range(n)]
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / f"one{k}"))
        os.makedirs(folder, exist_ok=True)
        shutil.copy(next((tmp_path / f"one{k}").glob("part-*.parquet")), f"{folder}/part-{k:05d}.parquet")
        start += n
    confs = {"spark.sql.files.maxPartitionBytes": "40k", "spark.sql.files.openCostInBytes": "0", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in confs}
    try:
        for c, v in confs.items():
            spark.conf.set(c, v)
        got = corpus_pipeline.packed(spark, spark.read.parquet(folder), SF).select("pack_id", "doc_ids").collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    parts = {}
    for r in got:
        parts.setdefault(r.pack_id >> 33, []).extend(r.doc_ids)
    spans = [(min(parts[p]), max(parts[p])) for p in sorted(parts)]
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert sorted(set(sum(parts.values(), []))) == list(range(start))
