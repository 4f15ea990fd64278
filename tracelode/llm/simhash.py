"""SimHash near-duplicate groups by deletion-variant signatures.

Every text gets a 64-bit fingerprint: the majority, bit by bit, of the XXH64 hashes of its word shingles.
Fingerprints link when at most `distance` bits differ. Cut into `distance // 2 + 1` segments, two linked
fingerprints have a segment in which at most one bit differs. Each fingerprint is therefore indexed by every
segment as it is, and by every segment with one bit left out; a pair meets on an equal segment, or on the variant
without the one bit in which it differs. The variant's sides are told apart by that bit, so that an equality join
brings each pair together once for each such segment, and the join itself verifies the distance and keeps a pair at
its first such segment alone. Equal fingerprints are one node from the start: copies are never expanded into pairs.

Pairs that meet grow with the square of the distinct fingerprints, spread over 2^20 keys for each of 64 variants: about n^2 / 65,000
of n in random places (15 million for a million, which is little; 1.5 billion for 10 million). Pairs that link are all
written, m^2 / 2 for m distinct fingerprints that are all within the distance of each other.

Keys that very many edges share are few, and are joined by a broadcast of their own (bounded by a share of all edges); what is
joined back by component is written first, so that adaptive execution can split a large component. All other joins have sides that grow
with the documents and are merges by a hint: adaptive execution would otherwise broadcast a side of up to 10 MB of shuffled bytes, which
is a table of hundreds of megabytes in the driver.

Edge cases: null and empty texts have fingerprint zero and link like any other; very long texts are read whole, a batch of about
8 MB at a time; `simhash_groups` keeps repeated rows; rows with a null id take part, and the component's id is the smallest
non-null id (null if there is none); an empty table gives an empty table. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, pieces, row_key, shielded

SEED = 42


def fingerprint(text: str | bytes | None, shingle: int = 4) -> int:
    """The fingerprint of one text, unsigned."""
    raw = b"" if text is None else text.encode() if isinstance(text, str) else text
    words = raw.lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - shingle] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 255 * 64):  # sums of 255 rows fit in a byte
        bits = np.unpackbits(hashes[k : k + 255 * 64].view(np.uint8), bitorder="little").reshape(-1, 64)
        for j in range(0, len(bits), 255):
            ones += bits[j : j + 255].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """The columns of `docs` but its last, text, and fp (the fingerprint's 64 bits as a long)."""
    kept = docs.drop("text").schema
    names = [*kept.names, "fp"]
    rows = docs.select(*kept.names, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            *own, text = b.columns
            found = np.array([fingerprint(t, shingle) for t in text.cast(pa.large_binary()).to_pylist()], np.uint64)
            yield pa.record_batch([*own, pa.array(found.view(np.int64))], names=names)

    return rows.mapInArrow(run, T.StructType([*kept.fields, T.StructField("fp", T.LongType())]))


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of the segments, so many that linked fingerprints differ in one bit at most of some segment."""
    n = distance // 2 + 1
    at = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def links(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """u < v of the distinct fingerprints in column fp, for each two within `distance` bits."""
    cuts = segments(distance)
    bits = {s: F.shiftrightunsigned("fp", s[0]).bitwiseAND(F.lit((1 << s[1]) - 1)) for s in cuts}
    whole = F.array(*(F.struct(F.lit(k).alias("seg"), bits[s].alias("key")) for k, s in enumerate(cuts)))
    # a variant's key: the segment without the bit, and which bit that is
    variants = F.array(*(
        F.struct(F.lit(k).alias("seg"), F.lit(j).alias("bit"), bits[s].bitwiseAND(F.lit(~(1 << j))).alias("key"), F.shiftright(bits[s], j).bitwiseAND(F.lit(1)).alias("side"))
        for k, s in enumerate(cuts) for j in range(s[1])
    ))

    def near(x: str, y: str):
        return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= distance

    def first(x: str, y: str, seg: str):
        """Whether no earlier segment brings the pair together."""
        apart = F.col(x).bitwiseXOR(F.col(y))
        out = F.lit(True)
        for k, (a, n) in enumerate(cuts):
            out = out & ((F.col(seg) <= k) | (F.bit_count(F.shiftrightunsigned(apart, a).bitwiseAND(F.lit((1 << n) - 1))) > 1))
        return out

    # few bytes each, many variants: dealt out again, since adaptive execution puts small rows together
    nodes = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    a = nodes.select(F.col("fp").alias("u"), F.inline(whole))
    b = nodes.select(F.col("fp").alias("v"), F.inline(whole)).withColumnRenamed("seg", "seg2").withColumnRenamed("key", "key2")
    same = a.join(b.hint("merge"), (F.col("seg") == F.col("seg2")) & (F.col("key") == F.col("key2")) & (F.col("u") < F.col("v")) & near("u", "v") & first("u", "v", "seg")).select("u", "v")
    spread = nodes.select("fp", F.inline(variants))
    zero = spread.where("side = 0").select(F.col("fp").alias("u"), "seg", "bit", "key")
    one = spread.where("side = 1").select(F.col("fp").alias("v"), F.col("seg").alias("seg2"), F.col("bit").alias("bit2"), F.col("key").alias("key2"))
    apart = zero.join(one.hint("merge"), (F.col("seg") == F.col("seg2")) & (F.col("bit") == F.col("bit2")) & (F.col("key") == F.col("key2")) & near("u", "v") & first("u", "v", "seg"))
    return same.unionAll(apart.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))


def _by_key(rows: DataFrame, found: DataFrame, many: int | None) -> DataFrame:
    """`rows` joined with `found` (u, m, n: how many rows have that u) on u; keys of more than `many` rows, if there are any, by a broadcast."""
    if many is None:
        return rows.join(found.select("u", "m").hint("merge"), "u")
    hot = found.where(F.col("n") > many).select("u", "m")
    direct = rows.join(F.broadcast(hot), "u")
    rest = rows.join(F.broadcast(hot.select("u")), "u", "left_anti").join(found.where(F.col("n") <= many).select("u", "m").hint("merge"), "u")
    return direct.select(*rows.columns, "m").unionAll(rest.select(*rows.columns, "m"))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) of the undirected edges u, v, by alternating large and small stars.

    Every round is a minimum by key, combined before the shuffle, and a join on that key; its edges are written to
    the shared folder. Ends when what is left are stars: no node is both hub and leaf, none is a leaf of two hubs."""
    now = cut(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    for _ in range(most):
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("hub"), F.lit(0).alias("leaf")), F.struct(F.col("v").alias("node"), F.lit(0).alias("hub"), F.lit(1).alias("leaf")))).alias("e")).select("e.*")
        nodes = ends.groupBy("node").agg(F.max("hub").alias("hub"), F.sum("leaf").alias("leaf"), F.count("*").alias("n"))
        mixed, size, most_edges = nodes.agg(F.count_if((F.col("leaf") > 1) | ((F.col("leaf") > 0) & (F.col("hub") > 0))), F.sum("leaf"), F.max("n")).first()
        if not mixed:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        many = max(1000, size // 1000)  # so at most 2000 keys have more
        many = many if most_edges > many else None
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _by_key(both.where("v > u"), low, many).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))  # here v < u
        small = _by_key(large, low, many).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        now = cut(small.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    raise RuntimeError(f"components did not settle in {most} rounds")


def _rooted(prints: DataFrame, best: Column, distance: int) -> DataFrame:
    """fp, root and best (an aggregate of the rows of a fingerprint), a row for each distinct fingerprint."""
    nodes = cut(prints.groupBy("fp").agg(best.alias("best")))
    roots = components(links(nodes.select("fp"), distance))
    return nodes.join(roots.hint("merge"), nodes.fp == roots.node, "left").select("fp", "best", F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row of `docs`."""
    prints = cut(fingerprints(docs.select("doc_id", "text"), shingle))
    rooted = cut(_rooted(prints, F.min("doc_id"), distance))
    smallest = cut(rooted.groupBy("root").agg(F.min("best").alias("component_id")))
    named = rooted.join(smallest.hint("merge"), "root").select("fp", "component_id")
    return prints.join(named.hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """The rows of `docs` without all but one document of each group: that of the smallest doc_id, null ids last.

    A document is what has one doc_id and text: rows that repeat both stay once, rows that share the id alone are compared by
    text like any others. Texts are shuffled once, after repeated rows are put together within each partition."""
    rows, named = shielded(docs)
    own, text = F.col(named["doc_id"]), F.col(named["text"])
    prints = cut(fingerprints(rows.select(own.alias("doc_id"), row_key(own, text).alias("key"), text.alias("text")), shingle))
    rooted = _rooted(prints, F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")), distance)
    kept = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.key.a").alias("a"), F.col("best.key.b").alias("b"))
    keyed = rows.withColumn("key", row_key(own, text)).select("*", "key.a", "key.b").drop("key")
    return keyed.dropDuplicates(["a", "b"]).join(kept.hint("merge"), ["a", "b"], "left_semi").drop("a", "b").toDF(*docs.columns)
