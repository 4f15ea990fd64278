"""Mixing sources to target weights along a time-varying curriculum.

Sizes are words. Each source has a target: its weight's share of all words, at most `cap` times its own size, what
exceeds that being dealt again by weight (water filling over one row per source). Each source also has a schedule, a
piecewise-linear weight over training time 0 to 1. Its integral, scaled to the source's target, is the source's
cumulative demand; a document copy that stands at some share of what the source gives takes the training position at
which the cumulative demand reaches that share. Documents are then sorted by position.

Within a source, documents stand in the order of a hash of id and text. Whole passes come first; the rest of the target is met by a
last pass that stops at a hash value. That value comes from four histograms of 1024 bins each, every one within the bin of
the one before in which the rest ends. Where several rows have the very hash at which it stops (rows that repeat each other), so many of
them are taken as the rest asks, by a number that they get in a distributed rank of these rows alone. No source is ever sorted or held in one place, and
whether a document is taken depends on its own row and its source's one row. Nothing depends on how the table is partitioned. What is computed per source goes through one task where sources are ranked: a row for each.

Edge cases: null text has size 0; very long texts count whole; a null source is a source of its own, last; a document of size 0
is taken along with its pass but takes no words; in a source without words every document stands once. Of rows with equal ids
and texts so many are taken as the target asks, no matter which. An empty table gives an empty result. Further columns
pass through `mix`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import running
from .common import cut, shielded, word_count

BINS = 1024
WEIGHTS = (5.0, 2.0, 1.0)
#: Schedule of each source, repeating like the weights: knots (time, relative weight).
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)))


def hashed(doc_id: Column, text: Column) -> Column:
    """40 bits of id and text that order the documents of a source, whatever the number of partitions; rows that repeat each other have the same."""
    return F.xxhash64(doc_id.cast("string"), F.lit("mixing"), text).bitwiseAND(F.lit(BINS**4 - 1))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """One row per source: source, place (its rank by code point, null last), source_size, target."""
    place = Window.orderBy(F.col("source").asc_nulls_last())  # over one row per source
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("place", F.row_number().over(place) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("full_at", F.col("most") / F.col("weight"))
    every, upto = Window.partitionBy(), Window.orderBy("full_at", "place").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("all", F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
    s = s.withColumn("left", F.col("all") - F.coalesce(F.sum("most").over(upto), F.lit(0.0))).withColumn("rest", F.col("weights") - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    s = s.withColumn("full", F.col("full_at") * F.col("rest") <= F.col("left"))
    # the level: words for each unit of weight, over the sources that are not full
    level = s.agg((F.max("all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))), F.lit(0.0))).alias("words"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("open"))
    level = level.select((F.col("words") / F.col("open")).alias("level"))
    return s.crossJoin(F.broadcast(level)).select("source", "place", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight"))).alias("target"))


def _histogram(rows: DataFrame, bin_of: Column, name: str) -> DataFrame:
    """source, and the words in each of the BINS bins as an array."""
    one = rows.groupBy("source", bin_of.alias("bin")).agg(F.sum("size").alias("words"))
    held = one.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("bin", "words"))).alias("m"))
    return held.select("source", F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("long")), F.lit(0).cast("long"))).alias(name))


def _running(words: Column) -> Column:
    """Cumulative sums, with a leading 0."""
    return F.aggregate(words, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def _few(plans: DataFrame) -> DataFrame:
    """A row for each source: broadcast if all of them take 64 MB at most."""
    return F.broadcast(plans) if plans.count() * 10 * BINS <= 64 << 20 else plans


def plan(sized: DataFrame, weights: tuple = WEIGHTS, cap: float = 3.0, schedules: tuple = SCHEDULES) -> DataFrame:
    """One row per source with its target, whole passes, the hash at which the last pass stops, the words before each bin and its schedule.

    `sized` has source, size and h."""
    s = targets(sized, weights, cap)
    s = s.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1).cast("long"))
    s = s.withColumn("rest", F.when(F.col("source_size") > 0, F.col("target") - F.col("passes") * F.col("source_size")).otherwise(0.0))
    s = s.withColumnRenamed("source", "of").join(_histogram(sized, F.shiftright("h", 30), "bins"), F.col("of").eqNullSafe(F.col("source"))).drop("of")
    knots = F.array(*(F.array(*(F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in k)) for k in schedules))
    s = s.withColumn("before", _running(F.col("bins"))).withColumn("knots", F.element_at(knots, (F.col("place") % len(schedules) + 1).cast("int")))
    # the bin in which the rest ends: the last that begins at or before it
    first = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.size(F.filter("before", lambda x: x <= F.col("rest"))) - 1))
    s = cut(s.withColumn("at", first.cast("long")).withColumn("left", F.col("rest") - F.element_at("before", first + 1)))
    near = s.select(F.col("source").alias("of"), "at", "left")
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    for shift in (20, 10, 0):
        rows = sized.join(_few(near), F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("h", shift + 10) == F.col("at")))
        one = rows.groupBy("source", F.shiftright("h", shift).alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.first("left").alias("left"))
        one = one.withColumn("start", F.coalesce(F.sum("words").over(upto), F.lit(0)))
        if shift:
            last = F.max_by(F.struct("bin", (F.col("left") - F.col("start")).alias("left")), F.when(F.col("start") <= F.col("left"), F.col("bin")))
            near = cut(one.groupBy("source").agg(last.alias("l")).select(F.col("source").alias("of"), F.col("l.bin").alias("at"), "l.left"))
    # of the rows of the hash in which the rest ends so many are taken as come nearest to it
    last = F.max_by(F.struct("bin", "words", "rows", (F.col("left") - F.col("start")).alias("left")), F.when(F.col("start") <= F.col("left"), F.col("bin")))
    ends = one.groupBy(F.col("source").alias("of")).agg(last.alias("l"))
    each = F.col("l.words") / F.col("l.rows")
    ends = ends.select("of", F.col("l.bin").alias("last_h"), F.col("l.rows").alias("alike"), F.when(each > 0, F.greatest(F.lit(0), F.least(F.col("l.rows"), F.ceil(F.col("l.left") / each - 0.5)))).otherwise(0).cast("long").alias("more"))
    s = s.join(ends, F.col("source").eqNullSafe(F.col("of")), "left")
    some, zero = F.col("rest") > 0, F.lit(0).cast("long")
    stop = F.when(some, F.coalesce("last_h", F.shiftleft("at", 30))).otherwise(zero)
    # where the one row, or all or none of several, are taken, no rank is needed
    return cut(s.select("source", "source_size", "target", "passes", stop.alias("last_h"), F.when(some, F.coalesce("alike", zero)).otherwise(zero).alias("alike"), F.when(some, F.coalesce("more", zero)).otherwise(zero).alias("more"), "before", "knots"))


def position(share: Column, knots: Column) -> Column:
    """The time at which the schedule's integral reaches this share of its whole."""
    area = F.transform(F.sequence(F.lit(1), F.size(knots) - 1), lambda i: (F.element_at(knots, i + 1)["t"] - F.element_at(knots, i)["t"]) * (F.element_at(knots, i + 1)["w"] + F.element_at(knots, i)["w"]) / 2)
    whole = F.aggregate(area, F.lit(0.0), lambda a, x: a + x)
    # folds over the pieces: what is left of the wanted area, and the time reached
    begin = F.struct((share * whole).alias("left"), F.lit(0.0).alias("t"))

    def step(acc: Column, i: Column) -> Column:
        a, b, own = F.element_at(knots, i), F.element_at(knots, i + 1), F.element_at(area, i)
        width, slope = b["t"] - a["t"], (b["w"] - a["w"]) / (b["t"] - a["t"])
        # w x + slope x^2 / 2 = left, in the form that stays exact for a slope near 0
        x = F.when(acc["left"] >= own, width).otherwise(2 * acc["left"] / (a["w"] + F.sqrt(F.greatest(F.lit(0.0), a["w"] * a["w"] + 2 * slope * acc["left"]))))
        done = acc["left"] <= 0
        return F.struct(F.when(done, acc["left"]).otherwise(acc["left"] - own).alias("left"), F.when(done, acc["t"]).otherwise(a["t"] + F.coalesce(x, F.lit(0.0))).alias("t"))

    return F.aggregate(F.sequence(F.lit(1), F.size(knots) - 1), begin, step)["t"]


def taken(docs: DataFrame, plans: DataFrame) -> DataFrame:
    """The rows of `docs` (with columns __size and __h) and __source_size, __target, __copies, __positions (one for each copy)."""
    p = plans.select(*(F.col(c).alias(f"__{c}") for c in plans.columns))
    rows = docs.join(_few(p), F.col("source").eqNullSafe(F.col("__source")))
    below = F.when(F.col("__h") < F.col("__last_h"), 1).otherwise(0)
    at_end = (F.col("__h") == F.col("__last_h")) & (F.col("__more") > 0)
    parted = (F.col("__h") == F.col("__last_h")) & (F.col("__more") > 0) & (F.col("__more") < F.col("__alike"))
    whole = rows.withColumn("__copies", F.col("__passes") + below + F.when(at_end, 1).otherwise(0))
    if plans.where("more > 0 and more < alike").isEmpty():
        rows = whole
    else:
        ranked = running(rows.where(parted), ["__source"], [F.col("__h")])
        ranked = ranked.withColumn("__copies", F.col("__passes") + F.when(F.col("__no") <= F.col("__more"), 1).otherwise(0)).drop("__no")
        rows = whole.where(~parted).unionAll(ranked.select(*whole.columns))
    bin_ = F.shiftright("__h", 30).cast("int")
    low, high = F.element_at("__before", bin_ + 1), F.element_at("__before", bin_ + 2)
    at = low + (high - low) * ((F.col("__h").bitwiseAND(F.lit((1 << 30) - 1)) + 0.5) / (1 << 30))  # words of the source before this document, within a bin by its hash
    share = lambda k: F.when(F.col("__target") > 0, F.least(F.lit(1.0), (k * F.col("__source_size") + at) / F.col("__target"))).otherwise(F.lit(0.0))
    each = F.transform(F.when(F.col("__copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)).otherwise(F.array().cast("array<bigint>")), lambda k: position(share(k), F.col("__knots")))
    return rows.withColumn("__positions", each).drop("__source", "__passes", "__last_h", "__alike", "__more", "__before", "__knots", "__h")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hashed(F.col("doc_id"), F.col("text")).alias("h"))


def mixture(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words), positions (of its copies, rising); sorted by the first position, what isn't taken last."""
    s = cut(sized(docs))
    out = taken(s.withColumnsRenamed({"size": "__size", "h": "__h"}), plan(s, **how)).orderBy(F.try_element_at("__positions", F.lit(1)).asc_nulls_last(), "doc_id")
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"), F.col("__positions").alias("positions"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The documents as training meets them: each taken copy a row with the columns of `docs`, sorted by position.

    What the plan needs is read first (source, size and hash); the rows themselves are shuffled once, by range."""
    own, named = shielded(docs)
    doc_id, source, text = (F.col(named[c]) for c in ("doc_id", "source", "text"))
    rows = own.select(*own.columns, source.alias("source"), hashed(doc_id, text).alias("__h"))
    plans = plan(cut(sized(own.select(doc_id.alias("doc_id"), source.alias("source"), text.alias("text")))), **how)
    each = taken(rows, plans).withColumn("__at", F.explode("__positions"))
    return each.orderBy("__at", F.xxhash64(doc_id.cast("string")), doc_id).select(*own.columns).toDF(*docs.columns)
