"""Benchmark decontamination by spaced seeds, with DataFrame functions alone.

A document holds a passage of an item if, with the document's tokens laid against the item's on some diagonal, there is a stretch that begins and
ends with agreeing tokens, in which `least` (13) agree at least, and these are `share` (70) percent of the stretch at least. Any fourth word
may so be another. Function words alone, in sentences of the same frame, agree in fewer places.

A seed is a fixed mask over tokens; positions at 0 are ignored. The masks, of weight 5, miss no such passage: in any
sequence of agreeing and other places that has none of them, each stretch with 13 agreeing places has under 70 percent of them. (A test walks
through all sequences.) Items of 5 to 12 tokens have no stretch of 13: of these 80 percent must agree, and masks of
weight 4 miss none of them. Items of fewer tokens hold no passage: a document leaks one only if it consists of it.

Items are hashed at every position under every mask; documents likewise. Documents meet the items by an equality join on
the hash. A hit whose preceding place on the diagonal agrees under the mask as well is left to that one, so a copied passage is verified once a mask,
not once a token; the hit is then verified over the whole diagonal.

The items' hashes are broadcast, each with its item's tokens, if that takes at most `most` bytes (summed up first). Beyond
that the join shuffles by hash, with ids and positions alone on either side; the tokens come back to one hit of each diagonal by a join on
the document and its tokens' hash.

Tokens are runs of letters and digits, lower-cased. Null or empty
texts have no tokens. Very long texts are compared at every position, in rows of their own. Repeated rows give one link; rows
with a null doc_id give links with a null doc_id. An empty table on either side gives no links. Further columns are not read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, shielded

#: Of items of 13 tokens and more, and of shorter ones. Masks begin and end with 1.
MASKS = ("1111", "11101", "11011")
SHORT_MASKS = ("1111", "11011", "10111", "11101")
LEAST, SHARE, SHORTEST = 13, 70, 5
BROADCAST_BYTES = 128 << 20


def tokens(text: Column) -> Column:
    """Hashes of the tokens, in order."""
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def seeds(mask_no: int, mask: str, at: Column, toks: str = "toks") -> Column:
    """The hash of the tokens from position `at` (from 0) under a mask."""
    return F.xxhash64(F.lit(mask_no), *(F.get(toks, at + k) for k, kept in enumerate(mask) if kept == "1"))


def _windows(rows: DataFrame, masks: tuple[str, ...], keep: list[str], first: int) -> DataFrame:
    """`keep`, at, mask (its number in `masks`) and seed, for every position of every row under every mask that ends within it; masks are numbered from `first`."""
    n = min(map(len, masks))
    places = F.when(F.size("toks") >= n, F.sequence(F.lit(0), F.size("toks") - n))  # null, so no row, for fewer than n tokens
    each = rows.select(*keep, F.explode(places).alias("at"))
    # a null seed meets nothing
    own = (F.when(F.col("at") + len(m) <= F.size("toks"), seeds(first + k, m, F.col("at"))) for k, m in enumerate(masks))
    return each.select(*keep, "at", F.posexplode(F.array(*own)).alias("mask", "seed"))


def _meet(d: DataFrame, mine: DataFrame, own: tuple[str, ...], first: int) -> DataFrame:
    """A hit (doc_id, toks, at, item_id, item_toks, item_at) of each diagonal by a shuffle of hashes, for items that are too many to broadcast."""
    keyed = d.withColumn("key", F.xxhash64("toks"))
    ours = _windows(keyed, own, ["doc_id", "key", "toks"], first).select("doc_id", "key", "at", "seed")
    theirs = _windows(mine, own, ["item_id", "toks"], first).select("item_id", F.col("at").alias("item_at"), F.col("seed").alias("item_seed"))
    met = ours.join(theirs, F.col("seed") == F.col("item_seed")).select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"), F.col("item_id").alias("hit"), "at", (F.col("at") - F.col("item_at")).alias("diagonal"))
    hits = met.groupBy("of", "of_key", "hit", "diagonal").agg(F.min("at").alias("at")).withColumn("item_at", F.col("at") - F.col("diagonal"))
    hits = hits.join(mine.select("item_id", F.col("toks").alias("item_toks")), F.col("hit").eqNullSafe(F.col("item_id")))
    return hits.join(keyed, (F.col("of_key") == F.col("key")) & F.col("of").eqNullSafe(F.col("doc_id")))


def _carried_on(masks: tuple[str, ...]) -> Column:
    """Whether a hit's mask agrees one place earlier as well: column mask has its number among `masks`."""
    same = lambda k: F.coalesce(F.get("toks", F.col("at") - 1 + k) == F.get("item_toks", F.col("item_at") - 1 + k), F.lit(False))
    whole = [reduce(lambda a, b: a & b, (same(k) for k, kept in enumerate(m) if kept == "1")) for m in masks]
    return (F.col("at") > 0) & (F.col("item_at") > 0) & reduce(lambda when, k: when.when(F.col("mask") == k, whole[k]), range(1, len(masks)), F.when(F.col("mask") == 0, whole[0]))


def _dense(places: Column, least: int, share: int) -> Column:
    """Whether some stretch from one of the rising places to another holds at least so many of them, and so large a share.

    With g(k) = 100 k - share * place(k), the stretch from the i-th to the j-th has the share if g(j) - g(i) >= share - 100."""
    g = lambda k: 100 * k - F.lit(share) * F.get(places, k)
    begin = F.struct(g(F.lit(0)).cast("int").alias("low"), F.lit(False).alias("ok"))

    def step(acc: Column, j: Column) -> Column:
        low = F.least(acc["low"], g(j - (least - 1)).cast("int"))
        return F.struct(low.alias("low"), (acc["ok"] | (g(j) - low >= share - 100)).alias("ok"))

    return (F.size(places) >= least) & F.aggregate(F.sequence(F.lit(least - 1), F.greatest(F.lit(least - 1), F.size(places) - 1)), begin, step)["ok"]


def leaks(docs: DataFrame, items: DataFrame, least: int = LEAST, share: int = SHARE, masks: tuple[str, ...] = MASKS, most: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id, agreeing (tokens on the best diagonal), item_tokens: a row for each document and item of which it holds a passage."""
    test = items.select("item_id", tokens(F.col("text")).alias("toks")).where(F.size("toks") >= 1)
    d = docs.select("doc_id", tokens(F.col("text")).alias("toks"))
    size = F.size("toks")
    whole = test.where(size < SHORTEST).select("item_id", F.col("toks").alias("item_toks"))
    out = [d.where(size < SHORTEST).join(whole, F.col("toks") == F.col("item_toks")).select("doc_id", "item_id", size.alias("agreeing"), size.alias("item_tokens"))]
    kinds = [(masks, 0, size >= least)]
    if not test.where((size >= SHORTEST) & (size < least)).isEmpty():
        kinds.append((SHORT_MASKS, 1000, (size >= SHORTEST) & (size < least)))
    for own, first, which in kinds:
        mine = test.where(which)
        # a row for each position and mask: 8 bytes a token, and some for the rest
        bytes_ = mine.agg(F.coalesce(F.sum(F.size("toks").cast("long") * len(own) * (8 * F.size("toks") + 80)), F.lit(0))).first()[0]
        if bytes_ <= most:
            table = _windows(mine, own, ["item_id", "toks"], first).select("item_id", F.col("at").alias("item_at"), F.col("seed").alias("item_seed"), "mask", F.col("toks").alias("item_toks")).where("item_seed is not null")
            # compiled into the join, before a row is made of a hit: few pass
            hits = _windows(d, own, ["doc_id", "toks"], first).drop("mask").join(F.broadcast(table), F.col("seed") == F.col("item_seed")).where(~_carried_on(own))
        else:
            hits = _meet(d, mine, own, first)
        # the diagonal around the seed, as far as both reach; the texts' own tokens end here
        lead, tail = F.least("item_at", "at"), F.least(F.size("item_toks") - F.col("item_at"), F.size("toks") - F.col("at"))
        ours, theirs = F.slice("toks", F.col("at") - lead + 1, lead + tail), F.slice("item_toks", F.col("item_at") - lead + 1, lead + tail)
        places = F.filter(F.transform(F.zip_with(ours, theirs, lambda x, y: x == y), lambda e, i: F.when(e, i)), lambda i: i.isNotNull())
        hits = hits.select("doc_id", "item_id", F.size("item_toks").alias("item_tokens"), places.alias("places"))
        enough = F.size("places") >= F.ceil(F.col("item_tokens") * 0.8) if first else _dense(F.col("places"), least, share)
        # made by a generator: as a condition it would move into the join, whose stage then isn't compiled
        found = F.filter(F.array(F.struct(F.size("places").alias("agreeing"), "item_tokens", enough.alias("enough"))), lambda r: r["enough"])
        out.append(hits.select("doc_id", "item_id", F.inline(found)).select("doc_id", "item_id", "agreeing", "item_tokens"))
    return reduce(DataFrame.unionAll, out).groupBy("doc_id", "item_id").agg(F.max("agreeing").alias("agreeing"), F.max("item_tokens").alias("item_tokens"))


def drop_leaked(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of `docs` that hold no passage of an item, whatever their ids: rows are told apart by id and text."""
    rows, named = shielded(docs)
    key = row_key(F.col(named["doc_id"]), F.col(named["text"]))
    bad = leaks(rows.select(key.alias("doc_id"), F.col(named["text"]).alias("text")), items, **how).select(F.col("doc_id.a").alias("a"), F.col("doc_id.b").alias("b")).distinct()
    keyed = rows.withColumn("key", key).select("*", "key.a", "key.b").drop("key")
    return keyed.join(bad, ["a", "b"], "left_anti").drop("a", "b").toDF(*docs.columns)
