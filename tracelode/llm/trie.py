"""Prefix trie of conversations by parallel tree contraction.

A node is a distinct sequence of first d turns (role, text), known by its depth and the XOR of two 64-bit hashes of each turn with its
place. The running XOR of a conversation's turns gives all its nodes, and a node's parent is its own XOR without its last turn: no
sequence is gathered, a conversation may be of any length.

Totals of subtrees come from contraction, in rounds of joins over what is left of the tree. A round rakes all leaves (their totals are
final, their parents add them up), then compresses unary chains: a node with one child left goes if its coin is 1 and its child's 0, and the child
takes its place, with what stood above it. Neighbours never go together, since the coins differ. In the first rounds the coin is a bit of the depth, so
that a chain halves each time; after as many rounds as the deepest node's depth has bits it is a bit of a hash, a new one each round, which
contracts any other shape as well. What goes is written with its round; when the root alone is left, the rounds are read backwards, and a
node that was compressed gets its total from the child that took its place: the child's, and what was noted. Every round reads
and writes what is left, so all of them together cost about as much as the first few.

A node keeps the XOR of its children's numbers and depths: of an only child these are its own, so a node knows whether it goes without a join.

The digest of the ids that end at a node is one stream over these ids in order: they are range-sorted and put together in pieces of
a bounded size first, so that a node at which very many conversations end is sorted over many tasks, and its one row reads only the pieces.

Edge cases: null role and text are empty; turns are ordered by turn (null first), then role and text, and repeated rows are
turns of their own; rows with a null conversation id take no part; a conversation without turns ends at the root; very long
texts count by their length alone; an empty table has no node. Further columns are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running, sorted_pieces
from .common import cut

#: Ids in a piece of the list of those that end at a node.
PIECE = 4096
KEY = ("depth", "a", "b")


def _turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, tie, x, y (hashes of role and text), size (code points); tie is the text where another row has the conversation and turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    tied = rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("of"), F.col("turn").alias("at"))
    if tied.isEmpty():  # the usual case: no text is moved
        rows = rows.withColumn("tie", F.lit(""))
    else:
        rows = rows.join(tied, (F.col("conv_id") == F.col("of")) & F.col("turn").eqNullSafe(F.col("at")), "left").withColumn("tie", F.when(F.col("of").isNotNull(), F.col("text")).otherwise(""))
    return rows.select("conv_id", "turn", "role", "tie", F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit("turn"), "text", "role").alias("y"), F.length("text").cast("long").alias("size"))


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 1), x, y, size of every turn."""
    return cut(running(_turns(rows), ["conv_id"], [F.col("turn"), F.col("role"), F.col("tie")]).select("conv_id", F.col("__no").alias("place"), "x", "y", "size"))


def rebuilt(own: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that share their beginnings: c starts with the first h turns of c - c % `every`, h = crc32(c) % `most`, and goes on with its own after its first h.

    `own` is what `numbered` gives. (The same columns of the rebuilt ones; conv_id of all conversations.)"""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = F.col("conv_id") - F.col("conv_id") % every
    convs = cut(own.groupBy("conv_id").agg(F.count("*").alias("turns")).select("conv_id", "turns", base.alias("base"), h.alias("h")))
    lenders = convs.where("conv_id = base").select(F.col("conv_id").alias("of"), F.least("turns", F.lit(most - 1)).alias("has"))
    convs = cut(convs.join(lenders, F.col("base") == F.col("of"), "left").select("conv_id", "base", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("lent")))
    # most - 1 turns at most of each conversation that others begin with
    heads = own.where((F.col("conv_id") % every == 0) & (F.col("place") < most)).select(F.col("conv_id").alias("of"), "place", "x", "y", "size")
    begun = convs.join(heads, (F.col("base") == F.col("of")) & (F.col("place") <= F.col("lent"))).select("conv_id", "place", "x", "y", "size")
    rest = own.join(convs.select(F.col("conv_id").alias("of"), "h", "lent"), (F.col("conv_id") == F.col("of")) & (F.col("place") > F.col("h")))
    return begun.unionAll(rest.select("conv_id", (F.col("place") - F.col("h") + F.col("lent")).alias("place"), "x", "y", "size")), convs.select("conv_id")


def steps(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, a, b (the node), pa, pb (its parent, null for the root), size (of its last turn), ends (whether the conversation ends there): a row for each conversation and node on its way."""
    placed = turns.select("conv_id", "place", "size", F.xxhash64("place", "x", "y").alias("a"), F.xxhash64("y", "place", "x").alias("b"))
    at = running(placed, ["conv_id"], [F.col("place")], ("a", "b"))
    way = at.select("conv_id", F.col("place").alias("depth"), F.col("a__run").alias("a"), F.col("b__run").alias("b"), F.col("a__run").bitwiseXOR(F.col("a")).alias("pa"), F.col("b__run").bitwiseXOR(F.col("b")).alias("pb"), "size")
    last = way.groupBy("conv_id").agg(F.max("depth").alias("last")).withColumnRenamed("conv_id", "of")
    way = way.join(last, F.col("conv_id") == F.col("of")).select(*way.columns, (F.col("depth") == F.col("last")).alias("ends"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    start = convs.join(last, F.col("conv_id") == F.col("of"), "left").select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), none.alias("pa"), none.alias("pb"), zero.alias("size"), F.col("last").isNull().alias("ends"))
    return cut(way.unionAll(start))


def _streamed(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """`key` and ends_sha256 of rows (key, conv_id)."""
    fields = ", ".join(f"{k} long" for k in key)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, first = None, [], 0
        out: list[list] = [[] for _ in range(len(key) + 2)]

        def put() -> None:
            for column, v in zip(out, (*now, first, ",".join(map(str, held))), strict=True):
                column.append(v)

        def flushed() -> pa.RecordBatch:
            batch = pa.record_batch([*(pa.array(c, pa.int64()) for c in out[:-1]), pa.array(out[-1], pa.string())], names=[*key, "first", "ids"])
            for c in out:
                c.clear()
            return batch

        for b in batches:
            for *k, c in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                if now != k or len(held) >= PIECE:
                    if now is not None:
                        put()
                    now, held, first = k, [], c
                held.append(c)
            if len(out[0]) >= 200:
                yield flushed()
        if now is not None:
            put()
        yield flushed()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for b in batches:
            out: list[list] = [[] for _ in range(len(key) + 1)]

            def put(out: list[list] = out) -> None:
                for column, v in zip(out, (*now, sha.hexdigest()), strict=True):
                    column.append(v)

            for *k, _, ids in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                if now != k:
                    if now is not None:
                        put()
                    now, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.record_batch([*(pa.array(c, pa.int64()) for c in out[:-1]), pa.array(out[-1], pa.string())], names=[*key, "ends_sha256"])
        if now is not None:
            yield pa.record_batch([*(pa.array([v], pa.int64()) for v in now), pa.array([sha.hexdigest()])], names=[*key, "ends_sha256"])

    sorted_ids = sorted_pieces(rows.select(*key, "conv_id"), list(key), [F.col("conv_id")])
    in_pieces = sorted_ids.mapInArrow(pieces, f"{fields}, first long, ids string")
    return in_pieces.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digests, f"{fields}, ends_sha256 string")


def nodes(way: DataFrame) -> DataFrame:
    """id, up (id of the parent, null for the root), conv_id, depth, parent_conv_id, n_convs, size, n_children, kids (XOR of the children's ids), kid_depths, ends_sha256."""
    ends = _streamed(way.where("ends"), KEY).select(F.col("depth").alias("d"), F.col("a").alias("ea"), F.col("b").alias("eb"), "ends_sha256")
    own = way.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    own = cut(own.withColumn("id", F.monotonically_increasing_id()))
    over = own.select(F.col("id").alias("up"), F.col("depth").alias("pd"), F.col("a").alias("oa"), F.col("b").alias("ob"), F.col("conv_id").alias("parent_conv_id"))
    linked = cut(own.join(over, (F.col("depth") == F.col("pd") + 1) & (F.col("pa") == F.col("oa")) & (F.col("pb") == F.col("ob")), "left"))
    kids = linked.where("up is not null").groupBy("up").agg(F.count("*").alias("n_children"), F.bit_xor("id").alias("kids"), F.bit_xor("depth").alias("kid_depths")).withColumnRenamed("up", "of")
    both = linked.join(kids, F.col("id") == F.col("of"), "left").join(ends, (F.col("depth") == F.col("d")) & (F.col("a") == F.col("ea")) & (F.col("b") == F.col("eb")), "left")
    zero = F.lit(0).cast("long")
    return cut(both.select(
        "id", "up", "conv_id", "depth", "parent_conv_id", "n_convs", "size", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("kids", zero).alias("kids"), F.coalesce("kid_depths", zero).alias("kid_depths"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    ))


def _coin(ident: str, depth: str, turn: int, bits: int) -> Column:
    """1: the upper node of a chain's edge goes, if the lower one's coin is 0."""
    return (1 - F.shiftright(depth, turn).bitwiseAND(F.lit(1))) if turn < bits else F.xxhash64(F.lit(turn), ident).bitwiseAND(F.lit(1))


def totals(tree: DataFrame, values: tuple[str, ...], most: int = 400) -> DataFrame:
    """id and, for each column of values (longs), its sum over the subtree: of a tree with columns id, up, depth, n_children, kids, kid_depths and the values."""
    zero = F.lit(0).cast("long")
    # _top: what stood between a node and its parent and is gone
    alive = cut(tree.select("id", "up", "depth", F.col("n_children").alias("n"), "kids", "kid_depths", *values, *(zero.alias(f"{v}_top") for v in values)))
    bits = int(alive.agg(F.max("depth")).first()[0] or 0).bit_length()
    changed, raked, gone = None, [], []
    for turn in range(most):
        # rake: leaves go, and what the last compression changed below a node reaches it as well
        leaf = (F.col("n") == 0) & F.col("up").isNotNull()
        told = alive.where(leaf).select("up", F.lit(1).cast("long").alias("less"), F.col("id").alias("x"), F.col("depth").alias("y"), *((F.col(v) + F.col(f"{v}_top")).alias(f"{v}_in") for v in values))
        told = told if changed is None else told.unionAll(changed.select("up", zero.alias("less"), "x", "y", *(zero.alias(f"{v}_in") for v in values)))
        told = told.groupBy(F.col("up").alias("of")).agg(F.sum("less").alias("less"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), *(F.sum(f"{v}_in").alias(f"{v}_in") for v in values))
        rest = alive.where(~leaf).join(told, F.col("id") == F.col("of"), "left")
        rest = cut(rest.select(
            "id", "up", "depth", (F.col("n") - F.coalesce("less", zero)).alias("n"), F.col("kids").bitwiseXOR(F.coalesce("x", zero)).alias("kids"), F.col("kid_depths").bitwiseXOR(F.coalesce("y", zero)).alias("kid_depths"),
            *((F.col(v) + F.coalesce(f"{v}_in", zero)).alias(v) for v in values), *(f"{v}_top" for v in values),
        ))
        raked.append(alive.where(leaf).select("id", *values))
        if rest.where("up is not null").isEmpty():
            raked.append(rest.select("id", *values))
            break
        # compress: whether a node goes can be told from its own row; its child then takes its place
        goes = F.coalesce((F.col("n") == 1) & F.col("up").isNotNull() & (_coin("id", "depth", turn, bits) == 1) & (_coin("kids", "kid_depths", turn, bits) == 0), F.lit(False))
        out = rest.where(goes).select(F.col("id").alias("over"), F.col("up").alias("over_up"), F.col("depth").alias("over_depth"), *(F.col(v).alias(f"{v}_own") for v in values), *(F.col(f"{v}_top").alias(f"{v}_before") for v in values))
        both = cut(rest.where(~goes).join(out, F.col("up") == F.col("over"), "left"))
        heir = both.where("over is not null")
        gone.append(heir.select(F.col("over").alias("id"), F.col("id").alias("below"), *((F.col(f"{v}_own") + F.col(f"{v}_top")).alias(v) for v in values)))
        changed = heir.select(F.col("over_up").alias("up"), F.col("id").bitwiseXOR(F.col("over")).alias("x"), F.col("depth").bitwiseXOR(F.col("over_depth")).alias("y"))
        alive = both.select("id", F.when(F.col("over").isNull(), F.col("up")).otherwise(F.col("over_up")).alias("up"), "depth", "n", "kids", "kid_depths", *values, *((F.col(f"{v}_top") + F.coalesce(F.col(f"{v}_own") + F.col(f"{v}_before"), zero)).alias(f"{v}_top") for v in values))
    else:
        raise RuntimeError(f"the tree was not contracted in {most} rounds")
    # re-expansion: a compressed node's total is its note and the total of the child that took its place, which went in a later round.
    # Followed by doubling: nodes of all rounds at once, each time twice as far
    n = int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    solved = cut(reduce(DataFrame.unionAll, raked).coalesce(n))
    if not gone:
        return solved
    still, known = cut(reduce(DataFrame.unionAll, gone).coalesce(n)), [solved]
    while True:
        look = reduce(DataFrame.unionAll, known).select("id", F.lit(None).cast("long").alias("below"), *values).unionAll(still.select("id", "below", *values))
        look = look.select(F.col("id").alias("of"), F.col("below").alias("further"), *(F.col(v).alias(f"{v}_of") for v in values))
        next_ = cut(still.join(look, F.col("below") == F.col("of")).select("id", F.col("further").alias("below"), *((F.col(v) + F.col(f"{v}_of")).alias(v) for v in values)))
        known.append(next_.where("below is null").select("id", *values))
        still = next_.where("below is not null")
        if still.isEmpty():
            return reduce(DataFrame.unionAll, known)


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (code points that members share with the first, over the subtree), ends_sha256.

    `turns`: conv_id, place, x, y, size, as `numbered` gives them; `convs`: conv_id of all, those without turns too."""
    tree = nodes(steps(turns, convs)).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("size")).withColumn("n_leaves", (F.col("n_children") == 0).cast("long"))
    total = totals(tree, ("n_leaves", "saved_tokens")).withColumnRenamed("id", "of") if not tree.isEmpty() else tree.select(F.col("id").alias("of"), "n_leaves", "saved_tokens")
    return tree.drop("n_leaves", "saved_tokens").join(total, F.col("id") == F.col("of")).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(rows: DataFrame) -> DataFrame:
    """The trie of the conversations in rows conv_id, turn, role, text as they are."""
    own = numbered(rows)
    return trie(own, own.select("conv_id").distinct())


def rebuilt_trie(rows: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(*rebuilt(numbered(rows), every, most))
