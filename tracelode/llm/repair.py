"""Conversation structure repair by a rank-convergence parallel Viterbi.

A conversation's rows are edited at the least cost so that the roles' initials read `(s?(ua)+)?`: a row is kept (0), given the role
user or assistant (3) or deleted (4, forced for blank rows and duplicates), and empty texts of user or assistant are inserted anywhere (3);
a truncated row that isn't deleted adds 3. The automaton has four states, so a row is a 4 x 4 matrix of costs in the (min, +) algebra, and the
least cost from any place on is a vector of four: the backward costs.

Conversations are sorted over partitions and cut into chunks, so that one of any length is many tasks. Every chunk starts from a speculative vector
(the end's) and runs backwards. In fix-up passes a chunk whose successor now begins with another vector than it assumed runs again;
vectors that differ by a constant are the same one, as matrices of such rows soon have rank 1. (Those of forced deletions alone never have; a run of
them is carried as one entry, so that no chunk consists of them but where a whole partition does.) When no chunk has to run again, the costs are exact
but for a constant a chunk, and these constants add up: the cost of the whole is their sum and the first chunk's. The least audit is
traced forwards on the costs' differences alone, for each of the four states a chunk may be entered in, and the chunks' maps of states are
composed by doubling; a map that leads to one state whatever the entry needs no predecessor.

The digest of a repaired conversation is one stream over its rows in order; it and the audit are one output row by definition. A conversation
that lies in one chunk is finished where it lies; of the others the chunks' results are brought together by conversation and streamed.

Edge cases: rows are ordered by turn (null first), then role and text after damage; a null role or text is one space; null turns
and conversation ids count as one space in the damage's key, a null id is a conversation; rows that repeat each other wholly are
carried as one with a count; very long texts are read whole, a chunk holds `chunk` rows or about 4 MB at most (one row at least); a
conversation of which nothing is left has zeros, an empty audit and the digest of nothing; an empty table gives none. Further columns are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import running, sorted_pieces
from .common import SPACE, cut

KEEP, ROLE, DELETE, INSERT, SHORT = 0, 3, 4, 3, 3
BEGIN, S, U, A = range(4)
FAR = 1 << 40
#: state -> {initial: next state}; inserted and changed rows are u or a
MOVES = ({"s": S, "u": U}, {"u": U}, {"a": A}, {"u": U})
#: The one state that an inserted or changed row leads to, and its role.
NEXT = ((U, "user"), (U, "user"), (A, "assistant"), (U, "user"))
#: What remains after the last row: rows of user and assistant to insert.
END = (0, 2 * INSERT, INSERT, 0)
LETTERS, CLEAN, CUT, FORCED = "sua", 0, 4, 8


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n of conversations damaged by crc32(`conv_id:turn`) % 20: dropped (n = 0), emptied, stripped of `.!?`, repeated (n = 2), or said by the user."""
    blank = F.lit(" ")
    role, text = (F.coalesce(F.col(c).cast("string"), blank) for c in ("role", "text"))
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (rows that are alike), code (how the first of them may be edited: a role's initial, and whether truncated; or forced), blank, duplicate, truncated (rows)."""
    own = cut(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")))
    said = [F.xxhash64(F.col("conv_id").isNull(), "conv_id", "role", "text").alias("x"), F.xxhash64(F.lit("said"), "text", "role", F.col("conv_id").isNull(), "conv_id").alias("y")]
    first = own.where("n > 0").groupBy(*said).agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("at"), F.count("*").alias("times")).where("times > 1")
    first = first.select(F.col("x").alias("fx"), F.col("y").alias("fy"), F.col("at.turn").alias("first"))
    at = own.select("*", *said).join(first, (F.col("x") == F.col("fx")) & (F.col("y") == F.col("fy")), "left")
    again = F.col("fx").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))
    bare = F.btrim("text", F.lit(SPACE))
    empty = bare == ""
    short = ~empty & ~F.right(bare, F.lit(1)).isin(".", "!", "?")
    letter = reduce(lambda when, k: when.when(F.left("role", F.lit(1)) == LETTERS[k], k), range(1, len(LETTERS)), F.when(F.left("role", F.lit(1)) == LETTERS[0], 0)).otherwise(len(LETTERS))
    code = F.when(empty | again, FORCED).otherwise(letter + F.when(short, CUT).otherwise(CLEAN))
    zero = F.lit(0).cast("long")
    alone = F.when(F.col("n") > 0, 1).otherwise(0).cast("long")
    return at.select(
        "conv_id", "turn", "role", "text", "n", code.cast("int").alias("code"), F.when(empty, F.col("n")).otherwise(zero).alias("blank"),
        F.when(empty, zero).when(again, F.col("n")).otherwise(F.col("n") - alone).alias("duplicate"), F.when(short & ~again, alone).otherwise(zero).alias("truncated"),
    )


def matrices() -> np.ndarray:
    """Of each code (4 clean initials, 4 truncated, forced, and nothing): the least cost of going over the row from one state to another, insertions before it included."""
    out = np.full((10, 4, 4), FAR, np.int64)
    for code in range(9):
        rows = np.full((4, 4), FAR, np.int64)
        more = SHORT if CUT <= code < FORCED else 0
        for s in range(4):
            rows[s, s] = DELETE
            if code < FORCED:
                rows[s, NEXT[s][0]] = min(rows[s, NEXT[s][0]], ROLE + more)
                to = MOVES[s].get((LETTERS + "-")[code % 4])
                if to is not None:
                    rows[s, to] = min(rows[s, to], KEEP + more)
        for _ in range(3):  # insertions, until nothing gets cheaper
            for s in range(4):
                rows[s] = np.minimum(rows[s], INSERT + rows[NEXT[s][0]])
        out[code] = rows
    out[9] = np.where(np.eye(4, dtype=bool), 0, FAR)
    return out


MATRICES = matrices()


def backwards(codes: list[list[int]], ends: np.ndarray) -> np.ndarray:
    """vectors (length + 1, chunks, 4): the least costs from each place on, given those after the last row. Chunks are aligned at their ends."""
    most = max(map(len, codes), default=0)
    padded = np.full((len(codes), most), 9)
    for i, c in enumerate(codes):
        padded[i, most - len(c) :] = c
    out = np.empty((most + 1, len(codes), 4), np.int64)
    out[most] = ends
    for k in range(most - 1, -1, -1):
        out[k] = (MATRICES[padded[:, k]] + out[k + 1][:, None, :]).min(2)
    return out


def trace(codes: list[int], more: list[int], after: np.ndarray, state: int, last: bool) -> tuple[str, int]:
    """The least audit of a chunk entered in a state, and the state that it ends in. after[k]: costs from row k on; more: forced deletions after each row."""
    out = []
    for k, code in enumerate(codes):
        here, then = after[k], after[k + 1]
        while True:
            left = here[state]
            if left == DELETE + then[state]:
                out.append("D")
                break
            to = NEXT[state][0]
            if left == INSERT + here[to]:
                out.append("I")
                state = to
                continue
            extra = SHORT if CUT <= code < FORCED else 0
            kept = MOVES[state].get((LETTERS + "-")[code % 4]) if code < FORCED else None
            if kept is not None and left == KEEP + extra + then[kept]:
                out.append("K")
                state = kept
            else:
                out.append("R")
                state = to
            break
        if more[k]:
            out.append("D" * more[k])
    if last:
        for _ in range(END[state] // INSERT):
            out.append("I")
            state = NEXT[state][0]
    return "".join(out), state


def repaired(audit: str, roles: list[str], texts: list[str], counts: list[int], state: int) -> Iterator[str]:
    """`role:text` of what a chunk's audit leaves and adds."""
    k, used = 0, 0
    for letter in audit:
        if letter == "I":
            state, role = NEXT[state]
            yield f"{role}:"
            continue
        if letter == "K":
            yield f"{roles[k]}:{texts[k]}"
            state = MOVES[state][roles[k][0]]
        elif letter == "R":
            state, role = NEXT[state]
            yield f"{role}:{texts[k]}"
        used += 1
        if used == counts[k]:
            k, used = k + 1, 0


_SUMS = ("blank", "duplicate", "truncated", "illegal")
_CHUNK = (
    "pid int, k int, whole boolean, roles array<string>, texts array<string>, counts array<long>, codes array<int>, blank long, duplicate long, truncated long, illegal long, "
    "head string, tail string, first_turn long, last_turn long, turns long"
)
_LEGAL = {"su", "ua", "au"}


class _Chunk:
    """Rows of a conversation, as they come."""

    def __init__(self, conv, k: int, first: bool):
        self.conv, self.k, self.first = conv, k, first
        self.roles, self.texts, self.counts, self.codes, self.sums = [], [], [], [], [0, 0, 0, 0]
        self.head = self.tail = self.first_turn = self.last_turn = None
        self.turns = self.size = 0

    def add(self, turn, role, text, n, code, *sums) -> None:
        if not n:  # the conversation is there, the row isn't
            return
        for k, v in enumerate(sums):
            self.sums[k] += v
        letter = role[:1]
        self.sums[3] += (n - 1 if letter + letter not in _LEGAL else 0) + (self.tail is not None and self.tail + letter not in _LEGAL)
        self.head, self.tail = letter if self.head is None else self.head, letter
        if turn is not None and turn != self.last_turn:
            self.first_turn, self.last_turn, self.turns = turn if self.first_turn is None else self.first_turn, turn, self.turns + 1
        if code == FORCED:  # what is deleted in any case needs no text, and a run of it is one entry: vectors pass through it, which would take a pass a chunk
            role = text = ""
            if self.codes and self.codes[-1] == FORCED:
                self.counts[-1] += n
                return
        self.size += len(text)
        for column, v in zip((self.roles, self.texts, self.counts, self.codes), (role, text, n, code), strict=True):
            column.append(v)

    def row(self, pid: int, whole: bool) -> tuple:
        return (self.conv, pid, self.k, whole, self.roles, self.texts, self.counts, self.codes, *self.sums, self.head, self.tail, self.first_turn, self.last_turn, self.turns)


def chunks(rows: DataFrame, chunk: int, most: int = 4 << 20) -> DataFrame:
    """The rows of `faults` as chunks of at most so many rows and characters; `whole` is true where a chunk is known to hold all of its conversation."""
    kind = rows.schema["conv_id"]
    schema = T.StructType([kind, *T.StructType.fromDDL(_CHUNK).fields])
    arrow = [pa.int64() if isinstance(kind.dataType, T.LongType) else None, pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, now, out, held = TaskContext.get().partitionId(), None, [], 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array(v, a) if a is not None else pa.array(v) for v, a in zip(zip(*out, strict=True), arrow, strict=True)]
            return pa.record_batch(columns, names=schema.names)

        for b in batches:
            for conv, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None:
                    now = _Chunk(conv, 0, True)
                elif now.conv != conv:
                    out.append(now.row(pid, now.k == 0 and not now.first))
                    held, now = held + now.size, _Chunk(conv, 0, False)
                elif len(now.codes) >= chunk or now.size >= most:
                    out.append(now.row(pid, False))
                    held, now = held + now.size, _Chunk(conv, now.k + 1, now.first)
                now.add(*row)
                if len(out) >= 1000 or held >= most:
                    yield batch()
                    out, held = [], 0
        if now is not None:
            out.append(now.row(pid, False))
        if out:
            yield batch()

    order = [F.col("turn"), F.col("role"), F.col("text")]
    return cut(sorted_pieces(rows, ["conv_id"], order).mapInArrow(run, schema))


_OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _finished(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [None, *[pa.int64()] * 6, pa.string(), pa.string()]
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.record_batch([pa.array(v, k) if k is not None else pa.array(v, pa.int64() if all(x is None for x in v) else None) for v, k in zip(columns, kinds, strict=True)], names=names)


def _alone(whole: DataFrame, schema: T.StructType) -> DataFrame:
    """The results of conversations that lie in one chunk each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            codes = [r["codes"] for r in rows]
            costs = backwards(codes, np.array(END))
            out = []
            for i, r in enumerate(rows):
                after = costs[len(costs) - 1 - len(codes[i]) :, i].tolist()
                audit, _ = trace(codes[i], [n - 1 for n in r["counts"]], after, BEGIN, True)
                forced = DELETE * (sum(r["counts"]) - len(codes[i]))
                gaps = r["last_turn"] - r["first_turn"] + 1 - r["turns"] if r["turns"] else 0
                lines = "\n".join(repaired(audit, r["roles"], r["texts"], r["counts"], BEGIN))
                out.append((r["conv_id"], gaps, *(r[c] for c in _SUMS), after[0][BEGIN] + forced, audit, hashlib.sha256(lines.encode()).hexdigest()))
            yield _finished(out, schema.names)

    return whole.mapInArrow(run, schema)


def _vectors(rows: DataFrame, by: T.StructField) -> DataFrame:
    """conv_id, no, codes, counts, assumed, begins (the vector at the chunk's beginning, from the assumed one after it), changed: rows also have follows, the vector that its successor begins with."""
    schema = T.StructType([by, *T.StructType.fromDDL("no long, codes array<int>, counts array<long>, assumed array<long>, begins array<long>, changed boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            again = []
            for r in rows:
                f = r.pop("follows")
                to = list(END) if f is None else [x - f[BEGIN] for x in f]
                r["changed"] = r["begins"] is None or (f is not None and to != r["assumed"])
                if r["changed"]:
                    r["assumed"] = to
                    again.append(r)
            if again:
                first = backwards([r["codes"] for r in again], np.array([r["assumed"] for r in again]))
                for i, r in enumerate(again):
                    r["begins"] = (first[0, i] + DELETE * (sum(r["counts"]) - len(r["codes"]))).tolist()
            kinds = [b.schema.field(0).type, pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]
            yield pa.record_batch([pa.array([r[c] for r in rows], k) for c, k in zip(schema.names, kinds, strict=True)], names=schema.names)

    return cut(rows.select("conv_id", "no", "codes", "counts", "assumed", "begins", "follows").mapInArrow(run, schema))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def converged(small: DataFrame) -> DataFrame:
    """The vectors of chunks (conv_id, no, codes, counts), after as many fix-up passes as it takes, and `base`: what is to be added for the chunks after this one's successor began."""
    none = F.lit(None).cast("array<long>")
    by = small.schema["conv_id"]
    # speculation: every chunk is followed by nothing
    at = _vectors(small.select("*", none.alias("assumed"), none.alias("begins"), none.alias("follows")), by)
    while True:
        after = at.select(F.col("conv_id").alias("of"), (F.col("no") - 1).alias("before"), F.col("begins").alias("follows"))
        seen = at.drop("changed").join(after, _same("conv_id", "of") & (F.col("no") == F.col("before")), "left").drop("of", "before")
        at = _vectors(seen, by)
        if at.where("changed").isEmpty():
            break
    after = at.select(F.col("conv_id").alias("of"), (F.col("no") - 1).alias("before"), F.col("begins").alias("follows"))
    joined = at.join(after, _same("conv_id", "of") & (F.col("no") == F.col("before")), "left")
    return cut(joined.select("conv_id", "no", "codes", "counts", "assumed", "begins", F.coalesce(F.get("follows", F.lit(BEGIN)), F.lit(0).cast("long")).alias("base"), F.col("follows").isNull().alias("last")))


def _after(codes: list[list[int]], assumed: list[list[int]]) -> list[list[list[int]]]:
    """Of each chunk the costs from each of its rows on."""
    costs = backwards(codes, np.array(assumed))
    return [costs[len(costs) - 1 - len(c) :, i].tolist() for i, c in enumerate(codes)]


def entered(at: DataFrame) -> DataFrame:
    """conv_id, no, state: the state in which the least audit enters each chunk; the chunks' maps of states, composed by doubling."""
    by = at.schema["conv_id"]

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            held = _after([r["codes"] for r in rows], [r["assumed"] for r in rows])
            to = [[trace(r["codes"], [0] * len(r["codes"]), after, s, False)[1] for s in range(4)] for r, after in zip(rows, held, strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(to, pa.list_(pa.int32()))], names=["conv_id", "no", "to"])

    schema = T.StructType([by, *T.StructType.fromDDL("no long, to array<int>").fields])
    upto = cut(at.select("conv_id", "no", "codes", "assumed").mapInArrow(maps, schema))
    far = 1
    while True:
        fixed = (F.array_size(F.array_distinct("to")) == 1) | (F.col("no") <= far)
        if upto.where(~fixed).isEmpty():
            break
        before = upto.select(F.col("conv_id").alias("of"), (F.col("no") + far).alias("then"), F.col("to").alias("first"))
        seen = upto.join(before, _same("conv_id", "of") & (F.col("no") == F.col("then")) & ~fixed, "left")
        upto = cut(seen.select("conv_id", "no", F.when(F.col("first").isNull(), F.col("to")).otherwise(F.transform("first", lambda s: F.get("to", s))).alias("to")))
        far *= 2
    ends = upto.select(F.col("conv_id").alias("of"), (F.col("no") + 1).alias("then"), F.get("to", F.lit(BEGIN)).alias("state"))
    seen = upto.select("conv_id", "no").join(ends, _same("conv_id", "of") & (F.col("no") == F.col("then")), "left")
    return seen.select("conv_id", "no", F.coalesce("state", F.lit(BEGIN)).alias("state"))


_PIECE = "no long, audit string, said string, lines long, cost long, blank long, duplicate long, truncated long, illegal long, head string, tail string, first_turn long, last_turn long, turns long"


def _together(parts: DataFrame, schema: T.StructType) -> DataFrame:
    """The results of conversations of many chunks: rows of a chunk each (all columns of its own, no, assumed, begins, base, last, state)."""
    piece = T.StructType([schema.fields[0], *T.StructType.fromDDL(_PIECE).fields])

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = b.to_pylist(), []
            for r, after in zip(rows, _after([r["codes"] for r in rows], [r["assumed"] for r in rows]), strict=True):
                audit, _ = trace(r["codes"], [n - 1 for n in r["counts"]], after, r["state"], r["last"])
                lines = list(repaired(audit, r["roles"], r["texts"], r["counts"], r["state"]))
                cost = r["base"] + (r["begins"][BEGIN] if r["no"] == 1 else 0)
                out.append((r["no"], audit, "\n".join(lines), len(lines), cost, *(r[c] for c in (*_SUMS, "head", "tail", "first_turn", "last_turn", "turns"))))
            kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.string(), pa.string(), *[pa.int64()] * 3]
            columns = zip(*out, strict=True) if out else [[] for _ in kinds]
            yield pa.record_batch([b.column(0), *(pa.array(v, k) for v, k in zip(columns, kinds, strict=True))], names=piece.names)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, None

        def row() -> tuple:
            gaps = kept["last"] - kept["first"] + 1 - kept["turns"] if kept["turns"] else 0
            return (now[0], gaps, *(kept[c] for c in _SUMS), kept["cost"], "".join(kept["audit"]), kept["sha"].hexdigest())

        for b in batches:
            done = []
            for r in b.to_pylist():
                if now is None or now[0] != r["conv_id"]:
                    if now is not None:
                        done.append(row())
                    now, kept = (r["conv_id"],), {"sha": hashlib.sha256(), "lines": 0, "audit": [], "cost": 0, "tail": None, "first": None, "last": None, "turns": 0, **dict.fromkeys(_SUMS, 0)}
                for c in (*_SUMS, "cost"):
                    kept[c] += r[c]
                if r["head"] is not None:
                    kept["illegal"] += kept["tail"] is not None and kept["tail"] + r["head"] not in _LEGAL
                    kept["tail"] = r["tail"]
                if r["turns"]:
                    kept["turns"] += r["turns"] - (kept["last"] == r["first_turn"])
                    kept["first"], kept["last"] = r["first_turn"] if kept["first"] is None else kept["first"], r["last_turn"]
                if r["lines"]:
                    kept["sha"].update(("\n" if kept["lines"] else "").encode() + r["said"].encode())
                    kept["lines"] += r["lines"]
                kept["audit"].append(r["audit"])
            yield _finished(done, schema.names)
        if now is not None:
            yield _finished([row()], schema.names)

    return parts.mapInArrow(cuts, piece).repartition("conv_id").sortWithinPartitions("conv_id", "no").mapInArrow(stream, schema)


def repair(rows: DataFrame, chunk: int = 64) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of the conversations in rows conv_id, turn, role, text, n (how often a row is there; 0: only its conversation)."""
    rows = rows.withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")})
    held = chunks(cut(faults(rows)), chunk)
    schema = T.StructType([held.schema["conv_id"], *T.StructType.fromDDL(_OUT).fields])
    done = _alone(held.where("whole"), schema)
    many = held.where("not whole")
    if many.isEmpty():
        return done
    small = running(many.select("conv_id", "pid", "k", "codes", "counts"), ["conv_id"], [F.col("pid"), F.col("k")]).withColumnRenamed("__no", "no")
    at = converged(small.select("conv_id", "no", "codes", "counts"))
    found = at.select("conv_id", "no", "assumed", "begins", "base", "last").join(entered(at).withColumnsRenamed({"conv_id": "of", "no": "at"}), _same("conv_id", "of") & (F.col("no") == F.col("at")))
    placed = small.select(F.col("conv_id").alias("conv"), F.col("pid").alias("part"), F.col("k").alias("nth"), F.col("no").alias("number")).join(found, _same("conv", "conv_id") & (F.col("number") == F.col("no"))).drop("conv_id")
    parts = many.join(placed, _same("conv_id", "conv") & (F.col("pid") == F.col("part")) & (F.col("k") == F.col("nth")))
    kept = [c for c in many.columns if c not in ("pid", "k", "whole")]
    return done.unionAll(_together(parts.select(*kept, "no", "assumed", "begins", "base", "last", "state"), schema))


def repaired_conversations(rows: DataFrame, chunk: int = 64) -> DataFrame:
    """`repair` of rows conv_id, turn, role, text after `damaged`."""
    return repair(damaged(rows), chunk)
