"""Numbers and running folds within groups of any size, without a window over a group.

Rows are range-partitioned by group, order and their own number, so a group of whatever size is spread over as many partitions as it
fills. Each partition is numbered where it lies. A group can only go on from one partition to the next, so what a partition must add is
known from the first and last row of each: two rows a partition reach the driver, however many groups there are.

Edge cases: null groups are a group like any other; rows that are equal in group and order are numbered in the order of their place in the
input, and may be parted among partitions; an empty table gives an empty table. The added columns are __no (from 1), and for each
column x that is folded x__run (its XOR over the group's rows up to and with this one); no input column may have such a name."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import cut

FIRST, LAST = 1, 2


def sorted_pieces(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """`rows`, which must be a table that reads alike each time (`cut`), range-partitioned and sorted by group and order."""
    keys = [*map(F.col, by), *order, F.col("__tie")]
    return rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")


def _starts(batch: pa.RecordBatch, by: list[int], before: tuple | None) -> np.ndarray:
    """Which rows begin a group; `before` is the group of the row ahead of the batch."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = before is None or before != tuple(batch.column(k)[0].as_py() for k in by)
    for k in by:
        c = batch.column(k)
        a, b = c.slice(1), c.slice(0, batch.num_rows - 1)
        apart = pc.fill_null(pc.not_equal(a, b), False)
        new[1:] |= pc.or_(apart, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return new


def running(rows: DataFrame, by: list[str], order: list[Column], folds: tuple[str, ...] = ()) -> DataFrame:
    """`rows` with __no and the folds; they lie in partitions by group and order afterwards, and are written to the shared folder."""
    at = sorted_pieces(cut(rows), by, order)
    names, group, folded = at.columns, [at.columns.index(c) for c in by], [at.columns.index(c) for c in folds]
    more = ["__no", *(f"{c}__run" for c in folds), "__lead", "__pid", "__edge"]
    schema = T.StructType([*at.schema.fields, *(T.StructField(c, T.LongType()) for c in more[: 1 + len(folds)]), T.StructField("__lead", T.BooleanType()), T.StructField("__pid", T.IntegerType()), T.StructField("__edge", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, before, lead, held = TaskContext.get().partitionId(), None, True, None
        number, folds_so_far = 0, [np.int64(0)] * len(folded)
        for b in batches:
            if not b.num_rows:
                continue
            n, first = b.num_rows, before is None
            new = _starts(b, group, before)
            begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # where the row's group begins in this batch, -1: before it
            no = np.where(begin >= 0, np.arange(n) - begin + 1, number + np.arange(n) + 1)
            runs = []
            for i, k in enumerate(folded):
                upto = np.concatenate([[np.int64(0)], np.bitwise_xor.accumulate(b.column(k).to_numpy(zero_copy_only=False))])
                runs.append(upto[1:] ^ np.where(begin >= 0, upto[np.maximum(begin, 0)], folds_so_far[i]))
            later = np.flatnonzero(new[1:] if first else new)
            leads = np.full(n, lead)
            if len(later):
                leads[later[0] + first :], lead = False, False
            edge = np.zeros(n, np.int32)
            edge[0] = FIRST if first else 0
            if held is not None:
                yield held
            columns = [*b.columns, pa.array(no, pa.int64()), *(pa.array(r, pa.int64()) for r in runs), pa.array(leads), pa.array(np.full(n, pid, np.int32)), pa.array(edge)]
            held = pa.record_batch(columns, names=[*names, *more])
            before, number, folds_so_far = tuple(b.column(k)[n - 1].as_py() for k in group), int(no[-1]), [r[-1] for r in runs]
        if held is not None:
            edge = held.column(held.num_columns - 1).to_numpy(zero_copy_only=False).copy()
            edge[-1] |= LAST
            yield pa.record_batch([*held.columns[:-1], pa.array(edge)], names=held.schema.names)

    local = cut(at.mapInArrow(run, schema))
    kept = [*names, *more[: 1 + len(folds)]]
    ends: dict[int, list] = {}
    for r in local.where("__edge > 0").select("__pid", "__edge", "__lead", *by, *more[: 1 + len(folds)]).collect():  # two rows a partition
        own = ends.setdefault(r["__pid"], [None, None])
        for bit in (FIRST, LAST):
            if r["__edge"] & bit:
                own[bit - 1] = r
    carry, last, total = [], None, None  # what the group of the last row so far has come to
    for pid in sorted(ends):
        first, final = ends[pid]
        own = [final["__no"], *(final[f"{c}__run"] for c in folds)]
        add = total if last is not None and [last[c] for c in by] == [first[c] for c in by] else None
        if add is not None:
            carry.append((pid, *add))
            own = [own[0] + add[0], *(a ^ b for a, b in zip(own[1:], add[1:], strict=True))] if final["__lead"] else own
        last, total = final, own
    if not carry:
        return local.select(*kept)
    plus = local.sparkSession.createDataFrame(carry, T.StructType([T.StructField("__of", T.IntegerType()), *(T.StructField(f"__add{k}", T.LongType()) for k in range(1 + len(folds)))]))
    joined = local.join(F.broadcast(plus), (F.col("__pid") == F.col("__of")) & F.col("__lead"), "left")
    zero = F.lit(0).cast("long")
    sums = [(F.col("__no") + F.coalesce("__add0", zero)).alias("__no")]
    sums += [F.col(f"{c}__run").bitwiseXOR(F.coalesce(f"__add{k + 1}", zero)).alias(f"{c}__run") for k, c in enumerate(folds)]
    return joined.select(*names, *sums)
