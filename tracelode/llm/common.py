"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, shared_dir, spread

__all__ = ["SPACE", "SPACE_RE", "crc_mod", "cut", "flat_bytes", "load", "pieces", "platt", "row_key", "sampled", "shared_dir", "shielded", "spread", "word_count"]

#: ASCII white space: what separates words in every operator here.
SPACE = " \t\n\x0b\f\r"
SPACE_RE = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with columns c0, c1, ..., and which of them each column is: whatever the table's own names, an operator's can't clash with them."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), dict(reversed(list(zip(docs.columns, names, strict=True))))


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null counts 0."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.coalesce(F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACE_RE))), F.lit(0)).cast("long")


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that tell rows apart by id and text; never null. Rows with both equal have one key."""
    parts = [doc_id.isNull(), doc_id, text.isNull(), text]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("row"), *reversed(parts)).alias("b"))


def sampled(rows: DataFrame, size: int, key: Column) -> DataFrame:
    """About `size` rows (all, if there are fewer): those whose key's hash lies below a share. The same rows in every run, and no sort."""
    n, span = rows.count(), 1 << 40
    return rows if n <= size else rows.where(F.pmod(F.xxhash64(key), F.lit(span)) < int(span * size / n))


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and where each row starts in it; nulls are empty."""
    col = texts.cast(pa.large_binary()).fill_null(b"")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that `column` holds about `most` bytes at a time, one row at least: bounds a worker's memory."""
    for batch in batches:
        sizes = np.diff(flat_bytes(batch.column(batch.schema.get_field_index(column)))[1])
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id gives null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def platt(z: np.ndarray, y: np.ndarray, pull: float = 0.1, weight: np.ndarray | None = None) -> tuple[float, float]:
    """(slope, shift) of the logistic fit of 0/1 labels to logits, drawn towards (1, 0); Newton steps, halved until the loss falls."""
    a, start, many = np.stack([z, np.ones(len(z))], 1), np.array([1.0, 0.0]), np.ones(len(z)) if weight is None else weight
    loss = lambda w: float((many * np.logaddexp(0, (1 - 2 * y) * (a @ w))).sum() + pull / 2 * ((w - start) ** 2).sum())
    w = start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (many * p * (1 - p))[:, None]).T @ a + np.eye(2) * pull, a.T @ (many * (p - y)) + pull * (w - start))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        if size <= 1e-6 or np.abs(step).max() * size < 1e-8:
            break
        w = w - size * step
    return max(0.05, float(w[0])), float(w[1])
