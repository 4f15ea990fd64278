"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's subwords are its byte n-grams after lower-casing. Each is hashed to a row of an embedding table; the text is
the mean of its rows; a linear layer and a softmax give the languages' probabilities. Both tables are learned by
stochastic gradient descent in numpy. A temperature, fitted on the part of the sample that training doesn't see,
calibrates the probabilities; the rejection threshold is the largest that keeps `keep` of that part's right answers.

The sample is about `sample` labelled rows, chosen by a hash of their id. Executors turn its texts into
shares by bucket, of each text its `most_grams` most frequent ones, so the driver holds `sample * most_grams` times 6 bytes at most
(74 MB), whatever the texts' lengths. Scoring folds the two tables into one number per bucket and language and sums those over
the whole text, in blocks.

Edge cases: null text, or text without a letter, is `und` with score 0; empty texts likewise; very long texts are read whole, in
blocks of 4 MB; without any labelled row everything is `und`; an empty table gives no rows. Repeated rows are scored alike.
Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat_bytes, pieces, sampled

BUCKETS = 1 << 15
ORDERS = (2, 3, 4)
SAMPLE = 3000
MOST_GRAMS = 4096
BLOCK = 4 << 20
FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def buckets_of(raw: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte but the last order-1."""
    n = len(raw) - order + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    h = np.full(n, order * 0x165667B1 & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h = (h ^ raw[k : k + n]) * np.uint32(FACTORS[k])
        h ^= h >> np.uint32(13)
    return (h % np.uint32(BUCKETS)).astype(np.int32)


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts' bytes, a space before and after each."""
    col = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    return flat_bytes(pc.binary_join_element_wise(space, col, space, nothing))


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # of bucket and language: embedding times linear layer
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def probabilities(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def score(self, texts: pa.Array) -> np.ndarray:
        """The languages' probabilities for each text."""
        raw, at = lowered(texts)
        rows = len(at) - 1
        sums, counts = np.zeros((rows, len(self.langs))), np.zeros(rows)
        for order in ORDERS:
            lo, hi = at[:-1], np.maximum(at[:-1], at[1:] - order + 1)
            counts += hi - lo
            for a in range(0, len(raw), BLOCK):  # n-grams that start in this block
                found = buckets_of(raw[a : a + BLOCK + order - 1], order)
                begin, end = np.clip(lo - a, 0, len(found)), np.clip(hi - a, 0, len(found))
                for j in range(len(self.langs)):
                    run = np.concatenate([[0.0], np.cumsum(self.table[:, j][found], dtype=np.float64)])
                    sums[:, j] += run[end] - run[begin]
        return self.probabilities(sums, counts)


def counted(docs: DataFrame, most_grams: int = MOST_GRAMS) -> DataFrame:
    """lang, and each text's n-grams, the `most_grams` most frequent: their buckets (2 bytes each) and shares (4-byte floats), as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 4 << 20):
            raw, at = lowered(b.column(1))
            bucket, share = [], []
            for lo, hi in zip(at, at[1:], strict=False):
                c = sum(np.bincount(buckets_of(raw[a : min(hi, a + BLOCK + n - 1)], n), minlength=BUCKETS) for n in ORDERS for a in range(lo, hi, BLOCK))
                own = np.flatnonzero(c)
                if len(own) > most_grams:
                    own = np.sort(own[np.argsort(-c[own], kind="stable")[:most_grams]])
                bucket.append(own.astype("<u2").tobytes())
                share.append((c[own] / max(1, c.sum())).astype("<f4").tobytes())
            yield pa.record_batch([b.column(0), pa.array(bucket, pa.binary()), pa.array(share, pa.binary())], names=["lang", "bucket", "share"])

    return docs.select("lang", F.col("text").cast("string").alias("text")).mapInArrow(run, "lang string, bucket binary, share binary")


def train(labelled: DataFrame, sample: int = SAMPLE, width: int = 16, epochs: int = 4, rate: float = 0.5, keep: float = 0.99, seed: int = 7) -> Model | None:
    """Fits on about `sample` rows of doc_id, text, lang; None if there are none."""
    named = labelled.where("lang is not null and doc_id is not null")
    # the sample's ids first, from ids alone; they are broadcast (8 bytes each)
    few = sampled(named.select("doc_id").distinct(), sample, F.concat(F.lit("langid "), F.col("doc_id").cast("string")))
    own = named.select("doc_id", "lang", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r"))
    rows = counted(own.orderBy("doc_id").select("r.lang", "r.text")).toArrow()
    if not rows.num_rows:
        return None
    names = rows.column(0).to_pylist()
    langs = sorted(set(names))
    y = np.array([langs.index(n) for n in names])
    feats = [(np.frombuffer(b.as_py(), "<u2").astype(np.int64), np.frombuffer(w.as_py(), "<f4")) for b, w in zip(rows.column(1), rows.column(2), strict=True)]
    del rows
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / width, 1 / width, (BUCKETS, width)).astype(np.float32)
    out, bias = np.zeros((width, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    order = rng.permutation(len(y))
    held, learn = order[: len(y) // 5], order[len(y) // 5 :]
    steps, done = epochs * len(learn), 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            ix, share = feats[i]
            x = share @ emb[ix]
            z = x @ out + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y[i]] -= 1
            now = rate * (1 - done / steps)
            back = out @ g
            out -= now * np.outer(x, g)
            bias -= now * 0.1 * g
            emb[ix] -= now * 10 * np.outer(share, back)
            done += 1
    model = Model(langs, (emb @ out).astype(np.float32), bias.astype(np.float64))
    fit = held if len(held) >= 20 else order
    sums = np.array([feats[i][1] @ model.table[feats[i][0]] for i in fit])
    best = min(np.geomspace(0.05, 5, 40), key=lambda t: _loss(model, sums, y[fit], t))
    model.temperature = float(best)
    p = model.probabilities(sums, np.ones(len(fit)))
    right = np.sort(p.max(1)[p.argmax(1) == y[fit]])
    model.reject_below = float(right[int((1 - keep) * len(right))]) if len(right) else 0.0
    return model


def _loss(model: Model, sums: np.ndarray, y: np.ndarray, temperature: float) -> float:
    z = (sums + model.bias) / temperature
    return float((np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(y)), y]).mean())


def identify(docs: DataFrame, model: Model | None, extra: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, the `extra` columns, lang_pred, score (calibrated), rejected (score below the threshold, or `und`)."""
    named = [c.alias(k) for k, c in (extra or {}).items()]
    rows = docs.select("doc_id", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__ok"), F.col("text").cast("string").alias("text"), *named)
    kept = [f for f in rows.schema if f.name not in ("__ok", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            ok = np.array(b.column(1))
            if model is None:
                lang, score, low = ["und"] * len(ok), np.zeros(len(ok)), np.ones(len(ok), bool)
            else:
                p = model.score(b.column(2))
                best, score = p.argmax(1), np.where(ok, p.max(1), 0.0)
                lang = [model.langs[k] if y else "und" for k, y in zip(best, ok, strict=True)]
                low = ~ok | (score < model.reject_below)
            yield pa.record_batch([b.column(0), *(b.column(k) for k in range(3, b.num_columns)), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(low)], names=[*(f.name for f in kept), "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string", "score double", "rejected boolean"]))
