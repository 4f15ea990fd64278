"""Quality classifier: a generalised additive model with pairwise interactions, learned by cyclic boosting.

Each text is described by a few shares and means over the whole text. Each feature is cut into bins at quantiles. Boosting
cycles over the features; in each turn a shallow tree over one feature's bins (at most two cuts) fits the gradient of
the log loss and is added to the feature's table at a small rate. Then the pairs whose joint tables explain most of what
is left are boosted likewise, with a cut in either feature. A score is the sum of one entry for each feature and pair:
additions of looked-up bins, vectorised. A logistic fit on rows that boosting doesn't see calibrates it.

Labels are taken from about `sample` ids, chosen by a hash; they are broadcast (12 bytes each). Of rows that repeat an id,
one is learned from. Labels that contradict each other for one id count as 1; null labels don't count.

Edge cases: null and empty texts have all features 0 and are scored; very long texts are described whole, a batch of about 8 MB at
a time; an empty table gives no rows; without labels, or with one class alone, the score
is that class's share (0.5 without any). Repeated rows are scored alike. Further columns are not read by `scored`
and pass through `keep_good`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, platt, sampled, shielded

SAMPLE = 8000
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "line_bytes", "distinct_words", "top_word", "repeated_lines", "repeated_line_bytes",
    "upper", "digits", "spaces", "marks", "symbols", "pipes", "bangs", "word_end_marks", "long_words", "short_words", "sentence_ends", "wide",
)
_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 white space, 5 common marks, 6 other ASCII signs, 7 bytes of other characters
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 7 if _b > 127 else 1 if _c.isupper() else 2 if _c.islower() else 3 if _c.isdigit() else 4 if _c.isspace() else 5 if _c in ".,;:'\"-()?" else 6
_END = re.compile(rb"[.?!](?:[\x20\x09-\x0d]|$)")


def features(text: str | bytes | None) -> list[float]:
    raw = b"" if text is None else text.encode() if isinstance(text, str) else text
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=8) / n
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    w = max(1, len(words))
    seen, rows = Counter(words), Counter(lines)
    repeated = [(k, c) for k, c in rows.items() if c > 1]
    ends = sum(c for x, c in seen.items() if x[-1] in b"!#$%&*+=<>@^_`{|}~")
    lens = np.array([len(x) for x in words]) if words else np.zeros(1)
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), sum(map(len, words)) / w, n / max(1, len(lines)), len(seen) / w ** 0.8, max(seen.values(), default=0) / w,
        sum(c - 1 for _, c in repeated) / max(1, len(lines)), sum(len(k) * (c - 1) for k, c in repeated) / n,
        *kinds[[1, 3, 4, 5, 6]].tolist(), raw.count(b"|") / w, raw.count(b"!") / w, ends / w, float((lens > 20).mean()), float((lens < 3).mean()), len(_END.findall(raw)) / w, float(kinds[7]),
    ]


@dataclass
class Gam:
    """bins[f]: the edges of a feature; tables[f]: its additions by bin; pairs: (f, g, table)."""

    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    base: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def raw(self, b: np.ndarray) -> np.ndarray:
        z = np.full(len(b), self.base)
        for f, t in enumerate(self.tables):
            z += t[b[:, f]]
        for f, g, t in self.pairs:
            z += t[b[:, f], b[:, g]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.raw(self.binned(x)) + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, cuts: int = 2, least: float = 1.0) -> np.ndarray:
    """The additions by bin of a tree with so many cuts, from the bins' sums of gradients and hessians."""
    parts = [(0, len(g))]
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + least)
    for _ in range(cuts):
        best = (1e-9, None)
        for a, b in parts:
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            if len(gl):
                won = gl**2 / (hl + least) + (g[a:b].sum() - gl) ** 2 / (h[a:b].sum() - hl + least) - gain(a, b)
                k = int(won.argmax())
                best = max(best, (float(won[k]), (a, a + k + 1, b)), key=lambda x: x[0])
        if best[1] is None:
            break
        a, m, b = best[1]
        parts = [p for p in parts if p != (a, b)] + [(a, m), (m, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + least)
    return out


def _block_tree(g: np.ndarray, h: np.ndarray, least: float = 1.0) -> np.ndarray:
    """A tree over two features: a cut of each, four leaves, the best pair of cuts of all."""
    def corners(x: np.ndarray) -> tuple[np.ndarray, ...]:
        c = x.cumsum(0).cumsum(1)
        low, rows, cols, every = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return low, rows - low, cols - low, every - rows - cols + low

    out = np.zeros(g.shape)
    if min(g.shape) < 2:
        return out
    gain = sum(a**2 / (b + least) for a, b in zip(corners(g), corners(h), strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    for r in (slice(0, i + 1), slice(i + 1, None)):
        for c in (slice(0, j + 1), slice(j + 1, None)):
            out[r, c] = g[r, c].sum() / (h[r, c].sum() + least)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 20, pairs: int = 4, rate: float = 0.15, bins: int = 32, seed: int = 7) -> Gam:
    """Learns from features and 0/1 labels."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Gam(base=float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    m = Gam(edges=edges, base=float(np.log(y.mean() / (1 - y.mean()))))
    order = np.random.default_rng(seed).permutation(len(y))
    held, learn = order[: len(y) // 5], order[len(y) // 5 :]
    b, t = m.binned(x), y[learn]
    bl = b[learn]
    m.tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(len(learn), m.base)

    def sums(index: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = _sigmoid(z)
        return np.bincount(index, t - p, size), np.bincount(index, p * (1 - p), size)

    for _ in range(rounds):
        for f, table in enumerate(m.tables):
            step = rate * _tree(*sums(bl[:, f], len(table)))
            table += step
            z += step[bl[:, f]]
    joint = lambda f, g: (bl[:, f] * len(m.tables[g]) + bl[:, g], (len(m.tables[f]), len(m.tables[g])))

    def explains(f: int, g: int) -> float:
        index, shape = joint(f, g)
        a, c = sums(index, shape[0] * shape[1])
        step = _block_tree(a.reshape(shape), c.reshape(shape))
        return float((step * a.reshape(shape)).sum())

    ranked = sorted(((f, g) for f in range(len(edges)) for g in range(f)), key=lambda p: -explains(*p))[:pairs]
    m.pairs = [(f, g, np.zeros((len(m.tables[f]), len(m.tables[g])))) for f, g in ranked]
    for _ in range(pair_rounds):
        for f, g, table in m.pairs:
            index, shape = joint(f, g)
            a, c = sums(index, shape[0] * shape[1])
            step = rate * _block_tree(a.reshape(shape), c.reshape(shape))
            table += step
            z += step[bl[:, f], bl[:, g]]
    if len(held) >= 50 and y[held].min() < y[held].max():
        m.slope, m.shift = platt(m.raw(b[held]), y[held])
    return m


def described(docs: DataFrame, *keep: str) -> DataFrame:
    """The `keep` columns and x, the features."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            x = [features(t) for t in b.column(len(keep)).cast(pa.large_binary()).to_pylist()]
            yield pa.record_batch([*(b.column(k) for k in range(len(keep))), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("x", T.ArrayType(T.DoubleType()))]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, learn_from: Column | None = None) -> Gam:
    """Fits on about `sample` labelled documents, of those where `learn_from` (a condition on doc_id) holds."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    if learn_from is not None:
        known = known.where(learn_from)
    known = sampled(known, sample, F.concat(F.lit("quality "), F.col("doc_id").cast("string")))
    own = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # about `sample` rows of 12 bytes are broadcast
    rows = described(own, "doc_id", "quality").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).orderBy("doc_id").select("quality", "x").toArrow()
    y = np.array(rows.column(0).to_pylist(), float)
    return fit(np.array(rows.column(1).to_pylist(), float).reshape(len(y), len(FEATURES)), (y > 0).astype(float))


def scored(docs: DataFrame, model: Gam, *keep: str, threshold: float = 0.3, only_good: bool = False) -> DataFrame:
    """The `keep` columns, score and predicted (1 if score >= threshold); `only_good`: of those predicted 1."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "__text"):
            x = np.array([features(t) for t in b.column(at).cast(pa.large_binary()).to_pylist()], float)
            s = model.score(x.reshape(b.num_rows, len(FEATURES)))
            good = (s >= threshold).astype(np.int32)
            out = pa.record_batch([*(b.column(k) for k in range(at)), pa.array(s), pa.array(good)], names=[*keep, "score", "predicted"])
            yield out.filter(pa.array(good == 1)) if only_good else out

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def keep_good(docs: DataFrame, model: Gam, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` that the model doesn't reject, with the columns of `docs`; one pass without a shuffle."""
    rows, named = shielded(docs)
    kept = scored(rows.withColumn("text", F.col(named["text"])), model, *rows.columns, threshold=threshold, only_good=True)
    return kept.select(*rows.columns).toDF(*docs.columns)
