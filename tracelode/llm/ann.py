"""Approximate nearest neighbours by cosine: an inverted file with product-quantised residuals.

Vectors that are equal are one class (their k + 1 smallest ids are kept, more can't be asked for), so a vector that a third of
the rows share costs as much as any other. Classes are assigned to the nearest of about sqrt(n) coarse centroids; the
residual is coded by `parts` sub-quantisers of 256 centroids. A query visits the nearest cells. There a table of its products
with every sub-centroid gives the asymmetric distance of each code, sixteen or more additions a code and no vector read. Of all
visited cells together, the `rerank` classes nearest by code are scored exactly on the original vectors.

A block of a cell sends no more than the `rerank` nearest of a query. So that it needn't send as many, each query has a limit: its distance, by codes as well, from the m-th nearest of
the fitting sample, with m such that 1.5 times `rerank` classes of all are expected below it, and 8 at least. Cells are cut into
blocks and queries into groups, so a hot cell is many small tasks.

The centroids are fitted on about 32 sqrt(n) classes, chosen by a hash, but `sample` at least and `most_sampled` at most; an eighth
of them can be cells, so cells grow with n up to `most_sampled` / 8. The number of cells to visit is the smallest whose recall
against brute force within that sample, for queries drawn from it, is `recall` at least, less 2.5 standard errors of a mean
over as many queries as are asked: few queries visit more, and vectors without structure need many cells. A query whose cells
hold fewer than k other vectors visits further ones, in order of distance, until they hold k or no cell is left; of these
first cells the nearest k + 1 classes are kept whatever the limit.

Edge cases: vectors that are null, zero, or hold a null or non-finite component take no part, as query or candidate; rows
with a null id neither. Vectors of different lengths have no cosine: each length is searched for itself. Components of any size
are scored (vectors are scaled by a power of two first). Ties go to the smaller id; with fewer candidates than k all are
returned; repeated rows (same id and vector) count once; a row of the query's id with another vector is a candidate, and a
query of its own. Further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, sampled

SAMPLE, MOST_SAMPLED = 8192, 65536
SALTS = 32


@dataclass
class Index:
    coarse: np.ndarray
    books: np.ndarray  # parts x 256 x width
    probes: int
    near: np.ndarray  # the sample, as its codes say
    rank: int  # of the sample's vector that limits a query

    def away(self, x: np.ndarray) -> np.ndarray:
        """Squared distances from unit vectors to the cells' centroids."""
        return 1 + (self.coarse**2).sum(1)[None] - 2 * x @ self.coarse.T

    def encode(self, r: np.ndarray) -> np.ndarray:
        width = self.books.shape[2]
        codes = np.empty((len(r), len(self.books)), np.uint8)
        for p, book in enumerate(self.books):
            codes[:, p] = _nearest(r[:, p * width : (p + 1) * width], book)
        return codes

    def coded(self, codes: np.ndarray) -> np.ndarray:
        """The residuals that codes stand for."""
        return np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], 1)

    def terms(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What a class adds to each distance, whatever the query: |b|^2 + 2 b c of its coded residual b and centroid c."""
        b = self.coded(codes)
        return (b * (b + 2 * self.coarse[own])).sum(1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x parts x 256: what each sub-centroid adds to a query's distances."""
        return -2 * np.einsum("npw,pjw->npj", q.reshape(len(q), len(self.books), -1), self.books)

    def limits(self, q: np.ndarray) -> np.ndarray:
        """Each query's distance from the sample's vector of that rank."""
        d = 1 + (self.near**2).sum(1)[None] - 2 * q @ self.near.T
        m = min(self.rank, len(self.near)) - 1
        return np.partition(d, m, 1)[:, m]


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, of so many rows at a time that their distances fill some megabytes."""
    norms, rows = (c**2).sum(1)[None], max(64, (2 << 20) // len(c))
    return np.concatenate([(norms - 2 * x[i : i + rows] @ c.T).argmin(1) for i in range(0, len(x), rows)])


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        order = np.argsort(own, kind="stable")
        some = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], (np.cumsum(n) - n)[some], 0)
        c[some] = sums / n[some, None]
    return c


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows in doubles, divided by a power of two so that no square over- or underflows: exact, and the cosine stays."""
    x = np.asarray(x, np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def units(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def fit(x: np.ndarray, n: int, parts: int = 32, recall: float = 0.945, k: int = 5, rerank: int = 50, asked: int = 1000, seed: int = 3) -> Index:
    """Learns from a sample of vectors, for an index of n of them that is asked so many times."""
    rng = np.random.default_rng(seed)
    x = units(x)
    cells = max(1, min(len(x) // 8, int(np.sqrt(n))))
    coarse = _means(x, cells, rng)
    while x.shape[1] % parts:
        parts -= 1
    own = _nearest(x, coarse)
    r, width = x - coarse[own], x.shape[1] // parts
    some = r[rng.permutation(len(r))[:4096]]
    books = np.stack([np.resize(_means(some[:, p * width : (p + 1) * width], min(256, len(some)), rng, 6), (256, width)) for p in range(parts)])
    index = Index(coarse, books, cells, x, max(8, int(np.ceil(1.5 * rerank * len(x) / n))))
    index.near = coarse[own] + index.coded(index.encode(r))
    ask = rng.permutation(len(x))[:256]
    best = []
    for q in ask:
        sims = x @ x[q]
        sims[q] = -9
        best.append(np.argsort(-sims, kind="stable")[: min(k, len(x) - 1)])
    best = np.array(best, np.int64)
    if best.size:
        rank = np.argsort(np.argsort(index.away(x[ask]), 1, kind="stable"), 1)
        seen = rank[np.arange(len(ask))[:, None], own[best]]  # how many cells a query must visit to see each neighbour
        found = (seen[:, :, None] < np.arange(1, cells + 1)).mean(1)  # each query's recall for so many cells
        sure = found.mean(0) - 2.5 * found.std(0) / np.sqrt(max(1, asked)) >= recall
        index.probes = int(sure.argmax()) + 1 if sure.any() else cells
    return index


def clean(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """vec_id, v (floats if the input has floats, else doubles) of the rows that take part."""
    kind = vectors.schema[vec].dataType
    v = F.col(vec) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else F.col(vec).cast("array<double>")
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(v, lambda e: e != 0)
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def classes(rows: DataFrame, k: int = 5) -> DataFrame:
    """class_id (smallest id), ids (the k+1 smallest), v, of each different vector. Salted, so no vector's ids meet in one place."""
    some = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, k + 1)
    salted = rows.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt")).agg(F.collect_set("vec_id").alias("ids"))
    one = salted.select("v", some(F.col("ids")).alias("ids")).groupBy("v").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    return one.select(some(F.col("ids")).alias("ids"), "v")


def search(vectors: DataFrame, is_query: Column, k: int = 5, vec: str = "embedding", **how) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest other rows of each row where `is_query` (a condition on vec_id) holds."""
    rows = cut(clean(vectors, vec))
    lengths = sorted(r[0] for r in rows.select(F.size("v").alias("n")).distinct().collect())  # a row for each length
    found = [_search(rows.where(F.size("v") == n) if len(lengths) > 1 else rows, is_query, k, **how) for n in lengths]
    return reduce(DataFrame.unionAll, found) if found else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search(rows: DataFrame, is_query: Column, k: int, parts: int = 32, rerank: int = 50, recall: float = 0.945, sample: int = SAMPLE, most_sampled: int = MOST_SAMPLED, block: int = 512, group: int = 512) -> DataFrame:
    """The search among vectors of one length."""
    # a class has a number of its own: ids may stand in several
    known = cut(classes(rows, k).select(F.monotonically_increasing_id().alias("class_id"), "ids", "v"))
    n = known.count()
    size = int(min(most_sampled, max(sample, 32 * n**0.5)))
    few = sampled(known, size, F.element_at("ids", 1)).orderBy("v").select("v").toArrow().column(0).combine_chunks()
    asked = rows.where(is_query).count()
    index = fit(few.flatten().to_numpy(zero_copy_only=False).reshape(len(few), -1), n, parts, recall, k, rerank, asked)
    cells = len(index.coarse)
    # the driver holds what a function is sent with, so each gets the parts of the index that it uses
    placing = replace(index, near=index.near[:0])
    comparing = replace(placing, coarse=index.coarse[:0])

    def place(batches):
        for b in batches:
            if len(b):
                x = units(np.stack(b["v"]))
                own = placing.away(x).argmin(1)
                codes = placing.encode(x - placing.coarse[own])
                yield pd.DataFrame({"cell": own.astype(np.int32), "class_id": b["class_id"], "ids": b["ids"], "code": [c.tobytes() for c in codes], "term": placing.terms(own, codes)})

    lists = cut(known.select("class_id", "v", F.size("ids").alias("ids")).mapInPandas(place, "cell int, class_id long, ids int, code binary, term float"))
    held = np.zeros(cells, np.int64)  # ids in each cell, up to k + 1 of a class: one row per cell
    for r in lists.groupBy("cell").agg(F.sum("ids").alias("ids")).collect():
        held[r.cell] = r.ids

    def visit(batches):
        for whole in batches:
            for b in (whole[i : i + 256] for i in range(0, len(whole), 256)):
                q = units(np.stack(b["v"]))
                d = index.away(q)
                far = np.argsort(d, 1, kind="stable")
                # the cells before the one with which k + 1 ids are seen: the query's own is one of them
                need = np.minimum((np.cumsum(held[far], 1) < k + 1).sum(1) + 1, cells)
                many = np.maximum(need, min(index.probes, cells))
                row, at = np.repeat(np.arange(len(b)), many), np.concatenate([np.arange(m) for m in many])
                cell, raw = far[row, at], [x.tobytes() for x in q]
                yield pd.DataFrame({"cell": cell.astype(np.int32), "asker": b["asker"].to_numpy()[row], "q": [raw[i] for i in row], "base": d[row, cell].astype(np.float32), "most": index.limits(q)[row].astype(np.float32), "must": at < need[row]})

    # queries that are equal ask once: the class of the vector asks, for its members
    asking = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v").join(known.select("class_id", F.col("v").alias("cv")).hint("merge"), F.col("v") == F.col("cv"))
    members = cut(asking.select(F.col("class_id").alias("asker"), "query_id", "v").distinct())
    probe = members.select("asker", "v").dropDuplicates(["asker"]).mapInPandas(visit, "cell int, asker long, q binary, base float, most float, must boolean")
    # how many blocks and groups each cell has: one row per cell
    sizes = lists.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    asked = probe.groupBy("cell").agg(F.ceil(F.count("*") / group).cast("int").alias("groups"))
    # this alone is broadcast: left to Spark, lists or queries would be where they are the smaller side or are done first, and they grow with the vectors
    both = sizes.join(asked.hint("merge"), "cell").hint("broadcast")
    part = lambda key, many: F.pmod(F.xxhash64(key), many.cast("long")).cast("int")
    left = lists.join(both, "cell").withColumn("block", part("class_id", F.col("blocks"))).withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("cell", "block", "grp", "class_id", "code", "term")
    right = probe.join(both, "cell").withColumn("grp", part("asker", F.col("groups"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "block", "grp", "asker", "q", "base", "most", "must")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"asker": pd.Series(dtype="int64"), "class_id": pd.Series(dtype="int64"), "d": pd.Series(dtype="float32")})
        codes = np.frombuffer(b"".join(a["code"]), np.uint8).reshape(len(a), -1)
        q = np.frombuffer(b"".join(b["q"]), np.float32).reshape(len(b), -1)
        d = b["base"].to_numpy()[:, None] + a["term"].to_numpy()[None]
        table = comparing.tables(q)
        for p in range(codes.shape[1]):
            d += np.take(table[:, p], codes[:, p], 1)
        keep = d <= b["most"].to_numpy()[:, None]
        must = np.flatnonzero(b["must"].to_numpy())
        if len(must):
            top = np.argpartition(d[must], k, 1)[:, : k + 1] if len(a) > k + 1 else np.tile(np.arange(len(a)), (len(must), 1))
            keep[must[:, None], top] = True
        if len(a) > most:  # more can't be among the best of all; those that are as near as the last stay
            held = np.where(keep, d, np.inf)
            keep &= d <= np.partition(held, most - 1, 1)[:, most - 1 : most]
        i, j = np.nonzero(keep)
        return pd.DataFrame({"asker": b["asker"].to_numpy()[i], "class_id": a["class_id"].to_numpy()[j], "d": d[i, j]})

    where, most = ["cell", "block", "grp"], max(rerank, k + 1)
    found = left.groupBy(*where).cogroup(right.groupBy(*where)).applyInPandas(compare, "asker long, class_id long, d float")
    # the best by code of all cells together, and the k + 1 that a query is sure of are among them
    # (a block sends no more than that; those of many blocks are put together in parts first)
    best_of = lambda rows: F.slice(F.sort_array(rows), 1, most)
    parts_of = found.groupBy("asker", F.pmod("class_id", F.lit(SALTS)).alias("salt")).agg(best_of(F.collect_list(F.struct("d", "class_id"))).alias("top"))
    top = parts_of.groupBy("asker").agg(best_of(F.flatten(F.collect_list("top"))).alias("top"))
    pairs = top.select("asker", F.explode("top.class_id").alias("class_id"))
    askers = known.select(F.col("class_id").alias("asker"), F.col("v").alias("q"))
    # merges: a broadcast of pairs, vectors or results would pass through the driver, and they grow with the queries
    exact = pairs.join(askers.hint("merge"), "asker").join(known.select("class_id", "ids", "v").hint("merge"), "class_id")

    def score(batches):
        for b in batches:
            if len(b):
                x, q = scaled(np.stack(b["v"])), scaled(np.stack(b["q"]))
                s = np.einsum("ij,ij->i", x, q) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", q, q))
                yield pd.DataFrame({"asker": b["asker"], "class_id": b["class_id"], "ids": b["ids"], "far": -s})

    scored = exact.select("asker", "class_id", "ids", "v", "q").mapInPandas(score, "asker long, class_id long, ids array<long>, far double")
    near = scored.select("asker", "class_id", "far", F.explode("ids").alias("vec_id")).groupBy("asker").agg(F.sort_array(F.collect_list(F.struct("far", "vec_id", "class_id"))).alias("near"))
    best = members.select("asker", "query_id").join(near.hint("merge"), "asker")
    best = best.select("query_id", F.slice(F.filter("near", lambda x: (x["vec_id"] != F.col("query_id")) | (x["class_id"] != F.col("asker"))), 1, k).alias("near"))
    return best.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
