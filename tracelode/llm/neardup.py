"""Near copies among embeddings: spherical k-means cells, blocked cosine products within them, one representative a group.

Vectors are compared only where their labels (and lengths) are equal. Equal vectors are one class from the start, with a count. Centroids are
fitted on a bounded sample of classes; every class has its home, the nearest centroid, and cells are (label, length, centroid).

A cell's core is what lies within half the linking angle of its centroid: its members all link each other, which needs no comparison, so a
group of near copies of any size costs in proportion to its size. Centroids closer than a quarter of that angle to an earlier one are dropped, so that such a
group isn't torn over many cells. All else is compared in blocks, each two vectors in one place:
- vectors within one and a half linking angles of a centroid visit its core, of other cores those of larger homes alone. Nothing is missed here: no other vector can link with a member.
- vectors outside of cores meet those outside of the core of their own cell, and visit the same of other cells if they lie near the border. Two
  linked vectors lie within p of the border together, p being their distance along the line through both centroids; so one of them lies
  within p / 2, and p is about the distance over the square root of the number of dimensions in which vectors differ (estimated from the sample). Visitors come
  from within `reach` times that (4; never more than what is exact, half of the distance itself), so a pair in a hundred thousand may be missed.

Blocks send counts of links and a spanning forest, never pairs.

Edge cases: vectors that are null, zero, or hold a null or non-finite component link with nothing, and neither do those with a
null label; each is its own group. Rows with equal ids are vectors of their own; a null id is never a group's smallest, and a
group of nulls alone has none. Components of any size are scored (vectors are scaled by a power of two). An empty table gives an empty one. Further columns
are not read."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ann import scaled
from .common import cut, sampled
from .simhash import components

SAMPLE, MOST_SAMPLED = 8192, 65536
CORE, REST = 0, 1


@dataclass
class Cells:
    centroids: np.ndarray  # unit vectors
    angle: float  # of a link
    reach: float  # how near to a border a vector visits the other side

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Products with all centroids, the nearest, and whether the vector lies in its core."""
        near = self.products(x)
        home = near.argmax(1)
        return near, home, near[np.arange(len(x)), home] >= np.cos(self.angle / 2 - 1e-6)

    def products(self, x: np.ndarray) -> np.ndarray:
        width = max(x.shape[1], self.centroids.shape[1])
        wide = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
        return wide(x) @ wide(self.centroids).T

    def visits(self, near: np.ndarray, home: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector, which cores and which other rests it visits."""
        n, k = near.shape
        cores = near >= np.cos(min(np.pi, 1.5 * self.angle + 1e-6))
        cores &= ~core[:, None] | (np.arange(k)[None] < home[:, None])
        own = np.zeros((n, k), bool)
        own[np.arange(n), home] = True
        cores &= ~(own & core[:, None])
        apart = np.sqrt(np.maximum(0, 2 - 2 * (self.centroids @ self.centroids.T)))[home]
        rests = (near[np.arange(n), home][:, None] - near <= self.reach * apart) & ~own & ~core[:, None]
        return cores, rests


def fit(x: np.ndarray, n: int, least: float, reach: float = 4.0, seed: int = 3, rounds: int = 12) -> Cells:
    """Spherical k-means of a sample of n vectors."""
    rng = np.random.default_rng(seed)
    cells = max(1, min(len(x) // 8, int(np.sqrt(n))))
    angle = float(np.arccos(least))
    c = x[rng.permutation(len(x))[:cells]].copy()
    own = np.zeros(len(x), int)
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1)
        c[size > 1e-9] = sums[size > 1e-9] / size[size > 1e-9, None]
    # the fullest first: those that lie close to an earlier one are dropped
    c = c[np.argsort(-np.bincount(own, minlength=len(c)), kind="stable")]
    kept = np.zeros(len(c), bool)
    close = c @ c.T >= np.cos(angle / 4)
    for i in range(len(c)):
        kept[i] = not (close[i] & kept).any()
    c = c[kept]
    r = x - c[np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])]
    spread = np.linalg.eigvalsh(r.T @ r / len(r))
    dims = max(1.0, spread.sum() ** 2 / max(1e-12, (spread**2).sum()))
    far = np.sqrt(2 - 2 * least)
    return Cells(c, angle, float(far / 2 * min(1.0, reach / np.sqrt(dims))))


def units(vectors) -> np.ndarray:
    """Rows of length 1 in doubles; shorter ones are filled up with zeros."""
    width = max(map(len, vectors), default=1)
    x = scaled(np.stack([v if len(v) == width else np.pad(v, (0, width - len(v))) for v in vectors]))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(rows: DataFrame, salts: int = 32) -> DataFrame:
    """cls, label, v, m (rows), first (smallest id) of each label and vector; salted, so the rows of one vector are put together in many places."""
    salted = rows.groupBy("label", "v", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).alias("salt")).agg(F.count("*").alias("m"), F.min("vec_id").alias("first"))
    return salted.groupBy("label", "v").agg(F.sum("m").alias("m"), F.min("first").alias("first")).withColumn("cls", F.monotonically_increasing_id())


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes can reach over the edges i, j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicates(vectors: DataFrame, least: float = 0.93, vec: str = "embedding", reach: float = 4.0, sample: int = SAMPLE, most_sampled: int = MOST_SAMPLED, block: int = 512) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept, of every row vec_id, label, `vec`."""
    kind = vectors.schema[vec].dataType
    v = F.col(vec) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else F.col(vec).cast("array<double>")
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(v, lambda e: e != 0)
    joins = F.col("label").isNotNull() & F.coalesce(v.isNotNull() & fine, F.lit(False))
    rows = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"), joins.alias("joins")))
    some, none = rows.where("joins"), rows.where("not joins")
    alone = none.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    known = cut(classes(some))
    n = known.count()
    if not n:
        return alone
    few = sampled(known, int(min(most_sampled, max(sample, 32 * n**0.5))), F.hash("v")).orderBy("v").select("v").toArrow().column(0)  # a bounded sample
    cells = fit(units(few.to_pylist()), n, least, reach)

    def place(batches):
        for whole in batches:
            for b in (whole[i : i + 1024] for i in range(0, len(whole), 1024)):
                if not len(b):
                    continue
                near, home, core = cells.homes(units(b["v"].tolist()))
                cores, rests = cells.visits(near, home, core)
                yield pd.DataFrame({"cls": b["cls"], "home": home.astype(np.int32), "core": core, "cores": [np.flatnonzero(c).astype(np.int32) for c in cores], "rests": [np.flatnonzero(c).astype(np.int32) for c in rests]})

    placed = known.select("cls", "v").mapInPandas(place, "cls long, home int, core boolean, cores array<int>, rests array<int>").withColumnRenamed("cls", "of")
    at = cut(known.join(placed, F.col("cls") == F.col("of")).select("cls", "label", F.size("v").alias("len"), "v", "m", "first", "home", "core", "cores", "rests"))
    zone = ["label", "len", "cell", "zone"]
    lives = at.select("label", "len", F.col("home").alias("cell"), F.when(F.col("core"), CORE).otherwise(REST).alias("zone"), "cls", "v", "m", "home", "rests")
    each = F.concat(
        F.transform("cores", lambda c: F.struct(c.alias("cell"), F.lit(CORE).alias("zone"))), F.transform("rests", lambda c: F.struct(c.alias("cell"), F.lit(REST).alias("zone"))),
        F.when(F.col("core"), F.array().cast("array<struct<cell:int,zone:int>>")).otherwise(F.array(F.struct(F.col("home").alias("cell"), F.lit(REST).alias("zone")))),
    )
    comes = at.select("label", "len", F.inline(each), "cls", "v", "m", "home")
    # how many blocks of members and of visitors each zone has
    blocks = lives.groupBy(*zone).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    groups = comes.groupBy(*zone).agg(F.ceil(F.count("*") / block).cast("int").alias("groups"))
    both = cut(blocks.join(groups, zone))
    part = lambda many: F.pmod(F.xxhash64("cls"), many.cast("long")).cast("int")
    left = lives.join(both, zone).withColumn("block", part(F.col("blocks"))).withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    right = comes.join(both, zone).withColumn("grp", part(F.col("groups"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    where = [*zone, "block", "grp"]

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"cls": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
        if not len(a) or not len(b):
            return nothing
        x, y = units(a["v"].tolist()), units(b["v"].tolist())
        s = x @ y.T
        i, j = np.nonzero(s >= least - 1e-9)
        close = np.abs(s[i, j] - least) < 1e-9
        if close.any():  # as the measure is defined, on the vectors as they are
            p, q = (scaled(np.stack(t["v"].tolist())) for t in (a, b))
            k = np.flatnonzero(close)
            p, q = p[i[k]], q[j[k]]
            exact = np.einsum("ij,ij->i", p, q) / np.sqrt(np.einsum("ij,ij->i", p, p) * np.einsum("ij,ij->i", q, q))
            keep = np.ones(len(i), bool)
            keep[k] = exact >= least
            i, j = i[keep], j[keep]
        ca, cb, ha, hb = a["cls"].to_numpy(), b["cls"].to_numpy(), a["home"].to_numpy(), b["home"].to_numpy()
        if int(a["zone"].iloc[0]) == REST:
            # within a rest each two meet twice; of two rests that both visit, the smaller cell counts
            back = np.zeros((len(a), len(cells.centroids)), bool)
            for r, cs in enumerate(a["rests"]):
                back[r, cs] = True
            one = np.where(ha[i] == hb[j], ca[i] < cb[j], (ha[i] < hb[j]) | ~back[i, hb[j]])
            i, j = i[one], j[one]
        if not len(i):
            return nothing
        nodes = np.concatenate([ca, cb])
        links = np.concatenate([np.bincount(i, b["m"].to_numpy()[j], len(a)), np.bincount(j, a["m"].to_numpy()[i], len(b))]).astype(np.int64)
        # a class may be in both: nodes are joined by their number
        ids, at_ = np.unique(nodes, return_inverse=True)
        root = ids[_forest(at_[i], at_[len(a) + j], len(ids))]
        total = np.bincount(at_, links, len(ids)).astype(np.int64)
        seen = total > 0
        return pd.DataFrame({"cls": ids[seen], "links": total[seen], "root": root[seen]})

    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # columns of their own: both come of one table
    found = left.groupBy(*where).cogroup(right.groupBy(*where)).applyInPandas(compare, "cls long, links long, root long")
    # the members of a core link each other
    cored = at.where("core").groupBy("label", "len", F.col("home").alias("cell")).agg(F.sum("m").alias("all"), F.min("cls").alias("root")).withColumnsRenamed({"label": "in_label", "len": "in_len"})
    within = at.where("core").join(cored, (F.col("label") == F.col("in_label")) & (F.col("len") == F.col("in_len")) & (F.col("home") == F.col("cell"))).select("cls", (F.col("all") - F.col("m")).alias("links"), "root")
    told = cut(found.unionAll(within).groupBy("cls", "root").agg(F.sum("links").alias("links")))
    roots = components(told.where("cls <> root").select(F.col("root").alias("u"), F.col("cls").alias("v"))).withColumnRenamed("node", "of")
    links = told.groupBy("cls").agg(F.sum("links").alias("links")).withColumnRenamed("cls", "linked")
    named = at.select("cls", "label", "v", "m", "first").join(roots, F.col("cls") == F.col("of"), "left").withColumn("top", F.coalesce("root", "cls"))
    smallest = named.groupBy("top").agg(F.min("first").alias("component_id")).withColumnRenamed("top", "over")
    named = named.join(links, F.col("cls") == F.col("linked"), "left").join(smallest, F.col("top") == F.col("over"))
    named = named.select(F.col("label").alias("of_label"), F.col("v").alias("of_v"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = some.join(named, (F.col("label") == F.col("of_label")) & (F.col("v") == F.col("of_v")))
    return alone.unionAll(out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")))


def drop_near_duplicates(vectors: DataFrame, **how) -> DataFrame:
    """vec_id of one vector of each group: the smallest."""
    return near_duplicates(vectors, **how).where("kept").select("vec_id")
