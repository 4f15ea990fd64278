"""Secret scans: rules for the known forms, a character convolutional network over every candidate.

The rules' findings always stay. Every run of 12 or more key characters is a candidate, also where a rule's span touches it; a
small convolutional network in numpy reads each with its surroundings, window by window where it is long, and the largest logit
counts. What the network is surer of than a threshold becomes a `cnn` span, unless rules' spans cover it whole.

The network (character embedding, one convolution, largest value over positions, two dense layers) is trained on labelled
findings. Some are generated from a seed, in the forms that keys, passwords, tokens and their look-alikes take. The others are those
of all documents: what rules find there, without its keyword, are secrets, and candidates apart from these are none. Every distinct
window counts; a kind (secrets, look-alikes with and without digits) weighs as EVEN windows at most, so that the commonest doesn't
drown the others. A fifth of the candidates, by a hash of their text, is held out. A logistic fit on all of these calibrates the
logits; the threshold is the highest that still finds `recall` of the held-out secrets, of the generated ones and of the documents' alike.

The network is first fitted to what is generated. The documents' windows are then dealt out by a hash into shards of about SHARD;
in each epoch every shard goes on from the same network, with its own windows and the generated ones, and the mean of what the shards
reach is the next one. Parameters are summed up in fixed point, so neither the order of tasks nor their number matters. Logits are
rounded to 1/GRID, here as in scans: the held-out ones are then a bounded table of counts, from which fit and threshold are exact.

Edge cases: null and empty texts have no spans; very long texts and candidates are read whole, in work that grows with their length;
ties don't occur, since a kind's spans don't overlap; repeated rows are scanned alike; an empty table trains on what is generated and
gives no rows. Further columns are not read. Positions are code points.
"""

from __future__ import annotations

import copy
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces, platt, sampled

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
KINDS = ("assign", "access", "hex", "cnn")
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
LEAD, BODY, TRAIL = 24, 48, 8
WIDTH = LEAD + BODY + TRAIL
#: A kind of the documents' windows weighs as so many at most, and a shard has about so many of them.
EVEN, SHARD = 4000, 16384
#: Logits are multiples of 1/GRID, at most FAR in size.
GRID, FAR = 256, 128
#: Parameters are summed up as multiples of 1/FIXED.
FIXED = 1 << 32
#: Kinds of labelled windows: look-alikes without and with a digit, secrets.
PLAIN, DIGITS, SECRET = range(3)
#: Character ids: 0 for no character, 1 for what is not printable ASCII, then the printable ones.
CHARS = {chr(c): c - 30 for c in range(32, 127)}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The rules' findings: kind, start, end; by start, then kind as listed."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def covered(spans: list[tuple[int, int]], by: list[tuple[int, int]]) -> list[bool]:
    """Whether each span lies within what `by` covers together; both sorted by start, in one pass."""
    joined: list[list[int]] = []
    for s, e in by:
        if joined and s <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e])
    out, k = [], 0
    for s, e in spans:
        while k < len(joined) and joined[k][1] <= s:
            k += 1
        out.append(k < len(joined) and joined[k][0] <= s and e <= joined[k][1])
    return out


def windows(text: str, start: int, end: int, lead_to: int | None = None) -> np.ndarray:
    """Ids of the candidate with its surroundings; a row for each BODY characters of it, the last one moved back to be full.

    Characters of the candidate are offset by 128. What stands before it ends at `lead_to` (by default at its start)."""
    rows = []
    for a in range(start, end, BODY):
        a = max(start, min(a, end - BODY))
        b = min(end, a + BODY)
        at = a if a > start or lead_to is None else lead_to
        lead = text[max(0, at - LEAD) : at]
        ids = [0] * (LEAD - len(lead)) + [CHARS.get(c, 1) for c in lead] + [CHARS.get(c, 1) + 128 for c in text[a:b]]
        ids += [CHARS.get(c, 1) for c in text[b : b + TRAIL]]
        rows.append(ids + [0] * (WIDTH - len(ids)))
    return np.array(rows, np.uint8)


def labelled(text: str) -> list[tuple[int, str, np.ndarray]]:
    """(kind, value, windows) of what a text holds: the rules' values without their keyword, and the candidates apart from them."""
    base, found = base_spans(text), []
    for kind, s, e in base:
        at = e - len(ASSIGN.match(text, s)[2]) if kind == "assign" else s
        found.append((SECRET, text[at:e], windows(text, at, e, s)))
    k, reach = 0, 0
    for s, e in candidates(text):
        while k < len(base) and base[k][1] < e:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= s:
            value = text[s:e]
            found.append((DIGITS if any(c.isdigit() for c in value) else PLAIN, value, windows(text, s, e)))
    return found


def findings_of(docs: DataFrame, sample: int | None = None) -> DataFrame:
    """kind, value_hash, ids (of one window, as bytes): all distinct ones of all documents, or of about `sample` documents where a quick fit will do."""
    if sample is not None:
        docs = sampled(docs, sample, F.concat(F.lit("secrets "), F.col("doc_id").cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 1 << 20):
            rows = list({(k, zlib.crc32(v.encode()), w.tobytes()) for t in b.column(0).to_pylist() for k, v, ws in labelled(t or "") for w in ws})
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "value_hash", "ids"])

    return cut(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind int, value_hash long, ids binary").distinct())


def held_out(value_hash: Column) -> Column:
    """Whether a candidate is held out; 2654435761 less 2^32, so that the product is a long."""
    return F.pmod(F.pmod(value_hash * F.lit(2654435761 - (1 << 32)), F.lit(1 << 32)), F.lit(5)) == 0


def dealt(found: DataFrame, n: int) -> DataFrame:
    """shard, kinds, ids (as bytes): a row for each of n shards of windows, in an order of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, list[tuple[bytes, int]]] = {}
        for b in batches:
            for at, i, k in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                shards.setdefault(at, []).append((i, k))
        for at, rows in shards.items():
            rows.sort()
            yield pa.record_batch([pa.array([at], pa.int32()), pa.array([bytes(k for _, k in rows)], pa.binary()), pa.array([b"".join(i for i, _ in rows)], pa.binary())], names=["shard", "kinds", "ids"])

    rows = found.select(F.pmod(F.xxhash64("ids", "kind", "value_hash"), F.lit(n)).cast("int").alias("shard"), "ids", "kind")
    return cut(rows.repartitionById(n, F.col("shard")).mapInArrow(run, "shard int, kinds binary, ids binary"))


def generated(n: int = 4000, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """Labelled findings: half secrets, half look-alikes."""
    rng = np.random.default_rng(seed)
    one = lambda xs: xs[int(rng.integers(len(xs)))]
    draw = lambda chars, k: "".join(chars[i] for i in rng.integers(len(chars), size=k))
    size = lambda a, b: int(rng.integers(a, b))
    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    syl = "an er in on th re st en ti es ou at nd ha ion ment que lle der sch ung la do co ra pf ck kt bl tz ph gh mp rk lf ng wh str ft zw kn".split()
    word = lambda: "".join(one(syl) for _ in range(size(1, 5)))
    prose = lambda: " ".join(word() for _ in range(size(0, 6)))
    names = ["auth", "bearer", "key", "credential", "private_key", "access", "client", "pwd", "session", "signing", "webhook", "conn"]
    found = []
    for k in range(n):
        if k % 2:
            body = one([
                lambda: draw(low + up + dig, size(20, 64)), lambda: draw("0123456789abcdef", size(20, 65)), lambda: draw("0123456789ABCDEF", size(24, 65)),
                lambda: "sk_live_" + draw(low + up + dig, 24), lambda: "ghp_" + draw(low + up + dig, 36), lambda: "xox" + one("bp") + "-" + draw(dig, 11) + "-" + draw(low + up + dig, 24),
                lambda: draw(low + up + dig + "+/", size(24, 88)) + one(["", "=", "=="]), lambda: "eyJ" + draw(low + up + dig + "-_", 30) + "." + draw(low + up + dig + "-_", 40),
                lambda: "AIza" + draw(low + up + dig + "-_", 35), lambda: draw(up + dig, size(24, 41)),
            ])()
            lead = one([lambda: f"{prose()} {one(names)}{one(['=', ': ', ' = ', '=\"', ': \"'])}", lambda: prose() + one([" ", "\n", " \"", " '"])])()
        else:
            body = one([
                lambda: f"{word()}{size(0, 99)}.example.{one(['com', 'org', 'net'])}", lambda: f"{word()}.{word()}{size(0, 99)}.{one(['com', 'org', 'net', 'io'])}",
                lambda: "-".join([word(), word(), word(), str(size(0, 3000))]), lambda: f"{size(1990, 2030)}-{size(10, 13)}-{size(10, 29)}T{size(10, 24)}.{size(10, 60)}.{size(10, 60)}Z",
                lambda: "/".join([word(), word(), word() + str(size(0, 100)) + one([".py", ".html", ".txt", ".json"])]), lambda: "_".join(word() for _ in range(4)) + str(size(0, 10)),
                lambda: word().upper() + "-" + word().upper() + "-" + str(size(1000, 99999999)), lambda: f"{word()}.{word()}.v{size(1, 9)}.{size(0, 20)}.{size(0, 20)}-beta{size(1, 9)}",
                lambda: "+" + draw(dig, 2) + "-" + draw(dig, 3) + "-" + draw(dig, 4) + "-ext" + draw(dig, 3), lambda: "".join(word().title() for _ in range(4)) + str(size(0, 100)),
                lambda: "".join(word() for _ in range(3)).ljust(12, "e"), lambda: "".join(word() for _ in range(3)).ljust(12, "n").upper(), lambda: "".join(word() for _ in range(3)).ljust(12, "t").title() + one(["", ".", "-"]),
                lambda: "=" * size(8, 20) + word() + str(size(1, 9)) + "=" * size(8, 20), lambda: "//" + word() + ".example.com/" + word() + "/" + str(size(1, 999)),
            ])()
            lead = one([lambda: prose() + " ", lambda: prose() + "\n", lambda: f"{prose()} {word()}: ", lambda: prose() + "@", lambda: f"{prose()} {word()}.{size(0, 100)}@", lambda: prose() + " https:"])()
        found.append((lead, body, one(["", " " + prose(), "\n" + prose(), "\" " + prose(), ". " + prose()]), k % 2))
    return found


@dataclass
class CharCnn:
    emb: np.ndarray  # 256 x e
    conv: np.ndarray  # k*e x f
    conv_b: np.ndarray
    dense: np.ndarray  # f x d
    dense_b: np.ndarray
    out: np.ndarray  # d
    out_b: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    held_out: dict | None = None
    learned: dict | None = None

    def added(self) -> np.ndarray:
        """What a character adds to a filter, by its place under it: k x 256 x f."""
        return self.emb @ self.conv.reshape(-1, self.emb.shape[1], self.conv.shape[1])

    def forward(self, ids: np.ndarray, added: np.ndarray) -> tuple:
        n = ids.shape[1] - len(added) + 1
        a = np.take(added[0], ids[:, :n], 0)
        for j in range(1, len(added)):
            a += np.take(added[j], ids[:, j : n + j], 0)
        top = a.argmax(1)
        return top, *self.judged(np.take_along_axis(a, top[:, None], 1)[:, 0])

    def judged(self, best: np.ndarray) -> tuple:
        pooled = np.maximum(best + self.conv_b, 0)
        mid = np.maximum(pooled @ self.dense + self.dense_b, 0)
        return pooled, mid, mid @ self.out + self.out_b

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -30, 30)))

    def logits(self, ids: np.ndarray, block: int = 64) -> np.ndarray:
        added, z = self.added(), []
        for i in range(0, len(ids), block):
            at = ids[i : i + block].T  # positions first: the largest value alone is found faster so
            n = len(at) - len(added) + 1
            a = np.take(added[0], at[:n], 0)
            for j in range(1, len(added)):
                a += np.take(added[j], at[j : n + j], 0)
            z.append(self.judged(a.max(0))[-1])
        return np.clip(np.round(np.concatenate(z).astype(float) * GRID) / GRID, -FAR, FAR) if z else np.zeros(0)

    def learn(self, ids: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator, epochs: int) -> None:
        """Adam over mixed batches, from fresh moments."""
        (v, e), f = self.emb.shape, self.conv.shape[1]
        first, second, step = 0.0, 0.0, 0
        places, filters = np.arange(len(self.conv) // e)[:, None, None], np.arange(f)
        for _ in range(epochs):
            mixed = rng.permutation(len(ids))
            for i in range(0, len(mixed), 64):
                at = mixed[i : i + 64]
                top, pooled, mid, z = self.forward(ids[at], self.added())
                g = (weight[at] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) / len(at)).astype(np.float32)
                g_mid = g[:, None] * self.out * (mid > 0)
                g_pool = (g_mid @ self.dense.T) * (pooled > 0)
                # the gradient of `added`: summed up by place, character and filter
                cells = (places * v + ids[at][np.arange(len(at))[:, None], top + places]) * f + filters
                by = np.bincount(cells.ravel(), np.broadcast_to(g_pool, cells.shape).ravel(), len(places) * v * f).astype(np.float32).reshape(-1, v, f)
                g_emb, g_conv = (by @ self.conv.reshape(-1, e, f).transpose(0, 2, 1)).sum(0), self.emb.T @ by
                step += 1
                grad = np.concatenate([g_emb.ravel(), g_conv.ravel(), g_pool.sum(0), (pooled.T @ g_mid).ravel(), g_mid.sum(0), mid.T @ g])
                first = 0.9 * first + 0.1 * grad
                second = 0.999 * second + 0.001 * grad**2
                moved = 0.004 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-7)
                self.put(self.parameters() - np.append(moved, 0.002 * float(g.sum())))

    def parameters(self) -> np.ndarray:
        return np.concatenate([*(getattr(self, n).ravel().astype(float) for n in PARTS), [self.out_b]])

    def put(self, values: np.ndarray) -> None:
        at = 0
        for n in PARTS:
            old = getattr(self, n)
            setattr(self, n, values[at : at + old.size].reshape(old.shape).astype(old.dtype))
            at += old.size
        self.out_b = float(values[at])


#: The network's parameters, but for the last shift.
PARTS = ("emb", "conv", "conv_b", "dense", "dense_b", "out")


def epoch(shards: DataFrame, n: int, m: CharCnn, made: tuple[np.ndarray, np.ndarray], weights: list[float], seed: tuple[int, int]) -> np.ndarray:
    """The mean of the parameters that n shards reach from the network, each with its windows and the generated ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(m.parameters()), np.int64)
        for b in batches:
            for at, k, i in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                kinds, own = np.frombuffer(k, np.uint8), copy.copy(m)
                # a shard has an n-th of the documents' windows, and all generated ones
                weight = np.concatenate([np.ones(len(made[0])), np.array(weights)[kinds] * n])
                own.learn(np.concatenate([made[0], np.frombuffer(i, np.uint8).reshape(-1, WIDTH)]), np.concatenate([made[1], kinds == SECRET]), weight, np.random.default_rng([*seed, at]), 1)
                total += np.round(own.parameters() * FIXED).astype(np.int64)
        if total.any():
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "value"])

    got = shards.mapInArrow(run, "at int, value long").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    return got.column("value").to_numpy()[np.argsort(got.column("at").to_numpy())] / FIXED / n


def counted(found: DataFrame, m: CharCnn) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """kind, logit and number of windows: a bounded table, since logits are multiples of 1/GRID up to FAR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = m.logits(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, WIDTH))
            yield pa.record_batch([b.column(0), pa.array(np.round(z * GRID).astype(np.int32))], names=["kind", "z"])

    got = found.select("kind", "ids").mapInArrow(run, "kind int, z int").groupBy("kind", "z").count().toArrow()
    kind, z, n = (got.column(c).to_numpy() for c in ("kind", "z", "count"))
    order = np.lexsort((z, kind))
    return kind[order], z[order] / GRID, n[order]


def train(docs: DataFrame | None = None, recall: float = 0.97, sample: int | None = None, epochs: int = 6, seed: int = 5) -> CharCnn:
    """Fits the network to generated findings and to those of all `docs` (or of about `sample` of them); a fifth is held out for calibration and threshold.

    The model's `learned` says how many of the documents' windows of each kind it was fitted to; its `held_out` what the threshold does to those held
    out: recall of generated and of the documents' secrets, false alarms of look-alikes."""
    rng = np.random.default_rng(seed)
    made = [(w, y, zlib.crc32(v.encode())) for b, v, a, y in generated() for w in windows(b + v + a, len(b), len(b) + len(v))]
    ids, y, held = np.stack([m[0] for m in made]), np.array([float(m[1]) for m in made]), np.array([m[2] * 2654435761 % (1 << 32) % 5 == 0 for m in made])
    e, k, f, d = 8, 5, 32, 16
    init = lambda *s: (rng.standard_normal(s) * np.sqrt(2 / s[0])).astype(np.float32)
    m = CharCnn(init(256, e) * 4, init(k * e, f), np.zeros(f, np.float32), init(f, d), np.zeros(d, np.float32), init(d)[:, None][:, 0])
    m.learn(ids[~held], y[~held], np.ones((~held).sum()), rng, epochs)
    kind, z, n, weights = np.zeros(0, int), np.zeros(0), np.zeros(0, int), [1.0] * 3
    if docs is not None:
        found = findings_of(docs, sample).withColumn("held", held_out(F.col("value_hash")))
        counts = {(r["kind"], r["held"]): r["count"] for r in found.groupBy("kind", "held").count().collect()}
        m.learned = {name: counts.get((c, False), 0) for c, name in enumerate(("plain", "digits", "secret"))}
        weights = [min(1.0, EVEN / max(1, counts.get((c, False), 0) + counts.get((c, True), 0))) for c in range(3)]
        if some := sum(m.learned.values()):
            n_shards = max(1, round(some / SHARD))
            shards = dealt(found.where(~F.col("held")), n_shards)
            for r in range(epochs):
                m.put(epoch(shards, n_shards, m, (ids[~held], y[~held]), weights, (seed, r)))
        kind, z, n = counted(found.where("held"), m)
    own = m.logits(ids[held])
    yes = np.concatenate([y[held], kind == SECRET])
    m.slope, m.shift = platt(np.concatenate([own, z]), yes, weight=np.concatenate([np.ones(len(own)), n * np.array(weights)[kind]]))
    # sorted probabilities of the held-out secrets: how many there are, and where each value's end
    groups = [(np.sort(m.probability(own[y[held] == 1])), np.arange(1, int(y[held].sum()) + 1)), (m.probability(z[kind == SECRET]), np.cumsum(n[kind == SECRET]))]
    m.threshold = float(min(p[np.searchsorted(ends, int((1 - recall) * ends[-1]), "right")] for p, ends in groups if len(p)))
    share = lambda p, n: float(n[p >= m.threshold].sum() / n.sum()) if n.sum() else None
    sure, none = m.probability(z), kind != SECRET
    m.held_out = {"generated recall": share(groups[0][0], np.ones(len(groups[0][0]))), "documents' recall": share(sure[~none], n[~none]),
                  "false alarms": [share(m.probability(own[y[held] == 0]), np.ones(int((y[held] == 0).sum()))), share(sure[none], n[none])], "windows": int(held.sum() + n.sum())}
    return m


def scan_batch(texts: list[str | None], model: CharCnn) -> list[list[tuple[str, int, int, float]]]:
    """The spans of each text: the rules' (score 1), and the candidates that the network takes for secrets."""
    out, ids, where = [], [], []
    for i, text in enumerate(texts):
        base = base_spans(text) if text else []
        out.append([(*s, 1.0) for s in base])
        found = candidates(text) if text else []
        for (a, b), known in zip(found, covered(found, [(s, e) for _, s, e in base]), strict=True):
            w = windows(text, a, b)
            ids.append(w)
            where.append((i, a, b, len(w), known))
    if ids:
        p, k = model.probability(model.logits(np.concatenate(ids))), 0
        for i, a, b, n, known in where:
            best = float(p[k : k + n].max())
            k += n
            if best >= model.threshold and not known:
                out[i].append(("cnn", a, b, best))
    return [sorted(x, key=lambda s: (s[1], KINDS.index(s[0]))) for x in out]


def scan(docs: DataFrame, model: CharCnn) -> DataFrame:
    """doc_id, spans (kind, start, end, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            found = [[{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in x] for x in scan_batch(b.column(1).to_pylist(), model)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.record_batch([b.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (as text), n_cnn."""
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "cnn")
    return scanned.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("cnn"))
