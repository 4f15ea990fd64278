"""Prefix trie, near copies among embeddings and structure repair against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tracelode.llm import neardup, repair, trie

TURNS = "conv_id long, turn long, role string, text string"


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


# prefix trie ---------------------------------------------------------------------------------------------------------


def plain_trie(rows, every=100, most=6):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {c: own.get(c - c % every, [])[: (h := zlib.crc32(str(c).encode()) % most)] + own[c][h:] for c in own}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    total = {}
    for k in sorted(members, key=len, reverse=True):
        saved = (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        total[k] = (sum(total[x][0] for x in kids[k]) or 1, saved + sum(total[x][1] for x in kids[k]))
    digest = lambda k: hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), *total[k], digest(k)) for k, m in members.items()), key=str)


def test_trie_of_ties_nulls_repeats_and_a_long_conversation(spark):
    rng, rows = random.Random(3), []
    for c in [*range(130), 300, 1000]:
        rows += [(c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "cc"])) for t in range(rng.choice([1, 2, 3, 8]))]
    rows += [(7, t, "user", f"x{t % 3}") for t in range(120)] + [(None, 1, "user", "z")] * 3 + [(3, 5, "user", "same")] * 20
    extra = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{TURNS}, depth int, id string")
    assert rows_of(trie.rebuilt_trie(extra)) == plain_trie(rows)


def test_trie_totals_of_other_shapes(spark):
    """A path, a star and a random tree, whose depths leave gaps for the coins."""
    rng = random.Random(5)
    up = [None] + [k - 1 for k in range(1, 60)] + [0] * 30
    for k in range(len(up), 200):
        up.append(rng.randrange(k))
    depth, kids = [0] * len(up), defaultdict(list)
    for k, p in enumerate(up):
        if p is not None:
            depth[k] = depth[p] + 1
            kids[p].append(k)
    xor = lambda v: __import__("functools").reduce(lambda a, b: a ^ b, v, 0)
    rows = [(k, p, depth[k], len(kids[k]), xor(kids[k]), xor(depth[c] for c in kids[k]), k % 7) for k, p in enumerate(up)]
    want = [k % 7 for k in range(len(up))]
    for k in range(len(up) - 1, 0, -1):
        want[up[k]] += want[k]
    tree = spark.createDataFrame(rows, "id long, up long, depth long, n_children long, kids long, kid_depths long, w long")
    assert sorted(tuple(r) for r in trie.totals(tree, ("w",)).collect()) == list(enumerate(want))


def test_trie_of_conversations_as_they_are_and_of_none(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "bb"), (2, 0, "user", "a"), (5, 0, "user", "a")], TURNS)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert rows_of(trie.prefix_trie(df)) == [(1, 0, None, 3, 1, 1, 2, digest("")), (1, 1, 1, 3, 1, 1, 2, digest("2,5")), (1, 2, 1, 1, 0, 1, 0, digest("1"))]
    assert rows_of(trie.rebuilt_trie(df.limit(0))) == []


# structure repair ----------------------------------------------------------------------------------------------------

AFTER = {0: "u", "s": "u", "u": "a", "a": "u"}


def plain_repair(rows):
    """Each state's best (cost, audit, lines), row by row from the end."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        kept = convs[c]
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            kept += [(t is not None, t or 0, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    out = []
    for c, kept in convs.items():
        kept, seen, kinds = sorted(kept), set(), []
        for _, _, r, x in kept:
            bare = x.strip(" \t\n\x0b\f\r")
            kinds.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((r, x))
        said = lambda s: "user:" if s == "u" else "assistant:"

        def closed(best):
            for _ in range(4):
                for s, to in AFTER.items():
                    if to in best:
                        v = (best[to][0] + 3, "I" + best[to][1], (said(to), *best[to][2]))
                        if s not in best or v[:2] < best[s][:2]:
                            best[s] = v
            return best

        best = closed({0: (0, "", ()), "a": (0, "", ())})
        for (_, _, r, x), kind in reversed(list(zip(kept, kinds, strict=True))):
            now, more = {}, 3 if kind == "truncated" else 0
            for s, to in AFTER.items():
                ways = [(best[s][0] + 4, "D" + best[s][1], best[s][2])]
                if kind not in ("blank", "duplicate"):
                    ways.append((best[to][0] + 3 + more, "R" + best[to][1], (said(to) + x, *best[to][2])))
                    if r[:1] and r[:1] == to or s == 0 and r[:1] in ("s", "u"):
                        ways.append((best[r[0]][0] + more, "K" + best[r[0]][1], (f"{r}:{x}", *best[r[0]][2])))
                now[s] = min(ways, key=lambda v: v[:2])
            best = closed(now)
        initials, turns = [r[:1] for _, _, r, _ in kept], [t for some, t, _, _ in kept if some]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, lines = best[0]
        out.append((c, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [2, 64])
def test_repair_of_every_fault_in_chunks_of_any_size(spark, chunk):
    rng, rows = random.Random(3), []
    texts = ["a.", "bé", "", None, "cc!", " x? ", *(f"{k}." for k in range(40)), *map(str, range(40))]
    for c in [None, *range(40)]:
        rows += [(c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts)) for t in range(rng.choice([1, 2, 8, 40]))]
    rows += [(7, t, rng.choice(["user", "assistant", "system"]), f"x{t % 250}.") for t in range(300)] + [(3, 5, "user", "same")] * 40
    extra = spark.createDataFrame([(*r, 5, "x") for r in rows], f"{TURNS}, n int, code string")
    assert rows_of(repair.repaired_conversations(extra, chunk)) == plain_repair(rows)


def test_repair_of_what_is_dropped_whole_and_of_nothing(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "a.")], TURNS)
    assert rows_of(repair.repaired_conversations(df)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert rows_of(repair.repaired_conversations(df.limit(0))) == []


def test_vectors_of_speculative_starts_soon_differ_by_a_constant():
    rng = np.random.default_rng(1)
    codes = [rng.integers(0, 8, 40).tolist()]
    a, b = (repair.backwards(codes, np.array(end))[0, 0] for end in (repair.END, (9, 0, 2, 7)))
    assert len(set((a - b).tolist())) == 1


# near copies among embeddings ------------------------------------------------------------------------------------------


def plain_groups(rows, least=0.93):
    fine = [v is not None and label is not None and bool(v) and all(e is not None and np.isfinite(e) for e in v) and any(v) for _, label, v in rows]
    top, links, groups = list(range(len(rows))), [0] * len(rows), defaultdict(list)

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for i, (_, label, v) in enumerate(rows):
        if fine[i]:
            groups[label, len(v)].append(i)
    for g in groups.values():
        x = np.array([rows[i][2] for i in g], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = x @ x.T >= least
        np.fill_diagonal(s, False)
        for a, i in enumerate(g):
            links[i] = int(s[a].sum())
            for b in np.flatnonzero(s[a]):
                top[find(i)] = find(g[b])
    low = {}
    for i, (ident, _, _) in enumerate(rows):
        if ident is not None:
            low[find(i)] = min(low.get(find(i), ident), ident)
    return sorted(((ident, links[i], low.get(find(i)), ident == low.get(find(i))) for i, (ident, _, _) in enumerate(rows)), key=str)


def test_near_copies_of_all_kinds_of_vectors(spark):
    rng, rows = np.random.default_rng(1), []
    base = rng.normal(size=(30, 16))
    for i in range(900):
        v = (base[rng.integers(30)] + rng.normal(size=16) * rng.choice([0, 0.05, 0.2, 0.4])) * rng.choice([1, 1e-30, 1e30])
        rows.append((i, int(rng.integers(3)) if i % 50 else None, v.tolist()))
    rows += [(2000, 1, None), (2001, 1, [0.0] * 16), (2002, 1, [1.0, None] * 8), (2003, 1, [float("nan")] * 16), (2004, 2, [1.0, 2.0]), (2005, 2, [1.0, 2.0]), (2006, 2, [1.0, 2.01])]
    rows += [(2006, 1, rows[5][2]), (None, rows[7][1], rows[7][2]), (2007, 1, []), *[(3000 + k, 2, rows[9][2]) for k in range(100)]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, cls string, m int")
    assert rows_of(neardup.near_duplicates(df, block=64)) == plain_groups(rows)
    assert rows_of(neardup.near_duplicates(df.limit(0))) == []


def test_near_copies_without_clusters_keep_nearly_all_links(spark):
    """Pairs that k-means parts at random: their own recall, not that of groups around a centroid."""
    rng = np.random.default_rng(4)
    one = rng.normal(size=(1500, 32))
    two = one + rng.normal(size=one.shape) * 0.38
    rows = [(i, 0, v.tolist()) for i, v in enumerate(np.concatenate([one, two]))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    want = sum(r[1] for r in plain_groups(rows))
    assert 0.99 * want <= sum(r[1] for r in got.collect()) <= want
