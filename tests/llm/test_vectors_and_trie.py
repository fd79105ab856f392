"""Embedding near-dedup, vector codes and the prefix trie against brute force and on awkward tables."""
from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from fieldloom.llm import nn_descent, prefix_trie, vector_codes
from tests.llm.cases import key

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id bigint, embedding array<float>, label int, n_links string, code string, root int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, g, "x", "y", 1) for i, e, g in rows], VECTORS).repartition(4)


def odd_vectors():
    return [(900, None, 1), (901, [], 1), (902, [0.0] * 8, 2), (903, [NAN] + [1.0] * 7, 2), (904, [INF] + [1.0] * 7, None), (905, [None] + [1.0] * 7, None)]


# --- op11 -----------------------------------------------------------------------------

def some_vectors(n=160, dim=8, seed=3):
    """Lone vectors, exact copies, pairs at the threshold, and a dense group wider than the angle of a link."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[10:20] = x[10]
    for i in range(20, 60, 2):
        a, e = x[i] / np.linalg.norm(x[i]), rng.standard_normal(dim)
        e -= e @ a * a
        c = rng.uniform(0.88, 0.95)
        x[i + 1] = 3 * (c * a + np.sqrt(1 - c * c) * e / np.linalg.norm(e))
    a = x[60] / np.linalg.norm(x[60])
    x[60:130] = a + rng.standard_normal((70, dim)) * 0.16
    return x.astype(np.float32)


def brute_links(rows):
    """vec_id -> (links, smallest reachable id)."""
    good = [(i, np.array(e, float)) for i, e, _ in rows if e and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    edges = [(p, q) for p in range(len(good)) for q in range(len(good)) if p != q and len(good[p][1]) == len(good[q][1])
             and nn_descent.cosine(good[p][1][None], good[q][1][None])[0] >= nn_descent.THRESHOLD]
    root = list(range(len(good)))
    for _ in range(len(good)):
        for p, q in edges:
            root[p] = root[q] = min(root[p], root[q], key=lambda k: good[k][0])
    out = {i: (0, i) for i, _, _ in rows}
    for p, (i, _) in enumerate(good):
        out[i] = sum(a == p for a, _ in edges), good[root[p]][0]
    return out


@pytest.mark.parametrize("longest", [32, 4])
def test_links_match_brute_force(spark, monkeypatch, longest):
    """With short lists the dense group is counted in blocks."""
    monkeypatch.setattr(nn_descent, "MAX_NEIGHBOURS", longest)
    monkeypatch.setattr(nn_descent, "NEIGHBOURS", 4)
    rows = [(i, e.tolist(), 0) for i, e in enumerate(some_vectors())] + odd_vectors() + [(800, [1.0, 0.0], 0), (801, [2.0, 0.0], 0)]
    found = nn_descent.near_embeddings(vectors(spark, rows))
    got = {r.vec_id: r for r in found.rows.collect()}
    want = brute_links(rows)
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values()) and found.recall == 1.0


def test_blocks_count_as_pairs_do(spark, monkeypatch):
    """Sure, impossible and compared blocks give each member its links."""
    monkeypatch.setattr(nn_descent, "BLOCK", 5)
    x = some_vectors()[60:130].astype(float)
    df = spark.createDataFrame([(i, v.tolist(), 1 + i % 3) for i, v in enumerate(x)], "id bigint, vec array<double>, weight bigint")
    roots = spark.createDataFrame([(i, 0) for i in range(len(x))], "node bigint, root bigint")
    got = {r.id: r.n for r in nn_descent._dense_counts(df, roots, spark.createDataFrame([(0,)], "root bigint")).collect()}
    u = nn_descent.unit(x)
    for i in range(len(x)):
        assert got.get(i, 0) == sum(1 + j % 3 for j in range(len(x)) if j != i and u[i] @ u[j] >= nn_descent.THRESHOLD)


def test_links_of_empty_and_repeated_rows(spark):
    assert nn_descent.near_embeddings(vectors(spark, [])).rows.count() == 0
    rows = [(5, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (None, None, None), (3, [2.0, 4.0], 1)]
    got = sorted((tuple(r) for r in nn_descent.near_embeddings(vectors(spark, rows)).rows.collect()), key=key)
    assert got == sorted([(5, 3, 3, False), (5, 3, 3, False), (None, 3, 3, False), (None, 0, None, True), (3, 3, 3, True)], key=key)


# --- op12 -----------------------------------------------------------------------------

def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = sorted([(i, [int(np.floor(1024 * np.float64(v))) for v in e], g) for i, e, g in rows
                   if e is not None and all(v is not None and np.isfinite(v) for v in e)], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], ""
    width = len(kept[0][1]) // parts
    cut = [[r[1][p * width:(p + 1) * width] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            d = [[(sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])] for p in range(parts)]
            out.append([min(x) for x in d])
        return out

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, got) if a[p][1] == k]
                if mine:
                    books[p][k] = [sum(v) // len(mine) for v in zip(*mine)]
    got = assign()
    label = collections.Counter()
    for r, a in zip(kept, got):
        label[r[2]] += sum(d for d, _ in a)
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [(r[0], "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), label[r[2]]) for r, a in zip(kept, got)], digest


@pytest.mark.parametrize("scale", [1.0, 3e7])
def test_codes_match_brute_force(spark, monkeypatch, scale):
    """Also with integers whose squares don't fit 64 bits: there errors may be NULL, codes and codebooks are exact."""
    monkeypatch.setattr(vector_codes, "ENTRIES", 9)
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((60, 8)) * scale).astype(np.float32)
    x[5], x[6] = x[4], -x[4]
    rows = [(i, v.tolist(), [None, 1, 2][i % 3]) for i, v in enumerate(x)] + [(7, x[7].tolist(), 1), (None, x[8].tolist(), 2), (2, x[9].tolist(), None)]
    want, digest = brute_codes(rows, entries=9)
    coded, books = vector_codes.encode(vectors(spark, rows + [r for r in odd_vectors() if r[1] != [] and r[0] != 902]))
    got = sorted(((r.vec_id, r.code, r.error) for r in coded.collect()), key=key)
    fits = lambda v: v if v <= vector_codes.LONG_MAX else None
    assert got == sorted(((i, c, fits(e)) for i, c, e, _ in want), key=key)
    assert vector_codes.digest(books) == digest


def test_codes_of_odd_tables(spark):
    rows, books = vector_codes.encode(vectors(spark, []))
    assert rows.count() == 0 and len(books) == vector_codes.PARTS
    rows, _ = vector_codes.encode(vectors(spark, odd_vectors()[:1] + odd_vectors()[3:]))
    assert rows.count() == 0
    rows, _ = vector_codes.encode(vectors(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 4, 1), (3, [2.0] * 8, 1)]))
    assert {r.vec_id: (r.code, r.error) for r in rows.collect()} == {1: ("00000000", 0), 2: (None, None), 3: ("01010101", 0)}


# --- op13 -----------------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string, depth int, k1 string"


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + v[h:]
    nodes = collections.defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    out = []
    for path, members in nodes.items():
        under = [p for p in nodes if p[:len(path)] == path]
        childless = [p for p in under if not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in under)]
        saved = sum((len(nodes[p]) - 1) * len((p[-1][1] if p else "").encode().split()) for p in under)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
                    sum(len(q) == len(path) + 1 for q in under), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=key)


def conversations(n, seed):
    rng = random.Random(seed)
    turns = [("user", "hi"), ("assistant", "hello there"), ("user", "x y z"), (None, "hi"), ("user", None), ("", ""), ("userh", "i")]
    rows = []
    for c in [*range(n), 40 * n, 40 * n + 7]:
        for t in range(rng.choice([1, 1, 2, 3, 6])):
            rows.append((c, rng.choice([t, t, t, None, 0]), *turns[min(int(rng.expovariate(0.9)), len(turns) - 1)]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_matches_brute_force(spark, monkeypatch, seed):
    if seed == 2:  # a screen that proves next to nothing, and lists in many pieces
        monkeypatch.setattr(prefix_trie, "MIN_SLOTS", 64)
        monkeypatch.setattr(prefix_trie, "MAX_SLOTS", 64)
        monkeypatch.setattr(prefix_trie, "PIECE", 2)
    rows = conversations(70, seed) + [(None, 1, "user", "lost"), (33, 5, "user", "again"), (33, 5, "user", "again")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS).repartition(3)
    got = sorted(map(tuple, prefix_trie.trie(df).select(*prefix_trie.COLUMNS).collect()), key=key)
    assert got == brute_trie(rows)


def test_conversation_over_many_tasks(spark, monkeypatch):
    """One conversation with most rows is sorted over all tasks; its keys are put together from their pieces."""
    rows = [(21, i, "user", f"turn {i}") for i in range(900)] + [(c, i, "user", f"turn {i}") for c in (0, 20, 22) for i in range(4)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS).repartition(4)
    carried, joined = [], prefix_trie._joined
    monkeypatch.setattr(prefix_trie, "_joined", lambda runs, c: carried.append(c) or joined(runs, c))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = prefix_trie.ordered_turns(df)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(carried[0]) >= 4 and turns.where("conv_id = 21").agg({"k": "max"}).first()[0] == 900
    monkeypatch.setattr(prefix_trie, "ordered_turns", lambda _: turns)
    got = sorted(map(tuple, prefix_trie.trie(df).select(*prefix_trie.COLUMNS).collect()), key=key)
    short = [r for r in rows if r[0] != 21 or r[1] < 12]  # brute force on a shortened copy, then the tail of single turns
    want = [w for w in brute_trie(short) if w[1] < 10]
    cut = lambda r: (r[0], r[1], r[2], r[3], r[4], r[5], r[6])
    assert [cut(g) for g in got if g[1] < 10] == [cut(w) for w in want]
    assert sum(g[1] >= 10 for g in got) == 900 - 9 and max(g[1] for g in got) == 900


def test_trie_of_an_empty_table(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0
