"""Benchmark decontamination by greedy string tiling (operator 3).

Texts and benchmark items become word sequences (lower case, ASCII punctuation
as white space).  Documents and items that share a seed of ``MIN_MATCH`` words
are joined; each pair is tiled by running Karp-Rabin: prefix hashes of the words
find all common runs of a search length, the longest non-overlapping ones are
marked, and the search length shrinks until ``MIN_MATCH``.  A tile may lie anywhere,
so passages whose parts were reordered are found as well.  A document that
covers at least ``COVERAGE`` of an item's words is contaminated.

Scale: the benchmark is the query set.  Its distinct texts are sent to the
executors in blocks of about ``BLOCK_BYTES`` (one block for usual benchmarks), each
a pass over all documents; of several blocks one at a time is held.  Item ids join
the matches by the text's digest, so no document is shuffled and a passage in a third of all documents is nothing special.  Seeds are looked up
for whole batches at once.  A document meets an item only by a seed that is not among
the item's most common ones, as many as a match can do without; and it is tiled, over the words
that their common seeds cover, only if these reach ``COVERAGE``.

Defined cases: NULL or empty texts and items have no words and match nothing;
items of fewer than ``MIN_MATCH`` words need all their words in one run; repeated
rows are judged alike; items that repeat are all reported; empty tables give no
rows; a text of any length is read whole; other columns are ignored by the report
and kept by ``decontaminate``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import documents, stored
from fieldloom.sources.tables import table

MIN_MATCH = 5
COVERAGE = 0.8
BLOCK_BYTES = 32 << 20
BATCH = 256                 # documents whose seeds are looked up at once
MODULUS = (1 << 61) - 1
BASE = 1_000_003

_PUNCT = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))
_FOLD = bytes.maketrans(_PUNCT + bytes(range(65, 91)), b" " * len(_PUNCT) + bytes(range(97, 123)))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def _prefix_hashes(seq: list[int]) -> list[int]:
    h = [0]
    for x in seq:
        h.append((h[-1] * BASE + x + 1) % MODULUS)
    return h


def tile(pattern: list, text: list, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (pattern start, text start, length) of the tiles."""
    ids: dict = {}
    p = [ids.setdefault(x, len(ids)) for x in pattern]
    t = [ids.setdefault(x, len(ids)) for x in text]
    ph, th = _prefix_hashes(p), _prefix_hashes(t)
    p_used, t_used = [False] * len(p), [False] * len(t)
    tiles: list[tuple[int, int, int]] = []

    def starts(used: list[bool], s: int) -> Iterator[int]:
        """Places from which s words are unmarked."""
        run = 0
        for i, u in enumerate(used):
            run = 0 if u else run + 1
            if run >= s:
                yield i - s + 1

    def scan(s: int) -> tuple[int, list[tuple[int, int, int]]]:
        power = pow(BASE, s, MODULUS)
        at: dict[int, list[int]] = {}
        for j in starts(t_used, s):
            at.setdefault((th[j + s] - th[j] * power) % MODULUS, []).append(j)
        found, longest = [], 0
        for i in starts(p_used, s):
            for j in at.get((ph[i + s] - ph[i] * power) % MODULUS, ()):
                if i and j and p[i - 1] == t[j - 1] and not p_used[i - 1] and not t_used[j - 1]:
                    continue  # part of the match that starts one word earlier
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not p_used[i + k] and not t_used[j + k]:
                    k += 1
                if k >= s:
                    found.append((k, i, j))
                    longest = max(longest, k)
        return longest, found

    s = max(min_match, min(20, len(p)))
    while s >= min_match:
        longest, found = scan(s)
        if longest > 2 * s:
            s = longest
            continue
        again = False
        for k, i, j in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if any(p_used[i:i + k]) or any(t_used[j:j + k]):
                again = True  # overlaps a longer tile; what is left of it is found by the next scan
                continue
            p_used[i:i + k] = [True] * k
            t_used[j:j + k] = [True] * k
            tiles.append((i, j, k))
        if all(p_used):
            break
        if again:
            continue
        s = s // 2 if s > 2 * min_match else min_match if s > min_match else 0
    return tiles


class Benchmark:
    """The items of one block with their seeds; finds the items that a text covers."""

    def __init__(self, items: list[tuple[str, str]], min_match: int = MIN_MATCH, coverage: float = COVERAGE):
        self.min_match, self.coverage = min_match, coverage
        self.items = [(i, w) for i, t in items if (w := words(t))]
        self.sizes = sorted({min(min_match, len(w)) for _, w in self.items})
        self.own: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(self.items)  # an item's seeds in order
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in self.sizes:
            here = [n for n, (_, w) in enumerate(self.items) if min(min_match, len(w)) == size]
            for n in here:
                self.own[n] = self._rolled(self._hashes(self.items[n][1]), size)
            keys, n_items = np.unique(np.concatenate([np.unique(self.own[n]) for n in here]), return_counts=True)
            probes = [(self._probes(n, size, keys, n_items), n) for n in here]
            value = np.concatenate([p for p, _ in probes])
            item = np.repeat([n for _, n in probes], [len(p) for p, _ in probes])
            order = np.argsort(value, kind="stable")
            bits = np.zeros(1 << 22, bool)
            bits[(keys >> np.uint64(42)).astype(np.int64)] = True
            self.seeds[size] = keys, bits, value[order], item[order]

    def _probes(self, n: int, size: int, keys: np.ndarray, n_items: np.ndarray) -> np.ndarray:
        """The item's seeds that make a text a candidate: all but its most common ones.

        Tiles over ``coverage`` of the words hold at least ``need`` seeds, so one of
        them is among the rarest, less ``need - 1``: a stem that many items share proposes nothing.
        """
        own = self.own[n]
        need = max(1, math.ceil(self.coverage * len(self.items[n][1]) / size - 1e-9))
        order = np.argsort(n_items[np.searchsorted(keys, own)], kind="stable")
        return np.unique(own[order[:max(1, len(own) - need + 1)]])

    @staticmethod
    def _hashes(tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(hash, tokens), np.int64, len(tokens)).view(np.uint64)

    @staticmethod
    def _rolled(h: np.ndarray, size: int) -> np.ndarray:
        """Karp-Rabin value of each run of ``size`` words."""
        n = len(h) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = h[:n].copy()
        for k in range(1, size):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
            out += h[k:k + n]
        out *= np.uint64(0xFF51AFD7ED558CCD)
        return out ^ (out >> np.uint64(32))

    def matches(self, texts: list[str | None]) -> list[list[tuple[str, float, int, int]]]:
        """Per text the covered items: (key, coverage, tiles, longest tile)."""
        tokens = [words(t) for t in texts]
        ends = np.cumsum([len(w) for w in tokens])
        flat = self._hashes([x for w in tokens for x in w])
        out: list[list[tuple[str, float, int, int]]] = [[] for _ in texts]
        for size in self.sizes:
            keys, bits, value, item = self.seeds[size]
            r = self._rolled(flat, size)
            at = np.flatnonzero(bits[(r >> np.uint64(42)).astype(np.int64)])
            at = at[np.isin(r[at], keys)]
            docs = np.searchsorted(ends, at, side="right")
            inside = at + size <= ends[docs]
            at, docs = at[inside], docs[inside]
            for d in np.unique(docs):
                here = at[docs == d]
                found, places = r[here], here - (ends[d - 1] if d else 0)
                lo, hi = np.searchsorted(value, np.unique(found)), np.searchsorted(value, np.unique(found), side="right")
                spans = [item[a:b] for a, b in zip(lo, hi) if b > a]
                for n in np.unique(np.concatenate(spans)).tolist() if spans else []:
                    got = self._tiled(n, size, tokens[d], places, found)
                    if got:
                        out[d].append(got)
        return out

    def _tiled(self, n: int, size: int, tokens: list[bytes], places: np.ndarray, found: np.ndarray) -> tuple[str, float, int, int] | None:
        """The item's match with a text that has the seeds ``found`` at ``places``, if it covers enough."""
        key, pattern = self.items[n]
        mine = np.flatnonzero(np.isin(self.own[n], found))
        bound = int(np.minimum(np.diff(mine), size).sum()) + size if len(mine) else 0  # words that any tile can hold
        if bound < self.coverage * len(pattern) - 1e-9:
            return None
        text: list = []
        end = 0
        for a in places[np.isin(found, self.own[n])].tolist():  # the runs that seeds cover, kept apart from each other
            if a > end:
                text.append(None)
            text += tokens[max(a, end):a + size]
            end = a + size
        tiles = tile(pattern, text, min(self.min_match, len(pattern)))
        covered = sum(k for _, _, k in tiles)
        if covered < self.coverage * len(pattern) - 1e-9:
            return None
        return key, covered / len(pattern), len(tiles), max(k for _, _, k in tiles)


def _keyed(benchmark: DataFrame) -> DataFrame:
    """The items with a text, and its digest ``_key``."""
    return benchmark.where(F.col("text").isNotNull()).select("item_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("_key"))


def _blocks(texts: DataFrame) -> Iterator[tuple[list[tuple[str, str]], bool]]:
    """The distinct texts with their digests, about ``BLOCK_BYTES`` at a time, and whether there are several blocks."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_BYTES))
    for b in range(n):
        yield [tuple(r) for r in texts.where(F.pmod(F.xxhash64("_key"), F.lit(n)) == b).collect()], n > 1


REPORT = "doc_id long, _key string, coverage double, n_tiles long, longest_tile long"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that it covers: doc_id, item_id, coverage, n_tiles, longest_tile."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    items = _keyed(benchmark)
    out = None
    for texts, several in _blocks(items.select("_key", "text").distinct()):
        sent = sc.broadcast(texts)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            b = Benchmark(sent.value)
            for batch in batches:
                for start in range(0, batch.num_rows, BATCH):
                    part = batch.slice(start, BATCH)
                    ids = part.column("doc_id").to_pylist()
                    got = [(i, *m) for i, ms in zip(ids, b.matches(part.column("text").to_pylist())) for m in sorted(ms)]
                    if got:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*got), (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()))],
                            names=["doc_id", "_key", "coverage", "n_tiles", "longest_tile"])

        found = rows.mapInArrow(run, REPORT)
        if several:  # the pass runs now, so that the next block takes this one's place in memory
            found = stored(found, "decontam-found")
            sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out.join(items.select("_key", F.col("item_id").cast("long")), "_key") \
        .select("doc_id", "item_id", "coverage", "n_tiles", "longest_tile")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that cover no item, with their own columns."""
    sc = docs.sparkSession.sparkContext
    for texts, several in _blocks(_keyed(benchmark).select("_key", "text").distinct()):
        sent = sc.broadcast(texts)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            b = Benchmark(sent.value)
            for batch in batches:
                for start in range(0, batch.num_rows, BATCH):
                    part = batch.slice(start, BATCH)
                    yield part.filter(pa.array([not m for m in b.matches(part.column("text").to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if several:
            docs = stored(docs, "decontam-rest")
            sent.destroy()
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
