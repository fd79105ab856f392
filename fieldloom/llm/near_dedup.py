"""Near-duplicate detection with bottom-k sketches (operator 6).

A document's set holds the hashes of its word shingles; its sketch is the
``K`` smallest of them, from one hash function.  Equal sets are one from the
start.  Two sets with similarity 0.8 share at least ``SHARED`` of their retained
values, but for a chance of 2e-14; so with each sketch ordered by how many sets
retain a value (rarest first), such a pair has a value in common among the first
``K - SHARED + 1``.  Only these go into the inverted lists: values of passages
that many documents share come last and hardly ever get there.

 1. Each list proposes its members against its ``HUBS`` smallest members, which
    is every pair in lists up to that size and linear in longer ones.
 2. The union sketch of a proposed pair estimates its similarity; pairs far below
    the threshold go, and with them one of similarity 0.8 by the same chance of 2e-14.
 3. The rest is verified on the full sets, recomputed for the documents concerned.
 4. Links form components.  Longer lists that still span several components are
    searched whole, in blocks of ``BLOCK`` members against each other inside
    tasks: pairs of different components are estimated, each in its first common
    list, and verified there on the full sets; only links come out.

So a link between different texts is lost by these two chances only, no list is capped, and a group of
thousands of near copies costs its size times ``HUBS``, not its square.

Scale: sketches are stored once (``K`` longs a document).  Values retained by one
set only drop out in the first aggregation.  Joins on hot values or hubs are
plain equi-joins that adaptive execution splits; a text that many rows repeat is
reduced to one before texts are shuffled for verification.

Defined cases: NULL text, or text without a word, has an empty set and is linked
with nothing; fewer words than a shingle are one shingle; repeated rows and exact
copies are linked; NULL doc_id never becomes a component's id unless all its ids
are NULL, and is then kept; an empty table gives no rows; other columns are
ignored by ``near_duplicates`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import WORD_CHAR, digest128, documents, let, stored, text_of
from fieldloom.llm.components import components

SHINGLE = 5                 # words; the query's contract has 4
PERCENT = 80                # similarity of a link
K = 64
SHARED = 24                 # P(Binomial(64, 0.8) < 24) = 2e-14
MIN_ESTIMATE = (SHARED - 0.5) / K  # an estimate misses no more often than the lists do
HUBS = 16
BLOCK = 3000                # members of a list in one task, and values of their full sets
BLOCK_ITEMS = 2_000_000
BATCH = 256


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    out = h[:n].copy()
    for k in range(1, size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
        out += h[k:k + n]
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


def text_digest() -> list[Column]:
    return [h.alias(n) for h, n in zip(digest128("text"), ("_t1", "_t2"))]


def _longs(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, _t1, _t2, n_shingles, key (digest of the set; NULL if empty), sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                b = batch.slice(start, BATCH)
                sets = [shingles(t, size) for t in b.column("text").to_pylist()]
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("_t1"), b.column("_t2"), pa.array(list(map(len, sets)), pa.int64()),
                     pa.array(keys, pa.binary()), _longs([s[:K] for s in sets])],
                    names=["doc_id", "_t1", "_t2", "n_shingles", "key", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).select("doc_id", *text_digest(), "text")
    return rows.mapInArrow(run, "doc_id long, _t1 long, _t2 long, n_shingles long, key binary, sketch array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two sketches: the share of the union's K smallest values that both retain."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, K)
    return let(union, lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))


def _similar_sizes(a: str, b: str) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def inverted_lists(sets: DataFrame) -> DataFrame:
    """(v, key, n, prefix): each set under the values of its prefix; ``prefix`` in the common order."""
    vals = sets.select("key", "n", F.size("sketch").alias("_m"), F.explode("sketch").alias("v"))
    common = vals.groupBy("v").count().where("count >= 2").withColumnRenamed("count", "_df")
    per = vals.join(common, "v").groupBy("key").agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("_df", "v"))).alias("_vs"))
    needed = F.least(F.lit(SHARED), F.ceil(F.col("n") * (PERCENT / 100) - 1e-9)).cast("int")
    take = F.greatest(F.size("_vs") - needed + 1, F.lit(0))  # values of this set alone fill the front
    per = per.withColumn("prefix", F.transform(F.slice("_vs", F.lit(1), take), lambda x: x["v"]))
    return per.select("key", "n", "prefix", F.explode("prefix").alias("v"))


def _proposed(lists: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of a list's members with its hubs."""
    nth = F.row_number().over(Window.partitionBy("v").orderBy("key"))
    hubs = lists.select("v", "key", "n").withColumn("_nth", nth).where(F.col("_nth") <= HUBS) \
        .select("v", F.col("key").alias("a"), F.col("n").alias("_na"))
    members = lists.select("v", F.col("key").alias("b"), F.col("n").alias("_nb"))
    return members.join(hubs, "v").where(F.col("a") < F.col("b")).where(_similar_sizes("_na", "_nb")).select("a", "b").distinct()


def _with(pairs: DataFrame, table: DataFrame, side: str, *columns: str) -> DataFrame:
    t = table.select(F.col("key").alias(f"_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in columns])
    return pairs.join(t, F.col(side) == F.col(f"_{side}")).drop(f"_{side}")


def _estimated(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    both = _with(_with(pairs, sets, "a", "sketch"), sets, "b", "sketch")
    return both.where(estimate(F.col("sketch_a"), F.col("sketch_b")) >= MIN_ESTIMATE).select("a", "b")


def _full_sets(keys: DataFrame, sets: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(key, items): the full sets of some keys, recomputed from one text each."""
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                b = batch.slice(start, BATCH)
                yield pa.RecordBatch.from_arrays(
                    [b.column("key"), _longs([shingles(t, size) for t in b.column("text").to_pylist()])], names=["key", "items"])

    need = keys.distinct().join(sets.select("key", "_t1", "_t2"), "key")
    texts = docs.select(text_of().alias("text")).select(*text_digest(), "text").groupBy("_t1", "_t2").agg(F.first("text").alias("text"))
    return stored(texts.join(need, ["_t1", "_t2"]).select("key", "text").mapInArrow(full, "key binary, items array<long>"), "near-sets")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the similarity."""
    items = _full_sets(pairs.select(F.explode(F.array("a", "b")).alias("key")), sets, docs, size)
    both = _with(_with(pairs, items, "b", "items"), items, "a", "items")
    same = F.size(F.array_intersect("items_a", "items_b"))
    both = both.select("a", "b", same.alias("_same"), (F.size("items_a") + F.size("items_b")).alias("_sum"))
    return both.where(F.col("_same") * 100 >= (F.col("_sum") - F.col("_same")) * PERCENT).select(F.col("a").alias("u"), F.col("b").alias("v"))


class _Postings:
    """For rows of values: how many values a row has in common with every other."""

    def __init__(self, rows: list[np.ndarray]):
        self.sizes = np.array(list(map(len, rows)), np.int64)
        self.ends = np.cumsum(self.sizes)
        flat = np.concatenate([np.zeros(0, np.int64), *rows])
        values, self.codes = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(rows)), self.sizes)
        rank = np.arange(len(flat)) - np.repeat(self.ends - self.sizes, self.sizes)
        order = np.argsort(self.codes, kind="stable")
        self.owner, self.rank = owner[order], rank[order]
        self.starts = np.searchsorted(self.codes[order], np.arange(len(values) + 1))

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, rank there and rank here of every occurrence of row i's values, in its order."""
        mine = self.codes[self.ends[i] - self.sizes[i]:self.ends[i]]
        spans = [slice(self.starts[x], self.starts[x + 1]) for x in mine]
        if not spans:
            return (np.zeros(0, np.int64),) * 3
        here = np.repeat(np.arange(len(mine)), [x.stop - x.start for x in spans])
        return np.concatenate([self.owner[x] for x in spans]), np.concatenate([self.rank[x] for x in spans]), here

    def common(self, i: int) -> np.ndarray:
        return np.bincount(self.of(i)[0], minlength=len(self.sizes))


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between components among the members of one list, or between two of its blocks."""
    v, left, right = pdf["v"].iloc[0], pdf["_i"].iloc[0], pdf["_j"].iloc[0]
    pdf = pdf.sort_values("key")
    codes, roots = pd.factorize(pdf["root"])
    out: list[tuple[bytes, bytes]] = []
    if len(roots) > 1:
        items, sizes, keys, block = pdf["items"].to_list(), pdf["n"].to_numpy(), pdf["key"].to_list(), pdf["_b"].to_numpy()
        sketches = _Postings([x[:K] for x in items])
        # a pair is looked at in the first list that both are in: no common value comes earlier
        earlier = _Postings([x[:np.flatnonzero(x == v)[0]] for x in pdf["prefix"]])
        largest, m = np.bincount(codes).argmax(), len(pdf)
        for i in np.flatnonzero(codes != largest):  # a pair of two components has a member outside the largest
            small = np.minimum(sizes, sizes[i])
            ok = (codes != codes[i]) & (small * 100 >= np.maximum(sizes, sizes[i]) * PERCENT)
            ok &= (codes == largest) | (np.arange(m) > i)
            if left != right:
                ok &= block != block[i]
            if not ok.any():
                continue
            ok &= earlier.common(i) == 0
            rows, there, here = sketches.of(i)
            ok &= np.bincount(rows, minlength=m) >= np.minimum(SHARED, np.ceil(small * (PERCENT / 100) - 1e-9))
            at = ok[rows]
            rows, there, here = rows[at], there[at], here[at]
            order = np.argsort(rows, kind="stable")
            rows, place = rows[order], (there + here)[order]
            nth = np.arange(len(rows)) - np.searchsorted(rows, rows)  # common values below this one
            retained = np.bincount(rows[place - nth < K], minlength=m)  # of those in the union's sketch
            union = np.minimum(K, sketches.sizes + sketches.sizes[i] - np.bincount(rows, minlength=m))
            ok &= retained >= MIN_ESTIMATE * union
            for j in np.flatnonzero(ok):
                if codes[i] == codes[j]:
                    continue
                same = np.intersect1d(items[i], items[j], assume_unique=True).size
                if same * 100 >= (sizes[i] + sizes[j] - same) * PERCENT:
                    out.append((keys[i], keys[j]))
                    codes[codes == codes[i]] = codes[j]  # the largest keeps its code
    return pd.DataFrame(out, columns=["u", "v"], dtype=object)


def _rest(lists: DataFrame, sets: DataFrame, roots: DataFrame, docs: DataFrame, size: int) -> DataFrame | None:
    """Links across components in lists that have more members than hubs; None without such lists."""
    long = lists.groupBy("v").agg(F.count("*").alias("_size"), F.sum("n").alias("_items")).where(F.col("_size") > HUBS + 1)
    rows = lists.join(long, "v").join(roots.withColumnRenamed("node", "key"), "key", "left") \
        .withColumn("root", F.coalesce("root", "key"))
    mixed = rows.groupBy("v").agg(F.min("root").alias("_r0"), F.max("root").alias("_r1")).where("_r0 <> _r1").select("v")
    rows = stored(rows.join(mixed, "v"), "near-rest")
    if rows.isEmpty():
        return None
    items = _full_sets(rows.select("key"), sets, docs, size)
    rows = rows.withColumn("_nb", F.greatest(F.ceil(F.col("_size") / BLOCK), F.ceil(F.col("_items") / BLOCK_ITEMS)).cast("int"))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("key"), F.col("_nb")).cast("int"))
    ij = F.transform(F.sequence(F.lit(0), F.col("_nb") - 1),
                     lambda o: F.struct(F.least(F.col("_b"), o).alias("_i"), F.greatest(F.col("_b"), o).alias("_j")))
    cols = ["v", "key", "n", "prefix", "root", "_b"]
    rows = rows.select(*cols, F.explode(ij).alias("_ij")).select(*cols, "_ij._i", "_ij._j").join(items, "key")
    return rows.groupBy("v", "_i", "_j").applyInPandas(_search, "u binary, v binary")


def linked(docs: DataFrame, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """The stored sketch rows, and (node, root) for the sets that have links."""
    rows = stored(sketched(docs, size), "near-sketches")
    sets = stored(rows.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"),
        F.min(F.struct("_t1", "_t2")).alias("_t")).select("key", "n", "sketch", "_t._t1", "_t._t2"), "near-sets")
    lists = stored(inverted_lists(sets), "near-lists")
    pairs = stored(_estimated(_proposed(lists), sets), "near-pairs")
    edges = stored(_verified(pairs, sets, docs, size), "near-edges")
    roots = components(edges)
    rest = _rest(lists, sets, roots, docs, size)
    if rest is not None:  # the components so far stand for their links
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(stored(rest, "near-edges")))
    return rows, roots


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per document."""
    rows, roots = linked(docs, size)
    rows = _rooted(rows.select("doc_id", "n_shingles", "key"), roots)
    first = rows.where(F.col("root").isNotNull()).groupBy(F.col("root").alias("_root")).agg(F.min("doc_id").alias("_first"))
    out = rows.join(first, F.col("root") == F.col("_root"), "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("_first"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One document of each component, the one with the smallest id, with its own columns; documents without words stay."""
    rows, roots = linked(docs, size)
    rows = _rooted(rows.where(F.col("key").isNotNull()).select("doc_id", "_t1", "_t2", "key"), roots)
    rank = F.struct(F.col("doc_id").isNull().alias("_no"), "doc_id", "_t1", "_t2")
    best = rows.groupBy("root").agg(F.min(rank).alias("_b")).select("_b.*")
    copies = rows.groupBy("doc_id", "_t1", "_t2").count()
    w, c = ["_wid", "_w1", "_w2"], ["doc_id", "_t1", "_t2"]
    win = best.join(copies.select(*[F.col(x).alias(y) for x, y in zip(c, w)], F.col("count").alias("_copies")),
                    F.col("doc_id").eqNullSafe(F.col("_wid")) & (F.col("_t1") == F.col("_w1")) & (F.col("_t2") == F.col("_w2")))
    win = stored(win.select(*w, "_copies"), "near-kept")
    own = F.struct(*[F.col(x) for x in docs.columns]).alias("_row")
    texts = docs.select(own, "doc_id", text_of().alias("text")).select("_row", "doc_id", *text_digest(), F.col("text").rlike(WORD_CHAR).alias("_word"))
    kept = texts.where("_word").join(win, F.col("doc_id").eqNullSafe(F.col("_wid")) & (F.col("_t1") == F.col("_w1")) & (F.col("_t2") == F.col("_w2")))
    out = texts.where(~F.col("_word")).select("_row").unionByName(kept.where("_copies = 1").select("_row"))
    if not win.where("_copies > 1").isEmpty():  # repeated rows of one id and text: any one of them
        out = out.unionByName(kept.where("_copies > 1").groupBy("doc_id", "_t1", "_t2").agg(F.first("_row").alias("_row")).select("_row"))
    return out.select("_row.*")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), 4)
