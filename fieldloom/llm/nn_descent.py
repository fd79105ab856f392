"""Near-duplicate embeddings by NN-descent (operator 11).

Equal vectors are one from the start, with their number as weight.  Over the
distinct vectors a neighbour graph is refined:

 1. Seed: in each of ``TABLES`` random orders (sign bits of random projections,
    sorted by range) every vector meets the ``WINDOW`` next ones.  A third of all rows with
    the same bits still spreads over tasks, as ties are broken by a hash.
 2. Rounds: a vector gathers its list and up to as many vectors that list it; pairs among
    these with one entry new to its list are compared, and each end takes the other if
    it beats its worst neighbour.  Lists hold ``NEIGHBOURS`` entries; one whose entries
    are all links is saturated and twice as long in the next round, up to
    ``MAX_NEIGHBOURS``.  Rounds end when under ``SETTLED`` of the entries change.
 3. Links are pairs whose cosine, recomputed in double precision, reaches the
    threshold.  They give the components.
 4. Lists that are saturated at their greatest length don't hold all links.  Components
    that have such lists are counted exactly: their members, sorted by
    the angle to the component's first vector, are compared block by block, but
    for blocks that two angles prove linked (their sum is under the threshold's
    angle) or apart (their difference is over it).  Only counts come out.
 5. Audit: the links of up to ``AUDIT`` vectors whose id is divisible by 100 (the first by
    hash) are counted against all rows.  While the graph has found fewer than ``RECALL`` of
    a vector's links on average, it is seeded again from other projections and refined on, ``PASSES`` times at most;
    ``Links.recall`` is what the audit measured.

So links inside dense groups are complete, and a sparse link is missed only if neither
seeds nor rounds met it; the audit measures that.

Scale: a round shuffles at most ``2 * MAX_NEIGHBOURS`` vectors a row, of a group
nothing more; best lists are cut map-side by window limits.  The audit's vectors are bounded by ``AUDIT``.

Defined cases: vectors that are NULL, empty or zero or hold NULL or non-finite components
link with nothing; vectors of different lengths don't link; rows that repeat one
vec_id are rows of their own, linked as equal vectors; a NULL vec_id is a
component's id only if all its ids are NULL, and then kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import release, stored
from fieldloom.llm.components import components
from fieldloom.llm.vector_codes import finite
from fieldloom.sources.tables import table

THRESHOLD = 0.9
TABLES, WINDOW, BITS = 16, 4, 30
NEIGHBOURS, MAX_NEIGHBOURS = 8, 32
SETTLED = 0.01
ROUNDS = 6
BLOCK = 2000
AUDIT, RECALL, PASSES = 1000, 0.99, 4
SLACK = 1e-7              # of an angle, far above rounding


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; the same for a pair in either order."""
    return np.einsum("ij,ij->i", unit(a), unit(b))


class _Vectors:
    """The vectors of an Arrow list column."""

    def __init__(self, col: pa.ListArray):
        self.starts, self.values = np.array(col.offsets[:-1]), np.array(col.values, np.float64)
        self.widths = np.diff(np.array(col.offsets))

    def by_width(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for w in np.unique(self.widths):
            at = np.flatnonzero(self.widths == w)
            yield at, self.values[self.starts[at][:, None] + np.arange(w)]


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored (id, vec, weight) of the distinct vectors, and (vec_id, id) of all rows; id is NULL where nothing can link."""
    vec = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), vec.alias("vec"))
    ok = finite(F.col("vec")) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("key", F.when(ok, F.sha2(F.concat_ws(",", F.col("vec").cast("array<string>")), 256)))
    distinct = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.first("vec").alias("vec"), F.count("*").alias("weight"))
    distinct = stored(distinct.select(F.monotonically_increasing_id().alias("id"), "key", "vec", "weight"), "nn-vectors")
    members = rows.select("vec_id", "key").join(distinct.select(F.col("key").alias("_key"), "id"), F.col("key") == F.col("_key"), "left")
    return distinct.select("id", "vec", "weight"), stored(members.select("vec_id", "id"), "nn-members")


def _signs(seed: int):
    """Batches of (id, vec) with their place in each random order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vecs = np.array(b.column("id")), _Vectors(b.column("vec"))
            for at, x in vecs.by_width():
                planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], TABLES * BITS))
                bits = (unit(x) @ planes > 0).reshape(len(at), TABLES, BITS)
                code = bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                n = len(at) * TABLES
                mix = (ids[at][:, None] * 0x2545F4914F6CDD1D + np.arange(TABLES)) * 0x9E3779B97F4A7C1 >> 20
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(TABLES, dtype=np.int32), len(at))), pa.array(np.full(n, x.shape[1], np.int32)),
                     pa.array(code.ravel()), pa.array(mix.ravel()), pa.array(np.repeat(ids[at], TABLES)),
                     b.column("vec").take(pa.array(np.repeat(at, TABLES)))], names=["t", "width", "code", "mix", "id", "vec"])
    return run


def _pairs(a: list, b: list, s: list) -> pa.RecordBatch:
    """Both directions of scored pairs."""
    x = [np.concatenate([np.zeros(0, t), *p]) for p, t in ((a, np.int64), (b, np.int64), (s, np.float64))]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0], x[1]])), pa.array(np.concatenate([x[1], x[0]])),
                                       pa.array(np.round(np.concatenate([x[2], x[2]]), 9))], names=["id", "other", "sim"])


_PAIR = "id long, other long, sim double"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row against the next ones of its order."""
    held = None
    for b in batches:
        ids, vecs = np.array(b.column("id")), _Vectors(b.column("vec"))
        same = np.array(b.column("t")).astype(np.int64) << 32 | np.array(b.column("width"))
        out: tuple[list, list, list] = ([], [], [])
        for at, x in vecs.by_width():
            u, tag, who = unit(x), same[at], ids[at]
            if held is not None and held[0].shape[1] == u.shape[1]:
                u, tag, who = np.vstack([held[0], u]), np.concatenate([held[1], tag]), np.concatenate([held[2], who])
            for step in range(1, WINDOW + 1):
                ok = np.flatnonzero((tag[step:] == tag[:-step]) & (who[step:] != who[:-step]))
                out[0].append(who[ok])
                out[1].append(who[ok + step])
                out[2].append(np.einsum("ij,ij->i", u[ok], u[ok + step]))
            held = u[-WINDOW:], tag[-WINDOW:], who[-WINDOW:]
        yield _pairs(*out)


def seeds(vectors: DataFrame, seed: int) -> DataFrame:
    rows = vectors.select("id", "vec").mapInArrow(_signs(seed), "t int, width int, code long, mix long, id long, vec array<double>")
    order = ["t", "width", "code", "mix"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_windows, _PAIR)


_LISTS = "id long, size int, near array<struct<other:bigint,sim:double,fresh:boolean>>"


def _best(pairs: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """(id, size, near): each vector's best entries, at most ``size``, best first; ``fresh`` where a list gains one.

    ``pairs`` has an int ``fresh``: 0 if the entry was in the list before.
    """
    order = Window.partitionBy("id").orderBy(F.col("sim").desc(), "other")
    top = pairs.withColumn("_nth", F.dense_rank().over(order)).where(F.col("_nth") <= MAX_NEIGHBOURS)
    lists = top.groupBy("id", "other").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    lists = lists.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("far"), "other", "fresh"))).alias("near"))
    lists = lists.withColumn("near", F.transform("near", lambda x: F.struct(x["other"], (-x["far"]).alias("sim"), (x["fresh"] == 1).alias("fresh"))))
    if sizes is None:
        size = F.lit(NEIGHBOURS)
    else:
        lists = lists.join(sizes, "id", "left")
        size = F.coalesce("size", F.lit(NEIGHBOURS))
    return lists.select("id", size.alias("size"), F.slice("near", F.lit(1), size).alias("near"))


def _grown() -> Column:
    """The length of a list for the next round: twice, if every entry is a link."""
    full = (F.size("near") >= F.col("size")) & F.forall("near", lambda x: x["sim"] >= THRESHOLD)
    return F.when(full, F.least(F.col("size") * 2, F.lit(MAX_NEIGHBOURS))).otherwise(F.col("size")).cast("int")


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs among the vectors that one vector gathers, at least one of them fresh, that better an end's list."""
    for b in batches:
        offsets = np.array(b.column("met").offsets)
        met = b.column("met").values
        ids, fresh, bar = np.array(met.field("other")), np.array(met.field("fresh")), np.array(met.field("bar"))
        vec = met.field("vec")
        starts, values, widths = np.array(vec.offsets[:-1]), np.array(vec.values, np.float64), np.diff(np.array(vec.offsets))
        out: tuple[list, list, list] = ([], [], [])
        for lo, hi in zip(offsets[:-1], offsets[1:]):
            _, at = np.unique(ids[lo:hi], return_index=True)
            at += lo
            if len(at) < 2 or not fresh[at].any():
                continue
            x = unit(values[starts[at][:, None] + np.arange(widths[lo])])
            s = x @ x.T
            i, j = np.triu_indices(len(at), 1)
            score = s[i, j]
            ok = (fresh[at][i] | fresh[at][j]) & (score > np.minimum(bar[at][i], bar[at][j]))
            out[0].append(ids[at][i[ok]])
            out[1].append(ids[at][j[ok]])
            out[2].append(score[ok])
        yield _pairs(*out)


def _round(vectors: DataFrame, lists: DataFrame) -> DataFrame:
    """Candidate pairs of one round."""
    entry = lists.select("id", "size", F.explode("near").alias("e"))
    nth = F.row_number().over(Window.partitionBy("other").orderBy(F.col("fresh").desc(), F.xxhash64("id"), "id"))
    back = entry.select(F.col("e.other").alias("other"), F.col("e.fresh").alias("fresh"), "id")
    back = back.withColumn("_nth", nth).where(F.col("_nth") <= MAX_NEIGHBOURS)
    back = back.join(lists.select(F.col("id").alias("other"), "size"), "other").where(F.col("_nth") <= F.col("size"))
    gathered = entry.select("id", "e.other", "e.fresh").unionByName(back.select(F.col("other").alias("id"), F.col("id").alias("other"), "fresh"))
    bar = F.when(F.size("near") >= _grown(), F.element_at("near", -1)["sim"]).otherwise(-1.0)
    known = vectors.select("id", "vec").join(lists.select(F.col("id").alias("_id"), bar.alias("bar")), F.col("id") == F.col("_id"))
    known = known.select(F.col("id").alias("other"), "vec", "bar")
    met = gathered.join(known, "other").groupBy("id").agg(F.collect_list(F.struct("other", "fresh", "bar", "vec")).alias("met"))
    return met.select("met").mapInArrow(_local_join, _PAIR)


def descend(vectors: DataFrame, start: DataFrame, n: int) -> DataFrame:
    """The refined lists (id, size, near) from stored lists whose entries are fresh."""
    spark, lists = vectors.sparkSession, start
    for _ in range(ROUNDS):
        found = _round(vectors, lists)
        old = lists.select("id", F.explode("near").alias("e")).select("id", "e.other", "e.sim", F.lit(0).alias("fresh"))
        new = _best(old.unionByName(found.withColumn("fresh", F.lit(1))), lists.select("id", _grown().alias("size")))
        new = stored(new, "nn-lists")
        release(spark, lists)
        lists = new
        changed = lists.agg(F.sum(F.size(F.filter("near", lambda x: x["fresh"])))).first()[0] or 0
        if changed <= SETTLED * n * NEIGHBOURS:
            break
    return lists


def _verified(lists: DataFrame, vectors: DataFrame) -> DataFrame:
    """(u, v), u > v, of the pairs in the lists whose cosine reaches the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = _Vectors(b.column("a")), _Vectors(b.column("b"))
            ok = np.zeros(b.num_rows, bool)
            for (at, x), (_, y) in zip(a.by_width(), c.by_width()):
                ok[at] = cosine(x, y) >= THRESHOLD
            yield b.select(["u", "v"]).filter(pa.array(ok))

    near = lists.select("id", F.explode("near").alias("e")).where(F.col("e.sim") >= THRESHOLD - SLACK)
    near = near.select(F.greatest("id", "e.other").alias("u"), F.least("id", "e.other").alias("v")).distinct()
    a = vectors.select(F.col("id").alias("u"), F.col("vec").alias("a"))
    b = vectors.select(F.col("id").alias("v"), F.col("vec").alias("b"))
    return near.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _count_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of each row of one block with the rows of another (or of its own)."""
    i, j = pdf["_i"].iloc[0], pdf["_j"].iloc[0]
    pdf = pdf.sort_values("id")
    x, w, ids, block = unit(np.stack(pdf["vec"].to_list()).astype(np.float64)), pdf["weight"].to_numpy(), pdf["id"].to_numpy(), pdf["_b"].to_numpy()
    left = np.flatnonzero(block == i)
    right = np.flatnonzero(block == j)
    n = np.zeros(len(pdf), np.int64)
    for s in range(0, len(left), 500):
        rows = left[s:s + 500]
        c = x[rows] @ x[right].T
        close = np.argwhere(np.abs(c - THRESHOLD) < 1e-9)
        hit = c >= THRESHOLD
        for a, b in close:  # decided as everywhere else
            hit[a, b] = np.einsum("j,j->", x[rows[a]], x[right[b]]) >= THRESHOLD
        hit &= rows[:, None] != right[None, :]
        n[rows] += hit @ w[right]
        if i != j:
            n[right] += hit.T @ w[rows]
    return pd.DataFrame({"id": ids, "n": n})


def _dense_counts(vectors: DataFrame, roots: DataFrame, dense: DataFrame) -> DataFrame:
    """(id, n): weights of all vectors of the same component linked with each member, for the components in ``dense``."""
    member = vectors.join(roots.select(F.col("node").alias("id"), "root").join(dense, "root"), "id")
    pivot = vectors.select(F.col("id").alias("root"), F.col("vec").alias("_pivot"))

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = _Vectors(b.column("vec")), _Vectors(b.column("_pivot"))
            angle = np.zeros(b.num_rows)
            for (at, x), (_, y) in zip(a.by_width(), c.by_width()):
                angle[at] = np.arccos(np.clip(cosine(x, y), -1, 1))
            yield pa.RecordBatch.from_arrays([b.column("root"), b.column("id"), b.column("weight"), b.column("vec"), pa.array(angle)],
                                             names=["root", "id", "weight", "vec", "angle"])

    rows = member.join(pivot, "root").select("root", "id", "weight", "vec", "_pivot") \
        .mapInArrow(angles, "root long, id long, weight long, vec array<double>, angle double")
    # blocks: sorted by range over the component and angle, and numbered within each task
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, k = None, 0
        for b in batches:
            out = []
            for r in b.column("root").to_pylist():
                k = k + 1 if r == root else 0
                root = r
                out.append(k // BLOCK)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "_nth"])

    order = ["root", "angle", "id"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_task", F.spark_partition_id()) \
        .mapInArrow(numbered, "root long, id long, weight long, vec array<double>, angle double, _task int, _nth long")
    rows = stored(rows.withColumn("_b", F.col("_task") * F.lit(1 << 32) + F.col("_nth")).drop("_task", "_nth"), "nn-dense")
    blocks = stored(rows.groupBy("root", "_b").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.sum("weight").alias("all")), "nn-blocks")
    other = blocks.select(F.col("root").alias("_root"), *[F.col(c).alias(f"{c}2") for c in ("_b", "lo", "hi", "all")])
    limit = math.acos(THRESHOLD)
    # of BLOCK rows each: the square of a component's blocks, but for those too far apart
    met = blocks.join(other, (F.col("root") == F.col("_root")) & (F.col("lo2") - F.col("hi") <= limit + SLACK) & (F.col("lo") - F.col("hi2") <= limit + SLACK))
    met = met.withColumn("sure", F.col("hi") + F.col("hi2") <= limit - SLACK)
    known = _sure_counts(rows, met)
    open_ = met.where("not sure").where(F.col("_b") <= F.col("_b2")).select("root", F.col("_b").alias("_i"), F.col("_b2").alias("_j"))
    sides = open_.select("root", "_i", "_j", F.explode(F.array_distinct(F.array("_i", "_j"))).alias("_b"))
    counted = rows.join(sides, ["root", "_b"]).select("root", "_i", "_j", "_b", "id", "weight", "vec") \
        .groupBy("root", "_i", "_j").applyInPandas(_count_blocks, "id long, n long")
    return known.unionByName(counted).groupBy("id").agg(F.sum("n").alias("n"))


def _sure_counts(rows: DataFrame, met: DataFrame) -> DataFrame:
    """Links proven by the angles: the weights of the sure blocks, without the row itself."""
    sure = met.where("sure").groupBy(F.col("root").alias("_root"), F.col("_b").alias("_block")).agg(
        F.sum("all2").alias("_all"), F.max((F.col("_b") == F.col("_b2")).cast("long")).alias("_own"))
    on = (F.col("root") == F.col("_root")) & (F.col("_b") == F.col("_block"))
    return rows.join(sure, on).select("id", (F.col("_all") - F.col("_own") * F.col("weight")).alias("n"))


@dataclass
class Links:
    """The result of ``near_embeddings``: a row per vector, and the audited recall."""
    rows: DataFrame
    recall: float


def _counts(vectors: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, n) for the vectors with links to others, n by weight; and the components (node, root)."""
    edges = stored(_verified(lists, vectors), "nn-links")
    roots = stored(components(edges), "nn-roots")
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    full = lists.where((F.size("near") >= MAX_NEIGHBOURS) & F.forall("near", lambda x: x["sim"] >= THRESHOLD - SLACK)).select("id")
    dense = stored(full.join(members, F.col("id") == F.col("node")).select("root").distinct(), "nn-saturated")
    both = edges.select(F.col("u").alias("id"), F.col("v").alias("other")).unionByName(edges.select(F.col("v").alias("id"), F.col("u").alias("other")))
    inside = members.join(dense, "root").select(F.col("node").alias("id"))
    both = both.join(inside, "id", "left_anti")
    weight = vectors.select(F.col("id").alias("other"), "weight")
    n = both.join(weight, "other").groupBy("id").agg(F.sum("weight").alias("n"))
    return stored(n.unionByName(_dense_counts(vectors, members, dense)), "nn-counts"), roots


def _audit(vectors: DataFrame, members: DataFrame, counts: DataFrame) -> float:
    """The share that was found of an audited vector's links, on average over those that have any."""
    asked = members.where("vec_id % 100 = 0 AND id IS NOT NULL").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(AUDIT)
    asked = asked.join(vectors.select("id", "vec"), "id").join(counts, "id", "left").select("id", "vec", F.coalesce("n", F.lit(0)).alias("n"))
    rows = asked.collect()  # at most AUDIT
    by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for w in {len(r.vec) for r in rows}:
        at = [r for r in rows if len(r.vec) == w]
        by_width[w] = np.array([r.id for r in at]), unit(np.array([r.vec for r in at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {w: np.zeros(len(who), np.int64) for w, (who, _) in by_width.items()}
        for b in batches:
            ids, weights, vecs = np.array(b.column("id")), np.array(b.column("weight")), _Vectors(b.column("vec"))
            for at, x in vecs.by_width():
                if x.shape[1] in by_width:
                    who, q = by_width[x.shape[1]]
                    hit = (unit(x) @ q.T >= THRESHOLD) & (ids[at][:, None] != who[None, :])
                    total[x.shape[1]] += weights[at] @ hit
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *(by_width[w][0] for w in total)])),
                                          pa.array(np.concatenate([np.zeros(0, np.int64), *total.values()]))], names=["id", "n"])

    truth = {r.id: r.n for r in vectors.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    shares = [min(r.n / truth[r.id], 1.0) for r in rows if truth.get(r.id)]
    return sum(shares) / len(shares) if shares else 1.0


def near_embeddings(vectors: DataFrame) -> Links:
    """Rows (vec_id, n_links, component_id, kept) of all ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    distinct, members = classes(vectors)
    n = distinct.count()
    lists, recall, counts, roots = None, 0.0, None, None
    for seed in range(PASSES):
        found = seeds(distinct, seed).withColumn("fresh", F.lit(1))
        if lists is not None:
            known = lists.select("id", F.explode("near").alias("e")).select("id", "e.other", "e.sim", F.lit(0).alias("fresh"))
            found = found.unionByName(known)
        new = stored(_best(found, None if lists is None else lists.select("id", "size")), "nn-lists")
        if lists is not None:
            release(spark, lists)
        lists = descend(distinct, new, n)
        counts, roots = _counts(distinct, lists)
        recall = _audit(distinct, members, counts)
        if recall >= RECALL:
            break
    rows = members.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rows = rows.join(counts, "id", "left").join(distinct.select("id", "weight"), "id", "left")
    first = rows.where("root IS NOT NULL").groupBy(F.col("root").alias("_root")).agg(F.min("vec_id").alias("_first"))
    rows = rows.join(first, F.col("root") == F.col("_root"), "left")
    component = F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("_first"))
    links = F.coalesce("n", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))
    rows = rows.select("vec_id", links.cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
    return Links(rows, recall)


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all embeddings, with the recall that the audit measured."""
    found = near_embeddings(table(spark, sf_dir, "embeddings"))
    return found.rows.withColumn("audited_recall", F.lit(found.recall))
