"""Product codes of vectors by member-resident Lloyd rounds (operator 12).

Each component x becomes the integer floor(1024 * x); a vector is cut into ``PARTS``
equal parts, and each part position has a codebook of ``ENTRIES`` entries, refined
by ``ROUNDS`` rounds of Lloyd's algorithm.  Everything is exact integer arithmetic.

 * A part lives in the partition of its (position, entry, salt), its owner.  The
   salt deals an entry's members over several owners, so an entry that holds a third
   of all parts is split.
 * The owners add up their resident members: a sum and a count for each entry
   leave a task, pre-aggregated, and make the next codebook (``PARTS * ENTRIES``
   entries, whatever the input's size; this is all that is collected and sent out).
 * With the new codebook each owner looks for its members' nearest entries.  Those
   that keep theirs stay in their files' partition; only parts that change entry go
   through the next shuffle, to their new owner.

Each round's residents are written to the shared folder, which cuts the lineage; the
files of the round before are then deleted.

Defined cases: vectors that are NULL or hold NULL or non-finite components are
dropped; vectors of another length than the one with the smallest vec_id can't be
compared and get a NULL code and error (the label's sum skips them); a length
that ``PARTS`` does not divide makes the last parts shorter; NULL vec_id comes
last, and rows that repeat one vec_id come in the order of their vectors; fewer
vectors than ``ENTRIES`` give a codebook of as many entries; NULL labels are one
label; an empty table gives no rows; other columns are ignored.  Components
beyond ``EXACT`` are computed with Python's integers, and errors beyond a long are NULL.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import release, stored
from fieldloom.sources.tables import table

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
EXACT = 1 << 24           # a component's size up to which 64-bit sums of squares are exact
MIN_SALTS = 64
MEMBERS_PER_OWNER = 100_000
LONG_MAX = (1 << 63) - 1

Codebook = list[np.ndarray]  # by position: entries x components


def finite(vec: Column) -> Column:
    """The vector holds no NULL, NaN or infinite component."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return vec.isNotNull() & F.forall(vec, lambda x: F.coalesce(ok(x), F.lit(False)))


def _whole(x: np.ndarray) -> np.ndarray:
    """The integer components: 64-bit where squares stay exact, else Python's integers."""
    x = np.floor(x * SCALE)
    if not x.size or np.abs(x).max() <= EXACT:
        return x.astype(np.int64)
    return np.array([[math.floor(v) for v in r] for r in x], object).reshape(x.shape)


def _small(a: np.ndarray) -> bool:
    return a.dtype != object and (not a.size or np.abs(a).max() <= EXACT)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry (the first of equal ones) and its squared distance."""
    width = max(x.shape[1], 1)
    if _small(x) and _small(book) and width * 4 * EXACT ** 2 < LONG_MAX:
        squares = (book * book).sum(1)
        if width * EXACT * max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) * 4 < 1 << 53:
            cross = (x.astype(np.float64) @ book.T.astype(np.float64)).astype(np.int64)  # exact: whole numbers below 2**53
        else:
            cross = x @ book.T
        d = squares[None, :] - 2 * cross
        at = d.argmin(1)
        return at, d[np.arange(len(x)), at] + (x * x).sum(1)
    x, book = x.astype(object), book.astype(object)
    d = np.array([[((r - e) ** 2).sum() for e in book] for r in x], object).reshape(len(x), len(book))
    at = np.array([min(range(len(book)), key=lambda k: (r[k], k)) for r in d], np.int64)
    return at, np.array([r[k] for r, k in zip(d, at)], object)


class _Parts:
    """The parts of a batch; those of one position are equally long."""

    def __init__(self, col: pa.ListArray):
        self.starts, self.values = np.array(col.offsets[:-1]), np.array(col.values)
        self.widths = np.diff(np.array(col.offsets))

    def whole(self, at: np.ndarray) -> np.ndarray:
        width = self.widths[at[0]]
        return _whole(self.values[self.starts[at][:, None] + np.arange(width)])


def _assign(books: Codebook, salts: int):
    """Batches of parts with their nearest entry, its distance, and whether they change entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos, parts = np.array(b.column("pos")), _Parts(b.column("part"))
            entry, dist = np.zeros(len(pos), np.int64), np.zeros(len(pos), object)
            for p in np.unique(pos):
                at = np.flatnonzero(pos == p)
                for s in range(0, len(at), 4096):
                    piece = at[s:s + 4096]
                    entry[piece], d = nearest(parts.whole(piece), books[p])
                    dist[piece] = d
            salt = np.array(b.column("rid")) * 0x9E3779B97F4A7C1 >> 20 & 0x7FFFFFFF
            moved = np.array(b.column("entry").fill_null(-1)) != entry
            out = {"pos": b.column("pos"), "entry": pa.array(entry.astype(np.int32)), "salt": pa.array((salt % salts).astype(np.int32)),
                   "rid": b.column("rid"), "part": b.column("part"), "moved": pa.array(moved),
                   "dist": pa.array([int(d) if d <= LONG_MAX else None for d in dist], pa.int64())}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
    return run


_ASSIGNED = "pos int, entry int, salt int, rid long, part array<double>, moved boolean, dist long"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and sums of a task's members by position and entry; sums as digits, so that none overflows."""
    held: dict[tuple[int, int], list] = {}
    for b in batches:
        pos, entry, parts = np.array(b.column("pos")), np.array(b.column("entry")), _Parts(b.column("part"))
        code = pos.astype(np.int64) * ENTRIES + entry
        order = np.argsort(code, kind="stable")
        cuts = np.flatnonzero(np.diff(code[order])) + 1
        for group in np.split(order, cuts) if len(order) else []:
            x = parts.whole(group)
            key = int(pos[group[0]]), int(entry[group[0]])
            n, total = held.get(key, (0, 0))
            held[key] = n + len(group), total + x.sum(0).astype(object)
    rows = [(p, e, n, k, str(v)) for (p, e), (n, total) in held.items() for k, v in enumerate(total)]
    cols = list(zip(*rows)) or [()] * 5
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                                      pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.string())], names=["pos", "entry", "n", "at", "total"])


def _updated(books: Codebook, residents: DataFrame) -> Codebook:
    """The codebook whose used entries are the floors of their members' means."""
    sums = residents.mapInArrow(_sums, "pos int, entry int, n long, at int, total string") \
        .groupBy("pos", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"))
    new = [b.astype(object) for b in books]
    for r in sums.collect():  # at most ENTRIES numbers for each component of a vector
        new[r.pos][r.entry, r.at] = int(r.total) // r.n
    return [b.astype(np.int64) if not b.size or max(map(abs, b.flat)) <= EXACT else b for b in new]


def _cut(vec: list[float], width: int) -> list[list[float]]:
    return [vec[k * width:(k + 1) * width] for k in range(PARTS)]


def _initial(kept: DataFrame, length: int, width: int) -> Codebook:
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(ENTRIES).collect()
    parts = [_cut(list(r.vec), width) for r in first]
    return [_whole(np.array([p[k] for p in parts], np.float64).reshape(len(parts), -1 if parts else 0)) for k in range(PARTS)]


def encode(vectors: DataFrame) -> tuple[DataFrame, Codebook]:
    """(vec_id, label, code, error) of the vectors that are kept, and the final codebooks."""
    spark = vectors.sparkSession
    vec = F.col("embedding").cast("array<double>")
    kept = vectors.select(F.col("vec_id").cast("long"), "label", vec.alias("vec")).where(finite(F.col("vec")))
    kept = stored(kept.select("*", F.monotonically_increasing_id().alias("rid")), "codes-vectors")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vec").select(F.size("vec").alias("n")).first()
    length = first["n"] if first else 0
    width = -(-length // PARTS)
    fit = kept.where(F.size("vec") == length)
    books = _initial(fit, length, width)
    cut = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.struct(
        k.cast("int").alias("pos"), F.slice("vec", k * width + 1, F.lit(width)).alias("part")))
    parts = fit.select("rid", F.explode(cut).alias("_")).select("_.pos", F.lit(None).cast("int").alias("entry"), "rid", "_.part")
    salts = max(MIN_SALTS, -(-fit.count() // MEMBERS_PER_OWNER))

    residents, old = parts, []
    for _ in range(ROUNDS):
        assigned = stored(residents.mapInArrow(_assign(books, salts), _ASSIGNED), "codes-assigned")
        state = ["pos", "entry", "salt", "rid", "part"]
        movers = assigned.where("moved").select(*state).repartition("pos", "entry", "salt")
        residents = stored(assigned.where("not moved").select(*state).unionByName(movers), "codes-residents")
        books = _updated(books, residents)
        release(spark, assigned, *old)
        old = [residents]
    final = residents.mapInArrow(_assign(books, salts), _ASSIGNED).select("rid", "pos", "entry", "dist")
    final = stored(final.groupBy("rid").agg(
        F.array_sort(F.collect_list(F.struct("pos", "entry"))).alias("_e"), F.sum(F.col("dist").cast("decimal(38,0)")).alias("_error"),
        F.count("dist").alias("_n")), "codes-final")
    release(spark, *old)
    digits = F.transform("_e", lambda x: F.lower(F.lpad(F.hex(x["entry"]), 2, "0")))
    error = F.when((F.col("_n") == PARTS) & (F.col("_error") <= LONG_MAX), F.col("_error").cast("long"))
    coded = final.select(F.col("rid").alias("_rid"), F.concat_ws("", digits).alias("code"), error.alias("error"))
    return kept.join(coded, F.col("rid") == F.col("_rid"), "left").select("vec_id", "label", "code", "error"), books


def digest(books: Codebook) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.flat).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 per kept vector."""
    rows, books = encode(table(spark, sf_dir, "embeddings"))
    rows = stored(rows, "codes-rows")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    labels = rows.groupBy(F.col("label").alias("_label")).agg(F.when(total <= LONG_MAX, total).cast("long").alias("label_error"))
    return rows.join(labels, F.col("label").eqNullSafe(F.col("_label")), "left") \
        .select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds as one chain of common table expressions; whole numbers in doubles are exact here."""
    def assign(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (
  SELECT p.rid, p.pos, arg_min(b.entry, (list_inner_product(b.x, b.x) - 2 * list_inner_product(p.x, b.x), b.entry)) AS entry,
         min(list_inner_product(b.x, b.x) - 2 * list_inner_product(p.x, b.x)) + any_value(list_inner_product(p.x, p.x)) AS dist
  FROM parts p JOIN b{r} b ON b.pos = p.pos GROUP BY p.rid, p.pos)"""

    def update(r: int) -> str:
        return f"""b{r + 1} AS MATERIALIZED (
  SELECT b.pos, b.entry, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN (
    SELECT pos, entry, list(v ORDER BY i) AS x FROM (
      SELECT a.pos, a.entry, i, floor(sum(p.x[i]) / count(*)) AS v
      FROM a{r} a JOIN parts p ON p.rid = a.rid AND p.pos = a.pos, generate_series(1, len(p.x)) g(i) GROUP BY a.pos, a.entry, i)
    GROUP BY pos, entry) m ON m.pos = b.pos AND m.entry = b.entry)"""

    steps = [f"{assign(r)},\n{update(r)}" for r in range(ROUNDS)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, vec_id, label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT rid, pos, x[pos * len(x) // {PARTS} + 1:(pos + 1) * len(x) // {PARTS}] AS x FROM kept, generate_series(0, {PARTS - 1}) g(pos)),
b0 AS MATERIALIZED (SELECT pos, rid AS entry, x FROM parts WHERE rid < {ENTRIES}),
{", ".join(steps)},
{assign(ROUNDS)},
books AS (
  SELECT sha256(string_agg(v, ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM (
    SELECT pos, entry, array_to_string(list_transform(x, lambda v: v::BIGINT::VARCHAR), ',') AS v FROM b{ROUNDS})),
coded AS (SELECT rid, string_agg(lower(printf('%02x', entry)), '' ORDER BY pos) AS code, sum(dist)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid)
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, codebooks_sha256
FROM kept k JOIN coded c ON c.rid = k.rid, books
"""


OP12_SQL = _sql()
