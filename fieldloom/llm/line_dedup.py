"""Reversible line dedup with sharded cuckoo filters (operator 5).

State, one folder per version: ``refs`` - the exact reference counts, one row
(key, n_docs) per line key -, ``filters`` - one cuckoo filter per shard
that holds the keys found in at least ``MIN_DOCS`` documents -, ``docs`` - the digests of
the documents that are in, with their number - and, after a deletion, ``refused``.  A row in
``manifest``, written last, makes a version valid; a ``LineIndex`` opened on a folder goes on with its
latest one, in any session.  Inserting or
deleting documents sums their distinct keys (+1 / -1) into the counts; keys that
cross the threshold enter or leave their shard's filter, which a Bloom filter
could not do.  A new version is written beside the old one.

Dropping lines: the documents' distinct keys probe the filter of their shard; a
miss is certain, so most lines end there.  Hits are confirmed against the exact
counts, and a document gets the list of its own keys to drop.

A line's key is its text without ASCII white space at both ends and with A-Z
lower-cased, held as a 128-bit digest; the shard is taken from the digest.

Scale: counts are summed map-side first, so a line found in a third of all
documents is one row per task.  The number of shards follows the number of keys.
Probes are dealt over (shard, salt), with salts by the shard's number of probes
and the shard's filter repeated for each salt, so a frequent line is spread
evenly.  Documents are matched with their keys to drop by a digest of their
text: equal texts share one decision, and no row needs an identity.

Defined cases: NULL or empty text is one empty line, whose key has no code point
and is never dropped; repeated rows count as documents of their own; NULL doc_id
is kept; an empty table gives no rows; other columns are ignored by the report
and kept by ``drop_lines``.  Deleting a document that is not in the index, or more
often than it is, changes no count; ``refused`` lists it.  A document without any key (blank
lines only) leaves no trace in the index.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import LOWER, SPACES, UPPER, digest128, documents, scratch, stored

MIN_DOCS = 10
KEYS_PER_SHARD = 200_000
PROBES_PER_TASK = 400_000
SLOTS = 4
MANIFEST = "version int, shards int, min_docs int"
FIRST_BUCKETS = 64
KICKS = 500


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; works on arrays of 64-bit keys."""

    def __init__(self, table: np.ndarray | None = None, n: int = 0):
        if table is None:
            buckets = FIRST_BUCKETS
            while buckets * SLOTS * 0.8 < n:
                buckets *= 2
            table = np.zeros((buckets, SLOTS), np.uint16)
        self.table = table

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(29))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = self._mix(keys)
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, bucket, prints):
        jump = self._mix(np.asarray(prints, np.uint64)).astype(np.int64)
        return (bucket ^ jump) & (len(self.table) - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        p, a, b = self._places(keys)
        return (self.table[a] == p[:, None]).any(1) | (self.table[b] == p[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """False when the filter is too full; it is then to be rebuilt larger."""
        rng = np.random.default_rng(len(self.table))
        for p, a, b in zip(*self._places(keys)):
            for bucket in (a, b):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = p
                    break
            else:
                bucket = a if rng.integers(2) else b
                for _ in range(KICKS):
                    slot = rng.integers(SLOTS)
                    p, self.table[bucket, slot] = self.table[bucket, slot], p
                    bucket = int(self._other(np.int64(bucket), np.array([p]))[0])
                    free = np.flatnonzero(self.table[bucket] == 0)
                    if len(free):
                        self.table[bucket, free[0]] = p
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Takes out keys that were inserted before."""
        for p, a, b in zip(*self._places(keys)):
            for bucket in (a, b):
                found = np.flatnonzero(self.table[bucket] == p)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    @classmethod
    def build(cls, keys: np.ndarray) -> CuckooFilter:
        n = max(1, len(keys))
        while not (f := cls(n=n)).insert(keys):
            n *= 2
        return f


# --- keys -------------------------------------------------------------------

def line_key(line: Column) -> Column:
    """Digest pair of a line's key; NULL for a key without a code point."""
    key = F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)
    return F.when(key != "", F.struct(*[h.alias(n) for h, n in zip(digest128(key), ("k1", "k2"))]))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_digest() -> list[Column]:
    return [h.alias(n) for h, n in zip(digest128(F.coalesce(F.col("text"), F.lit(""))), ("_t1", "_t2"))]


def doc_keys(docs: DataFrame) -> DataFrame:
    """(_t1, _t2, k1, k2, lead): each document's text digest with each of its keys once, the first one marked."""
    keys = F.array_distinct(F.transform(lines_of(F.col("text")), line_key))
    return docs.select(*text_digest(), F.posexplode(F.filter(keys, lambda k: k.isNotNull())).alias("_at", "_k")) \
        .select("_t1", "_t2", "_k.k1", "_k.k2", (F.col("_at") == 0).alias("lead"))


# --- index ------------------------------------------------------------------

class LineIndex:
    """Versioned reference counts, filters and documents under ``path``; opens the latest version."""

    def __init__(self, spark: SparkSession, path: str, min_docs: int = MIN_DOCS):
        self.spark, self.path, self.min_docs, self.version = spark, path, min_docs, 0
        self.shards = 1
        last = self._latest()
        if last is not None:
            if last["min_docs"] != min_docs:
                raise ValueError(f"the index was made with min_docs={last['min_docs']}")
            self.version, self.shards = last["version"], last["shards"]

    def _latest(self) -> Row | None:
        try:
            made = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return made.orderBy(F.desc("version")).first()

    def _at(self, name: str, version: int | None = None) -> str:
        return f"{self.path}/v{self.version if version is None else version}/{name}"

    def refs(self) -> DataFrame:
        schema = "k1 long, k2 long, n_docs long"
        if not self.version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._at("refs"))

    def docs(self) -> DataFrame:
        """(_t1, _t2, n): the documents that are in, by text digest."""
        schema = "_t1 long, _t2 long, n long"
        return self.spark.read.schema(schema).parquet(self._at("docs")) if self.version else self.spark.createDataFrame([], schema)

    def refused(self) -> DataFrame:
        """(_t1, _t2, n): what the last deletion named beyond the documents that were in."""
        return self.spark.read.schema("_t1 long, _t2 long, n long").parquet(self._at("refused"))

    def filters(self) -> DataFrame:
        return self.spark.read.schema("shard int, filter binary").parquet(self._at("filters"))

    def shard_of(self, k1: Column) -> Column:
        return F.pmod(k1, F.lit(self.shards)).cast("int")

    def insert(self, keys: DataFrame) -> LineIndex:
        """Adds documents, given as their ``doc_keys``."""
        return self._change(keys, 1)

    def delete(self, keys: DataFrame) -> LineIndex:
        """Takes out documents, given as their ``doc_keys``."""
        return self._change(keys, -1)

    def _change(self, keys: DataFrame, sign: int) -> LineIndex:
        new = self.version + 1
        write = lambda df, name: df.write.mode("overwrite").parquet(self._at(name, new))  # noqa: E731  what a broken run left goes
        if sign > 0:
            delta = keys.groupBy("k1", "k2").agg(F.count("*").alias("_d"))
        else:
            asked = self._asked(keys)
            once = keys.select("_t1", "_t2", "k1", "k2").distinct().join(asked.where("_out > 0").select("_t1", "_t2", "_out"), ["_t1", "_t2"])
            delta = once.groupBy("k1", "k2").agg((F.sum("_out") * -1).alias("_d"))
            write(asked.where("_n > _out").select("_t1", "_t2", (F.col("_n") - F.col("_out")).alias("n")), "refused")
        old = self.refs()
        if self.version:
            moved = old.withColumn("_d", F.lit(0).cast("long")) \
                .unionByName(delta.withColumn("n_docs", F.lit(0).cast("long"))) \
                .groupBy("k1", "k2").agg(F.sum("n_docs").alias("_old"), F.sum("_d").alias("_d"))
        else:
            moved = delta.select("k1", "k2", F.lit(0).cast("long").alias("_old"), "_d")
        moved = moved.select("k1", "k2", "_old", F.greatest(F.col("_old") + F.col("_d"), F.lit(0)).alias("n_docs"))
        write(moved, "moved")
        moved = self.spark.read.schema(moved.schema).parquet(self._at("moved", new))
        is_in, was_in = F.col("n_docs") >= self.min_docs, F.col("_old") >= self.min_docs
        crossed = moved.where(is_in != was_in).select("k1", is_in.alias("enters"))
        frequent = moved.where(is_in).count()
        shards = max(1, -(-frequent // KEYS_PER_SHARD))
        if self.version and shards <= 2 * self.shards:
            self._update_filters(crossed, new)
        else:  # first version, or shards that have outgrown their size: deal the keys out anew
            self.shards = shards
            self._build_filters(moved.where(is_in).select("k1"), new)
        write(moved.where("n_docs > 0").select("k1", "k2", "n_docs"), "refs")
        write(self._changed_docs(keys, sign), "docs")
        self.spark.createDataFrame([(new, self.shards, self.min_docs)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self.version = new
        return self

    @staticmethod
    def _batch(keys: DataFrame) -> DataFrame:
        return keys.where("lead").groupBy("_t1", "_t2").agg(F.count("*").alias("_n"))

    def _asked(self, keys: DataFrame) -> DataFrame:
        """(_t1, _t2, _n, _out): documents to take out, how often they are named and how often they go."""
        have = self.docs().withColumnRenamed("n", "_have")
        out = self._batch(keys).join(have, ["_t1", "_t2"], "left")
        return stored(out.select("_t1", "_t2", "_n", F.least("_n", F.coalesce("_have", F.lit(0))).alias("_out")), "line-asked")

    def _changed_docs(self, keys: DataFrame, sign: int) -> DataFrame:
        change = self._batch(keys).select("_t1", "_t2", (F.col("_n") * sign).alias("n"))
        if not self.version:
            return change.where("n > 0")
        return self.docs().unionByName(change).groupBy("_t1", "_t2").agg(F.sum("n").alias("n")).where("n > 0")

    def _build_filters(self, keys: DataFrame, version: int) -> None:
        def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            f = CuckooFilter.build(pdf.k1.to_numpy().view(np.uint64))
            return pd.DataFrame({"shard": [key[0]], "filter": [f.to_bytes()]})

        keys.withColumn("shard", self.shard_of(F.col("k1"))).groupBy("shard") \
            .applyInPandas(build, "shard int, filter binary").write.mode("overwrite").parquet(self._at("filters", version))

    def _update_filters(self, crossed: DataFrame, version: int) -> None:
        def update(key: tuple, have: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
            f = CuckooFilter.from_bytes(have["filter"].iloc[0]) if len(have) else CuckooFilter()
            k, enters = moved.k1.to_numpy().view(np.uint64), moved.enters.to_numpy(bool)
            f.delete(k[~enters])
            full = not f.insert(k[enters])
            return pd.DataFrame({"shard": [key[0]], "filter": [None if full else f.to_bytes()]})

        old = self.filters()
        moved = crossed.withColumn("shard", self.shard_of(F.col("k1")))
        out = old.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(update, "shard int, filter binary")
        out = stored(out, "line-filters")
        full = out.where(F.col("filter").isNull()).select("shard")
        if full.isEmpty():
            out.write.mode("overwrite").parquet(self._at("filters", version))
            return
        keys = self.spark.read.parquet(self._at("moved", version)).where(F.col("n_docs") >= self.min_docs) \
            .withColumn("shard", self.shard_of(F.col("k1"))).join(full, "shard").select("k1")
        self._build_filters(keys, version)
        out.where(F.col("filter").isNotNull()).write.mode("append").parquet(self._at("filters", version))

    def frequent_keys(self, keys: DataFrame) -> DataFrame:
        """(_t1, _t2, _drop): for texts with frequent lines, the keys of these lines; ``keys`` is read twice."""
        probes = keys.withColumn("shard", self.shard_of(F.col("k1")))
        salts = probes.groupBy("shard").count().select("shard", F.ceil(F.col("count") / PROBES_PER_TASK).cast("int").alias("salts"))
        dealt = probes.join(salts, "shard").select(
            "shard", F.pmod(F.xxhash64("_t1", "k2"), F.col("salts")).cast("int").alias("salt"), "_t1", "_t2", "k1", "k2")
        copies = self.filters().join(salts, "shard").select(
            "shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "filter")

        def probe(key: tuple, lines: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
            cols = ["_t1", "_t2", "k1", "k2"]
            if not len(have):
                return lines[cols].iloc[:0]
            f = CuckooFilter.from_bytes(have["filter"].iloc[0])
            return lines.loc[f.contains(lines.k1.to_numpy().view(np.uint64)), cols]

        hits = dealt.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")) \
            .applyInPandas(probe, "_t1 long, _t2 long, k1 long, k2 long")
        sure = self.refs().where(F.col("n_docs") >= self.min_docs).select("k1", "k2")
        return hits.join(sure, ["k1", "k2"]).groupBy("_t1", "_t2").agg(F.collect_set(F.struct("k1", "k2")).alias("_drop"))


# --- use --------------------------------------------------------------------

def stored_keys(docs: DataFrame) -> DataFrame:
    return stored(doc_keys(docs), "line-keys")


def _with_kept(docs: DataFrame, index: LineIndex, keys: DataFrame | None, keep: list) -> DataFrame:
    """``keep`` columns, n_lines, n_dropped and the kept text."""
    drops = index.frequent_keys(stored_keys(docs) if keys is None else keys).select(F.col("_t1").alias("_d1"), F.col("_t2").alias("_d2"), "_drop")
    rows = docs.select(*keep, "text", *text_digest())
    rows = rows.join(drops, (F.col("_t1") == F.col("_d1")) & (F.col("_t2") == F.col("_d2")), "left")
    rows = rows.select(*keep, lines_of(F.col("text")).alias("_lines"), "_drop")
    left = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(
        F.filter("_lines", lambda x: ~F.coalesce(F.array_contains(F.col("_drop"), line_key(x)), F.lit(False))))
    rows = rows.select(*keep, F.size("_lines").cast("long").alias("n_lines"), left.alias("_left"))
    return rows.select(*keep, "n_lines", (F.col("n_lines") - F.size("_left")).alias("n_dropped"),
                       F.array_join("_left", "\n").alias("_kept"))


def line_report(docs: DataFrame, index: LineIndex, keys: DataFrame | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 per document; ``keys``: their ``doc_keys``, where stored already."""
    return _with_kept(docs, index, keys, ["doc_id"]).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode("_kept", "UTF-8"), 256).alias("kept_sha256"))


def drop_lines(docs: DataFrame, index: LineIndex, keys: DataFrame | None = None) -> DataFrame:
    """The documents with frequent lines taken out of their text."""
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    out = _with_kept(docs.select(own, "text"), index, keys, ["_row"])
    return out.select(*[F.col("_kept").alias(c) if c == "text" else F.col(f"_row.{c}") for c in docs.columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    keys = stored_keys(docs)
    index = LineIndex(spark, scratch(spark, "line-index")).insert(keys)
    return line_report(docs, index, keys)


_KEY = "translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '" + UPPER + "', '" + LOWER + "')"
OP5_SQL = f"""
WITH l AS (
  SELECT rn, i, l, {_KEY} AS k FROM (
    SELECT rn, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS l FROM (
      SELECT row_number() OVER () AS rn, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
f AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT rn) >= {MIN_DOCS}),
m AS (SELECT l.rn, l.i, l.l, f.k IS NOT NULL AS dropped FROM l LEFT JOIN f ON l.k = f.k),
d AS (SELECT row_number() OVER () AS rn, doc_id FROM documents)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(dropped::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m JOIN d USING (rn) GROUP BY rn, doc_id
"""
