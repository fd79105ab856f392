"""Sharding by extendible hashing (operator 8).

A document's key is a 60-bit digest prefix of its id.  The directory is indexed
by the first bits of the key; a bucket whose bytes exceed the limit is split on
one more bit, all others stay, until every shard fits.  Depth and prefix name the
shard.

Bytes are summed once per directory slot (first ``_depth`` bits) and rolled up
to every shorter prefix, so all splits of a pass are decided in one small
aggregation; the pass ends as many bits deep as a uniform spread needs plus
``SLACK_BITS``.  Only buckets still too large go into a further pass over their
own rows with more bits.  Rows meet their shard through the directory slot.

Rows whose key alone is heavier than a shard (one id repeated very often) can't
be told apart by the key: they get a second key from their number within
(key, salt) first, where the salt spreads a key over tasks of ``SALT_ROWS`` rows.

Only DataFrame functions are used.  Defined cases: NULL text has 0 bytes; NULL
doc_id is the key of the empty string; a single document above the limit is
alone in its shard and flagged ``oversized``; repeated rows each count their
bytes; an empty table gives no rows; other columns are kept by ``assign_shards``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import documents, stored

LIMIT = 1 << 20             # bytes of text in a shard
KEY_BITS = 60
SLACK_BITS = 5
STEP_BITS = 8               # bits a further pass adds
SALT_ROWS = 200_000


def key_of(doc_id: Column) -> Column:
    digest = F.md5(F.concat(F.lit("shard:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def prefix(key: Column, bits: Column | int) -> Column:
    """The first ``bits`` bits of a key as a long."""
    bits = F.lit(bits) if isinstance(bits, int) else bits
    return F.call_function("shiftright", key, F.lit(KEY_BITS) - bits)


def _rekeyed(rows: DataFrame, limit: int) -> DataFrame:
    """Distinct second keys for the rows of keys that can't fit a shard."""
    heavy = stored(rows.groupBy("_key").agg(F.count("*").alias("_rows"), F.sum("n_bytes").alias("_bytes"))
                   .where((F.col("_bytes") > limit) & (F.col("_rows") > 1)).select("_key", "_rows"), "shard-heavy")
    if heavy.isEmpty():
        return rows
    salted = rows.join(heavy, "_key").withColumn(
        "_salt", F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("_rows") / SALT_ROWS)))
    number = F.row_number().over(Window.partitionBy("_key", "_salt").orderBy("n_bytes"))
    again = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("_key"), F.col("_salt"), number)), 1, 15), 16, 10).cast("long")
    rest = rows.join(heavy, "_key", "left_anti")
    return stored(rest.unionByName(salted.withColumn("_key", again).select(*rest.columns)), "shard-keys")


def _directory(rows: DataFrame, low: int, depth: int, limit: int) -> DataFrame:
    """(_slot, shard_depth, shard_bytes) for every used slot of ``depth`` bits; shards are at least ``low`` bits deep.

    shard_depth is NULL where even the slot is too large.
    """
    slots = rows.groupBy(prefix(F.col("_key"), depth).alias("_slot")).agg(
        F.sum("n_bytes").alias("_bytes"), F.count("*").alias("_rows"), F.min("_key").alias("_k0"), F.max("_key").alias("_k1"))
    levels = slots.select("*", F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("_d"))
    at = F.call_function("shiftright", F.col("_slot"), F.lit(depth) - F.col("_d"))
    sums = levels.groupBy("_d", at.alias("_p")).agg(
        F.sum("_bytes").alias("shard_bytes"), F.sum("_rows").alias("shard_rows"), F.min("_k0").alias("_k0"), F.max("_k1").alias("_k1"))
    # a bucket fits, or holds one key only, which no further bit splits
    fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("_k0") == F.col("_k1")))
    found = levels.select("_slot", "_d", at.alias("_p")).join(fits.select("_d", "_p", "shard_bytes", "shard_rows"), ["_d", "_p"], "left") \
        .groupBy("_slot").agg(F.min(F.when(F.col("shard_bytes").isNotNull(), F.struct("_d", "shard_bytes", "shard_rows"))).alias("_leaf"))
    return found.select("_slot", F.col("_leaf._d").alias("shard_depth"), "_leaf.shard_bytes", "_leaf.shard_rows")


def shard_rows(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds shard_id, shard_depth, shard_bytes, oversized to rows with ``_key`` and ``n_bytes``."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, depth = 0, min(KEY_BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + SLACK_BITS))
    done, todo = None, rows
    while True:
        d = _directory(todo, low, depth, limit)
        placed = todo.withColumn("_slot", prefix(F.col("_key"), depth)).join(d, "_slot").drop("_slot")
        final = placed.where(F.col("shard_depth").isNotNull()) if depth < KEY_BITS else placed
        done = final if done is None else done.unionByName(final)
        if depth >= KEY_BITS:
            break
        todo = stored(placed.where(F.col("shard_depth").isNull()).select(*rows.columns), "shard-rest")
        if todo.isEmpty():
            break
        low, depth = depth + 1, min(KEY_BITS, depth + STEP_BITS)
    bits = F.lpad(F.bin(prefix(F.col("_key"), F.col("shard_depth"))), F.col("shard_depth"), F.lit("0"))
    name = F.when(F.col("shard_depth") == 0, F.lit("root")).otherwise(bits)
    return done.withColumn("shard_id", name).withColumn("oversized", F.col("shard_bytes") > limit)


def shard_report(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, shard_id, shard_depth, shard_bytes, shard_rows, oversized per document."""
    rows = stored(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                              key_of(F.col("doc_id")).alias("_key")), "shard-sizes")
    return shard_rows(_rekeyed(rows, limit), limit).drop("_key")


def assign_shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The documents with their own columns, and shard_id, shard_depth, shard_bytes, oversized."""
    clash = {"n_bytes", "shard_id", "shard_depth", "shard_bytes", "shard_rows", "oversized"}
    own = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.select(own.alias("_row"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                       key_of(F.col("doc_id")).alias("_key"))
    out = shard_rows(_rekeyed(rows, limit), limit)
    return out.select(*[F.col(f"_row.{c}") for c in docs.columns if c not in clash],
                      "n_bytes", "shard_id", "shard_depth", "shard_bytes", "shard_rows", "oversized")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(documents(spark, sf_dir))


OP8_SQL = f"""
WITH r AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         CAST('0x' || substr(md5('shard:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k
  FROM documents),
lev AS (
  SELECT d, k >> ({KEY_BITS} - d) AS p, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
  FROM r, (SELECT unnest(range(0, {KEY_BITS + 1})) AS d) GROUP BY 1, 2 HAVING sum(n_bytes) <= {LIMIT} OR min(k) = max(k)),
leaf AS (
  SELECT r.k, arg_min(struct_pack(d := lev.d, b := lev.shard_bytes, n := lev.shard_rows), lev.d) AS s
  FROM (SELECT DISTINCT k FROM r) r JOIN lev ON lev.p = r.k >> ({KEY_BITS} - lev.d) GROUP BY r.k)
SELECT doc_id, n_bytes, CASE WHEN s.d = 0 THEN 'root' ELSE right(lpad(bin(k >> ({KEY_BITS} - s.d)), 64, '0'), s.d::INT) END AS shard_id,
       s.d::INTEGER AS shard_depth, s.b AS shard_bytes, s.n AS shard_rows, s.b > {LIMIT} AS oversized
FROM r JOIN leaf USING (k)
"""
