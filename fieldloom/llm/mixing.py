"""Mixing sources to target weights (operator 4).

Words are summed per source, the weights give each source a target of words,
and target / size is the source's repetition rate: a document is emitted
floor(rate) times, plus once more when a number seeded by the digest of its id, source
and text lies below the rate's fraction.  Of n rows that are equal in these, floor(n *
fraction) get the extra copy, and one more by that number: a hot id can't make a
source miss its target.

Targets: ``SHARE`` of all words is dealt out by weight; a source takes at most
``CAP`` times its own words, and what it can't take goes to the others by
weight, until none is above.  That fixed point is ``min(weight * level, cap)``
with one level for all: with the sources ordered by cap / weight, the level is
what is left after the sources that fill up, per weight left.  It is read off
running sums over one row per source, without a loop.

Only DataFrame functions are used.  Word counts are stored once (narrow), so
texts are read once for the counts; the per-source sums are partial before the
shuffle, and the join with the rates needs no shuffle while that table is under
Spark's broadcast threshold (a skewed sort-merge join is split beyond it).

Defined cases: NULL text has size 0; NULL source is a source of its own, last in
order; an empty table gives no rows; a source of size 0 has target 0; NULL doc_id is
seeded as an empty one, so that the text decides; of repeated rows the extra copies go to
any, evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import WORD, documents, stored, text_of

WEIGHTS = (3, 1, 2)         # by the source's place in code point order, repeating
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
SALTS = 256                 # tasks that the rows of one key are dealt over


def size_of(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   cap: float = CAP) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size); one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("_w", F.get(F.array(*[F.lit(float(w)) for w in weights]), place % len(weights)))
    whole = Window.partitionBy()
    fill = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_cap", F.col("source_size") * cap) \
        .withColumn("_left", F.sum("source_size").over(whole) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) \
        .withColumn("_wleft", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    # the first source that its share does not fill sets the level
    per = per.withColumn("_level", F.min(F.when(F.col("_w") * F.col("_left") / F.col("_wleft") < F.col("_cap"),
                                                F.struct(F.col("source_size") / F.col("_w"), F.col("_left") / F.col("_wleft")))
                                         ).over(whole).getField("col2"))
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_w") * F.col("_level")))
    return per.select("source", "source_size", target.alias("target"),
                      F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def row_key() -> Column:
    """The digest that seeds a document's draw; rows with the same one are equal in id, source and text."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(SEED), own("doc_id"), own("source"), F.md5(text_of().cast("binary"))).cast("binary"))


def draw(key: Column) -> Column:
    """A number in [0, 1) from a row's key."""
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / float(1 << 48)


def copies(rate: Column) -> Column:
    """How often the row ``_i`` of ``_n`` equal ones is taken."""
    more = F.col("_n") * (rate - F.floor(rate))
    extra = F.floor(more) + F.when(draw(F.col("_key")) < more - F.floor(more), 1).otherwise(0)
    upto = lambda i: F.floor(i * extra / F.col("_n"))
    return (F.floor(rate) + upto(F.col("_i")) - upto(F.col("_i") - 1)).cast("int")


def _numbered(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with the number ``_n`` of rows that share their ``_key``, and a place ``_i`` among them.

    Keys of one row, nearly all, need no more.  The rows of others are stored with a salt and numbered within
    (key, salt), so that a key with a third of all rows is dealt over ``SALTS`` tasks.
    """
    several = keys.groupBy("_key").count().where("count > 1").withColumnRenamed("_key", "_rk")
    several = stored(several, "mix-repeated")
    if several.isEmpty():
        return rows.withColumns({"_n": F.lit(1).cast("long"), "_i": F.lit(1).cast("long")})
    flagged = rows.join(several, F.col("_key") == F.col("_rk"), "left").drop("_rk").withColumnRenamed("count", "_n")
    hot = stored(flagged.where("_n IS NOT NULL").withColumn("_salt", F.monotonically_increasing_id() % SALTS), "mix-several")
    parts = hot.groupBy(F.col("_key").alias("_pk"), F.col("_salt").alias("_ps")).count()
    before = Window.partitionBy("_pk").orderBy("_ps").rowsBetween(Window.unboundedPreceding, -1)  # SALTS rows at most
    parts = parts.select("_pk", "_ps", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_key", "_salt").orderBy("_n"))
    hot = hot.withColumn("_nth", nth).join(parts, (F.col("_key") == F.col("_pk")) & (F.col("_salt") == F.col("_ps")))
    hot = hot.withColumn("_i", F.col("_before") + F.col("_nth")).select(*rows.columns, "_n", "_i")
    alone = flagged.where("_n IS NULL").drop("_n").withColumns({"_n": F.lit(1).cast("long"), "_i": F.lit(1).cast("long")})
    return alone.unionByName(hot)


def _rated(rows: DataFrame, targets: DataFrame) -> DataFrame:
    t = targets.withColumnRenamed("source", "_source")
    return rows.join(t, rows["source"].eqNullSafe(t["_source"])).drop("_source")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken per document."""
    sizes = stored(docs.select("doc_id", "source", size_of(text_of()).alias("size"), row_key().alias("_key")), "mix-sizes")
    out = _rated(_numbered(sizes, sizes), source_targets(sizes)).withColumn("copies", copies(F.col("rate")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies",
                      (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: every document as many times as the mix takes it, with its own columns."""
    sizes = stored(docs.select("source", size_of(text_of()).alias("size"), row_key().alias("_key")), "mix-sizes")
    t = stored(source_targets(sizes), "mix-targets")
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), "source", row_key().alias("_key"))
    out = _rated(_numbered(own, sizes), t).select("_row", copies(F.col("rate")).alias("_copies"))
    repeated = F.explode(F.array_repeat(F.lit(0), F.col("_copies")))
    return out.where("_copies > 0").select("_row", repeated).select("_row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(documents(spark, sf_dir))


OP4_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(source, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [{', '.join(f'{float(w)}' for w in WEIGHTS)}][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)})] AS w
  FROM sized GROUP BY source),
run AS (
  SELECT *, source_size * {CAP} AS cap,
         sum(source_size) OVER () * {SHARE} - coalesce(sum(source_size * {CAP}) OVER (
           ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
         sum(w) OVER () - coalesce(sum(w) OVER (
           ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wleft
  FROM per),
lev AS (SELECT arg_min(left_ / wleft, source_size / w) FILTER (w * left_ / wleft < cap) AS level FROM run),
tar AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, w * level) END AS target FROM run, lev),
rated AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         key, CAST('0x' || substr(key, 1, 12) AS BIGINT) / {float(1 << 48)} AS u,
         count(*) OVER (PARTITION BY key) AS n, row_number() OVER (PARTITION BY key) AS i
  FROM sized s JOIN tar t ON s.source IS NOT DISTINCT FROM t.source),
drawn AS (
  SELECT *, floor(n * (rate - floor(rate))) + CASE WHEN u < n * (rate - floor(rate)) - floor(n * (rate - floor(rate))) THEN 1 ELSE 0 END AS extra
  FROM rated),
counted AS (SELECT *, floor(rate) + floor(i * extra / n) - floor((i - 1) * extra / n) AS c FROM drawn)
SELECT doc_id, source, size, source_size, CAST(target AS DOUBLE) AS target, CAST(c AS INTEGER) AS copies, CAST(size * c AS BIGINT) AS taken
FROM counted
"""
