"""H33 with the party dictionary as a table: the first listed name that a text contains, and its line.

``header.known_party_line`` compiles a short list into the projection.  Here the names are rows,
found by an inverted index: every name is filed under its rarest run of ``GRAMS`` characters, the
longest that it has (counted over the dictionary; shorter names under themselves).  A name has no line end,
so the lines of the texts meet the names filed under one of their runs by an equi-join, and what meets is verified by
containment in that line: no text is shuffled.  Runs whose digest no name is filed under are left out before the shuffle
(beyond ``SLOTS`` names the digests are cut to so many values, so their broadcast has a bound; a shared digest costs a row,
never a result).  So the plan is the same for ten names or a million, a common word
in many names proposes nothing, and the result is that of testing every name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.rx import strip
from fieldloom.sources.sink import scratch_path

GRAMS = (12, 6)
SLOTS = 1 << 22


def _runs(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text, in one pass (a substring by place would count from the start each time)."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def dictionary(parties: DataFrame) -> DataFrame:
    """(key, size, name, rank) of the distinct lower-case names of ``parties`` (name, rank); blank names are left out."""
    names = parties.where(F.col("name") != "").groupBy(F.lower("name").alias("name")).agg(F.min("rank").alias("rank"))
    n = F.length("name")
    names = names.select("name", "rank", F.when(n >= GRAMS[0], GRAMS[0]).when(n >= GRAMS[1], GRAMS[1]).otherwise(n).alias("size"))
    own = F.when(F.col("size") == GRAMS[0], _runs(F.col("name"), GRAMS[0])).when(F.col("size") == GRAMS[1], _runs(F.col("name"), GRAMS[1])) \
        .otherwise(F.array("name"))
    runs = names.select("name", "rank", "size", F.posexplode(own).alias("at", "key"))
    common = runs.groupBy("key").agg(F.count("*").alias("n"))
    rarest = runs.join(common, "key").groupBy("name", "rank", "size").agg(F.min(F.struct("n", "at", "key")).alias("k"))
    return rarest.select("k.key", "size", "name", "rank")


def known_parties(docs: DataFrame, parties: DataFrame) -> DataFrame:
    """``(doc_key, party, line)``: for documents that contain a listed name (ignore case), the one of least ``rank`` (then
    by name) and the stripped line of its first place.  Documents without any are left out.

    ``docs`` (doc_key, text) with one row per key; ``parties`` (name, rank); names have no line ends.
    """
    path = scratch_path(docs.sparkSession, "parties")
    dictionary(parties).write.parquet(path)  # read three times
    index = docs.sparkSession.read.parquet(path)
    sizes = {r["size"]: r["count"] for r in index.groupBy("size").count().collect()}

    def digest(key: Column) -> Column:
        return F.xxhash64(key) if sum(sizes.values()) <= SLOTS else F.pmod(F.xxhash64(key), F.lit(SLOTS))

    lines = docs.where(F.col("doc_key").isNotNull()).select("doc_key", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    low = F.lower("line")
    runs = [_runs(low, size) for size in sorted(sizes) or GRAMS[:1]]
    own = lines.select("doc_key", "no", "line", F.explode(F.concat(*runs)).alias("key"))
    filed = index.select(digest(F.col("key")).alias("slot")).distinct()
    own = own.join(F.broadcast(filed), digest(F.col("key")) == F.col("slot"), "left_semi")
    held = own.join(index, "key").where(low.contains(F.col("name")))
    best = held.groupBy("doc_key").agg(F.min(F.struct("rank", "name", "no", "line")).alias("b"))
    return best.select("doc_key", F.col("b.name").alias("party"), strip(F.col("b.line")).alias("line"))
