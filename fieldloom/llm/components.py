"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import stored


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (u, v) but the roots, with the smallest node it reaches.

    Each round hooks the neighbours of a node to the smallest of them; minima are
    aggregated before they are joined back, so a node with very many neighbours
    is never gathered in one place.  The edge table is stored each round.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stored(e, "cc-edges")
    last = _fingerprint(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("u", "_m").alias("_m"))
        # large star: the larger neighbours of a node hang on its smallest one
        e = both.join(least, F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")) \
            .where("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("_m")).withColumnRenamed("u", "_u")
        # small star: a node and its smaller neighbours hang on the smallest of these
        small = e.join(least, F.col("u") == F.col("_u"))
        e = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("_m").alias("v")),
                                           F.struct(F.col("u").alias("u"), F.col("_m").alias("v")))).alias("_e")) \
            .select("_e.u", "_e.v").where("u <> v").distinct()
        e = stored(e, "cc-edges")
        now = _fingerprint(e)
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now
