"""Digest pairs are two hashes, not one."""
from pyspark.sql import functions as F

from fieldloom.llm import line_dedup, near_dedup, suffix_dedup
from fieldloom.llm.common import digest128


def test_second_hash_does_not_follow_from_the_first(spark):
    rows = spark.range(200).select(F.concat(F.lit("line "), F.col("id").cast("string")).alias("text"))
    k1, k2 = digest128("text")
    got = rows.select(k1.alias("k1"), k2.alias("k2"))
    # Spark seeds each value's hash with the hash before it: the old pair was hash(lit) seeded with k1
    old = rows.select(F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit("t")).alias("o2"))
    assert got.select("k2").distinct().count() == 200 and got.where("k1 = k2").count() == 0
    assert old.join(got, "k1").where("o2 = k2").count() == 0
    key = line_dedup.line_key(F.col("text"))
    first = rows.select(key.alias("k"), *near_dedup.text_digest(), *[c.alias(f"s{c_}") for c_, c in enumerate(suffix_dedup._digest())]).first()
    want = rows.select(k1.alias("a"), k2.alias("b")).first()
    assert (first.k.k1, first.k.k2) == (first._t1, first._t2) == (first.s0, first.s1) == tuple(want)

