"""Shared pieces of the training-data operators."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.session import checkpoint_dir
from fieldloom.sources.tables import table

#: ASCII white space separates words: space and the code points 9 to 13.
WORD = r"[^ \t-\r]+"
WORD_CHAR = r"[^ \t-\r]"
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/fieldloom-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; ``options`` are the writer's.

    Cuts the lineage and lets several consumers share one computation; a lost
    executor costs nothing, as the files are not on it.
    """
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path  # for release()
    return out


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stored ``tables`` that nothing reads any more, and have Spark delete the shuffle
    files of steps that are no longer referred to.

    Spark's cleaner works when the driver collects its garbage, which may be long after; the
    second collection is for what the first one's finalizers and the listeners let go.
    """
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for _ in range(2):
        time.sleep(0.4)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def digest128(c: Column | str) -> list[Column]:
    """Two 64-bit hashes of a string that don't follow from each other.

    The second starts from another seed: ``xxhash64(c, lit)`` would be a function of
    the first, as Spark seeds each value's hash with the one before.
    """
    return [F.xxhash64(c), F.xxhash64(F.lit("second"), c)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def text_of(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))

