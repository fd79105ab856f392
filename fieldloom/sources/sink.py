"""Sinks (S3-S9): CSV record files, job status as JSON, per-job datasets.

Writes go to a dataset folder (one part file per task), never through the
driver.  Each writer takes the target folder; ``scratch_path`` gives a fresh
folder under the session's shared checkpoint directory for jobs that need an
intermediate table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.contract import (HEADER_COLUMNS, HEADER_DISPLAY, HEADER_FIELDS, ITEM_COLUMNS,
                                          ITEM_DISPLAY, ITEM_FIELDS, conform_headers, conform_items)
from fieldloom.session import checkpoint_dir

STATUS_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("file_id", T.StringType()),
    T.StructField("filename", T.StringType()), T.StructField("seq", T.LongType()),
    T.StructField("status", T.StringType()), T.StructField("provider", T.StringType()),
    T.StructField("invoice_csv", T.StringType()), T.StructField("item_csv", T.StringType()),
    T.StructField("error", T.StringType()),
])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/fieldloom/{name}/{uuid.uuid4().hex}"


def _display(df: DataFrame, cols: list[str], names: dict[str, str], keep: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(k) for k in keep], *[F.col(c).alias(names[c]) for c in cols])


#: Quotes doubled, empty text as nothing, fields with line ends in quotes: what CSV readers elsewhere expect.
_CSV = {"header": True, "encoding": "UTF-8", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "",
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
_CSV_READ = {**_CSV, "multiLine": True}


def write_headers_csv(headers: DataFrame, path: str, partition_by: tuple[str, ...] = (),
                      mode: str = "overwrite") -> None:
    """Header records as CSV with the display names and a header row."""
    out = _display(headers, HEADER_COLUMNS, HEADER_DISPLAY, partition_by)
    w = out.write.mode(mode).options(**_CSV)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_items_csv(items: DataFrame, path: str, partition_by: tuple[str, ...] = (),
                    mode: str = "overwrite") -> None:
    """Item records as CSV; an empty item set still writes the 19-column header."""
    out = _display(items, ITEM_COLUMNS, ITEM_DISPLAY, partition_by)
    w = out.write.mode(mode).options(**_CSV)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Any frame as CSV with a header row, no index column."""
    df.write.mode(mode).options(**_CSV).csv(path)


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """The column names of a CSV dataset (header row)."""
    return spark.read.options(**_CSV_READ).csv(path).columns


def _typed_schema(fields) -> T.StructType:
    return T.StructType([T.StructField(disp, typ, True) for _, disp, typ, _, _ in fields])


def read_headers_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read header CSV back into snake_case typed columns (plus partition columns)."""
    df = spark.read.options(**_CSV_READ).schema(_typed_schema(HEADER_FIELDS)).csv(path)
    inv = {v: k for k, v in HEADER_DISPLAY.items()}
    df = df.select(*[F.col(f"`{c}`").alias(inv.get(c, c)) for c in df.columns])
    extra = tuple(c for c in df.columns if c not in HEADER_DISPLAY)
    return conform_headers(df, extra)  # empty CSV fields read as NULL -> contract default


def read_items_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.options(**_CSV_READ).schema(_typed_schema(ITEM_FIELDS)).csv(path)
    inv = {v: k for k, v in ITEM_DISPLAY.items()}
    df = df.select(*[F.col(f"`{c}`").alias(inv.get(c, c)) for c in df.columns])
    extra = tuple(c for c in df.columns if c not in ITEM_DISPLAY)
    return conform_items(df, extra)


def write_status(status: DataFrame, path: str, mode: str = "append") -> None:
    """Status events as JSON records, partitioned by job."""
    cols = [f.name for f in STATUS_SCHEMA.fields]
    status.select(*[F.col(c).cast(STATUS_SCHEMA[c].dataType) if c in status.columns
                    else F.lit(None).cast(STATUS_SCHEMA[c].dataType).alias(c) for c in cols]) \
        .write.mode(mode).partitionBy("job_id").json(path)


def read_status(spark: SparkSession, path: str, job_id: str | None = None) -> DataFrame:
    """Status events of one job (partition-pruned); empty result = unknown job."""
    df = spark.read.schema(STATUS_SCHEMA).json(path)
    return df.where(F.col("job_id") == job_id) if job_id is not None else df


def output_names(file_id: str = "file_id") -> tuple:
    """Per-document output names kept as status columns."""
    return (F.concat(F.lit("invoice_level_"), F.col(file_id), F.lit(".csv")).alias("invoice_csv"),
            F.concat(F.lit("item_level_"), F.col(file_id), F.lit(".csv")).alias("item_csv"))


def write_record_tables(headers: DataFrame, items: DataFrame, name: str, path: str, buckets: int = 64) -> None:
    """``<name>_headers`` and ``<name>_items`` as tables bucketed and sorted by ``doc_key``, one file a bucket.

    The rows are shuffled once, here; every later join or grouping by ``doc_key`` needs no exchange.
    A key with very many items makes its bucket that much longer: the records of one document.
    """
    for kind, rows in (("headers", headers), ("items", items)):
        rows.repartition(buckets, "doc_key").write.mode("overwrite").bucketBy(buckets, "doc_key").sortBy("doc_key") \
            .option("path", f"{path}/{kind}").saveAsTable(f"{name}_{kind}")


def read_record_tables(spark: SparkSession, name: str) -> DataFrame:
    """Every header with its items, one row per item, or one without an item; joined without an exchange."""
    h, i = spark.table(f"{name}_headers").alias("h"), spark.table(f"{name}_items").alias("i")
    i = i.select("doc_key", *[F.col(c).alias(f"item_{c}" if c in h.columns else c) for c in i.columns if c != "doc_key"])
    return h.hint("merge").join(i, "doc_key", "left")
