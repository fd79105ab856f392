"""Text assembly and document admission.

* Pages -> document text (T1/T2): newline after every page, in page order.
* Words -> document text (T3): space after every word, newline after every line.
* Native vs OCR choice (T4) and first non-empty engine (T5).
* Listing of files, admission by name suffix with whole-batch rejection and
  quarantine (S1), and stable file ids (S2).

Aggregations are two-level where a single document could be very large: the
first level groups a bounded chunk of pages (or one line of words), the
second concatenates chunk texts in order.  Both levels are partially
aggregated map-side; no group ever holds more than one chunk's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.rx import strip

PAGES_PER_CHUNK = 256
OCR_MIN_CHARS = 100  # fixed value: native text shorter than this (stripped) tries OCR
ADMIT_SUFFIX = ".pdf"


def _ordered_concat(key_cols: list[str], order_col: str, text: Column) -> Column:
    """Sorted concatenation inside an aggregation (no separate sort stage)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"),
                                                                         text.alias("t")))),
                                    lambda s: s["t"]), "")


def pages_to_text(pages: DataFrame, doc: str = "doc_key", page: str = "page_no", text: str = "text",
                  pages_per_chunk: int = PAGES_PER_CHUNK) -> DataFrame:
    """``(doc, page, text)`` -> ``(doc_key, text)``; every page text is
    followed by a newline; NULL page text counts as empty."""
    body = F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n"))
    chunks = (pages.select(F.col(doc).alias("doc_key"), F.col(page).alias("page_no"), body.alias("t"))
              .groupBy("doc_key", F.floor(F.col("page_no") / pages_per_chunk).alias("chunk"))
              .agg(_ordered_concat([], "page_no", F.col("t")).alias("t")))
    return chunks.groupBy("doc_key").agg(_ordered_concat([], "chunk", F.col("t")).alias("text"))


def document_words(docs: DataFrame, lines_per_page: int = 50, lines_per_block: int = 10) -> DataFrame:
    """A word table ``(doc_key, page, block, line, word, value)`` derived from
    document texts (lines split on newline, words on single spaces)."""
    lines = docs.select("doc_key", F.posexplode_outer(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"))
                        .alias("ln", "line_text"))
    words = lines.select("doc_key", "ln", F.posexplode_outer(F.split("line_text", " ")).alias("word", "value"))
    return words.select(
        "doc_key",
        F.floor(F.col("ln") / lines_per_page).cast("int").alias("page"),
        F.floor((F.col("ln") % lines_per_page) / lines_per_block).cast("int").alias("block"),
        (F.col("ln") % lines_per_block).cast("int").alias("line"),
        F.col("word").cast("int").alias("word"), "value")


def words_to_text(words: DataFrame) -> DataFrame:
    """``(doc_key, page, block, line, word, value)`` -> ``(doc_key, text)``."""
    line_text = (words.groupBy("doc_key", "page", "block", "line")
                 .agg(_ordered_concat([], "word", F.concat(F.col("value"), F.lit(" "))).alias("t")))
    line_text = line_text.select("doc_key", F.struct("page", "block", "line").alias("pos"),
                                 F.concat("t", F.lit("\n")).alias("t"))
    return line_text.groupBy("doc_key").agg(_ordered_concat([], "pos", F.col("t")).alias("text"))


def prefer_text(native: DataFrame, ocr: DataFrame, min_chars: int = OCR_MIN_CHARS) -> DataFrame:
    """T4: keep the native text unless its stripped length is under ``min_chars``
    and the OCR text's stripped length is strictly longer.

    Only the short native documents meet the OCR table (the expensive branch
    runs only where needed); long ones pass through without a shuffle.
    """
    n = native.select("doc_key", "text", F.length(strip(F.coalesce(F.col("text"), F.lit("")))).alias("_n"))
    long_ = n.where(F.col("_n") >= min_chars).select("doc_key", F.lit("native").alias("source"), "text")
    short = n.where(F.col("_n") < min_chars)
    o = ocr.select("doc_key", F.col("text").alias("_ocr"))
    j = short.join(o, "doc_key", "left")
    use_ocr = F.coalesce(F.length(strip(F.col("_ocr"))), F.lit(-1)) > F.col("_n")
    chosen = j.select("doc_key", F.when(use_ocr, F.lit("ocr")).otherwise(F.lit("native")).alias("source"),
                      F.when(use_ocr, F.col("_ocr")).otherwise(F.col("text")).alias("text"))
    return long_.unionByName(chosen)


def prefer_text_of_pages(native: DataFrame, pages: DataFrame, min_chars: int = OCR_MIN_CHARS) -> DataFrame:
    """T4 from OCR pages: only the pages of documents with a short native text are assembled."""
    short = native.where(F.length(strip(F.coalesce(F.col("text"), F.lit("")))) < min_chars).select("doc_key")
    return prefer_text(native, pages_to_text(pages.join(short, "doc_key", "left_semi")), min_chars)


def first_nonempty_text(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """T5: first non-empty of two extraction engines, else ''."""
    p = primary.select("doc_key", F.col("text").alias("_a"))
    s = secondary.select("doc_key", F.col("text").alias("_b"))
    j = p.join(s, "doc_key", "full")
    return j.select("doc_key", F.coalesce(F.nullif(F.col("_a"), F.lit("")), F.nullif(F.col("_b"), F.lit("")),
                                          F.lit("")).alias("text"))


def file_name(path: Column) -> Column:
    """Last path segment of a path or URL."""
    return F.element_at(F.split(path, "/"), -1)


def admit(files: DataFrame, path: str = "path", batch: str = "job_id", suffix: str = ADMIT_SUFFIX) -> DataFrame:
    """``admitted`` per file (name ends with the suffix, case-sensitive),
    ``batch_admitted`` (every file of the batch admitted: one bad file rejects
    the whole batch), and a stable ``file_id``.

    The batch verdict is an aggregate per batch joined back on the batch key
    (partial aggregation; no window that would pull a whole batch into one task).
    """
    name = file_name(F.col(path))
    f = files.select("*", name.alias("filename"), name.endswith(suffix).alias("admitted"),
                     F.sha2(F.concat_ws("|", F.col(batch).cast("string"), F.col(path)), 256).alias("file_id"))
    verdict = f.groupBy(batch).agg(F.min(F.col("admitted").cast("int")).alias("_ok"))
    return (f.join(verdict, batch, "left")
            .withColumn("batch_admitted", F.col("_ok") == 1).drop("_ok"))


def list_files(spark: SparkSession, folder: str, batch: str = "job_id") -> DataFrame:
    """The files under a folder: ``path``, ``length``, ``modified`` and their batch, the folder that each lies in.
    Contents are not read: the column is pruned from the scan.  Spark's reader leaves out files of no bytes,
    so these are neither admitted nor quarantined here; list them from the upload's own records."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"),
                        F.element_at(F.split("path", "/"), -2).alias(batch))


def admit_or_quarantine(files: DataFrame, out: str, path: str = "path", batch: str = "job_id",
                        suffix: str = ADMIT_SUFFIX) -> tuple[DataFrame, DataFrame]:
    """S1 with its rejects: the admitted files and the quarantined ones, written in one pass.

    Quarantined rows have a ``reason``: the file's own name, or another name of its batch.  Both frames
    read their part of ``out`` only.  A file without a path is rejected by its name; files without a
    batch make up one batch.
    """
    name = file_name(F.col(path))
    good = F.coalesce(name.endswith(suffix), F.lit(False))
    f = files.select("*", name.alias("filename"), good.alias("_good"),
                     F.sha2(F.concat_ws("|", F.col(batch).cast("string"), F.col(path)), 256).alias("file_id"))
    verdict = f.groupBy(F.col(batch).alias("_batch")).agg(F.min("_good").alias("_ok"))
    reason = F.when(~F.col("_good"), F.concat(F.lit("name does not end in "), F.lit(suffix))) \
        .when(~F.col("_ok"), F.lit("another file of the batch was rejected"))
    f.join(verdict, F.col(batch).eqNullSafe(F.col("_batch"))) \
        .withColumn("reason", reason).withColumn("verdict", F.when(F.col("_ok"), "admitted").otherwise("quarantined")) \
        .drop("_batch", "_good", "_ok").write.mode("overwrite").partitionBy("verdict").parquet(out)
    back = files.sparkSession.read.schema(T.StructType([*files.schema.fields, *(T.StructField(c, T.StringType()) for c in
                                                        ("filename", "file_id", "reason", "verdict"))])).parquet(out)
    return (back.where(F.col("verdict") == "admitted").drop("verdict", "reason"),
            back.where(F.col("verdict") == "quarantined").drop("verdict"))
