"""Job bookkeeping and incremental processing.

* ``status_events`` - the status log of a bulk job: one ``processing`` event
  and one final ``completed`` / ``failed`` event per document (J2, J4).
* ``latest_status`` - latest state per file (J3) with ``max_by`` inside a
  partially aggregated ``groupBy``: no window, no sort of whole partitions.
* ``job_summary`` - per-job counts (J6).
* ``stream_extract`` - the same extraction over files arriving in a folder,
  with Structured Streaming (J5).  Header, item and status tables are written
  in one ``foreachBatch`` into folders keyed by the batch id, so a replayed
  micro-batch overwrites its own output and never duplicates rows.
  Documents whose extraction fails are dead letters beside them (J4), which
  ``replay_dead_letters`` extracts anew by another profile.
* ``first_arrivals`` / ``dropped_arrivals`` - duplicates across arrivals (X3).
* ``status_windows`` - status counts per event-time window with a watermark (X6).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.contract import contract_flags
from fieldloom.operators.header import extract_headers
from fieldloom.operators.items import extract_items
from fieldloom.sources.sink import output_names


def status_events(headers: DataFrame, job_id: str, provider: str = "regex",
                  error_col: str | None = None, keep: tuple[str, ...] = (), start: int = 0) -> DataFrame:
    """Two events per document (``processing`` then ``completed`` or
    ``failed``); a per-row error never stops the batch.  ``seq`` orders the events
    of a file (from ``start``), so keys of any type will do.  Both events come from one pass
    over the records (``explode`` of a two-element array), so the extraction
    upstream, which the error column reads, runs once."""
    err = F.col(error_col) if error_col else F.lit(None).cast("string")
    k = F.col("doc_key")
    fid = k.cast("string")
    inv_csv, item_csv = output_names("_fid")
    null_s = F.lit(None).cast("string")
    first = F.struct(F.lit(start).cast("bigint").alias("seq"), F.lit("processing").alias("status"), null_s.alias("invoice_csv"),
                     null_s.alias("item_csv"), null_s.alias("error"))
    done = F.struct(F.lit(start + 1).cast("bigint").alias("seq"),
                    F.when(F.col("_err").isNull(), F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
                    F.when(F.col("_err").isNull(), inv_csv).alias("invoice_csv"),
                    F.when(F.col("_err").isNull(), item_csv).alias("item_csv"), F.col("_err").alias("error"))
    base = headers.select("doc_key", *keep, fid.alias("_fid"), err.alias("_err"))
    ev = base.select(F.lit(job_id).alias("job_id"), F.col("_fid").alias("file_id"), F.col("_fid").alias("filename"),
                     F.lit(provider).alias("provider"), *keep, F.explode(F.array(first, done)).alias("e"))
    return ev.select("job_id", "file_id", "filename", "e.seq", "e.status", "provider", "e.invoice_csv",
                     "e.item_csv", "e.error", *keep)


def latest_status(events: DataFrame, file: str = "file_id", seq: str = "seq",
                  cols: tuple[str, ...] = ("status",)) -> DataFrame:
    """The latest event per file (``max_by`` over the ordering column)."""
    latest = F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(seq))
    out = events.groupBy(file).agg(latest.alias("_l"), F.max(seq).alias(f"last_{seq}"),
                                   F.count("*").alias("n_events"))
    return out.select(file, *[F.col(f"_l.{c}").alias(c) for c in cols], f"last_{seq}", "n_events")


def job_summary(events: DataFrame, job: str = "job_id", file: str = "file_id",
                status: str = "status", statuses: tuple[str, ...] = ()) -> DataFrame:
    """Files and events per job, with a count per listed status."""
    aggs = [F.countDistinct(file).alias("n_files"), F.count("*").alias("n_events")]
    aggs += [F.sum((F.col(status) == s).cast("bigint")).alias(f"n_{s}") for s in statuses]
    return events.groupBy(job).agg(*aggs)


def job_files(events: DataFrame, job: str = "job_id", file: str = "file_id", status: str = "status",
              seq: str = "seq") -> DataFrame:
    """The files of each job with their latest status, one row per file."""
    return events.groupBy(job, file).agg(F.max_by(status, seq).alias(status), F.count("*").alias("n_events"))


def status_windows(events: DataFrame, ts: str = "ts", status: str = "event_type",
                   window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Count per status and event-time window; rows later than the
    watermark are dropped in streaming mode (no effect on a batch frame).

    Watermarks need a zone-aware ``TIMESTAMP``; a ``TIMESTAMP_NTZ`` event time
    is read in the session time zone for the window and the window bounds are
    returned in the input's type.
    """
    ntz = dict(events.dtypes).get(ts) == "timestamp_ntz"
    if ntz:
        events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    w = events.withWatermark(ts, watermark).groupBy(F.window(ts, window), F.col(status)).count()
    start, end = F.col("window.start"), F.col("window.end")
    if ntz:
        start, end = start.cast("timestamp_ntz"), end.cast("timestamp_ntz")
    return w.select(start.alias("window_start"), end.alias("window_end"), status, F.col("count").alias("n"))


ROWS_PER_FILE = 10_000  # a file of invoices: about 10 MB of text


def land(df: DataFrame, path: str, rows: int, least: int = 4, rows_per_file: int = ROWS_PER_FILE,
         shuffled: bool = True) -> int:
    """Writes rows dealt by ``doc_key`` to ``path``, in as many files as ``rows`` (their number, or near it) asks for, so that no task
    gets more as the input grows.  Returns how many files it dealt to; those without rows are not written.

    Not ``shuffled``, the rows stay in the tasks that made them, which cut their files at that many rows: for texts
    that were just made from a shuffle, as shuffling them again takes several times its disk."""
    files = max(least, -(-rows // rows_per_file))
    if shuffled:
        df.repartition(files, "doc_key").write.parquet(path)
        return files
    df.write.option("maxRecordsPerFile", max(1, rows // files)).option("compression", "zstd").parquet(path)
    return len(df.sparkSession.read.schema(df.schema).parquet(path).inputFiles())


def stream_extract(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str,
                   profile: str = "simple", item_profile: str = "layout", job_id: str = "stream",
                   max_files_per_trigger: int | None = None, schema=None) -> None:
    """Extract headers and items from parquet files of ``(doc_key, text)``
    arriving in ``source_dir``; run until the available files are processed.

    Output: ``out_dir/headers/batch=<id>``, ``out_dir/items/batch=<id>``,
    ``out_dir/status/batch=<id>``, and ``out_dir/dead/batch=<id>`` with key, text and error of
    the documents whose extraction fails its contract; each batch folder is overwritten on replay.
    """
    from pyspark.sql import types as T
    schema = schema or T.StructType([T.StructField("doc_key", T.LongType()), T.StructField("text", T.StringType())])
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    docs = reader.parquet(source_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # read by three writes: extracted once; of the texts only the dead letters' are kept, items read them from the batch
        h = contract_flags(extract_headers(batch, profile, keep=("text",)), "header", ("invoice_document_number",))
        h = h.withColumn("text", F.when(~F.col("contract_ok"), F.col("text"))).persist()
        try:
            for name, rows in (("headers", h.drop("text", "contract_ok", "contract_error")),
                               ("items", extract_items(batch.select("doc_key", "text"), item_profile)),
                               ("status", status_events(h, job_id, error_col="contract_error")),
                               ("dead", h.where(~F.col("contract_ok")).select("doc_key", "text", "contract_error"))):
                rows.write.mode("overwrite").parquet(f"{out_dir}/{name}/batch={batch_id}")
        finally:
            h.unpersist()

    q = (docs.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def replay_dead_letters(spark: SparkSession, out_dir: str, profile: str = "layout", item_profile: str = "layout",
                        job_id: str = "stream") -> DataFrame:
    """Extracts the dead letters of :func:`stream_extract` anew by another profile.

    Rows that pass now go to ``out_dir/replay/headers``, ``items`` and ``status``, with the ``batch`` they
    came in; a replay takes the place of an earlier one, so replaying twice leaves no duplicates.
    Returns the rows that still fail: doc_key, batch, contract_error.
    """
    dead = spark.read.parquet(f"{out_dir}/dead")
    h = contract_flags(extract_headers(dead.drop("contract_error"), profile, keep=("text", "batch")), "header",
                       ("invoice_document_number",)).persist()
    try:
        good = h.where("contract_ok")
        for name, rows in (("headers", good.drop("text", "contract_ok", "contract_error")),
                           ("items", extract_items(good.select("doc_key", "text", "batch"), item_profile, keep=("batch",))),
                           ("status", status_events(good, job_id, error_col="contract_error", keep=("batch",), start=2))):
            rows.write.mode("overwrite").parquet(f"{out_dir}/replay/{name}")
    finally:
        h.unpersist()
    passed = spark.read.parquet(f"{out_dir}/replay/headers").select("doc_key", "batch")
    return dead.join(passed, ["doc_key", "batch"], "left_anti").select("doc_key", "batch", "contract_error")


def extracted_headers(spark: SparkSession, out_dir: str) -> DataFrame:
    """Headers of :func:`stream_extract`, those replaced that :func:`replay_dead_letters` got right."""
    h, again = (spark.read.parquet(f"{out_dir}/{d}") for d in ("headers", "replay/headers"))
    return h.join(again.select("doc_key", "batch"), ["doc_key", "batch"], "left_anti").unionByName(again)


def first_arrivals(headers: DataFrame, arrived: str = "arrived", within: str = "30 days") -> DataFrame:
    """X3 on a stream: the first header of each supplier's document number; later ones that arrive
    ``within`` that time of it are dropped.  The state of a number is freed at the end of the first batch
    whose watermark has passed it; until then later ones are dropped as well.
    Blank and default numbers are no numbers."""
    number = F.trim(F.coalesce(F.col("invoice_document_number"), F.lit("")))
    return headers.where((number != "") & (number != "UNKNOWN")).withWatermark(arrived, within) \
        .dropDuplicatesWithinWatermark(["supplier_gstin", "invoice_document_number"])


def dropped_arrivals(headers: DataFrame, kept: DataFrame) -> DataFrame:
    """The report beside :func:`first_arrivals`: every dropped ``doc_key`` with its number, from the headers
    that arrived and those kept (both written by the stream)."""
    number = F.trim(F.coalesce(F.col("invoice_document_number"), F.lit("")))
    return headers.where((number != "") & (number != "UNKNOWN")).join(kept.select("doc_key"), "doc_key", "left_anti") \
        .select("supplier_gstin", "invoice_document_number", "doc_key")
