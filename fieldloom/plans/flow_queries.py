"""Registered queries for assembly, admission, jobs, streaming, sinks,
relations and corpus-level additions, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import relate as R
from fieldloom.operators.header import extract_headers
from fieldloom.operators.items import extract_items
from fieldloom.plans.common import HEADER_MONEY, dec, decimals, invoices
from fieldloom.plans.extract_queries import D2, DOC_SRC, ITEM_SRC, ORACLE as EXTRACT_ORACLE, _with
from fieldloom.plans.oracle_corpus import TAXID_CUSTOMER, TAXID_SUPPLIER
from fieldloom.sources import assemble as A
from fieldloom.sources import sink as S
from fieldloom.sources.tables import Tables
from fieldloom.streaming import jobs as J
from fieldloom.streaming.status_store import StatusStore, stream_status


def _conv_pages(t: Tables) -> DataFrame:
    return t.conversations.select(F.col("conv_id").alias("doc_key"), F.col("turn").alias("page_no"), "text")


def _native(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("doc_key"), "text")


def q_pages_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return A.pages_to_text(_conv_pages(Tables(spark, sf)))


def q_words_to_text(spark, sf):
    return A.words_to_text(A.document_words(_native(Tables(spark, sf))))


def q_prefer_text(spark, sf):
    t = Tables(spark, sf)
    return A.prefer_text_of_pages(_native(t), _conv_pages(t))


def q_first_engine_text(spark, sf):
    t = Tables(spark, sf)
    return A.first_nonempty_text(_native(t), A.pages_to_text(_conv_pages(t)))


def _uploads(spark, sf):
    """Pages as uploads in jobs of 25; one page of every other job has no ``.pdf`` name."""
    job = F.floor(F.col("page_id") / 25).cast("bigint")
    named = (job % 2 == 0) | (F.col("page_id") % 25 != 3)
    return Tables(spark, sf).pages.select("page_id", job.alias("job_id"), F.concat("url", F.when(named, ".pdf").otherwise("")).alias("path"))


def q_admit_documents(spark, sf):
    return A.admit(_uploads(spark, sf)).select("page_id", "job_id", "file_id", "filename", "admitted", "batch_admitted")


def q_quarantine_documents(spark, sf):
    """S1 with its rejects: both outputs of one pass, the reason beside each rejected file."""
    good, bad = A.admit_or_quarantine(_uploads(spark, sf), S.scratch_path(spark, "quarantine"))
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad) \
        .select("page_id", "job_id", "file_id", "filename", "reason")


def _status_log(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("file_id"), F.col("ts"), F.col("event_type").alias("status"))


def q_job_status_latest(spark, sf):
    return J.latest_status(_status_log(Tables(spark, sf)), seq="ts")


STATUSES = ("signup", "click", "purchase", "error", "view")


def q_job_summary(spark, sf):
    e = Tables(spark, sf).events.select(F.to_date("ts").alias("job_id"), F.col("user_id").alias("file_id"),
                                        F.col("event_type").alias("status"))
    return J.job_summary(e, statuses=STATUSES)


def q_job_files(spark, sf):
    e = Tables(spark, sf).events.select(F.to_date("ts").alias("job_id"), F.col("user_id").alias("file_id"), "ts",
                                        F.col("event_type").alias("status"))
    return J.job_files(e, seq="ts")


def q_status_windows(spark, sf):
    return J.status_windows(Tables(spark, sf).events)


def q_bulk_status(spark, sf):
    """The minimal extraction of every invoice; a document without a number fails."""
    h = extract_headers(invoices(spark, sf), "minimal")
    checked = R.contract_check(h, fields=("invoice_document_number",))
    ev = J.status_events(checked, job_id="bulk", error_col="contract_error")
    return J.latest_status(ev, cols=("status", "invoice_csv", "item_csv", "error"))


def q_status_json_roundtrip(spark, sf):
    """The bulk job's events written as JSON, read back for the job."""
    h = extract_headers(invoices(spark, sf), "minimal")
    checked = R.contract_check(h, fields=("invoice_document_number",))
    path = S.scratch_path(spark, "status")
    S.write_status(J.status_events(checked, job_id="bulk", error_col="contract_error"), path)
    return S.read_status(spark, path, "bulk").select("file_id", "seq", "status", "provider", "invoice_csv", "error")


FILES_PER_BATCH = 100


def _per_batch(files: int) -> int:
    """Half of the files, so there are two micro-batches, and more of ``FILES_PER_BATCH`` when the input grows."""
    return min(FILES_PER_BATCH, -(-files // 2))


def q_stream_extract(spark, sf):
    """Invoices land as parquet files; a Structured Streaming job extracts
    them micro-batch by micro-batch; the header output is read back."""
    base = S.scratch_path(spark, "stream")
    src = f"{base}/in"
    files = J.land(invoices(spark, sf), src, Tables(spark, sf).orders.count(), shuffled=False)
    J.stream_extract(spark, src, f"{base}/out", f"{base}/checkpoint", max_files_per_trigger=_per_batch(files))
    h = spark.read.parquet(f"{base}/out/headers").drop("batch")
    return decimals(h, HEADER_MONEY)


def q_status_live(spark, sf):
    """The event log lands as files and is streamed into the status store, with snapshots on the way."""
    base = S.scratch_path(spark, "live")
    log = _status_log(Tables(spark, sf)).select(F.to_date("ts").alias("job_id"), F.col("file_id"), F.col("ts").alias("seq"), "status")
    log.repartition(6, "file_id", "seq").write.parquet(f"{base}/in")
    store = StatusStore(spark, f"{base}/store", log.schema)
    stream_status(store, spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in"),
                  f"{base}/checkpoint", compact_every=2)
    return store.latest().select("job_id", "file_id", "status", F.col("seq").alias("last_ts"), "n_events")


def _failing_stream(spark, sf, kind):
    """Invoices streamed through the minimal profile, which finds no number in a third of them; those are replayed."""
    base = S.scratch_path(spark, kind)
    files = J.land(invoices(spark, sf), f"{base}/in", Tables(spark, sf).orders.count(), least=16, shuffled=False)
    J.stream_extract(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", profile="minimal", max_files_per_trigger=_per_batch(files))
    return f"{base}/out", J.replay_dead_letters(spark, f"{base}/out", "simple")


def q_stream_dead_letters(spark, sf):
    """The stream's dead letters, their errors, and the numbers that the replay finds."""
    out, left = _failing_stream(spark, sf, "dead")
    again = J.extracted_headers(spark, out).select("doc_key", "batch", "invoice_document_number")
    return spark.read.parquet(f"{out}/dead").join(again, ["doc_key", "batch"]) \
        .join(left.select("doc_key", "batch", F.lit(True).alias("_left")), ["doc_key", "batch"], "left") \
        .select("doc_key", "contract_error", "invoice_document_number", F.coalesce("_left", F.lit(False)).alias("still_dead"))


def q_stream_replay_status(spark, sf):
    """Every document's latest state after the replay, and the events behind it."""
    out, _ = _failing_stream(spark, sf, "replayed")
    ev = spark.read.parquet(f"{out}/status").unionByName(spark.read.parquet(f"{out}/replay/status"))
    return J.latest_status(ev, cols=("status", "error"))


def q_stream_duplicates(spark, sf):
    """X3 across arrivals: invoices and a second upload of every seventh, in files, streamed; the dropped ones."""
    base = S.scratch_path(spark, "arrivals")
    k = F.col("doc_key")
    # each text is rendered once, its second upload beside it
    docs = invoices(spark, sf).select(F.explode(F.when(k % 7 == 0, F.array(k, -k - 1)).otherwise(F.array(k))).alias("doc_key"), "text")
    files = J.land(docs.withColumn("arrived", F.timestamp_seconds(F.abs("doc_key"))), f"{base}/in", Tables(spark, sf).orders.count(), shuffled=False)
    source = spark.readStream.schema("doc_key long, text string, arrived timestamp") \
        .option("maxFilesPerTrigger", -(-files // 2)).parquet(f"{base}/in")
    h = extract_headers(source, "minimal", keep=("arrived",)).select("doc_key", "arrived", "supplier_gstin", "invoice_document_number")
    J.first_arrivals(h, within="3650 days").writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint") \
        .trigger(availableNow=True).start(f"{base}/kept").awaitTermination()
    arrived = extract_headers(spark.read.parquet(f"{base}/in"), "minimal")
    dropped = J.dropped_arrivals(arrived, spark.read.schema("doc_key long").parquet(f"{base}/kept"))
    return dropped.groupBy("supplier_gstin", "invoice_document_number").agg(F.count("*").alias("n_dropped"))


def q_csv_roundtrip(spark, sf):
    """Headers written as CSV with display names, read back by name."""
    path = S.scratch_path(spark, "csv")
    S.write_headers_csv(extract_headers(invoices(spark, sf), "simple"), f"{path}/headers")
    back = S.read_headers_csv(spark, f"{path}/headers")
    back = back.select(F.col("serial_number").cast("bigint").alias("doc_key"), *back.columns)
    return decimals(back, HEADER_MONEY)


def _hi(spark, sf):
    docs = invoices(spark, sf)
    return extract_headers(docs, "simple"), extract_items(docs, "layout")


def _records(spark, sf, fields):
    return R.records(invoices(spark, sf), "simple", "layout", header_fields=fields)


def q_header_item_join(spark, sf):
    rec = _records(spark, sf, ["invoice_document_number", "document_type"])
    return decimals(R.header_item_rows(rec), ["line_total_value"])


def q_record_tables(spark, sf):
    """R1 over two bucketed tables of records, both made from invoices that are rendered once."""
    path = S.scratch_path(spark, "records")
    invoices(spark, sf).write.option("compression", "zstd").parquet(f"{path}/invoices")
    docs = spark.read.parquet(f"{path}/invoices")
    h, i = extract_headers(docs, "simple"), extract_items(docs, "layout")
    name = "records_" + path.rsplit("/", 1)[-1]
    S.write_record_tables(h.select("doc_key", "invoice_document_number", "document_type"),
                          i.select("doc_key", "line_number", "item_sku_code", "line_total_value"), name, path, buckets=8)
    return decimals(S.read_record_tables(spark, name), ["line_total_value"])


def q_items_per_doc(spark, sf):
    return R.item_counts(R.document_records(invoices(spark, sf), header_fields=[]))


def q_first_item(spark, sf):
    return decimals(R.first_item_of(R.document_records(invoices(spark, sf), header_fields=[])), ["line_total_value"])


def q_header_summary(spark, sf):
    h, _ = _hi(spark, sf)
    return decimals(R.header_summary(h), ["total_invoice_value"])


def q_contract_check(spark, sf):
    """R5 on the parties and number of the minimal extraction: about a third lacks a number."""
    h = extract_headers(invoices(spark, sf), "minimal")
    return R.contract_check(h, fields=("document_type", "invoice_document_number", "supplier_name", "buyer_name",
                                       "supplier_gstin", "total_invoice_value")) \
        .select("doc_key", "contract_ok", "contract_error")


def q_hostile_documents(spark, sf):
    """Whole prose and web page texts, each pressed into one line; every other one has a number in
    front.  Bad rows carry an error, none ends the job."""
    t = Tables(spark, sf)
    docs = t.documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text") \
        .unionByName(t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text")))
    line = F.translate(F.coalesce("text", F.lit("")), "\n", " ")
    front = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Document No: H"), F.col("id").cast("string"), F.lit("\n"))).otherwise("")
    h = extract_headers(docs.select(F.concat_ws("-", "kind", "id").alias("doc_key"), F.concat(front, line).alias("text")), "minimal")
    return R.contract_check(h, fields=("invoice_document_number",)) \
        .select("doc_key", "invoice_document_number", "contract_ok", "contract_error")


def q_reconcile(spark, sf):
    r = R.reconcile_records(R.document_records(invoices(spark, sf), header_fields=["subtotal_taxable_value"]))
    return decimals(r, ["subtotal", "items_total", "difference"])


def q_coverage(spark, sf):
    return R.coverage(extract_headers(invoices(spark, sf), "layout"))


def q_dup_numbers(spark, sf):
    """X3 over all invoices and a second upload of every seventh, with its texts unchanged."""
    docs = invoices(spark, sf)
    again = docs.where(F.col("doc_key") % 7 == 0).withColumn("doc_key", -F.col("doc_key") - 1)
    return R.duplicate_numbers(extract_headers(docs.unionByName(again), "minimal"))


def q_spend_rollup(spark, sf):
    return R.spend_rollup(extract_headers(invoices(spark, sf), "simple"))


def q_profile_agreement(spark, sf):
    return R.profile_agreement(invoices(spark, sf))


QUERIES = {
    "pages_to_text": q_pages_to_text,
    "words_to_text": q_words_to_text,
    "prefer_text": q_prefer_text,
    "first_engine_text": q_first_engine_text,
    "admit_documents": q_admit_documents,
    "quarantine_documents": q_quarantine_documents,
    "job_status_latest": q_job_status_latest,
    "status_live": q_status_live,
    "job_summary": q_job_summary,
    "job_files": q_job_files,
    "status_windows": q_status_windows,
    "bulk_status": q_bulk_status,
    "status_json_roundtrip": q_status_json_roundtrip,
    "stream_extract": q_stream_extract,
    "stream_dead_letters": q_stream_dead_letters,
    "stream_replay_status": q_stream_replay_status,
    "stream_duplicates": q_stream_duplicates,
    "csv_roundtrip": q_csv_roundtrip,
    "header_item_join": q_header_item_join,
    "record_tables": q_record_tables,
    "items_per_doc": q_items_per_doc,
    "first_item": q_first_item,
    "header_summary": q_header_summary,
    "contract_check": q_contract_check,
    "hostile_documents": q_hostile_documents,
    "reconcile": q_reconcile,
    "coverage": q_coverage,
    "dup_numbers": q_dup_numbers,
    "spend_rollup": q_spend_rollup,
    "profile_agreement": q_profile_agreement,
}

# --- oracles ------------------------------------------------------------------------

# Python's white space (str.isspace) as an RE2 class.
_PYWS = r"[\t\n\x0b\f\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _slen(x: str) -> str:
    return f"length(regexp_replace({x}, '^{_PYWS}+|{_PYWS}+$', '', 'g'))"


_CONV_TEXT = """conv_text AS (
  SELECT conv_id AS doc_key, string_agg(coalesce(text, '') || chr(10), '' ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id)"""

_PREFER = f"""
SELECT d.doc_id AS doc_key,
  CASE WHEN {_slen("coalesce(d.text, '')")} < 100 AND coalesce({_slen('o.text')}, -1) > {_slen("coalesce(d.text, '')")}
       THEN 'ocr' ELSE 'native' END AS source,
  CASE WHEN {_slen("coalesce(d.text, '')")} < 100 AND coalesce({_slen('o.text')}, -1) > {_slen("coalesce(d.text, '')")}
       THEN o.text ELSE d.text END AS text
FROM documents d LEFT JOIN conv_text o ON d.doc_id = o.doc_key"""

_ADMIT = """
WITH p AS (
  SELECT page_id, job_id, url, string_split(url, '/')[-1] AS filename,
         ends_with(string_split(url, '/')[-1], '.pdf') AS admitted
  FROM (SELECT page_id, page_id // 25 AS job_id,
               url || CASE WHEN (page_id // 25) % 2 = 0 OR page_id % 25 <> 3 THEN '.pdf' ELSE '' END AS url FROM pages) u)
SELECT page_id, job_id, sha256(CAST(job_id AS VARCHAR) || '|' || url) AS file_id, filename, admitted,
       bool_and(admitted) OVER (PARTITION BY job_id) AS batch_admitted
FROM p"""

_QUARANTINE = f"""
SELECT page_id, job_id, file_id, filename, CASE WHEN NOT admitted THEN 'name does not end in .pdf'
  WHEN NOT batch_admitted THEN 'another file of the batch was rejected' END AS reason
FROM ({_ADMIT}) a"""

_STATUS_COUNTS = ", ".join(f"CAST(sum(CASE WHEN event_type = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{s}"
                           for s in STATUSES)

_PROFILE = f"""
SELECT field, CAST(avg(same) AS DECIMAL(18,6)) AS match_rate, count(*) AS n_docs FROM (
  SELECT 'document_type' AS field, 1.0 AS same FROM doc_src UNION ALL
  SELECT 'invoice_document_number', CASE WHEN doc_key % 3 = 1 THEN 0.0 ELSE 1.0 END FROM doc_src UNION ALL
  SELECT 'invoice_document_date', 1.0 FROM doc_src UNION ALL
  SELECT 'supplier_name', 0.0 FROM doc_src UNION ALL
  SELECT 'supplier_gstin', 1.0 FROM doc_src UNION ALL
  SELECT 'buyer_gstin', 1.0 FROM doc_src UNION ALL
  SELECT 'consignee_gstin', CASE WHEN {TAXID_SUPPLIER} = {TAXID_CUSTOMER} THEN 1.0 ELSE 0.0 END
    FROM doc_src UNION ALL
  SELECT 'total_invoice_value', 1.0 FROM doc_src) u
GROUP BY field"""

_COVERAGE = f"""
SELECT CASE doc_key % 4 WHEN 1 THEN 'Delivery Challan' WHEN 2 THEN 'Stock Transfer' ELSE 'Tax Invoice' END
         AS document_type, count(*) AS n_docs,
  {', '.join(f'CAST({v} AS DECIMAL(18,6)) AS {k}' for k, v in [
      ('invoice_document_number', 1), ('invoice_document_date', 1), ('supplier_name', 0), ('supplier_gstin', 1),
      ('buyer_name', 0), ('buyer_gstin', 1), ('amount_in_words', 1), ('irn_no', 1), ('eway_bill_no', 1)])}
FROM doc_src GROUP BY 1"""

_HEADER_ITEMS = _with(DOC_SRC, ITEM_SRC) + (
        "SELECT i.doc_key, d.inv_no AS invoice_document_number, CASE d.doc_key % 4 WHEN 1 THEN 'Delivery Challan' "
        "WHEN 2 THEN 'Stock Transfer' ELSE 'Tax Invoice' END AS document_type, i.line_number, "
        "'P' || CAST(i.l_partkey AS VARCHAR) || '_' || i.brand AS item_sku_code, i.ext AS line_total_value "
        "FROM item_src i JOIN doc_src d ON i.doc_key = d.doc_key")

ORACLE = {
    "pages_to_text": _with(_CONV_TEXT) + "SELECT doc_key, text FROM conv_text",
    "words_to_text": ("SELECT doc_id AS doc_key, array_to_string(list_transform(string_split(coalesce(text, ''), "
                      "chr(10)), lambda x: x || ' ' || chr(10)), '') AS text FROM documents"),
    "prefer_text": _with(_CONV_TEXT) + _PREFER,
    "first_engine_text": _with(_CONV_TEXT) + (
        "SELECT coalesce(d.doc_id, o.doc_key) AS doc_key, coalesce(nullif(d.text, ''), nullif(o.text, ''), '') "
        "AS text FROM documents d FULL JOIN conv_text o ON d.doc_id = o.doc_key"),
    "admit_documents": _ADMIT,
    "quarantine_documents": _QUARANTINE,
    "status_live": ("SELECT CAST(ts AS DATE) AS job_id, user_id AS file_id, arg_max(event_type, ts) AS status, max(ts) AS last_ts, "
                    "count(*) AS n_events FROM events GROUP BY 1, 2"),
    "job_status_latest": ("SELECT user_id AS file_id, arg_max(event_type, ts) AS status, max(ts) AS last_ts, "
                          "count(*) AS n_events FROM events GROUP BY user_id"),
    "job_summary": (f"SELECT CAST(ts AS DATE) AS job_id, count(DISTINCT user_id) AS n_files, count(*) AS n_events, "
                    f"{_STATUS_COUNTS} FROM events GROUP BY 1"),
    "job_files": ("SELECT CAST(ts AS DATE) AS job_id, user_id AS file_id, arg_max(event_type, ts) AS status, "
                  "count(*) AS n_events FROM events GROUP BY 1, 2"),
    "status_windows": ("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, "
                       "time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, "
                       "count(*) AS n FROM events GROUP BY 1, 2, 3"),
    "bulk_status": _with(DOC_SRC) + (
        "SELECT CAST(doc_key AS VARCHAR) AS file_id, CASE WHEN doc_key % 3 = 2 THEN 'failed' ELSE 'completed' END AS status, "
        "CASE WHEN doc_key % 3 <> 2 THEN 'invoice_level_' || CAST(doc_key AS VARCHAR) || '.csv' END AS invoice_csv, "
        "CASE WHEN doc_key % 3 <> 2 THEN 'item_level_' || CAST(doc_key AS VARCHAR) || '.csv' END AS item_csv, "
        "CASE WHEN doc_key % 3 = 2 THEN 'missing or non-numeric invoice_document_number' END AS error, "
        "CAST(1 AS BIGINT) AS last_seq, CAST(2 AS BIGINT) AS n_events FROM doc_src"),
    "status_json_roundtrip": _with(DOC_SRC) + (
        "SELECT CAST(doc_key AS VARCHAR) AS file_id, s.seq, CASE WHEN s.seq = 0 THEN 'processing' "
        "WHEN doc_key % 3 = 2 THEN 'failed' ELSE 'completed' END AS status, 'regex' AS provider, "
        "CASE WHEN s.seq = 1 AND doc_key % 3 <> 2 THEN 'invoice_level_' || CAST(doc_key AS VARCHAR) || '.csv' END AS invoice_csv, "
        "CASE WHEN s.seq = 1 AND doc_key % 3 = 2 THEN 'missing or non-numeric invoice_document_number' END AS error "
        "FROM doc_src, (SELECT unnest([0, 1])::BIGINT AS seq) s"),
    "stream_extract": EXTRACT_ORACLE["headers_full"],
    "stream_dead_letters": _with(DOC_SRC) + (
        "SELECT doc_key, 'missing or non-numeric invoice_document_number' AS contract_error, "
        "inv_no AS invoice_document_number, false AS still_dead FROM doc_src WHERE doc_key % 3 = 2"),
    "stream_replay_status": _with(DOC_SRC) + (
        "SELECT CAST(doc_key AS VARCHAR) AS file_id, 'completed' AS status, CAST(NULL AS VARCHAR) AS error, "
        "CAST(CASE WHEN doc_key % 3 = 2 THEN 3 ELSE 1 END AS BIGINT) AS last_seq, "
        "CAST(CASE WHEN doc_key % 3 = 2 THEN 4 ELSE 2 END AS BIGINT) AS n_events FROM doc_src"),
    "stream_duplicates": _with(DOC_SRC) + (
        f"SELECT {TAXID_SUPPLIER} AS supplier_gstin, inv_no AS invoice_document_number, CAST(1 AS BIGINT) AS n_dropped "
        "FROM doc_src WHERE doc_key % 3 <> 2 AND doc_key % 7 = 0"),
    "csv_roundtrip": EXTRACT_ORACLE["headers_full"],
    "header_item_join": _HEADER_ITEMS,
    "record_tables": _HEADER_ITEMS,
    "items_per_doc": _with(DOC_SRC) + (
        "SELECT d.doc_key, count(*) AS n_items FROM doc_src d JOIN lineitem l ON l.l_orderkey = d.doc_key "
        "GROUP BY d.doc_key"),
    "first_item": _with(ITEM_SRC) + (
        "SELECT doc_key, line_number, 'P' || CAST(l_partkey AS VARCHAR) || '_' || brand AS item_sku_code, "
        "ext AS line_total_value FROM item_src WHERE line_number = 1"),
    "header_summary": _with(DOC_SRC) + (
        "SELECT doc_key, CASE doc_key % 4 WHEN 1 THEN 'Delivery Challan' WHEN 2 THEN 'Stock Transfer' "
        "ELSE 'Tax Invoice' END AS document_type, inv_no AS invoice_document_number, "
        "strftime(o_orderdate, '%d-%m-%Y') AS invoice_document_date, vendor AS supplier_name, "
        f"client AS buyer_name, {D2('o_totalprice')} AS total_invoice_value FROM doc_src"),
    "contract_check": _with(DOC_SRC) + (
        "SELECT doc_key, doc_key % 3 <> 2 AS contract_ok, "
        "CASE WHEN doc_key % 3 = 2 THEN 'missing or non-numeric invoice_document_number' END AS contract_error FROM doc_src"),
    "hostile_documents": (
        "SELECT kind || '-' || CAST(id AS VARCHAR) AS doc_key, CASE WHEN id % 2 = 0 THEN 'H' || CAST(id AS VARCHAR) ELSE '' END "
        "AS invoice_document_number, id % 2 = 0 AS contract_ok, "
        "CASE WHEN id % 2 <> 0 THEN 'missing or non-numeric invoice_document_number' END AS contract_error "
        "FROM (SELECT 'document' AS kind, doc_id AS id FROM documents UNION ALL SELECT 'page', page_id FROM pages) d"),
    "reconcile": _with(DOC_SRC, ITEM_SRC) + (
        "SELECT d.doc_key, CAST(d.taxable AS DECIMAL(18,2)) AS subtotal, CAST(sum(i.ext) AS DECIMAL(18,2)) "
        "AS items_total, count(*) AS n_items, CAST(sum(i.ext) - d.taxable AS DECIMAL(18,2)) AS difference, "
        "abs(sum(i.ext) - d.taxable) <= 0.005 AS reconciled FROM doc_src d JOIN item_src i ON i.doc_key = d.doc_key "
        "GROUP BY d.doc_key, d.taxable"),
    "coverage": _with(DOC_SRC) + _COVERAGE,
    "dup_numbers": _with(DOC_SRC) + (
        f"SELECT {TAXID_SUPPLIER} AS supplier_gstin, inv_no AS invoice_document_number, CAST(2 AS BIGINT) AS n "
        "FROM doc_src WHERE doc_key % 3 <> 2 AND doc_key % 7 = 0"),
    "spend_rollup": _with(DOC_SRC) + (
        f"SELECT {TAXID_SUPPLIER} AS supplier_gstin, strftime(o_orderdate, '%Y-%m') AS month, "
        f"CAST(GROUPING({TAXID_SUPPLIER}, strftime(o_orderdate, '%Y-%m')) AS BIGINT) AS level, "
        "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total_value, count(*) AS n_docs "
        "FROM doc_src GROUP BY ROLLUP (1, 2)"),
    "profile_agreement": _with(DOC_SRC) + _PROFILE,
}
assert set(ORACLE) == set(QUERIES)
_ = (dec, TAXID_CUSTOMER)
