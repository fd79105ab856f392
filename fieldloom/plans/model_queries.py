"""Registered model request / response queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import model_io as M
from fieldloom.plans.common import HEADER_MONEY, ITEM_MONEY, ITEM_TAX_MONEY, decimals
from fieldloom.plans.extract_queries import D2, DOC_SRC, ITEM_SRC, _with
from fieldloom.sources.corpus import PROVIDERS, render_invoices, render_responses
from fieldloom.sources.tables import Tables


def _responses(spark, sf):
    return render_responses(Tables(spark, sf))


def q_model_requests(spark: SparkSession, sf: str) -> DataFrame:
    """M1-M3 over the prose corpus: provider by key parity; whole texts, in chunks by provider."""
    d = Tables(spark, sf).documents
    docs = d.select(F.col("doc_id").alias("doc_key"), "text",
                    F.element_at(F.array(*[F.lit(p) for p in PROVIDERS]), (F.col("doc_id") % 2 + 1).cast("int"))
                    .alias("provider"))
    return M.build_requests(docs).select("doc_key", "provider", "chunk_no", "n_chunks", "request")


def q_model_unwrap(spark, sf):
    u = M.unwrap(_responses(spark, sf))
    return u.select("doc_key", "provider", F.col("error").isNull().alias("answer_ok"),
                    F.get_json_object("answer", "$.invoice_data['Invoice Number']").alias("invoice_number"))


def q_model_headers(spark, sf):
    u = M.unwrap(_responses(spark, sf)).where(F.col("error").isNull())
    return decimals(M.normalise_headers(u), HEADER_MONEY)


def q_model_items(spark, sf):
    u = M.unwrap(_responses(spark, sf))
    u = u.select("doc_key", "provider", F.when(F.col("error").isNull(), F.col("answer")).alias("answer"))
    return decimals(M.normalise_items(u), ITEM_MONEY + ITEM_TAX_MONEY)


def q_model_or_fallback(spark, sf):
    t = Tables(spark, sf)
    h = M.route_headers(render_invoices(t), render_responses(t))
    return decimals(h.select("doc_key", "document_type", "invoice_document_number", "supplier_name",
                             "buyer_name", "supplier_gstin", "total_invoice_value", "additional_remarks",
                             M.fallback_used(F.col("additional_remarks")).alias("fallback_used")),
                    ["total_invoice_value"])


def q_model_items_routed(spark, sf):
    t = Tables(spark, sf)
    it = M.route_items(render_invoices(t), render_responses(t))
    return it.groupBy("doc_key").agg(F.count("*").alias("n_items"),
                                     F.sum(F.col("line_total_value").cast("decimal(18,2)")).cast("decimal(18,2)")
                                     .alias("items_total"))


QUERIES = {
    "model_requests": q_model_requests,
    "model_unwrap": q_model_unwrap,
    "model_headers": q_model_headers,
    "model_items": q_model_items,
    "model_or_fallback": q_model_or_fallback,
    "model_items_routed": q_model_items_routed,
}


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_OK = "NOT (doc_key % 11 = 0 OR (doc_key % 7 = 1 AND doc_key % 2 = 0))"
_PROV = "CASE WHEN doc_key % 2 = 0 THEN 'google' ELSE 'openai' END"
_PROV_CAP = "CASE WHEN doc_key % 2 = 0 THEN 'Google' ELSE 'Openai' END"

_MODEL_HEADERS = f"""
SELECT doc_key, CAST(doc_key AS VARCHAR) AS serial_number, 'Tax Invoice' AS document_type,
  inv_no AS invoice_document_number, '' AS invoice_document_date, '' AS supplier_name, '' AS supplier_gstin,
  '' AS supplier_address, '' AS buyer_name, '' AS buyer_gstin, '' AS buyer_address, '' AS consignee_name,
  '' AS consignee_gstin, '' AS consignee_address, '' AS po_number, '' AS so_number, '' AS str_number,
  '' AS box_count, {D2('0')} AS total_quantity, {D2('0')} AS subtotal_taxable_value, {D2('0')} AS cgst_amount,
  {D2('0')} AS sgst_amount, {D2('0')} AS igst_amount, {D2('0')} AS cess_amount, {D2('0')} AS additional_charges,
  {D2('CASE WHEN doc_key % 3 = 2 THEN 0 ELSE o_totalprice END')} AS total_invoice_value,
  'No' AS reverse_charge, '' AS irn_no, '' AS eway_bill_no, '' AS amount_in_words,
  'Extracted with ' || {_PROV_CAP} || ' LLM' AS additional_remarks
FROM doc_src WHERE {_OK}"""

_MODEL_ITEMS = f"""
SELECT doc_key, CAST(doc_key AS VARCHAR) AS invoice_serial_number, 'INV/' || CAST(doc_key AS VARCHAR)
    AS invoice_number, line_number, '' AS po_identifier, 'P' || CAST(l_partkey AS VARCHAR) AS item_sku_code,
  '' AS item_description, '' AS hsn_code, {D2('qty')} AS quantity, '' AS uom, {D2('0')} AS unit_price,
  {D2('0')} AS discount, '' AS tax_rate, '' AS cgst_rate, '' AS sgst_rate, '' AS igst_rate,
  {D2('0')} AS cgst_amount, {D2('0')} AS sgst_amount, {D2('0')} AS igst_amount, ext AS line_total_value
FROM item_src WHERE {_OK}"""

_MODEL_ROUTED = f"""
SELECT doc_key,
  CASE WHEN {_OK} THEN 'Tax Invoice'
       ELSE CASE doc_key % 4 WHEN 1 THEN 'Delivery Challan' ELSE 'Tax Invoice' END END AS document_type,
  CASE WHEN {_OK} THEN inv_no WHEN doc_key % 3 = 2 THEN '' ELSE inv_no END AS invoice_document_number,
  CASE WHEN {_OK} THEN '' WHEN doc_key % 4 = 0 THEN vendor WHEN doc_key % 4 = 1 THEN 'DELIVERY CHALLAN'
       WHEN doc_key % 4 = 2 THEN 'STOCK TRANSFER' ELSE 'STATEMENT' END AS supplier_name,
  CASE WHEN {_OK} THEN '' ELSE client END AS buyer_name,
  CASE WHEN {_OK} THEN '' ELSE {{taxid}} END AS supplier_gstin,
  {D2(f'CASE WHEN {_OK} AND doc_key % 3 = 2 THEN 0 ELSE o_totalprice END')} AS total_invoice_value,
  CASE WHEN {_OK} THEN 'Extracted with ' || {_PROV_CAP} || ' LLM'
       ELSE 'Extracted with fallback method due to ' || {_PROV_CAP} || ' API failure' END AS additional_remarks,
  NOT ({_OK}) AS fallback_used
FROM doc_src"""

ORACLE = {
    "model_requests": (
        f"WITH d AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 10000 ELSE 8000 END AS lim FROM documents), "
        f"c AS (SELECT *, greatest(1, (length(coalesce(text, '')) + lim - 1) // lim)::INT AS n FROM d), "
        f"e AS (SELECT *, unnest(range(n)) AS i FROM c) "
        f"SELECT doc_id AS doc_key, CASE WHEN doc_id % 2 = 0 THEN 'google' ELSE 'openai' END AS provider, "
        f"i::INT AS chunk_no, n AS n_chunks, {_sql_str(M.REQUEST_PREFIX)} || substring(coalesce(text, ''), i * lim + 1, lim) "
        f"|| {_sql_str(M.REQUEST_SUFFIX)} AS request FROM e"),
    "model_unwrap": _with(DOC_SRC) + (
        f"SELECT doc_key, {_PROV} AS provider, {_OK} AS answer_ok, "
        f"CASE WHEN {_OK} THEN inv_no END AS invoice_number FROM doc_src"),
    "model_headers": _with(DOC_SRC) + _MODEL_HEADERS,
    "model_items": _with(ITEM_SRC) + _MODEL_ITEMS,
    "model_or_fallback": None,  # filled below (needs the tax id expression)
    "model_items_routed": _with(ITEM_SRC) + (
        f"SELECT doc_key, count(*) AS n_items, CAST(sum(ext) AS DECIMAL(18,2)) AS items_total "
        f"FROM item_src WHERE {_OK} GROUP BY doc_key"),
}
from fieldloom.plans.oracle_corpus import TAXID_SUPPLIER  # noqa: E402

ORACLE["model_or_fallback"] = _with(DOC_SRC) + _MODEL_ROUTED.replace("{taxid}", TAXID_SUPPLIER)
assert set(ORACLE) == set(QUERIES)
