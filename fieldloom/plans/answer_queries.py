"""Registered queries over chunked and failing model answers, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import patterns as P
from fieldloom.operators import model_io as M
from fieldloom.plans.common import decimals
from fieldloom.plans.extract_queries import D2, DOC_SRC, ITEM_SRC, _with
from fieldloom.plans.oracle_corpus import INVOICE_CTES, TAXID_SUPPLIER
from fieldloom.sources import answers as A
from fieldloom.sources.corpus import render_invoices
from fieldloom.sources.tables import Tables

HEADER = ["doc_key", "document_type", "invoice_document_number", "supplier_gstin", "buyer_name", "total_invoice_value", "additional_remarks"]


def _headers(h: DataFrame) -> DataFrame:
    return decimals(h.select(*HEADER, M.fallback_used(F.col("additional_remarks")).alias("fallback_used")), ["total_invoice_value"])


def _chunked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = Tables(spark, sf)
    requests = A.chunk_requests(t)
    return render_invoices(t), requests, A.render_chunk_responses(t, requests)


def q_model_chunk_headers(spark, sf):
    docs, _, responses = _chunked(spark, sf)
    return _headers(M.route_headers(docs, responses))


def q_model_chunk_items(spark, sf):
    docs, _, responses = _chunked(spark, sf)
    it = M.route_items(docs, responses)
    return decimals(it.select("doc_key", "invoice_number", "line_number", "item_sku_code", "quantity", "line_total_value"),
                    ["quantity", "line_total_value"])


def q_model_chunks_missing(spark, sf):
    _, requests, responses = _chunked(spark, sf)
    return M.missing_chunks(requests, responses)


def q_model_failures(spark, sf):
    return M.unwrap(A.render_failing_responses(Tables(spark, sf))).select("doc_key", "provider", F.col("answer").isNotNull().alias("answer_ok"), "error")


def q_model_failure_headers(spark, sf):
    t = Tables(spark, sf)
    return _headers(M.route_headers(A.failing_documents(t), A.render_failing_responses(t)))


def q_model_failure_items(spark, sf):
    t = Tables(spark, sf)
    it = M.route_items(A.failing_documents(t), A.render_failing_responses(t))
    return decimals(it.select("doc_key", "invoice_number", "line_number", "item_sku_code", "quantity", "line_total_value"),
                    ["quantity", "line_total_value"])


QUERIES = {
    "model_chunk_headers": q_model_chunk_headers,
    "model_chunk_items": q_model_chunk_items,
    "model_chunks_missing": q_model_chunks_missing,
    "model_failures": q_model_failures,
    "model_failure_headers": q_model_failure_headers,
    "model_failure_items": q_model_failure_items,
}

_PROVIDER = "CASE WHEN doc_key % 2 = 0 THEN 'google' ELSE 'openai' END"
_CAPITAL = "CASE WHEN doc_key % 2 = 0 THEN 'Google' ELSE 'Openai' END"
_CHUNKS = f"""
chunks AS MATERIALIZED (
  SELECT doc_key, n, unnest(range(n)) AS c FROM (
    SELECT doc_key, CASE WHEN doc_key % 2 = 0 THEN (length(text) + {A.CHUNK_LIMITS['google'] - 1}) // {A.CHUNK_LIMITS['google']}
      ELSE (length(text) + {A.CHUNK_LIMITS['openai'] - 1}) // {A.CHUNK_LIMITS['openai']} END AS n FROM invoices)),
state AS MATERIALIZED (
  SELECT *, CASE WHEN doc_key % 13 = 5 AND c = 1 THEN 'no response'
                 WHEN doc_key % 17 = 3 OR (doc_key % 13 = 6 AND c = n - 1) THEN 'API error: 500 - ' END AS reason FROM chunks),
per_doc AS MATERIALIZED (
  SELECT doc_key, any_value(n) AS n, count(*) FILTER (WHERE reason IS NULL) AS usable,
         bool_or(reason IS NULL AND c = 1) AS second, bool_or(reason IS NULL AND c = n - 1) AS last,
         string_agg(c::VARCHAR, ', ' ORDER BY c) FILTER (WHERE reason IS NOT NULL) AS missing FROM state GROUP BY doc_key)"""
_NUMBER = "CASE WHEN second THEN 'INV/' || doc_key WHEN last THEN 'OTHER/' || doc_key ELSE '' END"
# what the regex fallback reads from a rendered invoice
_FALLBACK = {"type": "CASE doc_key % 4 WHEN 1 THEN 'Delivery Challan' ELSE 'Tax Invoice' END",
             "number": "CASE WHEN doc_key % 3 = 2 THEN '' ELSE inv_no END", "id": TAXID_SUPPLIER}


def _routed(ok: str, number: str, buyer: str, total: str, remark: str, source: str, provider: str = _CAPITAL, empty: str = "false", plain: str = "false") -> str:
    """The routed header: of the answer where ``ok``, of the fallback elsewhere; empty texts have neither."""
    def pick(answer: str, fallback: str, blank: str) -> str:
        return f"CASE WHEN {empty} THEN {blank} WHEN {ok} THEN {answer} ELSE {fallback} END"
    return f"""
SELECT doc_key, {pick("'Tax Invoice'", _FALLBACK['type'], "'Tax Invoice'")} AS document_type,
  {pick(number, _FALLBACK['number'], "''")} AS invoice_document_number, {pick("''", _FALLBACK['id'], "''")} AS supplier_gstin,
  {pick(buyer, 'client', "''")} AS buyer_name, {D2(pick(total, 'o_totalprice', '0'))} AS total_invoice_value,
  {pick(remark, f"'Extracted with fallback method due to ' || {provider} || ' API failure'", f"'{P.EMPTY_TEXT_REMARK}'")} AS additional_remarks,
  NOT ({empty}) AND NOT ({ok}) AS fallback_used
FROM {source}"""


_KIND = f"doc_key % {A.FAILURES}"
_EMPTY = "doc_key % 12 = 6"
_ITEM_COLUMNS = "doc_key, {number} AS invoice_number, {line} AS line_number, 'P' || l_partkey AS item_sku_code, " \
                f"{D2('qty')} AS quantity, ext AS line_total_value"
ORACLE = {
    "model_chunk_headers": _with(INVOICE_CTES, DOC_SRC, _CHUNKS) + _routed(
        "usable > 0", _NUMBER, "CASE WHEN second THEN 'CLIENT ' || doc_key ELSE '' END", "CASE WHEN last THEN o_totalprice ELSE 0 END",
        f"'Extracted with ' || {_CAPITAL} || ' LLM' || coalesce('{M.REMARK_MISSING}' || missing, '')", "doc_src JOIN per_doc USING (doc_key)"),
    "model_chunk_items": _with(INVOICE_CTES, ITEM_SRC, _CHUNKS, """
placed AS (SELECT i.*, (i.line_number - 1) * d.n // count(*) OVER (PARTITION BY i.doc_key) AS c, d.second, d.last FROM item_src i JOIN per_doc d USING (doc_key))""") +
        f"SELECT {_ITEM_COLUMNS.format(number=_NUMBER, line='CAST(row_number() OVER (PARTITION BY doc_key ORDER BY line_number) AS INTEGER)')} "
        "FROM placed JOIN state USING (doc_key, c) WHERE reason IS NULL",
    "model_chunks_missing": _with(INVOICE_CTES, _CHUNKS) +
        "SELECT doc_key, c::INT AS chunk_no, n::INT AS n_chunks, reason FROM state WHERE reason IS NOT NULL",
    "model_failures": _with(DOC_SRC) + f"""
SELECT doc_key, CASE WHEN {_KIND} = 4 THEN 'mistral' ELSE {_PROVIDER} END AS provider, {_KIND} IN (0, 5, 6, 8) AS answer_ok,
  CASE {_KIND} WHEN 1 THEN 'API error: 500 - overloaded' WHEN 2 THEN 'API error: 504 - ' WHEN 3 THEN 'no table found'
    WHEN 4 THEN '{M.ERR_PROVIDER}mistral' WHEN 7 THEN '{M.ERR_OBJECT}'
    WHEN 10 THEN 'API error: none - no status' WHEN 11 THEN CASE WHEN doc_key % 2 = 0 THEN '{M.ERR_FORMAT['google']}' ELSE '{M.ERR_FORMAT['openai']}' END END AS error
FROM doc_src WHERE {_KIND} <> 9""",
    "model_failure_headers": _with(DOC_SRC) + _routed(
        f"{_KIND} IN (0, 5, 6, 8)", f"CASE WHEN {_KIND} = 8 THEN '' ELSE inv_no END", "''", f"CASE WHEN {_KIND} = 8 THEN 0 ELSE o_totalprice END",
        f"CASE WHEN {_KIND} = 8 THEN '{M.ERR_NORMALISE.replace(chr(39), chr(39) * 2)}' ELSE 'Extracted with ' || {_CAPITAL} || ' LLM' END", "doc_src",
        provider=f"CASE WHEN {_KIND} = 9 THEN '' WHEN {_KIND} = 4 THEN 'Mistral' ELSE {_CAPITAL} END", empty=_EMPTY),
    "model_failure_items": _with(ITEM_SRC) + f"SELECT {_ITEM_COLUMNS.format(number=chr(39) + 'INV/' + chr(39) + ' || doc_key', line='line_number')} "
        f"FROM item_src WHERE {_KIND} = 0",
}
assert set(ORACLE) == set(QUERIES)
