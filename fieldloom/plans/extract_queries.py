"""Registered header / item extraction queries and their DuckDB oracles.

The oracles never run our patterns: they derive the expected field values
from the source columns the invoice was rendered from (``doc_src`` /
``item_src`` CTEs), so they check the extraction end to end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import patterns as P
from fieldloom.functions.contract import HEADER_COLUMNS, ITEM_COLUMNS
from fieldloom.functions.rx import strip, extract, fold
from fieldloom.operators import header as H
from fieldloom.operators.items import extract_items
from fieldloom.operators.parties import known_parties
from fieldloom.plans import variants as V
from fieldloom.plans.common import HEADER_MONEY, ITEM_MONEY, ITEM_TAX_MONEY, dec, decimals, invoices
from fieldloom.plans.oracle_corpus import (INVOICE_CTES, ITEM_ORDER_SQL, TAXID_CUSTOMER, TAXID_SUPPLIER)
from fieldloom.sources.tables import Tables

# --- DuckDB source CTEs ---------------------------------------------------------

DOC_SRC = """
doc_src AS (
  SELECT f.doc_key, f.supp_key, f.total_qty, f.taxable, o.o_custkey, o.o_totalprice, o.o_orderdate,
         c.c_nationkey, c.c_mktsegment, s.s_nationkey,
         'VENDOR ' || printf('%06d', f.supp_key) || ' PRIVATE LIMITED' AS vendor,
         'CLIENT ' || printf('%06d', o.o_custkey) AS client,
         'INV/' || CAST(f.doc_key AS VARCHAR) AS inv_no
  FROM (SELECT l_orderkey AS doc_key, min(l_suppkey) AS supp_key,
               sum(CAST(l_quantity AS BIGINT)) AS total_qty,
               sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS taxable
        FROM lineitem GROUP BY l_orderkey) f
  JOIN orders o ON f.doc_key = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN supplier s ON f.supp_key = s.s_suppkey
)"""

ITEM_SRC = f"""
item_src AS (
  SELECT l.l_orderkey AS doc_key,
         CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY {ITEM_ORDER_SQL}) AS INTEGER) AS line_number,
         l.l_partkey, p.p_name, upper(replace(p.p_brand, '#', '')) AS brand,
         CAST(p.p_retailprice AS DECIMAL(18,2)) AS price,
         CAST(l.l_quantity AS BIGINT) AS qty, CAST(round(l.l_tax * 100) AS BIGINT) AS rate,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS ext
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def D2(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,2))"


# --- Spark side -------------------------------------------------------------------


def _inv(spark, sf):
    return invoices(spark, sf)


def q_doc_type(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return _inv(spark, sf).select(
        "doc_key", H.document_type(t).alias("document_type"),
        H.document_type(t, P.DOC_TYPES_MINIMAL).alias("document_type_minimal"))


def q_doc_type_noise(spark: SparkSession, sf: str) -> DataFrame:
    d = Tables(spark, sf).documents
    t = F.col("text")
    return d.select(F.col("doc_id").alias("doc_key"), H.document_type(t).alias("document_type"),
                    H.document_type(t, P.DOC_TYPES_MINIMAL).alias("document_type_minimal"))


def q_doc_number_simple(spark, sf):
    return _inv(spark, sf).select("doc_key", H.simple_invoice_number(F.col("text")).alias("invoice_document_number"))


def q_doc_number_layout(spark, sf):
    return _inv(spark, sf).select("doc_key", H.layout_invoice_number(F.col("text")).alias("invoice_document_number"))


def q_doc_number_minimal(spark, sf):
    return H.extract_headers(_inv(spark, sf), "minimal").select("doc_key", "invoice_document_number")


def q_doc_date(spark, sf):
    t = F.col("text")
    return _inv(spark, sf).select(
        "doc_key", H.simple_date(t).alias("date_simple"),
        H.first_matching(t, P.LAYOUT_DATE, "i").alias("date_layout"),
        H.first_matching(t, P.MINIMAL_DATE, "i").alias("date_minimal"))


def q_doc_date_noise(spark, sf):
    """H6 unlabelled date over prose: first numeric date anywhere, else ''."""
    d = Tables(spark, sf).documents
    return d.select(F.col("doc_id").alias("doc_key"),
                    H.first_matching(F.col("text"), [P.ANY_DATE], "i").alias("any_date"))


def q_tax_ids(spark, sf):
    t = F.col("text")
    a = _inv(spark, sf).select("doc_key", "text", fold(t).alias("_low"), H.tax_ids_all(t).alias("_ids"), H.first_at(t, "GSTIN").alias("_at"),
                               H.id_after(t, "GSTIN").alias("_id"))
    ids, low = F.col("_ids"), F.col("_low")
    simple, layout = (ids, F.col("_at"), F.col("_id"), low), (ids, F.col("_id"), low)
    return a.select(
        "doc_key",
        H.simple_gstin(t, "supplier", *simple).alias("supplier_gstin_simple"),
        H.simple_gstin(t, "buyer", *simple).alias("buyer_gstin_simple"),
        H.layout_gstin(t, "supplier", *layout).alias("supplier_gstin_layout"),
        H.layout_gstin(t, "buyer", *layout).alias("buyer_gstin_layout"),
        H.layout_gstin(t, "consignee", *layout).alias("consignee_gstin_layout"),
        F.coalesce(F.get(ids, 0), F.lit("")).alias("supplier_gstin_minimal"),
        F.coalesce(F.get(ids, 1), F.lit("")).alias("buyer_gstin_minimal"))


_PARTY_COLS = ["supplier_name", "supplier_address", "buyer_name", "buyer_address", "consignee_name",
               "consignee_gstin", "consignee_address"]


def q_parties_simple(spark, sf):
    return H.extract_headers(_inv(spark, sf), "simple").select("doc_key", *_PARTY_COLS)


def q_parties_layout(spark, sf):
    docs = V.colon_parties(_inv(spark, sf))
    return H.extract_headers(docs, "layout").select(
        "doc_key", "supplier_name", "supplier_address", "buyer_name", "buyer_address", "consignee_name",
        "consignee_address")


def q_parties_minimal(spark, sf):
    docs = V.known_party(_inv(spark, sf))
    return H.extract_headers(docs, "minimal").select(
        "doc_key", "supplier_name", "buyer_name", "supplier_address")


_AMOUNTS = ["total_quantity", "subtotal_taxable_value", "cgst_amount", "sgst_amount", "igst_amount",
            "cess_amount", "total_invoice_value"]


def q_amounts_simple(spark, sf):
    return decimals(H.extract_headers(_inv(spark, sf), "simple").select("doc_key", *_AMOUNTS), _AMOUNTS)


def q_amounts_layout(spark, sf):
    return decimals(H.extract_headers(_inv(spark, sf), "layout").select("doc_key", *_AMOUNTS), _AMOUNTS)


def q_amounts_minimal(spark, sf):
    h = H.extract_headers(_inv(spark, sf), "minimal").select("doc_key", "total_invoice_value")
    return decimals(h, ["total_invoice_value"])


def q_references(spark, sf):
    t = F.col("text")
    return _inv(spark, sf).select(
        "doc_key",
        H.first_value(t, P.IRN, "is").alias("irn_no"),
        H.first_value(t, P.EWAY, "is").alias("eway_bill_no"),
        H.first_nonblank(t, P.SIMPLE_WORDS, "is").alias("words_simple"),
        H.first_value(t, P.LAYOUT_IRN, "").alias("irn_layout"),
        H.layout_amount_in_words(t).alias("words_layout"))


def q_headers_full(spark, sf):
    return decimals(H.extract_headers(_inv(spark, sf), "simple"), HEADER_MONEY)


def q_headers_layout(spark, sf):
    return decimals(H.extract_headers(_inv(spark, sf), "layout"), HEADER_MONEY)


def q_items_simple(spark, sf):
    it = extract_items(_inv(spark, sf), "simple")
    return decimals(decimals(it, ITEM_MONEY), ITEM_TAX_MONEY, 5)


def q_items_layout(spark, sf):
    it = extract_items(_inv(spark, sf), "layout")
    return decimals(it, ITEM_MONEY + ITEM_TAX_MONEY)


def q_items_layout_zip(spark, sf):
    it = extract_items(V.single_space(_inv(spark, sf)), "layout")
    return decimals(it, ITEM_MONEY + ITEM_TAX_MONEY)


def q_items_simple_fallback(spark, sf):
    """I15/I16 on the header-less variant: every fallback row (any line of 10+
    characters with a code-like token and a number), not only item lines."""
    it = extract_items(V.headerless(_inv(spark, sf)), "simple")
    return it.select("doc_key", "line_number", "item_sku_code", dec("quantity").alias("quantity"), "uom",
                     F.col("unit_price").cast("decimal(28,8)").alias("unit_price"),
                     F.col("line_total_value").cast("decimal(28,2)").alias("line_total_value"),
                     "item_description")


def q_headers_minimal(spark, sf):
    return decimals(H.extract_headers(_inv(spark, sf), "minimal"), HEADER_MONEY)


def q_known_parties(spark, sf):
    """H33 over a dictionary of a third of the customers and, listed after them, half of the suppliers."""
    t = Tables(spark, sf)
    name = lambda word, k: F.concat(F.lit(word), F.format_string("%06d", F.col(k)))
    clients = t.customer.where("c_custkey % 3 = 0").select(name("Client ", "c_custkey").alias("name"), F.col("c_custkey").cast("long").alias("rank"))
    vendors = t.supplier.where("s_suppkey % 2 = 0").select(name("Vendor ", "s_suppkey").alias("name"), (F.col("s_suppkey") + (1 << 40)).alias("rank"))
    return known_parties(_inv(spark, sf), clients.unionByName(vendors))


QUERIES = {
    "known_parties": q_known_parties,
    "doc_type": q_doc_type,
    "doc_type_noise": q_doc_type_noise,
    "doc_number_simple": q_doc_number_simple,
    "doc_number_layout": q_doc_number_layout,
    "doc_number_minimal": q_doc_number_minimal,
    "doc_date": q_doc_date,
    "doc_date_noise": q_doc_date_noise,
    "tax_ids": q_tax_ids,
    "parties_simple": q_parties_simple,
    "parties_layout": q_parties_layout,
    "parties_minimal": q_parties_minimal,
    "amounts_simple": q_amounts_simple,
    "amounts_layout": q_amounts_layout,
    "amounts_minimal": q_amounts_minimal,
    "references": q_references,
    "headers_full": q_headers_full,
    "headers_layout": q_headers_layout,
    "items_simple": q_items_simple,
    "items_layout": q_items_layout,
    "items_layout_zip": q_items_layout_zip,
    "items_simple_fallback": q_items_simple_fallback,
    "headers_minimal": q_headers_minimal,
}

# --- DuckDB oracles ---------------------------------------------------------------------

_DT = "CASE doc_key % 4 WHEN 1 THEN 'Delivery Challan' WHEN 2 THEN 'Stock Transfer' ELSE 'Tax Invoice' END"
_DT_MIN = "CASE doc_key % 4 WHEN 1 THEN 'Delivery Challan' ELSE 'Tax Invoice' END"
_DATE = "strftime(o_orderdate, '%d-%m-%Y')"
_SUP_ADDR = "CAST(s_nationkey AS VARCHAR) || ' Mill Road, District ' || CAST(supp_key AS VARCHAR)"
_CUS_ADDR = "CAST(c_nationkey AS VARCHAR) || ' Lake Street'"
_WORDS = "'Rupees ' || lower(c_mktsegment) || ' Only'"


def _amount_cols(prefix: str = "") -> str:
    return f"""{D2('total_qty')} AS total_quantity, {D2('taxable')} AS subtotal_taxable_value,
      {D2('CASE WHEN doc_key % 2 = 0 THEN total_qty * 9 ELSE 0 END')} AS cgst_amount,
      {D2('CASE WHEN doc_key % 2 = 0 THEN total_qty * 9 ELSE 0 END')} AS sgst_amount,
      {D2('CASE WHEN doc_key % 2 = 1 THEN total_qty * 18 ELSE 0 END')} AS igst_amount,
      {D2('CASE WHEN doc_key % 5 = 0 THEN total_qty ELSE 0 END')} AS cess_amount,
      {D2('o_totalprice')} AS total_invoice_value"""


_DOCS_NOISE = """
SELECT doc_id AS doc_key,
  CASE WHEN contains(lower(text), 'tax invoice') THEN 'Tax Invoice'
       WHEN contains(lower(text), 'delivery challan') THEN 'Delivery Challan'
       WHEN contains(lower(text), 'stock transfer') THEN 'Stock Transfer' ELSE 'Tax Invoice' END AS document_type,
  CASE WHEN contains(lower(text), 'tax invoice') THEN 'Tax Invoice'
       WHEN contains(lower(text), 'delivery challan') THEN 'Delivery Challan' ELSE 'Tax Invoice' END
    AS document_type_minimal
FROM documents"""

_HEADERS_FULL = f"""
SELECT doc_key, CAST(doc_key AS VARCHAR) AS serial_number, {_DT} AS document_type,
  inv_no AS invoice_document_number, {_DATE} AS invoice_document_date,
  vendor AS supplier_name, {TAXID_SUPPLIER} AS supplier_gstin, {_SUP_ADDR} AS supplier_address,
  client AS buyer_name, {TAXID_CUSTOMER} AS buyer_gstin, {_CUS_ADDR} AS buyer_address,
  client AS consignee_name, {TAXID_CUSTOMER} AS consignee_gstin, {_CUS_ADDR} AS consignee_address,
  '' AS po_number, '' AS so_number, '' AS str_number, '' AS box_count,
  {_amount_cols()}, {D2('0')} AS additional_charges, 'No' AS reverse_charge,
  sha256(CAST(doc_key AS VARCHAR)) AS irn_no, CAST(100000000000 + doc_key AS VARCHAR) AS eway_bill_no,
  {_WORDS} AS amount_in_words, '' AS additional_remarks
FROM doc_src"""

_HEADERS_LAYOUT = f"""
SELECT doc_key, CAST(doc_key AS VARCHAR) AS serial_number, {_DT} AS document_type,
  CASE WHEN doc_key % 3 = 1 THEN CAST(100000000000 + doc_key AS VARCHAR) ELSE inv_no END
    AS invoice_document_number, {_DATE} AS invoice_document_date,
  '' AS supplier_name, {TAXID_SUPPLIER} AS supplier_gstin, '' AS supplier_address,
  '' AS buyer_name, {TAXID_CUSTOMER} AS buyer_gstin, '' AS buyer_address,
  '' AS consignee_name, {TAXID_SUPPLIER} AS consignee_gstin, '' AS consignee_address,
  '' AS po_number, '' AS so_number, '' AS str_number, '' AS box_count,
  {_amount_cols()}, {D2('0')} AS additional_charges, 'No' AS reverse_charge,
  sha256(CAST(doc_key AS VARCHAR)) AS irn_no, CAST(100000000000 + doc_key AS VARCHAR) AS eway_bill_no,
  {_WORDS} AS amount_in_words, '' AS additional_remarks
FROM doc_src"""

_RATE_TXT = "CAST(CAST(rate AS DOUBLE) AS VARCHAR) || '%'"
_HALF_TXT = "CAST(CAST(rate AS DOUBLE) / 2 AS VARCHAR) || '%'"

_ITEMS_SIMPLE = f"""
SELECT doc_key, CAST(doc_key AS VARCHAR) AS invoice_serial_number, 'INV/' || CAST(doc_key AS VARCHAR)
    AS invoice_number, line_number, '' AS po_identifier,
  'P' || CAST(l_partkey AS VARCHAR) || '_' || brand AS item_sku_code, p_name AS item_description,
  CAST(61000000 + l_partkey AS VARCHAR) AS hsn_code, {D2('qty')} AS quantity, 'PCS' AS uom,
  {D2('qty')} AS unit_price, {D2('0')} AS discount,
  CASE WHEN rate > 0 THEN {_RATE_TXT} ELSE '' END AS tax_rate,
  CASE WHEN rate > 0 AND doc_key % 2 = 0 THEN {_HALF_TXT} ELSE '' END AS cgst_rate,
  CASE WHEN rate > 0 AND doc_key % 2 = 0 THEN {_HALF_TXT} ELSE '' END AS sgst_rate,
  CASE WHEN rate > 0 AND doc_key % 2 = 1 THEN {_RATE_TXT} ELSE '' END AS igst_rate,
  CAST(CASE WHEN rate > 0 AND doc_key % 2 = 0 THEN ext * rate * 0.005 ELSE 0 END AS DECIMAL(18,5)) AS cgst_amount,
  CAST(CASE WHEN rate > 0 AND doc_key % 2 = 0 THEN ext * rate * 0.005 ELSE 0 END AS DECIMAL(18,5)) AS sgst_amount,
  CAST(CASE WHEN rate > 0 AND doc_key % 2 = 1 THEN ext * rate * 0.01 ELSE 0 END AS DECIMAL(18,5)) AS igst_amount,
  ext AS line_total_value
FROM item_src"""


def _items_layout_sql(where: str = "") -> str:
    return f"""
SELECT doc_key, CAST(doc_key AS VARCHAR) AS invoice_serial_number,
  CASE WHEN doc_key % 3 = 1 THEN CAST(100000000000 + doc_key AS VARCHAR) ELSE 'INV/' || CAST(doc_key AS VARCHAR) END
    AS invoice_number, line_number, '' AS po_identifier,
  'P' || CAST(l_partkey AS VARCHAR) || '_' || brand AS item_sku_code, p_name AS item_description,
  CAST(61000000 + l_partkey AS VARCHAR) AS hsn_code, {D2('qty')} AS quantity, 'PCS' AS uom,
  price AS unit_price, {D2('0')} AS discount,
  'GST_' || CAST(rate AS VARCHAR) AS tax_rate, '' AS cgst_rate, '' AS sgst_rate, {_RATE_TXT} AS igst_rate,
  {D2('0')} AS cgst_amount, {D2('0')} AS sgst_amount,
  CAST(CASE WHEN price > 0 AND qty > 0 THEN round_even(price * qty * rate * CAST(0.01 AS DECIMAL(3,2)), 2)
       ELSE 0 END AS DECIMAL(18,2)) AS igst_amount,
  ext AS line_total_value
FROM item_src {where}"""


_ITEMS_ZIP = """
SELECT doc_key, CAST(doc_key AS VARCHAR) AS invoice_serial_number,
  CASE WHEN doc_key % 3 = 1 THEN CAST(100000000000 + doc_key AS VARCHAR) ELSE 'INV/' || CAST(doc_key AS VARCHAR) END
    AS invoice_number, line_number, '' AS po_identifier,
  'P' || CAST(l_partkey AS VARCHAR) || '_' || brand AS item_sku_code, '' AS item_description,
  CAST(61000000 + l_partkey AS VARCHAR) AS hsn_code, CAST(qty AS DECIMAL(18,2)) AS quantity, 'PCS' AS uom,
  CAST(0 AS DECIMAL(18,2)) AS unit_price, CAST(0 AS DECIMAL(18,2)) AS discount,
  'GST_5' AS tax_rate, '' AS cgst_rate, '' AS sgst_rate, '5.00%' AS igst_rate,
  CAST(0 AS DECIMAL(18,2)) AS cgst_amount, CAST(0 AS DECIMAL(18,2)) AS sgst_amount,
  CAST(0 AS DECIMAL(18,2)) AS igst_amount, CAST(0 AS DECIMAL(18,2)) AS line_total_value
FROM item_src"""

_ITEMS_FALLBACK = f"""
SELECT doc_key, line_number,
  CASE WHEN sku0 = '' THEN 'ITEM' || CAST(line_number AS VARCHAR) ELSE sku0 END AS item_sku_code,
  CAST(qty AS DECIMAL(18,2)) AS quantity, CASE WHEN u0 = '' THEN 'PCS' ELSE u0 END AS uom,
  CAST(CAST(CASE WHEN qty > 0 AND total > 0 THEN total / qty ELSE 0.0 END AS VARCHAR) AS DECIMAL(28,8))
    AS unit_price,
  CAST(CAST(total AS VARCHAR) AS DECIMAL(28,2)) AS line_total_value, line AS item_description
FROM (
  SELECT doc_key, line_number, line, sku0, u0,
    CASE WHEN q0 = '' THEN 1.0 ELSE CAST(q0 AS DOUBLE) END AS qty,
    CASE WHEN len(amts) = 0 THEN 0.0 ELSE CAST(replace(amts[-1], ',', '') AS DOUBLE) END AS total
  FROM (
    SELECT doc_key, CAST(row_number() OVER (PARTITION BY doc_key ORDER BY idx) AS INTEGER) AS line_number, line,
      regexp_extract(line, '\\b([A-Z0-9]+(?:[_-][A-Z0-9]+)*)\\b', 1) AS sku0,
      regexp_extract(line, '(?i)\\b(\\d+(?:\\.\\d+)?)\\s*(?:PCS|NOS|EA|KG)\\b', 1) AS q0,
      upper(regexp_extract(line, '(?i)\\b(PCS|NOS|EA|KG)\\b', 1)) AS u0,
      regexp_extract_all(line, '\\b(\\d+(?:,\\d+)*(?:\\.\\d+)?)\\b', 1) AS amts
    FROM (
      SELECT doc_key, idx, trim(line) AS line FROM (
        SELECT doc_key, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS idx
        FROM (SELECT doc_key, {V.SQL["headerless"]} AS text FROM invoices) h) l) t
    WHERE NOT regexp_matches(line, '(?i)(S\\.?No\\.?|Sr\\.?\\s*No\\.?|Item Code|Description)$')
      AND regexp_matches(line, '\\b[A-Z0-9_-]{{6,}}\\b')
      AND (regexp_matches(line, '(?i)\\b\\d+\\s*(?:PCS|NOS|EA|KG)\\b')
           OR regexp_matches(line, '\\b\\d+(?:,\\d+)*(?:\\.\\d+)?\\b'))) r) x"""

_HEADERS_MINIMAL = f"""
SELECT doc_key, CAST(doc_key AS VARCHAR) AS serial_number, {_DT_MIN} AS document_type,
  CASE WHEN doc_key % 3 = 2 THEN '' ELSE inv_no END AS invoice_document_number, {_DATE} AS invoice_document_date,
  CASE WHEN doc_key % 4 = 0 THEN vendor WHEN doc_key % 4 = 1 THEN 'DELIVERY CHALLAN'
       WHEN doc_key % 4 = 2 THEN 'STOCK TRANSFER' ELSE 'STATEMENT' END AS supplier_name,
  {TAXID_SUPPLIER} AS supplier_gstin, '' AS supplier_address, client AS buyer_name,
  {TAXID_CUSTOMER} AS buyer_gstin, '' AS buyer_address, '' AS consignee_name, '' AS consignee_gstin,
  '' AS consignee_address, '' AS po_number, '' AS so_number, '' AS str_number, '' AS box_count,
  {D2('0')} AS total_quantity, {D2('0')} AS subtotal_taxable_value, {D2('0')} AS cgst_amount,
  {D2('0')} AS sgst_amount, {D2('0')} AS igst_amount, {D2('0')} AS cess_amount, {D2('0')} AS additional_charges,
  {D2('o_totalprice')} AS total_invoice_value, 'No' AS reverse_charge, '' AS irn_no, '' AS eway_bill_no,
  '' AS amount_in_words, 'Extracted with fallback method due to Google API failure' AS additional_remarks
FROM doc_src"""

ORACLE = {
    "known_parties": _with(DOC_SRC) + """
SELECT doc_key, lower(CASE WHEN o_custkey % 3 = 0 THEN client ELSE replace(vendor, ' PRIVATE LIMITED', '') END) AS party,
  CASE WHEN o_custkey % 3 = 0 THEN 'Legal Name: ' || client ELSE vendor END AS line
FROM doc_src WHERE o_custkey % 3 = 0 OR supp_key % 2 = 0""",
    "doc_type": _with(DOC_SRC) + f"SELECT doc_key, {_DT} AS document_type, {_DT_MIN} AS document_type_minimal FROM doc_src",
    "doc_type_noise": _DOCS_NOISE,
    "doc_number_simple": _with(DOC_SRC) + "SELECT doc_key, inv_no AS invoice_document_number FROM doc_src",
    "doc_number_layout": _with(DOC_SRC) + (
        "SELECT doc_key, CASE WHEN doc_key % 3 = 1 THEN CAST(100000000000 + doc_key AS VARCHAR) ELSE inv_no END "
        "AS invoice_document_number FROM doc_src"),
    "doc_number_minimal": _with(DOC_SRC) + (
        "SELECT doc_key, CASE WHEN doc_key % 3 = 2 THEN '' ELSE inv_no END AS invoice_document_number FROM doc_src"),
    "doc_date": _with(DOC_SRC) + f"SELECT doc_key, {_DATE} AS date_simple, {_DATE} AS date_layout, "
                                 f"{_DATE} AS date_minimal FROM doc_src",
    "doc_date_noise": ("SELECT doc_id AS doc_key, coalesce(regexp_extract(text, "
                       "'([0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4})', 1), '') AS any_date FROM documents"),
    "tax_ids": _with(DOC_SRC) + f"""SELECT doc_key, {TAXID_SUPPLIER} AS supplier_gstin_simple,
        {TAXID_CUSTOMER} AS buyer_gstin_simple, {TAXID_SUPPLIER} AS supplier_gstin_layout,
        {TAXID_CUSTOMER} AS buyer_gstin_layout, {TAXID_SUPPLIER} AS consignee_gstin_layout,
        {TAXID_SUPPLIER} AS supplier_gstin_minimal, {TAXID_CUSTOMER} AS buyer_gstin_minimal FROM doc_src""",
    "parties_simple": _with(DOC_SRC) + f"""SELECT doc_key, vendor AS supplier_name, {_SUP_ADDR} AS supplier_address,
        client AS buyer_name, {_CUS_ADDR} AS buyer_address, client AS consignee_name,
        {TAXID_CUSTOMER} AS consignee_gstin, {_CUS_ADDR} AS consignee_address FROM doc_src""",
    "parties_layout": _with(DOC_SRC) + f"""SELECT doc_key, vendor AS supplier_name,
        {_SUP_ADDR} || ' Supplier' AS supplier_address, client AS buyer_name,
        {_CUS_ADDR} || ' Customer' AS buyer_address, client AS consignee_name,
        {_CUS_ADDR} || ' Customer' AS consignee_address FROM doc_src""",
    "parties_minimal": _with(DOC_SRC) + f"""SELECT doc_key,
        CASE WHEN doc_key % 4 = 0 THEN vendor WHEN doc_key % 4 = 1 THEN 'DELIVERY CHALLAN'
             WHEN doc_key % 4 = 2 THEN 'STOCK TRANSFER' ELSE 'STATEMENT' END AS supplier_name,
        CASE WHEN doc_key % 6 = 0 THEN '{V.KNOWN_PARTY_LINE}' WHEN doc_key % 6 = 3 THEN '{V.FULL_PARTY_LINE}'
             ELSE client END AS buyer_name,
        CASE WHEN doc_key % 4 = 1 THEN '{V.ANCHOR_LINE} Trade Name: ' || vendor || ' Address: ' || {_SUP_ADDR}
             || ' Supplier GSTIN: ' || {TAXID_SUPPLIER} ELSE '' END AS supplier_address FROM doc_src""",
    "amounts_simple": _with(DOC_SRC) + f"SELECT doc_key, {_amount_cols()} FROM doc_src",
    "amounts_layout": _with(DOC_SRC) + f"SELECT doc_key, {_amount_cols()} FROM doc_src",
    "amounts_minimal": _with(DOC_SRC) + f"SELECT doc_key, {D2('o_totalprice')} AS total_invoice_value FROM doc_src",
    "references": _with(DOC_SRC) + f"""SELECT doc_key, sha256(CAST(doc_key AS VARCHAR)) AS irn_no,
        CAST(100000000000 + doc_key AS VARCHAR) AS eway_bill_no, {_WORDS} AS words_simple,
        sha256(CAST(doc_key AS VARCHAR)) AS irn_layout, {_WORDS} AS words_layout FROM doc_src""",
    "headers_full": _with(DOC_SRC) + _HEADERS_FULL,
    "headers_layout": _with(DOC_SRC) + _HEADERS_LAYOUT,
    "items_simple": _with(ITEM_SRC) + _ITEMS_SIMPLE,
    "items_layout": _with(ITEM_SRC) + _items_layout_sql(),
    "items_layout_zip": _with(ITEM_SRC) + _ITEMS_ZIP,
    "items_simple_fallback": "WITH " + INVOICE_CTES.strip() + "\n" + _ITEMS_FALLBACK,
    "headers_minimal": _with(DOC_SRC) + _HEADERS_MINIMAL,
}

assert set(ORACLE) == set(QUERIES)
_ = (HEADER_COLUMNS, ITEM_COLUMNS, INVOICE_CTES, strip, extract)
