"""DuckDB renderings of the corpora, used as CTEs by the oracle SQL.

These produce byte-identical texts to ``fieldloom.sources.corpus`` (checked by
``tests/test_corpus.py``), written independently in DuckDB's dialect:
``printf`` for ``format_string``, ``format('{:,.2f}')`` for ``format_number``,
``strftime`` for ``date_format``, ordered ``string_agg`` for the sorted list.
"""

ITEM_ORDER_SQL = ("l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, "
                  "l_quantity, l_discount, l_tax")


def _taxid(nk: str, key: str) -> str:
    return (f"(printf('%02d', ({nk} + 1)::BIGINT) || "
            f"translate(printf('%05d', {key} % 100000), '0123456789', 'ABCDEFGHIJ') || "
            f"printf('%04d', {key} % 10000) || 'F1Z5')")


# CTE list (without the leading WITH): li_lines, o_facts, inv_parts, invoices
INVOICE_CTES = f"""
li_lines AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_shipdate,
         l.l_quantity, l.l_discount, l.l_tax,
         'P' || CAST(l.l_partkey AS VARCHAR) || '_' || upper(replace(p.p_brand, '#', ''))
         || '  ' || p.p_name
         || '  ' || CAST(61000000 + l.l_partkey AS VARCHAR)
         || '  ' || CAST(CAST(l.l_quantity AS BIGINT) AS VARCHAR) || ' PCS'
         || '  ' || CAST(CAST(p.p_retailprice AS DECIMAL(18,2)) AS VARCHAR)
         || '  ' || CAST(CAST(round(l.l_tax * 100) AS BIGINT) AS VARCHAR) || '%'
         || '  ' || CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS line
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
),
o_facts AS (
  SELECT l_orderkey AS doc_key, min(l_suppkey) AS supp_key,
         sum(CAST(l_quantity AS BIGINT)) AS total_qty,
         sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS taxable,
         string_agg(line, chr(10) ORDER BY {ITEM_ORDER_SQL}) AS item_text
  FROM li_lines GROUP BY l_orderkey
),
inv_parts AS (
  SELECT f.*, o.o_custkey, o.o_totalprice, o.o_orderdate, c.c_nationkey, c.c_mktsegment, s.s_nationkey
  FROM o_facts f JOIN orders o ON f.doc_key = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN supplier s ON f.supp_key = s.s_suppkey
),
invoices AS (
  SELECT doc_key, concat_ws(chr(10),
    CASE doc_key % 4 WHEN 0 THEN 'TAX INVOICE' WHEN 1 THEN 'DELIVERY CHALLAN'
                     WHEN 2 THEN 'STOCK TRANSFER' ELSE 'STATEMENT' END,
    'VENDOR ' || printf('%06d', supp_key) || ' PRIVATE LIMITED',
    CASE doc_key % 3 WHEN 0 THEN 'Invoice No: ' WHEN 1 THEN 'Document No: ' ELSE 'Bill No. : ' END
      || 'INV/' || CAST(doc_key AS VARCHAR),
    'Invoice Date: ' || strftime(o_orderdate, '%d-%m-%Y'),
    'Supplier',
    'Trade Name: VENDOR ' || printf('%06d', supp_key) || ' PRIVATE LIMITED',
    'Address: ' || CAST(s_nationkey AS VARCHAR) || ' Mill Road, District ' || CAST(supp_key AS VARCHAR),
    'Supplier GSTIN: ' || {_taxid('s_nationkey', 'supp_key')},
    '',
    'Bill to',
    'Legal Name: CLIENT ' || printf('%06d', o_custkey),
    'Address: ' || CAST(c_nationkey AS VARCHAR) || ' Lake Street',
    'Customer GSTIN: ' || {_taxid('c_nationkey', 'o_custkey')},
    '',
    'Sr No  Item Code  Description  HSN  Qty  Rate  Amount',
    coalesce(item_text, ''),
    'Total Quantity: ' || CAST(total_qty AS VARCHAR),
    'Taxable Value: ' || format('{{:,.2f}}', taxable),
    CASE WHEN doc_key % 2 = 0 THEN 'CGST: ' || format('{{:,.2f}}', CAST(total_qty * 9 AS DECIMAL(18,2))) END,
    CASE WHEN doc_key % 2 = 0 THEN 'SGST: ' || format('{{:,.2f}}', CAST(total_qty * 9 AS DECIMAL(18,2))) END,
    CASE WHEN doc_key % 2 = 1 THEN 'IGST: ' || format('{{:,.2f}}', CAST(total_qty * 18 AS DECIMAL(18,2))) END,
    CASE WHEN doc_key % 5 = 0 THEN 'CESS: ' || format('{{:,.2f}}', CAST(total_qty AS DECIMAL(18,2))) END,
    'Total Invoice Value: Rs. ' || format('{{:,.2f}}', CAST(o_totalprice AS DECIMAL(18,2))),
    'Amount in Words: Rupees ' || lower(c_mktsegment) || ' Only',
    'IRN: ' || sha256(CAST(doc_key AS VARCHAR)),
    'E-Way Bill No: ' || CAST(100000000000 + doc_key AS VARCHAR)
  ) AS text
  FROM inv_parts
)
"""

# Per-document source facts that oracles compare extracted fields against.
FACT_CTES = """
doc_src AS (
  SELECT f.doc_key, f.supp_key, f.total_qty, f.taxable, o.o_custkey, o.o_totalprice, o.o_orderdate,
         c.c_nationkey, c.c_mktsegment, s.s_nationkey
  FROM (SELECT l_orderkey AS doc_key, min(l_suppkey) AS supp_key,
               sum(CAST(l_quantity AS BIGINT)) AS total_qty,
               sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS taxable
        FROM lineitem GROUP BY l_orderkey) f
  JOIN orders o ON f.doc_key = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN supplier s ON f.supp_key = s.s_suppkey
)
"""

TAXID_SUPPLIER = _taxid("s_nationkey", "supp_key")
TAXID_CUSTOMER = _taxid("c_nationkey", "o_custkey")


def with_invoices(select_sql: str, extra_ctes: str = "") -> str:
    """``WITH <invoice CTEs>[, extra] <select>``."""
    ctes = INVOICE_CTES.strip()
    if extra_ctes.strip():
        ctes += ",\n" + extra_ctes.strip()
    return f"WITH {ctes}\n{select_sql}"


def with_facts(select_sql: str, extra_ctes: str = "") -> str:
    ctes = FACT_CTES.strip()
    if extra_ctes.strip():
        ctes += ",\n" + extra_ctes.strip()
    return f"WITH {ctes}\n{select_sql}"
