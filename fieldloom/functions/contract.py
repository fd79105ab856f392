"""The two record contracts: header (30 fields) and item (19 fields).

Inside Spark the snake_case names are used; the display names are applied only
by the CSV sink.  Missing values always take the contract default
(``""`` for text, ``0.0`` for numbers, ``"No"`` for reverse charge).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, D, I = T.StringType(), T.DoubleType(), T.IntegerType()

# Field name, display name, type, default, required.
HEADER_FIELDS = [
    ("serial_number", "Serial Number", S, "", True),
    ("document_type", "Document Type", S, "", True),
    ("invoice_document_number", "Invoice/Document Number", S, "", True),
    ("invoice_document_date", "Invoice/Document Date", S, "", True),
    ("supplier_name", "Supplier Name", S, "", True),
    ("supplier_gstin", "Supplier GSTIN", S, "", True),
    ("supplier_address", "Supplier Address", S, "", True),
    ("buyer_name", "Buyer Name", S, "", True),
    ("buyer_gstin", "Buyer GSTIN", S, "", True),
    ("buyer_address", "Buyer Address", S, "", True),
    ("consignee_name", "Consignee Name", S, "", False),
    ("consignee_gstin", "Consignee GSTIN", S, "", False),
    ("consignee_address", "Consignee Address", S, "", False),
    ("po_number", "PO Number", S, "", False),
    ("so_number", "SO Number", S, "", False),
    ("str_number", "STR Number", S, "", False),
    ("box_count", "Box Count", S, "", False),
    ("total_quantity", "Total Quantity", D, 0.0, False),
    ("subtotal_taxable_value", "Subtotal/Taxable Value", D, 0.0, True),
    ("cgst_amount", "CGST Amount", D, 0.0, False),
    ("sgst_amount", "SGST Amount", D, 0.0, False),
    ("igst_amount", "IGST Amount", D, 0.0, False),
    ("cess_amount", "CESS Amount", D, 0.0, False),
    ("additional_charges", "Additional Charges / Round Off", D, 0.0, False),
    ("total_invoice_value", "Total Invoice Value", D, 0.0, True),
    ("reverse_charge", "Reverse Charge", S, "No", False),
    ("irn_no", "IRN No", S, "", False),
    ("eway_bill_no", "E-Way Bill No", S, "", False),
    ("amount_in_words", "Amount in Words", S, "", False),
    ("additional_remarks", "Additional Remarks", S, "", False),
]

ITEM_FIELDS = [
    ("invoice_serial_number", "Invoice Serial Number", S, "", True),
    ("invoice_number", "Invoice Number", S, "", True),
    ("line_number", "Line #", I, 0, True),
    ("po_identifier", "PO Identifier", S, "", False),
    ("item_sku_code", "Item/SKU Code", S, "", False),
    ("item_description", "Item Description", S, "", False),
    ("hsn_code", "HSN Code", S, "", False),
    ("quantity", "Quantity", D, 0.0, True),
    ("uom", "UOM", S, "", False),
    ("unit_price", "Unit Price", D, 0.0, True),
    ("discount", "Discount", D, 0.0, False),
    ("tax_rate", "Tax Rate", S, "", False),
    ("cgst_rate", "CGST Rate", S, "", False),
    ("sgst_rate", "SGST Rate", S, "", False),
    ("igst_rate", "IGST Rate", S, "", False),
    ("cgst_amount", "CGST Amount", D, 0.0, False),
    ("sgst_amount", "SGST Amount", D, 0.0, False),
    ("igst_amount", "IGST Amount", D, 0.0, False),
    ("line_total_value", "Line Total Value", D, 0.0, True),
]

HEADER_COLUMNS = [f[0] for f in HEADER_FIELDS]
ITEM_COLUMNS = [f[0] for f in ITEM_FIELDS]
HEADER_DISPLAY = {f[0]: f[1] for f in HEADER_FIELDS}
ITEM_DISPLAY = {f[0]: f[1] for f in ITEM_FIELDS}

HEADER_SCHEMA = T.StructType([T.StructField(n, t, True) for n, _, t, _, _ in HEADER_FIELDS])
ITEM_SCHEMA = T.StructType([T.StructField(n, t, True) for n, _, t, _, _ in ITEM_FIELDS])


def _conform(df: DataFrame, fields, keep: tuple[str, ...]) -> DataFrame:
    cols: list[Column] = [F.col(k) for k in keep]
    present = set(df.columns)
    for name, _, typ, default, _ in fields:
        if name in present:
            c = F.coalesce(F.col(name).cast(typ), F.lit(default).cast(typ))
        else:
            c = F.lit(default).cast(typ)
        cols.append(c.alias(name))
    return df.select(*cols)


def conform_headers(df: DataFrame, keep: tuple[str, ...] = ("doc_key",)) -> DataFrame:
    """Project to the fixed 30-column header schema; missing/NULL -> default."""
    return _conform(df, HEADER_FIELDS, keep)


def conform_items(df: DataFrame, keep: tuple[str, ...] = ("doc_key",)) -> DataFrame:
    """Project to the fixed 19-column item schema; missing/NULL -> default."""
    return _conform(df, ITEM_FIELDS, keep)


def contract_flags(df: DataFrame, kind: str = "header", only: tuple[str, ...] | None = None) -> DataFrame:
    """Add ``contract_ok`` and ``contract_error`` (first violated rule).

    Required text fields must hold something but white space (the default that
    stands for a missing one is blank), required numbers must be non-NULL and
    finite.  ``only`` limits the test to some of the required fields.  The reference declares these rules but never enforces them.
    """
    fields = HEADER_FIELDS if kind == "header" else ITEM_FIELDS
    checks = []
    for name, _, typ, _, required in fields:
        if not required or (only is not None and name not in only):
            continue
        c = F.col(name)
        if isinstance(typ, T.StringType):
            bad = F.trim(F.coalesce(c, F.lit(""))) == ""
        else:
            bad = c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
        checks.append((bad, name))
    err = F.lit(None).cast("string")
    for bad, name in reversed(checks):
        err = F.when(bad, F.lit(f"missing or non-numeric {name}")).otherwise(err)
    return df.withColumn("contract_error", err).withColumn("contract_ok", F.col("contract_error").isNull())
