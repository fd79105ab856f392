"""Relational operators over the two record tables (R1-R5) and corpus-level
additions (X1-X5).

Header and item tables are both keyed by ``doc_key``; joins on it are
sort-merge (or broadcast when AQE measures one side small) and aggregations
are partially aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.contract import HEADER_COLUMNS, contract_flags


def records(docs: DataFrame, header_profile: str = "simple", item_profile: str = "layout",
            header_fields: list[str] | None = None) -> DataFrame:
    """Headers and items from ONE pass over the documents.

    The header fields ride along as a struct column ``header`` while the items
    are generated from the same text; a document without items keeps one row
    (``has_item`` false, item fields NULL).  Relations below then need no join
    and at most one aggregation (partial aggregation already reduces each
    document to one row inside the task that produced it).  ``header_fields``
    limits the carried header fields; the others are pruned by Catalyst and
    never computed.
    """
    from fieldloom.operators.header import extract_headers
    from fieldloom.operators.items import extract_items
    h = extract_headers(docs, header_profile, keep=("text",))
    fields = HEADER_COLUMNS if header_fields is None else header_fields
    if not fields:
        return extract_items(docs, item_profile, outer=True)
    h = h.select("doc_key", "text", F.struct(*fields).alias("header"))
    return extract_items(h, item_profile, keep=("header",), outer=True)


def header_item_rows(rec: DataFrame) -> DataFrame:
    """R1 from :func:`records`: left-join semantics without a join."""
    return rec.select("doc_key", "header.invoice_document_number", "header.document_type", "line_number",
                      "item_sku_code", "line_total_value")


def document_records(docs: DataFrame, header_profile: str = "simple", header_fields: list[str] | None = None) -> DataFrame:
    """``doc_key``, ``header`` and ``items``: one row per document with its layout items as an array.

    For relations within a document: they read the array, where exploded items would be shuffled
    back together by key.  ``header_fields`` as in :func:`records`.
    """
    from fieldloom.operators.header import extract_headers
    from fieldloom.operators.items import layout_item_arrays
    fields = HEADER_COLUMNS if header_fields is None else header_fields
    if not fields:
        return layout_item_arrays(docs)
    h = extract_headers(docs, header_profile, keep=("text",))
    return layout_item_arrays(h.select("doc_key", "text", F.struct(*fields).alias("header")), keep=("header",))


def item_counts(rec: DataFrame) -> DataFrame:
    """R2 from :func:`document_records`."""
    return rec.select("doc_key", F.size("items").cast("bigint").alias("n_items"))


def first_item_of(rec: DataFrame) -> DataFrame:
    """R3 from :func:`document_records`: items stand in the order of their line numbers.

    An outer generator, as a filter on the item itself would move below the projection and build the array again."""
    f = rec.select("doc_key", F.explode_outer(F.slice("items", 1, 1)).alias("f")).where(F.col("f").isNotNull())
    return f.select("doc_key", "f.line_number", "f.item_sku_code", "f.line_total_value")


def reconcile_records(rec: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """X1 from :func:`document_records`: no join, no aggregation."""
    # amounts come from texts: one that doesn't fit is NULL, not the end of the job
    zero = F.lit(0).cast("decimal(37,2)")
    added = lambda total, x: F.coalesce(F.try_add(total, F.coalesce(x["line_total_value"].try_cast("decimal(28,2)"), zero)).try_cast("decimal(37,2)"), total)
    a = rec.select("doc_key", F.col("header.subtotal_taxable_value").try_cast("decimal(28,2)").alias("subtotal"),
                   F.aggregate("items", zero, added).alias("items_total"), F.size("items").cast("bigint").alias("n_items"))
    diff = F.try_subtract(F.col("items_total"), F.col("subtotal")).try_cast("decimal(38,2)")
    return a.select("doc_key", "subtotal", "items_total", "n_items", diff.alias("difference"),
                    (F.abs(diff) <= F.lit(tolerance)).alias("reconciled"))


def first_item(items: DataFrame) -> DataFrame:
    """The item with the lowest line number per document (``min_by``)."""
    s = F.struct("line_number", "item_sku_code", "line_total_value")
    f = items.groupBy("doc_key").agg(F.min_by(s, F.col("line_number")).alias("f"))
    return f.select("doc_key", "f.line_number", "f.item_sku_code", "f.line_total_value")


SUMMARY_FIELDS = ["document_type", "invoice_document_number", "invoice_document_date", "supplier_name",
                  "buyer_name", "total_invoice_value"]


def header_summary(headers: DataFrame) -> DataFrame:
    """The six-field projection printed by every parser script."""
    return headers.select("doc_key", *SUMMARY_FIELDS)


def contract_check(records: DataFrame, kind: str = "header", fields: tuple[str, ...] | None = None) -> DataFrame:
    """``contract_ok`` / ``contract_error`` per record; ``fields``: the required ones to look at."""
    return contract_flags(records, kind, fields)


COVERAGE_FIELDS = ["invoice_document_number", "invoice_document_date", "supplier_name", "supplier_gstin",
                   "buyer_name", "buyer_gstin", "amount_in_words", "irn_no", "eway_bill_no"]


def coverage(headers: DataFrame, fields: list[str] = COVERAGE_FIELDS) -> DataFrame:
    """Share of non-blank values per field and document type."""
    aggs = [F.avg((F.coalesce(F.col(f), F.lit("")) != "").cast("double")).cast("decimal(18,6)").alias(f)
            for f in fields]
    return headers.groupBy("document_type").agg(F.count("*").alias("n_docs"), *aggs)


def duplicate_numbers(headers: DataFrame) -> DataFrame:
    """Document numbers used more than once by the same supplier; blank and
    default numbers are no numbers."""
    number = F.trim(F.coalesce(F.col("invoice_document_number"), F.lit("")))
    return (headers.where((number != "") & (number != "UNKNOWN")).groupBy("supplier_gstin", "invoice_document_number").agg(F.count("*").alias("n"))
            .where(F.col("n") > 1))


def spend_rollup(headers: DataFrame, date_format: str = "dd-MM-yyyy") -> DataFrame:
    """Total value by supplier and month with subtotals (``rollup``); ``level``
    (``grouping_id``) tells a subtotal from an unreadable date."""
    d = F.try_to_date(F.col("invoice_document_date"), date_format)
    h = headers.select("supplier_gstin", F.date_format(d, "yyyy-MM").alias("month"),
                       F.col("total_invoice_value").try_cast("decimal(28,2)").alias("v"))
    return h.rollup("supplier_gstin", "month").agg(
        F.grouping_id().cast("bigint").alias("level"), F.sum("v").cast("decimal(38,2)").alias("total_value"),
        F.count("*").alias("n_docs"))


AGREEMENT_FIELDS = ["document_type", "invoice_document_number", "invoice_document_date", "supplier_name",
                    "supplier_gstin", "buyer_gstin", "consignee_gstin", "total_invoice_value"]


def profile_agreement(docs: DataFrame, profile_a: str = "simple", profile_b: str = "layout",
                      fields: list[str] = AGREEMENT_FIELDS) -> DataFrame:
    """Per field, the share of documents where two profiles agree.

    Both profiles run over one scan: the first profile's fields ride along as
    a struct while the second profile is computed (no self join), then one
    ``stack`` unpivots the per-field flags before a tiny aggregation.
    """
    from fieldloom.operators.header import extract_headers
    a = extract_headers(docs, profile_a, keep=("text",))
    a = a.select("doc_key", "text", F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("_a"))
    b = extract_headers(a, profile_b, keep=("_a",))
    stack = "stack({n}, {args}) as (field, same)".format(
        n=len(fields), args=", ".join(f"'{f}', _a.{f} <=> CAST({f} AS STRING)" for f in fields))
    return (b.selectExpr(stack).groupBy("field")
            .agg(F.avg(F.col("same").cast("double")).cast("decimal(18,6)").alias("match_rate"),
                 F.count("*").alias("n_docs")))
