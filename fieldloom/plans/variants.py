"""Corpus variants: small string edits of the rendered invoices.

Each edit is a literal replacement so Spark and DuckDB produce identical texts;
the DuckDB form of every edit sits next to the Spark form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM_HEADER = "Sr No  Item Code  Description  HSN  Qty  Rate  Amount"
# Fixed values of the variants.
KNOWN_PARTY_LINE = "Jabong Retail India Pvt Ltd Warehouse"
FULL_PARTY_LINE = "Myntra Jabong India Pvt Ltd"
ANCHOR_LINE = "SVS Warehouse Plot 7"


def _rep(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def headerless(df: DataFrame) -> DataFrame:
    """Drop the item header line."""
    return df.select("doc_key", _rep(F.col("text"), ITEM_HEADER + "\n", "").alias("text"))


def colon_parties(df: DataFrame) -> DataFrame:
    """Role word and name on one line: ``Supplier: VENDOR ...``, ``Buyer: CLIENT ...``."""
    t = _rep(F.col("text"), "Supplier\nTrade Name: ", "Supplier: ")
    t = _rep(t, "Bill to\nLegal Name: ", "Buyer: ")
    return df.select("doc_key", t.alias("text"))


def single_space(df: DataFrame) -> DataFrame:
    """Collapse the two-space column separators."""
    return df.select("doc_key", _rep(F.col("text"), "  ", " ").alias("text"))


def known_party(df: DataFrame) -> DataFrame:
    """Insert dictionary party lines (key % 6 = 0 and 3) and an address anchor (key % 4 = 1)."""
    k = F.col("doc_key")
    t = F.col("text")
    t = (F.when(k % 6 == 0, _rep(t, "Bill to\n", f"Bill to\n{KNOWN_PARTY_LINE}\n"))
         .when(k % 6 == 3, _rep(t, "Bill to\n", f"Bill to\n{FULL_PARTY_LINE}\n"))
         .otherwise(t))
    t = F.when(k % 4 == 1, _rep(t, "Supplier\n", f"Supplier\n{ANCHOR_LINE}\n")).otherwise(t)
    return df.select("doc_key", t.alias("text"))


# DuckDB twins (expressions over a column named text and a key doc_key)
SQL = {
    "headerless": f"replace(text, '{ITEM_HEADER}' || chr(10), '')",
    "colon_parties": ("replace(replace(text, 'Supplier' || chr(10) || 'Trade Name: ', 'Supplier: '), "
                      "'Bill to' || chr(10) || 'Legal Name: ', 'Buyer: ')"),
    "single_space": "replace(text, '  ', ' ')",
    "known_party": (
        "CASE WHEN doc_key % 4 = 1 THEN replace(t1, 'Supplier' || chr(10), 'Supplier' || chr(10) || "
        f"'{ANCHOR_LINE}' || chr(10)) ELSE t1 END"),
    "known_party_inner": (
        f"CASE WHEN doc_key % 6 = 0 THEN replace(text, 'Bill to' || chr(10), 'Bill to' || chr(10) || "
        f"'{KNOWN_PARTY_LINE}' || chr(10)) WHEN doc_key % 6 = 3 THEN replace(text, 'Bill to' || chr(10), "
        f"'Bill to' || chr(10) || '{FULL_PARTY_LINE}' || chr(10)) ELSE text END"),
}
