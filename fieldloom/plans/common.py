"""Shared pieces of the registered queries: corpus access and output typing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.sources.corpus import render_invoices
from fieldloom.sources.tables import Tables


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered invoice corpus of one scale directory."""
    return render_invoices(Tables(spark, sf_dir))


def dec(c: Column | str, scale: int = 2) -> Column:
    """Money / quantity output type: exact decimals, so value hashes do not
    depend on the last bits of a double."""
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast(f"decimal(18,{scale})")


def decimals(df: DataFrame, cols: list[str], scale: int = 2) -> DataFrame:
    return df.select(*[dec(c, scale).alias(c) if c in cols else F.col(c) for c in df.columns])


HEADER_MONEY = ["total_quantity", "subtotal_taxable_value", "cgst_amount", "sgst_amount", "igst_amount",
                "cess_amount", "additional_charges", "total_invoice_value"]
ITEM_MONEY = ["quantity", "unit_price", "discount", "line_total_value"]
ITEM_TAX_MONEY = ["cgst_amount", "sgst_amount", "igst_amount"]
