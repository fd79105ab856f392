"""Line-item operators (row generation) for the regex profiles.

``extract_items(docs, profile)`` maps ``(doc_key, text)`` to ``doc_key`` plus
the 19 item fields, one row per item.

Plan: one narrow stage, no shuffle.  Per document the candidate lines are an
array; the validity of each row is decided inside the array with
higher-order functions, the fallback array is chosen with ``CASE WHEN
size(primary) = 0`` (no anti join, no aggregation), and a single
``posexplode`` emits the rows.  Per-row fields are then plain column
expressions on the exploded rows.

A plain ``explode`` makes Spark infer ``size(rows) > 0`` and push it below the
projection, evaluating the whole row-array expression (section regex, line
filters, per-line parsing) again and again inside its lambdas; so the outer
generator is used, with a NULL filter above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import patterns as P
from fieldloom.functions.contract import conform_items
from fieldloom.functions.rx import (MOST, WS, _to_double, bound, digits_to_double, extract, filled, fold, has_any, matches, one_of, py, strip)
from fieldloom.operators.header import layout_invoice_number, serial_number, simple_invoice_number

# Section start keywords, header-line tests, units, fallbacks.
ITEM_KEYWORDS = r"S\.?No\.?|Sr\.?\s*No\.?|Item Code|HSN|Description|Qty|Rate|Amount"
SECTION_END = r"Total|Grand Total|Sub Total"
# from the first keyword only: if no end follows it, none follows a later one
SIMPLE_SECTION = rf"\A(?>.*?(?={ITEM_KEYWORDS}))(.*?)(?={SECTION_END})"
SIMPLE_HEADER_LINE = rf"({ITEM_KEYWORDS})$"
# the keywords in a folded text: plain words, and patterns that need the word "no"
PLAIN_KEYWORDS = ["item code", "hsn", "description", "qty", "rate", "amount"]
NO_KEYWORDS = r"s\.?no|sr\.?\s*no"
KEYWORDS_FOLDED = one_of([r"s\.?no\.?", r"sr\.?\s*no\.?", *PLAIN_KEYWORDS])
DETAILS_FOLDED = r"item\s*details"
UOM7 = "PCS|EA|NOS|KG|GM|MT|LT"
UOM4 = "PCS|NOS|EA|KG"
UOM3 = "PCS|EA|NOS"
SKU_SIMPLE = r"\b([A-Z0-9]+(?:_[A-Z0-9]+)*)\b"
HSN_SIMPLE = r"\b(\d{4,8})\b"
QTY_SIMPLE = rf"\b(\d+(?:\.\d+)?)\s*(?:{UOM7})\b"
UOM_SIMPLE = rf"\b({UOM7})\b"
PRICE_SIMPLE = rf"\b({P.NUM_STRICT})\s*(?=\s*\b(?:PER|{UOM7})\b)"
TOTAL_AT_END = rf"\b((?>{P.NUM_STRICT}))\s*$"  # no shorter number can end the line
PERCENT = r"(?<!\d)(\d++(?:\.\d++)?+)%"  # tried once per run of digits: from inside a run nothing else matches
FALLBACK_SKIP = r"(S\.?No\.?|Sr\.?\s*No\.?|Item Code|Description)$"
FALLBACK_CODE = r"\b[A-Z0-9_-]{6,}\b"
FALLBACK_QTY_UNIT = rf"\b\d+\s*(?:{UOM4})\b"
FALLBACK_NUMBER = rf"\b{P.NUM_STRICT}\b"
FALLBACK_AMOUNT = rf"\b({P.NUM_STRICT})\b"
FALLBACK_SKU = r"\b([A-Z0-9]+(?:[_-][A-Z0-9]+)*)\b"
FALLBACK_QTY = rf"\b(\d+(?:\.\d+)?)\s*(?:{UOM4})\b"
FALLBACK_UOM = rf"\b({UOM4})\b"
DEFAULT_UOM = "PCS"
LAYOUT_TOTAL_AT_END = rf"((?>{P.NUM_STRICT}))$"
ZIP_SKU = r"([A-Z0-9]+_[A-Z0-9]+)"
ZIP_HSN = r"(\d{8})"
ZIP_QTY = rf"(\d+)\s*(?:{UOM3})"
ZIP_TAX_RATE = "GST_5"
ZIP_IGST_RATE = "5.00%"


def _float_text(x: Column) -> Column:
    """``f"{x}"`` for a Python float in the range rates take (0.001 <= x < 1e7)."""
    return x.cast("string")


def _parse_loose(s: Column) -> Column:
    """``float(re.sub(r'[^\\d.]', '', s))``; NULL where Python would raise."""
    return digits_to_double(F.regexp_replace(s, r"(?U)[^\d.]", ""))


def _parse_commas(s: Column) -> Column:
    """A capture of digits, commas and dots, commas dropped."""
    return digits_to_double(F.regexp_replace(s, ",", ""))


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), strip)


# --- simple profile -------------------------------------------------------------------


def simple_items(docs: DataFrame, vendor_pattern: str = P.VENDOR_NUMBER, keep: tuple[str, ...] = (),
                 outer: bool = False) -> DataFrame:
    """I1, I3, I5, I7-I16.  ``keep``: document columns carried onto every item
    row; ``outer``: keep documents without items as one row (see ``_finish``)."""
    t = F.col("text")
    keep = tuple(k for k in keep if k not in ("doc_key", "text"))
    docs = docs.select("doc_key", "text", *keep, fold(t).alias("_low"))
    sec = F.regexp_extract(t, py(SIMPLE_SECTION, "is"), 1)
    a = docs.select(
        "doc_key", "text", *keep,
        simple_invoice_number(t, vendor_pattern, F.col("_low")).alias("invoice_number"),
        sec.alias("_sec"),
        F.upper(t).contains("CGST").alias("_has_c"),
        F.upper(t).contains("SGST").alias("_has_s"),
        F.upper(t).contains("IGST").alias("_has_i"),
    )
    primary = F.filter(_lines(F.col("_sec")), lambda x: (x != F.lit("")) & ~matches(x, SIMPLE_HEADER_LINE, "i"))
    fallback = F.filter(_lines(t), lambda x: ~matches(x, FALLBACK_SKIP, "i") & matches(x, FALLBACK_CODE)
                        & (matches(x, FALLBACK_QTY_UNIT, "i") | matches(x, FALLBACK_NUMBER)))
    b = a.select("*", F.when(F.col("_sec") == "", F.array().cast("array<string>"))
                 .otherwise(primary).alias("_primary"))
    c = b.select("doc_key", *keep, "invoice_number", "_has_c", "_has_s", "_has_i",
                 (F.size("_primary") == 0).alias("_fb"),
                 F.when(F.size("_primary") == 0, fallback).otherwise(F.col("_primary")).alias("_rows"))
    r = c.select("doc_key", *keep, "invoice_number", "_has_c", "_has_s", "_has_i", "_fb",
                 F.posexplode_outer("_rows").alias("_pos", "line"))
    r = r if outer else r.where(F.col("_pos").isNotNull())
    line = F.col("line")
    fb = F.col("_fb")
    # primary-row captures
    sku = extract(line, SKU_SIMPLE)
    hsn = extract(line, HSN_SIMPLE)
    qty = F.coalesce(digits_to_double(extract(line, QTY_SIMPLE, "i")), F.lit(1.0))
    uom = F.coalesce(filled(F.upper(extract(line, UOM_SIMPLE, "i"))), F.lit(DEFAULT_UOM))
    price0 = F.coalesce(_parse_commas(extract(line, PRICE_SIMPLE, "i")), F.lit(0.0))
    total = F.coalesce(_parse_commas(extract(line, TOTAL_AT_END)), F.lit(0.0))
    tax = F.coalesce(digits_to_double(extract(line, PERCENT)), F.lit(0.0))
    # fallback-row captures
    fb_sku = F.coalesce(filled(extract(line, FALLBACK_SKU)),
                        F.concat(F.lit("ITEM"), (F.col("_pos") + 1).cast("string")))
    fb_qty = F.coalesce(digits_to_double(extract(line, FALLBACK_QTY, "i")), F.lit(1.0))
    fb_uom = F.coalesce(filled(F.upper(extract(line, FALLBACK_UOM, "i"))), F.lit(DEFAULT_UOM))
    amounts = F.regexp_extract_all(line, F.lit(py(FALLBACK_AMOUNT)), 1)
    fb_total = F.coalesce(_parse_commas(F.element_at(F.when(F.size(amounts) > 0, amounts), -1)), F.lit(0.0))
    d = r.select(
        "doc_key", *keep, "invoice_number", "_has_c", "_has_s", "_has_i", "_fb", "_pos", "line",
        F.when(fb, fb_sku).otherwise(sku).alias("item_sku_code"),
        F.when(fb, F.lit("")).otherwise(hsn).alias("hsn_code"),
        F.when(fb, fb_qty).otherwise(qty).alias("quantity"),
        F.when(fb, fb_uom).otherwise(uom).alias("uom"),
        F.when(fb, F.lit(0.0)).otherwise(price0).alias("_price0"),
        F.when(fb, fb_total).otherwise(total).alias("line_total_value"),
        F.when(fb, F.lit(0.0)).otherwise(tax).alias("_tax"),
    )
    q, lt, tx = F.col("quantity"), F.col("line_total_value"), F.col("_tax")
    price = F.when(fb, F.when((q > 0) & (lt > 0), lt / q).otherwise(F.lit(0.0))) \
        .otherwise(F.when((lt > 0) & (F.col("_price0") == 0.0) & (q > 0), lt / q).otherwise(F.col("_price0")))
    pos_tax = tx > 0
    c_rate = F.when(F.col("_has_c") & pos_tax, F.concat(_float_text(tx / 2), F.lit("%"))).otherwise(F.lit(""))
    s_rate = F.when(F.col("_has_s") & pos_tax, F.concat(_float_text(tx / 2), F.lit("%"))).otherwise(F.lit(""))
    i_rate0 = F.when(F.col("_has_i") & pos_tax, F.concat(_float_text(tx), F.lit("%"))).otherwise(F.lit(""))
    i_rate = F.when(pos_tax & (c_rate == "") & (s_rate == "") & (i_rate0 == ""),
                    F.concat(_float_text(tx), F.lit("%"))).otherwise(i_rate0)
    # description: between the SKU and the first of HSN / quantity / unit, built
    # from the row's own values (the quantity's dot is a wildcard, as printed)
    desc_pat = F.concat(F.lit("(?iUd)"), F.col("item_sku_code"), F.lit(WS + "+(.*?)(?:\\b"),
                        F.col("hsn_code"), F.lit("\\b|\\b"), F.col("quantity").cast("string"),
                        F.lit("\\b|\\b"), F.col("uom"), F.lit("\\b)"))
    desc = strip(F.call_function("regexp_extract", line, desc_pat, F.lit(1)))
    description = F.when(fb | (desc == ""), line).otherwise(desc)
    e = d.select(
        "doc_key", *keep, F.col("_pos").isNotNull().alias("has_item"),
        serial_number(F.col("doc_key")).alias("invoice_serial_number"),
        "invoice_number",
        (F.col("_pos") + 1).cast("int").alias("line_number"),
        "item_sku_code", description.alias("item_description"), "hsn_code", "quantity", "uom",
        price.alias("unit_price"),
        F.when(pos_tax, F.concat(_float_text(tx), F.lit("%"))).otherwise(F.lit("")).alias("tax_rate"),
        c_rate.alias("cgst_rate"), s_rate.alias("sgst_rate"), i_rate.alias("igst_rate"),
        F.when(c_rate != "", lt * tx / 200).otherwise(F.lit(0.0)).alias("cgst_amount"),
        F.when(s_rate != "", lt * tx / 200).otherwise(F.lit(0.0)).alias("sgst_amount"),
        F.when(i_rate != "", lt * tx / 100).otherwise(F.lit(0.0)).alias("igst_amount"),
        "line_total_value",
    )
    return _finish(e, keep, outer)


# --- layout profile ----------------------------------------------------------------------


def _gst_label(rate: Column) -> Column:
    """``GST_<int>`` for whole rates, else ``GST_<float>``."""
    return F.when(rate == F.floor(rate), F.concat(F.lit("GST_"), F.floor(rate).cast("string"))) \
        .otherwise(F.concat(F.lit("GST_"), _float_text(rate)))


# Columns of a stripped line are split at runs of 2+ white-space characters.  The
# runs become line ends first, which no line contains: the pattern has one
# character class under its repetition, so a line of any length matches without
# recursion, and splitting at a single literal character compiles no pattern.
COLUMN_GAP = r"(?Ud)[\s\x1c-\x1f]{2,}"


def split_columns(line: Column) -> Column:
    """The column parts of a stripped, non-blank line."""
    return F.split(F.regexp_replace(line, COLUMN_GAP, "\n"), "\n")


def _has_keyword(low: Column) -> Column:
    """Whether a folded line holds one of ITEM_KEYWORDS."""
    return has_any(low, PLAIN_KEYWORDS) | (low.contains("no") & matches(low, NO_KEYWORDS))


def _layout_rows(docs: DataFrame, vendor_pattern: str, keep: tuple[str, ...], zip_limit: int | None) -> DataFrame:
    """``doc_key``, ``keep``, ``invoice_number`` and ``rows``: a document's item rows as an array (NULL without any)."""
    t = F.col("text")
    docs = docs.select("doc_key", "text", *keep, fold(t).alias("_low"))
    # in the folded text a keyword is found several times faster; every section end holds the word "total"
    low = F.col("_low")
    # a place by the characters left from it on (regexp_instr counts one beyond the BMP twice); past the end without a match
    places = [F.when(has_any(low, ["total"]) & need, F.length(t) - F.length(extract(low, rf"(?:{p})(?s:.*+)", "", 0)) + 1) for p, need in
              [(KEYWORDS_FOLDED, F.lit(True)), (DETAILS_FOLDED, has_any(low, ["details"]))]]
    locate = lambda word, text, at: F.call_function("locate", F.lit(word), text, at)

    def first_with_end(at: Column) -> Column:
        # an end that stands six characters on can't overlap the keyword: of those that end in "t", the longest has six
        starts = [F.when((x > 0) & ((locate("total", low, x + 6) > 0) | extract(low, rf"(?:{p})(?s:(.*+))").contains("total")), x)
                  for x, p in [(at["a"], KEYWORDS_FOLDED), (at["b"], DETAILS_FOLDED)]]
        return F.coalesce(*starts, F.lit(0))

    # each step reads the one before several times: bound, so that the rows' expression doesn't multiply where Spark inlines it
    a = docs.select(
        "doc_key", "text", *keep, "_low",
        layout_invoice_number(t, vendor_pattern, low).alias("invoice_number"),
        bound(F.struct(places[0].alias("a"), places[1].alias("b")), first_with_end).alias("_start"),
    )

    def section(text: Column) -> Column:
        return bound(F.col("_start"), lambda start: bound(locate("Total", t, start), lambda end: F.when(start == 0, F.lit(""))
                     .when(end == 0, F.substring(text, start, F.lit(MOST))).otherwise(F.substring(text, start, end - start))))

    b = a.select("doc_key", "text", *keep, "invoice_number", section(t).alias("_sec"), F.split(section(low), "\n").alias("_low_lines"))
    lines = F.filter(_lines(F.col("_sec")), lambda x, i: (x != F.lit("")) & ~_has_keyword(F.get(F.col("_low_lines"), i)))
    # each line's parts once, then its numbers once, then keep the valid rows
    with_parts = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line"),
                                                          split_columns(x).alias("parts")))

    def numbers(r):
        parts = r["parts"]
        wide = F.size(parts) >= 7
        qty = _parse_loose(F.when(wide, F.get(parts, 3)).otherwise(F.get(parts, 2)))
        price = _parse_loose(F.when(wide, F.get(parts, 4)).otherwise(F.get(parts, 3)))
        return F.struct(r["i"].alias("i"), r["line"].alias("line"), parts.alias("parts"),
                        qty.alias("qty"), price.alias("price"),
                        F.lit(None).cast("string").alias("zsku"), F.lit(None).cast("string").alias("zhsn"))

    def ok(r):
        wide = F.size(r["parts"]) >= 7
        return (F.size(r["parts"]) >= 3) & r["qty"].isNotNull() & (~wide | r["price"].isNotNull())

    primary = F.filter(F.transform(with_parts, numbers), ok)
    txt = F.col("text")
    skus = F.regexp_extract_all(txt, F.lit(py(ZIP_SKU)), 1)
    skus = skus if zip_limit is None else F.slice(skus, 1, zip_limit)
    hsns = F.regexp_extract_all(txt, F.lit(py(ZIP_HSN)), 1)
    qtys = F.regexp_extract_all(txt, F.lit(py(ZIP_QTY)), 1)
    one = lambda z: F.transform(z["skus"], lambda s, i: F.struct(
        i.alias("i"), F.lit(None).cast("string").alias("line"), F.lit(None).cast("array<string>").alias("parts"),
        F.coalesce(digits_to_double(F.get(z["qtys"], i)), F.lit(0.0)).alias("qty"), F.lit(0.0).alias("price"),
        s.alias("zsku"), F.coalesce(F.get(z["hsns"], i), F.lit("")).alias("zhsn")))
    # the lists are an element, as a search inside the inner lambda function would run for every item
    zipped = bound(F.struct(skus.alias("skus"), hsns.alias("hsns"), qtys.alias("qtys")), one)
    c = b.select("doc_key", "text", *keep, "invoice_number", "_sec", primary.alias("_primary"))
    rows = bound(F.col("_primary"), lambda p: F.when(F.size(p) > 0, p).when(F.col("_sec") != "", zipped))
    return c.select("doc_key", *keep, "invoice_number", rows.alias("rows"))


def _layout_amounts(r: Column) -> tuple[Column, Column, Column]:
    """Tax rate, computed tax amount and total of an item row."""
    parts, line = r["parts"], r["line"]
    wide = F.size(parts) >= 7
    tax = digits_to_double(extract(line, PERCENT))
    qty, price = r["qty"], F.coalesce(r["price"], F.lit(0.0))
    # money arithmetic in exact decimals, rounded half-even to 2 places; in doubles
    # where a number from the text doesn't fit them (it never ends the job)
    sub = F.try_multiply(price.try_cast("decimal(18,6)"), qty.try_cast("decimal(18,6)"))
    exact = F.try_divide(F.try_multiply(sub, tax.try_cast("decimal(10,4)")), F.lit(100).cast("decimal(3,0)"))
    igst = F.coalesce(F.bround(exact, 2).cast("double"), F.bround(price * qty * tax / 100, 2))
    computed = F.when(wide & tax.isNotNull() & (price > 0) & (qty > 0), igst)
    trailing = _parse_commas(extract(F.substring_index(line, " ", -1), LAYOUT_TOTAL_AT_END))  # a number holds no space
    line_total = F.when(wide, F.coalesce(trailing, F.coalesce(sub.cast("double"), price * qty) + computed)).otherwise(F.lit(0.0))
    return tax, computed, line_total


def layout_item_arrays(docs: DataFrame, vendor_pattern: str = P.VENDOR_NUMBER, keep: tuple[str, ...] = (),
                       zip_limit: int | None = None) -> DataFrame:
    """``doc_key``, ``keep`` and ``items``: per document the line number, code and total of its items in order, as
    :func:`layout_items` has them, without leaving the document's row (no explode, no shuffle to undo it)."""
    def item(r: Column) -> Column:
        total = F.coalesce(_layout_amounts(r)[2], F.lit(0.0))
        return F.struct((r["i"] + 1).cast("int").alias("line_number"),
                        F.coalesce(r["zsku"], F.get(r["parts"], 0), F.lit("")).alias("item_sku_code"), total.alias("line_total_value"))

    keep = tuple(k for k in keep if k not in ("doc_key", "text"))
    c = _layout_rows(docs, vendor_pattern, keep, zip_limit)
    none = F.array().cast("array<struct<line_number:int,item_sku_code:string,line_total_value:double>>")
    return c.select("doc_key", *keep, F.coalesce(F.transform("rows", item), none).alias("items"))


def layout_items(docs: DataFrame, vendor_pattern: str = P.VENDOR_NUMBER, keep: tuple[str, ...] = (),
                 outer: bool = False, zip_limit: int | None = None) -> DataFrame:
    """I2, I4, I6, I17-I25.  ``keep`` / ``outer`` as in :func:`simple_items`;
    ``zip_limit``: rows of the zip fallback (all by default)."""
    keep = tuple(k for k in keep if k not in ("doc_key", "text"))
    c = _layout_rows(docs, vendor_pattern, keep, zip_limit)
    r = c.select("doc_key", *keep, "invoice_number", F.explode_outer("rows").alias("r"))
    r = r if outer else r.where(F.col("r").isNotNull())
    is_zip = F.col("r.zsku").isNotNull()
    parts = F.col("r.parts")
    wide = F.size(parts) >= 7
    tax, computed, line_total = _layout_amounts(F.col("r"))
    qty, price = F.col("r.qty"), F.coalesce(F.col("r.price"), F.lit(0.0))
    hsn3 = F.get(parts, 2)
    m = r.select(
        "doc_key", *keep, F.col("r").isNotNull().alias("has_item"), "invoice_number",
        (F.col("r.i") + 1).cast("int").alias("line_number"),
        F.when(is_zip, F.col("r.zsku")).otherwise(F.get(parts, 0)).alias("item_sku_code"),
        F.when(is_zip, F.lit("")).otherwise(F.get(parts, 1)).alias("item_description"),
        F.when(is_zip, F.col("r.zhsn")).when(wide & matches(hsn3, r"^\d"), hsn3).otherwise(F.lit(""))
        .alias("hsn_code"),
        qty.alias("quantity"),
        F.when(wide | is_zip, F.lit(DEFAULT_UOM)).otherwise(F.lit("")).alias("uom"),
        price.alias("unit_price"),
        F.when(is_zip, F.lit(ZIP_TAX_RATE)).when(tax.isNotNull(), _gst_label(tax)).otherwise(F.lit(""))
        .alias("tax_rate"),
        F.when(is_zip, F.lit(ZIP_IGST_RATE)).when(tax.isNotNull(), F.concat(_float_text(tax), F.lit("%")))
        .otherwise(F.lit("")).alias("igst_rate"),
        F.coalesce(computed, F.lit(0.0)).alias("igst_amount"),
        line_total.alias("line_total_value"),
    )
    out = m.withColumn("invoice_serial_number", serial_number(F.col("doc_key")))
    return _finish(out, keep, outer)


def _finish(df: DataFrame, keep: tuple[str, ...], outer: bool) -> DataFrame:
    """Conform to the 19-field contract; with ``outer``, a document without items
    keeps one row whose item fields are NULL and ``has_item`` is false."""
    out = conform_items(df, ("doc_key",) + keep + ("has_item",))
    if not outer:
        return out.drop("has_item")
    from fieldloom.functions.contract import ITEM_COLUMNS
    return out.select("doc_key", *keep, "has_item",
                      *[F.when(F.col("has_item"), F.col(c)).alias(c) for c in ITEM_COLUMNS])


def extract_items(docs: DataFrame, profile: str = "layout", **kw) -> DataFrame:
    """``(doc_key, text)`` -> ``doc_key`` + 19 item fields, one row per item.

    ``keep=(...)`` carries document columns onto the item rows; ``outer=True``
    keeps documents without items as one row with NULL item fields."""
    if profile == "simple":
        return simple_items(docs, **kw)
    if profile == "layout":
        return layout_items(docs, **kw)
    raise ValueError(f"unknown item profile {profile!r}; expected 'simple' or 'layout'")
