"""Hand cases for item row generation."""
from fieldloom.operators.items import extract_items, layout_item_arrays
from tests.conftest import docs, rows

SECTION = "Sr No  Item Code  Description  HSN  Qty  Rate  Amount\n"


def test_layout_gaps_and_bad_quantity(spark):
    t = ("Invoice No: X1\n" + SECTION +
         "A_1  pen  1234  2 PCS  10.00  5%  21.00\n"
         "A_2  cap  1234  PCS  10.00  5%  21.00\n"      # bad quantity: row dropped, number kept
         "only two\n"                                  # fewer than 3 parts: dropped
         "A_3  ink  3 PCS  7.50\n"                      # 3-6 parts
         "Total: 1\n")
    r = rows(extract_items(docs(spark, t), "layout"), "line_number", "item_sku_code", "quantity",
             "unit_price", "tax_rate", "igst_rate", "igst_amount", "line_total_value")
    assert r == [(1, "A_1", 2.0, 10.0, "GST_5", "5.0%", 1.0, 21.0), (4, "A_3", 3.0, 7.5, "", "", 0.0, 0.0)]


def test_layout_zip_fallback_and_no_section(spark):
    t = ("Invoice No: X1\nItem Details\nAB_1 x 12345678 4 PCS\nCD_2 y 87654321 6 PCS\nTotal 9\n")
    r = rows(extract_items(docs(spark, t), "layout"), "line_number", "item_sku_code", "hsn_code", "quantity",
             "tax_rate", "igst_rate")
    assert r == [(1, "AB_1", "12345678", 4.0, "GST_5", "5.00%"), (2, "CD_2", "87654321", 6.0, "GST_5", "5.00%")]
    assert extract_items(docs(spark, "AB_1 12345678 4 PCS\n"), "layout").count() == 0


def test_simple_quirks(spark):
    t = "Invoice No: X1\nIGST\n" + SECTION + "P1_B  thing  61000173  40 PCS  917.30  12%  36692.00\nTotal\n"
    r = rows(extract_items(docs(spark, t), "simple"), "item_sku_code", "hsn_code", "quantity", "unit_price",
             "igst_rate", "igst_amount", "line_total_value", "item_description")
    # the number before the unit is the quantity, so unit price == quantity
    assert r == [("P1_B", "61000173", 40.0, 40.0, "12.0%", 36692.0 * 12 / 100, 36692.0, "thing")]


def test_simple_fallback_numbering(spark):
    t = "Invoice No: X1\nWIDGET-9 blue 3 PCS 45.00\nshort\nGADGET01 red 10 NOS 1,200.50\n"
    r = rows(extract_items(docs(spark, t), "simple"), "line_number", "item_sku_code", "quantity", "uom",
             "line_total_value")
    assert r == [(1, "WIDGET-9", 3.0, "PCS", 45.0), (2, "GADGET01", 10.0, "NOS", 1200.5)]


def test_layout_sections_are_found_in_the_folded_text(spark):
    """Letter case of keywords and ends, other letters for ASCII ones, an end beside or within its keyword."""
    row = "A_1  pen  1234  2 PCS  10.00  5%  1,021.00\n"
    texts = ["SR.  NO\n" + row + "tOtAl", "\u017fr no\n" + row + "Total", "HSNtotal\n" + row, "AMOUNTotal\n" + row, "\u0130 qty\n" + row + "total",
             "Item  Details\n" + row + "SUB TOTAL\n", "total\nhsn\n" + row, "qty\n" + row + "Invoice No 7\n" + row.replace("A_1", "A_2") + "De\u017fcription\nSr\tNo\n" + row + "\ntotal"]
    d = layout_item_arrays(docs(spark, *texts))
    got = [[(i.line_number, i.item_sku_code, i.line_total_value) for i in r["items"]] for r in d.orderBy("doc_key").collect()]
    one = [(1, "A_1", 1021.0)]
    assert got == [one, one, one, [], one, [(2, "A_1", 1021.0)], [], one + [(3, "A_2", 1021.0), (4, "A_1", 1021.0)]]
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "item code" in plan and "Item Code" not in plan  # no search of the whole text that ignores case


def test_section_behind_a_character_beyond_the_bmp(spark):
    text = "\U0001F600" * 20 + "\nSr No Qty\nA1  x  3  4.00  12.00\nTotal 1"
    df = extract_items(docs(spark, text, text[20:]), "layout").drop("doc_key", "invoice_serial_number")
    a, b = df.collect()
    assert a == b and a.item_sku_code == "A1"
