"""Hand cases for header operators (quirks kept on purpose are asserted too)."""
from fieldloom.operators.header import extract_headers
from tests.conftest import docs

BASE = ("TAX INVOICE\nACME TRADERS PRIVATE LIMITED\nInvoice No: A-17\nInvoice Date: 05-01-2024\n"
        "Supplier\nTrade Name: ACME TRADERS PRIVATE LIMITED\nAddress: 4 Mill Road\n"
        "Supplier GSTIN: 27ABCDE1234F1Z5\n\nBill to\nLegal Name: BETA STORES\nAddress: 9 Lake Street\n"
        "Customer GSTIN: 29PQRSX6789K1Z2\n\nSr No  Item Code  Description  HSN  Qty  Rate  Amount\n"
        "SKU_1  Blue pen  96081019  40 PCS  917.30  18%  1,234.00\n"
        "Total Quantity: 40\nTaxable Value: 1,234.00\nCGST: 111.06\nSGST: 111.06\n"
        "Total Invoice Value: Rs. 1,456.12\nAmount in Words: Rupees one thousand Only\n")


def test_simple_profile(spark):
    h = extract_headers(docs(spark, BASE), "simple").collect()[0]
    assert h.document_type == "Tax Invoice"
    assert h.invoice_document_number == "A-17"
    assert h.invoice_document_date == "05-01-2024"
    assert (h.supplier_name, h.supplier_address) == ("ACME TRADERS PRIVATE LIMITED", "4 Mill Road")
    assert (h.buyer_name, h.buyer_address) == ("BETA STORES", "9 Lake Street")
    assert (h.supplier_gstin, h.buyer_gstin) == ("27ABCDE1234F1Z5", "29PQRSX6789K1Z2")
    # no consignee section: the whole buyer triple is copied
    assert (h.consignee_name, h.consignee_gstin) == ("BETA STORES", "29PQRSX6789K1Z2")
    assert (h.total_quantity, h.subtotal_taxable_value, h.cgst_amount) == (40.0, 1234.0, 111.06)
    assert h.total_invoice_value == 1456.12
    assert h.amount_in_words == "Rupees one thousand Only"
    assert h.reverse_charge == "No" and h.po_number == ""


def test_simple_number_default_and_total_words_hint(spark):
    t = "Some note\nRupees two lakh only\n"
    h = extract_headers(docs(spark, t), "simple").collect()[0]
    assert h.invoice_document_number == "UNKNOWN"
    assert h.total_invoice_value == 100000.0


def test_simple_small_total_comes_from_loose_pass(spark):
    h = extract_headers(docs(spark, "Total Invoice Value: 5.00\n"), "simple").collect()[0]
    assert h.total_invoice_value == 5.0


def test_simple_gstin_bare_role_word_stops_search(spark):
    # (c): the leftmost hit of 'Supplier|Seller|From|GSTIN...' is the bare word -> ""
    t = "From the desk\nGSTIN 27ABCDE1234F1Z5\n"
    h = extract_headers(docs(spark, t), "simple").collect()[0]
    assert h.supplier_gstin == ""


def test_layout_profile_colon_labels(spark):
    t = BASE.replace("Supplier\nTrade Name: ", "Supplier: ").replace("Bill to\nLegal Name: ", "Buyer: ")
    h = extract_headers(docs(spark, t), "layout").collect()[0]
    assert h.supplier_name == "ACME TRADERS PRIVATE LIMITED"
    assert h.buyer_name == "BETA STORES"
    assert h.consignee_name == "BETA STORES"
    assert h.invoice_document_number == "A-17"
    assert h.total_invoice_value == 1456.12
    assert h.cgst_amount == 111.06


def test_layout_number_without_colon_is_not_taken(spark):
    h = extract_headers(docs(spark, "Invoice No A-17\nE-Way Bill No: 123\n"), "layout").collect()[0]
    assert h.invoice_document_number == "123"


def test_layout_words_appends_only(spark):
    h = extract_headers(docs(spark, "Amount in Words: Rupees ten\n"), "layout").collect()[0]
    assert h.amount_in_words == "Rupees ten Only"


def test_minimal_profile_and_known_party(spark):
    t = "DELIVERY CHALLAN\nBill to: Someone\nJabong India Pvt Ltd branch\nDocument No: D/9\n"
    h = extract_headers(docs(spark, t), "minimal").collect()[0]
    assert h.document_type == "Delivery Challan"
    assert h.supplier_name == "DELIVERY CHALLAN"
    assert h.buyer_name == "Jabong India Pvt Ltd branch"
    assert h.invoice_document_number == "D/9"
    assert h.additional_remarks == "Extracted with fallback method due to Google API failure"
