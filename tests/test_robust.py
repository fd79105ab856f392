"""Hostile texts, failed calls and awkward values: a row may be wrong, the job goes on."""
import json

import pytest
from pyspark.sql import functions as F

from fieldloom.functions.contract import ITEM_COLUMNS
from fieldloom.operators import model_io as M
from fieldloom.operators import relate as R
from fieldloom.operators.header import extract_headers
from fieldloom.operators.items import extract_items, split_columns
from fieldloom.sources import sink as S
from fieldloom.streaming import jobs as J
from tests.conftest import docs

HEAD = "Invoice No: H1\nItem Code  Description  HSN  Qty  Rate  Amount  Tax\n"
TAIL = "\nTotal Amount: 10.00\n"


@pytest.mark.parametrize("line", [
    "word " * 800,                                            # 4,000 characters in single spaces
    "x" * 1_000_000,                                          # one word of 1 MB
    "a b " * 250_000,                                         # 1 MB of short words
    ",".join(["1"] * 6000),                                   # a long comma run
    "S1  thing  7300  1234567890123456  9.99  5%  12.00",     # 16 digits as quantity
    "S1  thing  7300  " + "9" * 400 + "  9.99  5%  12.00",    # 400 digits
    "S1  thing  7300  " + "9" * 30 + "  " + "8" * 30 + "  5%  12.00",
])
def test_one_line_never_ends_the_job(spark, line):
    d = docs(spark, HEAD + line + TAIL, HEAD + "A1  ok  7300  2  3.00  5%  6.00" + TAIL, "CGST " + line, line)
    for profile in ("simple", "layout"):
        assert extract_items(d, profile).select(*ITEM_COLUMNS).where("invoice_number = 'H1'").count() >= 1
    for profile in ("simple", "layout", "minimal"):
        assert extract_headers(d, profile).count() == 4
    assert len(extract_headers(d, "layout").collect()) == 4


def test_columns_of_a_long_line(spark):
    df = spark.createDataFrame([("a b  c\t\td e   f",), ("x " * 100_000 + "  y",)], "line string")
    got = [r[0] for r in df.select(split_columns(F.trim("line"))).collect()]
    assert got[0] == ["a b", "c", "d e", "f"] and len(got[1]) == 2 and got[1][1] == "y"


def test_numbers_keep_their_shape(spark):
    d = docs(spark, "CGST: 1,200.50 x", "CGST: 1,,2", "CGST: 12,", "CGST: 7")
    h = {r.doc_key: r.cgst_amount for r in extract_headers(d, "layout").collect()}
    assert h == {0: 1200.5, 1: 1.0, 2: 12.0, 3: 7.0}


def test_zip_fallback_gives_every_row(spark):
    skus = " ".join(f"AB{i}_C{i}" for i in range(9))
    d = docs(spark, f"Invoice No: Z\nItem Code\n{skus}\nTotal")
    assert extract_items(d, "layout").count() == 9
    assert extract_items(d, "layout", zip_limit=5).count() == 5


def _body(text):
    return json.dumps({"choices": [{"message": {"content": text}}]})


def test_failed_answers_take_the_fallback(spark):
    text = "TAX INVOICE\nInvoice No: Z9\nTotal: 10.50\n"
    d = docs(spark, *[text] * 6)
    r = spark.createDataFrame([
        (0, "openai", 504, None), (1, "openai", 200, _body('{"error": "quota"}')), (2, "openai", 200, _body("[1]")),
        (3, "other", 200, _body('{"invoice_data": {}}')), (4, None, None, None),
        (5, "openai", 500, "down"), (5, "openai", 200, _body('{"invoice_data": {"Invoice Number": "N5"}, "line_items": [{"Quantity": 1}]}')),
    ], "doc_key bigint, provider string, http_status int, body string")
    errors = {x.doc_key: x.error for x in M.unwrap(r.where("doc_key < 5")).collect()}
    assert errors[0] == "API error: 504 - " and errors[1] == "quota" and errors[2] == M.ERR_OBJECT
    assert errors[3] == M.ERR_PROVIDER + "other" and errors[4] == M.ERR_PROVIDER
    h = {x.doc_key: x for x in M.route_headers(d, r).collect()}
    assert len(h) == 6 and all("fallback" in h[k].additional_remarks and h[k].invoice_document_number == "Z9" for k in range(4))
    assert h[5].invoice_document_number == "N5"
    assert [x.doc_key for x in M.route_items(d, r).collect()] == [5]


def test_latest_response_wins(spark):
    r = spark.createDataFrame([(1, "openai", 200, "a", 1), (1, "openai", 500, "b", 2)],
                              "doc_key bigint, provider string, http_status int, body string, received_at int")
    assert [x.body for x in M.latest_responses(r).collect()] == ["b"]


def test_requests_hold_whole_texts(spark):
    text = "".join(chr(97 + i % 26) for i in range(20_001))
    d = docs(spark, text, "", None)
    got = M.build_requests(d, "openai").orderBy("doc_key", "chunk_no").collect()
    cut = [x.request[len(M.REQUEST_PREFIX):-len(M.REQUEST_SUFFIX)] for x in got if x.doc_key == 0]
    assert "".join(cut) == text and [len(c) for c in cut] == [8000, 8000, 4001]
    assert [x.n_chunks for x in got if x.doc_key > 0] == [1, 1]


def test_model_items_plan_parses_json_in_projections_only(spark):
    r = spark.createDataFrame([(1, "openai", 200, _body("{}"))], "doc_key bigint, provider string, http_status int, body string")
    plan = M.route_items(docs(spark, "x"), r)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if ("Filter" in x or "Join" in x) and "from_json" in x]


def test_status_events_take_text_keys(spark):
    d = spark.createDataFrame([("a.pdf", None), ("b.pdf", "no text")], "doc_key string, err string")
    got = {(x.file_id, x.seq): x.status for x in J.status_events(d, "j", error_col="err").collect()}
    assert got == {("a.pdf", 0): "processing", ("a.pdf", 1): "completed", ("b.pdf", 0): "processing", ("b.pdf", 1): "failed"}


def test_large_sums_and_duplicates(spark):
    h = spark.createDataFrame([("S", "N1", "01-02-2024", 9e15)] * 3 + [("S", "", "x", 1.0)] * 2 + [("S", "N2", "x", 1e30)],
                              "supplier_gstin string, invoice_document_number string, invoice_document_date string, total_invoice_value double")
    rows = R.spend_rollup(h).collect()
    assert max(x.total_value for x in rows) == 27_000_000_000_000_002
    assert {x.level for x in rows} == {0, 1, 3}
    assert [(x.invoice_document_number, x.n) for x in R.duplicate_numbers(h).collect()] == [("N1", 3)]


def test_csv_quotes_commas_and_line_ends(spark, tmp_path):
    import csv
    names = ['A "Q" LTD, X', "two\nlines", "back\\slash", " lead", ""]
    h = extract_headers(docs(spark, *["x"] * 5), "simple").drop("supplier_name") \
        .join(spark.createDataFrame(list(enumerate(names)), "doc_key bigint, supplier_name string"), "doc_key")
    S.write_headers_csv(h.coalesce(1), str(tmp_path / "h"))
    back = {r.serial_number: r.supplier_name for r in S.read_headers_csv(spark, str(tmp_path / "h")).collect()}
    assert back == {str(i): n for i, n in enumerate(names)}
    part = next((tmp_path / "h").glob("part-*.csv"))
    with open(part, newline="") as f:
        rows = list(csv.DictReader(f))
    assert sorted(r["Supplier Name"] for r in rows) == sorted(names)
    S.write_csv(h.select("doc_key"), str(tmp_path / "any"))
    assert S.csv_columns(spark, str(tmp_path / "any")) == ["doc_key"]


ID = "27ABCDE1234F1Z5"


@pytest.mark.parametrize("text", [
    f"x GSTIN {ID}", f"From x GSTIN {ID}", "GSTIN none here", f"GSTIN a From b {ID}", f"{ID} GSTIN", "from only",
    f"GSTIN GSTIN {ID} seller", f"seller GSTIN {ID}", "", f"gstin\n{ID.lower()}",
])
def test_context_search_equals_the_one_pattern(spark, text):
    import re

    from fieldloom.functions import patterns as P
    from fieldloom.operators.header import first_at, id_after, simple_gstin
    labels, words, _ = P.SIMPLE_ID_ROLES["supplier"]
    m = re.search(rf"({words}|GSTIN.*?{P.TAXID})", text, re.I | re.S)
    want = None if not m else "" if m[1].lower() in ("supplier", "seller", "from") else m[1][-15:]
    labelled = [re.search(p, text, re.I) for p in labels]
    if not any(labelled) and want is not None:
        t = F.col("text")
        df = docs(spark, text).select(simple_gstin(t, "supplier", F.array().cast("array<string>"), first_at(t, "GSTIN"), id_after(t, "GSTIN")).alias("g"))
        assert df.collect()[0].g == want


@pytest.mark.parametrize("shape", [
    "from GSTIN x ", "Supplier: acme\nshort line\n", "Qty Rate Amount\nline\n", "CGST SGST IGST CESS x ", "Supplier: a\nRoad x\n", "Bill to\nBuyer y ",
])
def test_long_texts_take_linear_time(spark, shape):
    """Twice the text takes at most about twice the time, in all profiles; no shape has the end its searches look for."""
    import time

    from fieldloom.operators.items import extract_items

    def took(size):
        best = []
        for _ in range(2):
            d = docs(spark, shape * (size // len(shape)))
            t = time.perf_counter()
            extract_headers(d, "simple").collect()
            extract_headers(d, "layout").collect()
            extract_headers(d, "minimal").collect()
            extract_items(d, "simple").count()
            extract_items(d, "layout").count()
            best.append(time.perf_counter() - t)
        return min(best)
    took(1 << 10)
    base, small, large = took(1 << 10), took(1 << 16), took(1 << 17)
    assert large - base < 2.6 * max(small - base, 1.0)


def test_layout_number_of_a_line_equals_the_plain_search(spark):
    import re

    from fieldloom.functions import patterns as P
    from fieldloom.operators.header import _layout_number
    texts = ["CGST x CGST Rs. 5.50", "CGST none\nCGST: 7", "x CGST\n 1,200.25", "cgst CGST\n", "CGST a\n\nb 3", "SGST 4 CGST 5 CGST 6", "y"]
    got = docs(spark, *texts).select("doc_key", _layout_number(F.col("text"), "CGST").alias("n")).orderBy("doc_key").collect()
    for r, text in zip(got, texts):
        m = re.search(rf"(?:CGST){P.LAYOUT_NUMBER_TAIL}", text, re.I)
        assert r.n == (float(m[1].replace(",", "")) if m else 0.0)


def address_patterns():
    """The address searches as one search each, which starts anew at every line end."""
    from fieldloom.functions import patterns as P
    return [rf"\n(.*?{w}.*?){P.ADDRESS_END}" for w in P.ADDRESS_WORDS]


@pytest.mark.parametrize("text", [
    "acme\n12 Mill Road\nNext", "acme\nplain\n1 Road 2 Road\n\nx", "acme\nno word\nat all", "acme Road\nx\nCity\nq", "acme\nDistrict 560001",
    "acme\nx 560001 y\n 7\n8\nA", "acme\n\n \nTown\n \nroad\n1", "acme", "acme\nRoad\n1\n2", "acme\nlane\n1\nlane\nx",
])
def test_address_from_the_first_line_equals_the_plain_search(spark, text):
    import re

    from fieldloom.operators.header import layout_address
    found = next((m[1] for p in address_patterns() if (m := re.search(p, text, re.I | re.S))), None)
    got = docs(spark, text).select(layout_address(F.col("text"), F.lit("acme")).alias("a")).collect()[0].a
    if found is not None:
        assert got == re.sub(r"\s+", " ", found.strip())
    else:  # the lines that follow, up to a blank one
        lines = [x.strip() for x in text.split("\n")[1:]]
        assert got == ", ".join(lines[:lines.index("")] if "" in lines else lines)
