"""Model request / response operators: envelopes, fences, malformed answers, routing."""
import json

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import model_io as M
from tests.conftest import docs


def resp(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_key bigint, provider string, http_status int, body string")


def env_a(text):
    return json.dumps({"candidates": [{"content": {"parts": [{"inline": 1}, {"text": text}]}}]})


def env_b(text):
    return json.dumps({"choices": [{"message": {"content": text}}]})


ANSWER = '{"invoice_data": {"Invoice Number": "N1", "Total Invoice Value": "₹1,200.50"}, ' \
         '"line_items": [{"Item/SKU Code": "S1", "Quantity": "2", "Line Number": 7}, {"Quantity": 1}]}'


def test_unwrap_fences_and_errors(spark):
    r = resp(spark,
             (1, "google", 200, env_a("```json\n" + ANSWER + "\n```")),
             (2, "google", 200, env_a("```\n" + ANSWER + "\n```")),   # bare fence: error for A
             (3, "openai", 200, env_b("```\n" + ANSWER + "\n```")),   # fine for B
             (4, "openai", 500, "boom"),
             (5, "google", 200, json.dumps({"candidates": []})),
             (6, "openai", 200, env_b(ANSWER[:40])))
    got = {r.doc_key: r.error for r in M.unwrap(r).collect()}
    assert got[1] is None and got[3] is None
    assert got[2] == M.ERR_PARSE["google"] and got[6] == M.ERR_PARSE["openai"]
    assert got[4] == "API error: 500 - boom" and got[5] == M.ERR_FORMAT["google"]


def test_normalise_headers_and_items(spark):
    u = M.unwrap(resp(spark, (1, "openai", 200, env_b(ANSWER))))
    h = M.normalise_headers(u).collect()[0]
    assert (h.invoice_document_number, h.total_invoice_value) == ("N1", 1200.5)
    assert h.document_type == "Tax Invoice" and h.additional_remarks == "Extracted with Openai LLM"
    items = M.normalise_items(u).orderBy("line_number").collect()
    assert [(i.line_number, i.item_sku_code, i.quantity, i.invoice_number) for i in items] == \
        [(2, "", 1.0, "N1"), (7, "S1", 2.0, "N1")]


def test_one_malformed_item_empties_the_list(spark):
    bad = '{"invoice_data": {}, "line_items": [{"Quantity": 1}, 5]}'
    u = M.unwrap(resp(spark, (1, "openai", 200, env_b(bad))))
    assert M.normalise_items(u).count() == 0


def test_route_fallback_and_empty_text(spark):
    d = docs(spark, "TAX INVOICE\nInvoice No: Z9\nTotal: 10.50\n", "")
    r = resp(spark, (0, "google", 500, "down"), (1, "google", 200, env_a(ANSWER)))
    h = {x.doc_key: x for x in M.route_headers(d, r).collect()}
    assert h[0].invoice_document_number == "Z9" and h[0].total_invoice_value == 10.5
    assert M.fallback_used(F.lit(h[0].additional_remarks)) is not None
    assert "fallback" in h[0].additional_remarks
    assert h[1].additional_remarks == "Failed to extract text from PDF" and h[1].document_type == "Tax Invoice"


def test_requests_cut_by_provider(spark):
    d = docs(spark, "§" * 12000, "¤" * 12000).withColumn(
        "provider", F.when(F.col("doc_key") == 0, "google").otherwise("openai"))
    r = {(x.doc_key, x.chunk_no): x.request for x in M.build_requests(d).collect()}
    assert [r[0, i].count("§") for i in (0, 1)] == [10000, 2000] and [r[1, i].count("¤") for i in (0, 1)] == [8000, 4000]
    bad = docs(spark, "z").withColumn("provider", F.lit("other"))
    row = M.build_requests(bad).collect()[0]
    assert row.request is None and row.error.startswith(M.ERR_PROVIDER)


def test_invalid_answers_are_as_long_as_valid_ones(spark, sf001):
    from fieldloom.sources.corpus import render_response_texts
    from fieldloom.sources.tables import Tables
    broken = [r.content.strip("`\n").removeprefix("json\n")
              for r in render_response_texts(Tables(spark, sf001)).where("doc_key % 11 = 0").collect()]
    assert broken and all(b.endswith("]") and json.loads(b + "}")["line_items"] for b in broken)


def chunk_rows(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_key bigint, provider string, chunk_no int, n_chunks int, http_status int, body string")


def test_long_text_gives_chunks_and_all_their_items(spark):
    d = docs(spark, "x" * 20_000 + "y" * 3_000)
    req = M.build_requests(d, "openai")
    assert [r.chunk_no for r in req.orderBy("chunk_no").collect()] == [0, 1, 2]
    answer = lambda number, *skus: json.dumps({"invoice_data": {"Invoice Number": number}, "line_items": [
        {"Item/SKU Code": s, "Line Number": i + 1} for i, s in enumerate(skus)]})
    r = chunk_rows(spark, (0, "openai", 2, 3, 200, env_b(answer("LATE", "S4"))), (0, "openai", 0, 3, 200, env_b(answer("  ", "S1", "S2"))),
                   (0, "openai", 1, 3, 200, env_b(answer("N1", "S3"))))
    items = M.route_items(d, r).orderBy("line_number").collect()
    assert [(i.line_number, i.item_sku_code, i.invoice_number) for i in items] == [(1, "S1", "N1"), (2, "S2", "N1"), (3, "S3", "N1"), (4, "S4", "N1")]
    h = M.route_headers(d, r).collect()[0]
    assert h.invoice_document_number == "N1" and h.additional_remarks == "Extracted with Openai LLM"
    assert M.missing_chunks(req, r).count() == 0


def test_missing_and_failed_chunks_are_named(spark):
    d = docs(spark, "x" * 20_000, "TAX INVOICE\nInvoice No: Z9\n" + "z" * 9_000)
    req = M.build_requests(d, "openai")
    r = chunk_rows(spark, (0, "openai", 1, 3, 200, env_b('{"invoice_data": {"Invoice Number": "A\\"1"}, "line_items": [{"Item/SKU Code": "\\\\"}]}')),
                   (0, "openai", 2, 3, 500, None), (1, "openai", 0, 2, 500, None), (1, "openai", 1, 2, 200, env_b('{"error": "blurred"}')))
    h = {x.doc_key: x for x in M.route_headers(d, r).collect()}
    assert h[0].invoice_document_number == 'A"1' and h[0].additional_remarks == "Extracted with Openai LLM; no answer for chunks 0, 2"
    assert h[1].invoice_document_number == "Z9" and "fallback" in h[1].additional_remarks
    assert [(i.doc_key, i.item_sku_code) for i in M.route_items(d, r).collect()] == [(0, "\\")]
    assert {(x.doc_key, x.chunk_no): x.reason for x in M.missing_chunks(req, r).collect()} == {
        (0, 0): "no response", (0, 2): "API error: 500 - ", (1, 0): "API error: 500 - ", (1, 1): "blurred"}


def test_merge_reads_the_responses_once(spark):
    r = chunk_rows(spark, (0, "openai", 0, 1, 200, env_b(ANSWER)))
    plan = M.merge_chunks(r)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    (m,) = M.merge_chunks(r).collect()
    assert m.answer == ANSWER and m.missing == [] and m.n_chunks == 1


@pytest.mark.parametrize("answer, null", [
    ('{"invoice_data":null,"line_items":[]}', True), (' \n{"a":1,"invoice_data" : null}', True), ('{"x":{"invoice_data":null}}', True),
    ('{"invoice_data":{"Invoice Number":null}}', False), ('["invoice_data",null]', False), ('["invoice_data":null]', False),
    ('{"line_items":[]}', False), ('"invoice_data":null', False), (None, None)])
def test_null_header_object(spark, answer, null):
    got = spark.createDataFrame([(answer,)], "a string").select(M._no_header(F.col("a")).alias("n"))
    assert got.first().n is null


def test_null_header_is_found_by_short_searches(spark):
    """No pattern that reads an answer to its end and comes back: that took most of the time of the chunked answers."""
    plan = spark.range(1).select(F.col("id").cast("string").alias("a")).where(M._no_header(F.col("a")))._jdf.queryExecution().toString()
    assert "invoice_data" in plan and "[\\s\\S]*" not in plan


def test_escaped_error_name_is_read(spark):
    rows = [(1, '{"err\\u006fr":"no table"}', "no table"), (2, '{"error":"none"}', "none"), (3, '{"invoice_data":{}}', None)]
    r = spark.createDataFrame([(k, "openai", 200, json.dumps({"choices": [{"message": {"content": a}}]})) for k, a, _ in rows],
                              "doc_key bigint, provider string, http_status int, body string")
    assert {x.doc_key: x.error for x in M.unwrap(r).collect()} == {k: e for k, _, e in rows}
