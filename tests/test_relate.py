"""Relations within a document need no shuffle and equal those over exploded items."""
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import relate as R
from fieldloom.operators.items import extract_items
from fieldloom.plans.common import invoices
from fieldloom.streaming import jobs as J
from tests.conftest import docs

TEXT = "TAX INVOICE\nTaxable Value: 30\nSr No  Item Code\nA_1  red  6100  2 PCS  10.00  5%  20.00\nB_2  blue  6100  x PCS  10.00  5%  7.00\nC_3  green  6100  1 PCS  10.00  5%  10.00\nTotal 30"


@pytest.mark.parametrize("relation", [R.item_counts, R.first_item_of, R.reconcile_records])
def test_no_exchange(spark, relation):
    rec = R.document_records(docs(spark, TEXT, "", "no items", None), header_fields=["subtotal_taxable_value"])
    assert "Exchange" not in relation(rec)._jdf.queryExecution().executedPlan().toString()


def test_arrays_equal_exploded_items(spark, sf001):
    d = invoices(spark, sf001).unionByName(docs(spark, TEXT, "", "no items", None).withColumn("doc_key", -1 - F.col("doc_key")))
    rec = R.document_records(d, header_fields=[])
    items = extract_items(d, "layout")
    cols = ["doc_key", "line_number", "item_sku_code", "line_total_value"]
    got = rec.select("doc_key", F.explode("items").alias("i")).select("doc_key", "i.*")
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, items.select(cols).collect()))
    assert sorted(map(tuple, R.first_item_of(rec).collect())) == sorted(map(tuple, R.first_item(items).collect()))
    assert R.item_counts(rec).where("doc_key < 0 AND n_items > 0").count() == 1


@pytest.mark.parametrize("rows", [lambda d: extract_items(d, "layout"), lambda d: extract_items(d, "simple"),
                                  lambda d: R.first_item_of(R.document_records(d, header_fields=[]))])
def test_no_filter_builds_the_item_rows_again(spark, rows):
    plan = rows(docs(spark, TEXT, "", None))._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and ("lambda" in x or "regexp" in x or "RLIKE" in x)]


def test_large_input_lands_in_more_files(spark, tmp_path):
    d = spark.range(40).selectExpr("id AS doc_key", "concat('text ', id) AS text")
    few, many = J.land(d, f"{tmp_path}/few", rows=40, least=4, rows_per_file=10), J.land(d, f"{tmp_path}/many", rows=400, least=4, rows_per_file=10)
    assert (few, many) == (4, 40)
    for path, n in (("few", few), ("many", many)):
        back = spark.read.parquet(f"{tmp_path}/{path}")
        assert len(back.inputFiles()) <= n and sorted(r.doc_key for r in back.collect()) == list(range(40))
    assert len(spark.read.parquet(f"{tmp_path}/many").inputFiles()) > 4
