"""All registered queries and oracles, merged from the topic modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.plans import answer_queries, extract_queries, flow_queries, model_queries

QUERIES = {}
ORACLE = {}
for _m in (extract_queries, model_queries, answer_queries, flow_queries):
    QUERIES.update(_m.QUERIES)
    ORACLE.update(_m.ORACLE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices -> simple headers ⋈ layout items -> reconciliation per document."""
    return flow_queries.q_reconcile(spark, sf_dir)
