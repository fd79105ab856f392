"""Model answers by chunk, rendered from tables of their own."""
import datetime

from fieldloom.sources import answers as A
from fieldloom.sources.tables import Tables

DAY = datetime.datetime(1996, 1, 2)


def write_tables(spark, at, keys):
    """One order and line per key: the few columns that the renderer reads."""
    sf = str(at)
    spark.createDataFrame([(1, 3, "BUILDING")], "c_custkey bigint, c_nationkey int, c_mktsegment string").write.parquet(f"{sf}/customer.parquet")
    spark.createDataFrame([(1, 4)], "s_suppkey bigint, s_nationkey int").write.parquet(f"{sf}/supplier.parquet")
    spark.createDataFrame([(1, "green bolt", "Brand#11", 9.5)], "p_partkey bigint, p_name string, p_brand string, p_retailprice double") \
        .write.parquet(f"{sf}/part.parquet")
    spark.createDataFrame([(k, 1, 100.0 + k, DAY) for k in keys], "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp") \
        .write.parquet(f"{sf}/orders.parquet")
    spark.createDataFrame([(k, 1, 1, 1, 2.0, 19.0, 0.0, 0.05, DAY) for k in keys],
                          "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double, l_shipdate timestamp").write.parquet(f"{sf}/lineitem.parquet")
    return Tables(spark, sf)


def test_retried_chunks_need_no_second_pass(spark, tmp_path):
    t = write_tables(spark, tmp_path, [1, 2, 3, 4])  # % 19 = 1: the first chunk failed once; % 17 = 3: all failed
    requests = A.chunk_requests(t)
    responses = A.render_chunk_responses(t, requests)
    asked = requests.count()
    rows = responses.collect()
    assert len(rows) == asked + 1
    assert [(r.chunk_no, r.body) for r in rows if r.http_status == 504] == [(0, None)]
    assert sorted(r.http_status for r in rows if r.doc_key == 1 and r.chunk_no == 0) == [200, 504]
    assert {(r.http_status, r.body) for r in rows if r.doc_key == 3} == {(500, None)}
    # the lines are read for the requests' texts and for the answers' items, and not again for the retries
    plan = responses._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linenumber") > 0 and "Union" not in plan
    assert sum("Relation [" in x and "l_orderkey" in x for x in plan.splitlines()) == 2


def test_missing_chunks_join_without_the_answers(spark, tmp_path):
    """The join by chunk shuffles its rows: they say whether there is an answer, and don't carry it."""
    from fieldloom.operators import model_io as M
    t = write_tables(spark, tmp_path, [3, 4, 5, 6])
    requests = A.chunk_requests(t)
    n = {r.doc_key: r.n_chunks for r in requests.collect()}
    missing = M.missing_chunks(requests, A.render_chunk_responses(t, requests))
    got = sorted((r.doc_key, r.chunk_no, r.reason) for r in missing.collect())
    assert got == sorted([(3, c, "API error: 500 - ") for c in range(n[3])] + [(5, 1, "no response"), (6, n[6] - 1, "API error: 500 - ")])
    body = '{"choices":[{"message":{"content":"{\\"line_items\\":[]}"}}]}'
    asked = spark.createDataFrame([(1, 0, 2, None), (1, 1, 2, None), (2, 0, 1, "x"), (3, 0, 1, None)], "doc_key bigint, chunk_no int, n_chunks int, error string")
    answers = spark.createDataFrame([(1, "openai", 0, 200, body), (1, "openai", 1, 200, "{}")], "doc_key bigint, provider string, chunk_no int, http_status int, body string")
    m = M.missing_chunks(asked, answers)
    assert sorted((r.doc_key, r.chunk_no, r.reason) for r in m.collect()) == [(1, 1, M.ERR_FORMAT["openai"]), (2, 0, "x"), (3, 0, "no response")]
    plan = m._jdf.queryExecution().optimizedPlan()
    joins = [p for p in [plan.children().apply(0)] if p.nodeName() == "Filter"] or [plan]
    join = joins[0].children().apply(0)
    assert join.nodeName() == "Join" and [a.name() for a in _each(join.children().apply(1).output())] == ["doc_key", "chunk_no", "_usable", "_error"]


def _each(seq):
    return [seq.apply(i) for i in range(seq.length())]
