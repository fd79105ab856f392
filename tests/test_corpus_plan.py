"""Plan of the rendered corpus: what is shuffled by which key."""
import re

from fieldloom.sources.corpus import invoice_parts
from fieldloom.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def test_no_item_lines_are_shuffled_by_customer(spark):
    """Without broadcasts, as with large customer tables, customers join the order rows and not the documents."""
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        plan = invoice_parts(Tables(spark, SF))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if re.search(r"Exchange hashpartitioning\(o_custkey", line))
    depth = len(re.match(r"[\s:|+*-]*", lines[at]).group())
    below = []
    for line in lines[at + 1:]:
        if len(re.match(r"[\s:|+*-]*", line).group()) <= depth:
            break
        below.append(line)
    assert below and not any("l_orderkey" in line for line in below)
