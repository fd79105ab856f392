"""The party dictionary as a table agrees with testing every name of a list."""
from pyspark.sql import functions as F

from fieldloom.operators.header import known_party_line
from fieldloom.operators.parties import known_parties
from tests.conftest import docs

NAMES = ["Myntra Jabong", "India Pvt Ltd", "ab", "Jabong", "Acme Traders Ltd", "Acme Trading", "é", "jabong"]
TEXTS = ["To\n  xJabongy Ltd \nmyntra jabong", "INDIA PVT LTD\nAcme Traders Ltd", "acme tradin\ncab", "Acme Trading Co", "nothing", "", "É x", "x\nJABONG\nJabong", None]


def test_table_equals_list(spark):
    d = docs(spark, *TEXTS)
    parties = spark.createDataFrame([(n, i) for i, n in enumerate(NAMES)] + [("", 0), (None, 1)], "name string, rank long")
    got = {r.doc_key: r.line for r in known_parties(d, parties).collect()}
    want = d.select("doc_key", known_party_line(F.col("text"), NAMES).alias("line")).collect()
    assert got == {r.doc_key: r.line for r in want if r.line is not None}
    assert known_parties(d, parties.where("false")).count() == 0


def test_many_names_meet_few_texts(spark):
    """The plan doesn't grow with the names, and a word that all names share proposes nothing."""
    clients = lambda n: spark.range(n).select(F.format_string("Client %06d Private Limited", F.col("id")).alias("name"), F.col("id").alias("rank"))
    d = docs(spark, *[f"Bill to\nclient {7 * i:06d} private limited\nClient {i:06d}" for i in range(50)])
    out = known_parties(d, clients(100_000))
    assert {r.doc_key: r.party for r in out.collect()} == {i: f"client {7 * i:06d} private limited" for i in range(50)}
    few = known_parties(d, clients(10))
    lines = lambda x: len(x._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    assert lines(out) == lines(few)


def test_only_runs_of_names_are_shuffled(spark):
    """A run that no name is filed under is left out by a broadcast before any exchange by key."""
    parties = spark.createDataFrame([("acme traders", 1)], "name string, rank long")
    text = "x".join(f"{i:05d}" for i in range(200)) + "\nAcme Traders Ltd"
    out = known_parties(docs(spark, text), parties)
    assert [(r.party, r.line) for r in out.collect()] == [("acme traders", "Acme Traders Ltd")]
    assert "LeftSemi, BuildRight" in out._jdf.queryExecution().executedPlan().toString()


def test_texts_are_rendered_once_and_not_shuffled(spark):
    """What meets is verified in its line, and only runs of names are shuffled, not those that share a digest cut to few values."""
    clients = spark.range(20_000).select(F.format_string("Client %06d", F.col("id")).alias("name"), F.col("id").alias("rank"))
    d = docs(spark, "Client 000007 x\n" + "y" * 900 + "\nclient 000003", "ient 000003 client 00000", None)
    out = known_parties(d, clients)
    assert [tuple(r) for r in out.collect()] == [(0, "client 000003", "client 000003")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "regexp_extract_all(lower(line" in plan and "(.{12})" in plan
