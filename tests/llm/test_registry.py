"""The registered queries: oracles agree, the pipeline's stages do what they say."""
import pytest

import __spark_entry__ as E
import corpus_pipeline
from fieldloom.llm import registry
from fieldloom.llm.common import documents
from tests.oracle_check import duck, rows_of

SF = "/root/testdata/sf0.001"
NAMES = {1: "doc_id held_out lang_pred score", 4: "doc_id size source_size target taken", 5: "doc_id n_lines n_dropped kept_sha256",
         6: "doc_id n_shingles component_id kept", 7: "doc_id n_bytes n_removed n_spans kept_sha256",
         9: "doc_id n_bytes n_tokens over_limit",
         10: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"}


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_oracle(spark, name):
    df = E.queries()[name](spark, SF)
    s = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(SF).execute(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(c[0] for c in cur.description)
    assert s == rows_of([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("n", sorted(NAMES))
def test_contract_columns(spark, n):
    query = next(f for k, f in registry.QUERIES.items() if k.startswith(f"op{n}_"))
    df = query(spark, SF)
    assert df.columns[:len(NAMES[n].split())] == NAMES[n].split() or set(NAMES[n].split()) <= set(df.columns)
    assert df.count() == documents(spark, SF).count()


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near dedup", "decontamination", "mixing", "sharding"]
    docs = documents(spark, SF)
    ids = {r.doc_id for r in docs.collect()}
    judged = {r.doc_id for r in registry.QUERIES["op10_quality_rules"](spark, SF).where("kept").collect()}
    stage = docs
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, stage, SF)
        path = corpus_pipeline.scratch(spark, "t")
        out.write.parquet(path)
        before, stage = stage, spark.read.schema(out.schema).parquet(path)
        if name != "sharding":
            assert stage.columns == docs.columns
        now = {r.doc_id for r in stage.collect()}
        if name == "quality rules":
            assert now == judged
        assert now <= {r.doc_id for r in before.collect()} <= ids
    assert {"shard_id", "shard_bytes"} <= set(stage.columns) and stage.count() > 0
    again = corpus_pipeline.run(spark, SF)
    cols = ["doc_id", "shard_id"]
    assert sorted(map(tuple, again.select(cols).collect())) == sorted(map(tuple, stage.select(cols).collect()))
