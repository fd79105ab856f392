"""Listing and quarantine, the status store, dead letters, record tables, duplicates across arrivals."""
import os

from pyspark.sql import functions as F

from fieldloom.sources import assemble as A
from fieldloom.sources import sink as S
from fieldloom.streaming import jobs as J
from fieldloom.streaming.status_store import StatusStore, stream_status
from tests.conftest import docs

EVENT = "job_id string, file_id string, seq long, status string"


def test_files_are_listed_without_their_contents(spark, tmp_path):
    for job, name, text in (("j1", "a.pdf", "12345"), ("j1", "b.txt", "t"), ("j2", "empty.pdf", ""), ("j2", "c.pdf", "x" * 3000)):
        (tmp_path / job).mkdir(exist_ok=True)
        (tmp_path / job / name).write_text(text)
    files = A.list_files(spark, str(tmp_path))
    assert {(r.job_id, r.path.rsplit("/", 1)[-1], r.length) for r in files.collect()} == {
        ("j1", "a.pdf", 5), ("j1", "b.txt", 1), ("j2", "c.pdf", 3000)}
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    good, bad = A.admit_or_quarantine(files, S.scratch_path(spark, "quarantine"))
    assert [(r.job_id, r.filename, r.length) for r in good.collect()] == [("j2", "c.pdf", 3000)]
    assert {(r.filename, r.reason) for r in bad.collect()} == {
        ("a.pdf", "another file of the batch was rejected"), ("b.txt", "name does not end in .pdf")}


def test_quarantine_of_nulls_and_of_nothing(spark):
    schema = "path string, job_id int, note string"
    rows = spark.createDataFrame([(None, 1, "n"), ("/a/x.pdf", 1, "x"), ("/b/y.pdf", None, "y"), ("/b/y.pdf", None, "y")], schema)
    good, bad = A.admit_or_quarantine(rows, S.scratch_path(spark, "quarantine"))
    assert [(r.path, r.job_id, r.note) for r in good.collect()] == [("/b/y.pdf", None, "y")] * 2
    assert {(r.path, r.job_id) for r in bad.collect()} == {(None, 1), ("/a/x.pdf", 1)}
    good, bad = A.admit_or_quarantine(spark.createDataFrame([], schema), S.scratch_path(spark, "quarantine"))
    assert good.count() == bad.count() == 0


def _view(store, job=None):
    return sorted(((r.job_id, r.file_id, r.seq, r.status, r.n_events) for r in store.latest(job).collect()), key=repr)


def test_store_shows_whole_batches_only(spark):
    path = S.scratch_path(spark, "store")
    store = StatusStore(spark, path, EVENT)
    assert _view(store) == [] and store.compact() == -1
    one = spark.createDataFrame([("j", "a", 0, "processing"), ("j", "b", 0, "processing"), (None, None, None, "odd"), ("", "a", 0, "new")], EVENT)
    two = spark.createDataFrame([("j", "a", 1, "completed"), ("k", "a", 0, "processing")], EVENT)
    assert store.append(one, 0)
    first = [("j", "a", 0, "processing", 1), ("j", "b", 0, "processing", 1), ("", "a", 0, "new", 1), (None, None, None, "odd", 1)]
    assert _view(store) == sorted(first, key=repr)
    two.write.parquet(f"{path}/log/batch=1")  # a writer that broke off before its commit
    assert _view(store) == sorted(first, key=repr)
    assert store.append(two, 1) and not store.append(two, 1)  # written anew, and not twice
    second = sorted([("j", "a", 1, "completed", 2), *first[1:], ("k", "a", 0, "processing", 1)], key=repr)
    before = store.latest()
    assert _view(store) == second and store.compact() == 1
    again = StatusStore(spark, path, EVENT)  # another session's object on the same folder
    assert _view(again) == second and _view(again, "j") == [r for r in second if r[0] == "j"]
    assert again.append(spark.createDataFrame([("j", "b", 1, "failed")], EVENT), 2)
    assert ("j", "b", 1, "failed", 2) in _view(store)
    assert store.compact() == 2 and ("j", "b", 1, "failed", 2) in _view(store)
    assert before.count() == len(second)  # a frame of the older version still reads it
    assert store.events().count() == 7


def test_view_after_every_batch_equals_recomputation(spark, sf001):
    ev = spark.read.parquet(f"{sf001}/events.parquet").select(
        F.lit("log").alias("job_id"), F.col("user_id").cast("string").alias("file_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"), F.col("event_type").alias("status"))
    base = S.scratch_path(spark, "live")
    ev.repartition(5).write.parquet(f"{base}/in")
    store, sizes = StatusStore(spark, f"{base}/store", EVENT), []

    def seen(batch):
        log = store.events()
        want = J.latest_status(log).select("file_id", "status", "n_events")
        got = store.latest("log").select("file_id", "status", "n_events")
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
        sizes.append(log.count())

    def run():
        source = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        stream_status(store, source, f"{base}/checkpoint", compact_every=2, seen=seen)

    run()
    run()  # a restart finds nothing new
    assert len(sizes) == 5 and sizes[-1] == ev.count() and sizes == sorted(sizes)
    assert os.path.isdir(f"{base}/store/snapshots/upto=3")


def test_dead_letters_are_replayed_without_duplicates(spark):
    base = S.scratch_path(spark, "dead")
    texts = ["Invoice No: A1\n", "no number here", "", None, "Invoice Number: A2\n"]
    docs(spark, *texts).repartition(2).write.parquet(f"{base}/in")
    J.stream_extract(spark, f"{base}/in", f"{base}/out", f"{base}/ck", profile="minimal", max_files_per_trigger=1)
    dead = {r.doc_key: r.text for r in spark.read.parquet(f"{base}/out/dead").collect()}
    headers = spark.read.parquet(f"{base}/out/headers")
    assert headers.count() == len(texts) and set(dead) == {r.doc_key for r in headers.collect() if not r.invoice_document_number.strip()}
    assert dead[1] == texts[1] and 3 in dead
    for profile in ("simple", "simple", "minimal", "simple"):
        left = {r.doc_key for r in J.replay_dead_letters(spark, f"{base}/out", profile).collect()}
        now = J.extracted_headers(spark, f"{base}/out").collect()
        assert sorted(r.doc_key for r in now) == list(range(len(texts)))
        assert left == {r.doc_key for r in now if not r.invoice_document_number.strip()}
        if profile == "minimal":
            assert left == set(dead)


def test_record_tables_join_without_an_exchange(spark):
    h = docs(spark, "a", "b", "c").select("doc_key", F.col("text").alias("name"))
    i = spark.createDataFrame([(0, 1, "p"), (0, 2, "q"), (2, 1, "r")], "doc_key bigint, line_number int, name string")
    path = S.scratch_path(spark, "records")
    name = "t_" + path.rsplit("/", 1)[-1]
    S.write_record_tables(h, i, name, path, buckets=4)
    got = S.read_record_tables(spark, name)
    assert {(r.doc_key, r.name, r.line_number, r.item_name) for r in got.collect()} == {
        (0, "a", 1, "p"), (0, "a", 2, "q"), (1, "b", None, None), (2, "c", 1, "r")}
    counts = got.groupBy("doc_key").count()
    for df in (got, counts):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_first_arrivals_within_a_time(spark):
    schema = "doc_key long, arrived timestamp, supplier_gstin string, invoice_document_number string"
    day = lambda k, d, s, n: (k, d * 86400, s, n)
    parts = [[day(1, 1, "s", "A"), day(2, 1, "s", " "), day(3, 1, None, "A"), day(4, 1, "s", None)],
             [day(5, 2, "s", "A"), day(6, 2, "t", "A"), day(7, 2, "s", " "), day(8, 2, None, "A")],
             [day(9, 90, "s", "Z")], [day(12, 91, "s", "Y")], [day(10, 92, "s", "A"), day(11, 92, "s", "A")]]
    base = S.scratch_path(spark, "arrivals")
    for p in parts:
        spark.createDataFrame(p, schema.replace("timestamp", "long")).withColumn("arrived", F.timestamp_seconds("arrived")) \
            .coalesce(1).write.mode("append").parquet(f"{base}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    J.first_arrivals(source, within="30 days").writeStream.format("parquet").option("checkpointLocation", f"{base}/ck") \
        .trigger(availableNow=True).start(f"{base}/kept").awaitTermination()
    kept = spark.read.parquet(f"{base}/kept")
    ids = {r.doc_key for r in kept.collect()}
    # A is new again once a batch behind the watermark (day 60 from the third batch on) has freed it
    assert ids - {10, 11} == {1, 3, 6, 9, 12} and len(ids & {10, 11}) == 1
    dropped = {r.doc_key for r in J.dropped_arrivals(spark.read.parquet(f"{base}/in"), kept).collect()}
    assert dropped == {5, 8} | ({10, 11} - ids)
