"""A status store that can be read while a job writes it.

Events are kept as a log of batches and, now and then, a snapshot of the latest state per file::

    log/batch=<n>          events of one micro-batch
    snapshots/upto=<n>     latest state per (job, file) after batch n, in their order
    commits/log-<n>        one line, written after the batch is complete
    commits/snapshot-<n>   one line, written after the snapshot is complete

A folder counts from its commit on and is not changed afterwards, so a reader never meets a
half-written batch and a frame made before a compaction still gives the same rows after it.  A
batch that is replayed after its commit changes nothing; one that broke off before is written anew.

The driver reads the commit lines only: one per batch and snapshot.  States are merged with
``max_by`` in a partially aggregated ``groupBy``, so a file with very many events is
reduced in every task first.

Defined cases: a store without commits has no rows; events equal in ``seq`` are ordered by
their status; a NULL ``file_id`` or ``job_id`` is a value like any other; a NULL ``seq`` comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEYS = ("job_id", "file_id")


class StatusStore:
    """Events of ``schema``: job_id, file_id, seq, status and any more columns."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType):
        self.spark, self.path = spark, path.rstrip("/")
        empty = spark.createDataFrame([], schema)
        self.fields = empty.columns
        self.state = [c for c in self.fields if c not in KEYS]
        self.empty = empty
        spark.createDataFrame([("open", -1)], "kind string, batch long").coalesce(1) \
            .write.mode("ignore").json(f"{self.path}/commits/open")

    def _commits(self, kind: str) -> list[int]:
        got = self.spark.read.schema("kind string, batch long").json(f"{self.path}/commits/*")
        return sorted(r.batch for r in got.where(F.col("kind") == kind).distinct().collect())

    def _commit(self, kind: str, batch: int) -> None:
        self.spark.createDataFrame([(kind, batch)], "kind string, batch long").coalesce(1) \
            .write.mode("overwrite").json(f"{self.path}/commits/{kind}-{batch}")

    def append(self, events: DataFrame, batch: int) -> bool:
        """Adds a batch; False if it is there already."""
        if batch in self._commits("log"):
            return False
        events.select(*self.fields).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")
        self._commit("log", batch)
        return True

    def _log(self, after: int) -> DataFrame:
        paths = [f"{self.path}/log/batch={b}" for b in self._commits("log") if b > after]
        return self.spark.read.schema(self.empty.schema).parquet(*paths) if paths else self.empty

    def events(self) -> DataFrame:
        """Every committed event."""
        return self._log(-1)

    def _order(self) -> Column:
        return F.struct("seq", "status")

    def _states(self) -> DataFrame:
        """A row for the newest snapshot's states and one for each later event; ``_n``: events behind it."""
        upto = max(self._commits("snapshot"), default=-1)
        rows = self._log(upto).withColumn("_n", F.lit(1).cast("long"))
        if upto < 0:
            return rows
        kept = self.spark.read.schema(rows.schema).parquet(f"{self.path}/snapshots/upto={upto}")
        return kept.select(*rows.columns).unionByName(rows)

    def _merge(self, rows: DataFrame) -> DataFrame:
        last = F.max_by(F.struct(*self.state), self._order()).alias("_l")
        return rows.groupBy(*KEYS).agg(last, F.sum("_n").alias("_n")) \
            .select(*KEYS, *[F.col(f"_l.{c}").alias(c) for c in self.state], "_n")

    def latest(self, job_id: str | None = None) -> DataFrame:
        """The latest state of every file, of one job or of all, with ``n_events``.
        A snapshot is in the order of jobs, so one job is read from few of its files and row groups."""
        rows = self._states()
        if job_id is not None:
            rows = rows.where(F.col("job_id") == job_id)
        return self._merge(rows).withColumnRenamed("_n", "n_events")

    def compact(self) -> int:
        """Writes the states after the last committed batch as a snapshot; its number, -1 if there is no batch."""
        batches = self._commits("log")
        if not batches:
            return -1
        upto = batches[-1]
        if upto not in self._commits("snapshot"):
            self._merge(self._states()).repartitionByRange(*KEYS).sortWithinPartitions(*KEYS) \
                .write.mode("overwrite").parquet(f"{self.path}/snapshots/upto={upto}")
            self._commit("snapshot", upto)
        return upto


def stream_status(store: StatusStore, events: DataFrame, checkpoint: str, compact_every: int = 16, seen=None) -> None:
    """A stream of status events into the store, visible batch by batch; runs until the files there are done.

    A snapshot follows every ``compact_every`` batches, so a reader merges no more than that many.
    ``seen(batch)`` is called after each commit.
    """

    def write_batch(batch: DataFrame, number: int) -> None:
        store.append(batch, number)
        if (number + 1) % compact_every == 0:
            store.compact()
        if seen is not None:
            seen(number)

    events.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start().awaitTermination()
