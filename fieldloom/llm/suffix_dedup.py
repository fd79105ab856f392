"""Repeated-substring removal by distributed prefix doubling (operator 7).

Every byte that lies in a string of ``LENGTH`` bytes which also starts elsewhere
is removed.  Ranking all byte positions would shuffle many times the input, so
the doubling runs over content-defined blocks:

 1. Sampling: of each run of ``RUN`` positions, the one whose ``GRAM`` bytes have
    the smallest hash is a block start.  Equal strings of ``LENGTH`` bytes have the
    same starts inside, at least two of them.  A block reaches from its start to
    ``GRAM`` bytes into the next; its first rank is a hash of its bytes.
 2. Doubling: positions with a rank of their own drop out.  The others join
    their rank with those of the block sequences that follow, and these tuples are
    ranked anew, at offsets eight times as far each round, until a position is
    unique or its sequence is ``LENGTH`` bytes long.  A sequence that long which
    still is not unique is repeated as a whole.  (It is ranked at ``GROWN`` bytes
    as well, so that the windows inside a long repeat all lie in one.  Eight instead of two: a round
    costs a shuffle by text and two by rank, and most sequences need four blocks.)
 3. Ends: a repeated string may reach beyond whole blocks, by less than a block.
    Windows of ``LENGTH`` bytes all of whose blocks are repeated, but that no
    repeated sequence holds, are compared by their own hashes, with each other
    and with the windows of one representative of each repeated sequence.

Everything is keyed by distinct text: copies are counted, and of a text that
occurs twice all bytes go (if there are ``LENGTH`` of them).

Scale: a position costs some 20 bytes for one in ``RUN`` / 2 positions, and only
positions that are not unique reach the rounds; ranks are counted map-side first,
so a passage in a third of all documents is a row per task, and the joins back
are equi-joins that adaptive execution splits.  What is gathered per document is
bounded by its length.  Texts are told apart by 128 bits, block ranks and window
hashes by 64: of n different strings of ``LENGTH`` bytes, some n * n / 2**65 pairs are taken for equal.

Defined cases: NULL and empty texts have 0 bytes and nothing removed; texts under
``LENGTH`` bytes stay; matches never cross documents; bytes are judged on the
input; repeated rows are copies of each other; NULL doc_id is kept; an empty
table gives no rows; other columns are ignored; texts of any length are whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import digest128, documents, release, stored, text_of

LENGTH = 200
GRAM = 16                   # a power of two
RUN = 92                    # 2 * RUN + GRAM <= LENGTH + 1: two starts inside every window
FOLLOWERS = 7               # sequences that a round appends to each, at most
GROWN = LENGTH + RUN - 1    # a repeated sequence this long holds every window that starts in its first block
CHUNK = 1 << 23
PASSES = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x)], dtype=np.uint64) for x in (_ODD, _INVERSE))


class Sampled:
    """Block starts of one text and hashes of any of its substrings of at least ``GRAM`` bytes."""

    def __init__(self, data: bytes, powers: Powers):
        b = np.frombuffer(data, np.uint8)
        self.n, self.powers = len(b), powers
        h = _mix(b.astype(np.uint64) + np.uint64(1))
        width = 1
        while width < GRAM:
            h = _mix(h[:-width] * _ODD + h[width:])
            width *= 2
        self.least = np.concatenate([self._least(h[at:at + CHUNK + RUN - 1]) + at for at in range(0, len(h) - RUN + 1, CHUNK)])
        self.starts = self.least[np.r_[True, self.least[1:] != self.least[:-1]]]
        powers.grow(len(h) + 1)
        self.sums = np.r_[np.uint64(0), np.cumsum(h * powers.up[:len(h)], dtype=np.uint64)]

    @staticmethod
    def _least(h: np.ndarray) -> np.ndarray:
        """For each run of ``RUN`` positions, the first with the smallest hash (40 bits of it)."""
        m = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= RUN:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < RUN:
            m = np.minimum(m[:len(m) - (RUN - width)], m[RUN - width:])
        return (m & np.uint64(0xFFFFFF)).astype(np.int64)

    def hashes(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the substrings [first, end)."""
        s = (self.sums[end - GRAM + 1] - self.sums[first]) * self.powers.down[first]
        return _mix(_mix(s + (end - first).astype(np.uint64))).view(np.int64)

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and rank of each block."""
        a, e = self.starts[:-1], self.starts[1:] + GRAM
        return a, e, self.hashes(a, e)

    def windows(self, repeated: np.ndarray) -> np.ndarray:
        """Which windows have repeated blocks only; ``repeated``: their starts."""
        n = self.n - LENGTH + 1
        odd = np.r_[0, np.cumsum(~np.isin(self.starts[:-1], repeated))]
        first = np.searchsorted(self.starts, self.least[:n])
        last = np.searchsorted(self.starts, self.least[LENGTH + 1 - RUN - GRAM:][:n])
        return odd[last] == odd[first]


def _inside(n: int, spans: np.ndarray) -> np.ndarray:
    """Which of the ``n`` windows lie inside one of the spans (rows of start, end)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 1] - LENGTH + 1, -1)
    return np.cumsum(edge)[:n] > 0


def _lists(arrays: list[np.ndarray], dtype) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, dtype), *arrays]).astype(dtype)))


def _digest() -> list[Column]:
    return [h.alias(n) for h, n in zip(digest128("text"), ("_t1", "_t2"))]


def _texts(docs: DataFrame) -> DataFrame:
    t = docs.select(text_of().alias("text"))
    return t.where(F.octet_length("text") >= LENGTH).select(*_digest(), "text")


def _blocks(docs: DataFrame) -> DataFrame:
    """One row per distinct text: id, _t1, _t2, copies, and its blocks (a, e, r)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                b = batch.slice(start, 256)
                got = [Sampled(t.as_py().encode(), powers).blocks() for t in b.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [b.column("_t1"), b.column("_t2"), *[_lists([g[k] for g in got], d) for k, d in enumerate((np.int32, np.int32, np.int64))]],
                    names=["_t1", "_t2", "a", "e", "r"])

    rows = _texts(docs).mapInArrow(run, "_t1 long, _t2 long, a array<int>, e array<int>, r array<long>")
    one = rows.groupBy("_t1", "_t2").agg(F.count("*").alias("copies"), F.first(F.struct("a", "e", "r")).alias("_b"))
    return stored(one.select(F.monotonically_increasing_id().alias("id"), "_t1", "_t2", "copies", "_b.*"), "suffix-blocks")


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each short sequence of a text with up to ``FOLLOWERS`` that follow it, as far as ``LENGTH`` and ``GROWN`` bytes."""
    for batch in batches:
        out: list[tuple] = []
        for row in range(batch.num_rows):
            seq = batch.column("seq")[row].values
            a, e, r = (seq.field(c).to_numpy(zero_copy_only=False) for c in "aer")
            order = np.argsort(a)
            a, e, r = a[order].astype(np.int64), e[order].astype(np.int64), r[order].view(np.uint64)
            after = np.searchsorted(a, e - GRAM)  # the next sequence starts GRAM bytes before this one's end
            after[a[np.minimum(after, len(a) - 1)] != e - GRAM] = -1
            at = here = np.flatnonzero(e - a < LENGTH)
            name, end = r[at], e[at]
            found = []
            for goal in (LENGTH, GROWN):
                for _ in range(FOLLOWERS):
                    grow = end - a[at] < goal
                    keep = ~grow | (after[here] >= 0)  # a sequence with a unique follower is unique
                    at, here, name, end, grow = at[keep], here[keep], name[keep], end[keep], grow[keep]
                    here = np.where(grow, after[here], here)
                    name = np.where(grow, _mix(name * _ODD + r[here]), name)
                    end = e[here]
                found.append((a[at], end, name.view(np.int64)))
                more = (end - a[at] >= LENGTH) & (end - a[at] < GROWN)
                at, here, name, end = at[more], here[more], name[more], end[more]
            out.append(tuple(map(np.concatenate, zip(*found))))
        cols = list(zip(*out)) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([batch.column("id"), *[_lists(c, d) for c, d in zip(cols, (np.int32, np.int32, np.int64))]],
                                         names=["id", "a", "e", "r"])


def repeated_sequences(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repeated blocks, and repeated block sequences of ``LENGTH`` bytes or more: (id, a, e, r), both stored.

    ``blocks`` is deleted."""
    rows = lambda t: t.select("id", F.explode(F.arrays_zip("a", "e", "r")).alias("_b")).select("id", "_b.a", "_b.e", "_b.r")
    repeated = lambda t: t.select(F.explode("r").alias("r")).groupBy("r").count().where("count > 1").select("r")
    first = stored(rows(blocks).join(repeated(blocks), "r").select("id", "a", "e", "r"), "suffix-ranks")
    level = first
    short = F.col("e") - F.col("a") < LENGTH
    long, spark, done = first.where(~short), blocks.sparkSession, []
    release(spark, blocks)
    while not level.where(short).isEmpty():
        if level is not first:  # only texts that still have short sequences
            level = level.join(level.where(short).select("id").distinct(), "id", "left_semi")
        texts = level.repartition("id").groupBy("id").agg(F.collect_list(F.struct("a", "e", "r")).alias("seq"))
        grown = stored(texts.mapInArrow(_followed, "id long, a array<int>, e array<int>, r array<long>"), "suffix-grown")
        ranked = stored(rows(grown).join(repeated(grown), "r").select("id", "a", "e", "r"), "suffix-ranks")
        long = long.unionByName(ranked.where(~short))
        release(spark, grown)
        done.append(ranked)
        # sequences that are long enough stay as what may follow others
        level = ranked.unionByName(level.where(~short))
    long = stored(long, "suffix-long")
    release(spark, *done)
    return first, long


def _spans_per_text(blocks: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, spans): per text the repeated spans of bytes, not merged; ``texts``: id, _t1, _t2."""
    spark = docs.sparkSession
    first, long = repeated_sequences(blocks)
    chosen = long.groupBy("r").agg(F.min(F.struct("id", "a", "e")).alias("_m")).select("_m.*")  # one representative each
    marks = first.select("id", F.lit(0).alias("kind"), "a", "e") \
        .unionByName(long.select("id", F.lit(1).alias("kind"), "a", "e")) \
        .unionByName(chosen.select("id", F.lit(2).alias("kind"), "a", "e"))
    marks = marks.repartition("id").groupBy("id").agg(*[F.collect_list(F.when(F.col("kind") == k, F.struct("a", "e"))).alias(f"s{k}") for k in (0, 1, 2)]) \
        .select("id", *[F.col(f"s{k}.{c}").alias(f"{c}{k}") for k in (0, 1, 2) for c in ("a", "e")])
    marks = stored(marks, "suffix-marks")
    release(spark, first, long)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            out: list[tuple] = []
            for row in range(batch.num_rows):
                get = lambda c, row=row: batch.column(c)[row].values.to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: E731, B023
                s = Sampled(batch.column("text")[row].as_py().encode(), powers)
                n = s.n - LENGTH + 1
                whole = _inside(n, np.stack([get("a1"), get("e1")], 1))
                ends = np.flatnonzero(s.windows(get("a0")) & ~whole)
                chosen = np.flatnonzero(_inside(n, np.stack([get("a2"), get("e2")], 1)))
                edge = np.diff(np.r_[0, whole.astype(np.int8), 0])
                spans = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + LENGTH - 1
                out.append((batch.column("id")[row].as_py(), ends, s.hashes(ends, ends + LENGTH), s.hashes(chosen, chosen + LENGTH), *spans))
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), _lists(cols[1], np.int32), _lists(cols[2], np.int64), _lists(cols[3], np.int64),
                 _lists(cols[4], np.int32), _lists(cols[5], np.int32)], names=["id", "p", "h", "others", "a", "e"])

    one = _texts(docs).groupBy("_t1", "_t2").agg(F.first("text").alias("text"))
    work = one.join(texts.select("id", "_t1", "_t2").join(marks, "id"), ["_t1", "_t2"]).drop("_t1", "_t2")
    found = stored(work.mapInArrow(run, "id long, p array<int>, h array<long>, others array<long>, a array<int>, e array<int>"), "suffix-windows")
    del work, one
    release(spark, marks)
    hits = None
    for part in range(PASSES):  # of the hashes, one after another, to halve what is shuffled at once
        here = F.pmod(F.col("h"), F.lit(PASSES)) == part
        ends = found.select("id", F.explode(F.arrays_zip("p", "h")).alias("_w")).select("id", "_w.p", "_w.h").where(here)
        every = found.select(F.explode(F.concat("h", "others")).alias("h")).where(here)
        again = every.groupBy("h").count().where("count > 1").select("h")
        got = stored(ends.join(again, "h").select("id", "p"), "suffix-ends")
        hits = got if hits is None else hits.unionByName(got)
        del ends, every, again
        release(spark)
    ends = hits.groupBy("id").agg(F.collect_list("p").alias("_p"))
    span = lambda a, e: F.struct(a.cast("int").alias("a"), e.cast("int").alias("e"))
    spans = found.select("id", F.arrays_zip("a", "e").alias("_s")).join(ends, "id", "left")
    return spans.select("id", F.concat(F.transform("_s", lambda s: span(s["a"], s["e"])), F.coalesce(
        F.transform("_p", lambda p: span(p, p + LENGTH)), F.array())).alias("spans"))


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(data: bytes, a: np.ndarray, e: np.ndarray) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs, and what is left."""
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, a, 1)
    np.add.at(edge, e, -1)
    gone = np.cumsum(edge)[:len(data)] > 0
    return int(gone.sum()), int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum()), np.frombuffer(data, np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) per document."""
    blocks = _blocks(docs)
    texts = stored(blocks.select("id", "_t1", "_t2", "copies"), "suffix-texts")
    spans = _spans_per_text(blocks, texts, docs)
    cuts = texts.select("id", "_t1", "_t2", (F.col("copies") > 1).alias("whole")).join(spans, "id", "left") \
        .where("whole OR size(spans) > 0").select(F.col("_t1").alias("_x1"), F.col("_t2").alias("_x2"), "whole",
                                                  F.when(~F.col("whole"), F.col("spans.a")).alias("a"), F.when(~F.col("whole"), F.col("spans.e")).alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                data = batch.column("text")[row].as_py().encode()
                whole, a = batch.column("whole")[row].as_py(), batch.column("a")[row]
                if whole:
                    got = len(data), 1, b""
                elif a.is_valid:
                    got = _cut(data, *[batch.column(c)[row].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in "ae"])
                else:
                    got = 0, 0, data
                out.append((len(data), got[0], got[1], hashlib.sha256(got[2]).hexdigest(), got[2]))
            cols = list(zip(*out)) if out else [()] * 5
            types = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, types)]],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).select(
        "doc_id", "text", *_digest())
    joined = rows.join(cuts, (F.col("_t1") == F.col("_x1")) & (F.col("_t2") == F.col("_x2")), "left")
    return joined.select("doc_id", "text", "whole", "a", "e").mapInArrow(run, f"doc_id long, {RESULT}, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")
