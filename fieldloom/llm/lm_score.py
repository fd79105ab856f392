"""Stupid-backoff language-model scores (operator 2).

The model is the corpus itself: for each order k the table of its k-grams and
their counts, partitioned by hash.  A word's score is count(k-gram) / count(its
first k-1 words) at the highest order whose k-gram occurs at least ``MIN_COUNT``
times, times ``ALPHA`` for each order it backs off; single words score count / N.
A document's score is the sum of the logarithms over its words.

Relationally, for each order: documents are exploded to their k-grams, k-grams
and tables meet by hash, and what comes back is summed per document.  To keep
hundreds of rows per document out of the shuffles, rows are packed: documents
come in batches of ``BATCH_BYTES``, a row holds the distinct k-gram hashes of one
batch that fall into one hash range with their counts, the range's task adds up
the table and answers each row with the totals.  The answers meet their batch
again by its id, where they are laid over the words and summed.

Scale: one table entry per batch and k-gram, so a word or passage in every
document is pre-aggregated before it is shuffled; hash ranges follow the input's
size (``RANGE_BYTES`` of text each); one order is shuffled at a time.

Words are separated by ASCII white space, with A-Z lower-cased.  Defined cases:
NULL text or text without a word has 0 words, sum 0 and a NULL mean; the first
words of a document score at the orders their history allows; repeated rows count
and are scored each; NULL doc_id is kept; an empty table gives no rows; other
columns are ignored; texts of any length are whole.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import documents, release, stored

ORDER = 3
ALPHA = 0.4
MIN_COUNT = 2
BATCH_BYTES = 1 << 20
BATCH_DOCS = 512
RANGE_BYTES = 8 << 20
CHUNK = 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def _byte_codes() -> np.ndarray:
    codes = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    codes[65:91] = codes[97:123]
    return codes


class Words:
    """Word hashes of byte strings, computed on arrays."""

    def __init__(self):
        self.codes, self.up = _byte_codes(), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(2 * n, x)], dtype=np.uint64) for x in (_ODD, _INVERSE))

    def _of_part(self, b: np.ndarray) -> np.ndarray:
        space = np.r_[True, _SPACE[b], True]
        edge = np.diff(space.astype(np.int8))
        first, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self._powers(len(b) + 1)
        sums = np.r_[np.uint64(0), np.cumsum(self.codes[b] * self.up[:len(b)], dtype=np.uint64)]
        return _mix((sums[end] - sums[first]) * self.down[first] + (end - first).astype(np.uint64) * _ODD)

    def of(self, data: bytes) -> np.ndarray:
        """Hashes of the words of one text, in order."""
        b, out, at = np.frombuffer(data, np.uint8), [], 0
        while at < len(b):
            end = min(len(b), at + CHUNK)
            while end < len(b) and not _SPACE[b[end]]:  # not inside a word
                end += 1
            out.append(self._of_part(b[at:end]))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes of a batch, the place of each word in its text, and the words per text."""
        each = [self.of(t.encode()) for t in texts]
        sizes = np.array(list(map(len, each)), np.int64)
        flat = np.concatenate([np.zeros(0, np.uint64), *each])
        return flat, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), sizes


def grams(words: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the last word, and hash, of every k-gram."""
    last = np.flatnonzero(place >= k - 1)
    h = words[last]
    for j in range(1, k):
        h = _mix(h * _ODD + words[last - j])
    return last, h


def _packed(x: np.ndarray) -> bytes:
    """Counts in the smallest integer type that holds them, named by the first byte."""
    kind = np.min_scalar_type(int(x.max()))
    return kind.char.encode() + x.astype(kind).tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.dtype(x[:1].decode()), offset=1).astype(np.int64)


@contextmanager
def _arrow_rows(spark: SparkSession, n: int):
    """Python tasks get ``n`` rows at a time: a row is a batch of documents here."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, n)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _batches(docs: DataFrame) -> DataFrame:
    """One row per batch of documents: batch, doc_ids, texts, n_bytes, n_words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(ids: list, texts: list, size: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().bytes], pa.binary()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([texts], pa.list_(pa.string())), pa.array([size], pa.int64()),
                 pa.array([sum(len(t.encode().split()) for t in texts)], pa.int64())],
                names=["batch", "doc_ids", "texts", "n_bytes", "n_words"])

        ids: list = []
        texts: list = []
        size = 0
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                t = t.as_py() or ""
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= BATCH_BYTES or len(ids) >= BATCH_DOCS:
                    yield packed(ids, texts, size)
                    ids, texts, size = [], [], 0
        if ids:
            yield packed(ids, texts, size)

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "batch binary, doc_ids array<long>, texts array<string>, n_bytes long, n_words long")
    return stored(rows, "lm-batches", **{"parquet.block.size": 8 << 20})  # from here on a batch keeps its id


def _counted(batches: DataFrame, k: int, ranges: int) -> DataFrame:
    """(k, batch, range, totals): for each batch the corpus counts of its distinct k-grams, in hash order."""
    def explode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in rows:
            for row in range(b.num_rows):
                distinct, n = np.unique(grams(*words.batch(b.column("texts")[row].as_py())[:2], k)[1], return_counts=True)
                if not len(distinct):
                    continue
                part = ((distinct >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                at = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
                cut = [slice(x, y) for x, y in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[at[:-1]].astype(np.int32)), pa.array([b.column("batch")[row].as_py()] * len(cut), pa.binary()),
                     pa.array([distinct[c].tobytes() for c in cut], pa.binary()),
                     pa.array([n[c].astype(np.uint32).tobytes() for c in cut], pa.binary())], names=["range", "batch", "hashes", "n"])

    def count(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")]
        n = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("n")])
        _, at = np.unique(np.concatenate(hashes), return_inverse=True)
        totals = np.bincount(at, weights=n)[at].astype(np.int64)
        ends = np.cumsum(list(map(len, hashes)))
        out = [_packed(totals[e - len(h):e]) for h, e in zip(hashes, ends)]
        return pa.table({"k": pa.array([k] * len(out), pa.int32()), "batch": table.column("batch"),
                         "range": table.column("range"), "totals": pa.array(out, pa.binary())})

    sent = batches.select("batch", "texts").mapInArrow(explode, "range int, batch binary, hashes binary, n binary")
    return stored(sent.groupBy("range").applyInArrow(count, "k int, batch binary, range int, totals binary"), f"lm-counts-{k}")


def scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """doc_id, n_words, log_score (sum of ln S), mean_score (per word) for each document."""
    spark = docs.sparkSession
    batches = _batches(docs)
    size = batches.agg(F.sum("n_bytes"), F.sum("n_words")).first()
    ranges, n_words = max(1, math.ceil((size[0] or 0) / RANGE_BYTES)), size[1] or 0
    answers = None
    for k in range(1, order + 1):
        with _arrow_rows(spark, 4):
            a = _counted(batches, k, ranges)
        answers = a if answers is None else answers.unionByName(a)
        release(spark)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Words()
        for b in rows:
            for row in range(b.num_rows):
                texts, ids = b.column("texts")[row].as_py(), b.column("doc_ids")[row].as_py()
                words, place, sizes = hashed.batch(texts)
                got: dict[int, list[tuple[int, bytes]]] = {}
                for a in b.column("answers")[row].as_py() or []:
                    got.setdefault(a["k"], []).append((a["range"], a["totals"]))
                best = np.zeros(len(words))
                shorter = np.full(len(words), float(n_words))
                for k in range(1, order + 1):
                    last, h = grams(words, place, k)
                    if not len(last):
                        break
                    totals = np.concatenate([_unpacked(t) for _, t in sorted(got[k])])
                    n = totals[np.unique(h, return_inverse=True)[1]].astype(float)
                    context = shorter[last - 1] if k > 1 else shorter[last]
                    here = np.log(n) - np.log(context)
                    best[last] = np.where(n >= min_count, here, best[last] + math.log(alpha)) if k > 1 else here
                    shorter = np.ones(len(words))
                    shorter[last] = n
                sums = np.zeros(len(texts))
                if len(words):
                    sums[sizes > 0] = np.add.reduceat(best, np.flatnonzero(place == 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()),
                     pa.array(np.divide(sums, sizes, out=np.zeros(len(sums)), where=sizes > 0), pa.float64(), mask=sizes == 0)],
                    names=["doc_id", "n_words", "log_score", "mean_score"])

    per = answers.groupBy("batch").agg(F.collect_list(F.struct("k", "range", "totals")).alias("answers"))
    out = batches.select("batch", "doc_ids", "texts").join(per, "batch", "left").select("doc_ids", "texts", "answers") \
        .mapInArrow(run, "doc_id long, n_words long, log_score double, mean_score double")
    with _arrow_rows(spark, 4):
        return stored(out, "lm-scores")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scores(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_score", 6).alias("mean_score"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (SELECT rn, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM d),
t AS (SELECT rn, i, w, lag(w) OVER (PARTITION BY rn ORDER BY i) AS v, lag(w, 2) OVER (PARTITION BY rn ORDER BY i) AS u FROM p),
c1 AS (SELECT w, count(*) AS n FROM t GROUP BY 1),
c2 AS (SELECT v, w, count(*) AS n FROM t WHERE v IS NOT NULL GROUP BY 1, 2),
c3 AS (SELECT u, v, w, count(*) AS n FROM t WHERE u IS NOT NULL GROUP BY 1, 2, 3),
s AS (
  SELECT t.rn, CASE
      WHEN c3.n >= {MIN_COUNT} THEN ln(c3.n) - ln(x2.n)
      ELSE CASE WHEN t.u IS NULL THEN 0 ELSE ln({ALPHA}) END + CASE
        WHEN c2.n >= {MIN_COUNT} THEN ln(c2.n) - ln(x1.n)
        ELSE CASE WHEN t.v IS NULL THEN 0 ELSE ln({ALPHA}) END + ln(c1.n) - ln((SELECT count(*) FROM t)) END END AS ls
  FROM t JOIN c1 ON c1.w = t.w
  LEFT JOIN c2 ON c2.v = t.v AND c2.w = t.w LEFT JOIN c1 x1 ON x1.w = t.v
  LEFT JOIN c3 ON c3.u = t.u AND c3.v = t.v AND c3.w = t.w LEFT JOIN c2 x2 ON x2.v = t.u AND x2.w = t.v)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, round(coalesce(sum(ls), 0), 4) AS log_score,
       round(sum(ls) / nullif(len(ws), 0), 6) AS mean_score
FROM d LEFT JOIN s USING (rn) GROUP BY d.rn, d.doc_id, ws
"""
