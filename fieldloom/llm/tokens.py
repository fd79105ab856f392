"""Token counts behind a digest cache (operator 9).

The cache is a table (digest, tokenizer, n_tokens): the SHA-256 of the content
and the SHA-256 of the tokenizer's file.  A run joins the documents' digests to
it, encodes each distinct miss once and appends the new counts as files of their
own, so a cache that many runs share is never rewritten.

Texts travel once, by digest, and only those that miss; a text that a third of
all rows repeat is reduced to one row in each task before that.  Content is
normalised as the tokenizer itself does it (byte_bpe_50k has no normaliser), so
the digest is of the text's UTF-8 bytes, NULL being the empty text.

Encoding: the pattern that splits text before the merges never spans a single
space between two ordinary characters, so a text's count is the sum over the
pieces between such places.  Pieces repeat far more often than texts; each task
hands the library the pieces that it has not met and remembers their counts (the
last ``MEMORY`` to twice as many pieces).

Defined cases: NULL and empty text have 0 bytes and 0 tokens; repeated rows each
get their row; NULL doc_id is kept; an empty table gives no rows; other columns
are ignored; a text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import documents, scratch, text_of

LIMIT = 1024
VOCABULARY = "byte_bpe_50k.json"
MEMORY = 300_000
CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
#: Places that no piece of the pattern spans: before one space or line end between visible ASCII or
#: Latin characters, and between a letter and a stop.
BETWEEN = re.compile("(?<=[!-~À-ɏ])(?=[ \\n][!-~À-ɏ])|(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[.,;:!?])")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def version_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Counter:
    """Counts tokens as the ``tokenizers`` library does."""

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def _learn(self, pieces: set[str]) -> None:
        if len(self.known) > MEMORY:
            self.known, self.older = {}, self.known
        new = []
        for p in pieces:
            n = self.older.get(p)
            if n is None:
                new.append(p)
            else:
                self.known[p] = n
        for start in range(0, len(new), 4096):
            part = new[start:start + 4096]
            encoded = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.known.update(zip(part, map(len, encoded)))

    def count(self, texts: list[str]) -> list[int]:
        split = [BETWEEN.split(t) for t in texts]
        self._learn(set().union(*split) if len(self.known) > MEMORY else set().union(*split) - self.known.keys())
        get = self.known.__getitem__
        return [sum(map(get, p)) for p in split]


def _counts(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            n: list[int] = []
            for start in range(0, len(texts), 256):
                n += counter.count(texts[start:start + 256])
            yield pa.RecordBatch.from_arrays(
                [b.column("digest"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())],
                names=["digest", "tokenizer", "n_tokens"])
    return run


def digest_of(text):
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; an absent folder is an empty cache."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except (AnalysisException, Py4JJavaError) as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, cache: str, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per document; new counts are appended to ``cache``."""
    spark = docs.sparkSession
    path = path or vocabulary_path()
    version = version_of(path)
    texts = docs.select("doc_id", text_of().alias("text")).select(
        "doc_id", "text", digest_of(F.col("text")).alias("digest"))
    known = read_cache(spark, cache).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    misses = texts.select("digest", "text").join(known, "digest", "left_anti") \
        .groupBy("digest").agg(F.first("text").alias("text"))
    misses.mapInArrow(_counts(path, version), CACHE_SCHEMA).write.mode("append").parquet(cache)
    # runs that append at the same time may store a digest twice, with the same count
    counts = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    own = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return own.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), scratch(spark, "token-cache"))
