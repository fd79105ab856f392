"""Language identification by word-first backoff (operator 1).

A word that the model knows is scored by its log frequency in each language.  An
unseen word falls back to character n-grams: at each of its places the longest
known n-gram that starts there counts, from ``MAX_GRAM`` letters down to one.
Scores are relative to the other languages, so words and n-grams of any length
add up as evidence; the score is the posterior of the best language.

Learning: word counts per language over a sample of the labelled rows that are
not held out (crc32 of the id's text mod 4 is not 2).  The sample is bounded:
``SAMPLE_DOCS`` documents per language and ``SAMPLE_ALL`` in all (shared evenly by the
languages), drawn by a hash of id and text, a documented limit of the classifier's fit.
Every word and n-gram of the sample is in the model, which holds a number for each
language that has it and none for the others; so the sample's bound is the
model's, whatever the number of languages.  Prediction reads every whole text and
nothing else.

Letters are the characters of Unicode's categories L*.

Defined cases: NULL text or text without a letter is ``und`` with score 0; text
without any known n-gram gets the first language by name with an even score; no
labelled row at all makes every text ``und``; NULL doc_id is not held out;
repeated rows are predicted alike and drawn together; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import documents, stored

SAMPLE_DOCS = 1000
SAMPLE_ALL = 8000
MAX_GRAM = 4
SMOOTH = 0.5
BROADCAST_LANGS = 10_000
MEMORY = 200_000
DENSE = 1 << 24             # numbers of a table that are laid out
LETTERS = regex.compile(r"\p{L}+")


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


class Table:
    """Log frequencies of the tokens of one kind: what every language has for an unseen token, and what a seen one adds."""

    def __init__(self, langs: int, tokens: list[str], owner: np.ndarray, lang: np.ndarray, n: np.ndarray):
        """Row by row: a token's place in ``tokens`` (ascending), a language that has it, and how often."""
        total = np.bincount(lang, weights=n, minlength=langs)
        self.unseen = np.log(SMOOTH) - np.log(total + SMOOTH * max(1, len(tokens)))
        self.tokens = tokens
        self.ends = np.searchsorted(owner, np.arange(len(tokens) + 1))
        self.lang, self.more = lang.astype(np.int32), np.log((n + SMOOTH) / SMOOTH)

    def fill(self) -> None:
        """Lays all rows out where they take little memory; they are the same as those made one by one."""
        n = len(self.tokens)
        self.dense = None
        if n * len(self.unseen) <= DENSE:
            self.dense = np.tile(self.unseen, (n, 1))
            self.dense[np.repeat(np.arange(n), np.diff(self.ends)), self.lang] += self.more

    def row(self, i: int) -> np.ndarray:
        if self.dense is not None:
            return self.dense[i]
        v = self.unseen.copy()
        v[self.lang[self.ends[i]:self.ends[i + 1]]] += self.more[self.ends[i]:self.ends[i + 1]]
        return v


class Model:
    """Words and n-grams by length; evidence per language, up to a constant that all languages share."""

    def __init__(self, langs: list[str], words: Table, grams: dict[int, Table]):
        self.langs, self.words, self.grams = langs, words, grams


class Evidence:
    """A model at work: rows are filled in when they are first asked for."""

    def __init__(self, model: Model):
        self.size, self.words = len(model.langs), model.words
        for t in (model.words, *model.grams.values()):
            t.fill()
        self.known = dict(zip(model.words.tokens, range(len(model.words.tokens))))
        self.grams: dict = {t: (table, i) for size, table in model.grams.items() for i, t in enumerate(table.tokens) if len(t) == size}

    def word(self, w: str) -> np.ndarray:
        i = self.known.get(w)
        if i is not None:
            return self.words.row(i)
        padded, total, n, grams = f" {w} ", np.zeros(self.size), 0, self.grams
        for i in range(len(padded)):
            for size in range(min(MAX_GRAM, len(padded) - i), 0, -1):
                g = padded[i:i + size]
                v = grams.get(g)
                if v is not None:
                    if type(v) is tuple:
                        v = grams[g] = v[0].row(v[1])
                    total = total + v
                    n += 1
                    break
        return total / max(1, n ** 0.5)

    def token(self, t: str) -> np.ndarray:
        """Evidence of what stands between two white spaces."""
        if t.isalpha():  # letters only
            return self.word(t)
        v = np.zeros(self.size)
        for w in LETTERS.findall(t):
            v = v + self.word(w)
        return v


class Predictor:
    """Scores texts; remembers the evidence of tokens, of ``MEMORY`` to twice as many for four languages, of fewer for more."""

    def __init__(self, model: Model):
        self.model, self.evidence, self.known, self.older = model, Evidence(model), {}, {}

    def _row(self, t: str) -> np.ndarray:
        v = self.older.get(t)
        if v is None:
            v = self.evidence.token(t)
        self.known[t] = v
        return v

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or LETTERS.search(text) is None or not self.model.langs:
            return "und", 0.0
        if len(self.known) * len(self.model.langs) > MEMORY * 4:
            self.known, self.older = {}, self.known
        counts = Counter(text.lower().split())
        known, row = self.known, self._row
        rows = [known[t] if t in known else row(t) for t in counts]
        total = np.fromiter(counts.values(), np.float64, len(counts)) @ np.array(rows)
        best = int(total.argmax())
        return self.model.langs[best], float(1 / np.exp(total - total[best]).sum())


def fit(docs: DataFrame) -> Model:
    """Learns from a bounded sample of the labelled rows that are not held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = stored(rows.groupBy("lang").count().withColumnRenamed("lang", "_lang"), "langid-sizes")
    n_langs = sizes.count()
    sizes = F.broadcast(sizes) if n_langs <= BROADCAST_LANGS else sizes  # else texts are shuffled by language
    place = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id"), F.col("text")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.select("lang", "text", place.alias("_u")).join(sizes, F.col("lang") == F.col("_lang")) \
        .where(F.col("_u") * F.col("count") < F.least(F.lit(SAMPLE_DOCS), F.lit(SAMPLE_ALL) / F.lit(max(1, n_langs))))
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    words = stored(sample.select("lang", words.alias("t")).groupBy("lang", "t").agg(F.count("*").alias("n")), "langid-words")
    padded = F.concat(F.lit(" "), F.col("t"), F.lit(" "))
    tables = [words.withColumn("size", F.lit(0))]
    for size in range(1, MAX_GRAM + 1):
        at = F.sequence(F.lit(1), F.greatest(F.length(padded) - (size - 1), F.lit(1)))
        piece = lambda i: F.substring(padded, i, F.lit(size))  # noqa: E731, B023  one argument: a second one would be the place
        grams = words.select("lang", "n", F.explode(F.transform(at, piece)).alias("t"))
        tables.append(grams.groupBy("lang", "t").agg(F.sum("n").alias("n")).withColumn("size", F.lit(size)).select("lang", "t", "n", "size"))
    langs = [r[0] for r in words.select("lang").distinct().orderBy("lang").collect()]
    place = {g: i for i, g in enumerate(langs)}
    made: dict[int, Table] = {}
    for size in range(MAX_GRAM + 1):  # what the bounded sample holds
        got = tables[size].select("t", "lang", "n").toArrow()
        t, lang = got.column("t").combine_chunks().dictionary_encode(), got.column("lang").to_pylist()
        tokens = t.dictionary.to_pylist()
        owner, lang = np.array(t.indices, np.int64), np.array([place[g] for g in lang], np.int64)
        order = np.lexsort((lang, owner))
        made[size] = Table(len(langs), tokens, owner[order], lang[order], np.array(got.column("n"), np.float64)[order])
    return Model(langs, made[0], {k: v for k, v in made.items() if k})


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score; only the text is an input of the prediction."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Predictor(sent.value)
        for b in batches:
            got = [p.predict(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, fit(docs))
