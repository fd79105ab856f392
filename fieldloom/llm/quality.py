"""Quality rules: base rules plus robust multivariate outliers (operator 10).

Every document gets a vector of transformed statistics (length, word length,
share of symbols, of repeated lines and of repeated words).  Per language and
source, the minimum-covariance-determinant (MCD) estimate of location and
scatter is found by concentration steps: distances under the current estimate,
the ``ALPHA`` share of the rows with the smallest ones, their mean and
covariance, and again.  Two deterministic starts run side by side and the one
with the smaller determinant wins.  Languages and the whole table get estimates
alike; a group's location and scatter are mixed with its language's, and these with
the table's, each by the square of n / (n + ``SHRINK``) for its n rows: an outlier among few rows
hardly widens its own limits, many rows decide nearly all, and no size is a limit between.  A document is rejected
when its squared Mahalanobis distance under that mixture exceeds ``CUTOFF``.

Only DataFrame functions are used.  A step is one pass over the narrow
statistics table: rows are grouped by (group, start, distance bin) with exact
integer moments, so a group with a third of all rows is summed map-side, and the
quantile and the moments of the nearest share are read off the few bins.
Integer sums make reruns agree bit for bit.

Defined cases: a NULL or empty text has no words and fails the base rules; NULL
``lang`` or ``source`` are groups of their own; a group has an estimate from one
row on that passes the base rules (the floors under the deviations keep it regular);
repeated rows are judged one by one, alike; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import SPACES, WORD_CHAR, documents, let, stored, text_of, words_of

WINDOW = 8                  # words in a repeated window
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
SYMBOLS = "#*$%&|<>"
ALPHA = 0.75                # share of a group's rows the estimate is made of
STEPS = 4                   # concentration steps
SHRINK = 60                 # rows at which a group's own estimate has a quarter of the weight
SCALE = 1000                # features are kept as integers of 1 / SCALE
#: Smallest standard deviation of each feature, in feature units: most rows have
#: no symbol or repetition at all, so their scatter would otherwise be singular.
FEATURES = {"_f1": 0.25, "_f2": 0.08, "_f3": 0.06, "_f4": 0.08, "_f5": 0.08}
CUTOFF = 60.0               # squared distance (5 features), after the consistency factor
#: Broadcast the table of estimates up to this many groups (about 300 bytes each).
BROADCAST_GROUPS = 20_000

NAMES = list(FEATURES)
PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]


def _covered(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, from the windows' hashes in order."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = lambda s: F.filter(s, lambda x, i: (
        ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
    at = let(pairs, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
    # each start adds the words up to the next start, WINDOW at most
    return let(at, lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x))


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
    and the integer features ``_f1`` to ``_f5``."""
    t = docs.select(*keep, text_of().alias("_t"))
    t = t.select(*keep, F.transform(words_of(F.col("_t")), lambda w: F.xxhash64(w)).alias("_w"),
                 F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD_CHAR)).alias("_l"),
                 F.length(F.translate("_t", SPACES, "")).cast("long").alias("_chars"),
                 (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("_syms"))
    n = F.size("_w")
    t = t.withColumn("_h", F.when(n > WINDOW, F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_w"), i, F.lit(WINDOW))))))
    t = t.select(
        *keep, n.cast("long").alias("_n"), "_chars", "_syms", F.size("_l").alias("_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("_dups"),
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), _covered(F.col("_h"))).otherwise(0).cast("long").alias("_rep"))
    scaled = lambda c: F.round(c * SCALE).cast("long")
    return t.select(
        *keep, F.col("_n").alias("n_words"), F.col("_chars").alias("word_chars"), F.col("_syms").alias("n_symbols"),
        F.col("_dups").alias("n_dup_lines"), F.col("_rep").alias("n_repeat_words"),
        ((F.col("_n") < MIN_WORDS) | (100 * F.col("_rep") > MAX_REPEAT_PCT * F.col("_n"))).alias("base_failed"),
        scaled(F.log1p("_n")).alias("_f1"),
        scaled(F.log((F.col("_chars") + 100) / (F.col("_n") + 20))).alias("_f2"),  # shrunk towards 5 letters
        scaled(F.sqrt(F.col("_syms") / (F.col("_chars") + 200))).alias("_f3"),
        scaled(F.sqrt(F.col("_dups") / (F.col("_lines") + 10))).alias("_f4"),
        scaled(F.sqrt(F.col("_rep") / (F.col("_n") + 100))).alias("_f5"))


def _chi2_cdf(x: float, k: int) -> float:
    """Regularised lower incomplete gamma by its series."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    for i in range(1, 500):
        term *= z / (a + i)
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def _consistency(alpha: float, p: int) -> float:
    """Factor that makes the scatter of the nearest ``alpha`` share unbiased under normality."""
    lo, hi = 1e-9, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, p) < alpha else (lo, mid)
    return alpha / _chi2_cdf(lo, p + 2)


KEYS = ["_glang", "_gsource", "_level"]


def _on(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """``b`` with its keys renamed, and the null-safe condition against ``a``."""
    b = b.select(*[F.col(k).alias(f"_r{k}") if k in keys else F.col(k) for k in b.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r{k}"))
    return b, cond


def _attach(rows: DataFrame, est: DataFrame, keys: list[str], small: bool, how: str = "inner") -> DataFrame:
    est, cond = _on(rows, est, keys)
    return rows.join(F.broadcast(est) if small else est, cond, how).drop(*[f"_r{k}" for k in keys])


def _medians(rows: DataFrame, value: str) -> DataFrame:
    """Lower median of the long column ``value`` per group and feature, from exact counts."""
    by = Window.partitionBy(*KEYS, "_k").orderBy(value)
    c = rows.groupBy(*KEYS, "_k", value).count()
    c = c.withColumn("_cum", F.sum("count").over(by)) \
        .withColumn("_all", F.sum("count").over(Window.partitionBy(*KEYS, "_k")))
    return c.where(2 * F.col("_cum") >= F.col("_all")).groupBy(*KEYS, "_k").agg(F.min(value).alias("_med"))


def _cholesky(m: DataFrame, cov: dict[tuple[int, int], Column], keep: list[str]) -> DataFrame:
    """Lower factor ``_l{i}{j}`` of the covariance, one column after another."""
    m = m.select(*keep, *[c.alias(f"_c{i}{j}") for (i, j), c in cov.items()])
    p = len(NAMES)
    for j in range(p):
        d = F.col(f"_c{j}{j}") - sum((F.col(f"_l{j}{k}") ** 2 for k in range(j)), F.lit(0.0))
        m = m.withColumn(f"_l{j}{j}", F.sqrt(F.greatest(d, F.lit((FEATURES[NAMES[j]] * SCALE) ** 2 * 1e-3))))
        cols = {f"_l{i}{j}": (F.col(f"_c{i}{j}") - sum((F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}") for k in range(j)), F.lit(0.0)))
                / F.col(f"_l{j}{j}") for i in range(j + 1, p)}
        if cols:
            m = m.withColumns(cols)
    return m.drop(*[f"_c{i}{j}" for i, j in cov])


def _distance(rows: DataFrame) -> DataFrame:
    """``_d2`` by forward substitution with ``_m*`` and ``_l**``, which it drops."""
    for i, n in enumerate(NAMES):
        rows = rows.withColumn(f"_y{i}", (F.col(n) - F.col(f"_m{i}")
                                          - sum((F.col(f"_l{i}{k}") * F.col(f"_y{k}") for k in range(i)), F.lit(0.0)))
                               / F.col(f"_l{i}{i}"))
    rows = rows.withColumn("_d2", sum((F.col(f"_y{i}") ** 2 for i in range(len(NAMES))), F.lit(0.0)))
    return rows.drop(*[f"_y{i}" for i in range(len(NAMES))], *[f"_m{i}" for i in range(len(NAMES))],
                     *[f"_l{i}{j}" for i, j in PAIRS])


def _few_groups(stats: DataFrame) -> bool:
    """The table of estimates is small enough to be broadcast."""
    return stats.select("lang", "source").distinct().limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS


def _members(stats: DataFrame) -> DataFrame:
    """The passing rows once for each estimate they are part of: their group's (level 0), their language's (1), that of all (2)."""
    s = stats.where(~F.col("base_failed")).select("lang", "source", *NAMES)
    s = s.withColumn("_level", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return s.select(F.when(F.col("_level") < 2, F.col("lang")).alias("_glang"), F.when(F.col("_level") < 1, F.col("source")).alias("_gsource"),
                    "_level", *NAMES)


def estimates(rows: DataFrame, small: bool) -> DataFrame:
    """MCD location ``_m*``, Cholesky factor ``_l**`` and row count ``_all`` per group, from rows with features and group keys."""
    p = len(NAMES)
    # start 0: nearest to the coordinate-wise medians in units of the median absolute deviation;
    # start 1: nearest to them in units of the smallest deviations allowed
    long = lambda r: r.select(*KEYS, F.posexplode(F.array(*NAMES)).alias("_k", "_v"))
    med = _medians(long(rows), "_v")
    dev = _attach(long(rows), med, [*KEYS, "_k"], small).select(*KEYS, "_k", F.abs(F.col("_v") - F.col("_med")).alias("_v"))
    wide = lambda m, n: m.groupBy(*KEYS).agg(*[F.max(F.when(F.col("_k") == i, F.col("_med"))).cast("double").alias(f"{n}{i}") for i in range(p)])
    both = _attach(wide(med, "_m"), wide(_medians(dev, "_v"), "_s"), KEYS, small)
    floor = [FEATURES[n] * SCALE for n in NAMES]
    spread = [F.when(F.col("_start") == 0, F.greatest(F.col(f"_s{i}") * 1.4826, F.lit(floor[i]))).otherwise(floor[i]) for i in range(p)]
    est = both.withColumn("_start", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        *KEYS, "_start", *[f"_m{i}" for i in range(p)],
        *[(spread[i] if i == j else F.lit(0.0)).alias(f"_l{i}{j}") for i, j in PAIRS])
    keys = [*KEYS, "_start"]
    starts = rows.withColumn("_start", F.explode(F.array(F.lit(0), F.lit(1))))
    factor = _consistency(ALPHA, p)
    for _ in range(STEPS):
        near = _distance(_attach(starts, est, keys, small))
        near = near.withColumn("_bin", F.floor(F.log1p("_d2") * 256).cast("long"))
        bins = near.groupBy(*keys, "_bin").agg(
            F.count("*").alias("_n"), *[F.sum(n).alias(f"_s{i}") for i, n in enumerate(NAMES)],
            *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"_q{i}{j}") for i, j in PAIRS])
        before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))) \
            .withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
        tot = bins.where(F.col("_before") < F.ceil(F.col("_all") * ALPHA)).groupBy(*keys).agg(
            F.max("_all").alias("_all"), *[F.sum(c).alias(c) for c in ["_n", *[f"_s{i}" for i in range(p)], *[f"_q{i}{j}" for i, j in PAIRS]]])
        mean = [F.col(f"_s{i}") / F.col("_n") for i in range(p)]
        cov = {(i, j): (F.col(f"_q{i}{j}") / F.col("_n") - mean[i] * mean[j]) * factor + (F.lit(floor[i] ** 2) if i == j else F.lit(0.0))
               for i, j in PAIRS}
        est = _cholesky(tot.select("*", *[m.alias(f"_m{i}") for i, m in enumerate(mean)]), cov, [*keys, "_all", *[f"_m{i}" for i in range(p)]])
    det = sum((F.log(F.col(f"_l{i}{i}")) for i in range(p)), F.lit(0.0))
    first = Window.partitionBy(*KEYS).orderBy(F.round(det, 9), "_start")
    return est.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank", "_start")


def _moments(est: DataFrame, tag: str, keys: list[str]) -> DataFrame:
    """``keys``, row count, location and covariance of an estimate, with ``tag`` in front."""
    cov = {(i, j): sum((F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}") for k in range(j + 1)), F.lit(0.0)) for i, j in PAIRS}
    return est.select(*keys, F.col("_all").alias(f"{tag}n"), *[F.col(f"_m{i}").alias(f"{tag}m{i}") for i in range(len(NAMES))],
                      *[c.alias(f"{tag}c{i}{j}") for (i, j), c in cov.items()])


def _towards(est: DataFrame, tag: str, wide: str) -> DataFrame:
    """Replaces the estimate ``tag`` by its mixture with the wider one; its weight grows with its rows."""
    w = F.pow(F.col(f"{tag}n") / (F.col(f"{tag}n") + SHRINK), 2)
    gap = [F.col(f"{tag}m{i}") - F.col(f"{wide}m{i}") for i in range(len(NAMES))]
    mean = {f"{tag}m{i}": w * F.col(f"{tag}m{i}") + (1 - w) * F.col(f"{wide}m{i}") for i in range(len(NAMES))}
    cov = {f"{tag}c{i}{j}": w * F.col(f"{tag}c{i}{j}") + (1 - w) * F.col(f"{wide}c{i}{j}") + w * (1 - w) * gap[i] * gap[j] for i, j in PAIRS}
    return est.withColumns({**mean, **cov})


def shrunk(est: DataFrame, small: bool) -> DataFrame:
    """One estimate per (language, source): its own, drawn towards the language's and that of all rows where it has few rows."""
    own = _moments(est.where("_level = 0"), "_a", ["_glang", "_gsource"])
    lang = _moments(est.where("_level = 1"), "_b", ["_glang"])
    every = _moments(est.where("_level = 2"), "_e", [])  # one row
    both = _towards(_attach(lang.withColumn("_one", F.lit(1)), every.withColumn("_one", F.lit(1)), ["_one"], True), "_b", "_e")
    both = both.select("_glang", *[c for c in both.columns if c.startswith("_b")])
    mixed = _towards(_attach(own, both, ["_glang"], small), "_a", "_b")
    keys = ["_glang", "_gsource", *[f"_m{i}" for i in range(len(NAMES))]]
    mixed = mixed.select("*", *[F.col(f"_am{i}").alias(f"_m{i}") for i in range(len(NAMES))])
    return _cholesky(mixed, {(i, j): F.col(f"_ac{i}{j}") for i, j in PAIRS}, keys)


def judged(stats: DataFrame, est: DataFrame, small: bool) -> DataFrame:
    """Adds ``distance2`` (NULL where no row of the group passes the base rules) and ``kept``."""
    rows = stats.select("*", F.col("lang").alias("_glang"), F.col("source").alias("_gsource"))
    out = _distance(_attach(rows, est, ["_glang", "_gsource"], small, "left"))
    return out.withColumn("distance2", F.round("_d2", 6)) \
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("_d2") <= CUTOFF, F.lit(True)))


def _fit(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame, bool]:
    stats = stored(with_statistics(docs, keep), "quality-stats")
    small = _few_groups(stats)
    est = stored(estimates(_members(stats), small), "quality-estimates")
    return stats, stored(shrunk(est, small), "quality-shrunk"), small


def quality(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, distance2."""
    stats, est, small = _fit(docs, ["doc_id", "lang", "source"])
    return judged(stats, est, small).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns.

    The estimates come from a first pass; a second one computes each row's
    statistics again, so no row needs an identity to find its verdict.
    """
    _, est, small = _fit(docs, ["lang", "source"])
    own = F.struct(*[F.col(c) for c in docs.columns])
    stats = with_statistics(docs.select(own.alias("_row"), "text", "lang", "source"), ["_row", "lang", "source"])
    verdict = judged(stats, est, small)
    # a filter on kept would be pushed below the statistics and repeat them in its condition;
    # an outer generator stays in place and computes each of them once
    out = verdict.select(F.explode_outer(F.when(F.col("kept"), F.array("_row"))).alias("_row"))
    return out.where(F.col("_row").isNotNull()).select("_row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))
