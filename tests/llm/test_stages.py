"""Each stage of the pipeline against brute force on that stage's own input."""
import collections
import hashlib
import math

import corpus_pipeline
from fieldloom.llm import decontam, mixing, quality
from fieldloom.llm.common import scratch
from fieldloom.sources.tables import table
from tests.llm.cases import prose
from tests.llm.test_operators import SF, brute_components, brute_targets, brute_tiles, near_copies, split


def covered(text, items):
    t = decontam.words(text)
    seeds = lambda w, n: {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
    for p in items:
        least = min(decontam.MIN_MATCH, len(p))
        if seeds(p, least) & seeds(t, least) and brute_tiles(p, t, least) >= decontam.COVERAGE * len(p) - 1e-9:
            return True
    return False


def copies(rows):
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len(split(r.text))
    target, out = brute_targets(sizes), collections.Counter()
    for r in rows:
        rate = target[r.source] / sizes[r.source]
        u = int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:12], 16) / (1 << 48)
        out[r.doc_id] = math.floor(rate) + (u < rate - math.floor(rate))
    return +out


def test_stages_match_brute_force(spark):
    items = [r.text for r in table(spark, SF, "benchmark").collect() if r.text]
    rows = [(i, prose(i + 100, 60 + i), "en", "abc"[i % 3]) for i in range(70)] + [(100 + i, t, "en", "ab"[i % 2]) for i, t in near_copies(30)]
    rows += [(200 + i, prose(900 + i, 40) + " " + t + " " + prose(950 + i, 40), "en", "c") for i, t in enumerate(items[:6])]
    rows += [(300, "too short", "en", "a"), (301, " ".join(w + "*$%#" for w in prose(300, 120).split()), "en", "a")]
    stage = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    for name, f in corpus_pipeline.STAGES:
        before = stage.collect()
        ids = collections.Counter(r.doc_id for r in before)
        if name == "quality rules":
            want = collections.Counter(r.doc_id for r in quality.quality(stage).where("kept").collect())
        elif name == "near dedup":
            want = collections.Counter(d for d, _, _, kept in brute_components([(r.doc_id, r.text) for r in before], 5) if kept)
        elif name == "decontamination":
            tiled = [decontam.words(t) for t in items]
            want = collections.Counter(r.doc_id for r in before if not covered(r.text, tiled))
        else:
            want = copies(before) if name == "mixing" else ids
        out = f(spark, stage, SF)
        path = scratch(spark, "t")
        out.write.parquet(path)
        stage = spark.read.schema(out.schema).parquet(path)
        after = stage.collect()
        assert collections.Counter(r.doc_id for r in after) == want, name
        assert name == "sharding" or want != ids, name
    total = collections.Counter()
    for r in after:
        total[r.shard_id] += len(r.text.encode())
    assert all(r.shard_bytes == total[r.shard_id] for r in after)
