"""Every operator on awkward and empty tables, and against brute force on small ones."""
from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import regex

from fieldloom.llm import decontam, langid, line_dedup, lm_score, mixing, near_dedup, quality, sharding, suffix_dedup, tokens
from fieldloom.llm.common import documents, scratch
from tests.llm.cases import awkward, empty, key, prose, values

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "n_words", "key", "kept"]


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def table(df):
    return [r.asDict() for r in df.collect()]


# --- op1 ------------------------------------------------------------------------------

def test_language_held_out_accuracy(spark):
    docs = documents(spark, SF)
    got = {r.doc_id: r for r in langid.op1_language_id(spark, SF).collect()}
    right = total = 0
    for r in docs.collect():
        held = zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        assert got[r.doc_id].held_out == held and 0 <= got[r.doc_id].score <= 1
        total += held
        right += held and got[r.doc_id].lang_pred == r.lang
    assert total and right / total > 0.95


def test_language_awkward(spark):
    d = awkward(spark)
    got = table(langid.predict(d, langid.fit(d)))
    assert len(got) == d.count()
    blank = {r["doc_id"]: r["lang_pred"] for r in got}
    assert all(blank[i] == "und" for i in (5, 6, 7, 15, 17)) and blank[0] in {"en", "fr"}
    none = langid.fit(empty(spark))
    assert {r["lang_pred"] for r in table(langid.predict(d, none))} == {"und"}
    assert langid.predict(empty(spark), none).count() == 0


def test_unseen_words_back_off():
    table = lambda *rows: langid.Table(2, sorted({t for t, _, _ in rows}), *(np.array(c) for c in zip(*[
        (sorted({t for t, _, _ in rows}).index(t), g, n) for t, g, n in sorted(rows)])))
    grams = {1: table(("x", 0, 9), ("y", 0, 1), ("y", 1, 9), ("z", 1, 9)), 2: table(("xy", 0, 5), ("zz", 1, 5))}
    m = langid.Model(["a", "b"], table(("known", 1, 20), ("other", 0, 20)), grams)
    p = langid.Predictor(m)
    assert p.predict("known")[0] == "b" and p.predict("xyxy")[0] == "a" and p.predict("1 2 ?") == ("und", 0.0)


def brute_language(rows, text):
    """Word-first backoff from plain counts: (language, score)."""
    tokens = {g: collections.Counter(w for t, x in rows if x == g for w in regex.findall(r"\p{L}+", t.lower())) for g in sorted({x for _, x in rows})}
    kinds = [tokens] + [{g: collections.Counter() for g in tokens} for _ in range(langid.MAX_GRAM)]
    for g, c in tokens.items():
        for w, n in c.items():
            for k in range(1, langid.MAX_GRAM + 1):
                padded = f" {w} "
                for i in range(max(1, len(padded) - k + 1)):
                    kinds[k][g][padded[i:i + k]] += n
    seen = [set().union(*kind.values()) for kind in kinds]

    def log(k, t, g):
        return math.log(kinds[k][g][t] + langid.SMOOTH) - math.log(sum(kinds[k][g].values()) + langid.SMOOTH * len(seen[k]))

    total = dict.fromkeys(tokens, 0.0)
    for w in regex.findall(r"\p{L}+", text.lower()):
        if w in seen[0]:
            for g in total:
                total[g] += log(0, w, g)
            continue
        padded, found = f" {w} ", []
        for i in range(len(padded)):
            k = next((k for k in range(langid.MAX_GRAM, 0, -1) if i + k <= len(padded) and padded[i:i + k] in seen[k]), None)
            if k:
                found.append((k, padded[i:i + k]))
        for g in total:
            total[g] += sum(log(k, t, g) for k, t in found) / max(1, len(found) ** 0.5)
    best = max(total, key=lambda g: (total[g], [-ord(c) for c in g]))
    return best, 1 / sum(math.exp(v - total[best]) for v in total.values())


def test_language_matches_brute_force(spark):
    rng = random.Random(5)
    stems = {"en": ["the", "tion", "ing", "was", "and"], "fr": ["le", "tion", "eau", "est", "élan"], "de": ["der", "ung", "ich", "und", "straße"]}
    word = lambda g: "".join(rng.choices(stems[g], k=rng.randint(1, 3)))
    rows = [(i, " ".join(word(g) for _ in range(8)) + f" {i}x½.", g) for i in range(40) for g in stems]
    rows = [(3 * i + k, t, g) for k, (i, t, g) in enumerate(rows)]
    asked = rows[:10] + [(9000 + i, " ".join(word(g) for g in rng.choices(list(stems), k=4)), None) for i in range(40)] + [(9999, "zzz qqq tion", None)]
    schema = "doc_id bigint, text string, lang string"
    learn = [(t, g) for i, t, g in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(asked, schema), langid.fit(spark.createDataFrame(rows, schema))).collect()}
    for i, t, _ in asked:
        lang, score = brute_language(learn, t)
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-9


def test_number_characters_are_no_letters(spark):
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["½ ² ①", "12 ½", "Ⅷ", "_", "a½"])], "doc_id bigint, text string, lang string")
    got = [r.lang_pred for r in langid.predict(d, langid.fit(d.where("doc_id = 4"))).orderBy("doc_id").collect()]
    assert got[:4] == ["und"] * 4 and got[4] != "und" or zlib.crc32(b"4") % 4 == 2


def test_model_is_bounded_whatever_the_number_of_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ALL", 200)
    rows = [(40 * g + i, f"w{'abcdefghij'[g % 10]}{chr(97 + g // 10)} x{'abcdefghij'[i % 10]}{'abcd'[i // 10]}", f"l{g:02}") for g in range(40) for i in range(40)]
    m = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(m.langs) > 30 and len(m.words.lang) < 4 * 200


def test_sample_of_rows_without_ids_is_bounded_and_not_empty(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 40)
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(1000 + i))
    rows = [(None, f"{g}common {g}{name(i)}", g) for g in ("de", "en", "fr") for i in range(400)]
    m = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    taken = {g: sum(w.startswith(g) and w != g + "common" for w in m.words.tokens) for g in ("de", "en", "fr")}
    assert m.langs == ["de", "en", "fr"] and all(10 < n < 120 for n in taken.values())


# --- op2 ------------------------------------------------------------------------------

def stupid_backoff(texts):
    docs = [[w.translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER)) for w in split(t)] for t in texts]
    n = [collections.Counter(tuple(d[i - k + 1:i + 1]) for d in docs for i in range(k - 1, len(d))) for k in (1, 2, 3)]
    total, out = sum(n[0].values()), []
    for d in docs:
        s = 0.0
        for i in range(len(d)):
            back = 0.0
            for k in range(min(3, i + 1), 0, -1):
                g = tuple(d[i - k + 1:i + 1])
                if k == 1:
                    s += back + np.log(n[0][g] / total)
                elif n[k - 1][g] >= lm_score.MIN_COUNT:
                    s += back + np.log(n[k - 1][g] / n[k - 2][g[:-1]])
                    break
                else:
                    back += np.log(lm_score.ALPHA)
        out.append((len(d), round(s, 6)))
    return out


def test_lm_scores_match_brute_force(spark):
    d = awkward(spark)
    rows = d.collect()
    want = sorted(((r.doc_id, *x) for r, x in zip(rows, stupid_backoff([r.text for r in rows]))), key=key)
    got = sorted(((r.doc_id, r.n_words, round(r.log_score, 6)) for r in lm_score.scores(d).collect()), key=key)
    for w, g in zip(want, got, strict=True):
        assert w[:2] == g[:2] and abs(w[2] - g[2]) < 1e-4
    assert all((r.mean_score is None) == (r.n_words == 0) for r in lm_score.scores(d).collect())
    assert lm_score.scores(empty(spark)).count() == 0


# --- op3 ------------------------------------------------------------------------------

def bench(spark, items):
    return spark.createDataFrame(list(items), "item_id bigint, text string")


def test_decontamination_finds_reordered_passages(spark):
    item = prose(9, 40).split()
    swapped = item[20:] + item[:20]
    half = item[:25]
    rows = [(1, prose(5, 50) + " " + " ".join(item) + " " + prose(6, 50)), (2, " ".join(swapped).upper()), (3, " ".join(half)),
            (4, prose(7, 200)), (5, None), (6, ""), (1, " ".join(item)), (7, ", ".join(item))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    b = bench(spark, [(10, " ".join(item)), (11, None), (12, ""), (13, "only three words"), (14, " ".join(item))])
    got = values(decontam.contaminated(d, b), "doc_id", "item_id", "n_tiles")
    assert {(x[0], x[1]) for x in got} == {(i, j) for i in (1, 2, 7) for j in (10, 14)} and len(got) == 8
    assert all(x[2] == 2 for x in got if x[0] == 2)
    assert sorted(r.doc_id for r in decontam.decontaminate(d, b).collect()) == [3, 4, 5, 6]
    assert decontam.contaminated(d, bench(spark, [])).count() == 0
    assert decontam.contaminated(d.limit(0), b).count() == 0


def test_decontamination_awkward(spark):
    d = awkward(spark)
    b = bench(spark, [(1, prose(2, 300)), (None, "one two"), (3, "一 二")])
    out = decontam.decontaminate(d, b)
    assert out.columns == COLUMNS and {r.doc_id for r in out.collect()} == {r.doc_id for r in d.collect()} - {3, 4}


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 300])
def test_repeated_items_are_sent_once(spark, monkeypatch, block):
    texts, sent = [prose(70 + k, 30) for k in range(3)], []
    blocks = decontam._blocks
    monkeypatch.setattr(decontam, "_blocks", lambda b: (sent.append(x[0] if isinstance(x, tuple) else x) or x for x in blocks(b)))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    d = spark.createDataFrame([(k, t + " " + prose(90 + k, 40)) for k, t in enumerate(texts)] + [(9, prose(99, 90))], "doc_id bigint, text string")
    b = bench(spark, [(i, texts[i % 3]) for i in range(60)] + [(None, texts[0])])
    got = values(decontam.contaminated(d, b), "doc_id", "item_id")
    assert got == sorted([(i % 3, i) for i in range(60)] + [(0, None)], key=key)
    assert sum(map(len, sent)) == 3 and (len(sent) > 1) == (block == 300)
    assert [r.doc_id for r in decontam.decontaminate(d, b).collect()] == [9]


def brute_tiles(p, t, least):
    """Greedy string tiling by trying every pair of starts."""
    pu, tu, out = [False] * len(p), [False] * len(t), 0
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not pu[i + k] and not tu[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        if best[0] < least:
            return out
        k, i, j = best[0], -best[1], -best[2]
        pu[i:i + k], tu[j:j + k] = [True] * k, [True] * k
        out += k


def test_items_with_one_stem_cost_little_and_are_still_found():
    rng = random.Random(1)
    some = lambda n: " ".join("".join(rng.choices("abcdefghij", k=4)) for _ in range(n))
    items = [(str(i), "which of the following statements about " + some(25)) for i in range(300)]
    texts = [some(30) + " which of the following statements about " + some(60) for _ in range(20)]
    texts[3] += " " + items[7][1]
    halves = items[9][1].split()
    texts[5] += " " + " ".join(halves[15:]) + " between " + " ".join(halves[:15])  # the stem is part of what is covered
    b = decontam.Benchmark(items)
    tiled = []
    count = decontam.tile
    try:
        decontam.tile = lambda *a: tiled.append(1) or count(*a)
        got = b.matches(texts)
    finally:
        decontam.tile = count
    assert [(i, m[0]) for i, ms in enumerate(got) for m in ms] == [(3, "7"), (5, "9")]
    assert len(tiled) < 20  # not every item for every document with the stem


def test_tiling_matches_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        p, t = (rng.choices("abc", k=rng.randint(1, 25)) for _ in range(2))
        assert sum(k for _, _, k in decontam.tile(p, t, 3)) == brute_tiles(p, t, 3)


# --- op4 ------------------------------------------------------------------------------

def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("seed", range(4))
def test_mix_targets_match_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 5, 100, 2000]) for s in ["a", "B", "é", "z", None, "b"]}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in sizes)


def test_rows_without_ids_meet_the_targets_and_equal_rows_are_dealt_evenly(spark):
    rows = [(None, "word " * 20, s, i) for s in "abc" for i in range(1000)] + [(7, "one two three", "d", i) for i in range(101)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, extra int").repartition(5)
    got = table(mixing.mix_report(d))
    by = collections.defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1] = r["target"]
        by[r["source"]][2] += r["copies"]
    assert len(got) == len(rows) and all(abs(t - want) <= 20 for t, want, _ in by.values())
    out = mixing.mix(d)
    n = collections.Counter((r.source, r.extra) for r in out.collect())
    assert out.columns == d.columns and sum(n.values()) == sum(r["copies"] for r in got)
    for s in "abcd":  # equal rows get the same number of copies, but for one
        assert max(v for (x, _), v in n.items() if x == s) - min(n[s, i] for i in range(101)) <= 1
    again = collections.Counter((r["source"], r["copies"]) for r in table(mixing.mix_report(d.repartition(3))))
    assert again == collections.Counter((r["source"], r["copies"]) for r in got)


def test_mix_awkward(spark):
    d = awkward(spark)
    got = table(mixing.mix_report(d))
    assert len(got) == d.count() and got and all(r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, table(mixing.mix_report(d))))
    out = mixing.mix(d)
    assert out.columns == COLUMNS
    taken = sum(len(split(r.text)) for r in out.collect())
    assert taken == sum(r["taken"] for r in got)
    assert mixing.mix_report(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


# --- op5 ------------------------------------------------------------------------------

def brute_lines(texts, least):
    keys = [[line.strip(" \t\n\x0b\f\r").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER)) for line in (t or "").split("\n")] for t in texts]
    n = collections.Counter(k for ks in keys for k in set(ks) if k)
    out = []
    for t, ks in zip(texts, keys):
        kept = [line for line, k in zip((t or "").split("\n"), ks) if n[k] < least]
        out.append((len(ks), len(ks) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def line_docs(n=40):
    rng = random.Random(1)
    lines = ["Header", " header\t", "rare 1", "rare 2", "", "  ", "é É", "common line of text", "x"]
    return ["\n".join(rng.choices(lines, k=rng.randint(0, 8))) for _ in range(n)]


def test_lines_match_brute_force_and_deletions_undo(spark):
    texts = [*line_docs(), None, "", "Header\nHeader", "only\nhere"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    keys = line_dedup.stored_keys(d)
    index = line_dedup.LineIndex(spark, scratch(spark, "t")).insert(keys)
    report = lambda: [r[1:] for r in values(line_dedup.line_report(d, index), "doc_id", "n_lines", "n_dropped", "kept_sha256")]
    order = sorted(range(len(texts)), key=str)
    before = report()
    want = brute_lines(texts, line_dedup.MIN_DOCS)
    assert before == [want[i] for i in order]
    more = spark.createDataFrame([(100 + i, "rare 1\nrare 2") for i in range(12)], "doc_id bigint, text string")
    index.insert(line_dedup.stored_keys(more))
    want_more = brute_lines(texts + ["rare 1\nrare 2"] * 12, line_dedup.MIN_DOCS)
    assert report() == [want_more[i] for i in order] and report() != before
    index.delete(line_dedup.stored_keys(more))
    assert report() == before
    assert index.refs().where("n_docs <= 0").count() == 0


def test_line_index_is_reopened_and_refuses_strangers(spark):
    texts = [f"shared\nown {i}" for i in range(12)] + ["shared\nown 0", "  \n"]
    docs = lambda ts: spark.createDataFrame(list(enumerate(ts)), "doc_id bigint, text string")
    path = scratch(spark, "line-index")
    line_dedup.LineIndex(spark, path).insert(line_dedup.doc_keys(docs(texts)))
    again = line_dedup.LineIndex(spark, path)  # as another session would
    assert again.version == 1 and again.docs().where("n = 2").count() == 1
    strangers = [f"shared\nnew {i}" for i in range(5)] + ["shared\nown 1"] * 3
    again.delete(line_dedup.doc_keys(docs(strangers)))
    assert sorted(r.n for r in again.refused().collect()) == [1, 1, 1, 1, 1, 2]
    left = texts[:1] + texts[2:]
    last = line_dedup.LineIndex(spark, path)
    assert values(line_dedup.line_report(docs(left), last), "n_lines", "n_dropped", "kept_sha256") == \
        sorted(brute_lines(left, line_dedup.MIN_DOCS), key=key)
    last.delete(line_dedup.doc_keys(docs(left[:4])))
    assert values(line_dedup.line_report(docs(left[4:]), line_dedup.LineIndex(spark, path)), "n_lines", "n_dropped", "kept_sha256") == \
        sorted(brute_lines(left[4:], line_dedup.MIN_DOCS), key=key)
    with pytest.raises(ValueError):
        line_dedup.LineIndex(spark, path, min_docs=3)


def test_lines_awkward(spark):
    d = awkward(spark)
    keys = line_dedup.stored_keys(d)
    index = line_dedup.LineIndex(spark, scratch(spark, "t"), min_docs=4).insert(keys)
    rows = d.collect()
    want = sorted(((r.doc_id, *x) for r, x in zip(rows, brute_lines([r.text for r in rows], 4))), key=key)
    assert values(line_dedup.line_report(d, index, keys), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    assert line_dedup.drop_lines(d, index).columns == COLUMNS and line_dedup.drop_lines(d, index).count() == d.count()
    none = line_dedup.LineIndex(spark, scratch(spark, "t")).insert(line_dedup.stored_keys(empty(spark)))
    assert line_dedup.line_report(empty(spark), none).count() == 0
    assert line_dedup.line_report(d, none).count() == d.count()


def test_cuckoo_filter_forgets_only_what_is_deleted():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2 ** 63, 20_000, dtype=np.uint64)
    f = line_dedup.CuckooFilter.build(keys)
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(keys).all() and f.contains(rng.integers(0, 2 ** 63, 20_000, dtype=np.uint64)).mean() < 0.01
    f.delete(keys[:10_000])
    assert f.contains(keys[10_000:]).all() and f.contains(keys[:10_000]).mean() < 0.01


# --- op6 ------------------------------------------------------------------------------

def shingle_set(text, size):
    w = [x.translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER)) for x in split(text)]
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(rows, size):
    sets = [shingle_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= 80 * (len(sets[i]) + len(sets[j]) - same):
                root[find(i)] = find(j)
    best: dict = {}
    for i, (d, _) in enumerate(rows):
        best.setdefault(find(i), []).append(d)
    first = {r: min((x for x in ids if x is not None), default=None) for r, ids in best.items()}
    return [(d, len(s), first[find(i)], d == first[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def near_copies(n):
    rng = random.Random(5)
    base, out = [prose(20 + k, 120).split() for k in range(3)], []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = f"changed{i}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("hubs", [near_dedup.HUBS, 1])
def test_near_duplicates_match_brute_force(spark, monkeypatch, hubs):
    monkeypatch.setattr(near_dedup, "HUBS", hubs)  # 1: most links are left to the search of whole lists
    monkeypatch.setattr(near_dedup, "BLOCK", 30 if hubs == 1 else 3000)
    rows = near_copies(90)
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert values(near_dedup.near_duplicates(d, 4), "doc_id", "n_shingles", "component_id", "kept") == sorted(brute_components(rows, 4), key=key)


def test_near_duplicates_awkward(spark):
    d = awkward(spark)
    rows = [(r.doc_id, r.text) for r in d.collect()]
    got = values(near_dedup.near_duplicates(d, 4), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute_components(rows, 4), key=key)
    out = near_dedup.deduplicate(d)
    assert out.columns == COLUMNS
    parts = brute_components(rows, 5)
    groups = {c for (d_, _, c, _), (_, t) in zip(parts, rows) if split(t)}
    kept = [r for r in out.collect()]
    assert sorted(r.doc_id for r in kept if split(r.text)) == sorted(groups)
    assert sum(not split(r.text) for r in kept) == sum(not split(t) for _, t in rows)
    assert near_dedup.near_duplicates(empty(spark)).count() == 0 and near_dedup.deduplicate(empty(spark)).count() == 0


def test_estimate_misses_no_more_links_than_the_lists():
    below = lambda n: sum(math.comb(near_dedup.K, k) * 0.8 ** k * 0.2 ** (near_dedup.K - k) for k in range(n))
    assert below(math.ceil(near_dedup.MIN_ESTIMATE * near_dedup.K)) <= below(near_dedup.SHARED) < 5e-9


# --- op7 ------------------------------------------------------------------------------

def brute_removed(texts, length=suffix_dedup.LENGTH):
    data = [(t or "").encode() for t in texts]
    n = collections.Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if n[b[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = len([1 for m in re.finditer(b"\x01+", bytes(gone))])
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def repeated_texts(n, seed):
    rng = random.Random(seed)
    pieces = [prose(50 + k, rng.choice([20, 34, 40, 60, 90])) for k in range(6)] + ["ab" * 150, "z" * 450, "é" * 130]
    return ["".join(p if rng.random() < 0.7 else p[rng.randrange(60):] for p in rng.choices(pieces, k=rng.randint(1, 3))) + prose(1000 + i, rng.randint(0, 30))
            for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_match_brute_force(spark, seed):
    texts = [*repeated_texts(30, seed), None, "", "short", "q" * 199, "q" * 200, "r" * 201]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = values(suffix_dedup.remove_repeats(d), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(((i, *x) for i, x in enumerate(brute_removed(texts))), key=key)


def test_repeats_awkward(spark):
    d = awkward(spark).where("coalesce(length(text), 0) < 20000")
    rows = d.collect()
    want = sorted(((r.doc_id, *x) for r, x in zip(rows, brute_removed([r.text for r in rows]))), key=key)
    assert values(suffix_dedup.remove_repeats(d), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


# --- op8 ------------------------------------------------------------------------------

def test_shards_fit_and_split_only_when_needed(spark):
    d = awkward(spark)
    for limit in (50_000, 3000, 1):
        got = table(sharding.shard_report(d, limit))
        assert len(got) == d.count()
        by: dict = {}
        for r in got:
            by.setdefault(r["shard_id"], []).append(r)
        for rows in by.values():
            total = sum(r["n_bytes"] for r in rows)
            assert {r["shard_bytes"] for r in rows} == {total} and {r["shard_rows"] for r in rows} == {len(rows)}
            assert total <= limit or (rows[0]["oversized"] and len({r["doc_id"] for r in rows}) == 1)
        names = [n for n in by if n != "root"]
        assert not any(a != b and b.startswith(a) for a in names for b in names)
    assert sharding.shard_report(empty(spark)).count() == 0


def test_one_id_is_split_too(spark):
    d = spark.createDataFrame([(7, "x" * 100)] * 200 + [(8, "y")], "doc_id bigint, text string")
    got = table(sharding.shard_report(d, 1000))
    assert len(got) == 201 and max(r["shard_bytes"] for r in got) <= 1000
    out = sharding.assign_shards(awkward(spark), 3000)
    assert set(COLUMNS) <= set(out.columns) and out.count() == awkward(spark).count()


# --- op9 ------------------------------------------------------------------------------

def test_tokens_match_the_library_and_the_cache_is_used(spark, monkeypatch):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokens.vocabulary_path())
    d = awkward(spark)
    cache = scratch(spark, "t")
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in d.collect()), key=key)
    assert values(tokens.token_counts(d, cache), "doc_id", "n_bytes", "n_tokens") == want
    stored = tokens.read_cache(spark, cache)
    n = stored.count()
    assert n == len({r.text or "" for r in d.collect()}) == stored.select("digest").distinct().count()
    assert values(tokens.token_counts(d, cache), "doc_id", "n_bytes", "n_tokens") == want
    assert tokens.read_cache(spark, cache).count() == n
    assert tokens.token_counts(empty(spark), scratch(spark, "t")).count() == 0


def test_token_pieces_add_up():
    rng = random.Random(2)
    c = tokens.Counter(tokens.vocabulary_path())
    parts = [" ", "  ", "\n", "a", "b", "é", "<|endoftext|>", "'s", "'", "12", "\t", " ", "!", "\x1c", "漢", "...", "×", "'ll", "\r\n", ". ", ","]
    for _ in range(3000):
        s = "".join(rng.choices(parts, k=rng.randint(0, 20)))
        assert c.count([s])[0] == len(c.tokenizer.encode(s, add_special_tokens=False).ids), repr(s)


# --- op10 -----------------------------------------------------------------------------

def brute_base(text):
    w = split(text)
    grams = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover), failed)


BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_rules_match_brute_force(spark):
    for d in (awkward(spark), documents(spark, SF)):
        want = sorted(((r.doc_id, *brute_base(r.text)) for r in d.collect()), key=key)
        assert values(quality.quality(d), *BASE) == want
    assert quality.quality(empty(spark)).count() == 0 and quality.quality_filter(empty(spark)).count() == 0


def test_outliers_go_and_clean_documents_stay(spark):
    rows = [(i, prose(i, 80 + i), "en", "s", 1) for i in range(150)]
    rows += [(1000 + i, " ".join(w + "*$%#" for w in prose(500 + i, 120).split()), "en", "s", 1) for i in range(10)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in quality.quality(d).where("kept").collect()}
    assert kept == set(range(150))
    out = quality.quality_filter(d)
    assert out.columns == d.columns and {r.doc_id for r in out.collect()} == kept
    assert quality.quality_filter(awkward(spark)).columns == COLUMNS


def test_small_groups_are_judged_by_their_language_or_by_all(spark):
    symbols = lambda seed: " ".join(w + "*$%#" for w in prose(seed, 120).split())
    rows = [(i, prose(i, 80 + i % 90), "en", "big") for i in range(150)]
    rows += [(200 + i, prose(200 + i, 100 + i), "en", "small") for i in range(5)] + [(300, symbols(300), "en", "small")]
    rows += [(400 + i, prose(400 + i, 100 + i), "fr", None) for i in range(5)] + [(500, symbols(500), "fr", None)]
    rows += [(600, prose(600, 110), None, None), (700, symbols(700), None, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = table(quality.quality(d))
    assert len(got) == len(rows) and all(r["distance2"] is not None for r in got)
    assert {r["doc_id"] for r in got if not r["kept"]} == {300, 500, 700}
    assert {r.doc_id for r in quality.quality_filter(d).collect()} == {r["doc_id"] for r in got if r["kept"]}
    few = d.where("lang = 'fr'")
    assert {r.doc_id for r in quality.quality(few).where("not kept").collect()} == {500}


def test_outlier_in_a_table_of_few_rows_goes(spark):
    rows = [(i, prose(i, 80 + 3 * i), "en", "s") for i in range(25)] + [(99, " ".join(w + "**" for w in prose(99, 120).split()), "en", "s")]
    got = table(quality.quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")))
    assert {r["doc_id"] for r in got if not r["kept"]} == {99} and all(r["distance2"] is not None for r in got)


def test_shrinking_matches_numpy(spark):
    rng = np.random.default_rng(7)
    features = rng.normal(1000, 300, (90, 5)).astype(int)
    langs, sources = ["a"] * 60 + ["b"] * 30, ["x"] * 50 + ["y"] * 10 + ["x"] * 30
    df = spark.createDataFrame([(g, s, False, *map(int, r)) for g, s, r in zip(langs, sources, features)],
                               "lang string, source string, base_failed boolean, " + ", ".join(f"_f{i} long" for i in range(1, 6)))
    got = {(r["_glang"], r["_gsource"]): r for r in quality.shrunk(quality.estimates(quality._members(df), True), True).collect()}
    floor = np.array(list(quality.FEATURES.values())) * quality.SCALE

    def mcd(rows):
        return min((brute_mcd(features[rows], quality.STEPS, quality.ALPHA, floor, s) for s in (0, 1)), key=lambda e: np.linalg.slogdet(e[1])[1])

    def mixed(n, e, wide):
        w, gap = (n / (n + quality.SHRINK)) ** 2, e[0] - wide[0]
        return w * e[0] + (1 - w) * wide[0], w * e[1] + (1 - w) * wide[1] + w * (1 - w) * np.outer(gap, gap)

    langs, sources = np.array(langs), np.array(sources)
    for g, s in (("a", "x"), ("a", "y"), ("b", "x")):
        own, lang = np.flatnonzero((langs == g) & (sources == s)), np.flatnonzero(langs == g)
        mean, cov = mixed(len(own), mcd(own), mixed(len(lang), mcd(lang), mcd(np.arange(90))))
        r = got[g, s]
        assert np.allclose([r[f"_m{i}"] for i in range(5)], mean)
        assert np.allclose([r[f"_l{i}{j}"] for i, j in quality.PAIRS], [np.linalg.cholesky(cov)[i, j] for i, j in quality.PAIRS])


def brute_mcd(x, steps, alpha, floor, start):
    """Concentration steps with numpy on one group; integer features as the operator has them."""
    p = x.shape[1]
    med = np.array([np.sort(c)[(len(c) + 1) // 2 - 1] for c in x.T], float)
    if start == 0:
        dev = np.abs(x - med)
        spread = np.maximum(1.4826 * np.array([np.sort(c)[(len(c) + 1) // 2 - 1] for c in dev.T]), floor)
    else:
        spread = floor
    mean, cov = med, np.diag(spread ** 2)
    for _ in range(steps):
        diff = x - mean
        d2 = np.einsum("ij,ij->i", diff @ np.linalg.inv(cov), diff)
        bins = np.floor(np.log1p(d2) * 256).astype(int)
        h = int(np.ceil(len(x) * alpha))
        last = np.sort(bins)[h - 1]
        near = x[bins <= last].astype(float)
        mean = near.mean(0)
        cov = (near.T @ near / len(near) - np.outer(mean, mean)) * quality._consistency(alpha, p) + np.diag(floor ** 2)
    return mean, cov


def test_estimates_match_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(5000, 400, 300), rng.normal(1600, 60, 300), rng.normal(30, 20, 300), rng.normal(0, 50, 300), rng.normal(0, 30, 300)]).astype(int)
    x[:30] += 900
    rows = [("en", "s", 0, *map(int, r), False) for r in x]
    df = spark.createDataFrame(rows, "_glang string, _gsource string, _level int, _f1 long, _f2 long, _f3 long, _f4 long, _f5 long, base_failed boolean")
    got = quality.estimates(df, True).collect()[0]
    floor = np.array(list(quality.FEATURES.values())) * quality.SCALE
    both = [brute_mcd(x, quality.STEPS, quality.ALPHA, floor, s) for s in (0, 1)]
    mean, cov = min(both, key=lambda e: np.linalg.slogdet(e[1])[1])
    assert np.allclose([got[f"_m{i}"] for i in range(5)], mean)
    assert np.allclose([got[f"_l{i}{j}"] for i, j in quality.PAIRS], [np.linalg.cholesky(cov)[i, j] for i, j in quality.PAIRS])
