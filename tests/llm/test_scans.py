import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from kernelforge.llm import decontaminate, langid, lm, mixing, queries
from pyspark.sql import functions as F

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def normal(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def hits(text, items, width=13):
    w, hit, found = normal(text), set(), set()
    at = {}
    for i, t in items:
        v = normal(t)
        for k in range(max(1, len(v) - width + 1) if v else 0):
            at.setdefault(tuple(v[k : k + width]), set()).add(str(i))
    for n in {len(k) for k in at}:
        for k in range(len(w) - n + 1):
            if found_here := at.get(tuple(w[k : k + n])):
                hit.update(range(k, k + n))
                found |= found_here
    return len(w), len(hit), sorted(found)


def test_contamination_of_table(spark):
    d = "/root/testdata/sf0.01"
    items = [tuple(r) for r in queries.read(spark, d, "benchmark").collect()]
    got = {r.doc_id: r for r in queries.op6_decontamination(spark, d).collect()}
    for i, t in queries.read(spark, d, "documents").select("doc_id", "text").collect():
        n, h, found = hits(t, items)
        want = (i, n, h, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), h > 0 and 20 * h >= n)
        assert tuple(got[i]) == want


def test_contamination_edges(spark, docs, none, monkeypatch):
    rows = docs.collect()
    items = [(1, rows[3].text), (2, rows[3].text), (3, None), (4, " .. "), (5, "w1"), (6, rows[40].text)]
    items += [(7 + i, f"{' '.join(rows[50 + i].text.split()[i : i + 30])} other words {i}") for i in range(30)]  # blocks of many items
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (3_000_000, 50):  # in one pass, and in many
        monkeypatch.setattr(decontaminate.pattern_parts, "__defaults__", (limit,))
        for r in decontaminate.scan(docs.withColumn("contamination", F.lit(1)), bench).collect():
            c = r.contamination
            assert (c.n_words, c.n_hit, c["items"]) == hits(r.text, items)
            assert sum(len(normal(r.text[s.start : s.end])) for s in c.spans) == c.n_hit
    nameless = decontaminate.scan(docs, spark.createDataFrame([(None, rows[3].text)], "item_id long, text string")).where("contamination.n_hit > 0").collect()
    assert nameless and all(not r.contamination["items"] for r in nameless)
    assert decontaminate.scan(none, bench).count() == 0
    assert {r.contamination.n_hit for r in decontaminate.scan(docs, bench.limit(0)).collect()} == {0}


def test_one_automaton_for_many_items():
    """400 items of 200 words, in one automaton of at most a node a word, against plain windows."""
    rnd = random.Random(2)
    item = lambda: " ".join(f"q{rnd.randrange(40)}" for _ in range(200))
    items = [(str(i), item()) for i in range(400)]
    found = decontaminate.Matcher([(n, t.encode()) for n, t in items], 13)
    assert found.automaton.get_stats()["nodes_count"] <= 400 * 200 + 1
    for k in range(60):
        a, b = rnd.sample(items, 2)
        text = " ".join([item(), *a[1].split()[k : k + 11 + k % 5], *b[1].split()[: 12 + k % 3], item()])
        spans, names = found.find(text.encode().split())
        want = hits(text, items)
        assert (len({i for x, y in spans for i in range(x, y)}), sorted(names)) == want[1:]


def test_language(spark, docs, none):
    d = "/root/testdata/sf0.1"
    got = queries.op7_language_id(spark, d).join(queries.read(spark, d, "documents").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert got > 0.98
    model = langid.fit(docs)
    res = {(r.doc_id, r.language.lang_pred, 0 <= r.language.score <= 1) for r in langid.predict(docs, model).collect()}
    assert {x for x in res if x[1] == "und"} == {(i, "und", True) for i in (110, 111, 112, 113)}
    assert langid.predict(none, model).count() == 0
    assert {r.language.lang_pred for r in langid.predict(docs, langid.fit(none)).collect()} == {"und"}


def base_scores(rows):
    tokens = {}
    for i, (d, t) in enumerate(rows):
        tokens[i] = (d, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), None])
    held = {i: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for i, (d, _) in tokens.items()}
    c = Counter(w for i, (_, ws) in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((d, held[i], len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 5)) for i, (d, ws) in tokens.items())


def test_lm(spark, docs, none, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 50)
    for frame in (docs, queries.read(spark, "/root/testdata/sf0.01", "documents")):
        out = lm.score(frame, queries.crc_mod(7) != 2).collect()
        assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out) == base_scores([(r.doc_id, r.text) for r in frame.collect()])
        assert all(r.score <= 0 for r in out)
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)
    one = sorted((r.doc_id, round(r.score, 6)) for r in lm.score(docs, queries.crc_mod(7) != 2).collect())
    monkeypatch.setattr(lm, "SLICE_BYTES", 300)  # many slices and passes, the same scores
    assert sorted((r.doc_id, round(r.score, 6)) for r in lm.score(docs, queries.crc_mod(7) != 2).collect()) == one
    assert lm.score(none, queries.crc_mod(7) != 2).count() == 0


def test_lm_start(spark):
    """Scores of training texts, first words included, against the model in plain code."""
    texts = [*(f"x w{i}" for i in range(64)), *(f"y w{i}" for i in range(5)), None]
    tokens = [["^", *(t or "").split(), "$"] for t in texts]
    words, pairs = Counter(w for t in tokens for w in t[1:]), Counter(p for t in tokens for p in zip(t, t[1:], strict=False))
    n, v = sum(words.values()), len(words)

    def about(c):
        return 1 if c == 1 else 1.5 * 2 ** int(math.log2(c))

    def p(h, w):
        one = (min(about(words[w]), n) + 1) / (n + v + 1)
        c = len(texts) if h == "^" else min(about(words[h]), n)
        return (min(about(pairs[h, w]), c) + lm.MU * one) / (c + lm.MU)

    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(rows, F.lit(True)).collect()}
    want = {i: sum(math.log10(p(h, w)) for h, w in zip(t, t[1:], strict=False)) for i, t in enumerate(tokens)}
    # A filter reads about 1 % of its counts a level too high.
    assert sum(abs(got[i] - x) < 1e-9 for i, x in want.items()) >= 0.9 * len(texts)
    assert abs(sum(got.values()) - sum(want.values())) < 0.01 * abs(sum(want.values()))


def test_mix(spark, docs, none):
    d = "/root/testdata/sf0.1"
    got = Counter((r.source for r in queries.op3_mix_sources(spark, d).collect()))
    rates = {r["__source"]: r for r in mixing.rates(queries.read(spark, d, "documents")).collect()}
    for s, r in rates.items():
        assert abs(got[s] - r.n * r.rate) < 5 * math.sqrt(r.n * r.rate)
    want = Counter()
    cdf = {r["__source"]: r.cdf for r in mixing.rates(docs, {"hot": 1, None: 2, "a": 0}).collect()}
    for r in docs.collect():
        h = hashlib.md5("|".join([mixing.SEED, str(r.doc_id), hashlib.md5((r.text or "").encode()).hexdigest()]).encode()).hexdigest()
        want[r.doc_id] += sum(p <= int(h[:12], 16) / 2**48 for p in cdf[r.source]) if r.source in ("hot", None) else 0
    out = mixing.mix(docs, {"hot": 1, None: 2, "a": 0}).collect()
    assert Counter(r.doc_id for r in out) == +want
    assert mixing.mix(none).count() == 0


def test_mix_large_rates(spark):
    for rate in (0.01, 1.0, 699.0, 701.0, 1000.0, 5000.0):
        cdf = mixing.cumulative(rate)
        assert abs(sum(1 - p for p in cdf) - rate) < 1e-6 * max(1, rate)  # the mean
        assert abs(sum((2 * k + 1) * (1 - p) for k, p in enumerate(cdf)) - rate * rate - rate) < 1e-4 * max(1, rate)  # the second moment
        assert all(0 <= a <= b <= 1 + 1e-12 for a, b in zip(cdf, cdf[1:], strict=False))
        exact = math.exp(int(rate) * math.log(rate) - rate - math.lgamma(int(rate) + 1))
        assert abs(cdf[int(rate)] - (cdf[int(rate) - 1] if rate >= 1 else 0) - exact) < 1e-9
    rows = spark.range(10_000).selectExpr("id as doc_id", "'t' as text", "if(id < 2, 'rare', 'rest') as source")
    got = Counter(r.source for r in mixing.mix(rows, {"rare": 1, "rest": 1}).select("source").collect())
    assert abs(got["rare"] - 5000) < 5 * math.sqrt(5000)


def test_too_many_languages(spark):
    rows = spark.range(langid.MAX_LANGUAGES + 1).selectExpr("'a' as text", "cast(id as string) as lang")
    with pytest.raises(ValueError, match="more than 16384 distinct values of lang"):
        langid.fit(rows)
