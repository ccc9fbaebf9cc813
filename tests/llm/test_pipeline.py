import hashlib
import math
import re
from collections import Counter

import corpus_pipeline
from kernelforge.llm import mixing, neardup
from test_neardup import brute
from test_scans import hits


def test_near_copies_at_80(spark):
    words = [f"v{i}" for i in range(104)]
    rows = []
    for i in range(30):  # pairs of 100 shingles each that share 90: 90 / 110 = 0.82
        a = [f"{w}-{i}" for w in words]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join([*a[:94], *(f"u{k}-{i}" for k in range(10))]))]
    want = brute(rows, corpus_pipeline.NEAR)
    assert sum(r[3] for r in want) == 30 and sum(r[3] for r in brute(rows)) == 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.neardup_stage(spark, docs, "").collect())
    assert kept == [r[0] for r in want if r[3]]
    assert all((1 - (t / 100) ** neardup.MAX_DEPTH) ** neardup.trees(t) <= neardup.MISS for t in (50, 80, 85, 100))
    assert neardup.trees(neardup.THRESHOLD) == 30 and neardup.trees(80) == 49


def test_repeated_and_null_ids(spark, docs):
    """Of rows that share an id one stays, and rows without an id that copy others go; every other group keeps its least id."""
    schema, rows = docs.schema, [tuple(r) for r in docs.collect()]
    by_id = {r[0]: r for r in rows}
    rows += [by_id[0], by_id[0], by_id[114], (0, "zz", *by_id[0][2:]), (None, *by_id[114][1:]), *[(None, "only here, with no id at all", *by_id[0][2:])] * 3, *[(None, *by_id[110][1:])] * 2]
    got = [tuple(r) for r in corpus_pipeline.neardup_stage(spark, spark.createDataFrame(rows, schema).repartition(3), "").collect()]
    want = brute([(r.doc_id, r.text) for r in docs.collect()], corpus_pipeline.NEAR)
    assert Counter(r[0] for r in got if r[0] is not None) == Counter({r[0] for r in want if r[3]})
    assert Counter(r[1] for r in got if r[0] is None) == {"only here, with no id at all": 1, None: 2}
    assert [r[1] for r in got if r[0] == 0] == [min(by_id[0][1], "zz")]


def copies(rate, ident, text):
    u = int(hashlib.md5("|".join([mixing.SEED, ident, hashlib.md5(text.encode()).hexdigest()]).encode()).hexdigest()[:12], 16) / 2**48
    k, p = 0, math.exp(-rate)
    while p <= u:
        k += 1
        p += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
    return k


def test_run(spark, docs, tmp_path):
    """What the language stage keeps, taken through the other stages in plain code, is what run() returns."""
    rows = [tuple(r) for r in docs.collect()]
    rows += [(200, "write to a.b@c.de for the plain truth", *rows[0][2:]), *[(None, "a text without any id, twice", *rows[0][2:])] * 2, (None, *rows[0][1:])]
    items = [(1, next(r[1] for r in rows if r[0] not in (None, 114) and len((r[1] or "").split()) > 100))]
    spark.createDataFrame(rows, docs.schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.language_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "").collect()
    assert not {110, 111, 112, 113} & {r.doc_id for r in kept} and {200, None} <= {r.doc_id for r in kept}
    keyed = [(10_000 + i if r.doc_id is None else r.doc_id, r) for i, r in enumerate(kept)]
    named = {x[0] for x in brute([(k, r.text) for k, r in keyed], corpus_pipeline.NEAR) if x[3]}
    left = list({k: r for k, r in keyed if k in named}.values())
    n_near = len(left)
    left = [r for r in left for n, h, _ in [hits(r.text, items)] if not (h > 0 and 20 * h >= n)]
    assert len(left) < n_near < len(kept)
    left = [(r.doc_id, re.sub(r"\S+@\S+", "[EMAIL]", r.text), r.source) for r in left]
    n = Counter(x[2] for x in left)
    whole = sum(c**mixing.ALPHA for c in n.values())
    want = Counter()
    for i, t, s in left:
        for copy in range(copies(n[s] ** mixing.ALPHA * len(left) / whole / n[s], "" if i is None else str(i), t)):
            want[i, t, s, len(t), copy] += 1
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(out.columns) == {*docs.columns, "copy", "shuffle_key"}
    assert Counter((r.doc_id, r.text, r.source, r.n_chars, r["copy"]) for r in out.collect()) == want
