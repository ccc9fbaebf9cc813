import random
import re
from collections import defaultdict

import pytest
from kernelforge.llm import graph, neardup, queries


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, threshold=85):
    sets, up = [(d, shingles(t)) for d, t in rows], {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(i)
    seen = set()
    for hs in holders.values():
        for i in hs:
            for j in hs:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    a, b = sets[i][1], sets[j][1]
                    n = len(a & b)
                    if 100 * n >= threshold * (len(a) + len(b) - n):
                        x, y = find(sets[i][0]), find(sets[j][0])
                        up[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def test_against_brute_force(docs):
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, neardup.near_duplicates(docs).collect())) == want


def test_cut_clusters_lose_no_link(docs, monkeypatch):
    monkeypatch.setattr(neardup, "PROBES", 7)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, neardup.near_duplicates(docs, chunk=1500).collect())) == want


def test_query_on_table(spark):
    d = "/root/testdata/sf0.01"
    want = brute([tuple(r) for r in queries.read(spark, d, "documents").select("doc_id", "text").collect()])
    assert sorted(map(tuple, queries.op4_minhash_neardup(spark, d).collect())) == want


def test_empty(none):
    assert neardup.near_duplicates(none).collect() == []


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (9, 8), (5, 5)], [(i, i + 1) for i in range(60)], []])
def test_components(spark, edges):
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    up = {}
    for a, b in sorted((min(e), max(e)) for e in edges if e[0] != e[1]):
        up.setdefault(a, a), up.setdefault(b, b)
        x, y = up[a], up[b]
        up.update({k: min(x, y) for k, v in up.items() if v in (x, y)})
    assert got == up


def test_forest_regions_whatever_the_partitions(spark):
    """Each region is taken at the least depth at which it has at most CROWD rows, or at MAX_DEPTH, also where partitions cut it."""
    rnd, n_trees = random.Random(3), 2
    rows = [(i, [tuple(rnd.choice((1, 1, 1, 2)) for _ in range(neardup.MAX_DEPTH)) for _ in range(n_trees)]) for i in range(900)]
    packed = [(i, b"".join(v.to_bytes(4, "big") for label in labels for v in label)) for i, labels in rows]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for t in range(n_trees):
        left = rows
        for depth in range(neardup.MIN_DEPTH, neardup.MAX_DEPTH + 1):
            regions = defaultdict(list)
            for i, labels in left:
                regions[labels[t][:depth]].append((i, labels))
            left = []
            for r in regions.values():
                if len(r) > neardup.CROWD and depth < neardup.MAX_DEPTH:
                    left += r
                    continue
                for i, _ in r:
                    x, y = find(r[0][0]), find(i)
                    up[max(x, y)] = min(x, y)
    want = {i: find(i) for i, _ in rows}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for parts in (1, 7, 40):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        edges = neardup.candidates(spark.createDataFrame(packed, "key long, labels binary"), n_trees)
        got = dict(graph.components(edges, "a", "b").collect())
        assert {i: got.get(i, i) for i in want} == want
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
