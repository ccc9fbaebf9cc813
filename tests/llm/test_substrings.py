import hashlib
import random

import numpy as np
import pytest
from kernelforge.llm import queries, substrings, suffix


def brute(rows, length=100):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        cover = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                cover[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, c in zip(raw, cover, strict=True) if not c)
        runs = sum(1 for i in range(len(cover)) if cover[i] and (i == 0 or not cover[i - 1]))
        out.append((d, len(raw), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def digest(rows):
    return sorted((r.doc_id, r.n_bytes, sum(x["end"] - x["start"] for x in r.runs), len(r.runs), hashlib.sha256(r.kept).hexdigest()) for r in rows)


def corpus():
    rnd = random.Random(3)
    line = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    shared = [line(n) for n in (90, 105, 150, 400, 1000)]
    rows = [(i, line(rnd.randrange(300)) + rnd.choice(shared)[rnd.randrange(20) :] + line(rnd.randrange(300)) + rnd.choice(shared)) for i in range(60)]
    rows += [(100, "a" * 700), (101, "ab" * 300), (102, "x" + "ab" * 200 + "y"), (103, rows[3][1]), (104, rows[3][1]), (105, None), (106, ""), (107, line(99)), (108, shared[1][:100]), (109, shared[3] * 3)]
    return rows


@pytest.mark.parametrize("hot", [5000, 4])
def test_against_brute_force(spark, hot):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").selectExpr("*", "1 as gram", "2 as runs").repartition(3)
    assert digest(substrings.remove(docs, hot=hot).collect()) == brute(corpus())


def test_query_on_table(spark):
    d = "/root/testdata/sf0.01"
    want = brute([tuple(r) for r in queries.read(spark, d, "documents").select("doc_id", "text").collect()])
    assert sorted(map(tuple, queries.op10_suffix_dedup(spark, d).collect())) == want


def test_repeated_rows_and_none(spark, none):
    rows = [(1, "q" * 150), (1, "q" * 150), (2, "r" * 40)]
    got = digest(substrings.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[0] == got[1] == brute(rows[:1])[0] and got[2][2] == 0
    assert substrings.remove(none).collect() == []


def test_sorter():
    rnd = random.Random(1)
    base = bytes(rnd.choice(b"ab") for _ in range(400))
    buf = np.frombuffer(base + base[:150] + b"a" * 300, np.uint8)
    start = np.arange(len(buf) - 100)
    group = start % 2
    kind = suffix.equal_classes(buf, start, group, 100)
    want = {}
    for s, g, k in zip(start, group, kind, strict=True):
        assert want.setdefault((int(g), buf[s : s + 100].tobytes()), k) == k
    assert len(set(want.values())) == len(want)
    trie, texts = suffix.BlindTrie(3), [b"abc", b"abd", b"aac", b"abc", b"zzz", b"a\0c"]
    for i, t in enumerate(texts):
        trie.add(t, i)
    assert [texts[x[0]] for x in trie.leaves()] == sorted(set(texts)) and [0, 3] in list(trie.leaves())
