import hashlib
import re

from kernelforge.llm import pii, queries

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum((2 * int(c) - 9 * (c > "4")) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if ok(k, m[0])]


TEXTS = [
    None, "", "mail é a.b@c.d.e and x@y, x@y.z+w@v.u", "ip 1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 99999999999999999999.1.1.1 1..2", "4111 1111 1111 1111, 4111-1111-1111-1112 1 4111111111111111 12345678901234567890123",
    "+49 (30) 123-4567. +1 555 +123456789012345678 ++12345678901", "write to joe [at] site (dot) org; tel: (555) 555-1234 or 555-555-1234", "a@" + "b." * 20000 + "c", "1" * 50000, "é4111111111111111é+12 345 678 90é",
]


def test_base_spans(spark):
    rows = list(enumerate(TEXTS))
    got = {r.i: r for r in pii.find(spark.createDataFrame(rows, "i int, text string").selectExpr("*", "1 as pii")).selectExpr("i", "filter(pii, x -> x.base) as b", "pii").withColumn("joined", pii.joined("b")).collect()}
    for i, t in rows:
        assert got[i].joined == ",".join(base(t)), t
    assert pii.find(spark.createDataFrame([], "i int, text string")).count() == 0


def test_prefilters_drop_no_match(spark):
    """A card without two adjacent digits, and loose phones without a hyphen in the text."""
    rows = list(enumerate(["4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "x 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "tel 555.123.4567", "call (555) 123.4567 now"]))
    got = {r.i: [(pii.KINDS[x.kind], x.start, x.end, x.base) for x in r.proposed] for r in pii.proposals(spark.createDataFrame(rows, "i int, text string")).collect()}
    assert got == {0: [("card", 0, 31, True)], 1: [("card", 2, 33, True)], 2: [("phone", 4, 16, False)], 3: [("phone", 5, 19, False)]}
    assert [[f"card:{a}:{b}" for _, a, b, _ in got[i]] for i in (0, 1)] == [base(t) for _, t in rows[:2]]


def test_query_on_table(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op5_pii_spans(spark, d).collect()}
    for i, t in queries.read(spark, d, "documents").select("doc_id", "text").collect():
        b = base(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(b).encode()).hexdigest()
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(x.startswith(k) for x in b) for k in pii.KINDS)
        assert set(b) <= set(got[i].spans.split(",")) | {""}


def test_redact(spark):
    rows = [(1, "Für a.b@c.de, +49 30 1234567!"), (2, None), (3, "none")]
    assert [r.text for r in pii.redact(spark.createDataFrame(rows, "i int, text string")).orderBy("i").collect()] == ["Für [EMAIL], [PHONE]!", None, "none"]


def test_model_learns():
    counts = {(0, 14): 500, (0, 12): 100, (0, 4): 20, (0, 0): 400, (0, 2): 100}
    p = pii.estimate(counts)
    assert p[0, 14] > 0.95 > 0.1 > p[0, 0]
    assert len(pii.train(counts, p)) == 9
