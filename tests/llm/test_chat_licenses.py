import json
import random

import pytest
from kernelforge.llm import chat, licenses, queries

ROWS = "conv_id long, turn long, role string, text string, calls array<" + chat.CALL + ">, result_for string, level int"
SCHEMAS = {"f": {"properties": {"x": "integer", "s": "string"}, "required": ["x"]}}


def call(i, args, deps=None, name="f"):
    return (i, name, args, deps)


def test_links(spark):
    rows = [
        (1, 0, "user", "go", None, None, 9), (1, 1, "assistant", None, [call("a", '{"x": 1}'), call("b", '{"x": 2, "s": "é"}')], None, 9), (1, 2, "tool", "r", None, "a", 9), (1, 3, "tool", "r", None, "b", 9),
        (1, 4, "assistant", "", [call("c", '{"x": true, "y": 1}', ["a", "b"])], None, 9), (1, 5, "tool", "late", None, "c", 9), (1, 6, "tool", "lost", None, "zz", 9),
        (2, 0, "assistant", "", [call("p", "{", ["q"])], None, 9), (2, 1, "assistant", "", [call("q", '{"s": 1}', ["p"], "g")], None, 9), (2, 2, "tool", "", None, "q", 9), (None, None, None, None, None, None, None), (3, 0, "user", "x", [], None, 1), (3, 0, "user", "x", [], None, 1),
    ]
    got = {}
    for r in chat.link(spark.createDataFrame(rows, ROWS), SCHEMAS).collect():
        got.setdefault((r.conv_id, r.turn), []).append(r)
    assert len(got[3, 0]) == 2 and len(got[None, None]) == 1
    one = {k: v[0] for k, v in got.items()}
    assert [one[1, t].level for t in range(7)] == [0, 0, 1, 1, 2, 3, 0]
    assert one[1, 6].problems == ["result without call"] and not one[1, 6].linked and one[1, 5].linked
    assert one[1, 4].problems == ["c: unknown y", "c: x is not integer"]
    assert one[2, 0].level is None and one[2, 0].problems == ["p: arguments are not JSON", "1 calls without result", "cycle"]
    assert one[2, 1].problems == ["q: unknown tool", "cycle"]
    assert one[1, 1].json == '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"x":1},"id":"a","name":"f"},{"arguments":{"s":"é","x":2},"id":"b","name":"f"}]}'
    assert chat.link(spark.createDataFrame([], ROWS), SCHEMAS).count() == 0


def test_chat_query(spark):
    """The whole result, against plain code."""
    d = "/root/testdata/sf0.01"
    got, rows = queries.op9_chat_format(spark, d).collect(), {(r.conv_id, r.turn): r for r in queries.read(spark, d, "conversations").collect()}
    assert len(got) == len(rows)

    def level(k):
        """A user turn waits for the answer of the call two turns before, or for that call; an answer for its call."""
        c, t = k
        if rows[k].role == "user":
            if (c, t - 2) not in rows or rows[c, t - 2].role != "user":
                return 0
            answer = (c, t - 1)
            return 1 + level(answer if answer in rows and rows[answer].role == "assistant" else (c, t - 2))
        return 1 + level((c, t - 1)) if rows[k].role == "assistant" and t > 0 and (c, t - 1) in rows and rows[c, t - 1].role == "user" else 0

    for r in got:
        c, t = k = (r.conv_id, r.turn)
        text, name, problems, body = rows[k].text, f"{c}-{t}", [], {"content": rows[k].text, "role": r.role}
        if r.role == "user":
            arguments = {"text": text, "turn": t} if text is not None else {"turn": t}
            if text is None:
                problems.append(f"{name}: missing text")
            problems += [f"{name}: text has a wrong length"] * (text is not None and not 1 <= len(text) <= 400) + [f"{name}: turn is out of range"] * (t > 5)
            problems += ["1 calls without result"] * (rows.get((c, t + 1)) is None or rows[c, t + 1].role != "assistant")
            body["tool_calls"] = [{"arguments": arguments, "id": name, "name": "reply"} | ({"depends_on": [f"{c}-{t - 2}"]} if t >= 2 else {})]
        linked = r.role == "assistant" and t > 0 and (c, t - 1) in rows and rows[c, t - 1].role == "user"
        if r.role == "assistant" and t > 0:
            body["tool_call_id"] = f"{c}-{t - 1}"
            problems += ["result without call"] * (not linked)
        assert (r.linked, r.n_calls, r.level, r.problems) == (linked, int(r.role == "user"), level(k), " | ".join(problems))
        assert r.json == json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert {r.level for r in got} >= set(range(6)) and any(r.problems for r in got)


def test_schemas():
    nested = {"g": {"properties": {"a": {"type": "array", "items": {"type": "object", "properties": {"k": {"enum": ["x", 1]}}, "required": ["k"]}, "maxItems": 2}, "n": {"type": ["number", "null"], "minimum": 0}, "s": {"type": "string", "pattern": "^[a-z]+$"}}}}
    wrong = lambda text: chat.check("g", text, nested)[1]
    assert wrong('{"a": [{"k": "x"}, {"k": 1}], "n": null, "s": "abc"}') == []
    assert wrong('{"a": [{"k": "y"}, {}], "n": -1, "s": "A", "z": 0}') == ["unknown z", "a[0].k is not one of the values", "missing a[1].k", "n is out of range", "s does not match"]
    assert wrong('{"a": [1, 2, 3]}') == ["a has a wrong length", "a[0] is not object", "a[1] is not object", "a[2] is not object"]
    for bad in ("NaN", '{"n": NaN}', '{"n": 1e999}', '{"s": "\\ud800"}', "", None, "[" * 100_000):
        assert wrong(bad) == ["arguments are not JSON"]
    assert wrong("[]") == ["arguments are not an object"] and chat.check("h", "{}", nested)[1] == ["unknown tool"]
    with pytest.raises(ValueError):
        chat.check("g", '{"x": 1}', {"g": {"properties": {"x": {"type": "whole"}}}})


def test_canonical_numbers():
    """Values of the standard's own table, and others."""
    for x, text in ((0.0, "0"), (-0.0, "0"), (5e-324, "5e-324"), (1.7976931348623157e308, "1.7976931348623157e+308"), (9007199254740992.0, "9007199254740992"), (295147905179352830000.0, "295147905179352830000"), (1e21, "1e+21"), (1e-6, "0.000001"), (1e-7, "1e-7"), (333333333.3333333, "333333333.3333333"), (-1.5, "-1.5"), (100.0, "100"), (1.25e-9, "1.25e-9")):
        assert chat.number(x) == text and float(text) == x
    assert chat.canonical({"\ufb33": 1, "\U0001f600": 2, "a": [1.0, None, True, "\n\u001f"]}) == '{"a":[1,null,true,"\\n\\u001f"],"\U0001f600":2,"\ufb33":1}'


def test_levels_of_graphs(spark):
    """Chains, junctions, cycles, what stands behind them and self-dependencies, against a plain search."""
    rnd, edges = random.Random(7), []
    for conv in range(12):
        n = 40
        for t in range(1, n):
            for _ in range(rnd.choice((0, 1, 1, 1, 1, 2, 3))):
                edges.append((conv, t, rnd.randrange(max(0, t - 3), t)))
        if conv % 3 == 0:
            a = rnd.randrange(5, 30)
            edges += [(conv, a, a + 4), (conv, a + 4, a)]
        if conv % 4 == 1:
            edges.append((conv, 20, 20))
    edges += [(99, t, t - 1) for t in range(1, 300)]
    on, memo = {}, {}
    for c, t, o in edges:
        on.setdefault((c, t), set()).add((c, o))

    def level(k, path=()):
        if k in path:
            return None
        if k not in memo:
            below = [level(x, (*path, k)) for x in sorted(on.get(k, ()))]
            if None in below and path:
                return None
            memo[k] = None if None in below else 1 + max(below, default=-1)
        return memo[k]

    nodes = [(c, t) for c in range(12) for t in range(40)]
    want = {k: v for k in nodes if (v := level(k)) is not None} | {(99, t): t for t in range(300)}
    nodes += [(99, t) for t in range(300)]
    got = chat.levels(spark.createDataFrame(edges, "conv long, turn long, on long"), spark.createDataFrame(nodes, "conv long, turn long"))
    assert {(r.conv, r.turn): r.level for r in got.collect()} == want


def test_repeated_identifiers_and_long_chains(spark):
    rows = [(1, 2 * i, "assistant", None, [call(f"c{i}", '{"x": 1}', [f"c{i - 1}", None] if i else None)], None, None) for i in range(12)]
    rows += [(1, 2 * i + 1, "tool", "é" * 200_000 if i == 3 else "r", None, f"c{i}", None) for i in range(12)]
    rows += [(2, 0, "assistant", None, [call("a", '{"x": 1}'), call("a", '{"x": 1}')], None, None), (2, 1, "assistant", None, [call("a", '{"x": 1}')], None, None)]
    got = {(r.conv_id, r.turn): r for r in chat.link(spark.createDataFrame(rows, ROWS), SCHEMAS).collect()}
    assert [got[1, t].level for t in range(24)] == list(range(24))
    assert got[2, 0].problems == ["a: repeated identifier", "2 calls without result"] and got[2, 1].problems == ["a: repeated identifier", "1 calls without result"]


def test_licenses(spark):
    t = licenses.TEMPLATES
    long = " ".join(f"word{i}" for i in range(300))
    rows = [(1, f"Ünder {long} {t['MIT-grant'].upper()} {long}"), (2, "x. Released under the MIT License."), (3, None), (4, ""), (5, "Released under the"), (6, long), (7, t["GPL-notice"].replace("modify", "change").replace("program", "work") + "\n" + t["BSD"])]
    got = sorted((r.doc_id, r.license, r.text[r.start : r.end]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect())
    assert [(d, x) for d, x, _ in got] == [(1, "MIT-grant"), (2, "MIT"), (7, "BSD")]
    assert got[0][2] == t["MIT-grant"].upper() and got[1][2] == "Released under the MIT License"
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), {"x": "too short"})


def test_license_copies_and_edges(spark):
    t = licenses.TEMPLATES
    kind = "doc_id long, text string, license string, start int"
    mit, short = t["MIT-grant"], t["MIT"]
    rows = [(1, f"{mit} {mit}", "x", 1), (2, f"{mit}, and once more: {mit} end {mit}", None, None), (3, f"{short}. {short}. {short}", "", 0), (None, mit, None, None), (4, mit, "x", 1), (4, mit, "x", 1), (5, f"{'w ' * 300_000}{mit}", None, None), (6, None, None, None)]
    docs = spark.createDataFrame(rows, kind)
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.license, r.start, r.end) for r in licenses.scan(docs).collect())
    n, m = len(mit), len(short)
    want = [(None, "MIT-grant", 0, n), (1, "MIT-grant", 0, n), (1, "MIT-grant", n + 1, 2 * n + 1)]
    want += [(2, "MIT-grant", a, a + n) for a in (0, n + 17, 2 * n + 22)] + [(3, "MIT", a, a + m) for a in (0, m + 2, 2 * m + 4)]
    want += [(4, "MIT-grant", 0, n)] * 2 + [(5, "MIT-grant", 600_000, 600_000 + n)]
    assert got == [((d is not None, d or 0), x, a, b) for d, x, a, b in want]
    assert licenses.scan(spark.createDataFrame([], kind)).collect() == []
    parts = licenses.scan(docs, limit=20)  # several passes, the same matches
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.license, r.start, r.end) for r in parts.collect()) == got
    for order in (docs.coalesce(1), docs.repartition(8)):
        assert licenses.scan(order).count() == len(got)


def test_whole_license_texts(spark, tmp_path):
    rnd = random.Random(1)
    text = lambda: " ".join(f"t{rnd.randrange(900)}" for _ in range(1500))
    for name in ("A-1.0.txt", "B-2.0.txt"):
        (tmp_path / name).write_text(text())
    (tmp_path / "tiny.txt").write_text("too short")
    found = licenses.read_templates(spark, str(tmp_path))
    assert sorted(found) == ["A-1.0", "B-2.0"]
    changed = found["A-1.0"].split()
    for i in range(0, 1500, 60):
        changed[i] = "Holder"
    rows = [(1, f"{text()} {' '.join(changed)} {text()}"), (2, " ".join(found["B-2.0"].split()[:700])), (3, f"{found['B-2.0']}\n{found['A-1.0']}")]
    got = sorted((r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), found).collect())
    assert got == [(1, "A-1.0"), (3, "A-1.0"), (3, "B-2.0")]


def test_license_query(spark):
    """Every notice line of the table, by plain search."""
    d = "/root/testdata/sf0.1"
    got = {(r.doc_id, r.license) for r in queries.op8_license_scan(spark, d).collect()}
    want = {(r.doc_id, n) for r in queries.read(spark, d, "documents").collect() for n, t in licenses.TEMPLATES.items() if t in (r.text or "")}
    assert want <= got and len(got) <= len(want) * 1.02 + 2
