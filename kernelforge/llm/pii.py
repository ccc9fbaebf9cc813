"""Personal data by weak supervision, in DataFrame functions only.

Regular expressions propose spans: the base kinds, which always stay, and looser
forms of them. Labelers vote on every proposal: the strict form, a gazetteer of
words before it, the context's boundaries, and the group shape of its digits.
Vote patterns (at most 16 for each kind) are counted over all documents;
expectation-maximisation of a two-class latent model on these counts gives each labeler's
reliability and each pattern's posterior, on which a logistic span classifier over
votes and kinds is trained. Looser spans that it gives ADD or more join the base ones.

Edge cases: a null or empty text has no span; positions are code points, ends
exclusive; rows pass through one by one, so repeated rows get the same result
and an empty table an empty one; input columns named like results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelforge.llm.shared import table

KINDS = ("email", "ip", "card", "phone")
ADD = 0.9
_LOCAL = "[A-Za-z0-9._%+-]"
# Possessive and anchored forms of the base patterns: the same matches without backtracking over long runs.
BASE = {
    "email": rf"(?=[A-Za-z0-9._%+-])(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser forms; a match that overlaps a base span of any kind is none.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])",
    "card": r"(?<![0-9-])(?<![0-9] )[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![ -]?[0-9])",
    "phone": r"(?<![0-9A-Za-z+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])",
}
#: What every match of the base and of the looser form holds, as regular expressions: a text without it is not searched.
NEEDS = {"email": ("@", "at"), "ip": (r"\.", ":"), "card": ("[0-9][ -]?[0-9]", "[0-9]{4}"), "phone": (r"\+", "[.-]")}
GAZETTEER = {
    "email": "e-?mail|mail|contact|kontakt|correo|courriel|write to",
    "ip": "ip|address|host|server|adresse|direcci[oó]n",
    "card": "card|visa|mastercard|credit|karte|carte|tarjeta|pan",
    "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
}


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of a pattern's matches in order, from the lengths of matches and gaps."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.aggregate(
        F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g")),
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint,text:string>>)").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["g"]) + F.length(x["m"])).cast("long").alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["g"])).cast("long").alias("start"), (acc["at"] + F.length(x["g"]) + F.length(x["m"])).cast("long").alias("end"), x["m"].alias("text")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def _luhn(text: Column) -> Column:
    digits = F.reverse(F.split(F.regexp_replace(text, "[^0-9]", ""), "(?<=.)(?=.)"))
    value = F.transform(digits, lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, b: a + b) % 10 == 0


def _passes(kind: str, text: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.expr("0") + F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return _luhn(text)
    if kind == "phone":
        return F.length(F.regexp_replace(text, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _votes(kind: str, text: Column, x: Column, base: bool) -> Column:
    before = F.substring(text, F.greatest(F.lit(1), (x["start"] - 29).cast("int")), F.least(F.lit(30), x["start"].cast("int")))
    after = F.substring(text, (x["end"] + 1).cast("int"), F.lit(1))
    clean = ((F.length(before) == 0) | before.rlike(r"[\s(\[<\"':;,.|=]$")) & ((F.length(after) == 0) | after.rlike(r"[\s)\]>\"':;,.|!?]"))
    shape = x["text"].rlike(r"[0-9]{3,4}[ .-][0-9]{4}$" if kind in ("card", "phone") else r"[.:][A-Za-z0-9]{1,6}$")
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(base).alias("base"),
        (F.lit(8 * base) + F.when(before.rlike(rf"(?i)\b(?:{GAZETTEER[kind]})\b[^A-Za-z0-9]*(?:\w+[^A-Za-z0-9]+)?$"), 4).otherwise(0) + F.when(clean, 2).otherwise(0) + F.when(shape, 1).otherwise(0)).alias("votes"),
    )


def proposals(docs: DataFrame, text: str = "text", into: str = "proposed") -> DataFrame:
    """docs with ``into``: array<struct<kind, start, end, base, votes>>, base spans and looser ones that overlap none of them."""
    whole = F.coalesce(F.col(text), F.lit(""))
    kind = "array<struct<kind:int,start:bigint,end:bigint,base:boolean,votes:int>>"
    none = F.expr(f"cast(array() as {kind})")

    def of(k: str, pattern: str, need: str, base: bool) -> Column:
        spans = _spans(whole, pattern)
        spans = F.filter(spans, lambda x: _passes(k, x["text"])) if base else spans
        return F.when(whole.rlike(need), F.transform(spans, lambda x: _votes(k, whole, x, base)).cast(kind)).otherwise(none)

    docs = docs.drop(into).withColumn("__base", F.concat(*(of(k, BASE[k], NEEDS[k][0], True) for k in KINDS)))
    loose = F.concat(*(of(k, LOOSE[k], NEEDS[k][1], False) for k in KINDS))
    docs = docs.withColumn("__loose", F.filter(loose, lambda x: ~F.exists("__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))
    return docs.withColumn(into, F.array_sort(F.concat("__base", "__loose"))).drop("__base", "__loose")


def estimate(counts: dict[tuple[int, int], int], rounds: int = 200) -> dict[tuple[int, int], float]:
    """Posterior of each (kind, votes): two classes, independent labelers, the kinds' priors and reliabilities apart."""
    out = {}
    for kind in range(len(KINDS)):
        cells = {v: n for (k, v), n in counts.items() if k == kind}
        total = sum(cells.values())
        if not total:
            continue
        prior, yes, no = 0.5, [0.9, 0.3, 0.8, 0.8], [0.1, 0.02, 0.4, 0.3]

        def post(v: int) -> float:
            a, b = math.log(prior), math.log(1 - prior)
            for j in range(4):
                bit = v >> (3 - j) & 1
                a += math.log(yes[j] if bit else 1 - yes[j])
                b += math.log(no[j] if bit else 1 - no[j])
            return 1 / (1 + math.exp(min(700, b - a)))

        for _ in range(rounds):
            p = {v: post(v) for v in cells}
            hit = sum(n * p[v] for v, n in cells.items())
            miss = total - hit
            # Beta priors keep a labeler better than chance and a class from dying out.
            prior = (hit + 5) / (total + 10)
            yes = [(sum(n * p[v] for v, n in cells.items() if v >> (3 - j) & 1) + 9 * y) / (hit + 10) for j, y in enumerate((0.9, 0.3, 0.8, 0.8))]
            no = [(sum(n * (1 - p[v]) for v, n in cells.items() if v >> (3 - j) & 1) + 10 * y) / (miss + 11) for j, y in enumerate((0.1, 0.02, 0.4, 0.3))]
        out |= {(kind, v): post(v) for v in cells}
    return out


def train(counts: dict[tuple[int, int], int], posterior: dict[tuple[int, int], float], rounds: int = 500) -> list[float]:
    """Weights of the logistic classifier on [1, the four votes, the kinds], by gradient descent on the counted patterns."""
    w, total = [0.0] * (5 + len(KINDS)), sum(counts.values()) or 1
    cells = [([1.0, *(v >> (3 - j) & 1 for j in range(4)), *(float(k == i) for i in range(len(KINDS)))], n / total, posterior[k, v]) for (k, v), n in counts.items()]
    for _ in range(rounds):
        grad = [1e-4 * x for x in w]
        for x, n, p in cells:
            error = n * (1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True)))) - p)
            grad = [g + error * b for g, b in zip(grad, x, strict=True)]
        w = [a - 4 * g for a, g in zip(w, grad, strict=True)]
    return w


def _score(w: list[float], x: Column) -> Column:
    z = F.lit(w[0])
    for j in range(4):
        z = z + F.lit(w[1 + j]) * (F.shiftright(x["votes"], 3 - j).bitwiseAND(1)).cast("double")
    return 1 / (1 + F.exp(-(z + F.element_at(F.array(*map(F.lit, w[5:])), x["kind"] + 1))))


def find(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """docs with ``into``: array<struct<kind, start, end, base, score>> by kind and start."""
    seen = table(proposals(docs, text, "__seen"), "proposals")  # the patterns run once; counting and scoring read the result
    rows = seen.select(F.explode("__seen").alias("x")).groupBy("x.kind", "x.votes").count().collect()  # 64 at most
    counts = {(r["kind"], r["votes"]): r["count"] for r in rows}
    w = train(counts, estimate(counts))
    out = F.transform("__seen", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"), _score(w, x).alias("score")))
    return seen.drop(into).withColumn(into, F.filter(out, lambda x: x["base"] | (x["score"] >= ADD))).drop("__seen")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets."""
    found = find(docs, text, "__pii")
    name, whole = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS)), F.col(text)
    order = F.array_sort(F.transform("__pii", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    part = lambda a, b: F.substring(whole, (a + 1).cast("int"), (b - a).cast("int"))
    done = F.aggregate(
        order, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], part(acc["at"], x["start"]), F.element_at(name, x["kind"] + 1))).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(whole, (acc["at"] + 1).cast("int"), F.length(whole))),
    )
    return found.withColumn(text, F.when(F.size("__pii") > 0, done).otherwise(whole)).drop("__pii")
