"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

Counts are quantised to q = 1 + floor(log2 c) and an n-gram is put into the
filter with each of the levels 1 to q; a count is read back by probing level
after level until one is absent. Words and word pairs share the filter. Its
pieces are sized by the distinct n-grams they hold (BITS bits an entry, HASHES
probes, so about 1 % of absent entries seem present), and it grows with the
corpus. It is broadcast whole up to SLICE_BYTES. A larger filter is broadcast in slices of at most that size, each
with a pass of its own over the texts, and no n-gram is dropped; the pieces of single words go with every slice, and
they grow with the vocabulary alone.

The model: P(w) = (c(w) + 1) / (N + V + 1), P(w | h) = (c(hw) + MU P(w)) / (c(h) + MU),
with counts read from the filter; the history of a text's first token is the start of a text,
so its c(h) is the exact number of training texts. The reference score ``base_score`` uses exact
counts: frequent words (at most HEAD of them) from a broadcast dictionary, all
others by a join on their hash.

Edge cases: a null text counts as empty and has the one end token; a row whose id
is null is trained on and scored, and held_out is false for it; equal rows score alike; with
nothing to learn from, N = V = 0 and every probability is 1; extra columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelforge.llm.shared import table
from kernelforge.llm.text import SPACE, U64, Powers, blocks, mix, per_row, word_hashes

BITS, HASHES, MU = 10, 5, 100.0
SLICE_BYTES = 256 << 20
HEAD = 1 << 17
#: Distinct n-grams that a task gathers before it hands them on.
HELD = 1 << 21
_END, _START = U64(0xE7D), U64(0x57A27)
_LEVEL = mix(np.arange(1, 65, dtype=U64))
_PROBE = mix(np.arange(1001, 1001 + HASHES, dtype=U64)) | U64(1)


def _tokens(buf: np.ndarray, off: np.ndarray, p: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the tokens with an end after each text, offsets of the texts)."""
    row, _, _, h = word_hashes(buf, off, SPACE, p)
    n = len(off) - 1
    count = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
    at = np.concatenate(([0], np.cumsum(count + 1)))
    out = np.full(at[-1], _END, U64)
    keep = np.ones(len(out), bool)
    keep[at[1:] - 1] = False
    out[keep] = h
    return out, at


def _pairs(t: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(history of each token, hash of the pair)."""
    before = np.concatenate(([_START], t[:-1]))
    before[at[:-1]] = _START
    return before, mix(mix(before) * U64(0x9E3779B97F4A7C15) + t)


def _gather(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    v, c = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
    order = np.argsort(v)
    v, c = v[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
    return v[first], np.add.reduceat(c, first) if len(v) else c


def _counts(docs: DataFrame, text: str, pairs: bool) -> DataFrame:
    """(h, c) of tokens, or of pairs and histories, combined within tasks."""

    def run(batches):
        p, held, n = Powers(), [], 0
        for batch in batches:
            for _, _, buf, off in blocks(batch, text):
                t, at = _tokens(buf, off, p)
                held.append(np.unique(_pairs(t, at)[1] if pairs else t, return_counts=True))
                n += len(held[-1][0])
                if n > HELD:
                    held = [_gather(held)]
                    n = len(held[0][0])
                    if n > HELD // 2:
                        yield from _rows(*held[0])
                        held, n = [], 0
        if held:
            yield from _rows(*_gather(held))

    return docs.select(text).mapInArrow(run, "h long, c long")


def _rows(h: np.ndarray, c: np.ndarray):
    for k in range(0, len(h), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(h[k : k + (1 << 16)].view(np.int64)), pa.array(c[k : k + (1 << 16)].astype(np.int64))], ["h", "c"])


def _positions(h: np.ndarray, level: np.ndarray | int, probe: int) -> np.ndarray:
    """A 64-bit number; modulo a piece's bits it is the place in it."""
    x = (h ^ _LEVEL[level]) * _PROBE[probe]
    return x ^ (x >> U64(32))


def build(counts: DataFrame, pieces: int) -> DataFrame:
    """The filter as a table: piece, bits (packed), n_bits."""

    def run(batches):
        held = [(b.column("h").to_numpy(zero_copy_only=False).view(U64), b.column("c").to_numpy(zero_copy_only=False)) for b in batches]
        if not held:
            return
        h, c = _gather(held)
        q = np.minimum(64, 1 + np.floor(np.log2(c)).astype(np.int64))
        piece = h.view(np.int64) % pieces
        for k in np.unique(piece):
            at = piece == k
            g, levels = h[at], q[at]
            n_bits = max(64, int(levels.sum()) * BITS)
            n_bits += -n_bits % 8
            bits = np.zeros(n_bits, np.uint8)
            for level in range(1, int(levels.max()) + 1):
                part = g[levels >= level]
                for probe in range(HASHES):
                    bits[_positions(part, level - 1, probe) % U64(n_bits)] = 1
            yield pa.RecordBatch.from_arrays([pa.array([int(k)]), pa.array([np.packbits(bits).tobytes()], pa.binary()), pa.array([n_bits])], ["piece", "bits", "n_bits"])

    return counts.repartition(pieces, F.pmod("h", F.lit(pieces))).mapInArrow(run, "piece long, bits binary, n_bits long")


class Filter:
    """The pieces of one slice, laid end to end; ``first`` is -1 for pieces of other slices."""

    def __init__(self, pieces: int, rows: list) -> None:
        self.pieces = pieces
        self.first, self.n_bits = np.full(pieces, -1, np.int64), np.ones(pieces, np.int64)
        at = 0
        for r in rows:
            self.first[r["piece"]], self.n_bits[r["piece"]] = at, r["n_bits"]
            at += r["n_bits"]
        self.bits = np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), np.uint8)

    def arrays(self) -> tuple:
        return self.pieces, self.first, self.n_bits, self.bits


def probe(arrays: tuple, h: np.ndarray) -> np.ndarray:
    """The quantised level of each n-gram, 0 if absent; -1 if its piece is in another slice."""
    pieces, first, n_bits, bits = arrays
    piece = h.view(np.int64) % pieces
    level = np.where(first[piece] < 0, -1, 0)
    left = np.flatnonzero(level == 0)
    for k in range(64):
        for i in range(HASHES):
            if not len(left):
                return level
            at = first[piece[left]] + (_positions(h[left], k, i) % n_bits[piece[left]].astype(U64)).astype(np.int64)
            left = left[(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0]
        level[left] = k + 1
    return level


def estimate(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: 1, then 1.5 times the level's smallest."""
    return np.where(level <= 0, 0.0, np.where(level == 1, 1.0, 1.5 * 2.0 ** np.maximum(level - 1, 0)))


def _slices(spark, made: DataFrame, pieces: int):
    """The filter's pieces, streamed through the driver one slice of bounded size at a time."""
    rows, size = [], 0
    for r in made.toLocalIterator():
        if rows and size + r["n_bits"] // 8 > SLICE_BYTES:
            yield Filter(pieces, rows)
            rows, size = [], 0
        rows.append(r)
        size += r["n_bits"] // 8
    if rows:
        yield Filter(pieces, rows)


def score(docs: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, and pair_rate (share of known pairs)."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(~learn_from, F.lit(False)).alias("held_out"))
    train = rows.where(~F.col("held_out"))
    pieces = max(12, 2 * docs.rdd.getNumPartitions())
    words = table(_counts(train, "text", False).groupBy("h").agg(F.sum("c").alias("c")), "word-counts")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # Each training text has one end token.
    texts = words.where(F.col("h") == int(_END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    head = words.orderBy(F.desc("c"), "h").limit(HEAD).toArrow()  # a cache of bounded size
    h, c = head["h"].to_numpy().view(U64), head["c"].to_numpy()
    order = np.argsort(h)
    dictionary = spark.sparkContext.broadcast((h[order], c[order], float(total), float(distinct), float(texts)))
    singles = table(build(words, pieces), "word-filter")
    pairs = table(build(_counts(train, "text", True), pieces), "pair-filter")
    if (pairs.agg(F.sum("n_bits")).first()[0] or 0) // 8 > SLICE_BYTES:
        rows = table(rows, "rows")  # numbers that name the rows in every pass, whatever docs is made of
    parts = [spark.sparkContext.broadcast(f.arrays()) for f in _slices(spark, singles, pieces)]
    scored = None
    for k, f in enumerate(_slices(spark, pairs, pieces)):
        one = _pass(rows, dictionary, parts, spark.sparkContext.broadcast(f.arrays()), k == 0)
        scored = one if scored is None else scored.unionByName(one)
    if scored is None:
        scored = _pass(rows, dictionary, [], spark.sparkContext.broadcast(Filter(pieces, []).arrays()), True)
    scored = table(scored, "scores")
    base = scored.where("first")
    tail = base.where("size(tail) > 0").select("uid", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("uid", F.col("x.tail").alias("h"), F.col("x.times").alias("times"))
    known = tail.join(words, "h", "left").groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known_tail"),
        F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(total + distinct + 1)))).alias("base_tail"),
    )
    both = scored.groupBy("uid").agg(F.sum("lm").alias("lm"), F.sum("pairs").alias("pairs"))
    return (
        base.drop("lm", "pairs", "tail", "times").join(known, "uid", "left").join(both, "uid").select(
            F.col("key").alias(key), "held_out", "n_tokens", (F.col("known_head") + F.coalesce("known_tail", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
            (F.col("base_head") + F.coalesce("base_tail", F.lit(0.0))).alias("base_score"), F.col("lm").alias("score"), (F.col("pairs") / F.col("n_tokens")).alias("pair_rate"),
        )
    )


def _pass(rows: DataFrame, dictionary, words: list, pairs, first: bool) -> DataFrame:
    """One pass over the texts: the terms of the pairs in this slice; in the first pass, the base score too."""

    def run(batches):
        p = Powers()
        known_h, known_c, total, distinct, texts = dictionary.value
        for batch in batches:
            for i, j, buf, off in blocks(batch):
                t, at = _tokens(buf, off, p)
                n = j - i
                word, inverse, times = np.unique(t, return_inverse=True, return_counts=True)
                level = np.zeros(len(word), np.int64)
                for w in words:
                    level = np.maximum(level, probe(w.value, word))
                approx = np.minimum(estimate(level), total)
                before, pair = _pairs(t, at)
                q = probe(pairs.value, pair)
                single = ((approx + 1) / (total + distinct + 1))[inverse]
                history = np.empty(len(t))
                history[1:] = approx[inverse[:-1]]
                history[at[:-1]] = texts
                seen = np.minimum(estimate(q), history)
                term = np.where(q < 0, 0.0, np.log10(np.maximum((seen + MU * single) / (history + MU), 1e-300)))
                out = {"lm": per_row(np.add, term, at, 0.0), "pairs": per_row(np.add, (q > 0).astype(np.int64), at, 0)}
                exact = np.zeros(len(word), np.int64)
                k = np.minimum(np.searchsorted(known_h, word), max(0, len(known_h) - 1))
                hit = known_h[k] == word if len(known_h) else np.zeros(len(word), bool)
                exact[hit] = known_c[k[hit]]
                in_head = hit[inverse]
                base = np.where(in_head, np.log10((exact + 1) / (total + distinct + 1))[inverse], 0.0)
                row = np.repeat(np.arange(n), np.diff(at))
                tail = np.flatnonzero(~in_head)
                cells, many = np.unique(row[tail] * len(word) + inverse[tail], return_counts=True)
                ends = pa.array(np.searchsorted(cells // len(word), np.arange(n + 1)).astype(np.int32))
                cols = [
                    batch.column("key").slice(i, n), batch.column("held_out").slice(i, n), batch.column("uid").slice(i, n), pa.array(out["lm"]), pa.array(out["pairs"]), pa.array(np.diff(at)),
                    pa.array(per_row(np.add, (in_head).astype(np.int64), at, 0)), pa.array(per_row(np.add, base, at, 0.0)),
                    pa.ListArray.from_arrays(ends, pa.array(word[cells % len(word)].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(many)), pa.array(np.full(n, first)),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["key", "held_out", "uid", "lm", "pairs", "n_tokens", "known_head", "base_head", "tail", "times", "first"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, held_out boolean, uid long, lm double, pairs long, n_tokens long, known_head long, base_head double, tail array<long>, times array<long>, first boolean")
