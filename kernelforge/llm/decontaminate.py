"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark texts.

Texts are normalised to words, and words to numbers. Every window of ``width`` consecutive words of
an item holds one of the item's blocks of (width + 1) // 2 words, which follow each other from its start; the automaton's patterns are
these blocks, as sequences of word numbers (a short item is one whole pattern), so it has at most a node for
each word of the benchmark. One scan of a text finds the blocks, and each is extended word by word
to both sides in the item's text, which decides exactly which windows occur. Hits are reported as
word counts and as character offsets in the original text. Whole texts are scanned. A benchmark
is broadcast in one part up to PART_WORDS words (100 MB of automaton for a worker, ten times the usual
collections of test questions); beyond that each further part is a pass whose hits unite with the others'.

Edge cases: a null or wordless text has no words and no hit; an item without
words has no window; an item whose id is null marks words but has no name to be listed by; items with equal windows all count;
rows pass through one by one, so repeated rows get the same result; an empty benchmark marks nothing.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kernelforge.llm.shared import append_column
from kernelforge.llm.text import LOWER, NON_ALNUM, string_buffer

WIDTH = 13
PART_WORDS = 2_000_000
#: Places of one block beyond which they are looked up by the words beside it.
CROWD = 8
_TABLE = bytes(0x20 if NON_ALNUM[i] else int(LOWER[i]) for i in range(256))
_TYPE = "struct<n_words:long,n_hit:long,items:array<string>,spans:array<struct<start:long,end:long>>,hits:array<int>>"


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def pattern_parts(benchmark: DataFrame, item: str, text: str, limit: int = PART_WORDS):
    """(name, words) of the items, in parts of about ``limit`` words, streamed through the driver."""
    part, held = [], 0
    for row in benchmark.select(item, text).toLocalIterator():
        words = normal_words(row[1])
        if words:
            part.append((None if row[0] is None else str(row[0]), b" ".join(words)))
            held += len(words)
        if held >= limit:
            yield part
            part, held = [], 0
    if part:
        yield part


class Matcher:
    """Finds the windows of some items in texts given as lists of words."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int) -> None:
        import ahocorasick

        self.width, self.block, self.number, self.items = width, (width + 1) // 2, {}, []
        places = defaultdict(list)
        for name, text in items:
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in text.split(b" "))
            size = self.block if len(ids) >= width else len(ids)
            for at in range(0, len(ids) - size + 1, size):
                places[ids[at : at + size]].append((len(self.items), at))
            self.items.append((name, ids))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for block, found in places.items():
            self.automaton.add_word(block, (len(block), found if len(found) <= CROWD else self._beside(found, len(block))))
        if places:
            self.automaton.make_automaton()

    def _beside(self, found: list, size: int) -> tuple:
        """Places by the word before and by the word after; those that are a whole item apart."""
        before, after, whole = defaultdict(list), defaultdict(list), []
        for i, at in found:
            ids = self.items[i][1]
            if len(ids) < self.width:
                whole.append((i, at))
                continue
            before[ids[at - 1] if at else -1].append((i, at))
            after[ids[at + size] if at + size < len(ids) else -1].append((i, at))
        return dict(before), dict(after), whole

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of hit words, and the names of items with occurring windows."""
        if not self.items:
            return [], set()
        text = tuple(map(self.number.get, words, repeat(0)))
        spans, names = [], set()
        for end, (size, places) in self.automaton.iter(text):
            at = end - size + 1
            if isinstance(places, tuple):
                before, after, whole = places
                places = {*whole, *(before.get(text[at - 1], ()) if at else ()), *(after.get(text[end + 1], ()) if end + 1 < len(text) else ())}
            for i, p in places:
                name, ids = self.items[i]
                left = right = 0
                if len(ids) >= self.width:
                    most = self.width - size
                    while left < most and left < p and left < at and ids[p - left - 1] == text[at - left - 1]:
                        left += 1
                    while right < most and p + size + right < len(ids) and end + right + 1 < len(text) and ids[p + size + right] == text[end + right + 1]:
                        right += 1
                    if left + size + right < self.width:
                        continue
                spans.append((at - left, end + right + 1))
                if name is not None:
                    names.add(name)
        return spans, names


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _offsets(raw: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Character offsets in the original of spans of words."""
    b = np.frombuffer(raw, np.uint8)
    word = ~NON_ALNUM[b]
    start = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
    end = np.flatnonzero(word & ~np.concatenate((word[1:], [False]))) + 1
    chars = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))
    return [{"start": int(chars[start[i]]), "end": int(chars[end[j - 1]])} for i, j in spans]


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, into: str = "contamination") -> DataFrame:
    """docs with a struct ``into``: n_words, n_hit (words inside a window's occurrence), items, spans of characters."""
    out = None
    for part in pattern_parts(benchmark, item, item_text):
        out = _pass(docs if out is None else out, part, text, into, out is not None, width)
    return _pass(docs, [], text, into, False, width) if out is None else out


def _pass(docs: DataFrame, part: list, text: str, into: str, again: bool, width: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast({"part": part, "made": {}})
    before = f"{into}_before"
    docs = docs.withColumnRenamed(into, before) if again else docs

    def make():
        made = sent.value["made"]  # stays with the worker, so the automaton is built once in each
        if not made:
            made["matcher"] = Matcher(sent.value["part"], width)
        matcher = made["matcher"]

        def find(batch: pa.RecordBatch) -> pa.Array:
            buf, off = string_buffer(batch.column(text))
            data, out = buf.tobytes(), []
            old = batch.column(before).to_pylist() if again else None
            for r in range(len(batch)):
                raw = data[off[r] : off[r + 1]]
                w = raw.translate(_TABLE).split()
                spans, items = matcher.find(w)
                if old:
                    h = old[r]["hits"]
                    spans += zip(h[::2], h[1::2], strict=True)
                    items |= set(old[r]["items"])
                spans = _merge(spans)
                out.append({"n_words": len(w), "n_hit": sum(y - x for x, y in spans), "items": sorted(items), "spans": _offsets(raw, spans) if spans else [], "hits": [v for x in spans for v in x]})
            return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("hits", pa.list_(pa.int32()))]))

        return find

    return append_column(docs, into, _TYPE, make).drop(before)
