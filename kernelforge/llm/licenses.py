"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

A window is as long as the template (in word shingles) and windows start every
quarter of that from the start of each text, cut at its end, so a copy fills at least 7/8 of its best window and shares at least 7/9 of the
union. Each of the BANDS bands is one MinHash value; a window at similarity s meets its template
in some band with probability 1 - (1 - s)**BANDS, over 1 - 1e-10 for a copy and over 0.99998 at
s = 0.5. Where windows meet a template, its distinct shingles found there are
counted; a run holding CONTAINED of them is a match, and where a run that holds so many turns back in the
template, another copy begins.

Templates are given by name and text: their shingles travel with the
code, MAX_SHINGLES in each pass over the texts. read_templates takes whole license texts from files. Edge cases: null and empty texts and texts shorter than a
shingle hold no license; templates need five words; repeated rows return the same matches
each; an empty table returns none; extra columns play no part.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelforge.llm.text import NON_ALNUM, U64, Powers, blocks, gram_hashes, mix, word_hashes

SHINGLE, BANDS, CONTAINED, MAX_SHINGLES = 5, 16, 0.8, 1_000_000
#: Common notices, by SPDX-like name. The wording of the licenses' own notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
_SEEDS = mix(np.arange(9001, 9001 + BANDS, dtype=U64)) | U64(1)


def _words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]), NON_ALNUM, Powers())[3]


def _shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles in order of hash, and where each first stands."""
    h = _words(text)
    if len(h) < SHINGLE:
        raise ValueError(f"a template needs {SHINGLE} words")
    return np.unique(gram_hashes(h, SHINGLE), return_index=True)


def read_templates(spark: SparkSession, path: str) -> dict[str, str]:
    """License texts by file name, of files that hold SHINGLE words or more."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value").toLocalIterator()
    texts = {r["name"].rsplit(".txt", 1)[0]: r["value"] for r in rows}
    return {k: v for k, v in texts.items() if len(_words(v)) >= SHINGLE}


def _window_least(x: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Least of x[p : p + n] for p in at and n in size, by least values over powers of two."""
    out, level = np.zeros(len(at), x.dtype), np.log2(np.maximum(size, 1)).astype(np.int64)
    for k in range(int(level.max()) + 1 if len(level) else 0):
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(x[at[here]], x[at[here] + size[here] - (1 << k)])
        x = np.minimum(x[: max(0, len(x) - (1 << k))], x[1 << k :])
    return out


def _copies(place: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Cuts a run of template places into copies: one that has ``least`` distinct places ends where they turn back."""
    out, begin, seen = [], 0, set()
    for i, p in enumerate(place.tolist()):
        if len(seen) >= least and p < place[i - 1]:
            out.append((begin, i))
            begin, seen = i, set()
        seen.add(p)
    return [*out, (begin, len(place))]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, key: str = "doc_id", text: str = "text", contained: float = CONTAINED, limit: int = MAX_SHINGLES) -> DataFrame:
    """key, license, start, end (characters), containment: a row for each match."""
    parts, held = [{}], 0
    for name, t in sorted(templates.items()):
        s = _shingles(t)
        if held and held + len(s[0]) > limit:
            parts, held = [*parts, {}], 0
        parts[-1][name] = s
        held += len(s[0])
    return reduce(DataFrame.union, (_scan(docs, p, key, text, contained) for p in parts))


def _scan(docs: DataFrame, sets: dict[str, tuple], key: str, text: str, contained: float) -> DataFrame:
    by_width: dict[int, list] = {}
    order = {name: place for name, (_, place) in sets.items()}
    for name, (s, _) in sets.items():
        by_width.setdefault(len(s), []).append((name, s, [int((s * seed).min()) for seed in _SEEDS]))

    def run(batches):
        p = Powers()
        for batch in batches:
            ids = batch.column("key")
            for i, _, buf, off in blocks(batch):
                row, start, end, h = word_hashes(buf, off, NON_ALNUM, p)
                g = gram_hashes(h, SHINGLE)
                if not len(g):
                    continue
                inside = row[: len(g)] == row[SHINGLE - 1 :]
                first = np.searchsorted(row, row[: len(g)])  # of the text's shingles
                last = np.minimum(np.searchsorted(row, row[: len(g)], "right") - SHINGLE + 1, len(g))
                place = np.arange(len(g))
                banded = [g * seed for seed in _SEEDS]
                found = []
                for width, group in by_width.items():
                    at = place[inside & ((place - first) % max(1, width // 4) == 0)]
                    size = np.minimum(width, last[at] - at)
                    least = [_window_least(x, at, size) for x in banded]
                    for name, s, bands in group:
                        meets = np.zeros(len(at), bool)
                        for x, b in zip(least, bands, strict=True):
                            meets |= x == U64(b)
                        if not meets.any():
                            continue
                        near, met = np.zeros(len(g) + 1, np.int64), at[meets]
                        np.add.at(near, np.maximum(met - width, first[met]), 1)
                        np.add.at(near, np.minimum(met + 2 * width, last[met]), -1)
                        here = np.flatnonzero((np.cumsum(near[:-1]) > 0) & inside)
                        here = here[np.isin(g[here], s)]
                        cut = np.flatnonzero((np.diff(here) > width) | (row[here[1:]] != row[here[:-1]])) + 1
                        for run_ in np.split(here, cut) if len(here) else []:
                            for a, b in _copies(order[name][np.searchsorted(s, g[run_])], contained * len(s)):
                                copy = run_[a:b]
                                share = len(np.unique(g[copy])) / len(s)
                                if share >= contained:
                                    found.append((int(row[copy[0]]), name, int(start[copy[0]]), int(end[copy[-1] + SHINGLE - 1]), share))
                if found:
                    found.sort()
                    chars = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
                    r, name, a, b, share = zip(*found, strict=True)
                    r = np.array(r)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i + r)), pa.array(name), pa.array(chars[np.array(a)] - chars[off[r]]), pa.array(chars[np.array(b)] - chars[off[r]]), pa.array(share)], [key, "license", "start", "end", "containment"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"{key} {kind}, license string, start long, end long, containment double")
