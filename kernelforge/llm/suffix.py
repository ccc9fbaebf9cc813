"""Deep-shallow suffix sorting of fixed-length byte strings, as numpy batches.

Shallow: multikey quicksort whose characters are 8-byte words; each round sorts
all open groups by their next word, and groups of one are done. Deep: a group
that still shares SHALLOW bytes is compared with its first string word by word
if that settles it (all equal), else ordered by a blind trie, which compares
each string once with one other.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 24


def words_at(buf: np.ndarray) -> np.ndarray:
    """Big-endian 8-byte word at each byte position; the buffer counts as zero-padded."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8))).astype(np.uint64)
    out = np.zeros(len(buf), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(buf)]
    return out


class BlindTrie:
    """A trie that keeps branching depths and bytes only; strings are read once on the way in."""

    def __init__(self, length: int) -> None:
        self.length, self.root, self.texts = length, None, []

    def add(self, text: bytes, name: int) -> None:
        """Nodes are [depth, {byte: child}]; leaves are [length, names, index of text]."""
        if self.root is None:
            self.root = [self.length, [name], 0]
            self.texts.append(text)
            return
        node, path = self.root, []
        while node[0] < self.length:  # blind descent: any leaf that agrees on the branching bytes met
            path.append(node)
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        other = self.texts[node[2]]
        differ = int.from_bytes(text, "big") ^ int.from_bytes(other, "big")
        common = self.length - (differ.bit_length() + 7) // 8
        if common == self.length:
            node[1].append(name)
            return
        self.texts.append(text)
        leaf = [self.length, [name], len(self.texts) - 1]
        at, above = self.root, None
        while at[0] < common:
            above, at = at, at[1][other[at[0]]]
        if at[0] == common:
            at[1][text[common]] = leaf
            return
        fork = [common, {text[common]: leaf, other[common]: at}]
        if above is None:
            self.root = fork
        else:
            above[1][other[above[0]]] = fork

    def leaves(self):
        """Lists of equal strings' names, in the order of the strings."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] == self.length:
                yield node[1]
            else:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))


def equal_classes(buf: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """A class number for each string buf[start : start + length]: equal if and only if group and bytes are equal."""
    word, out = words_at(buf), np.full(len(start), -1, np.int64)
    rows, g, fresh = np.arange(len(start)), group.astype(np.int64), 0

    def split(rows, g, key):
        """Sort by (g, key); rows of groups of one get their class."""
        nonlocal fresh
        order = np.lexsort((key, g))
        rows, g, key = rows[order], g[order], key[order]
        first = np.concatenate(([True], (g[1:] != g[:-1]) | (key[1:] != key[:-1]))) if len(rows) else np.zeros(0, bool)
        new = np.cumsum(first) - 1
        alone = np.bincount(new)[new] == 1 if len(rows) else first
        out[rows[alone]] = fresh + np.arange(alone.sum())
        fresh += int(alone.sum())
        return rows[~alone], new[~alone]

    for depth in range(0, min(SHALLOW, length - 7), 8):
        rows, g = split(rows, g, word[start[rows] + depth])
    if not len(rows):
        return out
    order = np.argsort(g, kind="stable")
    rows, g = rows[order], g[order]
    cut = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    first = np.repeat(rows[cut], np.diff(np.append(cut, len(rows))))
    same = np.ones(len(rows), bool)
    for depth in [*range(SHALLOW, length - 7, 8), max(0, length - 8)]:
        same &= word[start[rows] + depth] == word[start[first] + depth]
    whole = np.logical_and.reduceat(same, cut)
    data = buf.tobytes()
    for a, b, equal in zip(cut, np.append(cut[1:], len(rows)), whole, strict=True):
        if equal:
            out[rows[a:b]] = fresh
            fresh += 1
            continue
        trie = BlindTrie(length)
        for r in rows[a:b]:
            trie.add(data[start[r] : start[r] + length], int(r))
        for names in trie.leaves():
            out[names] = fresh
            fresh += 1
    return out
