"""Removal of repeated substrings by a sparse suffix array.

Every byte covered by a LENGTH-byte string that also starts earlier (smaller id,
or same document and earlier start) goes.

1. Texts that are whole copies of a smaller id's are settled by their digest.
2. Of each LENGTH-byte string the anchor is its GRAM-byte substring of least
   hash, leftmost on ties, so equal strings have the same anchor at the same place. The
   strings that share an anchor form a segment, about one for each 35 bytes. Segments
   are range-sorted by (hash of the anchor gram, hash of the segment, id, place), which
   splits any hot gram over partitions; all but the first of equal segments are covered whole.
3. Grams with several different segments get their bytes, and deep-shallow
   sorting orders the segments' LENGTH-byte strings, of which the first of equals stays.
   A gram with more than HOT segments is dealt to parts by salt; what survives
   there meets again by the hash of the whole string, until no group is hot.
4. The covered runs of a document unite, and its bytes are read once more.

Edge cases: a null or empty text has no bytes and nothing to remove; texts under
LENGTH bytes stay; rows whose id is null can't be ordered and are left out; rows
that repeat id and text get the same result; extra columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelforge.llm.shared import join_small, table
from kernelforge.llm.suffix import equal_classes
from kernelforge.llm.text import BYTE_VALUE, U64, Powers, blocks, mix, prefix_hash, span_hash, string_buffer

LENGTH, GRAM = 100, 32
#: Segments of one gram that one task sorts together, and bytes of segments sorted at once.
HOT, AT_ONCE = 5_000, 1 << 20


def segments(buf: np.ndarray, off: np.ndarray, p: Powers):
    """(row, start, size, gram hash, segment hash) of the block's segments."""
    n, span = len(buf), LENGTH - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.astype(U64), none.astype(U64)
    c = prefix_hash(BYTE_VALUE[buf], p)
    _, down = p.get(n + 1)
    grams = n - GRAM + 1
    least = (((c[GRAM:] - c[:grams]) * down[:grams]) & U64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=U64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    anchor = (least & U64(0xFFFFFFFF)).astype(np.int64)  # of the string at each start
    inside = np.zeros(n + 1, np.int64)
    length = np.diff(off)
    long = length >= LENGTH
    np.add.at(inside, off[:-1][long], 1)
    np.add.at(inside, off[1:][long] - LENGTH + 1, -1)
    valid = np.cumsum(inside)[: len(anchor)] > 0
    begins = np.zeros(n + 1, bool)
    begins[off[:-1]] = True
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1]) | begins[1 : len(valid)]
    start = np.flatnonzero(new)
    last = valid.copy()
    last[:-1] &= ~valid[1:] | new[1:]
    size = np.flatnonzero(last) - start + LENGTH
    at = anchor[start]
    gram = span_hash(c, at, at + GRAM, p)
    whole = mix(span_hash(c, start, start + size, p) ^ (at - start).astype(U64))
    return np.searchsorted(off, start, "right") - 1, start, size, gram, whole


def _anchors(batches):
    p = Powers()
    for batch in batches:
        ids = batch.column("doc").to_numpy()
        for i, _, buf, off in blocks(batch):
            row, start, size, gram, whole = segments(buf, off, p)
            place = (start - off[row]) * 256 + size
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(ids[i + row]), pa.array(place)], ["gram", "whole", "doc", "place"])


def _sweep(batches):
    """Sorted segments: rows with gram null are covered; the others stand for segments whose gram may have several."""
    last, first_gram = None, None  # last: (gram, whole, doc, place, has an earlier segment of its gram)

    def rows(gram, doc, place):
        return pa.RecordBatch.from_arrays([gram if isinstance(gram, pa.Array) else pa.array(gram, pa.int64()), pa.array(doc, pa.int64()), pa.array(place, pa.int64())], ["gram", "doc", "place"])

    for batch in batches:
        gram, whole, doc, place = (batch.column(x).to_numpy() for x in ("gram", "whole", "doc", "place"))
        if not len(gram):
            continue
        g, w = np.concatenate(([last[0] if last else ~gram[0]], gram)), np.concatenate(([last[1] if last else 0], whole))
        fresh = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
        k = np.flatnonzero(fresh)
        first_doc, first_place = np.concatenate(([last[2] if last else 0], doc[k])), np.concatenate(([last[3] if last else 0], place[k]))
        of = np.cumsum(fresh)
        over = ~fresh & ((doc != first_doc[of]) | (place != first_place[of]))  # a repeated row covers nothing
        if over.any():
            yield rows(pa.nulls(int(over.sum()), pa.int64()), doc[over], place[over])
        first_gram = gram[0] if first_gram is None else first_gram
        if not len(k):
            continue
        kg, kd, kp = gram[k], doc[k], place[k]
        before = np.concatenate(([last is not None and last[0] == kg[0]], kg[1:] == kg[:-1]))
        if last is not None and (last[4] or before[0] or last[0] == first_gram):
            yield rows([last[0]], [last[2]], [last[3]])
        send = before | np.concatenate((kg[1:] == kg[:-1], [False])) | (kg == first_gram)
        send[-1] = False
        yield rows(kg[send], kd[send], kp[send])
        last = (kg[-1], whole[k[-1]], kd[-1], kp[-1], bool(before[-1]))
    if last is not None:
        yield rows([last[0]], [last[2]], [last[3]])


def _cut(batches):
    """The bytes of the segments that stand with each text."""
    for batch in batches:
        buf, off = string_buffer(batch.column("text"))
        data = buf.tobytes()
        for r, at in enumerate(batch.column("at").to_pylist()):
            size = [x["place"] % 256 for x in at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x["gram"] for x in at], pa.int64()), pa.array([x["salt"] for x in at], pa.int64()), pa.array([x["salts"] for x in at], pa.int64()), batch.column("doc")[r : r + 1].take(pa.array([0] * len(at))),
                    pa.array([x["place"] // 256 for x in at], pa.int64()), pa.array([data[off[r] + x["place"] // 256 : off[r] + x["place"] // 256 + n] for x, n in zip(at, size, strict=True)], pa.binary()),
                ],
                ["gram", "salt", "salts", "doc", "start", "bytes"],
            )


def _settle(batches):
    """Rows in order of (gram, salt): covered runs (bytes null), and what survives of salted grams."""
    held, n = [], 0

    def flush(t: pa.Table):
        gram, salt, salts, doc, at = (t[x].to_numpy() for x in ("gram", "salt", "salts", "doc", "start"))
        _, offs, data = t["bytes"].combine_chunks().buffers()
        off = np.frombuffer(offs, np.int32)[t["bytes"].combine_chunks().offset :][: len(t) + 1].astype(np.int64)
        buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        count = np.maximum(0, np.diff(off) - LENGTH + 1)
        row = np.repeat(np.arange(len(t)), count)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = off[row] + inner
        change = np.concatenate(([True], (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])))
        group = np.cumsum(change)[row]
        kind = equal_classes(buf, start, group, LENGTH)
        order = np.lexsort((at[row] + inner, doc[row], kind))
        later = np.zeros(len(row), bool)
        later[order[1:]] = kind[order[1:]] == kind[order[:-1]]
        lead = order[np.maximum.accumulate(np.where(later[order], 0, np.arange(len(order))))]
        later[order] &= (doc[row[order]] != doc[row[lead]]) | (at[row[order]] + inner[order] != at[row[lead]] + inner[lead])
        # Runs of covered strings of one segment.
        begin = later & ~np.concatenate(([False], later[:-1] & (row[1:] == row[:-1])))
        end = later & ~np.concatenate((later[1:] & (row[1:] == row[:-1]), [False]))
        a, b = np.flatnonzero(begin), np.flatnonzero(end)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(doc[row[a]]), pa.array(at[row[a]] + inner[a]), pa.array(at[row[b]] + inner[b] + LENGTH), pa.nulls(len(a), pa.binary())], ["gram", "doc", "start", "end", "bytes"])
        stay = np.flatnonzero(~later & (salts[row] > 1))
        if len(stay):
            raw = buf.tobytes()
            texts = [raw[s : s + LENGTH] for s in start[stay]]
            hashes = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in texts])
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(doc[row[stay]]), pa.array(at[row[stay]] + inner[stay]), pa.array(at[row[stay]] + inner[stay] + LENGTH), pa.array(texts, pa.binary())], ["gram", "doc", "start", "end", "bytes"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        n += len(t)
        held.append(t)
        if t.num_rows and sum(x["bytes"].nbytes for x in held) > AT_ONCE:
            t = pa.concat_tables(held).combine_chunks()
            g, s = t["gram"].to_numpy(), t["salt"].to_numpy()
            same = np.flatnonzero((g != g[-1]) | (s != s[-1]))
            cut = int(same[-1]) + 1 if len(same) else 0  # whole groups only; a group has HOT rows at most, or about so
            if cut:
                yield from flush(t.slice(0, cut))
            held = [t.slice(cut)]
    if held and n:
        t = pa.concat_tables(held).combine_chunks()
        if len(t):
            yield from flush(t)


def _salted(rows: DataFrame, hot: int) -> DataFrame:
    """gram's rows with salt and salts: more than ``hot`` of them are dealt to several groups."""
    crowd = table(rows.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > hot), "crowded")
    rows = join_small(rows, crowd, "gram", "left").withColumn("salts", F.ceil(F.coalesce("n", F.lit(1)) / F.lit(hot)).cast("long")).drop("n")
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc", "start"), "salts"))


def covered(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """doc and runs (array of packed start and end, not yet united) of the texts that hold covered bytes."""
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    sized = rows.where(F.octet_length("text") >= LENGTH)
    digests = table(sized.select("doc", F.unhex(F.md5("text")).alias("digest"), F.octet_length("text").cast("long").alias("end")), "digests")
    several = digests.groupBy("digest").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    copies = table(digests.join(several.select("digest", "least"), "digest").where("doc > least").select("doc", F.lit(0).cast("long").alias("start"), "end").distinct(), "copies")
    single = join_small(sized, copies.select("doc"), "doc", "left_anti")
    keys = ["gram", "whole", "doc", "place"]
    order = single.mapInArrow(_anchors, "gram long, whole long, doc long, place long").repartitionByRange(*keys).sortWithinPartitions(*keys)
    swept = table(order.mapInArrow(_sweep, "gram long, doc long, place long"), "swept")
    place = F.col("place")
    begin = F.floor(place / 256).cast("long")
    runs = copies.union(swept.where("gram is null").select("doc", begin.alias("start"), (begin + place % 256).alias("end")))
    open_ = swept.where("gram is not null").withColumn("start", begin)
    lists = _salted(open_, hot).groupBy("doc").agg(F.collect_list(F.struct("gram", "salt", "salts", "place")).alias("at"))
    cut = rows.join(lists, "doc").mapInArrow(_cut, "gram long, salt long, salts long, doc long, start long, bytes binary")
    while True:
        ready = cut.repartition("gram", "salt").sortWithinPartitions("gram", "salt")
        found = table(ready.mapInArrow(_settle, "gram long, doc long, start long, end long, bytes binary"), "settled")
        runs = runs.union(found.where("gram is null").select("doc", "start", "end"))
        left = found.where("gram is not null").select("gram", "doc", "start", "bytes")
        if not left.limit(1).count():
            return runs.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
        cut = _salted(left, hot).select("gram", "salt", "salts", "doc", "start", "bytes")


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """key, n_bytes, kept (binary), runs (array of start, end in bytes; maximal, in order)."""
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    both = rows.join(covered(docs, key, text, hot), "doc", "left")

    def keep(batches):
        for batch in batches:
            buf, off = string_buffer(batch.column("text"))
            data, kept, runs = buf.tobytes(), [], []
            for r, found in enumerate(batch.column("runs").to_pylist()):
                raw, united, out, at = data[off[r] : off[r + 1]], [], [], 0
                for a, b in sorted((x["start"], x["end"]) for x in found or []):
                    if united and a <= united[-1][1]:
                        united[-1][1] = max(united[-1][1], b)
                    else:
                        united.append([a, b])
                for a, b in united:
                    out.append(raw[at:a])
                    at = b
                kept.append(b"".join([*out, raw[at:]]))
                runs.append([{"start": a, "end": b} for a, b in united])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(np.diff(off)), pa.array(kept, pa.binary()), pa.array(runs, kind)], [key, "n_bytes", "kept", "runs"])

    return both.mapInArrow(keep, f"{key} long, n_bytes long, kept binary, runs array<struct<start:long,end:long>>")
