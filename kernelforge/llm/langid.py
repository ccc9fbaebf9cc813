"""Language identification: multinomial naive Bayes over hashed character n-grams.

One pass counts hashed 1- to 3-grams per language, dense inside a task and
summed by a partially aggregated shuffle; the log-probability matrix, whose
size is bounded by MAX_CELLS, is broadcast; one more pass scores every text in
numpy. Whole texts count.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; so is
every text if there is nothing to learn from. Rows pass through one by one, so
repeated rows get the same result and an empty table gives an empty one. Ties go
to the language first in alphabetical order. More than MAX_LANGUAGES languages are an
error, raised before any text is counted. An input column named like the
result column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelforge.llm.shared import append_column
from kernelforge.llm.text import blocks, per_row

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Languages times buckets: 32 MB of doubles. With more languages there are fewer buckets.
MAX_CELLS = 1 << 22
#: Languages that leave 256 buckets each; more are an error.
MAX_LANGUAGES = MAX_CELLS >> 8
_MUL = np.uint32(0x9E3779B1)
_FOLD = np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(0x600)], np.uint32)
_FOLD[[i for i in range(0x600) if not chr(i).isalpha()]] = 32


def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _points(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the block, and each text's offsets in them."""
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    n = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    return points, n[off]


def _buckets(points: np.ndarray, off: np.ndarray, shift: int):
    """For each order, the bucket of the n-gram that starts at each position; one past the last bucket where it would leave its text."""
    folded = np.where(points < len(_FOLD), _FOLD[np.minimum(points, len(_FOLD) - 1)], points)
    h, outside = np.full(len(folded), 0x811C9DC5, np.uint32), 1 << (32 - shift)
    for j in range(len(ORDERS)):
        h = (h[: len(folded) - j] ^ folded[j:]) * _MUL
        h ^= h >> np.uint32(15)
        out = np.full(len(folded), outside, np.int32)
        out[: len(h)] = (h * _MUL) >> np.uint32(shift)
        for k in range(1, j + 1):
            last = off[1:] - k
            out[last[last >= off[:-1]]] = outside
        yield out


class Model:
    """languages, and log-probabilities [language, bucket] with class priors."""

    def __init__(self, languages: list[str], shift: int, table: np.ndarray, prior: np.ndarray) -> None:
        self.languages, self.shift, self.table, self.prior = languages, shift, table, prior


def fit(docs: DataFrame, learn_from: Column | None = None, text: str = "text", lang: str = "lang") -> Model:
    """Learn from the rows where ``learn_from`` holds and text and lang are not null."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = (rows if learn_from is None else rows.where(learn_from)).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    count = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(count) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} distinct values of {lang} to learn from; clean the column or narrow learn_from")
    languages = sorted(count)
    if not languages:
        return Model([], 32, np.zeros((0, 0)), np.zeros(0))
    bits = min(BUCKETS.bit_length() - 1, max(8, (MAX_CELLS // len(languages)).bit_length() - 1))
    width, shift, number = 1 << bits, 32 - bits, {x: i for i, x in enumerate(languages)}

    def counts(batches):
        total = np.zeros((len(languages), width + 1), np.int64)
        for batch in batches:
            of = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for i, j, buf, off in blocks(batch):
                points, at = _points(buf, off)
                base = np.repeat(of[i:j] * (width + 1), np.diff(at))
                for b in _buckets(points, at, shift):
                    total += np.bincount(base + b, minlength=total.size).reshape(total.shape)
        total = np.ascontiguousarray(total[:, :width]).reshape(-1)
        cell = np.flatnonzero(total)
        for k in range(0, len(cell), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(cell[k : k + (1 << 16)]), pa.array(total[cell[k : k + (1 << 16)]])], ["cell", "n"])

    found = rows.mapInArrow(counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(languages) * width)
    total[found["cell"].to_numpy()] = found["n"].to_numpy()
    smooth = total.reshape(len(languages), width) + 0.5
    table = np.pad(np.log(smooth / smooth.sum(axis=1, keepdims=True)), ((0, 0), (0, 1)))  # nothing for n-grams that leave their text
    docs_of = np.array([count[x] for x in languages], float)
    return Model(languages, shift, table, np.log(docs_of / docs_of.sum()))


def predict(docs: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """docs with a struct ``into``: lang_pred, score (posterior of that language), margin (log-odds a character)."""
    sent = docs.sparkSession.sparkContext.broadcast({"languages": model.languages, "shift": model.shift, "table": model.table, "prior": model.prior, "letters": _letters()})

    def make():
        m = sent.value
        names, n_lang = np.array([*m["languages"], "und"], object), len(m["languages"])

        def score(batch: pa.RecordBatch) -> pa.Array:
            best, post, margin = np.full(len(batch), n_lang), np.zeros(len(batch)), np.zeros(len(batch))
            for i, j, buf, off in blocks(batch, text):
                points, at = _points(buf, off)
                alpha = per_row(np.logical_or, m["letters"][points], at, False)
                if not n_lang or not alpha.any():
                    continue
                ll = np.tile(m["prior"], (j - i, 1))
                for b in _buckets(points, at, m["shift"]):
                    for k, column in enumerate(m["table"]):
                        ll[:, k] += per_row(np.add, column[b], at, 0.0)
                top = ll.argmax(axis=1)
                p = np.exp(ll - ll.max(axis=1, keepdims=True))
                second = np.partition(ll, -2, axis=1)[:, -2] if n_lang > 1 else ll.max(axis=1) - 1
                best[i:j] = np.where(alpha, top, n_lang)
                post[i:j] = np.where(alpha, 1 / p.sum(axis=1), 0)
                margin[i:j] = np.where(alpha, (ll.max(axis=1) - second) / np.maximum(1, np.diff(at)), 0)
            return pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(post), pa.array(margin)], ["lang_pred", "score", "margin"])

        return score

    return append_column(docs, into, "struct<lang_pred:string,score:double,margin:double>", make)
