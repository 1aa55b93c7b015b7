"""A quality classifier: a factorisation machine over hashed words, structure statistics and the text's length.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum is
half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), so a text is scored in time linear in its features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import text_counts
from .text import Texts, pieces

HASHED = 1 << 14
#: Structure statistics, each cut into this many equal-width levels; a text has one feature per statistic.
LEVELS = 24
_RATIOS = ("chars_per_word", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "marks", "bars", "words_per_line", "length")
N_FEATURES = HASHED + len(_RATIOS) * LEVELS


def _structure(t: Texts) -> np.ndarray:
    """For each text the level of each statistic."""
    c = text_counts(t)
    n, chars, lines = (np.maximum(c[k], 1).astype(float) for k in ("n_words", "word_chars", "n_lines"))
    bars = np.concatenate([[0], np.cumsum(t.data == ord("|"))])
    shares = [
        chars / n / 16,
        c["n_symbols"] / n / 4,
        c["n_dup_lines"] / lines,
        c["n_repeat_words"] / n,
        c["n_distinct"] / n,
        np.sqrt(c["n_upper"] / chars),
        np.sqrt(c["n_digits"] / chars),
        np.sqrt(c["n_marks"] / chars),
        np.sqrt((bars[t.offsets[1:]] - bars[t.offsets[:-1]]) / n / 2),
        np.log1p(n / lines) / 8,
        np.log1p(c["n_words"]) / 12,
    ]
    return np.clip(np.stack(shares, axis=1) * LEVELS, 0, LEVELS - 1).astype(np.int32)


def features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of texts, one after another, and the first of each (one more than texts)."""
    starts, stops, firsts = t.words()
    words = (t.word_hashes(starts, stops, lower=True) >> np.uint64(50)).astype(np.int64)
    text_of = np.repeat(np.arange(t.n), np.diff(firsts))
    keys, counts = np.unique(text_of * HASHED + words, return_counts=True)
    levels = _structure(t) + HASHED + LEVELS * np.arange(len(_RATIOS))
    owner = np.concatenate([keys // HASHED, np.repeat(np.arange(t.n), len(_RATIOS))])
    number = np.concatenate([keys % HASHED, levels.ravel()])
    value = np.concatenate([np.sqrt(counts), np.ones(levels.size)])
    length = np.sqrt(np.maximum(np.bincount(keys // HASHED, weights=counts, minlength=t.n), 1))
    value[: len(keys)] /= length[keys // HASHED]
    order = np.argsort(owner, kind="stable")
    return number[order].astype(np.int32), value[order].astype(np.float32), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=t.n))])


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, number: np.ndarray, value: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        x = value[:, None]
        sums = np.add.reduceat(self.v[number] * x, firsts[:-1], axis=0)
        squares = np.add.reduceat(((self.v[number] * x) ** 2).sum(axis=1), firsts[:-1])
        return self.w0 + np.add.reduceat(self.w[number] * value, firsts[:-1]) + 0.5 * ((sums**2).sum(axis=1) - squares)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fitted(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rank: int = 8, epochs: int = 6, rate: float = 0.08, decay: float = 1e-5, batch: int = 64, seed: int = 3) -> Machine:
    """AdaGrad on the logistic loss, rows in a seeded order."""
    rng = np.random.default_rng(seed)
    share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(N_FEATURES), rng.normal(0, 0.02, (N_FEATURES, rank)))
    gw, gv, g0 = np.full(N_FEATURES, 1e-2), np.full((N_FEATURES, rank), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            part = order[a : a + batch]
            sizes = [len(rows[k][0]) for k in part]
            firsts = np.concatenate([[0], np.cumsum(sizes)])
            number, value = np.concatenate([rows[k][0] for k in part]), np.concatenate([rows[k][1] for k in part]).astype(float)
            x = value[:, None]
            each = m.v[number] * x
            sums = np.add.reduceat(each, firsts[:-1], axis=0)
            error = (sigmoid(m.margin(number, value, firsts)) - y[part]) / len(part)
            e = np.repeat(error, sizes)
            ids, back = np.unique(number, return_inverse=True)
            dw = np.bincount(back, weights=e * value, minlength=len(ids)) + decay * m.w[ids]
            dv = np.zeros((len(ids), m.v.shape[1]))
            np.add.at(dv, back, e[:, None] * x * (np.repeat(sums, sizes, axis=0) - each))
            dv += decay * m.v[ids]
            gw[ids] += dw**2
            gv[ids] += dv**2
            g0 += error.sum() ** 2
            m.w[ids] -= rate * dw / np.sqrt(gw[ids])
            m.v[ids] -= rate * dv / np.sqrt(gv[ids])
            m.w0 -= rate * error.sum() / np.sqrt(g0)
    return m


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, limit: float = 0.3, max_fit_rows: int = 8000, rank: int = 8) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= limit).

    held_out rows have crc32(doc_id as text) mod folds = 0 and teach nothing.  The machine is fitted on the labelled others
    with the least hashes of their ids, at most max_fit_rows of them; every text is scored whole.  Null and empty texts
    are scored by their structure; a null doc_id is never held out and teaches nothing; without labelled rows all scores are
    0.5.  Of unlike labels of an id the least holds.  Repeated rows get equal scores; other columns are ignored.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))
    marks = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("y IS NOT NULL").where(~held & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("y").alias("y"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit_rows)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    @F.arrow_udf("struct<number:binary,value:binary>")
    def packed(column: pa.Array) -> pa.Array:
        numbers, values = [], []
        for _, t in pieces(column):
            number, value, firsts = features(t)
            numbers += [number[a:b].tobytes() for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
            values += [value[a:b].tobytes() for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
        return pa.StructArray.from_arrays([pa.array(numbers, pa.binary()), pa.array(values, pa.binary())], names=["number", "value"])

    sample = rows.join(F.broadcast(marks), "doc_id").select("doc_id", "y", packed("text").alias("f")).select("doc_id", "y", "f.*").collect()
    sample.sort(key=lambda r: (r["doc_id"], r["number"], r["value"]))
    machine = fitted([(np.frombuffer(r["number"], np.int32), np.frombuffer(r["value"], np.float32)) for r in sample], np.array([r["y"] for r in sample], float), rank) if sample else Machine(0.0, np.zeros(N_FEATURES), np.zeros((N_FEATURES, rank)))
    machine = Machine(machine.w0, machine.w.astype(np.float32), machine.v.astype(np.float32))
    shared = spark.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        found = [sigmoid(shared.value.margin(*features(t))).astype(float) for _, t in pieces(column)]
        return pa.array(np.concatenate(found) if found else [], pa.float64())

    return rows.select("doc_id", held.alias("held_out"), score("text").alias("score")).withColumn("predicted", (F.col("score") >= limit).cast("int"))
