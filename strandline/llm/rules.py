"""Quality rules: fixed limits, then an isolation forest over the rules' statistics.

Each text gives a few counts.  Their ratios are isolated by random splits: a document that few splits set apart is odd.
How odd is too odd is read off the scores of labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import staged
from .text import Texts, covered, ngram_hashes, pieces

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_upper", "n_digits", "n_marks")
_DDL = "struct<" + ",".join(f"{c}:long" for c in COUNTS) + ">"
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_CLASSES = {
    "word_chars": ~_SPACE & ((np.arange(256) & 0xC0) != 0x80),
    "n_symbols": np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8)),
    "n_upper": (np.arange(256) >= 65) & (np.arange(256) <= 90),
    "n_digits": (np.arange(256) >= 48) & (np.arange(256) <= 57),
    "n_marks": np.isin(np.arange(256), np.frombuffer(b"!?;:()[]{}=+/\\^~@_\"'`", np.uint8)),
}


def text_counts(t: Texts, window: int = 8) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text."""
    starts, stops, firsts = t.words()
    hashes = t.word_hashes(starts, stops)
    out = {"n_words": np.diff(firsts)}
    for name, members in _CLASSES.items():
        sums = np.concatenate([[0], np.cumsum(members[t.data])])
        out[name] = sums[t.offsets[1:]] - sums[t.offsets[:-1]]
    grams, at = ngram_hashes(hashes, firsts, window)
    cut = np.searchsorted(at, firsts)
    rest = {name: np.zeros(t.n, np.int64) for name in ("n_dup_lines", "n_repeat_words", "n_distinct", "n_lines")}
    for k in range(t.n):
        lines = [x for x in t.text(k).split(b"\n") if x and not x.isspace()]
        rest["n_lines"][k], rest["n_dup_lines"][k] = len(lines), len(lines) - len(set(lines))
        rest["n_distinct"][k] = len(np.unique(hashes[firsts[k] : firsts[k + 1]]))
        own = grams[cut[k] : cut[k + 1]]
        if len(own) > 1:
            ranked = np.sort(own)
            twice = ranked[1:][ranked[1:] == ranked[:-1]]
            if len(twice):
                rest["n_repeat_words"][k] = covered(int(firsts[k + 1] - firsts[k]), np.flatnonzero(np.isin(own, twice)), window).sum()
    return out | rest


def _counts(text: pa.Array) -> dict[str, np.ndarray]:
    found = [text_counts(t) for _, t in pieces(text)]
    return {c: np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in COUNTS}


def rule_counts(text: str = "text") -> F.Column:
    """A struct of COUNTS of a text column; of nulls, zeros."""

    @F.arrow_udf(_DDL)
    def counts(text: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in _counts(text).values()], names=list(COUNTS))

    return counts(F.col(text).cast("string"))


def statistics(counts: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest splits on, a row for each text: the rules' ratios as they are, word length up to 40 and symbols a word up to 1."""
    n, chars, lines = (np.maximum(counts[c], 1).astype(float) for c in ("n_words", "word_chars", "n_lines"))
    return np.stack(
        [
            np.minimum(chars / n, 40),
            np.minimum(counts["n_symbols"] / n, 1),
            counts["n_dup_lines"] / lines,
            counts["n_repeat_words"] / n,
            counts["n_distinct"] / n**0.9,
            counts["n_upper"] / chars,
            counts["n_digits"] / chars,
            counts["n_marks"] / chars,
        ],
        axis=1,
    )


class IsolationForest:
    """Trees of random splits (Liu, Ting and Zhou, 2008), each over `sample` rows, as flat arrays.

    Splits lie within the range of a node's own rows; if `among` is given, within the part of its rows' range that the
    node covers, so that trees of usual rows also split where only other rows are, and a side may be empty.
    """

    def __init__(self, rows: np.ndarray, trees: int = 200, sample: int = 256, seed: int = 7, among: np.ndarray | None = None) -> None:
        rng = np.random.default_rng(seed)
        self.range = None if among is None or not len(among) else (among.min(axis=0), among.max(axis=0))
        self.sample = min(sample, len(rows))
        self.depth = int(np.ceil(np.log2(max(self.sample, 2))))
        self.trees = [self._tree(rows[rng.choice(len(rows), self.sample, replace=False)], rng) for _ in range(trees)] if len(rows) else []

    def _tree(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, split, left, length = [], [], [], []

        def grow(part: np.ndarray, depth: int, at: int, box: tuple[np.ndarray, np.ndarray] | None) -> None:
            low, high = box or (part.min(axis=0), part.max(axis=0))
            open_ = np.flatnonzero(high > low)
            if depth == self.depth or len(part) < (1 if box else 2) or not len(open_):
                length[at] = depth + _mean_depth(len(part))
                return
            f = int(rng.choice(open_))
            cut = rng.uniform(low[f], high[f])
            feature[at], split[at], left[at] = f, cut, len(feature)
            for _ in range(2):
                new()
            mask = part[:, f] <= cut
            edge = np.arange(len(low)) == f
            grow(part[mask], depth + 1, left[at], box and (low, np.where(edge, cut, high)))
            grow(part[~mask], depth + 1, left[at] + 1, box and (np.where(edge, cut, low), high))

        def new() -> None:
            feature.append(0)
            split.append(0.0)
            left.append(-1)
            length.append(0.0)

        new()
        grow(rows, 0, 0, self.range)
        return np.array(feature), np.array(split), np.array(left), np.array(length)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / what a random tree needs): near 1 is odd, under 0.5 is usual."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, split, left, length in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                inner = left[at] >= 0
                at = np.where(inner, left[at] + (rows[every, feature[at]] > split[at]), at)
            total += length[at]
        return 2.0 ** -(total / max(len(self.trees), 1) / max(_mean_depth(self.sample), 1.0))


def _mean_depth(n: int) -> float:
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


BINS = 1000


def calibrated(good: np.ndarray, bad: np.ndarray, weight: float = 10.0) -> float:
    """The score limit with the least (share of bad rows kept + weight * share of good rows lost); arguments are histograms over [0, 1]."""
    if not bad.sum():
        return float("inf")
    lost = np.concatenate([np.cumsum(good[::-1])[::-1], [0]]) / max(good.sum(), 1)
    kept = np.concatenate([[0], np.cumsum(bad)]) / bad.sum()
    cost = kept + weight * lost
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float(best[len(best) // 4]) / BINS  # nearer to the good rows: unlabelled bad ones may score less than labelled ones


def base_failed(counts: str) -> F.Column:
    n = F.col(f"{counts}.n_words")
    return (n < 20) | (100 * F.col(f"{counts}.n_repeat_words") > 30 * n)


def quality_rules(docs: DataFrame, labels: DataFrame | None, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_fit_rows: int = 20_000, trees: int = 200, sample: int = 256) -> DataFrame:
    """docs with one more struct column `rules`: the counts of COUNTS, base_failed, score and kept.

    base_failed: fewer than 20 words, or over 30 % of the words in 8-word windows that the text repeats.  kept: base rules
    passed and the forest's score is under the calibrated limit.  At most max_fit_rows labelled documents that pass the base
    rules (the least hashes of their ids) make the forest: it is grown on the good ones (on all, if none is good), with
    splits over the range of all; the limit comes from the scores of all that are labelled and pass.  Of unlike labels of
    an id the least holds.  Without labelled rows the forest is grown on documents and nothing is rejected by it.  Null and
    empty texts fail for want of words; repeated rows get the same verdict; all columns stay, an own column named `rules` is
    replaced.
    """
    spark = docs.sparkSession
    counted = docs.select(F.col(doc_id).cast("long").alias("id"), rule_counts(text).alias("c"))
    passing = counted.where(~base_failed("c"))
    if labels is not None:
        marks = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.min("y").alias("y"))
        passing = passing.join(marks, "id")
    else:
        passing = passing.withColumn("y", F.lit(1))
    passing = staged(passing.select("id", "y", "c.*"))
    fit = passing.orderBy(F.xxhash64("id"), "id").limit(max_fit_rows).toPandas()
    rows, good = statistics({c: fit[c].to_numpy() for c in COUNTS}), fit["y"].to_numpy() != 0
    forest = IsolationForest(rows[good] if good.any() else rows, trees, sample, among=rows)
    shared = spark.sparkContext.broadcast(forest)

    @F.arrow_udf("double")
    def score(*columns: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(statistics({c: x.to_numpy() for c, x in zip(COUNTS, columns, strict=True)})), pa.float64())

    @F.arrow_udf(_DDL.replace(">", ",score:double>"))
    def judged(text: pa.Array) -> pa.Array:
        """Counts and score in one go, so that a task has one Python worker."""
        counts = _counts(text)
        values = [*(pa.array(x, pa.int64()) for x in counts.values()), pa.array(shared.value.score(statistics(counts)), pa.float64())]
        return pa.StructArray.from_arrays(values, names=[*COUNTS, "score"])

    scored = passing.select("y", F.least(F.floor(score(*COUNTS) * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    shares = np.zeros((2, BINS))
    for r in scored.groupBy("y", "bin").count().collect():  # at most 2 * BINS rows
        shares[1 if r["y"] else 0, r["bin"]] += r["count"]
    limit = calibrated(shares[1], shares[0])
    out = docs.withColumn("rules", judged(F.col(text).cast("string")))
    out = out.withColumn("rules", F.struct(*(f"rules.{c}" for c in COUNTS), base_failed("rules").alias("base_failed"), F.col("rules.score").alias("score")))
    return out.withColumn("rules", F.struct("rules.*", (~F.col("rules.base_failed") & (F.col("rules.score") < limit)).alias("kept")))
