"""Phrases that hold together: counts from a multikey three-way quicksort of suffix pointers, scored by their weakest cut.

Each word of a piece of text starts a suffix, as deep as the longest phrase.  Suffixes are routed by their leading words first: chunks
of texts send the counts of their words and pairs to buckets, which add them up; suffixes whose leading pair is too rare in the whole
corpus are abandoned, and a suffix ends before the first pair that is.  What is left of a chunk is sorted word by word in three-way partitions: the
sizes of the partitions of equal words are the chunk's counts of all its phrases, which Spark adds up by their words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exchange import ASK, Layout, answered, measure, questions, staged, with_answers
from .text import LOWER, ngram_hashes, pieces
from .text import mix as mixed

_U = np.uint64
_MARK = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_BETWEEN = _MARK | np.isin(np.arange(256), [9, 32])
COUNTS = "lang string, k int, phrase string, n long"


def sorted_suffixes(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """order, lo, hi, depth: suffix pointers in the order of their words, and all partitions order[lo:hi] of equal first `depth` words.

    A suffix is words[start : start + length].  Multikey quicksort: a segment of suffixes with `depth` equal words is parted by its
    pivot's next word into lesser, equal and greater ones; equal ones go on at the next word, until their suffixes end.  All
    segments take a step at once.  A suffix's end sorts before any word.
    """
    order = np.arange(len(starts))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lo, hi, depth = (np.array([x], np.int64) for x in (0, len(starts), 0)) if len(starts) else (np.zeros(0, np.int64),) * 3
    while len(lo):
        size = hi - lo
        seg = np.repeat(np.arange(len(lo)), size)
        first = np.cumsum(size) - size
        at = np.arange(len(seg)) - first[seg] + lo[seg]
        who = order[at]
        deep = depth[seg]
        more = lengths[who] > deep
        word = np.where(more, words[np.where(more, starts[who] + deep, 0)], -1)
        a, b, c = word[first], word[first + size // 2], word[first + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[seg]
        to = np.empty(len(seg), np.int64)
        bounds = [lo]
        for mine in (word < pivot, word == pivot, word > pivot):
            seen = np.cumsum(mine)
            before = np.where(first > 0, seen[first - 1], 0)
            to[mine] = (bounds[-1] - before)[seg[mine]] + seen[mine] - 1
            bounds.append(bounds[-1] + np.bincount(seg[mine], minlength=len(lo)))
        order[to] = who
        equal = pivot[first] >= 0
        found.append((bounds[1][equal], bounds[2][equal], depth[equal] + 1))
        parts = [(bounds[0], bounds[1], depth), (*(x[equal] for x in bounds[1:3]), depth[equal] + 1), (bounds[2], bounds[3], depth)]
        lo, hi, depth = (np.concatenate([p[k] for p in parts]) for k in range(3))
        keep = hi > lo
        lo, hi, depth = lo[keep], hi[keep], depth[keep]
        # suffixes that stand alone need no more steps: each of their further words is a partition of one
        alone = hi - lo == 1
        at, deep = lo[alone], depth[alone]
        rest = lengths[order[at]] - deep
        many = np.repeat(np.arange(len(at)), rest)
        step = np.arange(len(many)) - np.repeat(np.cumsum(rest) - rest, rest)
        found.append((at[many], at[many] + 1, deep[many] + 1 + step))
        lo, hi, depth = lo[~alone], hi[~alone], depth[~alone]
    if not found:
        return order, lo, hi, depth
    return order, *(np.concatenate([f[k] for f in found]) for k in range(3))


@dataclass
class _Chunk:
    """Words of a chunk's texts: bytes, places, the text each is of, whether the next word is of the same piece, and key hashes."""

    data: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    text: np.ndarray
    weight: np.ndarray
    ones: np.ndarray
    pairs: np.ndarray
    paired: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, bits: int) -> _Chunk:
        salts = _salts(table["lang"])
        parts: list[list[np.ndarray]] = [[] for _ in range(7)]
        base = words = 0
        for row, t in pieces(table["text"]):
            starts, stops, firsts = t.words(_BETWEEN)
            hashes = t.word_hashes(starts, stops, lower=True)
            text = np.repeat(np.arange(t.n), np.diff(firsts)) + row
            marks = np.cumsum(_MARK[t.data])[starts]
            grams, at = ngram_hashes(hashes, firsts, 2)
            same = marks[at] == marks[at + 1] if len(at) else at.astype(bool)
            grams, at = grams[same], at[same]
            own = [LOWER[t.data], starts + base, stops + base, text, mixed(hashes ^ salts[text]), mixed(grams ^ salts[text[at]]), at + words]
            for p, x in zip(parts, own, strict=True):
                p.append(x)
            base += len(t.data)
            words += len(starts)
        kinds = (np.uint8, np.int64, np.int64, np.int64, _U, _U, np.int64)
        data, starts, stops, text, ones, pairs, paired = (np.concatenate(p) if p else np.zeros(0, kind) for p, kind in zip(parts, kinds, strict=True))
        shift = _U(64 - bits)
        return cls(data, starts, stops, text, table["n"].to_numpy()[text], ones >> shift, pairs >> shift, paired)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of words and pairs, each occurrence's number among them (words first), and how often each occurs."""
        keys, number = np.unique(np.concatenate([self.ones, self.pairs]), return_inverse=True)
        return keys, number, np.bincount(number, np.concatenate([self.weight, self.weight[self.paired]]), len(keys))

    def spelled(self, at: np.ndarray) -> pa.Array:
        """The words at these places, in lower case."""
        size = self.stops[at] - self.starts[at]
        ends = np.cumsum(size)
        take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[at] - ends + size, size)
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(self.data[take]))


def _salts(langs: pa.ChunkedArray) -> np.ndarray:
    import zlib

    return mixed(np.array([zlib.crc32(x.encode()) + (zlib.adler32(x.encode()) << 32) for x in langs.to_pylist()], _U))


def _chunked(docs: DataFrame, text: str, lang: str, layout: Layout) -> DataFrame:
    """chunk, lang, text, n: each distinct text of a language once, with how many rows have it."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.groupBy("lang", "text").agg(F.count("*").alias("n"))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("lang", "text"), F.lit(layout.chunks))).repartition(layout.parts, "chunk")


def _sorted(table: pa.Table) -> pa.Table:
    """A chunk's rows in one order at each reading."""
    return table.take(pc.sort_indices(table.select(["lang", "text"]), sort_keys=[("lang", "ascending"), ("text", "ascending")])) if table.num_rows > 1 else table


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, most: int = 4, chunk_bytes: int = 4 << 20) -> DataFrame:
    """lang, k, phrase, n: all phrases of k = 1 to `most` words that occur at least `least` times in a language.

    k = 0 (phrase NULL) counts all words of a language.  Words are in lower case (A-Z) and joined by a space; a phrase
    lies within a piece, between marks.  Null texts are empty, a null language is `und`.  Other columns are ignored.
    """
    layout = Layout(docs.sparkSession, measure(docs, text), chunk_bytes)
    bits, kind = layout.filter_bits, [("n", "u1" if least < 256 else "<u4")]
    chunks = _chunked(docs, text, lang, layout)

    def ask(table: pa.Table) -> pa.Table:
        keys, _, n = _Chunk.of(_sorted(table), bits).keys()
        return questions(table["chunk"][0].as_py(), keys, layout.bucket_bits, bits, np.minimum(n, least).astype(kind[0][1]).view(kind))

    def enough(group: np.ndarray, extras: np.ndarray) -> np.ndarray:
        return (np.bincount(group, extras["n"]) >= least)[group]

    def count(chunk: int, table: pa.Table, replies: list[np.ndarray]) -> pa.Table:
        table = _sorted(table)
        c = _Chunk.of(table, bits)
        _, number, _ = c.keys()
        good = replies[0][number] > 0 if len(number) else np.zeros(0, bool)
        n, langs = len(c.ones), table["lang"].combine_chunks().cast(pa.string())
        words = number[:n]
        # how many pairs in a row are frequent from a word on, up to the longest phrase
        run, pair = np.zeros(n + 1, np.int64), np.zeros(n + 1, bool)
        pair[c.paired] = good[n:] & good[c.paired] & good[c.paired + 1]  # a filter may take a rare pair for a frequent one
        for _ in range(most - 1):
            run[:n] = np.where(pair[:n], 1 + run[1:], 0)
        run = np.minimum(run[:n], most - 1)
        starts = np.flatnonzero(run)
        order, lo, hi, depth = sorted_suffixes(words, starts, run[starts] + 1)
        total = np.concatenate([[0], np.cumsum(c.weight[starts[order]])])
        alone = np.flatnonzero(good[:n])
        named, place = np.unique(words[alone], return_index=True)
        spelled = c.spelled(alone[place])
        whole = np.bincount(c.text, c.weight, table.num_rows)
        out = [_rows(langs, np.arange(table.num_rows), 0, None, whole), _rows(langs, c.text[alone[place]], 1, spelled, np.bincount(words, c.weight)[named] if len(named) else named)]
        for k in range(2, most + 1):
            mine = depth == k
            at = starts[order[lo[mine]]]
            parts = [pc.take(spelled, pa.array(np.searchsorted(named, words[at + j]))) for j in range(k)]
            out.append(_rows(langs, c.text[at], k, pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())), (total[hi] - total[lo])[mine]))
        return pa.concat_tables(out)

    reply = answered(chunks.groupBy("chunk").applyInArrow(ask, ASK), enough, kind)
    each = with_answers(chunks.withColumn("doc_id", F.lit(None).cast("long")), [reply], count, COUNTS)
    return each.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | ((F.col("k") == 0) & (F.col("n") > 0)))


def _rows(langs: pa.Array, text: np.ndarray, k: int, phrase: pa.Array | None, n: np.ndarray) -> pa.Table:
    m = len(text)
    return pa.table({"lang": langs.take(pa.array(text)), "k": pa.array(np.full(m, k), pa.int32()), "phrase": pa.nulls(m, pa.string()) if phrase is None else phrase.cast(pa.string()), "n": pa.array(np.asarray(n).astype(np.int64))})


def _wide(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, most: int = 4, inside: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to `most` words, by score, a, and phrase.

    a counts the phrase, l and r the two parts of its worst cut, n all words of the language; the score is 2,000,000 a / (l + r), rounded
    down.  A phrase inside a longer one that is at least `inside` % as frequent is left out.  No words, no rows.
    """
    counts = staged(phrase_counts(docs, text, lang, least, most))
    phrases = counts.where("k >= 2").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    joined = lambda w, first, n: F.array_join(F.slice(w, first, n), " ")
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"), "w")
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.col("w"), 1, F.col("k")).alias("first"), joined(F.col("w"), F.col("k") + 1, F.size("w")).alias("rest"))
    known = counts.where("k >= 1")
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])
    value = F.expr("CAST((CAST(a AS DECIMAL(20,0)) * 2000000) div (CAST(l AS DECIMAL(20,0)) + r) AS LONG)")
    worst = cuts.withColumn("score", value).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("cut")).select("lang", "phrase", "cut.*")
    longer = phrases.where(F.size("w") > 2).withColumn("size", F.explode(F.sequence(F.lit(2), F.size("w") - 1)))
    parts = longer.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: joined(F.col("w"), i, F.col("size")))).alias("phrase"))
    over = parts.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = worst.join(over, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_wide("longer") * 100 < _wide("a") * inside))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first ones of each part of a language first, so that no task ranks a whole language
    part = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    best = part.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    sizes = counts.where("k = 0").select("lang", F.col("n").alias("words"))
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
