"""Benchmark items in documents, up to a share of edited words.

The CGK embedding (Chakraborty, Goldenberg and Koucky, 2016) walks over a string of words: at each step it writes the word
under its pointer and moves on or not, as a random function of step and word says.  Strings a few edits apart become
outputs that agree in most places, so that sampled places are a locality-sensitive key.  Windows as long as a class of
items are embedded by several walks; windows and items that agree on a key of any walk are compared exactly.  Windows that
can't be near any item, because too few of their runs of two or three words occur in the items at all (an edit destroys two
or three of them), are not walked.

Two walks drift apart over many edits, so an item of more than SEGMENT words is walked in equal segments of at most as
many: of the segments of an item within its share of edits one at least is within the same share of its own length.
What is compared in the end is always the whole item.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import staged
from .text import Texts, mix, pieces

_U = np.uint64
HIT = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int64())])
_DDL = "array<struct<item_id:long,start:long,n_words:long,edits:long>>"
#: A bit table of this many leading hash bits says whether a word pair occurs in the items.
_TABLE = 22
#: Bytes of item texts that a task is given at once; more items are taken in blocks, each against all documents.
BLOCK_BYTES = 4 << 20
#: Words of an item that are walked at once.
SEGMENT = 64
#: Pieces of text whose windows are walked together.
PIECES = 16


def near_segment(item: list[bytes], words: list[bytes], most: int) -> tuple[int, int, int] | None:
    """The segment of words (start, stop) within `most` edits of item: of the fewest edits, then the first and shortest."""
    n = len(words)
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    place = np.arange(n + 1)
    given = np.array(words, dtype=object)
    for word in item:
        differs = np.append(True, given != word) if n else np.array([True])
        # cost and start in one number: fewer edits first, then a later start, which is the shorter segment
        stay = (cost + 1) * (n + 1) + (n - start)
        swap = np.empty_like(stay)
        swap[0] = stay[0]
        swap[1:] = (cost[:-1] + differs[1:]) * (n + 1) + (n - start[:-1])
        best = np.minimum(stay, swap)
        # a skipped word of the text costs one more than the place before
        best = np.minimum.accumulate(best - place * (n + 1)) + place * (n + 1)
        cost, start = best // (n + 1), n - best % (n + 1)
    stop = int(np.argmin(cost))
    return (int(start[stop]), stop, int(cost[stop])) if cost[stop] <= most else None


class Items:
    """Keys of a block of items under seeded walks."""

    def __init__(self, items: list[tuple[int, bytes]], percent: int, walks: int, samples: int, bits: int, seed: int) -> None:
        self.percent, self.walks, self.samples, self.bits = percent, walks, samples, bits
        self.seeds = np.random.default_rng(seed).integers(0, 1 << 63, (walks, 3), dtype=np.uint64)
        sizes = np.cumsum([0, *(len(t) + 1 for _, t in items)])
        texts = Texts(np.frombuffer(b"".join(t + b"\n" for _, t in items), np.uint8), sizes)
        starts, stops, firsts = texts.words()
        hashes = texts.word_hashes(starts, stops, lower=True)
        self.ids, self.words, self.hashes = [], [], []
        for k, (item_id, text) in enumerate(items):
            if words := _lower(text).split():
                self.ids.append(item_id)
                self.words.append(words)
                self.hashes.append(hashes[firsts[k] : firsts[k + 1]])
        self.listed = [h.tolist() for h in self.hashes]
        self.single, self.pairs, self.triples = (np.zeros(1 << _TABLE, bool) for _ in range(3))
        for h in self.hashes:
            for n, table in enumerate((self.single, self.pairs, self.triples), 1):
                if len(h) >= n:
                    table[_slot(_run(h, n))] = True
        # classes of segments of like length: least length, most edits, and for each table its sorted keys with their (item, offset)
        by_length = defaultdict(list)
        for k, w in enumerate(self.words):
            for start, stop in _segments(len(w)):
                by_length[_class(stop - start)].append((k, start, stop))
        self.classes = []
        for members in by_length.values():
            length = min(stop - start for _, start, stop in members)
            most = max(self.edits(stop - start) for _, start, stop in members)
            rows = np.stack([self.hashes[k][start : start + length] for k, start, _ in members])
            tables = []
            for keys in self.keys(rows, np.full(len(members), length)):
                owners = defaultdict(list)
                for key, (k, start, _) in zip(keys.tolist(), members, strict=True):
                    owners[key].append((k, start))
                tables.append((np.array(sorted(owners), _U), dict(owners)))
            self.classes.append((length, most, tables))

    def edits(self, n: int) -> int:
        """Edits that an item of n words may have: at most (100 - percent) % of its words."""
        return (100 - self.percent) * n // 100

    def keys(self, rows: np.ndarray, stop: np.ndarray):
        """For each walk and sample the keys of windows: a row of word hashes each, of which the first `stop` are text."""
        n, length = rows.shape
        steps = max(1, 2 * length)
        every = np.arange(n)
        for walk in range(self.walks):
            a, b, c = self.seeds[walk]
            rng = np.random.default_rng([int(a & _U(0xFFFFFFFF)), length])
            picks = [set(rng.choice(steps, min(self.bits, steps), replace=False).tolist()) for _ in range(self.samples)]
            out = [np.full(n, c, _U) for _ in picks]
            at = np.zeros(n, np.int64)
            coin = mix(rows ^ a)
            for step in range(max(map(max, picks)) + 1):
                inside = at < stop
                here = np.minimum(at, length - 1)
                for k, p in enumerate(picks):
                    if step in p:
                        seen = np.where(inside, rows[every, here], _U(0x1234567890ABCDEF))
                        out[k] = mix(out[k] * _U(0x9E3779B97F4A7C15) + seen + _U(step))
                if step and step % 64 == 0:
                    coin = mix(coin + b)
                at += inside & ((coin[every, here] >> _U(step % 64)) & _U(1)).astype(bool)
            yield from out

    def hits(self, parts: list[Texts]) -> list[list[tuple[int, int, int, int]]]:
        """For each text of all parts its items: (item, start, number of words, edits), one for each item."""
        out: list[list] = []
        near = [[] for _ in self.classes]  # for each class: part, first words and rows of windows
        words = []
        for t in parts:
            starts, stops, firsts = t.words()
            h = t.word_hashes(starts, stops, lower=True)
            words.append((t, starts, stops, firsts, h, len(out)))
            out += [[] for _ in range(t.n)]
            if not len(h):
                continue
            text_of = np.repeat(np.arange(t.n), np.diff(firsts))
            end = firsts[1:][text_of]
            single = self.single[_slot(h)]
            runs = []  # up to each word, how many runs of two and of three words occur in the items
            for n, table in ((2, self.pairs), (3, self.triples)):
                hit = np.zeros(len(h), bool)
                if len(h) >= n:
                    hit[: 1 - n] = table[_slot(_run(h, n))] & (text_of[: 1 - n] == text_of[n - 1 :])
                runs.append(np.concatenate([[0], np.cumsum(hit)]))
            may = np.flatnonzero(single)
            room = end[may] - may
            for k, (length, most, _) in enumerate(self.classes):
                ok = room >= length - most
                at = may[ok]
                stop = at + np.minimum(room[ok], length)
                for n, found in zip((2, 3), runs, strict=True):
                    # an edit destroys n runs of n words
                    need = length - n + 1 - n * most
                    if need > 0:
                        ok = found[np.maximum(stop - n + 1, at)] - found[at] >= need
                        at, stop = at[ok], stop[ok]
                if len(at):
                    rows = h[np.minimum(at[:, None] + np.arange(length), len(h) - 1)]
                    near[k].append((len(words) - 1, at, stop - at, rows))
        maybe: dict[tuple[int, int, int], set[int]] = defaultdict(set)
        for (length, _, tables), windows in zip(self.classes, near, strict=True):
            if not windows:
                continue
            part = np.concatenate([np.full(len(w[1]), w[0]) for w in windows])
            at, stop, rows = (np.concatenate([w[j] for w in windows]) for j in (1, 2, 3))
            for a in range(0, len(at), 1 << 16):
                cut = slice(a, a + (1 << 16))
                for got, (known, owners) in zip(self.keys(rows[cut], stop[cut]), tables, strict=True):
                    hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, got), len(known) - 1)] == got)
                    for j in hit.tolist():
                        for item, offset in owners[int(got[j])]:
                            p = int(part[a + j])
                            maybe[(p, int(np.searchsorted(words[p][3], at[a + j], "right")) - 1, item)].add(int(at[a + j]) - offset)
        for (p, text, item), places in sorted(maybe.items()):
            if best := self._best(words[p], text, item, sorted(places)):
                out[words[p][5] + text].append(best)
        return out

    def _best(self, part: tuple, text: int, item: int, places: list[int]) -> tuple[int, int, int, int] | None:
        """The segment with the fewest edits around these places of a text, where the item may start."""
        t, starts, stops, firsts, h, _ = part
        words, most = self.words[item], self.edits(len(self.words[item]))
        low, high = int(firsts[text]), int(firsts[text + 1])
        best, k = None, 0
        while k < len(places):  # windows that start close together are compared in one go
            first = last = places[k]
            while k < len(places) and places[k] <= last + len(words):
                last = places[k]
                k += 1
            a, b = max(low, first - most), min(high, last + len(words) + 2 * most)
            around = set(h[a:b].tolist())
            if sum(map(around.__contains__, self.listed[item])) < len(words) - most:
                continue
            got = near_segment(words, [_lower(t.data[starts[j] : stops[j]].tobytes()) for j in range(a, b)], most)
            if got and (best is None or got[2] < best[3]):
                best = (self.ids[item], a - low + got[0], got[1] - got[0], got[2])
        return best


def _lower(data: bytes) -> bytes:
    return data.lower()  # of bytes: A-Z only


def _segments(n: int) -> list[tuple[int, int]]:
    cuts = [n * k // -(-n // SEGMENT) for k in range(-(-n // SEGMENT) + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _class(n: int) -> int:
    return n if n < 10 else int(10 + np.log(n / 10) / np.log(1.2))


def _run(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    out = h[: len(h) - n + 1]
    for k in range(1, n):
        out = mix(out * _U(0xD1342543DE82EF95) + h[k : len(h) - n + 1 + k])
    return out


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - _TABLE)).astype(np.int64)


def _items(benchmark: DataFrame, item_id: str, text: str) -> tuple[DataFrame, int]:
    """item_id, text and block, in a number of blocks of about BLOCK_BYTES, each small enough for the driver and every task."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL AND item_id IS NOT NULL").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = 1 + size // BLOCK_BYTES
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    return (staged(rows) if n > 1 else rows), n


def _block_hits(items: DataFrame, block: int, text: str, percent: int = 80, walks: int = 12, samples: int = 2, bits: int = 2, seed: int = 5) -> tuple[F.Column, Broadcast]:
    """A column of a text column's hits of a block's items, and what it has broadcast."""
    given = sorted((r["item_id"], r["text"].encode()) for r in items.where(F.col("block") == block).collect())
    shared = items.sparkSession.sparkContext.broadcast(Items(given, percent, walks, samples, bits, seed))
    return F.array_sort(F.array_distinct(_hits_udf(shared)(F.col(text).cast("string")))), shared


def _hits_udf(shared):
    @F.arrow_udf(_DDL)
    def hits(column: pa.Array) -> pa.Array:
        parts, found = [], []
        for _, t in pieces(column):
            parts.append(t)
            if len(parts) == PIECES:
                found += shared.value.hits(parts)
                parts = []
        found += shared.value.hits(parts)
        return pa.array([[dict(zip(HIT.names, h, strict=True)) for h in hit] for hit in found], pa.list_(HIT))

    return hits


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", **options) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, start, n_words, edits.

    A match is a segment of the text's words (A-Z lower-cased; start counts from 0) that at most (100 - percent) % of the
    item's words (percent: 80), rounded down, of inserted, deleted and changed words turn into the item; of an item's segments
    the one with the fewest edits.  Exact copies are always found; of edited ones, each of walks * samples (12 * 2) keys of
    `bits` (2) places finds some, together at least 95 % (measured in the tests, for items of 8 to 1,000 words).  Null and
    empty texts have no matches, null and empty items are nobody's; items with several texts are found by each.  Repeated rows
    give repeated matches; other columns are ignored.

    Items are taken in blocks of BLOCK_BYTES, one pass over the documents for each; a pass is written before the next begins,
    so that no more than a block is ever at the driver or in a task.
    """
    items, n = _items(benchmark, item_id, item_text)
    out = None
    for block in range(n):
        hits, shared = _block_hits(items, block, text, **options)
        part = docs.select(F.col(doc_id).alias("doc_id"), hits.alias("hits")).select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")
        if n > 1:
            part = staged(part)
            shared.destroy()
        out = part if out is None else out.unionAll(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", **options) -> DataFrame:
    """docs without the rows whose text holds a benchmark item (see benchmark_matches); all columns stay.

    Of several blocks of items, each is looked for in what the one before has left.
    """
    items, n = _items(benchmark, item_id, item_text)
    for block in range(n):
        hits, shared = _block_hits(items, block, text, **options)
        docs = docs.where(F.size(hits) == 0)
        if n > 1:
            docs = staged(docs)
            shared.destroy()
    return docs
