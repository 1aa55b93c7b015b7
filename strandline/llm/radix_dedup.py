"""Byte strings of a given length that occur twice, by a radix sort of suffixes that stops at that depth.

Suffixes are parted by most-significant-digit passes, and only through their first `length` bytes: a suffix that is
alone in its group after a pass is done, only the others read further, and after the last pass equal groups are exactly
the repeated strings.  A group is what agrees on all bytes read so far, so each pass parts the groups of the pass before.

Neighbouring suffixes are sorted together as long as they can be: all whose first `reach` places have their least
fingerprint at the same anchor form a run, and equal suffixes lie in runs with equal anchors.  From the anchor a run reads
DIGIT bytes in the first pass and the `length` - `reach` + 1 bytes that all its suffixes share there in the second,
which also compares the whole extents of runs: where all are equal, all their suffixes repeat.  What is still mixed
is parted suffix by suffix in the last pass, through all its `length` bytes.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import ASK, Layout, answered, chunked, distinct, measure, per_chunk, questions, with_answers
from .text import Texts, byte_values, covered, mix, pieces, powers, prefix_sums, spans

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
_U = np.uint64
#: Bytes that the first pass reads from a run's anchor.
DIGIT = 32
ALONE, REPEATED, MIXED = 0, 1, 2


class _Runs:
    """Suffixes of some texts that have `length` bytes, in runs of the same anchor."""

    def __init__(self, texts: Texts, length: int, reach: int) -> None:
        self.texts, self.length, self.depth = texts, length, length - reach + 1
        n = len(texts.data)
        self.sums = prefix_sums(byte_values(texts.data))
        sizes = np.diff(texts.offsets)
        valid = np.zeros(n, bool)
        for a, size in zip(texts.offsets[:-1][sizes >= length], sizes[sizes >= length], strict=True):
            valid[a : a + size - length + 1] = True
        at = np.flatnonzero(valid)
        self.first = self.last = self.anchor = at
        if not len(at):
            return
        # the least fingerprint, and of equal ones the first place, among the next `reach` places; windows of 8 bytes stay in a text where a suffix has `length`
        grams = np.zeros(n, _U)
        grams[: n - 7] = mix((self.sums[8:] - self.sums[:-8]) * powers(n - 7, True))
        grams &= ~_U(0xFFFFF)
        if n > 1 << 20:  # a long text's places don't fit into the 20 bits
            anchor = _first_place(grams, _sliding_least(grams, reach), at, reach)
        else:
            anchor = (_sliding_least(grams | np.arange(n, dtype=_U), reach)[at] & _U(0xFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.diff(anchor, prepend=-1) | (np.diff(at, prepend=-2) != 1))
        self.first, self.last = at[cut], at[np.concatenate([cut[1:], [len(at)]]) - 1]
        self.anchor = anchor[cut]

    @cached_property
    def checks(self) -> np.ndarray:
        """Prefix sums of the second hash."""
        return prefix_sums(byte_values(self.texts.data, 1), 1)

    def digits(self, depth: int, runs: np.ndarray | slice = slice(None)) -> np.ndarray:
        """What the runs read from their anchors through `depth` bytes."""
        return spans(self.sums, self.anchor[runs], self.anchor[runs] + depth)

    def extents(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of all bytes of the runs' suffixes."""
        a, b = self.first[runs], self.last[runs] + self.length
        return spans(self.sums, a, b), spans(self.checks, a, b, 1)

    def suffixes(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All suffixes of the runs: two hashes of their first `length` bytes, and places."""
        sizes = (self.last - self.first + 1)[runs]
        at = np.repeat(self.first[runs] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(sizes) else self.first[:0]
        return spans(self.sums, at, at + self.length), spans(self.checks, at, at + self.length, 1) if len(at) else np.zeros(0, _U), at


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[k : k + width] at each k, by windows of doubling width."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        np.minimum(out[: len(out) - step], out[step:], out=out[: len(out) - step])
        have += step
    return out


def _first_place(grams: np.ndarray, best: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    """The first place from each of `at` that has the least fingerprint within reach."""
    out = np.full(len(at), -1, np.int64)
    todo = np.arange(len(at))
    for shift in range(reach):
        hit = grams[at[todo] + shift] == best[at[todo]]
        out[todo[hit]] = at[todo[hit]] + shift
        todo = todo[~hit]
        if not len(todo):
            break
    return out


class _Chunk:
    """A chunk's texts on their way through the passes; each pass takes the answers to the one before."""

    def __init__(self, table: pa.Table, length: int, reach: int, shift: int) -> None:
        self.shift = _U(shift)
        self.parts = [(row, _Runs(t, length, reach)) for row, t in pieces(table["text"])]

    def first(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct first digits, each run's number among them, and how often each occurs."""
        return np.unique(self._joined([r.digits(min(DIGIT, r.depth)) >> self.shift for _, r in self.parts]), return_inverse=True, return_counts=True)

    def open_runs(self, shared: np.ndarray) -> list[np.ndarray]:
        """The runs of each piece that are not alone after the first pass."""
        return [np.flatnonzero(x) for x in self._split((shared > 0)[self.first()[1]] if len(shared) else np.zeros(0, bool), [len(r.first) for _, r in self.parts])]

    def second(self, runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct second digits of open runs, what is known of their extents, and each run's number among them."""
        some = list(zip((r for _, r in self.parts), runs, strict=True))
        digit = self._joined([r.digits(r.depth, x) for r, x in some])
        a, b = (self._joined(list(x)) for x in zip(*(r.extents(x) for r, x in some), strict=True)) if some else (digit, digit)
        keys, first, back, counts = np.unique(digit, return_index=True, return_inverse=True, return_counts=True)
        known = np.zeros(len(keys), SECOND)
        known["extent"], known["other"], known["twice"] = a[first], b[first], counts > 1
        known["differ"][back[(a != a[first][back]) | (b != b[first][back])]] = 1
        return keys, known, back

    def kinds(self, runs: list[np.ndarray], reply: np.ndarray) -> list[np.ndarray]:
        """ALONE, REPEATED or MIXED for each open run of each piece."""
        return self._split(reply[self.second(runs)[2]] if len(reply) else np.zeros(0, np.uint8), [len(x) for x in runs])

    def last(self, runs: list[np.ndarray], kinds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The suffixes of mixed runs: both hashes, and the places of each piece."""
        found = [r.suffixes(x[k == MIXED]) for (_, r), x, k in zip(self.parts, runs, kinds, strict=True)]
        return self._joined([f[0] for f in found]), self._joined([f[1] for f in found]), [f[2] for f in found]

    @staticmethod
    def _joined(arrays: list[np.ndarray]) -> np.ndarray:
        return np.concatenate(arrays) if arrays else np.zeros(0, _U)

    @staticmethod
    def _split(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
        return np.split(values, np.cumsum(sizes)[:-1]) if len(values) else [values for _ in sizes]


SECOND = np.dtype([("extent", "<u8"), ("other", "<u8"), ("differ", "u1"), ("twice", "u1")])
LAST = np.dtype([("check", "<u8"), ("twice", "u1")])


def _shared(group: np.ndarray, extras: np.ndarray) -> np.ndarray:
    """First and last pass: whether a group has more than one member."""
    twice = np.bincount(group) > 1
    twice[group[extras["twice"] > 0]] = True
    return twice[group]


def _kinds(group: np.ndarray, extras: np.ndarray) -> np.ndarray:
    """Second pass: ALONE, REPEATED (all extents of the group are equal) or MIXED."""
    n = int(group.max()) + 1 if len(group) else 0
    some = np.zeros(n, np.int64)
    some[group] = np.arange(len(group))
    other = extras[some[group]]
    differ, twice = np.zeros(n, bool), np.bincount(group, minlength=n) > 1
    differ[group[(extras["extent"] != other["extent"]) | (extras["other"] != other["other"]) | (extras["differ"] > 0)]] = True
    twice[group[extras["twice"] > 0]] = True
    return np.where(differ, MIXED, np.where(twice, REPEATED, ALONE))[group]


def radix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, chunk_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans of bytes.

    A byte (of UTF-8) is removed if a string of `length` bytes over it, within its text, also starts at any other place
    of any text.  Spans are maximal runs of removed bytes.  Null and empty texts have no bytes; a text shorter than
    `length` loses none; equal rows count as two texts, so both lose everything.  Other columns are ignored.  Strings are
    taken for equal if two independent 64-bit hashes of them are.
    """
    if length < 32:
        raise ValueError("strings have at least 32 bytes")
    reach = length // 2
    layout = Layout(docs.sparkSession, measure(docs, text), chunk_bytes)
    chunks = chunked(docs, doc_id, text, layout)
    bucket_bits, bits = layout.bucket_bits, layout.filter_bits
    opened = lambda table: _Chunk(table, length, reach, 64 - bits)

    def first_pass(chunk: int, table: pa.Table) -> pa.Table:
        keys, _, counts = opened(table).first()
        return questions(chunk, keys, bucket_bits, bits, (counts > 1).astype([("twice", "u1")]))

    def second_pass(chunk: int, table: pa.Table, replies: list[np.ndarray]) -> pa.Table:
        if not replies[0].any():
            return questions(chunk, np.zeros(0, _U), bucket_bits)
        c = opened(table)
        keys, known, _ = c.second(c.open_runs(replies[0]))
        return questions(chunk, keys, bucket_bits, 64, known)

    def last_pass(chunk: int, table: pa.Table, replies: list[np.ndarray]) -> pa.Table:
        if not (replies[1] == MIXED).any():
            return questions(chunk, np.zeros(0, _U), bucket_bits)
        c = opened(table)
        runs = c.open_runs(replies[0])
        keys, checks, _ = c.last(runs, c.kinds(runs, replies[1]))
        _, first, _, counts = distinct(keys, checks)
        extra = np.zeros(len(first), LAST)
        extra["check"], extra["twice"] = checks[first], counts > 1
        return questions(chunk, keys[first], bucket_bits, 64, extra)

    def finish(chunk: int, table: pa.Table, replies: list[np.ndarray]) -> pa.Table:
        ids = table["doc_id"].to_pylist()
        out: dict[str, list] = {name: [] for name in _OUT.names}
        if replies[1].any():
            c = opened(table)
            runs = c.open_runs(replies[0])
            kinds = c.kinds(runs, replies[1])
            keys, checks, places = c.last(runs, kinds)
            again = c._split(replies[2][distinct(keys, checks)[2]] > 0 if len(keys) else np.zeros(0, bool), [len(p) for p in places])
            for (row, r), x, k, at, hit in zip(c.parts, runs, kinds, places, again, strict=True):
                whole = x[k == REPEATED]
                starts = np.concatenate([r.first[whole], at[hit]])
                sizes = np.concatenate([(r.last - r.first)[whole] + length, np.full(int(hit.sum()), length)])
                _append(out, ids[row : row + r.texts.n], r.texts, covered(len(r.texts.data), starts, sizes) if len(starts) else None)
        else:
            for row, t in pieces(table["text"]):
                _append(out, ids[row : row + t.n], t, None)
        return pa.table(out, schema=_OUT)

    first = answered(per_chunk(chunks, first_pass), _shared, [("twice", "u1")])
    second = answered(with_answers(chunks, [first], second_pass, ASK), _kinds, SECOND.descr)
    last = answered(with_answers(chunks, [first, second], last_pass, ASK), _shared, LAST.descr)
    return with_answers(chunks, [first, second, last], finish, SCHEMA)


def _append(out: dict[str, list], ids: list, texts: Texts, gone: np.ndarray | None) -> None:
    """Rows of _OUT for some texts; gone: which of their bytes go, None for none."""
    for k, doc_id in enumerate(ids):
        a, b = int(texts.offsets[k]), int(texts.offsets[k + 1])
        mine = None if gone is None else gone[a:b]
        if mine is None or not mine.any():
            edges, kept = np.zeros((0, 2), int), texts.data[a:b]
        else:
            edges, kept = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0)).reshape(-1, 2), texts.data[a:b][~mine]
        out["doc_id"].append(doc_id)
        out["n_bytes"].append(b - a)
        out["n_removed"].append(b - a - len(kept))
        out["n_spans"].append(len(edges))
        out["kept_sha256"].append(hashlib.sha256(kept.tobytes()).hexdigest())
        out["spans"].append([{"start": int(x), "stop": int(y)} for x, y in edges])
