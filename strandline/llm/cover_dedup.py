"""Repeated passages of words, found at the places of a difference cover.

Any two places of two texts have a common shift, under the cover's period, that brings both to covered places.  So two
equal windows of `window` words share, at the same distance from their starts, an anchor of window - period + 1 words
at covered places of both.  Only anchors are asked for in the whole corpus; a window with an anchor that occurs
again is then extended to its full length and asked for as a whole, together with the first document that has it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import ASK, Layout, answered, chunked, distinct, measure, per_chunk, questions, with_answers
from .text import Texts, byte_values, covered, ngram_hashes, pieces, prefix_sums, spans

#: Perfect difference sets: every shift modulo the period is a difference of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,stop:long>>"
_U = np.uint64
#: What a chunk tells of a window: the second half of its hash, and the row that has it first.
OWNER = np.dtype([("check", "<u8"), ("id", "<i8"), ("text", "<u8")])


class _Piece:
    """Words, anchors and windows of some texts."""

    def __init__(self, texts: Texts, window: int, period: int) -> None:
        self.texts = texts
        self.starts, self.stops, self.firsts = texts.words()
        self.hashes = texts.word_hashes(self.starts, self.stops)
        self.window, self.period, self.length = window, period, window - period + 1

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        hashes, at = ngram_hashes(self.hashes, self.firsts, self.length)
        inside = at - np.repeat(self.firsts[:-1], np.diff(self.firsts))[at]
        ok = np.isin(np.arange(self.period), COVERS[self.period])[inside % self.period]
        return hashes[ok], at[ok]

    def windows(self, anchored: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that contain, at a shift under the period, one of these anchors: starts and two hashes."""
        n = len(self.hashes)
        first = np.zeros(n, bool)
        hit = np.zeros(n, bool)
        hit[anchored] = True
        for shift in range(min(self.period, n)):
            first[: n - shift] |= hit[shift:]
        room = np.repeat(self.firsts[1:], np.diff(self.firsts)) - np.arange(n)
        at = np.flatnonzero(first & (room >= self.window))
        if not len(at):
            return at, np.zeros(0, _U), np.zeros(0, _U)
        second = prefix_sums(self.texts.word_hashes(self.starts, self.stops, which=1), 1)
        return at, spans(prefix_sums(self.hashes), at, at + self.window), spans(second, at, at + self.window, 1)


def _pick_period(window: int) -> int:
    """The longest period that leaves anchors of at least two fifths of the window."""
    return max((p for p in COVERS if window - p + 1 >= max(1, 0.4 * window)), default=0)


def cover_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20, chunk_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 and the removed spans of words.

    A word is removed if a window of `window` words over it also starts earlier: in a smaller doc_id, or earlier in the
    same document.  Null and empty texts have no words; a text shorter than a window loses none.  Rows of one doc_id
    follow each other in the order of a hash of their texts, null ids come first, so equal rows after the first lose
    their words.  Other columns are ignored.  Windows are taken for equal if two independent 64-bit hashes of them are.
    """
    if window < 5:
        raise ValueError("a window has at least 5 words")
    period = _pick_period(window)
    layout = Layout(docs.sparkSession, measure(docs, text), chunk_bytes)
    chunks = chunked(docs, doc_id, text, layout)
    bits, shift = layout.filter_bits, _U(64 - layout.filter_bits)
    bucket_bits = layout.bucket_bits

    def anchor_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors of a chunk, and whether it has each more than once."""
        found = [_Piece(t, window, period).anchors()[0] >> shift for _, t in pieces(table["text"])]
        keys, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, _U), np.zeros(0, int))
        return keys, counts > 1

    def ask_anchors(chunk: int, table: pa.Table) -> pa.Table:
        keys, twice = anchor_keys(table)
        return questions(chunk, keys, bucket_bits, bits, twice.astype([("twice", "u1")]))

    def shared(group: np.ndarray, extras: np.ndarray) -> np.ndarray:
        twice = np.bincount(group) > 1
        twice[group[extras["twice"] > 0]] = True
        return twice[group]

    reply = answered(per_chunk(chunks, ask_anchors), shared, [("twice", "u1")])

    def repeated_windows(table: pa.Table, reply: np.ndarray) -> list[tuple]:
        """For each piece of text its first row, itself, and its windows around anchors that occur again."""
        keys, _ = anchor_keys(table)
        again = keys[reply > 0]
        out = []
        for row, t in pieces(table["text"]):
            piece = _Piece(t, window, period)
            hashes, at = piece.anchors()
            place = np.minimum(np.searchsorted(again, hashes >> shift), max(len(again) - 1, 0))
            hit = at[again[place] == hashes >> shift] if len(again) else at[:0]
            out.append((row, piece, *piece.windows(hit)))
        return out

    def first_places(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The first place of each distinct window of a chunk, numbered through all pieces; its hashes and its row."""
        keys, checks = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, _U) for k in (3, 4))
        rows = np.concatenate([f[0] + np.searchsorted(f[1].firsts, f[2], "right") - 1 for f in found]) if found else np.zeros(0, int)
        first = distinct(keys, checks)[1]
        return first, keys[first], checks[first], rows[first]

    def ask_windows(chunk: int, table: pa.Table, replies: list[np.ndarray]) -> pa.Table:
        _, keys, checks, rows = first_places(repeated_windows(table, replies[0]))
        extra = np.zeros(len(keys), OWNER)
        extra["check"], extra["id"], extra["text"] = checks, _ids(table)[rows], _text_hashes(table)[rows]
        return questions(chunk, keys, bucket_bits, 64, extra)

    def owned(group: np.ndarray, extras: np.ndarray) -> np.ndarray:
        """The row of the least id, then of the least hash of its text, has a window first; equal rows are of one chunk."""
        order = np.lexsort((extras["text"], extras["id"], group))
        mine = np.zeros(len(group), bool)
        mine[order[np.flatnonzero(np.diff(group[order], prepend=-1))]] = True
        return mine

    owners = answered(with_answers(chunks, [reply], ask_windows, ASK), owned, OWNER.descr)

    def finish(chunk: int, table: pa.Table, replies: list[np.ndarray]) -> pa.Table:
        found = repeated_windows(table, replies[0])
        first = first_places(found)[0]
        mine = np.zeros(sum(len(f[2]) for f in found), bool)
        mine[first[replies[1] > 0]] = True
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "spans": []}
        seen = 0
        ids = table["doc_id"].to_pylist()
        for row, piece, at, _, _ in found:
            gone = covered(len(piece.hashes), at[~mine[seen : seen + len(at)]], window)
            seen += len(at)
            total = np.concatenate([[0], np.cumsum(gone)])
            for k in range(piece.texts.n):
                a, b = piece.firsts[k], piece.firsts[k + 1]
                n_gone = int(total[b] - total[a])
                words = piece.texts.text(k).split()
                runs = []
                if n_gone:
                    edges = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                    runs = [{"start": int(x), "stop": int(y)} for x, y in edges]
                    words = [w for w, g in zip(words, gone[a:b].tolist(), strict=True) if not g]
                out["doc_id"].append(ids[row + k])
                out["n_words"].append(int(b - a))
                out["n_removed"].append(n_gone)
                out["kept_sha256"].append(hashlib.sha256(b" ".join(words)).hexdigest())
                out["spans"].append(runs)
        return pa.table(out, schema=_OUT)

    return with_answers(chunks, [reply, owners], finish, SCHEMA)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def _ids(table: pa.Table) -> np.ndarray:
    """Ids as numbers in their order; null is least."""
    import pyarrow.compute as pc

    return pc.fill_null(table["doc_id"], np.iinfo(np.int64).min).to_numpy()


def _text_hashes(table: pa.Table) -> np.ndarray:
    """A hash of each whole text; null and empty texts have no windows to own."""
    found = [spans(prefix_sums(byte_values(t.data)), t.offsets[:-1], t.offsets[1:]) for _, t in pieces(table["text"])]
    return np.concatenate(found) if found else np.zeros(0, _U)
