"""Suffix sorting against sorted tuples, and phrases against plain counts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from strandline.llm import collocations as co


def test_suffixes_and_partitions_are_those_of_tuples():
    r = np.random.default_rng(2)
    for n, vocabulary in ((0, 1), (1, 1), (2, 1), (50, 2), (300, 5), (2000, 40), (500, 1)):
        words = r.integers(0, vocabulary, n + 4)
        starts = np.flatnonzero(r.random(n) < 0.8) if n else np.zeros(0, int)
        lengths = r.integers(1, 5, len(starts))
        order, lo, hi, depth = co.sorted_suffixes(words, starts, lengths)
        suffixes = [tuple(words[s : s + k]) for s, k in zip(starts, lengths, strict=True)]
        assert [suffixes[k] for k in order] == sorted(suffixes)
        want = Counter(x[:k] for x in suffixes for k in range(1, len(x) + 1))
        got = [(suffixes[order[a]][:d], z - a) for a, z, d in zip(lo, hi, depth, strict=True)]
        assert len(got) == len(want) and dict(got) == want


def plain(rows, least, top, inside=80):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        mine = []
        for p, a in cand.items():
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            longer = [c for q, c in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * c >= inside * a for c in longer):
                mine.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank + 1, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(mine)[:top])]
    return sorted(out)


@pytest.mark.parametrize("chunk_bytes", [1 << 10, 4 << 20])
def test_phrases_are_the_plain_ones(spark, monkeypatch, chunk_bytes):
    monkeypatch.setattr(co, "phrase_counts", lambda *a, f=co.phrase_counts: f(*a, chunk_bytes=chunk_bytes))
    r = random.Random(6)
    vocabulary = ["new", "York", "Stock", "exchange", "a", "É", "b!", "c,d", "über", "x\ty", "||"]
    text = lambda k: "".join(r.choice(vocabulary) + r.choice([" "] * 6 + ["  ", "\n", ". "]) for _ in range(k))
    rows = [(r.choice(["en", "de", None, "und"]), text(r.randint(0, 60))) for _ in range(300)]
    rows += [("en", None), ("en", ""), (None, "..,"), ("fr", "one")] + [("en", "New York Stock Exchange a b c d")] * 40 + [("xx", "same words " * 3000)]
    table = spark.createDataFrame([(*x, k % 3, "n") for k, x in enumerate(rows)], "lang string, text string, n int, phrase string").repartition(4)
    for top in (2000, 7):
        got = co.collocations(table, least=12, top=top).collect()
        want = plain(rows, 12, top)
        assert sorted(tuple(x[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for x in got) == want and len(want) > (40 if top > 7 else 20)
    assert co.collocations(table.where("lang = 'fr'")).collect() == [] == co.collocations(table.where("false")).collect()


def test_products_over_64_bits_are_exact(spark, monkeypatch):
    counts = [("en", 0, None, 9 * 10**18), ("en", 1, "a", 8 * 10**18), ("en", 1, "b", 10**18), ("en", 2, "a b", 999_999_999_999_999_999)]
    monkeypatch.setattr(co, "phrase_counts", lambda *a: spark.createDataFrame(counts, co.COUNTS))
    row = co.collocations(spark.createDataFrame([], "text string, lang string")).first()
    assert row.score == 2_000_000 * 999_999_999_999_999_999 // (9 * 10**18)
