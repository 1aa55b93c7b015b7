import hashlib
from collections import Counter, defaultdict

import pytest

from strandline.llm.components import components
from strandline.llm.cover_dedup import COVERS, cover_dedup
from strandline.llm.group_join import ngram_join
from strandline.llm.radix_dedup import radix_dedup

from .fixtures import COLUMNS, corpus, table, words


def sha(b):
    return hashlib.sha256(b).hexdigest()


def naive_words(rows, window):
    seen, out = set(), {}
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        out[doc] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode()))
    return out


def naive_bytes(rows, length):
    count = Counter()
    data = {doc: (text or "").encode() for doc, text, *_ in rows}
    for b in data.values():
        count.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = {}
    for doc, b in data.items():
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[doc] = (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def naive_links(rows, n=5, percent=80):
    sets = {}
    for doc, text, *_ in rows:
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(text)]
        sets[doc] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_covers_reach_every_shift():
    for period, cover in COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("seed,window", [(1, 20), (2, 20), (3, 8), (4, 33)])
def test_cover_dedup(spark, seed, window):
    rows = corpus(seed, 90)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in cover_dedup(table(spark, rows), window=window, chunk_bytes=3000).collect()}
    assert got == naive_words(rows, window)


@pytest.mark.parametrize("seed,length", [(1, 400), (2, 100), (3, 60), (5, 40)])
def test_radix_dedup(spark, seed, length):
    rows = corpus(seed, 90)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in radix_dedup(table(spark, rows), length=length, chunk_bytes=3000).collect()}
    assert got == naive_bytes(rows, length)


def test_radix_dedup_of_low_entropy_and_long_texts(spark):
    r = corpus(9, 20)
    long = " ".join(t for _, t, *_ in r if t) * 3
    big = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(1_300_000))
    rows = [(1, "a" * 1500, "", "", 0), (2, "ab" * 300, "", "", 0), (3, "a" * 399, "", "", 0), (4, long, "", "", 0), (5, "x" + long[700:2500], "", "", 0)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in radix_dedup(table(spark, rows)).collect()}
    assert got == naive_bytes(rows, 400)
    rows = [(1, big, "", "", 0), (2, "--" + big[500_000:501_000] + "--", "", "", 0)]
    got = {r.doc_id: r.n_removed for r in radix_dedup(table(spark, rows)).collect()}
    assert got[2] == 1000


@pytest.mark.parametrize("seed,percent", [(1, 80), (2, 80), (3, 60), (6, 90)])
def test_ngram_join(spark, seed, percent):
    rows = corpus(seed, 120, longest=60)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(table(spark, rows), percent=percent, chunk_bytes=3000).collect()}
    assert got == naive_links(rows, percent=percent)


def test_ngram_join_of_a_chain(spark):
    """Each text changes one more word: neighbours link, the ends do not, and all are one component."""
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(40):
        rows.append((100 + k, " ".join(base), "", "", 0))
        base = [*base]
        base[(k * 7) % 60] = f"x{k}"
    got = {r.doc_id: r.component_id for r in ngram_join(table(spark, rows)).collect()}
    want = {d: c for d, (_, c) in naive_links(rows).items()}
    assert got == want


@pytest.mark.parametrize("op,columns", [(cover_dedup, 4), (radix_dedup, 5), (ngram_join, 4)])
def test_empty_null_and_repeated_rows(spark, op, columns):
    assert op(spark.createDataFrame([], COLUMNS)).collect() == []
    text = " ".join(f"w{k} of many" for k in range(300))
    rows = [(None, text, None, None, None), (None, None, None, None, None), (1, text, None, None, None), (1, text, None, None, None), (2, None, None, None, None)]
    df = table(spark, rows)
    for c in ("chunk", "bucket", "keys", "answer", "component", "group_id", "n_words"):
        df = df.withColumn(c, df.doc_id)
    got = op(df).collect()
    assert len(got) == 5 and sorted(r.doc_id is None for r in got) == [False] * 3 + [True] * 2
    if op is cover_dedup:
        assert sorted(r.n_removed for r in got) == [0, 0, 0, 900, 900]
    if op is radix_dedup:
        assert sorted(r.n_removed for r in got) == [0, 0] + [len(text)] * 3
    if op is ngram_join:
        assert {(r.doc_id, r.component_id) for r in got} == {(None, None), (1, 1), (2, 2)}


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 9), (9, 1), (20, 21), (21, 20), (7, 7)] + [(k, k + 1) for k in range(100, 160)]
    got = defaultdict(set)
    for r in components(spark.createDataFrame(links, "a long, b long")).collect():
        got[r.component].add(r.node)
    assert got == {1: {1, 3, 4, 5, 9}, 20: {20, 21}, 100: set(range(100, 161))}
