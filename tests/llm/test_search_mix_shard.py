import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm.decontaminate import benchmark_matches, decontaminated, near_segment
from strandline.llm import mixing
from strandline.llm.mixing import laid_out, mix, split_quotas
from strandline.llm.quality_fm import Machine, fitted, quality_scores
from strandline.llm.sharding import shard

from .fixtures import COLUMNS, corpus, table, words


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_near_segment_is_exact():
    r = random.Random(1)
    for _ in range(200):
        item = [r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(1, 6))]
        text = [r.choice([b"a", b"b", b"c", b"d"]) for _ in range(r.randint(0, 9))]
        best = min(edits(item, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        got = near_segment(item, text, 6)
        assert got[2] == best and edits(item, text[got[0] : got[1]]) == best
        assert near_segment(item, text, best - 1) is None


def planted(seed, n_edits, n=200):
    """Documents with an item each, edited n_edits times per 10 words."""
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(900)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.randint(8, 60)))) for k in range(30)] + [(77, "Two Words"), (78, ""), (79, None), (80, "single!")]
    docs, truth = [], set()
    for k in range(n):
        item, text = r.choice(items[:30])
        w = text.split()
        for _ in range(n_edits * len(w) // 10):
            at, how = r.randrange(len(w)), r.random()
            if how < 0.34:
                w[at] = r.choice(vocab)
            elif how < 0.67:
                del w[at]
            else:
                w.insert(at, r.choice(vocab))
        filler = lambda: [r.choice(vocab) for _ in range(r.randint(0, 80))]
        docs.append((k, " ".join(filler() + [x.upper() for x in w] + filler()), "", "", 0))
        if edits([x.lower() for x in w], text.split()) <= len(text.split()) // 5:
            truth.add((k, item))
    docs += [(n + k, t, "", "", 0) for k, t in enumerate([None, "", "two words", "Two", "a single! b"])]
    return docs, items, truth | {(n + 2, 77), (n + 4, 80)}


@pytest.mark.parametrize("n_edits,recall", [(0, 1.0), (1, 0.97), (2, 0.95)])
def test_decontamination_recall_and_precision(spark, n_edits, recall):
    docs, items, truth = planted(n_edits, n_edits, 150)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = benchmark_matches(table(spark, docs), benchmark).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert len(found & truth) >= recall * len(truth), (len(found & truth), len(truth))
    text, item = {d[0]: words((d[1] or "").lower()) for d in docs}, dict(items)
    for r in got:
        w = words(item[r.item_id].lower())
        assert r.edits <= len(w) // 5 and edits(w, text[r.doc_id][r.start : r.start + r.n_words]) == r.edits
    clean = {r.doc_id for r in decontaminated(table(spark, docs), benchmark).select("doc_id").collect()}
    assert clean == {d[0] for d in docs} - {d for d, _ in found}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert benchmark_matches(table(spark, docs), empty).count() == 0 and benchmark_matches(spark.createDataFrame([], COLUMNS), benchmark).count() == 0


def test_long_items_and_blocks_of_items(spark, monkeypatch):
    r = random.Random(9)
    vocab = [f"w{k}" for k in range(5000)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(n))) for k, n in enumerate([100, 300, 1000] * 4)]
    docs = []
    for k, item in [*items, *items]:
        w = item.split()
        for _ in range(len(w) // 5):
            at, how = r.randrange(len(w)), r.randrange(3)
            w[at : at + (how < 2)] = [r.choice(vocab)] if how else []
        docs.append((k, " ".join([*r.choices(vocab, k=50), *w, *r.choices(vocab, k=20)]), "", "", 0))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {(k, k) for k in range(12)}
    whole = benchmark_matches(table(spark, docs), benchmark).collect()
    assert len({(x.doc_id, x.item_id) for x in whole} & want) >= 0.95 * len(want)
    monkeypatch.setattr("strandline.llm.decontaminate.BLOCK_BYTES", 4000)
    assert sorted(benchmark_matches(table(spark, docs), benchmark).collect()) == sorted(whole)
    clean = [(100, "nothing of that kind", "", "", 0)]
    assert [x.doc_id for x in decontaminated(table(spark, docs + clean), benchmark).collect()] == [x[0] for x in docs + clean if x[0] not in {h.doc_id for h in whole}]


def filled(weights, limits, total):
    out, open_, left = [0.0] * len(weights), {k for k, x in enumerate(limits) if x > 0}, total
    while open_ and left > 0:
        sum_w = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / sum_w >= limits[k]]
        if not over:
            for k in open_:
                out[k] = left * weights[k] / sum_w
            break
        for k in over:
            out[k] = limits[k]
            left -= limits[k]
        open_ -= set(over)
    return out


@pytest.mark.parametrize("seed,block", [(1, 200), (2, 1000), (3, 100_000)])
def test_mix_meets_targets(spark, seed, block):
    rows = [(d, t, lang, r, n) for (d, t, lang, _, n), r in zip(corpus(seed, 300), random.Random(seed).choices(["a", "b", "É", None, "z", ""], [50, 5, 5, 5, 5, 30], k=300))]
    rows += [(5000, " ", "", "empty source", 0)]
    out = mix(table(spark, rows), block_words=block, shard_words=3000).collect()
    assert len(out) == len(rows)
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    want = dict(zip(names, filled([[1, 2, 3][k % 3] for k in range(len(names))], [3 * size[s] for s in names], sum(size.values()))))
    taken, largest = Counter(), max(len(words(r[1])) for r in rows)
    for r in out:
        m = r.mix
        assert m.size == len(words(r.text)) and m.source_size == size[r.source] and abs(m.target - want[r.source]) < 1e-6 * max(1, m.target)
        assert len(m.places) == m.copies <= 3 and (m.size or not m.copies)
        taken[r.source] += m.size * m.copies
    assert all(abs(taken[s] - want[s]) <= largest for s in names)
    again = mix(table(spark, rows, 7), block_words=block, shard_words=3000).collect()
    key = lambda rs: sorted((r.doc_id, r.mix.copies, sorted((p.shard, p.position) for p in r.mix.places)) for r in rs)
    assert key(out) == key(again)


def test_quotas_are_exact_and_fair(spark):
    blocks = spark.createDataFrame([(1, 900), (2, 90), (3, 10)], "source_key long, n long")
    got = split_quotas(blocks, 5, 1).collect()
    by, shards = Counter(), Counter()
    for r in got:
        by[r.source_key] += r.n
        shards[r.shard] += r.n
    assert by == {1: 900, 2: 90, 3: 10} and set(shards) == set(range(5)) and all(n == 200 for n in shards.values())
    assert all(abs(r.n - 180) < 25 for r in got if r.source_key == 1)


def test_documents_are_where_the_tree_deals_their_blocks(spark, monkeypatch):
    rows = corpus(3, 200)
    given = dict(block_words=100, shard_words=1000)
    out = mix(table(spark, rows), **given)
    shards = Counter(p.shard for r in out.collect() for p in r.mix.places)
    assert len(shards) > 3
    taken = {r.doc_id: r.mix.places for r in out.collect() if r.mix.copies}
    parts = defaultdict(list)
    for r in laid_out(out).select("doc_id", F.spark_partition_id().alias("part")).collect():
        parts[r.part].append(r.doc_id)
    assert Counter(d for ids in parts.values() for d in ids) == {d: len(p) for d, p in taken.items()}
    by_shard = defaultdict(list)
    for doc, places in taken.items():
        for p in places:
            by_shard[p.shard].append((p.position, doc))
    # each shard's documents stand together, in the order of their positions
    for members in by_shard.values():
        want = [doc for _, doc in sorted(members)]
        assert any(ids[k : k + len(want)] == want for ids in parts.values() for k in range(len(ids)))
    monkeypatch.setattr(mixing, "split_quotas", lambda blocks, shards, seed: blocks.select("source_key", F.lit(0).alias("shard"), "n"))
    assert Counter(p.shard for r in mix(table(spark, rows), **given).collect() for p in r.mix.places).keys() == {0}
    monkeypatch.setattr(mixing, "split_quotas", lambda blocks, shards, seed: blocks.select("source_key", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("n")).where("n > 0"))
    assert sum(r.mix.copies for r in mix(table(spark, rows), **given).collect()) == 0


def test_mix_of_odd_rows(spark):
    assert mix(spark.createDataFrame([], COLUMNS)).collect() == []
    rows = [(None, None, None, None, None), (1, "a b c", None, None, None), (1, "a b c", None, None, None)]
    out = mix(table(spark, rows).selectExpr("*", "1 AS block", "2 AS copies", "3 AS h", "4 AS mix")).collect()
    assert len(out) == 3 and sum(r.mix.size * r.mix.copies for r in out) == 6 and all((r.block, r.copies, r.h) == (1, 2, 3) for r in out)


@pytest.mark.parametrize("limit", [500, 2000, 10**9])
def test_shards_fit_and_split_only_when_needed(spark, limit):
    rows = corpus(7, 150)
    out = shard(table(spark, rows), limit).collect()
    assert sorted(r.doc_id for r in out) == list(range(150))
    size = defaultdict(int)
    for r in out:
        size[r.shard_id, r.shard_part] += len((r.text or "").encode())
    ids = {s for s, _ in size}
    for r in out:
        n = size[r.shard_id, r.shard_part]
        assert r.shard_bytes == n and len(r.shard_id) == r.shard_depth and (n <= limit or Counter(x.shard_id for x in out)[r.shard_id] == 1)
    assert not any(a != b and b.startswith(a) for a in ids for b in ids)
    for s in ids - {""}:  # the parent of each leaf is oversized
        assert sum(n for (x, _), n in size.items() if x.startswith(s[:-1])) > limit


def test_shards_of_equal_rows(spark):
    rows = [(1, "x" * 300, None, None, k % 2) for k in range(25)] + [(2, "y" * 5000, None, None, 0), (None, None, None, None, None), (3, "", None, None, 0)]
    df = table(spark, rows).selectExpr("*", "1 AS key", "2 AS size", "3 AS row", "4 AS shard_id")
    out = shard(df, 1000).collect()
    assert len(out) == 28 and all((r.key, r.size, r.row) == (1, 2, 3) for r in out)
    size = Counter()
    for r in out:
        size[r.shard_id, r.shard_part] += len(r.text or "")
    assert all(r.shard_bytes == size[r.shard_id, r.shard_part] for r in out)
    assert sorted(size.values())[-1] == 5000 and all(n <= 1000 for n in sorted(size.values())[:-1])
    assert sum(1 for n in size.values() if n == 900) == 8
    assert shard(spark.createDataFrame([], COLUMNS), 10).collect() == []


def test_machine_identity():
    rng = np.random.default_rng(0)
    m = Machine(0.1, rng.normal(size=50), rng.normal(size=(50, 4)))
    number, value = rng.choice(50, 7, replace=False), rng.normal(size=7)
    want = m.w0 + m.w[number] @ value + sum(m.v[number[i]] @ m.v[number[j]] * value[i] * value[j] for i in range(7) for j in range(i))
    assert abs(m.margin(number, value, np.array([0, 7]))[0] - want) < 1e-9


def test_machine_learns_a_pairwise_rule():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        rows.append((np.array([a, 2 + b], np.int32), np.ones(2, np.float32)))
        y.append(float(a == b))
    m = fitted(rows, np.array(y), epochs=15)
    at = [m.margin(np.array([a, 2 + b]), np.ones(2), np.array([0, 2]))[0] > 0 for a in (0, 1) for b in (0, 1)]
    assert at == [True, False, False, True]


def test_quality_scores(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9)))
    rows, marks = [(None, None, "", "", 0), (5000, "", "", "", 0)], [(6000, 1, 0), (None, 1, 0), (3, None, 0)]
    for k in range(500):
        w = [word() for _ in range(r.randint(5, 80))]
        bad = k % 4 == 0
        rows.append((k, " ".join(x + "%%" for x in w) if bad else " ".join(w), "", "", 0))
        if k % 3:
            marks.append((k, int(not bad), 0))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = quality_scores(table(spark, rows), labels).collect()
    assert len(out) == 502 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in out)
    held = [x for x in out if x.held_out]
    import zlib

    assert {x.doc_id for x in held} == {d[0] for d in rows if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0}
    assert np.mean([x.predicted == (x.doc_id % 4 != 0) for x in held if x.doc_id < 500]) > 0.95
    assert quality_scores(spark.createDataFrame([], COLUMNS), labels).collect() == []
    assert {x.score for x in quality_scores(table(spark, rows), labels.limit(0)).collect()} == {0.5}
