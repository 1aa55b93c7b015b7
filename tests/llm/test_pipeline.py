import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline

from .fixtures import COLUMNS, words
from .test_dedup import naive_links
from .test_rules_tokens_chat import naive_rules
from .test_search_mix_shard import edits, filled


def corpus(seed=4):
    """Prose, junk, copies, near copies and leaked items, each with what should become of it."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(3, 8))) for _ in range(3000)]
    phrase = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(phrase(r.randint(15, 30)))) for k in range(6)]
    rows, marks = [], []
    for k in range(260):
        kind = k % 13
        if kind == 3 and rows:
            text = r.choice(rows)[1]
        elif kind == 5 and rows:
            w = words(r.choice(rows)[1])
            if w:
                w[r.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 7:
            text = " ".join(x + "###" for x in phrase(80))
        elif kind == 9:
            leak = r.choice(items)[1].split()
            text = " ".join(phrase(40) + leak + phrase(30))
        elif kind == 11:
            text = " ".join(phrase(10))
        else:
            text = " ".join(phrase(r.randint(60, 150)))
        rows.append((k, text, "en", f"src{k % 4}", len(text)))
        if k % 2:
            marks.append((k, int("###" not in text), 0))
    return rows, items, marks


def test_stages_against_plain_versions(spark, tmp_path):
    rows, items, marks = corpus()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append([tuple(r) for r in docs.collect()])
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    by_id = {r[0]: r for r in rows}
    assert all(by_id[r[0]] == r for part in kept[:4] for r in part)

    want = {r[0] for r in rows if not naive_rules(r[1])[5] and "###" not in r[1]}
    assert {r[0] for r in kept[0]} == want

    links = naive_links(kept[0])
    assert sorted(r[0] for r in kept[1]) == sorted(d for d, (_, c) in links.items() if c == d)

    def leaked(text):
        w = words(text.lower())
        for _, item in items:
            i = words(item.lower())
            if any(edits(i, w[a : a + len(i) + e]) <= len(i) // 5 for a in range(len(w) - len(i) + 1) for e in (0,)):
                return True
        return False

    assert {r[0] for r in kept[2]} == {r[0] for r in kept[1] if not leaked(r[1])}

    size = {r[0]: len(words(r[1])) for r in kept[2]}
    by_source = Counter()
    for r in kept[2]:
        by_source[r[3]] += size[r[0]]
    names = sorted(by_source)
    targets = dict(zip(names, filled([[1, 2, 3][k % 3] for k in range(len(names))], [3 * by_source[s] for s in names], sum(by_source.values()))))
    copies, taken = Counter(r[0] for r in kept[3]), Counter()
    for r in kept[3]:
        taken[r[3]] += size[r[0]]
    assert max(copies.values()) <= 3 and set(copies) <= set(size)
    assert all(abs(taken[s] - targets[s]) <= max(size.values()) for s in names)

    assert Counter(r[0] for r in kept[4]) == copies
    shards = defaultdict(int)
    for r in docs.collect():
        shards[r.shard_id, r.shard_part] += len(r.text.encode())
    assert all(n <= corpus_pipeline.SHARD_BYTES for n in shards.values())


def test_near_duplicates_of_repeated_and_missing_ids(spark, tmp_path):
    r = random.Random(8)
    texts = [" ".join(f"{c}{r.randrange(10**6)}" for _ in range(70)) for c in "abcde"]
    near = [t + " changed" for t in texts]
    rows = [(1, texts[0]), (1, texts[1]), (2, near[0]), (0, near[1]), (None, texts[2]), (None, texts[2]), (None, near[2]), (None, near[0]), (3, texts[3]), (3, near[3]), (4, texts[4]), (4, texts[4]), (5, "")]
    want = [(0, near[1]), (1, texts[0]), (4, texts[4]), (5, "")]
    found = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in order], COLUMNS).repartition(3)
        out = [(x.doc_id, x.text) for x in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()]
        assert sorted(x for x in out if x[0] not in (None, 3)) == want
        assert len([x for x in out if x[0] is None]) == 1 and {x[1] for x in out if x[0] is None} < {texts[2], near[2]}
        assert len([x for x in out if x[0] == 3]) == 1
        found.append(sorted(out, key=str))
    assert found[0] == found[1]


def test_run_on_empty_and_odd_tables(spark, tmp_path):
    for k, rows in enumerate(([], [(None, None, None, None, None), (1, "", None, None, None), (2, " ".join(f"w{x}" for x in range(40)), None, None, None)])):
        d = f"{tmp_path}/{k}"
        spark.createDataFrame(rows, COLUMNS).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        assert sorted(r.doc_id for r in corpus_pipeline.run(spark, d).collect()) == ([] if k == 0 else [2])


def test_own_columns_of_any_name_and_type_stay(spark, tmp_path):
    rows, items, marks = corpus(9)
    own = ["_row", "rules", "mix", "_place", "key", "check", "row", "mix_file", "shard_id", "chunk", "component_id", "a.b"]
    table = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in own}).withColumn("m", F.create_map(F.lit("id"), "doc_id"))
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns[: len(table.columns)] == table.columns and (k == 4 or len(docs.columns) == len(table.columns))
    out = docs.collect()
    assert out and all(r[c] == f"{c} of {r.doc_id}" for r in out for c in own) and all(r.m == {"id": r.doc_id} for r in out)
    assert all(r._mix_file and r._mix_row is not None and r._shard_part == 0 for r in out)
    assert len({(r._mix_file, r._mix_row) for r in out}) == len(out)


def test_rows_that_one_hash_takes_for_another_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "row_key", lambda text: F.pmod(F.length(text), F.lit(1000)).cast("long"))
    texts = [" ".join(f"w{k}{j:03d}" for j in range(40)) for k in range(3)]  # of equal length: one key for all three
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate([*texts, texts[0] + " more"])], COLUMNS)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()) == [0, 1, 2, 3]
