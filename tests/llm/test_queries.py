"""The registered queries themselves, over tables written to a folder, against their SQL, the library or plain versions."""

import random
import zlib

import duckdb
import public_tokenizers
import pytest
import sentencepiece

from strandline.llm import queries
from strandline.llm.sharding import shard

from .fixtures import COLUMNS, corpus, table, words
from .test_rules_tokens_chat import CHATS, naive_rules
from .test_search_mix_shard import filled, planted


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs, items, _ = planted(4, 1, 40)
    rows = [(k, t, "en", f"s{k % 4}", 0) for k, (_, t, *_) in enumerate([*corpus(12, 70), *docs, *((k, f"A common phrase: number{k} of many common phrases here, word{k % 3} again") for k in range(64))])]
    table(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 7 > 0), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    said = [c for c in CHATS if c[0] not in (None, -7)]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d, rows


def from_sql(folder, sql):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return sorted((tuple(dict(zip(names, row, strict=True))[c] for c in sorted(names)) for row in found.fetchall()), key=str), sorted(names)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, folder, name):
    out = queries.QUERIES[name](spark, folder[0])
    want, names = from_sql(folder[0], queries.ORACLE_SQL[name])
    assert sorted(out.columns) == names
    assert sorted((tuple(r[c] for c in names) for r in out.collect()), key=str) == want and want


def test_many_shards_equal_their_sql(spark, folder):
    out = shard(spark.read.parquet(f"{folder[0]}/documents.parquet"), 900)
    want, names = from_sql(folder[0], queries.sharding_sql(900))
    got = out.selectExpr("doc_id", "cast(coalesce(octet_length(text), 0) as long) AS n_bytes", "shard_id", "shard_depth", "shard_bytes", "shard_part").collect()
    assert sorted((tuple(r[c] for c in names) for r in got), key=str) == want and len({r.shard_id for r in got}) > 25


def test_op1(spark, folder):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in queries.op1_quality_rules(spark, folder[0]).collect()}
    assert got == {r[0]: naive_rules(r[1]) for r in folder[1]}
    assert not any(r.kept and r.base_failed for r in queries.op1_quality_rules(spark, folder[0]).collect())


def test_op4(spark, folder):
    out = queries.op4_mixing(spark, folder[0]).collect()
    size = {r[0]: len(words(r[1])) for r in folder[1]}
    total = {s: sum(size[r[0]] for r in folder[1] if r[3] == s) for s in ("s0", "s1", "s2", "s3")}
    want = dict(zip(total, filled([1, 2, 3, 1], [3 * n for n in total.values()], sum(total.values()))))
    source = {r[0]: r[3] for r in folder[1]}
    taken = dict.fromkeys(total, 0)
    for r in out:
        assert (r.size, r.source_size) == (size[r.doc_id], total[source[r.doc_id]]) and abs(r.target - want[source[r.doc_id]]) < 1e-6 * r.target
        assert r.taken == r.size * len(r.shards) <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert len(out) == len(folder[1]) and all(abs(taken[s] - want[s]) <= max(size.values()) for s in total)
    key = lambda rows: sorted((r.doc_id, r.taken, tuple(r.shards)) for r in rows)
    assert key(out) == key(queries.op4_mixing(spark, folder[0]).collect())


def test_op6(spark, folder):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op6_token_counts(spark, folder[0]).collect()}
    assert got == {r[0]: (len((r[1] or "").encode()), n := len(library.encode(r[1] or "")), n > 4096) for r in folder[1]}


def test_op7(spark, folder):
    out = queries.op7_quality_fm(spark, folder[0]).collect()
    assert {r.doc_id: r.held_out for r in out} == {r[0]: zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in folder[1]}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)


def test_op10(spark, folder):
    got = {(r.doc_id, r.item_id) for r in queries.op10_decontamination(spark, folder[0]).collect()}
    _, _, truth = planted(4, 1, 40)
    truth = {(d + 70, k) for d, k in truth}
    assert len(got & truth) >= 0.97 * len(truth)


def test_marks_are_the_same_in_any_order(spark):
    """Of unlike labels of an id the least holds, wherever it stands."""
    r = random.Random(2)
    rows = [(k, " ".join(f"w{r.randrange(900)}" + ("##" if k % 5 == 0 else "") for _ in range(60)), "", "", 0) for k in range(60)]
    marks = [(k, int(k % 5 > 0), 0) for k in range(60)] + [(k, 1, 0) for k in range(0, 60, 5)]
    found = []
    for order in (marks, marks[::-1]):
        labels = spark.createDataFrame(order, "doc_id long, quality int, toxic int")
        found.append(sorted((x.doc_id, x.rules.kept, x.rules.score) for x in queries.quality_rules(table(spark, rows), labels, trees=20).collect()))
    assert found[0] == found[1] and not any(kept for k, kept, _ in found[0] if k % 5 == 0)
    assert queries.quality_rules(spark.createDataFrame([], COLUMNS), labels, trees=5).collect() == []


def test_op12(spark, folder):
    import hashlib

    from .test_semi_crf import plain

    out = queries.op12_semi_crf(spark, folder[0]).collect()
    assert len(out) == len(folder[1])
    text = {r[0]: r[1] or "" for r in folder[1]}
    for r in out:
        base = plain(text[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for _, k, _ in base) for kind in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, k, z in base).encode()).hexdigest()
        assert {f"{k}:{a}:{z}" for a, k, z in base} <= set(r.spans.split(",")) | {""}
