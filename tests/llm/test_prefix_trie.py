"""The trie against a plain one: long conversations, absent bases, turnless ones, nulls, ties, repeated rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from strandline.llm import prefix_trie as pt

from .fixtures import words

SCHEMA = "conv_id long, turn long, role string, text string, node string"


def rows_of(seed=3):
    r = random.Random(seed)
    text = lambda: " ".join(r.choice("ab") for _ in range(r.randint(0, 3)))
    out = []
    for c in [*range(0, 45), -20, -7, 61, 400]:
        if c in (20, 33):
            continue
        for k in range(r.choice([1, 1, 2, 4, 9, 16, 17])):
            out.append((c, k, r.choice(["user", None]), text() if r.random() < 0.9 else None, "mine"))
    out += [(100, k, "user", "a", "x") for k in range(40)] + [(101, k, "user", "a", "x") for k in range(41)]
    out += [(44, None, "user", "first", "x"), (44, 1, "user", "tie", "x"), (44, 1, "user", "tie", "x"), (None, 0, "user", "no id", "x")]
    r.shuffle(out)
    return out


def plain(rows, rebuild):
    said = defaultdict(list)
    for c, turn, role, text, _ in rows:
        if c is not None:
            said[c].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [x[2:] for x in sorted(v)] for c, v in said.items()}
    built = said
    if rebuild:
        built = {}
        for c, own in said.items():
            h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
            built[c] = said.get(base, [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    children = defaultdict(int)
    for v in nodes:
        if v:
            children[v[:-1]] += 1
    sums = defaultdict(lambda: [0, 0])
    for v, m in nodes.items():
        own = (int(children[v] == 0), (len(m) - 1) * len(words(v[-1][1])) if v else 0)
        for d in range(len(v) + 1):
            sums[v[:d]][0] += own[0]
            sums[v[:d]][1] += own[1]
    ends = lambda v: hashlib.sha256(",".join(map(str, sorted(c for c in nodes[v] if len(built[c]) == len(v)))).encode()).hexdigest()
    return sorted((min(m), len(v), min(nodes[v[:-1]]) if v else None, len(m), children[v], *sums[v], ends(v)) for v, m in nodes.items()), built


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("slab", [1, 512])
def test_rebuilt_trie_is_the_plain_one(spark, monkeypatch, slab):
    monkeypatch.setattr(pt, "SLAB", slab)
    monkeypatch.setattr(pt, "RUN", 7)
    rows = rows_of()
    out = pt.prefix_trie(pt.rebuilt(pt.turn_ids(pt.numbered(spark.createDataFrame(rows, SCHEMA).repartition(5))))).collect()
    want, built = plain(rows, True)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in out) == want
    assert any(not t for t in built.values()) and max(map(len, built.values())) > 4 * pt.WIDTH
    assert len({r.node for r in out}) == len(out)


def test_own_turns_with_texts(spark):
    rows = rows_of(5)
    out = pt.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    want, built = plain(rows, False)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in out) == want
    assert all((r.role, r.text) == (built[r.conv_id][r.depth - 1] if r.depth else (None, None)) for r in out)


def test_no_conversations_no_nodes(spark):
    assert pt.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert pt.conversation_trie(spark.createDataFrame([(None, 1, "user", "a", "x")], SCHEMA)).collect() == []


def test_numbers_of_a_conversation_that_spans_ranges(spark):
    rows = [(1, k % 700, "user", f"t{k}", "x") for k in range(1400)] + [(c, 0, "user", "a", "x") for c in range(2, 30)]
    got = sorted((r.conv_id, r.place, r.text) for r in pt.numbered(spark.createDataFrame(rows, SCHEMA)).collect())
    want = sorted((1, k + 1, t) for k, (_, t) in enumerate(sorted((r[1], r[3]) for r in rows if r[0] == 1))) + [(c, 1, "a") for c in range(2, 30)]
    assert got == want
