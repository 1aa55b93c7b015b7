"""Plain patterns against their regular expressions, the field's sums against enumeration, and held-out spellings."""

import itertools
import random
import re

import numpy as np
import pytest

from strandline.llm import semi_crf as sc

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain(text):
    found = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text):
            x = m.group()
            digits = [c for c in x if c in "0123456789"]
            checks = [int(c) for c in digits][::-1]
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in x.split(".")),  # noqa: B023
                "card": lambda: 12 <= len(digits) <= 19 and sum(checks[::2] + [v * 2 - 9 * (v > 4) for v in checks[1::2]]) % 10 == 0,  # noqa: B023
                "phone": lambda: 9 <= len(digits) <= 15,  # noqa: B023
            }[kind]()
            if ok:
                found.append((m.start(), k, kind, m.end()))
    return [(a, kind, z) for a, _, kind, z in sorted(found)]


@pytest.fixture(scope="module")
def model():
    r = random.Random(5)
    words = ["".join(r.choice("abcdeilnorst") for _ in range(r.randint(2, 8))) for _ in range(300)]
    phrase = lambda: " ".join(r.choice(words) for _ in range(4))
    windows = [f"{phrase()} {x} {phrase()}" for x in ("+1 (614) 555-8001", "4111111111111111", "10.1.2.3", "ab.1@mail.example.com", "version 2.0.", "page 17") for _ in range(10)]
    return sc.fit(sc.examples(windows)), windows


def test_plain_spans_are_their_patterns():
    r = random.Random(1)
    pieces = ["+", "1", "23", "255", "4111111111111111", "4111-1111 1111-1111", ".", "..", "-", " ", "  ", "(", ")", "@", "a@b.c", "a.b@c-d.e.f", "x", "é", "\n", "@@", "ab@", "@cd.ef", "300.1.2.3", "0001.2.3.4", "5", "+1 (614) 555-8001", "1234567890"]
    for _ in range(4000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 12)))
        assert sc.base_spans(text) == plain(text), text
    assert sc.base_spans("1" * 50_000) == [] and sc.base_spans("a" * 50_000 + "@") == []


def enumerated(size, segs, score, after):
    """All segmentations of places 0 .. size - 1: (weight, segments)."""
    out = []
    for n in range(len(segs) + 1):
        for chosen in itertools.combinations(sorted(segs, key=lambda s: s[1]), n):
            if all(a[2] <= b[1] for a, b in itertools.pairwise(chosen)):
                last, weight = 0, 0.0
                for r, _, _, kind in chosen:
                    weight += score[r] + after[last, kind]
                    last = kind + 1
                out.append((weight, chosen))
    return out


def test_expectations_and_best_way_are_those_of_all_ways():
    r = np.random.default_rng(3)
    for _ in range(20):
        size, segs = 6, []
        for k in range(6):
            a, z = sorted(r.choice(6, 2, replace=False))
            segs.append((k, int(a), int(z), int(r.integers(4))))
        score, after = r.normal(size=6), r.normal(size=(5, 4))
        mass, pairs = np.zeros(6), np.zeros((5, 4))
        sc._expected(size, sorted(segs, key=lambda s: s[2]), score, after, mass, pairs)
        ways = enumerated(size, segs, score, after)
        weight = np.exp([w for w, _ in ways])
        weight /= weight.sum()
        want = np.zeros(6)
        for p, (_, chosen) in zip(weight, ways, strict=True):
            for s in chosen:
                want[s[0]] += p
        assert np.allclose(mass, want) and np.isclose(pairs.sum(), want.sum())
        scores = [(a, z, sc.KINDS[k], float(score[i])) for i, a, z, k in segs]
        best = max(ways, key=lambda w: w[0])
        got = sc.Model({}, np.zeros((4, 0)), after).decoded(scores)
        assert got == [(a, sc.KINDS[k], z) for _, a, z, k in best[1]]


def test_other_spellings_are_found_and_decoys_left(model):
    field, windows = model
    held = sc.examples(windows, seed=77, each=60)
    right = wrong = missed = 0
    for text, truth in held:
        got, want = {s[:3] for s in field.spans(text)}, set(truth)
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right > 300 and wrong <= 0.04 * right and missed <= 0.04 * right
    r = random.Random(4)
    assert sum(bool(field.spans(f"we have {sc.decoy(r, lambda: 'thing')} here")) for _ in range(400)) <= 30


def test_query_form(spark, model):
    field, _ = model
    two = "cards 4111111111111111 4012888888881881 and john (at) mail (dot) com"
    rows = [(1, "mail a.b@c.org, ip 10.0.0.1.", "x"), (1, None, "y"), (None, "", "z"), (4, two, "w"), (5, "plain words " * 9000 + "+1 (614) 555-8001", "v")]
    out = {r.pii: r for r in sc.redacted(sc.pii_spans(spark.createDataFrame(rows, "doc_id long, text string, pii string").withColumnRenamed("pii", "note"), field)).withColumnRenamed("pii", "spans").withColumnRenamed("note", "pii").collect()}
    assert [tuple(s) for s in out["x"].spans] == [("email", 5, 14, True), ("ip", 19, 27, True)] and out["x"].redacted == "mail [EMAIL], ip [IP]."
    assert (out["y"].spans, out["y"].redacted, out["z"].redacted) == ([], None, "")
    assert [(s.kind, two[s.start : s.stop]) for s in out["w"].spans] == [("card", "4111111111111111"), ("card", "4012888888881881"), ("email", "john (at) mail (dot) com")]
    assert out["v"].redacted.endswith("words [PHONE]") and len(out["v"].spans) == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sc.pii_spans(empty, field).collect() == [] and sc.windows_of(empty, "text", "doc_id", 10) == []
