"""Personal data in texts: plain patterns, and a semi-Markov conditional random field for what is written otherwise.

A text is parted into segments: single characters outside, and whole candidate spans of a kind.  A candidate is scored by
features of the whole span (digits, groups, separators, check digit, octets, markers such as `(at)`, the word before), so a
bounded-entity dynamic program chooses boundaries and kinds together.  Candidates are chains of digit groups, and names around an at-mark;
where a text has neither, all of it is outside, and no candidate is longer than MOST_GROUPS groups or MOST_CHARS characters.

The weights are learnt here, by the conditional likelihood of segmentations: of rows whose plain patterns are labels, and of
their words with spans in other spellings, and decoys, written in between.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MOST_GROUPS, MOST_CHARS = 20, 100

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DOT = r"(?:\x20?[\[({<]\x20?(?:dot|punkt|point|punto|\.)\x20?[\])}>]\x20?|\x20(?:dot|punkt|punto)\x20|\x20?\.(?=[A-Za-z0-9])|\x20\.\x20)"
_CHAIN = re.compile(rf"[0-9]+(?:(?:[\x20./()\[\]_ :,-]{{1,3}}|{_DOT})[0-9]+)*", re.I)
_GROUP = re.compile("[0-9]+")
_AT = re.compile(r"\x20?[\[({<]\x20?(?:at|arroba)\x20?[\])}>]\x20?|\x20(?:at|arroba)\x20|\x20?@\x20?", re.I)
_BEFORE = re.compile(rf"[A-Za-z0-9][A-Za-z0-9_%+-]*(?:{_DOT}[A-Za-z0-9][A-Za-z0-9_%+-]*)*$", re.I)
_LABEL = re.compile("[A-Za-z0-9][A-Za-z0-9-]*")
_NEXT = re.compile(f"{_DOT}(?=[A-Za-z0-9])", re.I)
_WORD = re.compile(r"([^\W\d_]+)[^\w\n]{0,3}$")


def luhn(digits: str) -> bool:
    return sum((v - 9 if v > 9 else v) if k % 2 else int(c) for k, c in enumerate(reversed(digits)) for v in [2 * int(c)]) % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the plain patterns, leftmost without overlap within a kind, by start and KINDS."""
    found = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            found.append((start, "email", m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            found.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), "card", m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), "phone", m.end()))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


@dataclass(frozen=True)
class Candidate:
    start: int
    stop: int
    numeric: bool


#: Words before a span that name its kind: fixed values.
_CUES = {
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell", "telefon", "telefono", "mobil", "appeler", "llamar", "sms", "whatsapp"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta", "kreditkarte"),
    "ip": ("ip", "host", "server", "address", "addr", "ping", "subnet", "serveur", "servidor"),
    "email": ("mail", "email", "contact", "write", "reach", "kontakt", "correo", "courriel"),
    "number": ("order", "invoice", "isbn", "id", "ref", "version", "page", "year", "article", "bestellung", "facture", "pedido", "rechnung"),
}
_CUE = {w: k for k, ws in _CUES.items() for w in ws}


def _numeric(text: str, c: Candidate) -> list[str]:
    span = text[c.start : c.stop]
    groups = _GROUP.findall(span)
    digits = "".join(groups)
    n = len(digits)
    rest = {x.strip().lower() or " " for x in _GROUP.split(span)[1:-1]}
    sizes = ",".join(str(min(len(g), 5)) for g in groups)
    marks = "".join(sorted({"w" if any(y.isalpha() for y in x) else "b" if x[:1] in "[({<" and x[-1:] in "])}>" and len(x) > 1 else x[:1] for x in rest}))
    out = [f"n{n if n <= 19 else 20}", f"marks:{marks}", f"groups{min(len(groups), 6)}", "one" if len(rest) < 2 else "many"]
    out += [f"sizes:{sizes}"] if sizes in _SIZES else ["sizes:other"]
    if len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups):
        out.append("octets")
        out.append("octets:" + ("one" if len(rest) < 2 else "many"))
    if 12 <= n <= 19:
        out.append("luhn" if luhn(digits) else "no luhn")
    out.append("head:" + (span[0] if span[0] in "+(" else "00" if digits.startswith("00") else "0" if digits[0] == "0" else "d"))
    return out


_SIZES = frozenset({"4,4,4,4", "3,3,4", "1,3,3,4", "5", "4,2,2", "2,2,4", "4,4", "2,2,2", "3,4", "4,5", "2,3,5", "4,3,5", "4,3,4", "3,2,2,2"})
_MARKED = re.compile(r"[\[({<]")


def _named(text: str, c: Candidate) -> list[str]:
    span = text[c.start : c.stop]
    at = _AT.search(span)
    host = span[at.end() :]
    dots = [m.group() for m in _NEXT.finditer(host)]
    local = span[: at.start()]
    kind = lambda s: "mark" if _MARKED.search(s) else "word" if any(ch.isalpha() for ch in s) else "bare" if s.strip() == s else "spaced"
    tail = host[_NEXT.search(host).end() :] if dots else ""
    last = _LABEL.findall(tail)[-1:] or [""]
    how = f"{kind(at.group())}/{','.join(sorted({kind(d) for d in dots}))}"
    out = [f"how:{how}", f"dots{min(len(dots), 4)}", f"tail{min(len(last[0]), 7)}", "tail:alpha" if last[0].isalpha() else "tail:mixed"]
    out += ["local:long" if len(local) > 2 else "local:short", f"locals{min(1 + len(_NEXT.findall(local)), 4)}", "tail:lower" if last[0].islower() else "tail:upper"]
    out.append("known tail" if last[0].lower() in ("com", "org", "net", "edu", "de", "fr", "es", "info", "io") else "other tail")
    more = _NEXT.match(text, c.stop)
    return [*out, "goes on" if more and _LABEL.match(text, more.end()) else "ends"]


def features(text: str, c: Candidate) -> list[str]:
    """Names of a candidate's features; the characters beside it and the word before are among them."""
    out = ["bias", *(_numeric(text, c) if c.numeric else _named(text, c))]
    left, right = text[c.start - 1 : c.start], text[c.stop : c.stop + 1]
    side = lambda x: "none" if not x or x.isspace() else "alnum" if x.isalnum() else x if x in "+-./@#$()[]_:,=" else "other"
    out += [f"left:{side(left)}", f"right:{side(right)}"]
    if right and right in ".-/,:" and text[c.stop + 1 : c.stop + 2].isalnum():
        out.append("cut short")
    if c.start > 1 and left in tuple(".-/,:") and text[c.start - 2].isalnum():
        out.append("cut in front")
    word = _WORD.search(text, max(0, c.start - 24), c.start)
    return [*out, f"cue:{_CUE.get(word.group(1).lower(), 'none') if word else 'none'}"]


def candidates(text: str) -> list[Candidate]:
    """All candidates of a text, by start and stop."""
    found: set[Candidate] = set()
    for chain in _CHAIN.finditer(text):
        if chain.end() - chain.start() < 7:
            continue
        groups = [(m.start(), m.end()) for m in _GROUP.finditer(text, *chain.span())]
        for i, (a, _) in enumerate(groups):
            heads = [a]
            if a and text[a - 1] in "+(":
                heads.append(a - 1)
                if a > 1 and text[a - 2 : a] == "+(":
                    heads.append(a - 2)
            n = 0
            for j in range(i, min(i + MOST_GROUPS, len(groups))):
                n += groups[j][1] - groups[j][0]
                stop = groups[j][1]
                if stop - a > MOST_CHARS or n > 24:
                    break
                if n >= 7 or j - i == 3:
                    found.update(Candidate(h, stop, True) for h in heads)
    for at in _AT.finditer(text):
        before = _BEFORE.search(text, max(0, at.start() - 64), at.start())
        first = _LABEL.match(text, at.end())
        if not before or not first or before.end() != at.start():
            continue
        starts = [before.start(), *(m.end() for m in _NEXT.finditer(text, before.start(), at.start()))]
        stop, stops = first.end(), []
        while len(stops) < 5 and (dot := _NEXT.match(text, stop)) and (label := _LABEL.match(text, dot.end())):
            stop = label.end()
            stops.append(stop)
        found.update(Candidate(a, z, False) for a in starts[-4:] for z in stops if z - a <= MOST_CHARS)
    return sorted(found, key=lambda c: (c.start, c.stop))


Scores = list[tuple[int, int, str, float]]


class Model:
    """Weights of (kind, feature), and of a kind by that of the span before it (row 0: none yet)."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, after: np.ndarray) -> None:
        self.names, self.weights, self.after = names, weights, after

    def scored(self, text: str, barred: list[tuple[int, int]] = ()) -> Scores:
        """(start, stop, kind, score) of each candidate of each kind it may have, but for those that touch what is barred."""
        out: Scores = []
        k, barred = 0, sorted(barred)
        for c in candidates(text):
            while k < len(barred) and barred[k][1] <= c.start:
                k += 1
            if k < len(barred) and barred[k][0] < c.stop:
                continue
            ids = [self.names[f] for f in features(text, c) if f in self.names]
            for kind in kinds_of(c):
                out.append((c.start, c.stop, kind, float(self.weights[KINDS.index(kind), ids].sum())))
        return out

    def decoded(self, scores: Scores) -> list[tuple[int, str, int]]:
        """The best segmentation's spans: over the places where candidates start or stop, with the kind of the last span as state."""
        places = sorted({p for s in scores for p in s[:2]})
        number = {p: k for k, p in enumerate(places)}
        ending: dict[int, list[int]] = {}
        for k, s in enumerate(scores):
            ending.setdefault(number[s[1]], []).append(k)
        states, after = range(len(KINDS) + 1), self.after.tolist()
        best = [[0.0] + [-np.inf] * len(KINDS)]
        back: list[list[tuple[int, int] | None]] = [[None] * len(states)]
        for j in range(1, len(places)):
            now, how = list(best[-1]), [None] * len(states)
            for k in ending.get(j, ()):
                start, _, kind, score = scores[k]
                s, before = KINDS.index(kind) + 1, best[number[start]]
                value, last = max((before[x] + after[x][s - 1], x) for x in states)
                if value + score > now[s]:
                    now[s], how[s] = value + score, (k, last)
            best.append(now)
            back.append(how)
        spans, j = [], len(places) - 1
        state = max(states, key=lambda x: best[-1][x])
        while j > 0:
            if back[j][state] is None:
                j -= 1
            else:
                k, state = back[j][state]
                spans.append((scores[k][0], scores[k][2], scores[k][1]))
                j = number[scores[k][0]]
        return spans[::-1]

    def spans(self, text: str) -> list[tuple[int, str, int, bool]]:
        """(start, kind, stop, is it a plain pattern's) of all spans, by start and KINDS."""
        base = base_spans(text)
        more = self.decoded(self.scored(text, _merged(base)))
        return sorted([*((*s, True) for s in base), *((*s, False) for s in more)], key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def kinds_of(c: Candidate) -> tuple[str, ...]:
    return ("ip", "card", "phone") if c.numeric else ("email",)


def _merged(spans: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, _, z in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


Example = tuple[str, list[tuple[int, str, int]]]


def fit(examples: list[Example], rounds: int = 40, rate: float = 0.5, ridge: float = 0.02) -> Model:
    """Conditional likelihood of the given segmentations, by AdaGrad on all examples; expectations by forward and backward sums."""
    names: dict[str, int] = {"bias": 0}
    rows, docs = [], []
    n = len(KINDS)
    given = np.zeros((n + 1, n))
    for text, truth in examples:
        here, want = [], set(truth)
        for c in candidates(text):
            ids = [names.setdefault(f, len(names)) for f in features(text, c)]
            for kind in kinds_of(c):
                here.append((len(rows), c.start, c.stop, KINDS.index(kind)))
                rows.append((KINDS.index(kind), ids, (c.start, kind, c.stop) in want))
        if here:
            number = {p: k for k, p in enumerate(sorted({p for h in here for p in h[1:3]}))}
            docs.append((len(number), sorted(((r, number[a], number[z], k) for r, a, z, k in here), key=lambda s: s[2])))
            last = 0
            for r, _, _, k in sorted((h for h in here if rows[h[0]][2]), key=lambda h: h[1]):
                given[last, k] += 1
                last = k + 1
    p = len(names)
    flat = np.array([k * p + i for k, ids, _ in rows for i in ids], np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(ids) for _, ids, _ in rows])
    truth_of = np.array([t for *_, t in rows], float)
    w, after = np.zeros(n * p), np.zeros((n + 1, n))
    seen, seen_after = np.full(n * p, 1e-8), np.full((n + 1, n), 1e-8)
    for _ in range(rounds):
        score = np.bincount(owner, w[flat], len(rows))
        mass, pairs = np.zeros(len(rows)), np.zeros((n + 1, n))
        for size, segs in docs:
            _expected(size, segs, score, after, mass, pairs)
        grad = np.bincount(flat, (truth_of - mass)[owner], n * p) - ridge * w
        seen += grad**2
        w += rate * grad / np.sqrt(seen)
        step = given - pairs - ridge * after
        seen_after += step**2
        after = after + rate * step / np.sqrt(seen_after)
    return Model(names, w.reshape(n, p), after)


def _expected(size: int, segs: list[tuple[int, int, int, int]], score: np.ndarray, after: np.ndarray, mass: np.ndarray, pairs: np.ndarray) -> None:
    """Adds the probability of each segment to mass, and of each kind after each state to pairs; segs by where they stop."""
    n = after.shape[1]
    ahead = np.full((size, n + 1), -np.inf)  # of all ways up to a place, by the last span's kind
    ahead[0, 0] = 0.0
    k = 0
    for j in range(1, size):
        ahead[j] = ahead[j - 1]
        now = ahead[j]
        while k < len(segs) and segs[k][2] == j:
            r, i, _, kind = segs[k]
            x = ahead[i] + after[:, kind]
            top = x.max()
            now[kind + 1] = np.logaddexp(now[kind + 1], top + np.log(np.exp(x - top).sum()) + score[r])
            k += 1
    top = ahead[-1].max()
    total = top + np.log(np.exp(ahead[-1] - top).sum())
    rest = np.zeros((size, n + 1))  # of all ways from a place to the end
    order = sorted(segs, key=lambda s: -s[1])
    k = 0
    for i in range(size - 2, -1, -1):
        rest[i] = rest[i + 1]
        now = rest[i]
        while k < len(order) and order[k][1] == i:
            r, _, z, kind = order[k]
            way = after[:, kind] + score[r] + rest[z, kind + 1]
            share = np.exp(ahead[i] + way - total)
            mass[r] += share.sum()
            pairs[:, kind] += share
            now[:] = np.logaddexp(now, way)
            k += 1


def _digits(r: random.Random, n: int, first: str = "123456789") -> str:
    return r.choice(first) + "".join(r.choice("0123456789") for _ in range(n - 1))


def _card(r: random.Random, good: bool = True) -> str:
    head = _digits(r, 15, "3456")
    fit_ = [d for d in "0123456789" if luhn(head + d) == good]
    return head + r.choice(fit_)


def written(r: random.Random, kind: str, word) -> str:
    """A span of a kind in some spelling that the plain patterns mostly don't know."""
    if kind == "email":
        at = r.choice([" at ", " (at) ", "(at)", " [at] ", "[at]", " @ ", " AT ", "{at}"])
        dot = r.choice([" dot ", " (dot) ", "[dot]", " [dot] ", "(dot)", " DOT ", " [.] "]) if "@" not in at and r.random() < 0.8 or at.strip().lower() == "at" else r.choice([".", " . "] if "@" in at else ["."])
        local = word() + r.choice(["", "", f".{word()}", f"{r.randint(1, 99)}", f"_{word()}", f"{dot}{word()}"])
        return f"{local}{at}{word()}{r.choice(['', str(r.randint(1, 9))])}{dot}{r.choice(['', word() + dot])}{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'edu'])}"
    if kind == "ip":
        return r.choice([" . ", "[.]", "(.)", " dot ", "[dot]", "(dot)", " [.] "]).join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        d = _card(r)
        return r.choice([".", "/", "  ", "_", " - ", " "]).join(d[k : k + 4] for k in range(0, 16, 4))
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return r.choice([f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"1 ({a}) {b}-{c}", f"0049 {a} {_digits(r, 7)}", f"0033 {a} {b} {c}", f"0{_digits(r, 3)} {_digits(r, 3)}{_digits(r, 4)}", f"0{_digits(r, 3)}/{_digits(r, 7)}", f"+({_digits(r, 2)}) {a} {c}"])


def decoy(r: random.Random, word) -> str:
    """Something with digits or an at-mark that is no personal data."""
    n = lambda k: str(r.randint(0, k))
    year = str(r.randint(1900, 2030))
    return r.choice([
        f"{n(9)}.{n(20)}.{n(9)}", f"v{n(9)}.{n(9)}.{n(99)}", f"{year}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{year}", f"{r.randint(1, 12):02d}/{r.randint(1, 28):02d}/{year}",
        f"{year}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} {r.randint(0, 23):02d}:{n(5)}{n(9)}:{n(5)}{n(9)}", f"{n(999)},{_digits(r, 3)}.{n(9)}{n(9)}", f"{n(99)}.{_digits(r, 3)},{n(9)}{n(9)}", f"{year}-{year}", f"{year}, {year}, {year}",
        _card(r, False), " ".join(_card(r, False)[k : k + 4] for k in range(0, 16, 4)), f"order {_digits(r, 8)}", f"id {_digits(r, 10)}", f"978-{n(9)}-{_digits(r, 2)}-{_digits(r, 6)}-{n(9)}", _digits(r, r.randint(5, 11)), f"0.{_digits(r, 8)}",
        " ".join(n(99) for _ in range(r.randint(3, 8))), ", ".join(n(99) for _ in range(4)), "/".join(_digits(r, 3) for _ in range(4)), f"{word()} at {word()}. {word()}", f"look at {word()}.{word()}", f"at {n(12)}.{n(59)}", f"{word()} @ {word()}", f"page {n(99)}, {n(99)}, {n(99)}",
        f"{_digits(r, 3, '3456789')} . {_digits(r, 3, '3456789')} . {n(99)} . {n(99)}", f"{_digits(r, 4)} {_digits(r, 4)}", f"{_digits(r, 6)} {_digits(r, 6)}", f"{_digits(r, 9)}{_digits(r, 9)}{_digits(r, 8)}", f"{_digits(r, 3)} {_digits(r, 3)}", f"{n(99)}:{n(99)}:{n(99)}:{n(99)}",
    ])


_CUED = {kind: tuple(w for w in _CUES[kind]) for kind in KINDS}


def examples(windows: list[str], seed: int = 11, each: int = 110) -> list[Example]:
    """Labelled rows: windows of real text with their plain spans, and their words around other spellings and decoys."""
    r = random.Random(seed)
    vocabulary = sorted({w for t in windows for w in re.findall(r"[a-zA-Z]{2,12}", t)}) or ["lorem", "ipsum", "dolor", "amet", "sit"]
    word = lambda: r.choice(vocabulary)
    name = lambda: word().lower()
    out: list[Example] = [(t, base_spans(t)) for t in windows]
    around = lambda: " ".join(word() + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(1, 5)))
    for kind in KINDS:
        for _ in range(each):
            span = written(r, kind, name)
            lead = around() + " " + (r.choice(_CUED[kind]) + r.choice([" ", ": "]) if r.random() < 0.4 else "")
            tail = r.choice([" ", ". ", ", ", "\n", "!"])
            out.append((lead + span + tail + around(), [(len(lead), kind, len(lead) + len(span))]))
    for _ in range(2 * each):  # some spans after one another, as in an address
        text, truth = around(), []
        for kind in r.sample(KINDS, r.randint(2, 3)):
            text += r.choice([" ", ", ", "\n", " | ", ". "]) + (r.choice(_CUED[kind]) + r.choice([" ", ": "]) if r.random() < 0.5 else "")
            span = written(r, kind, name)
            truth.append((len(text), kind, len(text) + len(span)))
            text += span + r.choice(["", "", " " + word()])
        out.append((text, truth))
    for _ in range(4 * each):
        text = f"{around()} {decoy(r, word)}{r.choice([' ', '. ', ', '])}{around()}"
        out.append((text, base_spans(text)))
    return out


def windows_of(docs: DataFrame, text: str, doc_id: str, max_fit_docs: int, around: int = 40, most: int = 400) -> list[str]:
    """At most `most` short pieces around digits and at-marks, of the max_fit_docs documents whose ids and texts have the least hashes."""
    some = docs.select(F.xxhash64(F.col(doc_id), F.col(text).cast("string")).alias("k"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL")
    # the hashes alone are ordered first, so that no task gets the texts
    last = some.select("k").orderBy("k").limit(max_fit_docs).agg(F.max("k").alias("k")).first()["k"]
    some = some.where(F.col("k") <= F.lit(last).cast("long"))
    piece = F.regexp_extract_all(F.col("t"), F.lit(rf"(?s)[^0-9@]{{0,{around}}}[0-9@][^\n]{{0,{around}}}"), F.lit(0))
    rows = some.select(F.explode(F.slice(piece, 1, 4)).alias("w")).orderBy(F.md5("w")).limit(most).collect()
    return [row["w"] for row in rows]


def trained(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_fit_docs: int = 4000) -> Model:
    """A model for these documents; on the same rows always the same."""
    return _trained(tuple(windows_of(docs, text, doc_id, max_fit_docs)))


@lru_cache(maxsize=4)
def _trained(windows: tuple[str, ...]) -> Model:
    return fit(examples(list(windows)))


_DDL = "array<struct<kind:string,start:int,stop:int,base:boolean>>"


def pii_spans(docs: DataFrame, model: Model, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with out, an array of (kind, start, stop, base) in code points, stop exclusive, by start and KINDS.

    base: found by a plain pattern; the others are the model's and touch none of these.  A null or empty text has none; an
    own column of the name out is replaced; rows are judged one by one, so repeated ids or rows change nothing.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())]))

    @F.arrow_udf(_DDL)
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([[{"kind": k, "start": a, "stop": z, "base": b} for a, k, z, b in model.spans(t.as_py() or "")] for t in texts], kind)

    return docs.withColumn(out, found(F.col(text).cast("string")))


def counted(spans: str, kind: str) -> Column:
    """How many plain spans of a kind."""
    return F.size(F.filter(spans, lambda s: s.base & (s.kind == kind))).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string"))), ",")


def redacted(docs: DataFrame, text: str = "text", spans: str = "pii", out: str = "redacted") -> DataFrame:
    """docs with out: the text with each run of spans replaced by [KIND] of its first one; a null text stays null."""
    parts = F.array_sort(F.col(spans), lambda a, b: a.start - b.start)
    empty = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))

    def step(done: Column, s: Column) -> Column:
        new = s.start >= done.at
        kept = F.when(new, F.concat(done.text, F.substring(F.col(text), done.at + 1, s.start - done.at), F.lit("["), F.upper(s.kind), F.lit("]"))).otherwise(done.text)
        return F.struct(kept.alias("text"), F.greatest(done.at, s.stop).alias("at"))

    finish = lambda d: F.concat(d.text, F.substring(F.col(text), d.at + 1, F.char_length(text)))
    return docs.withColumn(out, F.when(F.col(text).isNotNull(), F.aggregate(parts, empty, step, finish)))
