"""Small corpora with copies, near copies, repeated passages and odd rows."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def corpus(seed=1, n=60, vocabulary=400, longest=120):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) + r.choice(["", "", ",", "É"]) for _ in range(vocabulary)]
    phrase = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passages = [phrase(r.randint(20, 60)) for _ in range(4)]
    texts = [None, "", " \n\t", "one", "two words", phrase(4), phrase(5)]
    while len(texts) < n:
        kind = r.random()
        if kind < 0.2 and len(texts) > 12:
            texts.append(r.choice(texts[7:]))
        elif kind < 0.5 and len(texts) > 12:
            w = words(r.choice(texts[7:]))
            for _ in range(r.randint(1, 3)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
            texts.append(r.choice([" ", "\n", "  "]).join(w))
        elif kind < 0.75:
            texts.append(phrase(r.randint(0, 30)) + " " + r.choice(passages) + "\n" + phrase(r.randint(0, 30)))
        elif kind < 0.8:
            texts.append(" ".join([phrase(3)] * r.randint(5, 20)))
        else:
            texts.append(phrase(r.randint(1, longest)))
    order = list(range(7, len(texts)))
    r.shuffle(order)
    texts = texts[:7] + [texts[k] for k in order]
    return [(k, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, COLUMNS).repartition(parts)
