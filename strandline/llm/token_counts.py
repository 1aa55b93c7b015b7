"""Token counts by whole-token shortcuts.

With a byte-pair model whose pieces have a space at their front only, texts fall apart before runs of spaces into pre-tokens
that are merged independently.  A vocabulary string that the library, asked beforehand, encodes as one token counts as
one wherever it is a whole pre-token; only the other pre-tokens are merged, each distinct one once per batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_RUNS = re.compile(" *[^ ]+| +$")
#: Merged pre-tokens that a worker remembers between batches.
REMEMBERED = 200_000


def whole_tokens(processor) -> frozenset[str]:
    """Vocabulary strings that begin a pre-token and that the library encodes alone as one token.

    Raises ValueError if a piece has a space behind another character, as pre-tokens are not independent then.
    """
    names = [processor.id_to_piece(k) for k in range(processor.get_piece_size()) if not (processor.is_control(k) or processor.is_unknown(k) or processor.is_byte(k) or processor.is_unused(k))]
    if any(MARK in x.lstrip(MARK) for x in names):
        raise ValueError("pieces of this model cross spaces")
    if MARK not in names or processor.encode("") or processor.encode("a  b") != processor.encode("a") + processor.encode(" b"):
        raise ValueError("this model normalises spaces")
    alone = [x[1:] for x in names if x[0] == MARK and len(x) > 1 and MARK not in x[1:]]
    return frozenset(x for x, ids in zip(alone, processor.encode(alone), strict=True) if len(ids) == 1)


class Counter:
    """Counts tokens of texts; whole: what whole_tokens() has proved."""

    def __init__(self, processor, whole: Iterable[str]) -> None:
        self.processor = processor
        self.whole = dict.fromkeys(whole, 1)
        self.known = dict(self.whole)

    def pre_tokens(self, text: str) -> list[str]:
        """What stands after the leading space that the library adds or finds; further spaces stay in front."""
        text = text.replace(MARK, " ")
        if "  " not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ") if text else []
        return [x[1:] for x in _RUNS.findall(" " + text)] if text else []

    def counts(self, texts: list[str]) -> list[int]:
        parts = [self.pre_tokens(t) for t in texts]
        known = self.known
        new = list({w for p in parts for w in p if w not in known})
        if len(known) + len(new) > len(self.whole) + REMEMBERED:
            known = self.known = dict(self.whole)
            new = list({w for p in parts for w in p if w not in known})
        known.update(zip(new, map(len, self.processor.encode(new, num_threads=1)), strict=True))
        known[""] = 1  # a space with nothing after it
        return [sum(map(known.__getitem__, p)) for p in parts]


_counter: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", limit: int = 4096, batch: int = 256) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    model: path of a sentencepiece byte-pair model, found at the same path on every executor.  Tokens are those that
    the library gives for the whole text, without begin or end.  Null and empty texts have none; repeated rows stay;
    other columns are ignored.
    """
    import sentencepiece

    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(sentencepiece.SentencePieceProcessor(model_file=model)))

    @F.arrow_udf("long")
    def tokens(column: pa.Array) -> pa.Array:
        if model not in _counter:
            _counter[model] = Counter(sentencepiece.SentencePieceProcessor(model_file=model), whole.value)
        texts = column.to_pylist()
        out: list[int] = []
        for k in range(0, len(texts), batch):
            out += _counter[model].counts([t or "" for t in texts[k : k + batch]])
        return pa.array(out, pa.int64())

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    out = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), tokens("text").alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
