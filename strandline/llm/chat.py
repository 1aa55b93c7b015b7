"""Chat formatting with spans found from outside: the template is a black box that renders a list of turns to a string.

Prefixes of one, two, three ... turns are rendered one after another.  Where each rendering continues the one before, what it
adds is the new turn's block.  Two renderings with probe texts in the turn's place show how much of the block is its head
and its tail; what lies between is the text.  A rendering that does not continue the one before has rewritten history:
the conversation is flagged, and its texts are located by probes within the rendering of all turns instead.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
_TURN = pa.struct([("role", pa.string()), ("block_start", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("block_stop", pa.int64())])
_OUT = pa.struct([("formatted", pa.string()), ("append_only", pa.bool_()), ("turns", pa.list_(_TURN))])
_DDL = "struct<formatted:string,append_only:boolean,turns:array<struct<role:string,block_start:long,start:long,stop:long,block_stop:long>>>"
HEAD, COLON, TAIL = "### ", ": ", " </turn>\n"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """No '#' or '<' stays without a backslash before it, so no text can hold a control string of the template."""
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("<", "\\<")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked_turns(turns: list[Turn]) -> str:
    """The default template: '### role: text </turn>' and a line end for each turn."""
    return "".join(f"{HEAD}{escape(role)}{COLON}{escape(text)}{TAIL}" for role, text in turns)


def role_of(head: str) -> str:
    """The role that a turn's head names, for marked_turns."""
    return unescape(head.removeprefix(HEAD).removesuffix(COLON))


def _between(template: Template, turns: list[Turn], k: int, whole: str) -> tuple[int, int] | None:
    """Where the text of turn k lies in the rendering `whole` of turns, from two probes."""
    one, two = (template([*turns[:k], (turns[k][0], probe), *turns[k + 1 :]]) for probe in "ab")
    if one == two:
        return None  # the rendering leaves this turn out
    head = len(os.path.commonprefix([one, two]))
    return head, len(whole) - (len(one) - head - 1)


def located(template: Template, turns: list[Turn]) -> tuple[str, bool, list[tuple[str, int, int, int, int] | None]]:
    """The rendering of all turns, whether it only ever grew, and for each turn its role and where its block and text start and stop."""
    before, spans, grows = template([]), [], True
    for k, (role, _) in enumerate(turns):
        now = template(turns[: k + 1])
        if not now.startswith(before):
            grows = False
            break
        at = _between(template, turns[: k + 1], k, now)
        spans.append(at and (role, len(before), *at, len(now)))
        before = now
    if grows:
        return before, True, spans
    whole, spans = template(turns), []
    for k, (role, _) in enumerate(turns):
        at = _between(template, turns, k, whole)
        spans.append(at and (role, at[0], *at, at[1]))
    return whole, False, spans


def format_chats(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = marked_turns) -> DataFrame:
    """One row per conv_id: conv_id, n_turns, formatted, append_only, turns (role, block_start, start, stop, block_stop).

    Offsets are code points of `formatted`; start and stop bound the turn's text as rendered, a turn that the template leaves
    out is null.  Turns are ordered by turn, role and text, nulls first; null roles and texts are empty; equal rows are
    separate turns; rows with a null conv_id are one conversation.  Other columns are ignored.  A conversation is one row in
    one task; rendering its prefixes takes time with the square of its turns.
    """
    turns = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    whole = conversations.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(turns)).alias("said"))

    @F.arrow_udf(_DDL)
    def formatted(said: pa.Array) -> pa.Array:
        out = []
        for turns in said.to_pylist():
            text, grows, spans = located(template, [(t["role"], t["text"]) for t in turns])
            out.append({"formatted": text, "append_only": grows, "turns": [s and dict(zip(_TURN.names, s, strict=True)) for s in spans]})
        return pa.array(out, _OUT)

    return whole.select("conv_id", F.size("said").cast("long").alias("n_turns"), formatted("said").alias("f")).select("conv_id", "n_turns", "f.*")


def loss_spans(turns: str = "turns", role: str = "assistant") -> F.Column:
    """Spans (start, stop) of the texts of one role: what a loss mask lets through."""
    return F.transform(F.filter(turns, lambda t: t.role == role), lambda t: F.struct(t.start.alias("start"), t.stop.alias("stop")))
