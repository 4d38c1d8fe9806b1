"""Chat formatting from a declarative template, with DataFrame functions only.

A template names the texts around each turn, which roles are under the loss, and the transitions that
a valid conversation takes. Inside texts and roles every character that can begin a control string
is replaced by a two-character escape, so a control string in the output is always the template's.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelseq.llm.common import narrow

#: Escapes in the order in which they are applied; they are undone in reverse.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\n"))


@dataclass(frozen=True)
class Template:
    """Texts before the role, between role and text, and after the text; the first and last hold ``#`` or ``<``."""

    open: str = "### "
    head: str = "\n"
    close: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: state -> role -> next state; a turn without an entry makes the conversation invalid.
    transitions: dict = field(default_factory=lambda: {
        "start": {"system": "ready", "user": "asked"},
        "ready": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })
    final: tuple[str, ...] = ("answered",)


def escape(c: Column, pairs=ESCAPES) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column, pairs=ESCAPES) -> Column:
    for a, b in reversed(pairs):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, formatted, segments, valid, stopped_at): one row for each conversation.

    ``segments`` holds struct(text, loss) in order; joined they are ``formatted``. Only the text of a
    turn whose role is under the loss has the flag. Turns are ordered by turn, role and text, so
    repeated turns stay and ties are fixed; null roles and texts count as empty, a null turn comes
    first, a null conv_id is a conversation of its own. ``valid`` says that the role order is
    accepted; ``stopped_at`` is the first turn (from 0) that the machine refuses, or else null.
    Nothing is left out: invalid conversations are formatted too. A conversation's text is one value, so
    its size is bounded by what one row may hold.
    """
    t = template or Template()
    if not any(c in t.open for c in "<#") or not any(c in t.close for c in "<#"):
        raise ValueError("the marks around a turn must hold an escaped character")
    if "" in {t.start, *t.final, *t.transitions, *(n for row in t.transitions.values() for n in row.values())}:
        raise ValueError("a state must have a name")
    rows = narrow(turns, "conv_id", "turn", "role", "text").select("conv_id", F.struct("turn", _text("role").alias("role"), _text("text").alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # The machine: its state and the number of turns it has accepted; a refused turn leads to the empty state for good.
    table = F.create_map(*[F.lit(x) for s, row in t.transitions.items() for r, n in row.items() for x in (f"{s}\x00{r}", n)])
    start = F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("n"))

    def step(acc, turn):
        to = F.coalesce(F.try_element_at(table, F.concat(acc["state"], F.lit("\x00"), turn["role"])), F.lit(""))
        return F.struct(to.alias("state"), (acc["n"] + F.when(to == "", 0).otherwise(1)).alias("n"))

    chats = chats.withColumn("end", F.aggregate("turns", start, step))
    loss = [F.lit(r) for r in t.loss_roles]
    segments = F.flatten(F.transform("turns", lambda x: F.array(
        F.struct(F.concat(F.lit(t.open), escape(x["role"], ROLE_ESCAPES), F.lit(t.head)).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(x["text"]).alias("text"), x["role"].isin(*loss).alias("loss")),
        F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")))))
    chats = chats.withColumn("segments", segments)
    return chats.select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments",
        F.col("end.state").isin(*t.final).alias("valid"), F.when(F.col("end.state") == "", F.col("end.n")).alias("stopped_at"))


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """array<struct<role, text>> read from a formatted conversation."""
    t = template or Template()
    blocks = F.split(formatted, _literal(t.close), -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turn(block):
        body = F.substr(block, F.lit(len(t.open) + 1))
        cut_at = F.instr(body, t.head)
        return F.struct(
            unescape(F.substr(body, F.lit(1), cut_at - 1), ROLE_ESCAPES).alias("role"),
            unescape(F.substr(body, cut_at + len(t.head))).alias("text"))

    return F.transform(blocks, turn)


def _literal(s: str) -> str:
    return "\\Q" + s + "\\E"


def loss_text(segments: Column) -> Column:
    """All text under the loss, unescaped and joined."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
