"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    """What stands before and after a turn's text, and whether the text bears loss."""

    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """Roles, the allowed moves between them, and the control strings that texts must not contain.

    A role that `roles` does not have is written as `other_open` + role + `other_mid`, bears no loss
    and is never a valid move."""

    roles: dict[str, Role] = field(
        default_factory=lambda: {
            "system": Role("<<SYS>>", "<</SYS>>"),
            "user": Role("[INST] ", " [/INST]"),
            "assistant": Role("<s>", "</s>", loss=True),
        }
    )
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    other_open: str = "<|turn|>"
    other_mid: str = "<|text|>"
    other_close: str = "<|end|>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|text|>", "<|end|>")

    def __post_init__(self):
        for mark in [m for r in self.roles.values() for m in (r.open, r.close)] + [self.other_open, self.other_mid, self.other_close]:
            if not any(c in mark for c in self.controls):
                raise ValueError(f"the mark {mark!r} holds no control string")
        for c in self.controls:
            if re.search(self._found, c[1:]):
                raise ValueError(f"the control string {c!r} holds another")

    @property
    def _found(self) -> str:
        return rf"([{re.escape(''.join(sorted({c[0] for c in self.controls})))}])(\\*)(?={'|'.join(re.escape(c[1:]) for c in self.controls)})"

    def escape(self, text: Column) -> Column:
        """Puts a backslash behind the first character of each control string, and of each one so escaped."""
        return F.regexp_replace(text, self._found, r"$1\\$2")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._found.replace(r"(\\*)", r"\\(\\*)"), "$1$2")


LLAMA = ChatTemplate()


def format_chat(conversations: DataFrame, template: ChatTemplate = LLAMA, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, first_bad (place of the first turn that the
    machine refuses, else null), segments array<struct<text string, loss boolean>>.

    Turns are ordered by turn, role and text; repeated rows stay.  A null text or role is an empty one;
    rows with a null conv_id form one conversation.  Every conversation is emitted, valid or not: the
    segments of all turns joined are its text.  A conversation is one row of the result, so its turns
    meet in one task; texts are escaped before that, where rows are still spread out.  No rows: no rows.
    """
    rows = conversations.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    lead = tail = bears = None
    for name, r in template.roles.items():
        here = F.col("role") == name
        lead = F.when(here, r.open) if lead is None else lead.when(here, r.open)
        tail = F.when(here, r.close) if tail is None else tail.when(here, r.close)
        bears = F.when(here, r.loss) if bears is None else bears.when(here, r.loss)
    parts = F.array(
        F.struct(lead.otherwise(F.concat(F.lit(template.other_open), template.escape(F.col("role")), F.lit(template.other_mid))).alias("text"), F.lit(False).alias("loss")),
        F.struct(template.escape(F.col("text")).alias("text"), bears.otherwise(F.lit(False)).alias("loss")),
        F.struct(tail.otherwise(F.lit(template.other_close)).alias("text"), F.lit(False).alias("loss")),
    )
    grouped = (
        rows.select("conv_id", F.struct("turn", "role", "text", parts.alias("parts")).alias("t"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("t")).alias("turns"))
    )
    allowed = F.create_map(*[F.lit(x) for a, bs in template.moves.items() for b in bs for x in (f"{a}>{b}", b)])

    def step(s: Column, t: Column) -> Column:
        after = F.element_at(allowed, F.concat(s["state"], F.lit(">"), t["role"]))
        bad = F.when(s["bad"].isNull() & after.isNull(), s["at"]).otherwise(s["bad"])
        return F.struct(F.coalesce(after, t["role"]).alias("state"), (s["at"] + 1).alias("at"), bad.alias("bad"))

    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))
    return grouped.withColumn("fsm", F.aggregate("turns", start, step)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.col("fsm.bad").isNull().alias("valid"),
        F.col("fsm.bad").alias("first_bad"),
        F.flatten(F.transform("turns", lambda t: t["parts"])).alias("segments"),
    )


def joined_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column, template: ChatTemplate = LLAMA) -> Column:
    """The unescaped text under the loss mask, in order, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")


def read_turns(formatted: Column, template: ChatTemplate = LLAMA) -> Column:
    """array<struct<role, text>> read back from a conversation's formatted text alone."""
    quote = lambda s: r"\Q" + s + r"\E"
    each = [(quote(r.open), quote(r.close)) for r in template.roles.values()] + [(quote(template.other_open), quote(template.other_close))]
    found = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join(f"{a}.*?{b}" for a, b in each)), F.lit(0))

    def turn(x: Column) -> Column:
        role = text = None
        for name, r in template.roles.items():
            here = x.startswith(r.open)
            body = F.substring(x, F.lit(len(r.open) + 1), F.length(x) - (len(r.open) + len(r.close)))
            role = F.when(here, name) if role is None else role.when(here, name)
            text = F.when(here, body) if text is None else text.when(here, body)
        mid = F.instr(x, template.other_mid)
        first, after = len(template.other_open) + 1, mid + len(template.other_mid)
        role = role.otherwise(template.unescape(F.substring(x, F.lit(first), mid - first)))
        text = text.otherwise(F.substring(x, after, F.length(x) - after + 1 - len(template.other_close)))
        return F.struct(role.alias("role"), template.unescape(text).alias("text"))

    return F.transform(found, turn)
