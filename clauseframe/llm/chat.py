"""Chat formatting with Spark expressions only: conversations to training strings with a loss mask, and back.

Turns are collected as structs and sorted, adjacent turns of one role are merged to one block, and blocks are
concatenated. The template marks blocks by control strings and turns inside a block by a separator, so the string
can be read back turn by turn. Control strings that occur inside a text get a backslash behind their first
character (and one more if they already have some), which is undone on reading; all other text stays as it is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Strings around a block. Each begins or ends with a control string, and no control string holds another's first
    character behind its own first one. Roles other than the two named ones are written out."""

    begin: str = "<s>"
    user_open: str = "[INST] "
    user_close: str = " [/INST]"
    assistant_open: str = "[OUT] "
    assistant_close: str = "</s>"
    role_open: str = "[ROLE] "
    role_body: str = " [BODY] "
    role_close: str = " [/ROLE]"
    turn: str = "[TURN]"

    @property
    def controls(self) -> list[str]:
        return sorted({x.strip() for x in vars(self).values()})

    @property
    def guard(self) -> str:
        """Regular expression of a control string with any number of backslashes behind its first character."""
        firsts = "".join(sorted({re.escape(c[0]) for c in self.controls}))
        rests = "|".join(re.escape(c[1:]) for c in self.controls)
        return rf"([{firsts}])(\\*)((?:{rests}))"


LLAMA = Template()


def escape(text: Column, t: Template = LLAMA) -> Column:
    return F.regexp_replace(text, t.guard, r"$1\\$2$3")


def unescape(text: Column, t: Template = LLAMA) -> Column:
    return F.regexp_replace(text, t.guard.replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")


def format_conversations(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", t: Template = LLAMA
) -> DataFrame:
    """One row a conversation: the conversation's key, ``formatted``, ``segments`` (text, loss) that make it up.

    ``segments`` is the loss mask: ``loss`` is true for the texts of assistant turns and nothing else.

    Defined cases: a null text counts as empty, a null role as an empty name; turns with equal numbers are ordered by
    role, then text, null turn numbers first; rows with a null conversation form one conversation; repeated rows are
    turns of their own; an empty table gives an empty result; other columns are not read. A conversation becomes one
    string, so its length is bounded by what Spark holds in a row (2 GB).
    """
    turns = df.groupBy(F.col(f"`{conv_col}`").alias("__conv")).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
                    F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
                )
            )
        ).alias("turns")
    )

    def merged(turns: Column) -> Column:
        """Blocks of adjacent turns of one role: where blocks start, then a slice of turns for each start."""
        starts = F.filter(
            F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.element_at(turns, i + 1)["role"] != F.element_at(turns, F.greatest(i, F.lit(1)))["role"])
        )
        return _let(starts, lambda s: F.transform(s, lambda start, j: _block(turns, start, F.coalesce(F.get(s, j + 1), F.size(turns)))))

    def _block(turns: Column, start: Column, end: Column) -> Column:
        return F.struct(
            F.element_at(turns, start + 1)["role"].alias("role"),
            F.transform(F.slice(turns, start + 1, end - start), lambda x: escape(x["text"], t)).alias("texts"),
        )

    def segments(block: Column) -> Column:
        role = block["role"]
        opened = F.when(role == "user", F.lit(t.user_open)).when(role == "assistant", F.lit(t.assistant_open)).otherwise(F.concat(F.lit(t.role_open), escape(role, t), F.lit(t.role_body)))
        closed = F.when(role == "user", F.lit(t.user_close)).when(role == "assistant", F.lit(t.assistant_close)).otherwise(F.lit(t.role_close))
        plain = lambda x: F.struct(x.alias("text"), F.lit(False).alias("loss"))
        texts = F.flatten(
            F.transform(
                block["texts"],
                lambda x, i: F.when(i == 0, F.array(F.struct(x.alias("text"), (role == "assistant").alias("loss")))).otherwise(
                    F.array(plain(F.lit(t.turn)), F.struct(x.alias("text"), (role == "assistant").alias("loss")))
                ),
            )
        )
        return F.concat(F.array(plain(opened)), texts, F.array(plain(closed)))

    made = turns.select(
        "__conv",
        _let(F.col("turns"), lambda x: F.concat(F.array(F.struct(F.lit(t.begin).alias("text"), F.lit(False).alias("loss"))), F.flatten(F.transform(merged(x), segments)))).alias("segments"),
    )
    return made.select(F.col("__conv").alias(conv_col), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column, t: Template = LLAMA) -> Column:
    """The turns (role, text) of a formatted conversation, from its string alone."""
    e = re.escape
    pattern = (
        f"(?s){e(t.user_open)}(.*?){e(t.user_close)}|{e(t.assistant_open)}(.*?){e(t.assistant_close)}|{e(t.role_open)}(.*?){e(t.role_body)}(.*?){e(t.role_close)}"
    )
    blocks = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0))

    def turns(block: Column) -> Column:
        user, assistant = F.startswith(block, F.lit(t.user_open)), F.startswith(block, F.lit(t.assistant_open))
        inner = lambda opened, closed: F.substring(block, F.lit(len(opened) + 1), F.length(block) - len(opened) - len(closed))
        named = inner(t.role_open, t.role_close)
        cut = F.instr(named, t.role_body)
        role = F.when(user, F.lit("user")).when(assistant, F.lit("assistant")).otherwise(unescape(F.substring(named, F.lit(1), cut - 1), t))
        body = (
            F.when(user, inner(t.user_open, t.user_close))
            .when(assistant, inner(t.assistant_open, t.assistant_close))
            .otherwise(F.substring(named, cut + len(t.role_body), F.length(named)))
        )
        return F.transform(F.split(body, re.escape(t.turn)), lambda x: F.struct(role.alias("role"), unescape(x, t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column, t: Template = LLAMA) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
