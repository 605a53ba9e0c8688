"""Chat formatting: a finite-state machine over roles, and a declarative template that emits segments with loss flags.

A template is data: the mark every control string begins with, the control strings, the roles under the loss, and the machine's
transitions. Texts and roles are escaped, so the mark occurs in the output only where a control string stands, and ``read_back`` recovers
every turn from the formatted string alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .base import query, table


@dataclass(frozen=True)
class Template:
    """Control strings all begin with ``mark`` and hold it once; ``escape`` is one character that is not in the mark."""

    mark: str = "<|"
    turn: str = "<|turn|>"
    body: str = "<|body|>"
    end: str = "<|end|>\n"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: state -> role -> next state; a role that is not listed leads to "invalid"
    transitions: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    })
    accept: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        controls = (self.turn, self.body, self.end)
        if any(not c.startswith(self.mark) or c.count(self.mark) != 1 for c in controls) or len({*controls}) < 3:
            raise ValueError("each control string must begin with the mark, hold it once, and differ from the others")
        if len(self.escape) != 1 or self.escape in self.mark or len(self.mark) < 2:
            raise ValueError("the escape must be one character outside the mark, and the mark two characters or more")


def _escape(c: Column, t: Template) -> Column:
    doubled = F.replace(c, F.lit(t.escape), F.lit(t.escape * 2))
    return F.replace(doubled, F.lit(t.mark), F.lit(t.mark[0] + t.escape + t.mark[1:]))


def _unescape(c: Column, t: Template) -> Column:
    return F.regexp_replace(c, r"(?s)\Q" + t.escape + r"\E(.)", "$1")


def _state(turns: Column, t: Template) -> Column:
    """Run the machine over the roles in order."""
    table_of = F.create_map(*[F.lit(x) for a, row in t.transitions.items() for role, b in row.items() for x in (f"{a}>{role}", b)])
    return F.aggregate(turns, F.lit(t.start), lambda state, turn: F.coalesce(
        F.element_at(table_of, F.concat(state, F.lit(">"), turn["role"])), F.lit("invalid")))


def format_chats(rows: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: the id, ``segments`` (text, loss), ``formatted`` (the segments joined), ``valid`` and ``state``.

    The machine judges the order of the roles; invalid conversations are formatted too, and flagged.

    * Null text or role: empty. Turns go by number, null first; ties by role, then text. Repeated rows are turns of their own.
    * A null conversation id is one conversation. An empty table gives an empty table.
    * A conversation becomes one row, as the format asks; its turns meet in one task.
    """
    t = template
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chats = rows.select(F.col(conv_col).alias("_conv"), turn.alias("_turn")).groupBy("_conv").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))

    def emit(x: Column) -> Column:
        def segment(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            segment(F.concat(F.lit(t.turn), _escape(x["role"], t), F.lit(t.body)), F.lit(False)),
            segment(_escape(x["text"], t), x["role"].isin(*t.loss_roles)),
            segment(F.lit(t.end), F.lit(False)))

    chats = chats.select("_conv", _state(F.col("_turns"), t).alias("state"), F.flatten(F.transform("_turns", emit)).alias("segments"))
    return chats.select(F.col("_conv").alias(conv_col), "segments",
                        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                        F.col("state").isin(*t.accept).alias("valid"), "state")


def read_back(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """Recover ``turns`` (role, text) from ``formatted`` alone, and ``loss_text``, the unescaped text under the loss flags."""
    t = template
    # the mark is never inside escaped text, so cutting at control strings cannot cut a text
    parts = F.split("formatted", r"\Q" + t.end + r"\E", -1)
    parts = F.filter(parts, lambda p: F.startswith(p, F.lit(t.turn)))

    def turn(p: Column) -> Column:
        inner = F.substr(p, F.lit(len(t.turn) + 1))
        head = F.substring_index(inner, t.body, 1)
        return F.struct(_unescape(head, t).alias("role"),
                        _unescape(F.substr(inner, F.char_length(head) + len(t.body) + 1), t).alias("text"))

    under = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: _unescape(s["text"], t))
    return chats.withColumn("turns", F.transform(parts, turn)).withColumn("loss_text", F.array_join(under, ""))


CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query("op10_chat_formatting", r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(role, '\', '\\'), '<|', '<\|') AS er, replace(replace(text, '\', '\\'), '<|', '<\|') AS et FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|turn|>') + length(er) + length('<|body|>') + length(et) + length('<|end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""")
def op10_chat_formatting(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    ok = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                               F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    chats = read_back(format_chats(rows.unionByName(ok)))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return chats.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                        F.char_length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                        F.char_length("formatted").cast("bigint").alias("formatted_chars"))
