"""Chat formatting from a declarative template (operator 4), DataFrame functions only.

A template names the marks around a turn, the characters that are escaped
inside texts and role names, the roles whose texts carry loss, and the moves of a
finite-state machine over roles.  A conversation becomes one row: its text
segments in order, each with a loss flag, the whole text, and whether the roles
kept the allowed order.  Marks hold an escaped character each, so no text can
contain one; ``read_back`` splits the whole text at the marks and unescapes.

Defined cases: a null text or role counts as empty; turns are ordered by (turn,
role, text), nulls first, so ties and repeated rows have one order and repeated
rows are kept; a null conv_id is one conversation of its own; a role outside the
template has no loss and breaks the order.  One conversation is one text, so it
is gathered in one row by definition of the output.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    before_role: str = "<turn "
    after_role: str = ">\n"
    after_text: str = "</turn>\n"
    # in this order when escaping, in reverse when reading back; the first one escapes the escapes
    escapes: tuple[tuple[str, str], ...] = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    })

    def __post_init__(self) -> None:
        for mark in (self.before_role, self.after_role, self.after_text):
            if not any(a in mark for a, _ in self.escapes):
                raise ValueError(f"{mark!r} could occur in a text: it holds no escaped character")
        lead = self.escapes[0][0]
        if any(not b.startswith(lead) for _, b in self.escapes) or any(a in b for _, b in self.escapes[1:] for a, _ in self.escapes[1:]):
            raise ValueError("every replacement must begin with the character that is escaped first, and hold no other one")


TEMPLATE = Template()


def _escaped(c: Column, t: Template) -> Column:
    for a, b in t.escapes:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _unescaped(c: Column, t: Template) -> Column:
    for a, b in reversed(t.escapes):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def _end_state(turns: Column, t: Template) -> Column:
    """The state that the roles lead to; null once a move is not allowed."""
    moves = F.create_map(*[x for a, m in t.moves.items() for r, b in m.items()
                           for x in (F.struct(F.lit(a).alias("state"), F.lit(r).alias("role")), F.lit(b))])
    return F.aggregate(turns, F.lit(t.start), lambda state, x: F.try_element_at(
        moves, F.struct(state.alias("state"), x["role"].alias("role"))))


def format_conversations(df: DataFrame, template: Template = TEMPLATE, conv: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_turns, end_state, valid, segments array<struct<text, loss>>, formatted)."""
    t = template
    empty = F.lit("")
    grouped = df.select(
        F.col(f"`{conv}`").alias("conv_id"),
        F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), empty).alias("role"),
                 F.coalesce(F.col(f"`{text}`").cast("string"), empty).alias("text")).alias("t"),
    ).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda x: F.array(
        F.struct(F.concat(F.lit(t.before_role), _escaped(x["role"], t), F.lit(t.after_role)).alias("text"),
                 F.lit(False).alias("loss")),
        F.struct(_escaped(x["text"], t).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
        F.struct(F.lit(t.after_text).alias("text"), F.lit(False).alias("loss")))))
    done = grouped.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                          _end_state(F.col("turns"), t).alias("end_state"), segments.alias("segments"))
    return done.select(
        "conv_id", "n_turns", "end_state", F.coalesce(F.col("end_state").isin(*t.accept), F.lit(False)).alias("valid"),
        "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(df: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """``df`` with ``turns`` (role and text, from ``formatted``) and ``loss_text`` (the text under the loss flags)."""
    t = template
    parts = F.split(F.col("formatted"), r"\Q" + t.after_text + r"\E")
    body = F.slice(parts, 1, F.size(parts) - 1)     # nothing follows the last mark

    def turn(p: Column) -> Column:
        at = F.position(F.lit(t.after_role), p)
        role = F.substring(p, F.lit(len(t.before_role) + 1), at - len(t.before_role) - 1)
        text = F.substring(p, at + len(t.after_role), F.length(p))
        return F.struct(_unescaped(role, t).alias("role"), _unescaped(text, t).alias("text"))

    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: _unescaped(s["text"], t))
    return df.withColumns({"turns": F.transform(body, turn), "loss_text": F.array_join(loss, "")})


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")).alias("role"),
        F.lit(r"\### Assistant: </turn> ok").alias("text"))
    done = read_back(format_conversations(given.unionByName(probe)))
    plain = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(plain.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")


OP4_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), numbered AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS prev, lead(role) OVER w AS next FROM given
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), marked AS (
  SELECT *, length(role) + length(text) + 4 * (length(role) - length(replace(role, '&', '')) + length(text) - length(replace(text, '&', '')))
      + 3 * (length(role) - length(replace(replace(role, '<', ''), '>', '')) + length(text) - length(replace(replace(text, '<', ''), '>', '')))
      + 16 AS chars,
    CASE WHEN prev IS NULL THEN role IN ('system', 'user') WHEN prev IN ('system', 'assistant') THEN role = 'user'
         WHEN prev = 'user' THEN role = 'assistant' ELSE false END AND (next IS NOT NULL OR role = 'assistant') AS fits
  FROM numbered
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, bool_and(fits) AS valid
FROM marked GROUP BY conv_id
"""
