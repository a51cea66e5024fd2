"""Chat formatting whose output is parsed again and compared with its source. DataFrame operations only.

Template, per turn: ``<|turn|>`` role ``<|text|>`` text ``<|end|>``. A turn whose role or text holds something that the
parser would take for a marker is written as ``<|turn:e|>`` with both escaped: ``<|`` becomes ``<\\|`` and each backslash
right after ``<`` is doubled beforehand, so unescaping is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed markers of the template.
TURN, ESCAPED, TEXT, END = "<|turn|>", "<|turn:e|>", "<|text|>", "<|end|>"


def escape(text: Column) -> Column:
    """No ``<|`` is left: ``<`` with n backslashes and then ``|`` gets one more; every other text is untouched."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def render_turn(turn: Column, escaped: Column) -> Column:
    role, text = turn["role"], turn["text"]
    return F.concat(
        F.when(escaped, F.lit(ESCAPED)).otherwise(F.lit(TURN)), F.when(escaped, escape(role)).otherwise(role), F.lit(TEXT),
        F.when(escaped, escape(text)).otherwise(text), F.lit(END),
    )


def parse(rendered: Column) -> Column:
    """Turns of a rendered conversation, left to right: everything up to ``<|end|>`` is a turn, its first
    ``<|text|>`` ends the role, and the opening marker tells whether both are escaped."""
    pieces = F.split(rendered, r"<\|end\|>", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        escaped = piece.startswith(ESCAPED)
        body = F.when(escaped, F.substr(piece, F.lit(len(ESCAPED) + 1))).otherwise(F.substr(piece, F.lit(len(TURN) + 1)))
        at = F.instr(body, TEXT)
        role = F.when(at > 0, F.substr(body, F.lit(1), at - 1)).otherwise(body)
        text = F.when(at > 0, F.substr(body, at + len(TEXT))).otherwise(F.lit(""))
        return F.struct(F.when(escaped, unescape(role)).otherwise(role).alias("role"), F.when(escaped, unescape(text)).otherwise(text).alias("text"))

    return F.transform(pieces, turn)


def joined(turns: Column, escaped: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: render_turn(t, escaped)), "")


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv, ``formatted``, and ``turns``, which are parsed back from ``formatted``.

    Turns go by number; equal numbers by role, then text (nulls first). A null role or text is an empty one, rows with
    a null conversation form one conversation. Empty tables give no row; other columns are not looked at. A turn is
    rendered plainly when parsing that rendering alone gives the turn back, else escaped; the whole conversation is
    parsed again then, and if it still differed from its source all of it would be escaped. A conversation is one row
    of output, so it is gathered whole; there is no other gathering.
    """
    fields = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = df.groupBy(F.col(conv).alias(conv)).agg(F.sort_array(F.collect_list(fields)).alias("source"))
    grouped = grouped.withColumn("source", F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))

    def checked(t: Column) -> Column:
        return render_turn(t, parse(render_turn(t, F.lit(False))) != F.array(t))

    first = grouped.withColumn("formatted", F.array_join(F.transform("source", checked), ""))
    second = first.withColumn("formatted", F.when(parse(F.col("formatted")) == F.col("source"), F.col("formatted")).otherwise(joined(F.col("source"), F.lit(True))))
    return second.select(conv, "formatted", parse(F.col("formatted")).alias("turns"))


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """The text that the loss mask covers: every text of ``role``, in order, with nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")


def turns_text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
