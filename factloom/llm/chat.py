"""Chat formatting (8, native): prefix-target expansion with a reversible template.

Every assistant turn becomes an example of its own: all turns before it are context, and only that
reply is trainable. A conversation whose last turn is no reply gives one more example without a target,
so that no turn is lost. Only DataFrame functions are used.

A turn is written <|role|>text</s>. Inside roles and texts a backslash becomes \\b, and the first
character of a control string becomes \\l (<), \\i ([) or \\p (|); undoing these three, then \\b, gives
the text back.

Null texts and roles are empty; turns are ordered by turn, then role, then text, so ties and repeated
rows have one order; an empty table gives no examples; other columns are ignored, whatever their names.
A conversation is formatted in one row, as its digest needs; expansion writes each prefix anew, so its
output grows with the square of a conversation's turns: that is the format, not a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import load

#: Control strings and what stands for their first character.
CONTROLS = ("</s>", "<s>", "<|", "[INST]", "[/INST]", "|>")
CODES = {"<": "\\l", "[": "\\i", "|": "\\p"}
END = "</s>"
REPLY = "assistant"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\b"))
    for control in CONTROLS:
        c = F.replace(c, F.lit(control), F.lit(CODES[control[0]] + control[1:]))
    return c


def unescape(c: Column) -> Column:
    for char, code in CODES.items():
        c = F.replace(c, F.lit(code), F.lit(char))
    return F.replace(c, F.lit("\\b"), F.lit("\\"))


def expand_prefix_targets(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows conv_id, example (number of context turns), prefix, target (null in an example without one)."""
    rows = df.select(
        F.col(f"`{key}`").alias("conv_id"),
        F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    written = turns.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"] == REPLY).alias("reply"),
        F.transform("turns", lambda t: F.concat(F.lit("<|"), escape(t["role"]), F.lit("|>"), escape(t["text"]), F.lit(END))).alias("lines"),
    )
    last = F.size("lines")
    picked = F.filter(F.sequence(F.lit(1), last), lambda i: (i == last) | F.element_at("reply", i))
    each = written.select("conv_id", "lines", "reply", F.explode(picked).alias("i"))
    own = F.element_at("reply", F.col("i"))
    return each.select(
        "conv_id",
        F.when(own, F.col("i") - 1).otherwise(F.col("i")).cast("long").alias("example"),
        F.array_join(F.slice("lines", F.lit(1), F.when(own, F.col("i") - 1).otherwise(F.col("i"))), "").alias("prefix"),
        F.when(own, F.element_at("lines", F.col("i"))).alias("target"),
    )


def parse_turns(c: Column) -> Column:
    """The turns (role, text) of a formatted string, unescaped."""
    pieces = F.filter(F.split(c, F.lit(END), F.lit(-1)), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(3)), "|>", 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, F.lit("|>")) + 2)).alias("text"),
        ),
    )


def digest(examples: DataFrame) -> DataFrame:
    """Read back from the examples, per conversation: its turns, the text under the loss mask, and the size of all."""
    whole = F.concat(F.col("prefix"), F.coalesce(F.col("target"), F.lit("")))
    own = examples.select("conv_id", "example", "target", whole.alias("whole"))
    by = own.groupBy("conv_id").agg(
        F.max_by("whole", F.struct("example", F.col("target").isNull())).alias("whole"),
        F.sort_array(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("example", "target")))).alias("targets"),
        F.sum(F.length("whole")).alias("formatted_chars"),
    )
    read = by.select(
        "conv_id",
        "formatted_chars",
        parse_turns(F.col("whole")).alias("turns"),
        F.array_join(F.flatten(F.transform("targets", lambda t: F.transform(parse_turns(t["target"]), lambda x: x["text"]))), "").alias("loss"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long"),
    )


def op8_chat_formatting(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    control = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(REPLY).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digest(expand_prefix_targets(rows.unionByName(control)))


_ESCAPED = "replace(replace(replace(replace(replace(replace(replace({}, '\\', '\\b'), '</s>', '\\l/s>'), '<s>', '\\ls>'), '<|', '\\l|'), '[INST]', '\\iINST]'), '[/INST]', '\\i/INST]'), '|>', '\\p>')"
ORACLE = f"""
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (
  SELECT *, 8 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('txt')}) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, txt) AS i, count(*) OVER (PARTITION BY conv_id) AS k FROM c),
s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM n)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || txt || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(txt)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(txt, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = 'assistant' OR i = k) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
