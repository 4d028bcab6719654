"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role share one block.

    <s>[ROLE]user[/ROLE]first text[TURN]second text</s><s>[ROLE]assistant[/ROLE]answer</s>

A control string inside a role or text gets a backslash after its first character; one that already has
backslashes there gets one more, so taking one away restores every text exactly. No escaped text holds a
control string, and none can arise where a text meets a mark, for every mark begins with `<` or `[` and has
neither inside.

Rows of a conversation are ordered by turn, then role, then text; repeated rows all stay. A null text or role
counts as empty, a null turn comes first, rows with a null conversation form one conversation. Other columns
are not read. An empty table gives an empty result. One conversation becomes one row, so its own length, not
the table's, decides what a task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegate.llm.tables import table

MARKS = r"(/?(?:s>|(?:ROLE|TURN|INST|SYS)\]))"
OPEN, ROLE_END, NEXT, CLOSE = "<s>[ROLE]", "[/ROLE]", "[TURN]", "</s>"
CONTROL = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + MARKS, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + MARKS, r"$1$2$3")


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, n_blocks and loss_spans (start, length in code points, from 0): where `trained_role` speaks."""
    rows = turns.select(
        "conv_id", F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def piece(t: Column, i: Column, all_turns: Column) -> Column:
        same = (i > 0) & (F.get(all_turns, i - 1)["role"] == t["role"])
        begin = F.concat(F.when(i > 0, F.lit(CLOSE)).otherwise(""), F.lit(OPEN), escape(t["role"]), F.lit(ROLE_END))
        head = F.when(same, F.lit(NEXT)).otherwise(begin)
        return F.struct(head.alias("head"), escape(t["text"]).alias("body"), (t["role"] == trained_role).alias("trained"), (~same).alias("new"))

    pieces = chats.select("conv_id", F.transform("turns", lambda t, i: piece(t, i, F.col("turns"))).alias("pieces"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, length: bigint>>)").alias("spans"))

    def add(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.char_length(p["head"])
        size = F.char_length(p["body"]).cast("long")
        span = F.array(F.struct(begin.alias("start"), size.alias("length")))
        return F.struct((begin + size).alias("at"), F.when(p["trained"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return pieces.select(
        "conv_id",
        F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), ""), F.lit(CLOSE)).alias("formatted"),
        F.size(F.filter("pieces", lambda p: p["new"])).cast("long").alias("n_blocks"),
        F.aggregate("pieces", start, add, lambda a: a["spans"]).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text), unescaped, from the formatted text alone, and loss_text, unescaped, from text and mask."""
    blocks = F.split("formatted", "</s>", -1)

    def turns(block: Column) -> Column:
        role = F.substring_index(block, ROLE_END, 1)
        body = F.substring(block, F.char_length(role) + len(ROLE_END) + 1, F.char_length(block))
        return F.transform(F.split(body, r"\[TURN\]", -1), lambda x: F.struct(unescape(F.substring(role, len(OPEN) + 1, F.char_length(role))).alias("role"), unescape(x).alias("text")))

    under = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select(
        "*", F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns)).alias("turns"), F.array_join(under, "").alias("loss_text")
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(CONTROL).alias("text"),
    )
    out = read_back(format_chats(given.unionByName(control)))
    per_turn = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(per_turn.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, coalesce(lag(role) OVER w <> role, true) AS fresh,
         length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|(?:ROLE|TURN|INST|SYS)\]))', '\1\\\2\3', 'g')) AS chars,
         length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|(?:ROLE|TURN|INST|SYS)\]))', '\1\\\2\3', 'g')) AS role_chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN fresh THEN role_chars + 20 ELSE 6 END) AS BIGINT) AS formatted_chars,
  CAST(sum(CASE WHEN fresh THEN 1 ELSE 0 END) AS BIGINT) AS n_blocks
FROM m GROUP BY conv_id
"""
