"""Chat formatting with Spark expressions only.

A formatted conversation is a row of blocks ``<turn:ROLE>TEXT<next>TEXT</turn>`` + newline. Adjacent turns of one role share
a block, their texts divided by ``<next>``. In roles and texts ``\\``, ``<`` and ``>`` are written ``\\b``, ``\\l`` and
``\\g``, so every ``<`` in the output is a mark of the template and reading back is exact.

Defined cases: a null text or role is empty; a null conv_id is a conversation of its own; null turns come first; rows that tie
in turn are ordered by role, then text; repeated rows stay; an empty table gives no rows; other columns are not read.
A conversation is one output row, so its text has to fit one row (2 GB in Spark).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROBE = "\\### Assistant: </turn> ok"


def escape(x: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        x = F.replace(x, F.lit(plain), F.lit(code))
    return x


def unescape(x: Column) -> Column:
    for plain, code in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        x = F.replace(x, F.lit(code), F.lit(plain))
    return x


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: array of (start, length) in code points of formatted, one for each text of loss_role."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # Where a block begins, then each block as its role and its texts.
    starts = F.filter(F.sequence(F.lit(1), F.size("ts")), lambda i: (i == 1) | (F.element_at("ts", i)["role"] != F.element_at("ts", F.greatest(i - 1, F.lit(1)))["role"]))
    cut = lists.select("conv_id", "ts", starts.alias("starts"))
    spans = F.zip_with("starts", F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("ts") + 1)), lambda a, b: F.struct(a.alias("a"), (b - a).alias("n")))
    blocks = F.transform(
        spans, lambda s: F.struct(F.element_at("ts", s["a"])["role"].alias("role"), F.transform(F.slice(F.col("ts"), s["a"], s["n"]), lambda t: escape(t["text"])).alias("texts"))
    )
    merged = cut.select("conv_id", blocks.alias("blocks"))
    head = lambda b: F.concat(F.lit("<turn:"), escape(b["role"]), F.lit(">"))
    text = F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], "<next>"), F.lit("</turn>\n"))), "")
    empty = F.expr("cast(array() as array<struct<start:int,length:int>>)")
    step = lambda at, out: F.struct(at.alias("at"), out.alias("out"))

    def one_block(acc: Column, b: Column) -> Column:
        inner = F.aggregate(
            b["texts"],
            step(acc["at"] + F.length(head(b)), acc["out"]),
            lambda a, t: step(
                a["at"] + F.length(t) + F.length(F.lit("<next>")),
                F.when(b["role"] == loss_role, F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), F.length(t).alias("length"))))).otherwise(a["out"]),
            ),
        )
        # The last text is followed by the closing mark instead of <next>.
        return step(inner["at"] - len("<next>") + len("</turn>\n"), inner["out"])

    spans = F.aggregate("blocks", step(F.lit(0), empty), one_block, lambda a: a["out"])
    return merged.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns (array of role and text) and loss_text, taken from the formatted string and the spans alone."""
    parts = F.filter(F.split("formatted", "</turn>\n", -1), lambda x: x != "")
    role = lambda b: unescape(F.substring_index(F.substring_index(b, ">", 1), "<turn:", -1))
    body = lambda b: F.substring(b, F.instr(b, F.lit(">")) + 1, F.length(b))
    turns = F.flatten(F.transform(parts, lambda b: F.transform(F.split(body(b), "<next>", -1), lambda t: F.struct(role(b).alias("role"), unescape(t).alias("text")))))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.withColumns({"turns": turns, "loss_text": loss})


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    back = read_back(format_chats(chats.unionByName(probe)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The formatted length follows from the template: 6 + role + 1 before a block, 8 after it, 6 between its texts, and a code of two for each escaped character.
OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), w AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    length(text) + length(regexp_replace(text, '[^\\<>]', '', 'g')) AS chars,
    length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) AS role_chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN before = role THEN 6 ELSE 15 + role_chars END) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""
