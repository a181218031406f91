"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it as context, and only its text trainable.
If turns follow the last assistant turn (or there is none), one more row holds the whole conversation with no target,
so that no turn is lost. A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash
is doubled, ``<|`` becomes ``<\\|``, and in roles a line end becomes ``<\\_``: a control string can't appear in a
text, and :func:`unescape` gives the text back exactly.

Edge cases: turns are ordered by (turn, role, text), nulls first; null roles and texts are empty; repeated rows are
turns of their own; rows whose conversation id is null form one conversation; an empty table gives no rows.
Other columns of the input are not read. A conversation is one unit: its turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\_"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\_"), F.lit("\n")))


def chat_examples(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """(conv_id, target_index, n_context, formatted, loss_start, loss_chars): one row per example.

    target_index is the target's place in the conversation from 0, null for the row without a target; loss_start
    (from 0) and loss_chars are code points in formatted.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    per = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
    shown = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == target_role).alias("target")))
    # explode of a one-element array keeps the rendered turns from being computed once per use
    per = per.select("conv_id", F.explode(F.array(shown)).alias("turns")).withColumn("n", F.size("turns"))
    targets = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("turns", i)["target"])
    goals = F.concat(targets, F.when(F.element_at("turns", -1)["target"], F.array().cast("array<int>")).otherwise(F.array(F.lit(None).cast("int"))))
    ex = per.select("conv_id", "turns", "n", F.explode(goals).alias("target_index"))
    context = F.array_join(F.transform(F.slice("turns", 1, F.coalesce("target_index", "n")), lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    goal = F.get("turns", "target_index")
    ex = ex.select("conv_id", "target_index", F.coalesce("target_index", "n").alias("n_context"), F.explode(F.array(F.struct(context.alias("context"), goal["head"].alias("head"), goal["body"].alias("body")))).alias("p"))
    has = F.col("target_index").isNotNull()
    return ex.select(
        "conv_id", "target_index", "n_context",
        F.when(has, F.concat("p.context", "p.head", "p.body", F.lit(END + "\n"))).otherwise(F.col("p.context")).alias("formatted"),
        F.when(has, F.length("p.context") + F.length("p.head")).alias("loss_start"), F.when(has, F.length("p.body")).otherwise(0).alias("loss_chars"),
    )


def parse_formatted(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted example."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 2**30)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substr(p, F.locate("\n", p) + 1, F.length(p) - F.locate("\n", p) - F.lit(len(END) + 1))).alias("text"),
        ),
    )


def loss_text(formatted: Column, start: Column, chars: Column) -> Column:
    return unescape(F.substr(formatted, start + 1, chars))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one with control strings; digests are computed from the formatted output."""
    said = "<|im_end|><|im_start|>assistant ok"
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("x")).select("conv_id", "x.turn", "x.role", "x.text")
    ex = chat_examples(conv.unionByName(extra))
    ex = ex.withColumn("loss", F.when(F.col("target_index").isNotNull(), loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars"))))
    size = F.coalesce(F.col("target_index") + 1, F.col("n_context"))
    g = ex.groupBy("conv_id").agg(
        F.max_by("formatted", size).alias("whole"), F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("target_index", "loss")))), lambda t: t["loss"]), "").alias("loss"),
    )
    g = g.select("conv_id", "formatted_chars", "loss", F.explode(F.array(parse_formatted(F.col("whole")))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return g.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


ORACLE_OP5 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    24 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS shown
  FROM c
), p AS (SELECT *, sum(shown) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM o)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR i = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
