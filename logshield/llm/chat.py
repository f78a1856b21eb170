"""Chat formatting with prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and its
text alone trainable. Turns are marked by control strings; the same strings inside texts and
roles are escaped, and unescaping gives the text back exactly.

An example holds its whole context by definition, so a conversation's turns meet in one row;
the rows that leave it are made one by one from that row, without a second shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """No control string occurs in the result: `\\` becomes `\\\\`, then `<|` becomes `<\\|`."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escaped_role(role: Column) -> Column:
    """As escaped; a line end, which would end the header, becomes `\\n`."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    """Between escaped backslashes, which come in pairs, a lone one marks a line end or a bar."""
    between = F.split(role, r"\\\\")
    return F.array_join(F.transform(between, lambda t: F.replace(F.replace(t, F.lit("\\n"), F.lit("\n")), F.lit("\\"), F.lit(""))), "\\")


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, target, formatted, loss_start, loss_chars, final) from turns(conv_id,
    turn, role, text). loss_start counts characters before the trainable text.

    `target` tells the examples of assistant turns from the row, at most one a conversation, that
    holds the turns after the last assistant turn, with nothing trainable, so that the output
    holds every turn. `final` marks the longest example and that row: read together they give the
    conversation. Defined cases: a null text or role is empty; turns are ordered by turn (null
    first), then role and text; repeated rows are turns of their own; a null conv_id is a
    conversation; very long texts stay whole; other columns are ignored; an empty table gives no
    rows."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), escaped_role(role), F.lit("\n"))
    got = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text"), head.alias("head"), escaped(text).alias("body")).alias("t"))
    got = got.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    pieces = F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n")))
    at = F.filter(F.transform("t", lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
    got = got.withColumn("pieces", pieces).withColumn("at", at)
    got = got.withColumn("last", F.coalesce(F.element_at("at", F.when(F.size("at") > 0, F.lit(-1)).otherwise(F.lit(None).cast("int"))), F.lit(-1)))
    rest = F.when(F.col("last") + 1 < F.size("t"), F.array(F.lit(None).cast("int"))).otherwise(F.array().cast("array<int>"))
    got = got.select("conv_id", "t", "pieces", "last", F.posexplode_outer(F.concat("at", rest)).alias("example", "i"))
    target = F.col("i").isNotNull()
    turn = F.get("t", F.col("i"))
    context = F.array_join(F.slice("pieces", F.lit(1), F.col("i")), "")
    after = F.array_join(F.slice("pieces", F.col("last") + 2, F.size("pieces")), "")
    return got.select(
        "conv_id", "example", target.alias("target"),
        F.when(target, F.concat(context, F.get("pieces", F.col("i")))).otherwise(after).alias("formatted"),
        F.when(target, F.char_length(context) + F.char_length(turn["head"])).otherwise(0).alias("loss_start"),
        F.when(target, F.char_length(turn["body"])).otherwise(0).alias("loss_chars"),
        (~target | (F.col("i") == F.col("last"))).alias("final"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted string, by its control strings alone."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")

    def turn(part: Column) -> Column:
        # The header ends at the first line end.
        at = F.locate("\n", part)
        role = F.substring(part, F.lit(len(START) + 1), at - len(START) - 1)
        return F.struct(unescaped_role(role).alias("role"), unescaped(F.substring(part, at + 1, F.char_length(part))).alias("text"))

    return F.transform(parts, turn)


def digests(rows: DataFrame) -> DataFrame:
    """Per conversation, read from the formatted examples: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars and n_examples."""
    turns = F.when(F.col("final"), read_back(F.col("formatted")))
    loss = F.when(F.col("target"), unescaped(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_chars")))).otherwise("")
    got = rows.withColumn("turns", turns).select(
        "conv_id", "target", F.char_length("formatted").alias("chars"), F.coalesce(F.size("turns"), F.lit(0)).alias("n"),
        F.struct("example", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("read"), loss.alias("loss")).alias("e"),
    )
    got = got.groupBy("conv_id").agg(
        F.sum(F.when(F.col("n") > 0, F.col("n")).otherwise(0)).alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sum(F.col("target").cast("long")).alias("n_examples"), F.sort_array(F.collect_list("e")).alias("e"),
    )
    joined = lambda f: F.array_join(F.transform("e", lambda e: F.coalesce(e[f], F.lit(""))), "")
    return got.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(joined("read"), 256).alias("turns_sha256"),
        F.char_length(joined("loss")).cast("long").alias("loss_chars"), F.sha2(joined("loss"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"), "n_examples",
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
s AS (
  SELECT *, 24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10))) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS n,
    row_number() OVER w AS k FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS upto, max(CASE WHEN role = 'assistant' THEN k ELSE 0 END) OVER (PARTITION BY conv_id) AS last FROM s)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN upto ELSE 0 END + CASE WHEN k > last THEN n ELSE 0 END) AS BIGINT) AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant') AS n_examples
FROM c GROUP BY conv_id
"""
