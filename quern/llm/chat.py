"""Chat formatting (operator 2), with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of
one role become one message with several parts. The text is

    <|start|>ROLE<|text|>PART<|text|>PART<|end|>  for each message, end to end

Control strings (the template's own and those of common chat templates) never
occur in escaped text: each backslash is doubled, and a backslash goes after
the first character of each control string. Removing the first backslash of
each pair undoes it, so roles and texts come back exactly.

Cases: null role or text is empty; turns sort by (turn, role, text), nulls
first, so ties and repeated rows have one order and all stay; a null conv_id
is a conversation of its own; other columns are ignored; an empty table gives no rows. A conversation is one
output row, so it must fit in a row (2 GB), as the result asks for.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import read

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
#: Strings that mean something to chat templates in use.
CONTROL = [START, TEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
BLANK = ("role", "text")


def escape(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        out = F.replace(out, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}"))
    return out


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, n_messages, loss_spans: array of (start, length) in code points and in bytes, from 0, over assistant parts."""
    turns = rows.select("conv_id", F.struct("turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in BLANK]).alias("t"))
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    once = lambda c: F.explode(F.array(c))  # noqa: E731  else an array is made anew for each element that a lambda takes from it
    esc = turns.select("conv_id", once(F.transform("t", lambda x: F.struct(escape(x["role"]).alias("role"), escape(x["text"]).alias("text")))).alias("t"))
    # A message starts where the role changes; its parts are the turns up to the next start.
    heads = esc.select("conv_id", "t", once(F.expr("filter(sequence(0, size(t) - 1), i -> i = 0 or t[i].role <> t[i - 1].role)")).alias("heads"))
    messages = heads.select("conv_id", F.expr(
        "transform(heads, (h, k) -> named_struct('role', t[h].role, 'parts', "
        "transform(slice(t, h + 1, coalesce(try_element_at(heads, k + 2), size(t)) - h), x -> x.text)))").alias("m"))
    # Pieces of text with a mark on those under the loss.
    pieces = messages.select("conv_id", F.size("m").cast("long").alias("n_messages"), F.expr(f"""
        flatten(transform(m, x -> concat(
            array(named_struct('s', concat('{START}', x.role), 'loss', false)),
            flatten(transform(x.parts, p -> array(named_struct('s', '{TEXT}', 'loss', false), named_struct('s', p, 'loss', x.role = 'assistant')))),
            array(named_struct('s', '{END}', 'loss', false)))))""").alias("p"))
    # A piece starts where all before it end; conversations stay where they were collected, so nothing is shuffled again.
    before = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda n: F.coalesce(F.sum(n("x.s")).over(before), F.lit(0)).cast("long")
    placed = pieces.select("conv_id", "n_messages", F.posexplode("p").alias("at", "x"))
    placed = placed.select("conv_id", "n_messages", F.struct("at", "x.s", "x.loss", sums(F.length).alias("start"), sums(F.octet_length).alias("byte_start")).alias("q"))
    q = placed.groupBy("conv_id").agg(F.first("n_messages").alias("n_messages"), F.sort_array(F.collect_list("q")).alias("q"))
    span = lambda x: F.struct(x["start"], F.length(x["s"]).cast("long").alias("length"), x["byte_start"], F.octet_length(x["s"]).cast("long").alias("byte_length"))
    spans = F.transform(F.filter("q", lambda x: x["loss"]), span)
    return q.select("conv_id", F.concat_ws("", F.col("q.s")).alias("formatted"), spans.alias("loss_spans"), "n_messages")


def read_back(chats: DataFrame) -> DataFrame:
    """Adds turns (array of role, text) and loss (text under the mask), both parsed from ``formatted``."""
    cut = lambda s: re.escape(s)
    blocks = F.expr(f"slice(split(formatted, '{cut(START)}'), 2, 2147483646)".replace("\\", "\\\\"))
    body = F.transform(blocks, lambda b: F.split(F.substring(b, F.lit(1), F.length(b) - len(END)), cut(TEXT)))
    turns = F.flatten(F.transform(body, lambda b: F.transform(
        F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0))),
        lambda x: F.struct(unescape(b[0]).alias("role"), unescape(x).alias("text")))))
    # By bytes, which are found without a walk from the start; exploded, so that the bytes are made once.
    rows = chats.select("*", F.explode(F.array(F.encode("formatted", "UTF-8"))).alias("__bytes"))
    loss = F.concat_ws("", F.transform("loss_spans", lambda s: unescape(F.decode(F.substring(
        F.col("__bytes"), (s["byte_start"] + 1).cast("int"), s["byte_length"].cast("int")), "UTF-8"))))
    return rows.withColumn("turns", turns).withColumn("loss", loss).drop("__bytes")


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    out = read_back(format_chats(rows.unionByName(more)))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "n_messages")


def _sql() -> str:
    def esc(c: str) -> str:
        out = f"replace({c}, '\\', '\\\\')"
        for s in CONTROL:
            out = f"replace({out}, '{s}', '{s[0]}\\{s[1:]}')"
        return out

    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM c),
m AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY k) = role THEN 0 ELSE 1 END AS head FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(TEXT)} + length({esc("text")}) + head * ({len(START) + len(END)} + length({esc("role")}))) AS BIGINT) AS formatted_chars,
       CAST(sum(head) AS BIGINT) AS n_messages
FROM m GROUP BY conv_id
"""


SQL = _sql()
