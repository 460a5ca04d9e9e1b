"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own (``examples``): all turns before it
are context, and only that reply is trainable. A last row without a span holds a
conversation whose last turns have no reply. A conversation of n turns thus writes up to
n / 2 texts that are n / 2 turns long on average; one conversation, and what it expands
to, is made in one task. ``formatted`` gives the same in pieces, where each row holds only
what its example adds to the one before it.

Turns are marked by control strings; control strings inside roles and texts get a
backslash after their first character, and backslashes are doubled, which
``unescaped`` undoes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Strings with which public chat templates mark turns.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), added, target_start and target_end (characters of added; null without a reply).

    Turns go in the order of turn, then role and text. Null roles and texts count as
    empty, a null turn comes first, rows of a null conv_id are one conversation; rows
    that repeat are turns that repeat. Extra columns are not looked at; an empty table
    gives an empty result.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    ordered = "over (partition by conv_id order by turn, role, text rows between unbounded preceding"
    turns = turns.withColumns(
        {
            "nth": F.expr("row_number() over (partition by conv_id order by turn, role, text)"),
            "example": F.expr(f"coalesce(sum(if(role = 'assistant', 1, 0)) {ordered} and 1 preceding), 0)"),
            "body": escaped(F.col("text")),
        }
    )
    # a line break in a role is escaped too: the first bare one ends the role
    opening = F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    pieces = turns.select("conv_id", "example", "nth", F.concat(opening, F.col("body"), F.lit(END)).alias("piece"), F.when(F.col("role") == "assistant", F.length("body")).alias("reply"))
    rows = pieces.groupBy("conv_id", "example").agg(F.sort_array(F.collect_list(F.struct("nth", "piece"))).alias("p"), F.max("reply").alias("reply"))
    added = F.array_join(F.transform("p", lambda x: x["piece"]), "")
    end = F.when(F.col("reply").isNotNull(), F.length("added") - len(END))
    return rows.select("conv_id", "example", added.alias("added"), "reply").select("conv_id", "example", "added", (end - F.col("reply")).alias("target_start"), end.alias("target_end"))


def turns_of(added: Column) -> Column:
    """role, a line break, text and a line break for each turn of formatted text, unescaped and joined."""
    parts = F.filter(F.split(added, r"<\|im_end\|>\n"), lambda x: x != "")
    body = lambda x: F.substring(x, len(START) + 1, 1 << 30)

    def one(x: Column) -> Column:
        role = F.regexp_extract(body(x), r"(?s)^([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n", 1)
        text = F.substr(body(x), F.length(role) + 2)
        return F.concat(unescaped(role), F.lit("\n"), unescaped(text), F.lit("\n"))

    return F.transform(parts, one)


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), text (all turns up to the reply), target_start and target_end (characters of text; null without a reply).

    Nulls, ties and repeated rows are as in ``formatted``.
    """
    frame = "over (partition by conv_id order by example rows between unbounded preceding and 1 preceding)"
    shifted = formatted(conversations).withColumn("before", F.expr(f"coalesce(array_join(collect_list(added) {frame}, ''), '')"))
    at = F.length("before")
    return shifted.select("conv_id", "example", F.concat("before", "added").alias("text"), (at + F.col("target_start")).alias("target_start"), (at + F.col("target_end")).alias("target_end"))


def digests(rows: DataFrame) -> DataFrame:
    """What ``examples`` gave, read back from it: turns from a conversation's longest text, each reply from the span of its own example."""
    reply = F.when(F.col("target_start").isNotNull(), unescaped(F.expr("substring(text, target_start + 1, target_end - target_start)")))
    parts = rows.select("conv_id", "example", "text", F.struct("example", reply.alias("reply")).alias("p"))
    whole = parts.groupBy("conv_id").agg(F.max_by("text", "example").alias("text"), F.sum(F.length("text")).cast("long").alias("formatted_chars"), F.sort_array(F.collect_list("p")).alias("p"))
    whole = whole.select("conv_id", "formatted_chars", turns_of(F.col("text")).alias("turns"), F.array_join(F.transform("p", lambda x: x["reply"]), "").alias("loss"))
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _escaped_sql(x: str) -> str:
    x = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        x = f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')"
    return x


ORACLE_SQL = f"""
with c as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as nth, count(*) over (partition by conv_id) as n,
           {len(START) + len(END) + 1} + length({_escaped_sql("role")}) + length({_escaped_sql("text")}) as chars from c),
x as (select *, sum(chars) over (partition by conv_id order by nth) as upto from e),
d as (
    select conv_id, count(*)::bigint as n_turns,
           string_agg(role || chr(10) || text || chr(10), '' order by nth) as turns,
           coalesce(string_agg(text, '' order by nth) filter (where role = 'assistant'), '') as loss,
           (sum(upto) filter (where role = 'assistant' or nth = n))::bigint as formatted_chars
    from x group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars from d
"""
