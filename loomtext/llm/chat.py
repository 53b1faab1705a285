"""Chat formatting with typed content parts, in DataFrame functions only.

A message is an array of parts {type, text, ref, tokens}. A visitor over the array flattens it:
text parts are escaped, image, audio and document parts become one placeholder each, in order, and
are recorded as attachments with their reference, place and expanded token count. Plain texts give
parts too: a link to media as Markdown writes it, ![name](reference), is a part of the kind that
its reference's ending says, and what stands around it is text.

Turns are marked <|turn|>role newline content <|end|>, placeholders <|@type|>. Control strings
inside texts are escaped reversibly: ~ opens every escape, so no text, role or type can hold a
control string of the template, and unescaping restores it. No type gives a turn's mark, since a
placeholder's name begins with @.

The loss mask is a list of spans (code points, ends exclusive) over the formatted text, one for
each assistant message's content, with the number of attachments before it. Places are running
sums over a conversation's turns, so time is linear in them; a conversation is one row in the end.

Defined cases: null text, role or parts count as empty; turns are ordered by turn (null first),
then role, then content, so ties and repeated rows have one order; a null conv_id is a conversation
of its own; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm.common import table

TURN, END = "<|turn|>", "<|end|>"
#: In this order when escaping; unescaping goes backwards.
ESCAPES = [("~", "~0"), ("<|", "~1"), ("</s>", "~2"), ("<s>", "~3"), ("[INST]", "~4"), ("[/INST]", "~5")]
#: Tokens that a part takes if it doesn't say.
DEFAULT_TOKENS = {"image": 576, "audio": 750, "document": 1024}
#: A link to media in a text, and the endings of what isn't an image.
MEDIA = r"!\[[^\]\n]*\]\([^()\s]+\)"
ENDINGS = {"audio": "mp3|wav|ogg|flac|m4a", "document": "pdf|docx?|pptx?|xlsx?|txt|csv"}
_HOLDER = r"<\|@[^|]*\|>"
PART = "struct<type:string,text:string,ref:string,tokens:int>"


def escape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), ESCAPES[::-1], text)


def escape_role(role: Column) -> Column:
    """A role also must not hold the newline that ends it."""
    return F.replace(escape(role), F.lit("\n"), F.lit("~6"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("~6"), F.lit("\n")))


def escape_kind(kind: Column) -> Column:
    """A type also must not hold the bar that ends its placeholder."""
    return F.replace(escape_role(kind), F.lit("|"), F.lit("~7"))


def _part(kind: Column, text: Column, ref: Column) -> Column:
    return F.struct(kind.alias("type"), text.alias("text"), ref.alias("ref"), F.lit(None).cast("int").alias("tokens"))


def parts_of(text: Column) -> Column:
    """The parts of a plain text: media links, and the texts around them."""
    none = F.lit(None).cast("string")
    only = F.array(_part(F.lit("text"), text, none))
    links = F.regexp_extract_all(text, F.lit(MEDIA), F.lit(0))
    ref = lambda m: F.regexp_extract(m, r"\(([^()\s]+)\)$", 1)
    ending = lambda m, kind: F.lower(ref(m)).rlike(rf"\.({ENDINGS[kind]})$")
    kind = lambda m: F.when(ending(m, "audio"), F.lit("audio")).when(ending(m, "document"), F.lit("document")).otherwise(F.lit("image"))
    pair = lambda t, i: F.array(_part(F.lit("text"), t, none), F.when(F.get(links, i).isNotNull(), _part(kind(F.get(links, i)), F.get(links, i), ref(F.get(links, i)))))
    several = F.flatten(F.transform(F.split(text, MEDIA, -1), pair))
    return F.when(F.contains(text, F.lit("](")), several).otherwise(only)


def flatten_parts(parts: Column) -> Column:
    """struct<content, attachments>: parts in order, text escaped and others as placeholders."""
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    kind = lambda p: F.coalesce(p["type"], F.lit("text"))
    content = F.array_join(F.transform(parts, lambda p: F.when(kind(p) == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|@"), escape_kind(kind(p)), F.lit("|>")))), "")
    default = lambda p: reduce(lambda c, kv: F.when(kind(p) == kv[0], F.lit(kv[1])).otherwise(c), DEFAULT_TOKENS.items(), F.lit(0))
    others = F.filter(parts, lambda p: kind(p) != "text")
    attachments = F.transform(others, lambda p, i: F.struct(i.alias("place"), kind(p).alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], default(p)).alias("tokens"), F.coalesce(p["text"], F.lit("")).alias("text")))
    return F.struct(content.alias("content"), attachments.alias("attachments"))


def format_chats(messages: DataFrame, parts: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments, attachment_tokens.

    messages has conv_id, turn, role and text, or the named column of parts instead of text. An
    attachment has its place among its message's, type, ref, tokens, and the text it stands for.
    """
    flat = flatten_parts(F.col(parts) if parts else parts_of(F.col("text")))
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), flat.alias("flat")).select("conv_id", "turn", "role", "flat.content", "flat.attachments")
    head = F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.withColumn("piece", F.concat(head, "content", F.lit(END))).withColumn("head", F.length(head))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "content").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select(
        "conv_id", "role", "piece", "attachments", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("int").alias("at"),
        F.coalesce(F.sum(F.size("attachments")).over(before), F.lit(0)).cast("int").alias("earlier"), "head", F.length("content").alias("size"),
    )
    start = F.col("at") + F.col("head")
    span = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.col("size")).alias("end"), "earlier"))
    turns = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece", "attachments"))).alias("turns"), F.array_sort(F.collect_list(span)).alias("loss_spans"))
    return turns.select(
        "conv_id", F.array_join(F.transform("turns", lambda m: m["piece"]), "").alias("formatted"), "loss_spans",
        F.flatten(F.transform("turns", lambda m: m["attachments"])).alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def restore(formatted: Column, attachments: Column, earlier: Column | int = 0) -> Column:
    """The formatted text, or a stretch of it before which ``earlier`` attachments stand, with the attachments' texts (escaped) for their placeholders."""
    earlier = F.lit(earlier) if isinstance(earlier, int) else earlier
    fill = lambda t, i: F.concat(F.when(i > 0, escape(F.coalesce(F.get(attachments, i - 1 + earlier)["text"], F.lit("")))).otherwise(F.lit("")), t)
    return F.array_join(F.transform(F.split(formatted, _HOLDER, -1), fill), "")


def read_back(formatted: Column, attachments: Column | None = None) -> Column:
    """array<struct<role, text>> of a formatted conversation, unescaped; attachments' texts stand where they stood if given."""
    whole = formatted if attachments is None else F.when(F.size(attachments) > 0, restore(formatted, attachments)).otherwise(formatted)
    turns = F.slice(F.split(whole, r"<\|turn\|>"), 2, 1 << 30)
    cut = F.transform(turns, lambda t: F.substring(t, F.lit(1), F.length(t) - F.lit(len(END))))
    role = lambda t: F.substring_index(t, "\n", 1)
    return F.transform(cut, lambda t: F.struct(unescape_role(role(t)).alias("role"), unescape(F.substring(t, F.length(role(t)) + F.lit(2), F.length(t))).alias("text")))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.sql("SELECT -1L conv_id, 0L turn, 'user' role, '</s>[INST] ok [/INST]' text UNION ALL SELECT -1L, 1L, 'assistant', '</s>[INST] ok [/INST]'")
    done = format_chats(rows.unionByName(extra)).withColumn("turns", read_back(F.col("formatted"), F.col("attachments")))
    stretch = lambda s: F.substring(F.col("formatted"), s["start"] + F.lit(1), s["end"] - s["start"])
    said = F.array_join(F.transform("loss_spans", lambda s: unescape(F.when(F.size("attachments") > 0, restore(stretch(s), F.col("attachments"), s["earlier"])).otherwise(stretch(s)))), "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    done = done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), said.alias("said"), F.length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"), "attachment_tokens")
    return done.select("conv_id", "n_turns", "turns_sha256", F.length("said").cast("long").alias("loss_chars"), F.sha2(F.col("said").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_attachments", "attachment_tokens")


def _sql_escape(column: str) -> str:
    return reduce(lambda c, e: f"replace({c}, '{e[0]}', '{e[1]}')", ESCAPES, column)


def _by_kind(m: str, values: dict[str, int]) -> str:
    ends = " ".join(f"WHEN regexp_matches(lower({m}), '\\.({e})\\)$') THEN {values[k]}" for k, e in ENDINGS.items())
    return f"CASE {ends} ELSE {values['image']} END"


_HOLDERS = {k: len(f"<|@{k}|>") for k in DEFAULT_TOKENS}
OP10_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
rows AS (SELECT *, regexp_extract_all(text, '{MEDIA}') AS media FROM said)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, {_sql_escape("text")})) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, {_sql_escape("text")}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum({len(TURN) + 1 + len(END)} + length(replace({_sql_escape("role")}, chr(10), '~6')) + length({_sql_escape("text")})
           + coalesce(list_sum(list_transform(media, lambda m: {_by_kind("m", _HOLDERS)} - length({_sql_escape("m")}))), 0))::BIGINT AS formatted_chars,
       sum(len(media))::BIGINT AS n_attachments,
       coalesce(sum(list_sum(list_transform(media, lambda m: {_by_kind("m", DEFAULT_TOKENS)}))), 0)::BIGINT AS attachment_tokens
FROM rows GROUP BY conv_id
"""
