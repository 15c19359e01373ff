"""Chat formatting with typed content parts and a loss mask, in DataFrame operations only.

The template of a turn is "### role: content</turn>\\n". In texts a backslash is put before every backslash, into
"</turn>" and "<|" after the first character, and between the signs of "###", so no control string is left in them;
dropping each backslash that starts a pair gives the text back. Roles are URL-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

END = "</turn>\n"
#: Expanded sizes: an image counts a token per patch, audio one per so many milliseconds, a document so many per page.
PATCH, AUDIO_MS, PAGE_TOKENS = 28, 40, 256
PARTS = "array<struct<type: string, text: string, ref: string, width: int, height: int, millis: bigint, pages: int>>"


def escape(text: Column) -> Column:
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    t = F.replace(F.replace(t, F.lit("</turn>"), F.lit("<\\/turn>")), F.lit("<|"), F.lit("<\\|"))
    return F.regexp_replace(t, "#(?=##)", r"#\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A list with one text part, as PARTS describes."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("millis", "bigint"), ("pages", "int"))))).cast(PARTS)


def expanded_tokens(part: Column) -> Column:
    """Tokens that a media part takes when a model expands its placeholder; unknown extents count 0."""
    image = F.ceil(part["width"] / F.lit(PATCH)) * F.ceil(part["height"] / F.lit(PATCH))
    size = F.when(part["type"] == "image", image).when(part["type"] == "audio", F.ceil(part["millis"] / F.lit(AUDIO_MS))).when(part["type"] == "document", part["pages"].cast("bigint") * PAGE_TOKENS)
    return F.coalesce(size, F.lit(0)).cast("bigint")


def _is_media(part: Column) -> Column:
    return F.coalesce(part["type"].isin("image", "audio", "document"), F.lit(False))


def visit(parts: Column) -> tuple[Column, Column]:
    """(content, attachments): parts flattened in order. Text is escaped; media become <|image|>, <|audio|> or
    <|document|>, with type, ref and tokens listed in the same order; unknown or null types count as text."""
    parts = F.coalesce(parts, F.array().cast(PARTS))
    content = F.array_join(F.transform(parts, lambda p: F.when(_is_media(p), F.concat(F.lit("<|"), p["type"], F.lit("|>"))).otherwise(escape(p["text"]))), "")
    media = F.transform(F.filter(parts, _is_media), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))
    return content, media


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans, attachments, media_tokens), a row for each conversation.

    turns: conv_id, turn, role, parts (PARTS). Turns stand in order of turn (null first), then role, then content;
    repeated rows stay. loss_spans lists (start, end) in code points of formatted, of the content of each turn of
    loss_role; attachments (turn_no, type, ref, tokens) in order of their placeholders. Null parts and texts are
    empty, a null role is an empty one, rows with null conv_id make one conversation. Offsets are running sums over
    a conversation, which is then put together in one row, the smallest unit of the output.
    """
    content, media = visit(F.col("parts"))
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("content"), media.alias("media"))
    head = F.concat(F.lit("### "), F.url_encode("role"), F.lit(": "))
    t = t.withColumn("head", head).withColumn("size", F.length("head") + F.length("content") + len(END))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "content")
    t = t.withColumn("place", F.row_number().over(order)).withColumn("begin", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size") + F.length("head"))
    rows = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "begin", "role", "head", "content", "media"))).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["content"], F.lit(END))), "")
    spans = F.transform(F.filter("turns", lambda x: x["role"] == loss_role), lambda x: F.struct(x["begin"].alias("start"), (x["begin"] + F.length(x["content"])).alias("end")))
    files = F.flatten(F.transform("turns", lambda x: F.transform(x["media"], lambda m: F.struct(x["place"].alias("turn_no"), m["type"].alias("type"), m["ref"].alias("ref"), m["tokens"].alias("tokens")))))
    out = rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), formatted.alias("formatted"), spans.alias("loss_spans"), files.alias("attachments"))
    return out.withColumn("media_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation without media: the template undone."""
    pieces = F.split(formatted, END)
    turns = F.slice(pieces, 1, F.size(pieces) - 1)
    # A role holds no ": " once encoded, so the first one ends it.
    role = lambda p: F.substring_index(p, ": ", 1)
    return F.transform(turns, lambda p: F.struct(F.url_decode(F.substr(role(p), F.lit(5))).alias("role"), unescape(F.substr(p, F.length(role(p)) + 3)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def chat_digest(conversations: DataFrame) -> DataFrame:
    """One row per conversation of the table and of conversation -7, whose texts hold control strings."""
    fields = {f.name: f.dataType.simpleString() for f in conversations.schema.fields}
    said = F.lit("\\### Assistant: </turn> ok")
    extra = conversations.sparkSession.range(1).select(F.lit(-7).cast(fields["conv_id"]).alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")))).alias("x"))
    extra = extra.select("conv_id", F.col("x.turn").cast(fields["turn"]).alias("turn"), "x.role", said.alias("text"))
    turns = conversations.select("conv_id", "turn", "role", "text").unionByName(extra).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))
    chats = format_chats(turns)
    read = chats.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars")
