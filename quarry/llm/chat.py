"""Chat formatting in DataFrame functions alone: typed content parts become ordered placeholders in one marked string.

A visitor over the parts of a message keeps text, with control strings escaped, and puts a numbered placeholder for each
image, audio or document part, recording the attachment and the tokens it expands to. Turns carry marks, and a loss mask
covers what the assistant wrote. What was formatted can be read back exactly.

Template (fixed values of this format): a turn is `<turn:ROLE>TEXT</turn>` and a line end; a placeholder is `<TYPE:NUMBER>`.
In roles and texts `&` becomes `&amp;`, `<` becomes `&lt;` and `>` becomes `&gt;`, so no text holds a mark.

Defined results: a null text or null part is empty; a null role is the empty role; turns with equal numbers are ordered by role
and the texts of their parts; null turn numbers come first; repeated rows are turns of their own; a null conversation id is a conversation; a part
of unknown type is a document; null uris are kept as null; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>\n"
PARTS = "array<struct<type:string,text:string,uri:string,units:bigint>>"
#: Tokens that one unit of a part expands to: a tile of an image, a second of audio, a page of a document.
EXPANDS = {"image": 256, "audio": 25, "document": 512}


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def text_parts(text: Column) -> Column:
    """The parts of a message that is one text."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(0).cast("long").alias("units"))).cast(PARTS)


def visited(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", expands: dict[str, int] = EXPANDS) -> DataFrame:
    """One row per turn: conv_id, position, role, body, attachments (number, type, uri, tokens), start and size of the formatted turn.

    Attachments are numbered over the conversation, in order. One shuffle by conversation serves numbering, offsets and what groups later.
    """
    kinds = list(expands)
    is_text = lambda p: F.coalesce(p["type"], F.lit("text")) == "text"
    rows = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(parts, F.expr(f"cast(array() as {PARTS})")).alias("parts"))
    order = [F.col("turn"), F.col("role"), F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), F.to_json("parts")]  # parts without text last
    whole = Window.partitionBy("conv_id").orderBy(*order)
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("position", F.row_number().over(whole)).withColumn("files", F.filter("parts", lambda p: ~is_text(p)))
    rows = rows.withColumn("first", F.coalesce(F.sum(F.size("files")).over(before), F.lit(0)))
    kind = lambda p: F.when(p["type"].isin(kinds), p["type"]).otherwise("document")
    tokens = lambda p: F.element_at(F.create_map(*[F.lit(x) for kv in expands.items() for x in kv]), kind(p)).cast("long") * F.greatest(F.coalesce(p["units"], F.lit(1)), F.lit(1))
    rows = rows.withColumn("attachments", F.transform("files", lambda p, i: F.struct((F.col("first") + i + 1).alias("number"), kind(p).alias("type"), p["uri"].alias("uri"), tokens(p).alias("tokens"))))
    number = lambda i: F.col("first") + 1 + F.size(F.filter(F.slice("parts", 1, i), lambda p: ~is_text(p)))
    body = F.array_join(F.transform("parts", lambda p, i: F.when(is_text(p), escaped(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), kind(p), F.lit(":"), number(i).cast("string"), F.lit(">")))), "")
    rows = rows.withColumn("body", body).withColumn("head", F.concat(F.lit("<turn:"), escaped(F.col("role")), F.lit(">")))
    rows = rows.withColumn("size", F.char_length("head") + F.char_length("body") + len(END))
    return rows.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).select("conv_id", "position", "role", "head", "body", "attachments", "start", "size")


def formatted(turns: DataFrame, learns: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (spans start, end of the string, code points), attachments, n_expanded tokens.

    The column skips says the same as loss by turn: how much of the turn comes before what is learnt; null where nothing is.
    """
    t = F.struct("position", "role", "head", "body", "start", "size", "attachments")
    per = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(t)).alias("t"))
    text = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    loss = F.transform(F.filter("t", lambda x: x["role"].isin(*learns)), lambda x: F.struct((x["start"] + F.char_length(x["head"])).alias("start"), (x["start"] + x["size"] - len(END)).alias("end")))
    skips = F.transform("t", lambda x: F.when(x["role"].isin(*learns), F.char_length(x["head"])))
    files = F.flatten(F.transform("t", lambda x: x["attachments"]))
    return per.select("conv_id", text.alias("formatted"), loss.alias("loss"), skips.alias("skips"), files.alias("attachments"), F.aggregate(files, F.lit(0).cast("long"), lambda s, x: s + x["tokens"]).alias("n_expanded"))


def read_back(column: str = "formatted") -> Column:
    """The turns of a formatted string as (role, text), unescaped; placeholders stay as they stand."""
    pattern = F.lit(r"(?s)<turn:([^>]*)>(.*?)</turn>\n")
    roles, texts = F.regexp_extract_all(column, pattern, F.lit(1)), F.regexp_extract_all(column, pattern, F.lit(2))
    return F.transform(F.arrays_zip(roles.alias("r"), texts.alias("t")), lambda x: F.struct(unescaped(x["r"]).alias("role"), unescaped(x["t"]).alias("text")))


def under_loss(column: str = "formatted", skips: str = "skips") -> Column:
    """All text under the loss mask, unescaped, as one string; one split at the ends of turns serves all of them."""
    turns = F.arrays_zip(F.slice(F.split(column, END, -1), 1, F.size(skips)).alias("turn"), F.col(skips).alias("skip"))
    return F.array_join(F.transform(turns, lambda x: F.when(x["skip"].isNotNull(), unescaped(x["turn"].substr(x["skip"] + 1, F.char_length(x["turn"])))).otherwise("")), "")
