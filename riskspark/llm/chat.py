"""Chat formatting with typed content parts, in DataFrame functions only.

A visitor turns each part of a message into text: text parts are escaped, image, audio and document parts become one
placeholder each, in order, and are recorded as attachments with their reference and the number of tokens the placeholder
expands to. A conversation is its messages by turn, each between marks; the loss mask lists where assistant messages stand,
in code points and in UTF-8 bytes, so that reading under the mask is linear in the text.

Escaping: a backslash is doubled, and a control string gets one after its first character; so no text can hold a mark, and
unescaping (drop each backslash, keep the character after it) gives the text back. In roles a line feed gets one too.

Null texts, parts and roles count as empty. Messages of the same turn are ordered by role, then content; repeated rows are
repeated messages; a null conversation id is a conversation of its own. One conversation's output is one string and so is built in
one task; nothing in it is quadratic in the number of messages. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}

#: Strings that templates in use give a meaning.
CONTROLS = [
    "<|im_start|>", "<|im_end|>", "<|image|>", "<|audio|>", "<|document|>", "<|file|>", "<|endoftext|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
]
OTHER = "<|file|>"

#: Type of ``parts``: what a message can hold. Sizes are in pixels, seconds and pages.
PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
REST = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}  # what a text has none of
PATCH, AUDIO_PER_SECOND, PER_PAGE = 28, 25, 512


def escape(text: Column, controls: list[str] = CONTROLS) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in controls:
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def text_part(text: Column) -> Column:
    """Parts of a message that is only a text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(kind).alias(name) for name, kind in REST.items()]))


def visit(parts: Column) -> tuple[Column, Column]:
    """(text with placeholders, attachments) of one message. Parts of an unknown type with a text count as text, others as a file.

    A text that comes with a reference is followed by the placeholder of a file, so that no reference is lost.
    """

    def is_text(part: Column) -> Column:
        known = F.coalesce(part["type"].isin(*PLACEHOLDERS), F.lit(False))
        return ~known & ((part["type"] == "text").eqNullSafe(True) | part["text"].isNotNull())

    def render(part: Column) -> Column:
        text = escape(F.coalesce(part["text"], F.lit("")))
        out = F.when(is_text(part), F.concat(text, F.when(part["ref"].isNotNull(), F.lit(OTHER)).otherwise(F.lit(""))))
        for kind, mark in PLACEHOLDERS.items():
            out = out.when(part["type"] == kind, F.lit(mark))
        return out.otherwise(F.lit(OTHER))

    def tokens(part: Column) -> Column:
        size = lambda name: F.coalesce(part[name], F.lit(0))
        image = F.ceil(size("width") / PATCH) * F.ceil(size("height") / PATCH)
        return (
            F.when(part["type"] == "image", image)
            .when(part["type"] == "audio", F.ceil(size("seconds") * AUDIO_PER_SECOND))
            .when(part["type"] == "document", size("pages") * PER_PAGE)
            .otherwise(F.lit(1)).cast("long")
        )

    attachments = F.transform(
        F.filter(parts, lambda p: ~is_text(p) | p["ref"].isNotNull()),
        lambda p: F.struct(F.when(is_text(p), F.lit("file")).otherwise(F.coalesce(p["type"], F.lit("file"))).alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens")),
    )
    return F.array_join(F.transform(parts, render), ""), attachments


def format_conversations(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str | None = "text", parts: str | None = None
) -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments, n_turns) from one row per message, with ``text`` (one text part) or with ``parts`` (array of PART)."""
    who = F.coalesce(F.col(role), F.lit(""))
    typed = text_part(F.col(text)) if parts is None else F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>"))
    body, files = visit(typed)
    head = F.concat(F.lit(START), F.replace(escape(who), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    turns = messages.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), who.alias("role"), body.alias("body"), files.alias("files"), head.alias("head")
    ).withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "body", F.to_json("files"))
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda size: F.coalesce(F.sum(size("piece")).over(earlier), F.lit(0)) + size("head")
    placed = turns.select(
        "conv_id", "piece", "files", (F.col("role") == "assistant").alias("learnt"),
        ahead(F.length).alias("start"), ahead(F.octet_length).alias("byte_start"),
        F.length("body").cast("long").alias("size"), F.octet_length("body").cast("long").alias("bytes"),
    )
    listed = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("byte_start", "start", "size", "bytes", "learnt", "piece", "files"))).alias("all")
    )
    spans = F.transform(
        F.filter("all", lambda m: m["learnt"]),
        lambda m: F.struct(
            m["start"].alias("start"), (m["start"] + m["size"]).alias("end"), m["byte_start"].alias("byte_start"), (m["byte_start"] + m["bytes"]).alias("byte_end")
        ),
    )
    return listed.select(
        "conv_id", F.array_join(F.col("all.piece"), "").alias("formatted"), spans.alias("loss_spans"),
        F.flatten("all.files").alias("attachments"), F.size("all").cast("long").alias("n_turns"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text), unescaped, parsed from the marks alone."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    role = r"(?s)^((?:[^\\\n]|\\.)*+)\n(.*)<\|im_end\|>\n$"
    return F.transform(
        pieces,
        lambda p: F.struct(unescape(F.regexp_extract(p, role, 1)).alias("role"), unescape(F.regexp_extract(p, role, 2)).alias("text")),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """Array of the unescaped texts under the loss mask. The bytes are bound once as a lambda variable, not copied for each span."""
    return F.transform(
        F.array(formatted.cast("binary")),
        lambda data: F.transform(
            spans, lambda s: unescape(data.substr((s["byte_start"] + 1).cast("int"), (s["byte_end"] - s["byte_start"]).cast("int")).cast("string"))
        ),
    )[0]
