"""Chat formatting of typed content parts (operator 4), in DataFrame functions only.

A visitor flattens the parts of each message: a text part becomes its escaped text; image,
audio and document parts become placeholders, in order, and each leaves a reference to its
attachment with the number of tokens that it will expand to. Parts are joined by a control
string, so that two texts side by side can't form one together.

The template is ``<|turn|>role<|say|>body<|end|>`` and a line feed for each turn. Control
strings inside roles and texts get a backslash after their first character, behind any
backslashes that already stand there; reading back takes one away, so every text returns
as it was. The loss mask is a list of (start, length) in characters of the formatted string.

Rows: a null role, text or list of parts is empty; a null or unknown part type is an
attachment of no tokens. Turns are in the order of ``turn``, nulls first, and ties in the
order of role and body; repeated rows are turns of their own. A null conversation id is a
conversation. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAY, END, PART = "<|turn|>", "<|say|>", "<|end|>", "<|part|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
OTHER = "<|attachment|>"
#: First character of a control string, backslashes, and the rest that tells it.
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"
PART_TYPE = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


@dataclass(frozen=True)
class Expansion:
    """Tokens of attachments: an image's patches, a second of sound, a page; and what an unknown size counts as."""

    patch: int = 28
    per_second: float = 25.0
    per_page: int = 512
    unknown: int = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _tokens(p: Column, e: Expansion) -> Column:
    side = lambda x: F.ceil(x / e.patch)
    count = (
        F.when(p["type"] == "image", side(p["width"]) * side(p["height"]))
        .when(p["type"] == "audio", F.ceil(p["seconds"] * e.per_second))
        .when(p["type"] == "document", p["pages"].cast("long") * e.per_page)
    )
    return F.when(p["type"].isin(*PLACEHOLDERS), F.coalesce(count, F.lit(e.unknown)).cast("long")).otherwise(F.lit(0).cast("long"))


def _visit(p: Column) -> Column:
    """The string of a part."""
    out = F.when(p["type"] == "text", escape(F.coalesce(p["text"], F.lit(""))))
    for kind, mark in PLACEHOLDERS.items():
        out = out.when(p["type"] == kind, F.lit(mark))
    return out.otherwise(F.lit(OTHER))


def text_parts(text: Column) -> Column:
    """A message of text alone, as a list of parts."""
    null = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(t).alias(k) for k, t in null.items()]))


def format_chat(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learn: tuple[str, ...] = ("assistant",), expansion: Expansion = Expansion()) -> DataFrame:
    """One row for each conversation: conv_id, n_turns, formatted, loss_spans, attachments, expanded_tokens.

    ``parts`` is a column of PART_TYPE. Attachments are (index, turn, part, type, ref, tokens).
    """
    p = F.coalesce(F.col(parts).cast(PART_TYPE), F.array().cast(PART_TYPE))
    own = F.coalesce(F.col(role), F.lit(""))
    rows = messages.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            own.alias("role"),
            F.array_join(F.transform(p, _visit), PART).alias("body"),
            F.filter(F.transform(p, lambda x, i: F.struct(i.alias("part"), x["type"].alias("type"), x["ref"].alias("ref"), _tokens(x, expansion).alias("tokens"))), lambda x: ~x["type"].eqNullSafe(F.lit("text"))).alias("attached"),
        ).alias("m"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    before = lambda m: F.concat(F.lit(TURN), escape(m["role"]), F.lit(SAY))
    chats = chats.select("conv_id", F.transform("m", lambda m, i: F.struct(i.alias("n"), m["role"].isin(*learn).alias("learn"), before(m).alias("before"), m["body"].alias("body"), m["attached"].alias("attached"))).alias("m"))
    close = END + "\n"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def walk(acc: Column, m: Column) -> Column:
        at, n = acc["at"] + F.char_length(m["before"]), F.char_length(m["body"])
        span = F.array(F.struct(at.alias("start"), n.alias("length")))
        return F.struct((at + n + len(close)).alias("at"), F.when(m["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    attached = F.flatten(F.transform("m", lambda m: F.transform(m["attached"], lambda a: F.struct(m["n"].alias("turn"), a["part"], a["type"], a["ref"], a["tokens"]))))
    return chats.select(
        "conv_id",
        F.size("m").cast("long").alias("n_turns"),
        F.array_join(F.transform("m", lambda m: F.concat(m["before"], m["body"], F.lit(close))), "").alias("formatted"),
        F.aggregate("m", start, walk)["spans"].alias("loss_spans"),
        F.transform(attached, lambda a, i: F.struct(i.alias("index"), a["turn"].alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string: an array of (role, text), as they were before. Placeholders and part marks stay."""
    pieces = F.split(formatted, r"<\|turn\|>")
    return F.transform(
        F.slice(pieces, 2, F.size(pieces)),
        lambda t: F.struct(unescape(F.substring_index(t, SAY, 1)).alias("role"), unescape(F.substring_index(F.substring_index(t, SAY, -1), END, 1)).alias("text")),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, as it was before."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
