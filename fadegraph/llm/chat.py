"""Chat formatting: every assistant turn becomes an example with all turns before it as context.

A turn is written ``<|role|>text<|end|>``.  Within roles and texts the
characters that control strings begin with, of this template and of common
others, are written as two characters, so no control string can occur there
and reading back is exact.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>", "<|end|>"
ASSISTANT = "assistant"
# What stands for the characters in texts; the first is the escape itself.
_ESCAPES = (("&", "&a"), ("<", "&l"), ("[", "&s"))
_ROLE_ESCAPES = (*_ESCAPES, ("|", "&p"))


def escape(value: Column, pairs: tuple[tuple[str, str], ...] = _ESCAPES) -> Column:
    for plain, written in pairs:
        value = F.replace(value, F.lit(plain), F.lit(written))
    return value


def unescape(value: Column, pairs: tuple[tuple[str, str], ...] = _ESCAPES) -> Column:
    for plain, written in reversed(pairs):
        value = F.replace(value, F.lit(written), F.lit(plain))
    return value


def _piece(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(turn["role"], _ROLE_ESCAPES), F.lit(CLOSE), escape(turn["text"]), F.lit(END))


def format_chat(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text") -> DataFrame:
    """Examples of conversations: (conv_id, example, trainable, formatted, loss_start, loss_end).

    ``example`` is the place, from 1, of the turn that an example ends with.
    An assistant turn is the end of an example whose loss mask, the code points
    from ``loss_start`` to ``loss_end`` exclusive of ``formatted``, is its text
    and nothing else.  Turns after the last assistant turn end one example that
    is not ``trainable`` and whose mask is empty, so that no turn is lost.

    Turns are ordered by ``turn``, null last, then role and text, so ties and
    repeated rows have their place.  Null roles and texts count as empty; a null
    id is a conversation of its own.  A conversation is one row while it is
    expanded, since its last example has to hold all of it.  Other columns are
    dropped.  An empty table gives an empty result.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).isNull().alias("last"), F.col(turn).alias("turn"),
                 F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                 F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("turn"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns")).select(
        "conv_id", F.transform("turns", _piece).alias("pieces"),
        F.transform("turns", lambda t: t["role"] == ASSISTANT).alias("replies"),
        F.transform("turns", lambda t: F.length(escape(t["text"]))).alias("sizes"))
    ends = F.filter(F.sequence(F.lit(1), F.size("pieces")),
                    lambda i: F.element_at("replies", i) | (i == F.size("pieces")))
    examples = whole.select("conv_id", "pieces", "replies", "sizes", F.explode(ends).alias("example"))
    built = examples.select(
        "conv_id", "example", F.element_at("replies", F.col("example")).alias("trainable"),
        F.array_join(F.slice("pieces", 1, F.col("example")), "").alias("formatted"),
        F.element_at("sizes", F.col("example")).alias("size"))
    end = F.length("formatted") - len(END)
    return built.select(
        "conv_id", "example", "trainable", "formatted",
        F.when(F.col("trainable"), end - F.col("size")).otherwise(F.length("formatted")).alias("loss_start"),
        F.when(F.col("trainable"), end).otherwise(F.length("formatted")).alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """Roles and texts of a formatted example: array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p != "")

    def read(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len(OPEN) + 1))
        at = F.instr(inner, CLOSE)
        return F.struct(unescape(F.substr(inner, F.lit(1), at - 1), _ROLE_ESCAPES).alias("role"),
                        unescape(F.substr(inner, at + len(CLOSE))).alias("text"))

    return F.transform(pieces, read)


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, as it was before it was escaped."""
    return unescape(F.substr(formatted, start + 1, end - start))


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of what the examples hold, one row for each conversation.

    ``conv_id, n_turns, turns_sha256`` of the longest example, ``loss_chars,
    loss_sha256`` of the texts under the masks in order, and ``formatted_chars``
    of all examples.
    """
    by_conv = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
        F.array_sort(F.collect_list(F.when(F.col("trainable"), F.struct(
            "example", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("text"))))).alias("replies"))
    read = by_conv.select("conv_id", "formatted_chars", read_turns(F.col("longest")).alias("turns"),
                          F.array_join(F.transform("replies", lambda r: r["text"]), "").alias("loss"))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(written, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
