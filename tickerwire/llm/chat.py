"""Chat formatting with typed content parts.

Rows are turns; a turn's content is an array of typed parts
``struct<type, text, uri, units>``. A visitor flattens the parts in order:
neighbouring texts are joined and escaped, every other part becomes a placeholder ``<|type|>`` with its
attachment reference and the number of tokens it expands to
(``units`` times the type's rate) recorded. The template marks each turn as

    <|im_start|>role\\ntext<|im_end|>\\n

Control strings inside roles and texts are made inert by one backslash more
after their first character; taking one away undoes it exactly, so the
formatted text can be parsed back without loss.

Defined results: null text, role or part list count as empty; an unknown or
null part type counts as text; a null turn comes first; rows equal in turn are
ordered by role, then content; a null conversation id is a conversation of its
own; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
# Control strings of common chat templates, by what follows the
# first character (``<`` or ``[``).
CONTROL = [r"\|im_start\|>", r"\|im_end\|>", r"\|(?:text|image|audio|document)\|>", r"\|endoftext\|>",
           r"/?s>", r"/?INST\]", r"/?SYS>", r"</?SYS>>"]
_AFTER = "(" + "|".join(CONTROL) + ")"
ESCAPE = r"([<\[])(\\*)" + _AFTER
UNESCAPE = r"([<\[])\\(\\*)" + _AFTER
# Tokens that one unit of an attachment takes (image: patches, audio: frames
# of 20 ms, document: pages).
RATES = {"image": 1, "audio": 1, "document": 1024}
PARTS = "array<struct<type: string, text: string, uri: string, units: bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def escape_role(role: Column) -> Column:
    """A role ends at the line end, so its own line ends are escaped too."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # "\\\\" -> "\\", "\\n" -> line end, left to right
    plain = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(plain, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("uri"),
                            F.lit(None).cast("bigint").alias("units"))).cast(PARTS)


def visit(parts: Column) -> tuple[Column, Column]:
    """(flat text, attachments in order) of a list of parts."""
    parts = F.coalesce(parts, F.array().cast(PARTS))
    attached = lambda p: F.coalesce(p["type"].isin(*RATES), F.lit(False))
    rate = lambda p: F.coalesce(*[F.when(p["type"] == k, F.lit(v)) for k, v in RATES.items()])
    said = lambda p: F.coalesce(p["text"], F.lit(""))
    # neighbouring texts are one run and are escaped as such: a control string
    # may lie across their borders
    flat = F.aggregate(
        parts, F.struct(F.lit("").alias("done"), F.lit("").alias("run")),
        lambda a, p: F.struct(
            F.when(attached(p), F.concat(a["done"], escape(a["run"]), F.lit("<|"), p["type"], F.lit("|>"))).otherwise(a["done"]).alias("done"),
            F.when(attached(p), F.lit("")).otherwise(F.concat(a["run"], said(p))).alias("run")),
        lambda a: F.concat(a["done"], escape(a["run"])))
    one = F.get(parts, 0)
    flat = F.when((F.size(parts) == 1) & ~attached(one), escape(said(one))).otherwise(flat)
    refs = F.transform(F.filter(parts, attached), lambda p: F.struct(
        p["type"].alias("type"), p["uri"].alias("uri"), (F.coalesce(p["units"], F.lit(0)) * rate(p)).cast("bigint").alias("tokens")))
    return flat, refs


def format_chat(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                parts: str = "parts", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_runs (array of
    struct<turn, start, length>: code points from the begin of the turn's
    block, one run per turn, of length 0 where no loss is taken), attachments
    (array of struct<turn, type, uri, tokens>) and expanded_tokens."""
    flat, refs = visit(F.col(parts))
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role), F.lit("")).alias("role"), flat.alias("flat"), refs.alias("refs"))
    place = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "flat")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    masked = F.length("flat") if loss_roles is None else F.when(F.col("role").isin(*loss_roles), F.length("flat")).otherwise(0)
    blocks = (rows.withColumn("no", F.row_number().over(place) - 1)
              .select("conv_id", "no", F.concat(head, "flat", F.lit(END + "\n")).alias("block"),
                      F.struct(F.col("no").alias("turn"), F.length(head).alias("start"), masked.alias("length")).alias("run"),
                      F.transform("refs", lambda r: F.struct(F.col("no").alias("turn"), r["type"].alias("type"), r["uri"].alias("uri"), r["tokens"].alias("tokens"))).alias("refs")))
    whole = (blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("no", "block", "run", "refs"))).alias("b")))
    return whole.select("conv_id", F.array_join("b.block", "").alias("formatted"), F.col("b.run").alias("loss_runs"),
                        F.flatten("b.refs").alias("attachments"),
                        F.aggregate(F.flatten("b.refs"), F.lit(0).cast("bigint"), lambda a, r: a + r["tokens"]).alias("expanded_tokens"))


def parse_chat(formatted: DataFrame) -> DataFrame:
    """Read ``format_chat``'s output back: turns (array of struct<role, text,
    loss>, unescaped; loss: the text under the mask) beside its columns."""
    blocks = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, F.greatest(F.size("loss_runs"), F.lit(1)))
    zipped = F.zip_with(blocks, "loss_runs", lambda b, r: F.struct(F.concat(F.lit(START), b).alias("block"), r.alias("run")))
    line = lambda x: F.instr(x["block"], "\n")
    turns = F.transform(zipped, lambda x: F.struct(
        unescape_role(F.substring(x["block"], len(START) + 1, line(x) - len(START) - 1)).alias("role"),
        unescape(F.substring(x["block"], line(x) + 1, F.length(x["block"]) - line(x) - len(END) - 1)).alias("text"),
        unescape(F.substring(x["block"], x["run"]["start"] + 1, x["run"]["length"])).alias("loss")))
    return formatted.withColumn("turns", turns)
