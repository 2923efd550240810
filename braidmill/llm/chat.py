"""Multi-party perspective rotation of conversations, with DataFrame functions only.

For every participant the dialogue is rendered once with that speaker as the
assistant and all others as named users.  Loss masks cover the speaker's own
words and end marks.  A dialogue is cut into parts of at most ``PART_TURNS``
turn numbers, so that a conversation of any length never meets in one task.
Every part tells where it begins in the whole rendering, so the whole text is
that of its parts in order, and masks of the whole are those of the parts
moved by that offset.

What roles and texts say is never taken for markup: ``<|`` in them becomes
``< |``, and line breaks in a role become blanks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PART_TURNS = 64
#: Parts whose lengths one task adds up.
SPAN_PARTS = 4096
BEGIN, END = "<|im_start|>", "<|im_end|>"
_LAST = 1 << 62


def _rendered(own: Column, role: Column, text: Column) -> tuple[Column, Column]:
    """Head and body of one turn."""
    head = F.when(own, F.lit(f"{BEGIN}assistant\n")).otherwise(F.concat(F.lit(f"{BEGIN}user name="), role, F.lit("\n")))
    return head, F.concat(text, F.lit(END))


def _plain(value: Column) -> Column:
    return F.replace(value, F.lit("<|"), F.lit("< |"))


def _offsets(turns: DataFrame, speakers: DataFrame) -> DataFrame:
    """(bm_conv, speaker, part, offset): characters of the dialogue before each part, from lengths alone.

    They are added up within spans of parts, then over the spans' totals.
    """
    keys = ["bm_conv", "speaker"]
    told = turns.groupBy("bm_conv", "part", "role").agg(F.count("*").alias("bm_n"), F.sum(F.length("text").cast("long")).alias("bm_chars"))
    head, body = _rendered(F.col("role") == F.col("speaker"), F.col("role"), F.lit(""))
    size = F.sum(F.col("bm_chars") + F.col("bm_n") * (F.length(head) + F.length(body) + 1))
    sizes = told.join(speakers, "bm_conv").groupBy(*keys, "part").agg(size.alias("bm_size")).withColumn("bm_span", F.floor(F.col("part") / SPAN_PARTS))
    w = Window.partitionBy(*keys, "bm_span").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inner = sizes.withColumn("bm_inner", F.coalesce(F.sum("bm_size").over(w), F.lit(0)))
    w = Window.partitionBy(*keys).orderBy("bm_span").rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy(*keys, "bm_span").agg(F.sum("bm_size").alias("bm_size"))
    outer = totals.select(*keys, "bm_span", F.coalesce(F.sum("bm_size").over(w), F.lit(0)).alias("bm_outer"))
    return inner.join(outer, [*keys, "bm_span"]).select(*keys, "part", (F.col("bm_inner") + F.col("bm_outer")).alias("offset"))


def rotate_perspectives(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, speaker, part, offset, n_turns, n_own, text, masks) for every participant and part.

    ``masks`` are structs (start, stop) of characters of ``text``, one for each
    of the speaker's own turns: its words and the end mark.  ``offset`` is the
    number of characters of the whole rendering before the part.  Turns are
    ordered by turn number (null last), then role, then text; equal rows all
    stay.  Parts are numbered by turn number.  A null role is the speaker
    ``unknown``, a null text is empty, and rows without conv_id are one
    conversation whose conv_id is null.  Texts of any length stay whole.  Other
    columns are ignored; an empty table gives an empty result.
    """
    part = F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(_LAST)).cast("long")
    turns = conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")).alias("bm_conv"),
        "conv_id",
        part.alias("part"),
        F.coalesce(F.col("turn").cast("long"), F.lit(_LAST)).alias("turn"),
        F.translate(_plain(F.coalesce("role", F.lit("unknown"))), "\r\n", "  ").alias("role"),
        _plain(F.coalesce("text", F.lit(""))).alias("text"),
    )
    speakers = turns.select("bm_conv", F.col("role").alias("speaker")).distinct()
    head, body = _rendered(F.col("role") == F.col("speaker"), F.col("role"), F.col("text"))
    told = turns.join(speakers, "bm_conv").select("conv_id", "bm_conv", "speaker", "part", F.struct("turn", "role", "text", head.alias("head"), body.alias("body"), (F.col("role") == F.col("speaker")).alias("own")).alias("bm_turn"))
    grouped = told.groupBy("bm_conv", "speaker", "part").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list("bm_turn")).alias("bm_turns"))
    spot = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("masks"))

    def step(s: Column, t: Column) -> Column:
        start = s["at"] + F.length(t["head"])
        stop = start + F.length(t["body"])
        masks = F.when(t["own"], F.concat(s["masks"], F.array(F.struct(start.alias("start"), stop.alias("stop"))))).otherwise(s["masks"])
        return F.struct((stop + 1).alias("at"), masks.alias("masks"))

    text = F.array_join(F.transform("bm_turns", lambda t: F.concat(t["head"], t["body"], F.lit("\n"))), "")
    parts = grouped.select(
        "bm_conv",
        "conv_id",
        "speaker",
        "part",
        F.size("bm_turns").cast("long").alias("n_turns"),
        F.size(F.filter("bm_turns", lambda t: t["own"])).cast("long").alias("n_own"),
        text.alias("text"),
        F.aggregate("bm_turns", spot, step, lambda s: s["masks"]).alias("masks"),
    )
    return parts.join(_offsets(turns, speakers), ["bm_conv", "speaker", "part"]).select("conv_id", "speaker", "part", "offset", "n_turns", "n_own", "text", "masks")
