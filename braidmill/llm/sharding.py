"""Sharding by jump consistent hashing, with DataFrame functions only.

The jump hash moves a key from shard to shard as shards are appended: from
shard b the next jump goes to floor((b + 1) / u), where u is the next number of
the key's own pseudo-random sequence in (0, 1].  The last jump below the shard
count is the key's shard.  So no table of a ring is needed, and with one more
shard a key either stays or moves into the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, quoted

SHARDS = 24
#: Parts of a shard that number their rows in tasks of their own.
PARTS = 64
#: Rows that one of these tasks numbers; more rows get more parts.
PART_ROWS = 1_000_000
_RANGE = 1 << 52


def _uniform(key: Column, step: Column) -> Column:
    """Number ``step`` of the key's sequence, in (0, 1]; 52 bits of a digest."""
    head = F.substring(F.md5(F.concat(key, F.lit(":"), step.cast("string"))), 1, 13)
    return (F.conv(head, 16, 10).cast("long") + 1) / F.lit(float(_RANGE))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a string key among ``shards``.

    A jump goes up by at least one, so ``shards`` steps always suffice; about
    ln(shards) of them draw a number, the others pass the state on.
    """
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(s: Column, i: Column) -> Column:
        moved = F.struct(s["j"].alias("b"), F.floor((s["j"] + 1) / _uniform(key, i)).alias("j"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def _key(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, *carry) of every row.

    A carried column called like one of the others gets underscores behind its name.

    ``doc_id`` and the shard count decide the shard (law ``key``); a null id is
    a key of its own.  ``grown_shard`` is the shard among ``shards + 1``.
    ``size`` is the text's UTF-8 bytes plus 8 and ``text_crc32`` its checksum;
    a null text counts as empty.  ``slot`` numbers the rows of a shard from 0
    without gaps: parts of the shard in turn (the id's digest names the part,
    the checksum splits the rows of one id), inside by doc_id, checksum and size.  Repeated rows get slots of
    their own.  Columns outside ``carry`` are dropped; an empty table gives an
    empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = _key("doc_id")
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(key, shards).alias("shard"),
        jump_hash(key, shards + 1).alias("grown_shard"),
        F.struct(F.lit(0).alias("bm_none"), *[quoted(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("bm_carry"),
    )
    parts = max(PARTS, -(-docs.count() // (shards * PART_ROWS)))
    part = F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") + F.col("text_crc32"), F.lit(parts)).cast("int")
    rows = rows.withColumn("bm_part", part)
    counts = rows.groupBy("shard", "bm_part").agg(F.count("*").alias("bm_n"))  # a row per shard and part: one per PART_ROWS rows of docs, or shards * PARTS
    before = F.coalesce(F.sum("bm_n").over(Window.partitionBy("shard").orderBy("bm_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("shard", "bm_part", before.alias("bm_start")))
    within = F.row_number().over(Window.partitionBy("shard", "bm_part").orderBy("doc_id", "text_crc32", "size")) - 1
    out = rows.withColumn("bm_row", within).join(starts, ["shard", "bm_part"])
    slot = (F.col("bm_start") + F.col("bm_row")).cast("long").alias("slot")
    names = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    carried = []
    for i, c in enumerate(carry):
        names.append(free_name(names, c))
        carried.append(F.col(f"bm_carry.c{i}").alias(names[-1]))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", slot, "grown_shard", *carried)
