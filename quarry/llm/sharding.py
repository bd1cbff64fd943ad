"""Sharding by jump consistent hashing, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import spread_rank, written

SHARDS = 24
#: The multiplier of the generator that jump consistent hashing draws from, as halves of 32 bits.
MULTIPLIER = 2862933555777941757
HIGH, LOW, MASK = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF, 0xFFFFFFFF


def _times(x: Column, c: int) -> tuple[Column, Column]:
    """x * c for x and c below 2**32, as a sum whose parts don't overflow in ANSI mode: (below 2**49, times 2**32)."""
    low, high = x.bitwiseAND(F.lit(0xFFFF)) * F.lit(c), F.shiftright(x, 16) * F.lit(c)
    return low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16), F.shiftright(high, 16)


def _drawn(s: Column) -> Column:
    """The generator's next state, as struct(hi, lo)."""
    low, carry = _times(s["lo"], LOW)
    low = low + F.lit(1)
    high = carry + F.shiftright(low, 32) + _times(s["hi"], LOW)[0] + _times(s["lo"], HIGH)[0]
    return F.struct(high.bitwiseAND(F.lit(MASK)).alias("hi"), low.bitwiseAND(F.lit(MASK)).alias("lo"))


def key_halves(key: Column) -> Column:
    """struct(hi, lo): the first 64 bits of the md5 of a key's text, so that keys of any type are spread; null counts as an empty one."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return F.struct(half(1).alias("hi"), half(9).alias("lo"))


def halves(key: Column) -> Column:
    """struct(hi, lo) of a long."""
    return F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(MASK)).alias("lo"))


def jump(key: Column, shards: int) -> Column:
    """struct(shard, grown): where the key, a struct(hi, lo), goes among so many shards, and among one more.

    Each jump goes up by one at least, so one step a shard is enough; a finished state is carried on as it is.
    """
    long = lambda x: F.lit(x).cast("long")
    start = F.struct(key["hi"].alias("hi"), key["lo"].alias("lo"), long(0).alias("shard"), long(0).alias("grown"), long(0).alias("to"))

    def step(s: Column, _: Column) -> Column:
        def jumped(d: Column) -> Column:
            # the draw is the state's upper 31 bits
            to = F.floor((s["to"] + 1) * (F.lit(2147483648.0) / (F.shiftright(d["hi"], 1) + 1)))
            return F.struct(d["hi"], d["lo"], F.when(s["to"] < shards, s["to"]).otherwise(s["shard"]).alias("shard"), s["to"].alias("grown"), to.alias("to"))

        return F.when(s["to"] <= shards, F.transform(F.array(_drawn(s)), jumped)[0]).otherwise(s)

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step, lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, size (UTF-8 bytes of the text and 8), text_crc32, law, shard, slot, grown_shard.

    The law is `key`: a document's id and the number of shards decide its shard; one more shard takes documents only
    into itself. Ids of any type are hashed by their text first, so close ids don't go together. A null id counts as an
    empty one; a null text is empty.
    Rows with the same id go to the same shard, each with a slot of its own; repeated rows may swap slots. Slots go from
    0 without gaps within each shard, ordered by the ids' md5. An empty table gives an empty result.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    to = F.transform(F.array(key_halves(F.col(key))), lambda k: jump(k, shards))[0]
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(whole) + 8).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), to.alias("_to"))
    rows = written(rows.select("doc_id", "size", "text_crc32", "_to.shard", F.col("_to.grown").alias("grown_shard")), "shards")
    ranked = spread_rank(rows, ["shard"], ["doc_id", "size", "text_crc32"])
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("rank").alias("slot"), "grown_shard")
