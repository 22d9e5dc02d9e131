"""Shards by jump consistent hashing, in DataFrame functions only.

A key's shard comes from the key and the number of shards alone, without a table of shards: a
linear congruential generator, started at the key's hash, draws how far the key jumps before it moves
again as shards are appended.  With one more shard, a key stays or goes to the new shard.
Places inside a shard come from a fixed order by hash, cut into buckets that are numbered side
by side and moved by the rows before them.  Equal rows are one unit with a count until they are
numbered, so a row that is repeated often is neither sorted nor shuffled often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, partitions

LAW = "key"
SHARDS = 8
# Fixed value: the multiplier of the generator in the published algorithm, as two halves of 32 bits.
MULTIPLIER_HIGH, MULTIPLIER_LOW = 0x27BB2EE6, 0x87B0B0FD
LOW_16, LOW_32 = 0xFFFF, 0xFFFFFFFF
USUAL_JUMPS = 48  # a key jumps about ln(shards) times; the few that jump more often go on to the end
REPEATS_AT_ONCE = 1 << 20  # copies of one row that one row of a task is unfolded to


def low_product(a: Column, b: int) -> Column:
    """a * b modulo 2**32 for a and b below 2**32; no step leaves 64 bits."""
    upper = F.shiftleft((F.shiftright(a, 16) * b).bitwiseAND(F.lit(LOW_16)), 16)
    return (a.bitwiseAND(F.lit(LOW_16)) * b + upper).bitwiseAND(F.lit(LOW_32))


def next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """The generator's next 64 bits, as two halves below 2**32: state * multiplier + 1."""
    first = low.bitwiseAND(F.lit(LOW_16)) * MULTIPLIER_LOW + 1
    second = F.shiftright(low, 16) * MULTIPLIER_LOW
    whole = first + F.shiftleft(second.bitwiseAND(F.lit(LOW_16)), 16)
    carried = F.shiftright(whole, 32) + F.shiftright(second, 16)
    return (carried + low_product(high, MULTIPLIER_LOW) + low_product(low, MULTIPLIER_HIGH)).bitwiseAND(F.lit(LOW_32)), whole.bitwiseAND(F.lit(LOW_32))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, of a key of 64 bits.

    Each jump goes up by one shard at least, so ``shards`` steps are enough for every key.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")

    def step(state: Column, _: Column) -> Column:
        high, low = next_state(state["high"], state["low"])
        jump = F.floor((state["to"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1)))
        go_on = state["to"] < shards
        pick = lambda new, old: F.when(go_on, new).otherwise(old)
        return F.struct(
            pick(high, state["high"]).alias("high"), pick(low, state["low"]).alias("low"),
            pick(state["to"], state["at"]).alias("at"), pick(jump, state["to"]).alias("to"),
        )

    zero = F.lit(0).cast("long")
    start = F.struct(F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(LOW_32)).alias("low"), zero.alias("at"), zero.alias("to"))
    fold = lambda state, steps: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step)
    if shards <= USUAL_JUMPS:
        return fold(start, shards)["at"].cast("int")
    usual = fold(start, USUAL_JUMPS)
    return F.when(usual["to"] >= shards, usual["at"]).otherwise(fold(usual, shards)["at"]).cast("int")


def number_of(text: Column) -> Column:
    """A 64-bit number for a text: the first half of its MD5 digest, the same on every engine."""
    return F.conv(F.substring(F.md5(text), 1, 16), 16, -10).cast("long")


def key_number(key: Column) -> Column:
    """The number that a key of any type is dealt by; null is a key like the empty text."""
    return number_of(F.coalesce(key.cast("string"), F.lit("")))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``size`` (bytes of the text in UTF-8 plus 1; null has none) and ``text_crc32``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def sharded(rows: DataFrame, key_col: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """All ``rows`` with ``law``, ``shard``, ``slot`` and ``grown_shard``, which take the place of columns so named.

    ``slot`` numbers the rows of a shard from 0 without gaps, in an order by hash that depends
    on the rows alone.  ``grown_shard`` is the shard with one shard more.  All rows of a key share a
    shard; null is a key like the empty text.  Equal texts aren't held together, as the key alone decides.
    Columns must be of types that can be grouped and cast to text.  An empty table gives an empty table.
    """
    added = {"law", "shard", "slot", "grown_shard"}
    columns = [c for c in rows.columns if c.lower() not in added]
    kept = [F.col(f"`{c}`") for c in columns]
    row = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(kept)])
    units = checkpointed(rows.select(row.alias("row"), key_number(F.col(f"`{key_col}`")).alias("key")).groupBy("row", "key").agg(F.count("*").alias("times")))
    total = units.count()
    placed = units.select("row", "times", jump_hash(F.col("key"), shards).alias("shard"), jump_hash(F.col("key"), shards + 1).alias("grown_shard"), number_of(F.concat_ws("\x1f", *[F.col("row")[c].cast("string") for c in units.schema["row"].dataType.names])).alias("draw"))
    # Buckets of the order, enough for all tasks and small enough for one.
    buckets = max(1, 4 * partitions(rows.sparkSession) // shards, total // (shards * 200_000))
    bucket = F.floor((F.shiftright(F.col("draw"), 11) + F.lit(1 << 52)) / F.lit(float(1 << 53)) * buckets)
    placed = checkpointed(placed.withColumn("bucket", F.least(bucket, F.lit(buckets - 1))))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("shard", "bucket").agg(F.sum("times").alias("rows")).select(
        "shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("draw", "row").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("start", F.coalesce(F.sum("times").over(inside), F.lit(0))).join(checkpointed(sizes), ["shard", "bucket"])
    numbered = numbered.select("row", "times", "shard", "grown_shard", (F.col("start") + F.col("offset")).alias("start"))
    few = numbered.where(F.col("times") <= REPEATS_AT_ONCE).withColumn("first", F.lit(0).cast("long"))
    many = numbered.where(F.col("times") > REPEATS_AT_ONCE).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(REPEATS_AT_ONCE).cast("long"))))
    chunks = few.unionByName(many.repartition("start", "first"))
    last = F.least(F.col("first") + REPEATS_AT_ONCE, F.col("times")) - 1
    unfolded = chunks.select("row", "shard", "grown_shard", "start", F.explode(F.sequence("first", last)).alias("copy"))
    return unfolded.select(
        *[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(columns)],
        F.lit(LAW).alias("law"), "shard", (F.col("start") + F.col("copy")).alias("slot"), "grown_shard",
    )


def write_shards(rows: DataFrame, path: str, key_col: str = "doc_id", shards: int = SHARDS) -> None:
    """``rows`` as Parquet in one folder for each shard; a shard is cut over several files by the session's file size."""
    shard = jump_hash(key_number(F.col(f"`{key_col}`")), shards)
    dealt = rows.withColumn("shard", shard)
    dealt.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
