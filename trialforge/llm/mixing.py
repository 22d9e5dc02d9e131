"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source has the same expected number of copies, target / size of the
source.  The whole part is given at once; the fractional part is a probability.  A bucket
folds over its documents: the pending document and the next one exchange words, in a random
direction whose odds keep both expectations, until one of them has no copy or a whole one.
So each bucket settles all its documents but one, and the words it takes change by nothing
else.  The pending documents of all buckets form the next level of the tree, and the last one
of a source goes to the nearer side, so that a source misses its target by half a document at
most.  A level shuffles a 64th of the rows of the level below.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, packed, replaced, unpacked, word_count

FAN_IN = 64
MOST = 3  # copies of a document, and the cap of a target in sizes of its source


def shares(sizes: DataFrame, weights: list[int] = (1, 2, 3), cap: int = MOST) -> DataFrame:
    """Targets of the sources in ``sizes`` (source, source_size, rows), one row for each source.

    Weights repeat over the sources by code point, null last.  The targets share the sum of
    all sizes by weight; a target stops at ``cap`` times its source's size and the excess goes
    to the others by weight.  Sources leave the sharing in the order of size / weight: source
    k is capped when an equal share, after all before it are capped, would exceed its cap.
    Expects a table of sources, a few columns wide, that one task can sort.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weights_left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (
        sizes.withColumn("weight", weight.cast("long"))
        .withColumn("level", left / weights_left)
        .withColumn("capped", F.col("level") * F.col("weight") > cap * F.col("source_size"))
    )
    first_free = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(every)
    return level.withColumn("free", first_free["level"]).select(
        "source", "source_size", "rows", "weight",
        F.when(F.col("source_size") == 0, F.lit(0.0))
        .otherwise(F.least(cap * F.col("source_size").cast("double"), F.coalesce(F.col("free"), F.col("level")) * F.col("weight")))
        .alias("target"),
    )


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(2**53))


def settle(units: DataFrame, level: int, seed: int) -> DataFrame:
    """One level of the tree: ``units`` with their new mass; one of each bucket is pending.

    A unit has ``weight`` words and ``mass`` in [0, weight], the words expected of it.
    """
    drawn = units.withColumn("draw", F.xxhash64("id", "size", F.lit(seed + level)))
    unit = F.struct("draw", "id", "size", "weight", "mass")
    buckets = drawn.groupBy("source", "bucket").agg(F.array_sort(F.collect_list(unit)).alias("units"))
    kind = buckets.schema["units"].dataType.elementType
    empty = F.array().cast(f"array<{kind.simpleString()}>")

    def moved(unit: Column, mass: Column) -> Column:
        return F.struct(unit["draw"].alias("draw"), unit["id"].alias("id"), unit["size"].alias("size"), unit["weight"].alias("weight"), mass.alias("mass"))

    def step(state: Column, new: Column) -> Column:
        old = state["pending"]
        up = F.least(old["weight"] - old["mass"], new["mass"])  # words that may go from new to old
        down = F.least(old["mass"], new["weight"] - new["mass"])  # and from old to new
        rise = uniform(old["draw"], new["draw"], F.lit(seed)) * (up + down) < down
        old_mass = F.when(rise, old["mass"] + up).otherwise(old["mass"] - down)
        new_mass = F.when(rise, new["mass"] - up).otherwise(new["mass"] + down)
        # Which of the two is settled is read from the step taken, so rounding can't leave both open.
        old_settled = F.when(rise, up == old["weight"] - old["mass"]).otherwise(down == old["mass"])
        settled_old = moved(old, F.when(rise, old["weight"]).otherwise(F.lit(0.0)))
        settled_new = moved(new, F.when(rise, F.lit(0.0)).otherwise(new["weight"]))
        done = F.when(old_settled, settled_old).otherwise(settled_new)
        pending = F.when(old_settled, moved(new, new_mass)).otherwise(moved(old, old_mass))
        return F.struct(F.concat(state["done"], F.array(done)).alias("done"), pending.alias("pending"))

    start = F.struct(empty.alias("done"), F.element_at("units", 1).alias("pending"))
    folded = buckets.withColumn("state", F.aggregate(F.slice("units", 2, F.size("units")), start, step))
    done = F.transform("state.done", lambda u: F.struct(u.alias("unit"), F.lit(False).alias("pending")))
    last = F.array(F.struct(F.col("state.pending").alias("unit"), F.lit(True).alias("pending")))
    return folded.select("source", "bucket", F.explode(F.concat(done, last)).alias("out")).select(
        "source", "bucket", "out.unit.id", "out.unit.size", "out.unit.weight", "out.unit.mass", "out.pending"
    )


def round_copies(units: DataFrame, most_in_source: int, seed: int = 17, fan_in: int = FAN_IN) -> DataFrame:
    """``units`` (source, id, size, weight, mass, rows) with ``extra`` 0 or 1, by the tree."""
    buckets = F.ceil(F.col("rows") / fan_in)
    bucketed = units.withColumn("bucket", F.pmod(F.xxhash64("id", "size", F.lit(seed)), buckets))
    settled, open_, level = [], bucketed.drop("rows"), 0
    width = max(1, math.ceil(most_in_source / fan_in))
    while True:
        out = checkpointed(settle(open_, level, seed))
        settled.append(out.where(~F.col("pending")))
        open_ = out.where("pending")
        if width == 1:
            break
        level, width = level + 1, math.ceil(width / fan_in)
        open_ = open_.withColumn("bucket", F.floor(F.col("bucket") / fan_in)).drop("pending")
    last = open_.withColumn("mass", F.when(F.col("mass") * 2 >= F.col("weight"), F.col("weight")).otherwise(0.0))
    whole = last
    for frame in settled:
        whole = whole.unionByName(frame)
    return whole.select("source", "id", "size", (F.col("mass") > 0).cast("long").alias("extra"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: list[int] = (1, 2, 3), seed: int = 17) -> DataFrame:
    """All rows of ``docs`` with the copies that the mix takes of each.

    Adds ``size`` (words of the text; null: 0), ``source_size``, ``target``, ``copies`` and
    ``taken`` (copies * size), which take the place of columns so named.  Null is a source of
    its own.  A document without words has no copies.  Rows that repeat id, source and size
    are one unit and get the same number of copies.  Results depend on the rows and ``seed``
    alone.  An empty table gives an empty table.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    rows = docs.select(packed(docs, added).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    slim = checkpointed(rows.groupBy("source", "id", "size").agg(F.count("*").alias("times")))
    copies = copies_of(slim, weights, seed)
    same = [rows[c].eqNullSafe(copies[c]) for c in ("source", "id", "size")]
    joined = rows.join(copies, same[0] & same[1] & same[2])
    return joined.select(
        *unpacked(rows, "row"), rows["size"], "source_size", "target", "copies", (F.col("copies") * rows["size"]).alias("taken")
    )


def copies_of(slim: DataFrame, weights: list[int] = (1, 2, 3), seed: int = 17) -> DataFrame:
    """The copies of each unit of ``slim`` (source, id, size, times), with its source's figures."""
    sizes = slim.groupBy("source").agg(
        F.sum(F.col("size") * F.col("times")).alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("rows")
    )
    targets = checkpointed(shares(sizes, weights))
    most = targets.agg(F.max("rows")).first()[0] or 1
    per_word = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # No hint: the table of sources is broadcast by its measured size, and else its rows are dealt with skew split.
    units = slim.join(targets, slim["source"].eqNullSafe(targets["source"])).select(
        slim["source"], "id", "size", "source_size", "target", "rows",
        (F.col("size") * F.col("times")).cast("double").alias("weight"),
        F.least(F.floor(per_word), F.lit(MOST)).alias("whole"),
        (per_word - F.floor(per_word)).alias("part"),
    )
    tree = units.where("size > 0 AND part > 0").select("source", "id", "size", "weight", "rows", (F.col("weight") * F.col("part")).alias("mass"))
    rounded = round_copies(tree, most, seed)
    same = [units[c].eqNullSafe(rounded[c]) for c in ("source", "id", "size")]
    return units.join(rounded, same[0] & same[1] & same[2], "left").select(
        units["source"], units["id"], units["size"], "source_size", "target",
        F.when(units["size"] > 0, F.col("whole") + F.coalesce("extra", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("copies"),
    )
