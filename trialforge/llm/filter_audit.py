"""Audit of how filters interact when they are applied in different orders.

Every document gets a mask of the filters that it fails.  Documents with the same part, mask
and labels are one cell, counted before any order is looked at.  Each cell then folds across
the array of all orders with ``transform`` and ``aggregate``: a struct for each step of each
order, weighted by the cell's count.  The structs of all cells of a part are merged by
elementwise sums.  A part has at most 2**filters * 4 cells, so the fold costs the same for
ten and ten billion documents, and the array of orders is a literal that travels with the plan.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

FILTERS = "ABCDE"
LEAST_WORDS = 200  # A: fewer words fail
DISTINCT_SHARE = 50  # B: fewer distinct words, in percent of the words, fail
CAPITAL_SHARE = 3  # C: more capitals, in percent of the code points, fail
MARKS = r"[#$%&*|]"  # D: a text that holds one fails
SPACE_RUN = r"[\x20\x09-\x0D]+"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_checks(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``id``, ``part``, ``digest`` of the text and ``mask`` of filters A to D, one row for each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"),
        F.array_remove(F.split(text, SPACE_RUN), "").alias("words"),
    )
    counted = read.select(
        "id", "part", "text", F.size("words").cast("long").alias("words"), F.size(F.array_distinct("words")).cast("long").alias("distinct"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("capitals"), F.length("text").cast("long").alias("points"),
    )
    fails = [
        F.col("words") < LEAST_WORDS,
        100 * F.col("distinct") < DISTINCT_SHARE * F.col("words"),
        100 * F.col("capitals") > CAPITAL_SHARE * F.col("points"),
        F.col("text").rlike(MARKS),
    ]
    mask = reduce(lambda a, b: a + b, [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)])
    return counted.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Count ``n`` of documents by ``part``, ``mask``, ``good`` and ``toxic``.

    Only narrow rows (id, part, a 256-bit digest of the text, a mask) leave the scan of the
    texts.  The joins with first ids and labels have one row on the other side for each key, each behind
    an exchange of its own, so that adaptive execution splits hot texts and ids.
    """
    narrow = checkpointed(text_checks(docs, id_col, text_col, part_col))
    # One row for each text that occurs again; counted before the shuffle.
    again = checkpointed(narrow.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("rows")).where("rows > 1").select("digest", "first_id"))
    marks = checkpointed(
        labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id"))
        .agg((F.max("quality") == 1).alias("good"), (F.max(F.col("toxic")) == 1).alias("toxic"))
        .where(F.col("good") | F.col("toxic"))
    )
    repeats = F.coalesce(F.col("first_id") < F.col("id"), F.col("first_id").isNotNull() & F.col("id").isNull())
    full_mask = F.col("mask") + F.when(repeats, F.lit(1 << 4)).otherwise(F.lit(0))
    joined = narrow.join(again, "digest", "left").select("id", "part", full_mask.alias("mask"))
    joined = joined.join(marks, joined["id"] == marks["label_id"], "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return joined.select("part", "mask", flag("good"), flag("toxic")).groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))


def orders(filters: str = FILTERS) -> Column:
    """All orders of the filters, as an array of (filter_order, bits of its filters)."""
    rows = [F.struct(F.lit("".join(o)).alias("filter_order"), F.array(*[F.lit(1 << filters.index(f)) for f in o]).alias("bits")) for o in itertools.permutations(filters)]
    return F.array(*rows)


def folded(cell: DataFrame, filters: str = FILTERS) -> Column:
    """The structs of one cell: one for each order and step, weighted by the cell's count ``n``."""
    n, zero = F.col("n"), F.lit(0).cast("long")

    def step(state: Column, bit: Column) -> Column:
        fails, gone = F.col("mask").bitwiseAND(bit) > 0, state["gone"]
        here = fails & ~gone
        count = lambda condition, name: F.when(condition, n).otherwise(zero).alias(name)
        entry = F.struct(
            (F.size(state["steps"]) + 1).alias("step"), count(~(gone | fails), "kept"), count(here, "removed"), count(fails & gone, "redundant"),
            count(F.col("mask") == bit, "unique_fails"), count(here & F.col("good"), "good_lost"), count(here & F.col("toxic"), "toxic_lost"),
        )
        return F.struct((gone | fails).alias("gone"), F.concat(state["steps"], F.array(entry)).alias("steps"))

    entries = "array<struct<step:int," + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"
    start = F.struct(F.lit(False).alias("gone"), F.array().cast(entries).alias("steps"))
    return F.transform(
        orders(filters), lambda o: F.struct(o["filter_order"].alias("filter_order"), F.aggregate(o["bits"], start, step)["steps"].alias("steps"))
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What each filter does at each step of each order: 600 rows for each part, zeros included.

    Null texts and parts are empty strings.  A document fails E when a smaller id has the same
    text; a null id is larger than all others, and rows that repeat both id and text don't make each other
    fail.  A label counts when any of the id's rows in ``labels`` has it; ids without labels
    lose nothing.  ``shapley`` is what the step's filter removes, summed over all orders.
    Columns besides id, text and part are not read.  An empty table gives no rows.
    """
    found = cells(docs, labels, id_col, text_col, part_col)
    by_order = found.select("part", F.explode(folded(found)).alias("o")).select("part", "o.filter_order", F.explode("o.steps").alias("s"))
    merged = by_order.groupBy("part", "filter_order", F.col("s.step").alias("step")).agg(*[F.sum(f"s.{c}").alias(c) for c in COUNTS])
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    over_orders = Window.partitionBy("part", letter)  # 120 rows for each
    return merged.select("part", "filter_order", "step", *COUNTS, F.sum("removed").over(over_orders).alias("shapley"))
