"""Rules of a session, followed attempt by attempt.

A participant's attempts, in order, drive a state machine: a fold over an array of structs.
It gives what the session led to and the first rule that the log breaks.  Rules bound how many
attempts a session may have, so the attempts up to one more decide, and later ones are dropped
before the shuffle by a limit on their rank; a key with any number of rows costs no more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The calibration levels, and the tries on the first of them.
LEVELS = (7, 9, 11, 13, 15, 17, 19)
FIRST_TRIES = 10
# A block of training, the blocks allowed, and the criterion inside a block.
BLOCK_TRIALS, MOST_BLOCKS = 30, 5
WINDOW, NEEDED = 20, 17

AFTER_END, WRONG_LEVEL, NO_OUTCOME = "attempt after the end", "wrong level", "outcome missing"
WRONG_BLOCK = "wrong block"


def _fold(
    df: DataFrame, keys: list[str], order: list[str], attempt: dict[str, Column], most: int,
    start: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column]],
) -> DataFrame:
    """Folds ``step`` over the first ``most`` + 1 attempts of each key.

    ``step(state, attempt)`` gives the new state and the rule that the attempt breaks, or null;
    from the first broken rule on the state stands still.  ``attempts`` counts those that kept the rules.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    first = df.select(*keys, *order, *[c.alias(f"_a_{n}") for n, c in attempt.items()]).withColumn("_rank", rank).where(F.col("_rank") <= most + 1)
    listed = first.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_rank", *[f"_a_{n}" for n in attempt]))),
            lambda a: F.struct(*[a[f"_a_{n}"].alias(n) for n in attempt]),
        ).alias("_attempts")
    )
    zero = F.lit(0).cast("int")
    initial = {**start, "ended": F.lit(False), "attempts": zero, "broken": F.lit(None).cast("string")}

    def named(values: dict[str, Column]) -> Column:
        return F.struct(*[values[n].alias(n) for n in initial])

    def guarded(state: Column, a: Column) -> Column:
        new, broken = step(state, a)
        broken = F.when(state["ended"], F.lit(AFTER_END)).otherwise(broken)
        moved = named({**{n: state[n] for n in initial}, **new, "attempts": state["attempts"] + 1})
        stopped = named({**{n: state[n] for n in initial}, "broken": broken})
        return F.when(state["broken"].isNotNull(), state).when(broken.isNotNull(), stopped).otherwise(moved)

    return listed.select(*keys, F.aggregate("_attempts", named(initial), guarded).alias("_s"))


def _outcome(folded: DataFrame, keys: list[str], results: dict[str, Column]) -> DataFrame:
    broken = F.col("_s.broken")
    return folded.select(
        *keys, *[c.alias(n) for n, c in results.items()], F.col("_s.attempts").alias("attempts"),
        (F.col("_s.ended") & broken.isNull()).alias("finished"), broken.alias("broken_rule"),
        F.when(broken.isNotNull(), F.col("_s.attempts") + 1).alias("broken_at"),
    )


def follow_calibration(
    df: DataFrame, keys: list[str], order: list[str], level: str, passed: Column,
    levels: tuple[int, ...] = LEVELS, first_tries: int = FIRST_TRIES,
) -> DataFrame:
    """Set point of each participant by the rules of the calibration.

    Levels come one after the other.  The first may be tried ``first_tries`` times; any other
    failure ends the sequence, and so does passing the last level.  Returns ``set_point`` (the last
    level passed by the rules, else null), ``attempts``, ``finished`` (ended, with no rule broken),
    ``broken_rule`` and ``broken_at``, the place of the attempt that breaks it.  ``order`` must
    order a participant's attempts completely.
    """
    levels_array, zero = F.array(*[F.lit(v).cast("long") for v in levels]), F.lit(0).cast("int")

    def step(state: Column, a: Column) -> tuple[dict[str, Column], Column]:
        expected = F.try_element_at(levels_array, state["at"] + 1)
        rule = F.when(~a["level"].eqNullSafe(expected), F.lit(WRONG_LEVEL)).when(a["passed"].isNull(), F.lit(NO_OUTCOME))
        tries = state["tries"] + F.when(a["passed"], 0).otherwise(1)
        return {
            "at": state["at"] + F.when(a["passed"], 1).otherwise(0),
            "tries": tries,
            "best": F.when(a["passed"], a["level"]).otherwise(state["best"]),
            "ended": F.when(a["passed"], state["at"] + 1 >= len(levels)).otherwise((state["at"] > 0) | (tries >= first_tries)),
        }, rule

    start = {"at": zero, "tries": zero, "best": F.lit(None).cast("long")}
    attempt = {"level": F.col(level).cast("long"), "passed": passed}
    folded = _fold(df, keys, order, attempt, first_tries + len(levels) - 1, start, step)
    return _outcome(folded, keys, {"set_point": F.col("_s.best")})


def follow_training(
    df: DataFrame, keys: list[str], order: list[str], block: str, correct: str,
    block_trials: int = BLOCK_TRIALS, most_blocks: int = MOST_BLOCKS, window: int = WINDOW, needed: int = NEEDED,
) -> DataFrame:
    """How far each participant's training goes by its rules.

    Trials come in blocks 1, 2, ... of ``block_trials``.  Training ends with the trial after which
    ``needed`` of the last ``window`` trials of the block are correct, and with the last trial of block
    ``most_blocks``.  Returns ``criterion_trial`` (the trial that reached the criterion, else
    null), ``blocks``, ``attempts`` (trials by the rules), ``finished``, ``broken_rule`` and ``broken_at``.
    """
    zero = F.lit(0).cast("int")
    outcomes = "array<int>"

    def step(state: Column, a: Column) -> tuple[dict[str, Column], Column]:
        opens = state["trial"] == block_trials
        expected = F.when(opens | (state["blocks"] == 0), state["blocks"] + 1).otherwise(state["blocks"])
        rule = F.when(~a["block"].eqNullSafe(expected), F.lit(WRONG_BLOCK)).when(a["correct"].isNull(), F.lit(NO_OUTCOME))
        trial = F.when(opens, 1).otherwise(state["trial"] + 1)
        recent = F.concat(F.when(opens, F.array().cast(outcomes)).otherwise(state["recent"]), F.array(a["correct"]))
        recent = F.slice(recent, F.greatest(F.size(recent) - window + 1, F.lit(1)), F.lit(window))
        reached = F.aggregate(recent, zero, lambda s, x: s + F.coalesce(x, zero)) >= needed
        return {
            "blocks": expected, "trial": trial, "recent": recent,
            "criterion": F.when(reached, state["attempts"] + 1),
            "ended": reached | ((expected == most_blocks) & (trial == block_trials)),
        }, rule

    start = {"blocks": zero, "trial": zero, "recent": F.array().cast(outcomes), "criterion": F.lit(None).cast("int")}
    attempt = {"block": F.col(block).cast("int"), "correct": F.col(correct).cast("int")}
    folded = _fold(df, keys, order, attempt, most_blocks * block_trials, start, step)
    return _outcome(folded, keys, {"criterion_trial": F.col("_s.criterion"), "blocks": F.col("_s.blocks")})
