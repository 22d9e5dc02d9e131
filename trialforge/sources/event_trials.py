"""The event table seen as a trial log, so that every operator runs on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import number_and_roll

BLOCK_TRIALS = 5
CRITERION_TRIALS = 20
FULL_LENGTH = 15
CRITERION = 12

TRAINING, TEST = "CfuncMixed", "CfuncTest"
PHASES = ["Crel", "CfuncDirection", "CfuncSpeed", "CfuncMixed", "CfuncTest"]

# Scaled-down stand-ins for the columns of a trial log.
_COLUMNS = {
    "unique_id": "user_id",
    "experiment_no": "CAST(user_id % 5 AS INT) + 1",
    "condition": "CASE user_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE '2a' END",
    "age": "18 + CAST(user_id % 40 AS INT)",
    "gender": "CASE WHEN user_id % 2 = 0 THEN 'female' ELSE 'male' END",
    "phase": """CASE WHEN event_type = 'click' THEN 'Crel'
        WHEN event_type = 'view' THEN 'CfuncDirection'
        WHEN event_type = 'error' THEN 'CfuncSpeed'
        WHEN event_type = 'purchase' THEN 'CfuncMixed'
        WHEN user_id % 4 = 0 THEN 'Generalisation' ELSE 'CfuncTest' END""",
    "is_test": "CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END",
    "correct": "CASE WHEN value < 60 THEN 1 ELSE 0 END",
    "accurate": "CASE WHEN value < 60 AND event_id % 11 <> 0 THEN 1 ELSE 0 END",
    "optimal_choice": "CASE WHEN value < 60 THEN '1' ELSE '0' END",
    "duration": "value * 10",
    "remaining": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 3 AS INT) END",
    "response": """CASE event_id % 6 WHEN 0 THEN 'relation1select' WHEN 1 THEN 'relation2select'
        WHEN 2 THEN 'r1d1select' WHEN 3 THEN 'r1d2select' WHEN 4 THEN 'r2d1select'
        ELSE 'r2d2select' END""",
    "correct_response": """CASE event_id % 4 WHEN 0 THEN 'relation1select' WHEN 1 THEN 'r1d1select'
        WHEN 2 THEN 'r1d2select' ELSE 'relation2select' END""",
    "relation1": "CASE WHEN event_id % 5 < 3 THEN '0.5,0,0' ELSE '1,0,50' END",
    "relation2": "CASE WHEN event_id % 5 < 3 THEN '1.5,0,0' ELSE '1,0,-40' END",
    "r1d1": "CASE WHEN event_id % 5 < 3 THEN '0.25,0,0' ELSE '1,0,100' END",
    "r1d2": "CASE WHEN event_id % 5 < 3 THEN '0.5,0,50' ELSE '0.5,0,-40' END",
    "r2d1": "CASE WHEN event_id % 5 < 3 THEN '2.25,0,0' ELSE '1.5,0,50' END",
    "r2d2": "CASE WHEN event_id % 5 < 3 THEN '1.5,0,-40' ELSE '1,0,-45' END",
    "set_point": "CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE '9.0' END",
    "x_2": "CASE WHEN user_id % 6 = 0 THEN NULL ELSE concat('means ', CAST(user_id % 4 AS STRING)) END",
    "pointGap": "CAST(event_id % 3 - 1 AS DOUBLE)",
    "bubbleGap": "CAST(event_id % 4 - 1 AS DOUBLE)",
    "pointLoss": "CAST(event_id % 9 AS DOUBLE)",
    "exclude_data": "CASE WHEN event_id % 17 = 0 THEN 'yes' ELSE 'no' END",
}

# The six option columns again, as cues.
CUES = {
    f"{option}select": f"cue_{option}" for option in ("relation1", "relation2", "r1d1", "r1d2", "r2d1", "r2d2")
}


def event_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial rows without the columns that depend on trial order: a pure projection."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr("event_id", "ts", *[f"{e} AS {n}" for n, e in _COLUMNS.items()])


def ordered_event_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial rows with trial number, block and the trailing count of correct responses."""
    trials = event_trials(spark, sf_dir)
    numbered = number_and_roll(
        trials, ["unique_id", "phase"], ["ts", "event_id"], "trial_n",
        ("correct", CRITERION_TRIALS, "criterion"),
    )
    return numbered.withColumn("block", F.floor((F.col("trial_n") - 1) / BLOCK_TRIALS) + 1)


def with_cues(trials: DataFrame) -> DataFrame:
    return trials.withColumns({cue: F.col(cue.removeprefix("cue_")) for cue in CUES.values()})
