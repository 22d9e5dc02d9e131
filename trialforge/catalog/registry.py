"""Registered queries: a Spark callable and, where SQL can say it, the same in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The event table as a trial log, in SQL.
TRIALS = """
t AS (
  SELECT event_id, ts, user_id AS unique_id,
    CAST(user_id % 5 AS INT) + 1 AS experiment_no,
    CASE user_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE '2a' END AS condition,
    18 + CAST(user_id % 40 AS INT) AS age,
    CASE WHEN user_id % 2 = 0 THEN 'female' ELSE 'male' END AS gender,
    CASE WHEN event_type = 'click' THEN 'Crel'
         WHEN event_type = 'view' THEN 'CfuncDirection'
         WHEN event_type = 'error' THEN 'CfuncSpeed'
         WHEN event_type = 'purchase' THEN 'CfuncMixed'
         WHEN user_id % 4 = 0 THEN 'Generalisation' ELSE 'CfuncTest' END AS phase,
    CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS is_test,
    ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS trial_n,
    CASE WHEN value < 60 THEN 1 ELSE 0 END AS correct,
    CASE WHEN value < 60 AND event_id % 11 <> 0 THEN 1 ELSE 0 END AS accurate,
    CASE WHEN value < 60 THEN '1' ELSE '0' END AS optimal_choice,
    value * 10 AS duration,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 3 AS INT) END AS remaining,
    CASE event_id % 6 WHEN 0 THEN 'relation1select' WHEN 1 THEN 'relation2select' WHEN 2 THEN 'r1d1select'
         WHEN 3 THEN 'r1d2select' WHEN 4 THEN 'r2d1select' ELSE 'r2d2select' END AS response,
    CASE event_id % 4 WHEN 0 THEN 'relation1select' WHEN 1 THEN 'r1d1select'
         WHEN 2 THEN 'r1d2select' ELSE 'relation2select' END AS correct_response,
    CASE WHEN event_id % 5 < 3 THEN '0.5,0,0' ELSE '1,0,50' END AS relation1,
    CASE WHEN event_id % 5 < 3 THEN '1.5,0,0' ELSE '1,0,-40' END AS relation2,
    CASE WHEN event_id % 5 < 3 THEN '0.25,0,0' ELSE '1,0,100' END AS r1d1,
    CASE WHEN event_id % 5 < 3 THEN '0.5,0,50' ELSE '0.5,0,-40' END AS r1d2,
    CASE WHEN event_id % 5 < 3 THEN '2.25,0,0' ELSE '1.5,0,50' END AS r2d1,
    CASE WHEN event_id % 5 < 3 THEN '1.5,0,-40' ELSE '1,0,-45' END AS r2d2,
    CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE '9.0' END AS set_point,
    CASE WHEN user_id % 6 = 0 THEN NULL ELSE 'means ' || CAST(user_id % 4 AS VARCHAR(10)) END AS x_2,
    CAST(event_id % 3 - 1 AS DOUBLE) AS pointGap,
    CAST(event_id % 4 - 1 AS DOUBLE) AS bubbleGap,
    CAST(event_id % 9 AS DOUBLE) AS pointLoss,
    CASE WHEN event_id % 17 = 0 THEN 'yes' ELSE 'no' END AS exclude_data
  FROM events),
trials AS (
  SELECT *, CAST(FLOOR((trial_n - 1) / 5.0) AS BIGINT) + 1 AS block,
    CAST(SUM(correct) OVER (PARTITION BY unique_id, phase ORDER BY trial_n, event_id
         ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS BIGINT) AS criterion
  FROM t)"""


def over_trials(body: str) -> str:
    """SQL over the trial log; ``body`` is further CTEs and a SELECT, or only a SELECT."""
    body = body.strip()
    glue = "\n" if body.upper().startswith("SELECT") else ",\n"
    return f"WITH RECURSIVE {TRIALS.strip()}{glue}{body}"


def query(name: str, sql: str | None = None, trials: bool = True):
    """Register a query, with SQL over the trial log unless ``trials`` is false."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = over_trials(sql) if trials else sql.strip()
        return fn

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on order, so compared doubles are rounded."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
