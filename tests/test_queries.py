"""Every registered query against its SQL, and what its plan must not contain."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from __spark_entry__ import entry
from __spark_entry__ import queries as registered
from check import canonical, kind_of, kind_of_sql, tables
from trialforge.catalog import ORACLES, QUERIES

# Groups are too small for the tests on the smallest tables.
SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def folder(name: str) -> str:
    return MEDIUM if name.startswith(("L", "K6")) else SMALL


@pytest.fixture(scope="module")
def duck():
    return {f: tables(f) for f in (SMALL, MEDIUM)}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(registered())


def test_every_operator_of_the_inventory_is_registered():
    counts = {"A": 4, "B": 11, "C": 9, "D": 13, "E": 2, "F": 5, "G": 9, "H": 3, "I": 4, "J": 2, "K": 7, "L": 8, "M": 4, "N": 5}
    wanted = {f"{g}{i}" for g, n in counts.items() for i in range(1, n + 1)}
    assert wanted <= {name.split("_")[0] for name in QUERIES}


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "blockAcc" in df.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, plan, name):
    where = folder(name)
    df = QUERIES[name](spark, where)
    rows = df.collect()
    result = duck[where].execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    kinds = {c[0]: kind_of_sql(c[1]) for c in result.description}
    assert {f.name: kind_of(f) for f in df.schema} == kinds
    assert canonical(df.columns, rows) == canonical(columns, result.fetchall())
    text = plan(df)
    # Selection and walks run on sorted arrays of counted values, one for each group.
    python = () if name.startswith(("L6", "M3")) else ("PythonUDF", "InPandas", "ArrowEvalPython")
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", *python):
        assert forbidden not in text


def gathers_rows_in_one_window(text: str) -> bool:
    return re.search(r"Window [^\n]*\n[^\n]*Sort [^\n]*\n(?:[^\n]*AQEShuffleRead[^\n]*\n)?[^\n]*Exchange SinglePartition", text) is not None


def test_the_check_itself(spark, plan):
    w = Window.orderBy("id")
    assert gathers_rows_in_one_window(plan(spark.range(9).withColumn("n", F.row_number().over(w)), "simple"))


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("A")))
def test_no_window_over_all_rows(spark, plan, name):
    assert not gathers_rows_in_one_window(plan(QUERIES[name](spark, SMALL), "simple"))
