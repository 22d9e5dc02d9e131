"""Reading trial logs and writing reports."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.rsem import to_int
from ..operators.skew import scratch_folder


def load_trials(
    spark: SparkSession, logs: dict[str, str], schema: StructType | str | None = None,
    fmt: str = "parquet", rename: dict[str, dict[str, str]] | None = None, label: str = "experiment",
) -> DataFrame:
    """One frame from one log per experiment, tagged with the experiment.

    Logs may differ in columns; what a log lacks is null.  ``rename`` maps the
    column names of single experiments to the common ones and keeps only those.
    """
    parts = []
    for experiment, path in logs.items():
        reader = spark.read.format(fmt)
        if fmt == "csv":
            reader = reader.option("header", True)
        df = (reader.schema(schema) if schema else reader).load(path)
        names = (rename or {}).get(experiment)
        if names:
            df = df.select(*[F.col(old).alias(new) for old, new in names.items()])
        parts.append(df.withColumn(label, F.lit(experiment)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def coerce_int(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Lenient integer column: truncates, and unreadable text becomes null."""
    return df.withColumn(out or column, to_int(column))


def with_row_index(df: DataFrame, order: list[Column], out: str = "row_index") -> DataFrame:
    """Number all rows 1..n in the given order without gathering them in one task.

    The sorted rows are checkpointed, which fixes both the cut between partitions
    and the place of every row; each partition is then shifted by the rows before
    it.  Remaining columns break ties, so equal sort values can be cut as well.
    """
    scratch_folder(df.sparkSession)
    placed = (
        df.orderBy(*order, *[F.col(c).asc_nulls_last() for c in df.columns])
        .withColumn("_place", F.monotonically_increasing_id())
        .checkpoint()
    )
    part = F.shiftright(F.col("_place"), 33)
    within = F.col("_place") - F.shiftleft(part, 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    # One row per partition.
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    shifted = placed.withColumns({"_part": part, "_within": within}).join(F.broadcast(offsets), "_part")
    return shifted.select((F.col("_within") + F.col("_before") + 1).alias(out), *df.columns)


def write_report(
    df: DataFrame, path: str, row_index: bool = True, order: list[Column] | None = None
) -> None:
    """CSV with header, in report order, with or without a leading column of row numbers."""
    order = order or []
    out = with_row_index(df, order) if row_index else (df.orderBy(*order) if order else df)
    out.write.mode("errorifexists").option("header", True).csv(path)


def read_report(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def report_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a report in the scratch folder."""
    return f"{scratch_folder(spark)}/reports/{name}-{uuid.uuid4().hex}"
