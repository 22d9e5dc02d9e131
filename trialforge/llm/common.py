"""Helpers shared by the text operators: words, checkpoints, sizes, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The separators of words, U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only a local session without that setting, as in tests, gets a temporary folder; a cluster
    without it is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(frame: DataFrame) -> DataFrame:
    """``frame`` written to the shared folder, with its lineage cut; Spark removes the files
    with the frame where it is set to clean checkpoints."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def written(frame: DataFrame) -> DataFrame:
    """``frame`` as a Parquet table in the shared folder, read again."""
    path = f"{shared_folder(frame.sparkSession)}/{uuid.uuid4()}.parquet"
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def squeezed(text: Column) -> Column:
    """Text without any separator; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def word_count(text: Column) -> Column:
    """Number of words as a long; null has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id has remainder -1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(-1))


def replaced(frame: DataFrame, names: list[str]) -> list[str]:
    """Columns of ``frame`` that keep their place when ``names`` are added."""
    return [c for c in frame.columns if c.lower() not in {n.lower() for n in names}]


def packed(frame: DataFrame, without: list[str] = ()) -> Column:
    """All columns of ``frame`` but ``without`` as one struct, so that no name clashes."""
    return F.struct(*[F.col(f"`{c}`") for c in replaced(frame, list(without))])


def unpacked(frame: DataFrame, row: str) -> list[Column]:
    """The fields of the struct column ``row`` as columns."""
    return [F.col(row)[c].alias(c) for c in frame.schema[row].dataType.names]
