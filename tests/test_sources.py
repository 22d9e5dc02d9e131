"""Loading logs and writing reports."""

from pyspark.sql import functions as F

from trialforge.functions.rsem import descending
from trialforge.sources import logs

from .conftest import values


def test_logs_with_different_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a", "because")], "unique_id long, phase string, x_2 string").write.parquet(str(tmp_path / "one"))
    spark.createDataFrame([(2, "b")], "unique_id long, phase string").write.parquet(str(tmp_path / "two"))
    df = logs.load_trials(spark, {"exp1": str(tmp_path / "one"), "exp2": str(tmp_path / "two")})
    assert values(df, "experiment", "unique_id", "x_2") == [("exp1", 1, "because"), ("exp2", 2, None)]


def test_csv_logs_with_a_schema(spark, tmp_path):
    (tmp_path / "log.csv").write_text("unique_id,phase,correct\n1,a,1\n2,b,\n")
    df = logs.load_trials(spark, {"e": str(tmp_path / "log.csv")}, "unique_id long, phase string, correct int", "csv")
    assert values(df, "unique_id", "correct") == [(1, 1), (2, None)]


def test_filters_and_columns_reach_the_files(spark, tmp_path, plan):
    spark.createDataFrame([(1, "Crel", 1, "x")], "unique_id long, phase string, correct int, note string").write.parquet(
        str(tmp_path / "log")
    )
    df = logs.load_trials(spark, {"e": str(tmp_path / "log")}).where(F.col("phase").isin("Crel", "CfuncTest"))
    text = plan(df.groupBy("unique_id").agg(F.avg("correct")))
    assert "PushedFilters: [In(phase, [CfuncTest,Crel])]" in text
    assert "ReadSchema: struct<unique_id:bigint,phase:string,correct:int>" in text


def test_indexed_report_is_in_order(spark, tmp_path):
    df = spark.range(50).select("id", (F.col("id") % 7).cast("double").alias("score")).repartition(4)
    path = str(tmp_path / "report")
    logs.write_report(df, path, True, descending("score"))
    out = logs.read_report(spark, path, "row_index long, id long, score double")
    rows = sorted((r.row_index, r.score, r.id) for r in out.collect())
    assert [i for i, _, _ in rows] == list(range(1, 51))
    assert [(s, i) for _, s, i in rows] == sorted(((s, i) for _, s, i in rows), key=lambda r: (-r[0], r[1]))
    heads = {p.read_text().splitlines()[0] for p in (tmp_path / "report").glob("*.csv")}
    assert heads == {"row_index,id,score"}


def test_plain_report(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "a,b")], "id long, text string")
    path = str(tmp_path / "plain")
    logs.write_report(df, path, row_index=False)
    assert values(logs.read_report(spark, path, "id long, text string"), "id", "text") == [(1, None), (2, "a,b")]
