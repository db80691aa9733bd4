import pytest
from pyspark.errors import AnalysisException

from plumbline import findings, moments, profile, read_report, report, rule_check, write_report
from pyspark.sql import functions as F


@pytest.fixture
def small_report(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, None)], "x double, s string")
    return report(
        [
            findings(profile(df), "profile", F.col("column")),
            findings(rule_check(df, {"x > 2": "x > 2"}), "rule", F.col("rule")),
            findings(moments(df, ["x"]), "moments", "all of x"),
        ]
    )


def test_findings(small_report):
    got = {tuple(r[:3]): r["value"] for r in small_report.collect()}
    assert got[("profile", "x", "mean")] == 2
    assert got[("profile", "s", "nulls")] == 1
    assert ("profile", "s", "mean") not in got
    assert got[("rule", "x > 2", "violations")] == 1
    assert got[("moments", "all of x", "n")] == 2


def test_written_report_reads_back(spark, small_report, tmp_path):
    path = str(tmp_path / "report")
    write_report(small_report, path)
    again = read_report(spark, path)
    assert again.columns == ["check", "subject", "metric", "value"]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, small_report.collect()))
    with pytest.raises(AnalysisException):
        write_report(small_report, path)


def test_reading_one_check_reads_one_folder(spark, small_report, tmp_path):
    path = str(tmp_path / "report")
    write_report(small_report, path)
    one = read_report(spark, path).where("check = 'rule'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(check" in plan
    assert one.count() == 3
