"""A session for tests and benchmarks on one machine.

On a cluster the session comes from the submitter; nothing in this package
depends on settings made here.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(threads: str = "*", name: str = "plumbline") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{threads}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
