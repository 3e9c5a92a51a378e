"""Local session for tests, bench and scripts. On a cluster, pass your own session to every function instead."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, driver_memory: str = "12g", **conf: str) -> SparkSession:
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": driver_memory,
        "spark.driver.host": "127.0.0.1",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("graphlode").config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
