"""Test runs: pytest started on the driver, its log kept in a folder and summarised."""

from __future__ import annotations

import subprocess
import sys
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from graphlode.operators.composites import run_summary


def run_pytest(spark: SparkSession, root: str, folder: str, args: list[str] = (), timeout: float | None = None) -> DataFrame:
    """One row of composites.run_summary() for a run of pytest in root; its log is <run>.log in folder, also where the run
    is stopped after `timeout` seconds."""
    run = uuid.uuid4().hex[:12]
    try:
        done = subprocess.run([sys.executable, "-m", "pytest", "-q", "-rfE", "--color=no", *args], cwd=root, check=False, capture_output=True, text=True, errors="replace", timeout=timeout)
        output = done.stdout + done.stderr
    except subprocess.TimeoutExpired as stopped:
        said = stopped.stdout or b""
        output = (said if isinstance(said, str) else said.decode("utf-8", "replace")) + f"\nstopped after {timeout} seconds\n"
    Path(folder).mkdir(parents=True, exist_ok=True)
    (Path(folder) / f"{run}.log").write_text(output)
    return run_summary(spark.createDataFrame([(run, output)], "run string, output string"))


def raw(folder: str, run: str) -> str:
    """The log of a run."""
    if not run.isalnum():
        raise ValueError(f"{run!r} is no run")
    return (Path(folder) / f"{run}.log").read_text()


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The summaries of all logs of a folder."""
    from pyspark.sql import functions as F

    logs = spark.read.text(f"{folder}/*.log", wholetext=True)
    return run_summary(logs.select(F.regexp_extract(F.input_file_name(), r"(\w+)\.log$", 1).alias("run"), F.col("value").alias("output")))
