"""git log as lines: read from a text file, or taken from a repository by one git process on the driver."""

from __future__ import annotations

import subprocess
import warnings

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphlode.operators.history import parse_log

COMMITS, TIMEOUT = 1000, 30
LINES = "log string, n long, line string"


def git_lines(root: str, commits: int = COMMITS, timeout: float = TIMEOUT) -> list[str]:
    """The last commits with their files; none outside a repository or without git. If git takes more than `timeout`
    seconds there are none either, and a warning."""
    command = ["git", "-C", root, "log", "--name-only", f"-{commits}", "--no-merges", "--pretty=format:COMMIT|%H|%an <%ae>|%aI"]
    try:
        done = subprocess.run(command, check=False, timeout=timeout, errors="replace", encoding="utf-8", capture_output=True)
    except OSError:
        return []
    except subprocess.TimeoutExpired:
        warnings.warn(f"git log took more than {timeout} seconds: {root} is treated as without history", stacklevel=2)
        return []
    return done.stdout.splitlines() if done.returncode == 0 else []


def commits_of(spark: SparkSession, root: str, commits: int = COMMITS) -> DataFrame:
    """(hash, author, date, files) of a repository."""
    lines = [("log", i, x) for i, x in enumerate(git_lines(root, commits))]
    return parse_log(spark.createDataFrame(lines, LINES))


def commits_from(spark: SparkSession, path: str) -> DataFrame:
    """The same of stored logs, one file a repository; a log is read whole, as its lines hang together."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("log"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    return parse_log(text.select("log", F.col("n").cast("long").alias("n"), "line"))
