"""Commits: file statistics, co-change and hotspots. A commit is (hash, author, date, files); date is a timestamp."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss"
LEAST_FILES, MOST_FILES = 2, 15
#: Commits that a pair of files shows, and parts that a pair's commits are ordered in.
SHOWN, PARTS = 20, 32


def file_stats(commits: DataFrame, as_of: str) -> DataFrame:
    """(file_path, total_commits, commits_30d, commits_7d, last_commit, primary_author, author_count) by as_of.

    The primary author has most commits of the file; of equal ones the first by name. Commits without a date count as now.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    date = F.coalesce(F.col("date").cast("timestamp_ntz"), now)
    touched = commits.select("author", date.alias("date"), F.explode("files").alias("file_path"))
    recent = lambda days: F.sum((F.col("date") >= now - F.expr(f"INTERVAL '{days}' DAY")).cast("long"))
    per_author = touched.groupBy("file_path", "author").agg(F.count("*").alias("n"), recent(30).alias("m"), recent(7).alias("w"), F.max("date").alias("last"))
    best = F.min_by("author", F.struct(-F.col("n"), F.col("author")))
    return per_author.groupBy("file_path").agg(
        F.sum("n").alias("total_commits"), F.sum("m").alias("commits_30d"), F.sum("w").alias("commits_7d"), F.date_format(F.max("last"), ISO).alias("last_commit"), best.alias("primary_author"), F.count("*").alias("author_count")
    )


def cochanges(commits: DataFrame, min_count: int = 2, min_coupling: float = 0.2, most_files: int = MOST_FILES) -> DataFrame:
    """Pairs of files with the number of common commits, either file's total, the last date, the score and up to 20 commits.

    Pairs come from commits of 2 to most_files files, as larger ones tell nothing of any pair; totals come from all commits;
    the score is the count through the larger total. The pairs of a commit are made inside its row, 105 by default at
    most, so nothing but pairs is shuffled.
    """
    files = commits.select("hash", "date", F.array_sort(F.array_distinct("files")).alias("files"))
    total = files.select(F.explode("files").alias("file")).groupBy("file").agg(F.count("*").alias("total"))
    few = files.where(F.size("files").between(LEAST_FILES, most_files))
    pairs = few.select("hash", "date", F.posexplode("files").alias("i", "file_a"), "files").select("hash", "date", "file_a", F.explode(F.expr(f"slice(files, i + 2, {most_files})")).alias("file_b"))
    # No list has more than SHOWN commits of a part of a pair's: a pair may be in a third of all commits.
    parted = pairs.withColumn("part", F.pmod(F.xxhash64("hash"), F.lit(PARTS)))
    first = F.row_number().over(Window.partitionBy("file_a", "file_b", "part").orderBy(F.col("date").asc_nulls_first(), "hash"))
    few_each = parted.withColumn("place", first).groupBy("file_a", "file_b", "part").agg(F.count("*").alias("n"), F.max("date").alias("last"), F.collect_list(F.when(F.col("place") <= SHOWN, F.struct("date", "hash"))).alias("ids"))
    met = few_each.groupBy("file_a", "file_b").agg(F.sum("n").alias("co_commit_count"), F.max("last").alias("last"), F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, SHOWN).alias("ids")).where(F.col("co_commit_count") >= min_count)
    both = met.join(total.select(F.col("file").alias("file_a"), F.col("total").alias("total_commits_a")), "file_a").join(total.select(F.col("file").alias("file_b"), F.col("total").alias("total_commits_b")), "file_b")
    score = F.col("co_commit_count") / F.greatest("total_commits_a", "total_commits_b")
    return both.where(score >= min_coupling).select(
        "file_a", "file_b", "co_commit_count", "total_commits_a", "total_commits_b", F.date_format("last", ISO).alias("last_co_commit"), F.bround(score, 3).alias("coupling_score"),
        F.transform("ids", lambda x: F.substring(x["hash"], 1, 8)).alias("commit_ids"),
    )


def cochange_of(pairs: DataFrame, file: str, min_count: int = 3, min_score: float = 0.2) -> DataFrame:
    """(other, co_commit_count, coupling_score) of a file's pairs."""
    other = F.when(F.col("file_a") == file, F.col("file_b")).otherwise(F.col("file_a"))
    mine = pairs.where(((F.col("file_a") == file) | (F.col("file_b") == file)) & (F.col("co_commit_count") >= min_count) & (F.col("coupling_score") >= min_score))
    return mine.select(other.alias("other"), "co_commit_count", "coupling_score")


def couplings(pairs: DataFrame, least: float = 0.4) -> DataFrame:
    return pairs.where(F.col("coupling_score") >= least).select("file_a", "file_b", "coupling_score", "co_commit_count")


def hotspots(commits: DataFrame, as_of: str, days: int = 7, top: int = 10) -> DataFrame:
    """(file_path, commits): the files with most commits in the last `days` days."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL '{days}' DAY")
    n = commits.where(F.col("date") >= since).select(F.explode("files").alias("file_path")).groupBy("file_path").agg(F.count("*").alias("commits"))
    return n.orderBy(F.desc("commits"), "file_path").limit(top)


# -- the log


def parse_log(lines: DataFrame) -> DataFrame:
    """(hash, author, date, files) of a log's lines (log, n, line): COMMIT|hash|author|date, then a path a line.

    Each line belongs to the last header before it. A log is one group; logs are parsed side by side. Blank lines and what
    comes before the first header have no place. Authors are normalised as text.author() does.
    """
    from graphlode.functions.text import author

    head = F.when(F.col("line").startswith("COMMIT|"), F.col("line"))
    w = Window.partitionBy("log").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    owned = lines.withColumn("head", F.last(head, ignorenulls=True).over(w)).where("head IS NOT NULL")
    path = F.when(~F.col("line").startswith("COMMIT|") & (F.trim("line") != ""), F.trim("line"))
    parts = F.split("head", r"\|", 4)
    c = owned.groupBy("log", "head").agg(F.array_sort(F.collect_set(path)).alias("files"))
    return c.select(parts[1].alias("hash"), author(parts[2]).alias("author"), F.to_timestamp(parts[3]).cast("timestamp_ntz").alias("date"), "files")
