"""Reports that put the other operators together: warnings, fragile zones, cards, outlines, the export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphlode.functions import text as tx
from graphlode.operators import graph
from graphlode.storage import looked_up, stash

FRAMEWORKS = {k.lower(): k for k in ("FastAPI", "Flask", "Django", "asyncio", "WebSockets", "React", "Express", "SQLAlchemy", "Pydantic", "pytest")} | {"torch": "PyTorch", "tensorflow": "TensorFlow"}


def _callers(edges: DataFrame) -> DataFrame:
    return edges.where("edge_type = 'calls'").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("callers"))


def beside_test(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of nodes that an edge of any type, either way, joins with a test."""
    tests = nodes.where(F.array_contains("tags", "test")).select("id")
    ahead = edges.join(looked_up(tests.withColumnRenamed("id", "source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id"))
    back = edges.join(looked_up(tests.withColumnRenamed("id", "target_id")), "target_id", "left_semi").select(F.col("source_id").alias("id"))
    return ahead.unionByName(back).distinct()


def _warning(df: DataFrame, kind: str, confidence: str, evidence: Column) -> DataFrame:
    return df.select(F.col("id").alias("node_id"), F.lit(kind).alias("category"), F.lit(confidence).alias("confidence"), evidence.cast("string").alias("evidence"))


def _common(nodes: DataFrame, edges: DataFrame, stats: DataFrame, conflicts: DataFrame, patterns: DataFrame) -> DataFrame:
    callers = _callers(edges).where("callers >= 5")
    # Files without a hazard, most of them, are out before they meet nodes; each join with nodes is done once.
    churn = stats.select("file_path", "commits_7d", "author_count").where("commits_7d >= 3 OR author_count >= 3")
    filed = stash(nodes.select("id", "file_path").join(churn, "file_path"), "churn")
    out = _warning(nodes.select("id").join(callers, "id"), "HIGH_IMPACT", "high", F.col("callers"))
    out = out.unionByName(_warning(nodes.select("id").join(conflicts.select(F.col("function_id").alias("id")), "id", "left_semi"), "CONTRACT_CONFLICT", "high", F.lit("")))
    out = out.unionByName(_warning(filed.where("commits_7d >= 3"), "ACTIVE_CHURN", "high", F.col("commits_7d")))
    out = out.unionByName(_warning(filed.where("author_count >= 3"), "MULTI_AUTHOR", "high", F.col("author_count")))
    return out.unionByName(_warning(nodes.select("id").join(patterns.select(F.col("node_id").alias("id"), "pattern"), "id"), "PATTERN", "low", F.col("pattern")))


def warnings(nodes: DataFrame, edges: DataFrame, stats: DataFrame, conflicts: DataFrame, pairs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(node_id, category, confidence, evidence) of all seven kinds; nodes must have importance."""
    reached = graph.test_coverage(nodes, edges).select("id")
    untested = nodes.where((F.col("importance") > 5) & ~F.array_contains("tags", "test")).join(reached, "id", "left_anti")
    close = pairs.where("coupling_score >= 0.5 AND co_commit_count >= 3")
    ends = close.select(F.explode(F.array("file_a", "file_b")).alias("file_path")).groupBy("file_path").agg(F.count("*").alias("n"))
    coupled = nodes.select("id", "file_path").join(ends, "file_path")
    out = _common(nodes, edges, stats, conflicts, patterns)
    out = out.unionByName(_warning(untested, "NO_TESTS", "medium", F.lit("max_hops=3")))
    return out.unionByName(_warning(coupled, "TEMPORAL_COUPLING", "medium", F.col("n")))


def warnings_viz(nodes: DataFrame, edges: DataFrame, stats: DataFrame, conflicts: DataFrame, patterns: DataFrame) -> DataFrame:
    """The six kinds of the export: of symbols only, and a test next to a node is enough."""
    symbols = nodes.where("kind <> 'file'")
    untested = symbols.where((F.col("importance") > 5) & ~F.array_contains("tags", "test")).join(beside_test(nodes, edges), "id", "left_anti")
    return _common(symbols, edges, stats, conflicts, patterns).unionByName(_warning(untested, "NO_TESTS", "medium", F.lit("adjacent")))


def fragile_zones(nodes: DataFrame, edges: DataFrame, conflicts: DataFrame, many: int = 8) -> DataFrame:
    """(id, importance, untested, callers, conflict) of important symbols with hazards. Importance of 15 needs a serious
    one (callers, conflict) or two, of 25 any. The export's variant counts 5 callers as many."""
    big = nodes.where("importance >= 15 AND kind <> 'file'").select("id", "importance", F.array_contains("tags", "test").alias("is_test"))
    tested = beside_test(nodes, edges).withColumn("tested", F.lit(True))
    clash = conflicts.select(F.col("function_id").alias("id"), F.lit(True).alias("conflict")).distinct()
    met = big.join(tested, "id", "left").join(_callers(edges), "id", "left").join(clash, "id", "left")
    untested = ~F.col("is_test") & F.col("tested").isNull()
    busy = F.coalesce(F.col("callers") >= many, F.lit(False))
    conflict = F.coalesce("conflict", F.lit(False))
    rows = met.select("id", "importance", untested.alias("untested"), F.when(busy, F.col("callers")).otherwise(0).alias("callers"), conflict.alias("conflict"))
    any_ = F.col("untested") | (F.col("callers") > 0) | F.col("conflict")
    serious = (F.col("callers") > 0) | F.col("conflict")
    return rows.where(any_ & ((F.col("importance") >= 25) | serious))


def peek(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """One row: the card of a symbol."""
    one = nodes.where(F.col("id") == node_id)
    calls = edges.where("edge_type = 'calls'")
    callees = calls.where(F.col("source_id") == node_id).agg(F.count("*").alias("callees_total"), F.slice(F.array_sort(F.collect_list(tx.short_name(F.col("target_id")))), 1, 8).alias("callees"))
    callers = calls.where(F.col("target_id") == node_id).agg(F.count("*").alias("caller_count"))
    cover = graph.test_coverage(nodes, edges).where(F.col("id") == node_id).select("id", "direct_count", "transitive", "hops")
    notable = F.filter("tags", lambda t: ~t.startswith("extends:") & ~t.startswith("decorator:"))
    doc = F.substring(F.split(F.trim(F.coalesce("docstring", F.lit(""))), tx.LINE_ENDS)[0], 1, 120)
    card = one.select("id", "kind", "name", "file_path", F.trim(F.coalesce("signature", F.lit(""))).alias("signature"), doc.alias("docstring_first_line"), "importance", F.concat_ws(",", notable).alias("tags"))
    return card.join(cover, "id", "left").crossJoin(callees).crossJoin(callers).select(
        *card.columns, F.concat_ws(",", "callees").alias("callees"), "callees_total", "caller_count", F.coalesce("direct_count", F.lit(0)).cast("long").alias("direct_count"), F.coalesce("transitive", F.lit(False)).alias("transitive"), F.coalesce("hops", F.lit(0)).alias("hops")
    )


def tree(nodes: DataFrame, edges: DataFrame, file_path: str) -> DataFrame:
    """(id, kind, name, parent_id, caller_count, outside) of a file's symbols; outside: callers in other files."""
    own = nodes.where((F.col("file_path") == file_path) & (F.col("kind") != "file")).select("id", "kind", "name", "parent_id")
    calls = edges.where("edge_type = 'calls'").select("source_id", F.col("target_id").alias("id")).join(own.select("id"), "id", "left_semi")
    placed = calls.join(nodes.select(F.col("id").alias("source_id"), "file_path"), "source_id", "left")
    n = placed.groupBy("id").agg(F.count("*").alias("caller_count"), F.sum((F.col("file_path") != file_path).cast("long")).alias("outside"))
    return own.join(n, "id", "left").select("id", "kind", "name", "parent_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("caller_count", "outside")))


def tree_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, class_count, method_count, function_count, called_by): the outline's head for every file at once."""
    per = nodes.where("kind <> 'file'").groupBy("file_path").agg(*(F.sum((F.col("kind") == k).cast("long")).alias(f"{k}_count") for k in ("class", "method", "function")))
    at = nodes.select("id", "file_path")
    calls = edges.where("edge_type = 'calls'").select("source_id", "target_id")
    met = calls.join(looked_up(at.select(F.col("id").alias("target_id"), "file_path")), "target_id").drop("target_id").join(looked_up(at.select(F.col("id").alias("source_id"), F.col("file_path").alias("from"))), "source_id")
    outside = met.where(F.col("from") != F.col("file_path")).groupBy("file_path").agg(F.countDistinct("source_id").alias("called_by"))
    return per.join(outside, "file_path", "left").withColumn("called_by", F.coalesce("called_by", F.lit(0)).cast("long"))


def viz_nodes(nodes: DataFrame, max_nodes: int = 1000) -> DataFrame:
    """The `max_nodes` most important symbols (all for 0) and the files that are their parents."""
    if max_nodes <= 0:
        return nodes
    kept = nodes.where("kind <> 'file'").orderBy(F.desc("importance"), "id").limit(max_nodes)
    files = nodes.where("kind = 'file'").join(kept.select(F.col("parent_id").alias("id")).distinct(), "id", "left_semi")
    if nodes.limit(max_nodes + 1).count() <= max_nodes:
        return nodes
    return kept.unionByName(files)


def viz_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """edges between kept nodes."""
    ids = kept.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def tech_stack(keywords: DataFrame) -> DataFrame:
    """(technology): Python, and each framework whose name is a keyword."""
    label = F.create_map(*(F.lit(x) for kv in FRAMEWORKS.items() for x in kv))
    found = keywords.where(F.col("keyword").isin(list(FRAMEWORKS))).select(label[F.col("keyword")].alias("technology")).distinct()
    return found.unionByName(keywords.sparkSession.createDataFrame([("Python",)], "technology string"))


# -- questions

#: Phrases of a statement "A <phrase> B" in order of precedence: (phrase, edge type, whether B is the source).
VERBS = [("is called by", "calls", True), ("called by", "calls", True), ("inherits from", "inherits", False), ("inherits", "inherits", False), ("extends", "inherits", False), ("imported by", "imports", True), ("imports", "imports", False), ("calls", "calls", False)]


def parse_statement(text: str) -> tuple[str, str, str] | None:
    """(source, edge type, target) of a statement, or None."""
    import re

    bare = text.strip().strip("\"'")
    for phrase, kind, swapped in VERBS:
        m = re.search(rf"\b{phrase}\b", bare, re.IGNORECASE)
        if m:
            a, b = bare[: m.start()].strip().strip("\"'"), bare[m.end() :].strip().strip("\"'")
            if not a or not b:
                return None
            return (b, kind, a) if swapped else (a, kind, b)
    return None


def verify(edges: DataFrame, statement: str, max_depth: int = 6) -> DataFrame:
    """(pos, id): the path that a statement about two ids claims; no row if there is none. Calls count only if certain."""
    parsed = parse_statement(statement)
    if parsed is None:
        raise ValueError("say: A calls B, A imports B, A extends B, A is called by B")
    a, kind, b = parsed
    return graph.shortest_path(graph.steps(graph.strict(edges) if kind == "calls" else edges, [kind]), a, b, max_depth)


def ask_calls(edges: DataFrame, caller: str, callee: str) -> DataFrame:
    """One row (caller, callee, direct): whether the caller surely calls the callee."""
    hit = graph.strict(edges).where((F.col("edge_type") == "calls") & (F.col("source_id") == caller) & (F.col("target_id") == callee))
    return hit.agg((F.count("*") > 0).alias("direct")).select(F.lit(caller).alias("caller"), F.lit(callee).alias("callee"), "direct")


def ask_all(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, signature, is_async, returns, callers_count) of every symbol: what is asked of one, answered for all."""
    n = _callers(edges)
    s = F.trim(F.coalesce("signature", F.lit("")))
    return nodes.where("kind <> 'file'").join(n, "id", "left").select("id", s.alias("signature"), tx.is_async(s, F.col("tags")).alias("is_async"), tx.return_type(s).alias("returns"), F.coalesce("callers", F.lit(0)).cast("long").alias("callers_count"))


# -- test runs


def run_summary(runs: DataFrame) -> DataFrame:
    """(run, passed, failed, errors, skipped, seconds, failures) of test logs (run, output); counts are 0 if not told."""
    ends = F.regexp_extract_all("output", F.lit(r"(?m)^=*\s*((?:\d+ \w+,? ?)+in [\d.]+s)"), F.lit(1))
    rows = runs.select("run", "output", F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit("")).alias("s"))
    n = lambda word: F.coalesce(F.expr(f"try_cast(regexp_extract(s, '(\\\\d+) {word}', 1) AS BIGINT)"), F.lit(0).cast("long"))
    failed = F.regexp_extract_all("output", F.lit(r"(?m)^((?:FAILED|ERROR)[^\r\n]*)"), F.lit(1))
    return rows.select("run", n("passed").alias("passed"), n("failed").alias("failed"), n("errors?").alias("errors"), n("skipped").alias("skipped"), F.coalesce(F.expr("try_cast(regexp_extract(s, 'in ([\\\\d.]+)s', 1) AS DOUBLE)"), F.lit(0.0)).alias("seconds"), failed.alias("failures"))
