"""Every query by name over the bound tables, with its oracle where SQL can express it."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphlode.functions import text as tx
from graphlode.operators import composites, concepts, content, find, graph, history, linker, patterns, scores, search
from graphlode.plans import bindings as b
from graphlode.sources import files as source_files
from graphlode.sources import parse
from graphlode.sources.store import Store
from graphlode.storage import shared_dir, spread, stash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: What the oracles build on, as CTEs.
NODES = """
place AS (SELECT n_nationkey, n_regionkey, n_name, r_name || '/' || n_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (
  SELECT 'r:' || r_regionkey AS id, 'file' AS kind, r_name AS name, r_name AS file_path, '' AS signature, ['category:doc'] AS tags, '' AS parent_id FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'class', n_name, place, '', ['data_model', 'category:core'], 'r:' || n_regionkey FROM place
  UNION ALL SELECT 's:' || s_suppkey, 'function', s_name, place, s_name || '(order) -> Part', ['category:core'], 'n:' || s_nationkey FROM supplier JOIN place ON s_nationkey = n_nationkey
  UNION ALL SELECT 'c:' || c_custkey, 'function', c_name, place || '/' || c_mktsegment, 'async ' || c_name || '(request)',
    CASE c_mktsegment WHEN 'BUILDING' THEN ['test', 'category:test'] WHEN 'MACHINERY' THEN ['entrypoint', 'category:core'] WHEN 'HOUSEHOLD' THEN ['callback', 'category:example'] ELSE ['category:core'] END,
    'n:' || c_nationkey FROM customer JOIN place ON c_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT 'b:' || p_brand, 'class', p_brand, p_brand, '', ['category:core'], '' FROM part
  UNION ALL SELECT 'p:' || p_partkey, 'method', p_name, p_brand || '/' || p_type, p_name || '(self) -> ' || p_type,
    CASE WHEN p_size > 45 THEN ['route_handler', 'category:core'] ELSE ['category:core'] END, 'b:' || p_brand FROM part)"""
EDGES = """
edges AS (
  SELECT DISTINCT 'c:' || o_custkey AS source_id, 'p:' || l_partkey AS target_id, 'calls' AS edge_type, 'high' AS confidence FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  UNION ALL SELECT 'p:' || l_partkey, 's:' || l_suppkey, 'calls', CASE WHEN bool_and(l_returnflag = 'R') THEN 'low' ELSE 'high' END FROM lineitem GROUP BY l_partkey, l_suppkey
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'inherits', 'high' FROM nation
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'imports', 'high' FROM supplier
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'imports', 'high' FROM customer)"""
_MODULE = "CASE WHEN contains(file_path, '/') THEN split_part(file_path, '/', 1) ELSE '' END"
IMPORTANCE = f"""
mods AS (SELECT id, {_MODULE} AS m FROM nodes),
weighted AS (
  SELECT source_id, target_id, edge_type, CASE edge_type WHEN 'calls' THEN 2.0 WHEN 'inherits' THEN 1.5 WHEN 'imports' THEN 0.5 ELSE 1.0 END::DOUBLE AS w,
         CASE WHEN a.m <> '' AND b.m <> '' AND a.m <> b.m THEN 2.0 ELSE 0.0 END::DOUBLE AS x
  FROM edges JOIN mods a ON a.id = source_id JOIN mods b ON b.id = target_id),
ends AS (SELECT target_id AS id, w + x AS s FROM weighted UNION ALL SELECT source_id, CASE WHEN edge_type = 'calls' THEN 0.5 ELSE 0 END::DOUBLE + x FROM weighted),
importance AS (
  SELECT n.id, (CASE WHEN starts_with(n.name, '_') THEN 0 ELSE 1 END)::DOUBLE + coalesce(sum(s), 0)::DOUBLE AS importance
  FROM nodes n LEFT JOIN ends e ON e.id = n.id GROUP BY n.id, n.name),
ranked AS (
  SELECT id, importance, round_even(CAST(row_number() OVER (ORDER BY importance, id) - 1 AS DOUBLE) / greatest(1, (SELECT count(*) FROM nodes) - 1) * 100, 0)::INT AS importance_rank
  FROM importance)"""
COVER = """
tests AS (SELECT id FROM nodes WHERE list_contains(tags, 'test')),
calls AS (SELECT source_id, target_id FROM edges WHERE edge_type = 'calls'),
d1 AS (SELECT target_id AS id, count(*) AS direct_count, min(source_id) AS via FROM calls WHERE source_id IN (SELECT id FROM tests) GROUP BY 1),
u1 AS (SELECT target_id AS root, source_id AS id FROM calls WHERE target_id NOT IN (SELECT id FROM d1)),
u2 AS (SELECT DISTINCT root, source_id AS id FROM u1 JOIN calls ON target_id = u1.id WHERE source_id <> root),
d2 AS (SELECT root AS id, min(u2.id) AS via FROM u2 JOIN tests ON tests.id = u2.id GROUP BY root),
u3 AS (SELECT DISTINCT root, source_id AS id FROM u2 JOIN calls ON target_id = u2.id WHERE source_id <> root AND root NOT IN (SELECT id FROM d2)),
d3 AS (SELECT root AS id, min(u3.id) AS via FROM u3 JOIN tests ON tests.id = u3.id GROUP BY root),
cover AS (
  SELECT id, direct_count::BIGINT AS direct_count, true AS transitive, 0 AS hops, '' AS via FROM d1
  UNION ALL SELECT id, 0, true, 2, via FROM d2 UNION ALL SELECT id, 0, true, 3, via FROM d3)"""
GRAPH = f"WITH {NODES.strip()},{EDGES}"
SCORED = f"{GRAPH},{IMPORTANCE}"
SUCCESSION = """
WITH RECURSIVE edges AS (
  SELECT DISTINCT 'p:' || a.l_partkey AS source_id, 'p:' || b.l_partkey AS target_id FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)"""
_STOPS = ", ".join(f"'{w}'" for w in tx.KEYWORD_STOPS)
KEYWORDS = rf"""
WITH words AS (
  SELECT 'd:' || doc_id AS node_id, 'docstring' AS source, unnest(regexp_extract_all(text, '[a-zA-Z_]\w*')) AS w FROM documents
  UNION ALL SELECT 'd:' || doc_id, 'name', unnest([source || '_' || lang, source, lang]) FROM documents
  UNION ALL SELECT 'd:' || doc_id, 'tag', unnest(['source:' || source, CASE WHEN lang = 'en' THEN 'category:core' ELSE 'category:doc' END]) FROM documents
  UNION ALL SELECT 'd:' || doc_id, 'file_path', unnest([lang, source]) FROM documents),
keywords AS (SELECT DISTINCT lower(w) AS keyword, node_id, source FROM words WHERE length(w) >= 3 AND lower(w) NOT IN ({_STOPS}))"""
_WEIGHT = "CASE WHEN source = 'name' THEN 3 WHEN source IN ('tag', 'docstring') THEN 2 ELSE 1 END"
EVENT_COMMITS = """
WITH commits AS (
  SELECT md5(user_id::VARCHAR || '|' || strftime(ts, '%Y-%m-%d')) AS hash, 'user_' || user_id AS author, max(ts) AS date, list(DISTINCT event_type) AS files
  FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d'))"""
ORDER_COMMITS = """
commits AS (
  SELECT md5(o_orderkey::VARCHAR) AS hash, any_value(c_mktsegment) AS author, any_value(o_orderdate) AS date, list(DISTINCT p_brand || '/' || p_type) AS files
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey)"""


def _stats(as_of: str) -> str:
    return f"""
touched AS (SELECT author, date, unnest(files) AS file_path FROM commits),
per_author AS (SELECT file_path, author, count(*) AS n FROM touched GROUP BY ALL),
best AS (SELECT file_path, author, row_number() OVER (PARTITION BY file_path ORDER BY n DESC, author) AS k FROM per_author),
stats AS (
  SELECT file_path, count(*)::BIGINT AS total_commits, count(*) FILTER (date >= TIMESTAMP '{as_of}' - INTERVAL 30 DAY)::BIGINT AS commits_30d,
         count(*) FILTER (date >= TIMESTAMP '{as_of}' - INTERVAL 7 DAY)::BIGINT AS commits_7d, strftime(max(date), '%Y-%m-%dT%H:%M:%S') AS last_commit,
         any_value(b.author) AS primary_author, count(DISTINCT t.author)::BIGINT AS author_count
  FROM touched t JOIN best b USING (file_path) WHERE b.k = 1 GROUP BY file_path)"""


PAIRS = """
few AS (SELECT hash, date, list_sort(files) AS files FROM commits WHERE len(files) BETWEEN 2 AND 15),
each AS (SELECT hash, date, unnest(files) AS file FROM few),
totals AS (SELECT file, count(*) AS total FROM (SELECT unnest(files) AS file FROM commits) GROUP BY 1),
met AS (SELECT a.file AS file_a, b.file AS file_b, count(*) AS co_commit_count, max(a.date) AS last FROM each a JOIN each b ON a.hash = b.hash AND a.file < b.file GROUP BY ALL HAVING count(*) >= 2),
pairs AS (
  SELECT file_a, file_b, co_commit_count::BIGINT AS co_commit_count, x.total::BIGINT AS total_commits_a, y.total::BIGINT AS total_commits_b, strftime(last, '%Y-%m-%dT%H:%M:%S') AS last_co_commit,
         round_even(co_commit_count / greatest(x.total, y.total), 3) AS coupling_score
  FROM met JOIN totals x ON x.file = file_a JOIN totals y ON y.file = file_b WHERE co_commit_count / greatest(x.total, y.total) >= 0.2)"""
CONTRACTS = "WITH contracts AS (SELECT 'o:' || l_orderkey AS function_id, 'p:' || l_partkey AS caller_id, min(l_returnflag) AS error_handling, min(l_linestatus) AS return_usage FROM lineitem GROUP BY l_orderkey, l_partkey)"
PART_CONFLICTS = """
conflicts AS (
  SELECT function_id FROM (SELECT 'p:' || l_partkey AS function_id, 's:' || l_suppkey AS caller_id, min(l_returnflag) AS e, min(l_linestatus) AS u FROM lineitem GROUP BY ALL)
  GROUP BY 1 HAVING count(DISTINCT e) > 1 OR count(DISTINCT u) > 1)"""
_CATEGORY = "coalesce(split_part(list_filter(tags, lambda t: starts_with(t, 'category:'))[1], ':', 2), '')"


def query(name: str, sql: str | None = None):
    """Registers a query, with its oracle if it has one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spread(spark, b.size(spark, sf_dir))
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, stored as the engine has them. A semi or anti join with unions would be done for each of their parts,
    and read its other side as often."""
    return stash(b.nodes(spark, sf_dir), "nodes"), stash(b.edges(spark, sf_dir), "edges")


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes with importance, and edges, both stored as the engine has them: reports read them many times."""
    n, e = _graph(spark, sf_dir)
    return stash(scores.scored_nodes(n, e), "scored"), e


def _succession(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The parts and their edges, stored as the engine has them: a traversal reads them at every level."""
    n, e = b.succession(spark, sf_dir)
    return n, stash(e, "succession")


def _busiest(e: DataFrame, column: str) -> str:
    """The id with most edges at one end; of equal ones the smallest."""
    return e.groupBy(column).count().orderBy(F.desc("count"), column).first()[0]


# -- scores, filters, scans


@query("importance_top", f"{SCORED} SELECT id, importance, importance_rank FROM ranked ORDER BY importance DESC, id LIMIT 20")
def _(spark, d):
    return scores.importance_rank(scores.importance(b.nodes(spark, d), b.edges(spark, d))).orderBy(F.desc("importance"), "id").limit(20)


@query("importance", f"{SCORED} SELECT id, importance FROM importance")
def _(spark, d):
    return scores.importance(b.nodes(spark, d), b.edges(spark, d))


@query("importance_rank", f"{SCORED} SELECT id, importance, importance_rank FROM ranked")
def _(spark, d):
    return scores.importance_rank(scores.importance(b.nodes(spark, d), b.edges(spark, d)))


@query("reverse_edges", f"""{GRAPH} SELECT source_id, target_id, edge_type, confidence FROM edges
UNION ALL SELECT target_id, source_id, CASE edge_type WHEN 'calls' THEN 'called_by' WHEN 'imports' THEN 'imported_by' ELSE 'inherited_by' END, confidence FROM edges""")
def _(spark, d):
    return graph.reverse_edges(b.edges(spark, d))


@query("degrees", f"""{GRAPH} SELECT n.id, (SELECT count(*) FROM edges WHERE source_id = n.id)::BIGINT AS out_degree, (SELECT count(*) FROM edges WHERE target_id = n.id)::BIGINT AS in_degree FROM nodes n""")
def _(spark, d):
    return scores.degrees(b.nodes(spark, d), b.edges(spark, d))


def _store(spark: SparkSession, **tables: DataFrame) -> Store:
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    for name, df in tables.items():
        store.write(name, df)
    return store


@query("scan_by_key", f"{GRAPH} SELECT id, kind, name, file_path FROM nodes WHERE kind = 'class'")
def _(spark, d):
    return _store(spark, nodes=b.nodes(spark, d)).by("nodes", kind="class").select("id", "kind", "name", "file_path")


@query("store_upsert", f"{GRAPH} SELECT id, kind, CASE WHEN kind = 'class' THEN upper(name) || '!' ELSE name END AS name FROM nodes WHERE file_path NOT IN (SELECT r_name FROM region)")
def _(spark, d):
    """Classes are renamed by an upsert, then the rows of the regions' files are deleted."""
    store = _store(spark, nodes=b.nodes(spark, d))
    store.upsert("nodes", store.by("nodes", kind="class").withColumn("name", F.concat(F.upper("name"), F.lit("!"))))
    store.delete_files("nodes", b.table(spark, d, "region").select(F.col("r_name").alias("file_path")))
    return store.read("nodes").select("id", "kind", "name")


@query("meta_counts", f"""{GRAPH} SELECT 'file_count' AS key, (SELECT count(*) FROM nodes WHERE kind = 'file')::VARCHAR AS value
UNION ALL SELECT 'node_count', (SELECT count(*) FROM nodes)::VARCHAR UNION ALL SELECT 'edge_count', (SELECT count(*) FROM edges)::VARCHAR""")
def _(spark, d):
    return scores.meta_counts(b.nodes(spark, d), b.edges(spark, d))


@query("find_kind_importance", f"{SCORED} SELECT n.id, importance FROM nodes n JOIN importance USING (id) WHERE kind = 'function' AND importance > 100")
def _(spark, d):
    n, e = _scored(spark, d)
    return find.find(n, e, kind="function", importance_gt=100).select("id", "importance")


@query("find_tag", f"{GRAPH} SELECT id, name FROM nodes WHERE list_contains(tags, 'entrypoint')")
def _(spark, d):
    return find.find(b.nodes(spark, d), b.edges(spark, d), tag="entrypoint").select("id", "name")


@query("find_category", f"{GRAPH} SELECT id, {_CATEGORY} AS category FROM nodes WHERE {_CATEGORY} NOT IN ('core', 'doc')")
def _(spark, d):
    return find.find(b.nodes(spark, d), b.edges(spark, d), exclude=["core", "doc"]).select("id", tx.category_of_tags(F.col("tags")).alias("category"))


@query("find_cross_module", f"""{GRAPH}, mods AS (SELECT id, {_MODULE} AS m FROM nodes), x AS (
  SELECT source_id, target_id FROM edges JOIN mods a ON a.id = source_id JOIN mods b ON b.id = target_id WHERE a.m <> '' AND b.m <> '' AND a.m <> b.m)
SELECT source_id AS id FROM x UNION SELECT target_id FROM x""")
def _(spark, d):
    return find.find(*_graph(spark, d), crosses=True).select("id")


@query("find_no_tests", f"{GRAPH},{COVER} SELECT id, kind FROM nodes WHERE NOT list_contains(tags, 'test') AND id NOT IN (SELECT id FROM cover) AND {_CATEGORY} NOT IN ('test', 'doc', 'example', 'vendor', 'generated', 'script')")
def _(spark, d):
    return find.find(*_graph(spark, d), no_tests=True).select("id", "kind")


@query("find_no_direct_tests", f"{GRAPH},{COVER} SELECT id, kind FROM nodes WHERE NOT list_contains(tags, 'test') AND id NOT IN (SELECT id FROM d1) AND {_CATEGORY} IN ('core', 'doc')")
def _(spark, d):
    return find.find(*_graph(spark, d), no_direct_tests=True, include=["core", "doc"]).select("id", "kind")


@query("find_dead", f"""{GRAPH}, used AS (SELECT target_id FROM edges WHERE edge_type IN ('calls', 'imports', 'inherits', 'instantiates'))
SELECT id, kind, name FROM nodes WHERE kind NOT IN ('file', 'method') AND NOT list_has_any(tags, ['test', 'entrypoint', 'callback', 'route_handler']) AND NOT (kind = 'class' AND list_contains(tags, 'data_model'))
  AND name <> 'main' AND id NOT IN (SELECT target_id FROM used)""")
def _(spark, d):
    return find.dead(*_graph(spark, d)).select("id", "kind", "name")


@query("framework_entry", f"{GRAPH} SELECT id, name FROM nodes WHERE list_has_any(tags, ['test', 'entrypoint', 'callback', 'route_handler'])")
def _(spark, d):
    return b.nodes(spark, d).where(find.framework_entry(F.col("name"), F.col("tags"))).select("id", "name")


@query("entry_points", f"{GRAPH} SELECT id, kind, name FROM nodes WHERE list_has_any(tags, ['entrypoint', 'route_handler'])")
def _(spark, d):
    return find.entry_points(b.nodes(spark, d)).select("id", "kind", "name")


@query("strict_edges", f"{GRAPH} SELECT source_id, target_id, edge_type FROM edges WHERE confidence <> 'low'")
def _(spark, d):
    return graph.strict(b.edges(spark, d)).select("source_id", "target_id", "edge_type")


_COUNTS = """
counted AS (
  SELECT module, count(*) AS total, count(DISTINCT file_path) AS file_count, sum(len(list_filter(tags, lambda t: t = 'test'))) AS tests, sum(len(list_filter(tags, lambda t: t = 'route_handler'))) AS routes,
         sum(len(list_filter(tags, lambda t: t = 'data_model'))) AS models, sum(len(list_filter(tags, lambda t: t = 'callback'))) AS callbacks,
         count(*) FILTER (kind = 'class') AS classes, count(*) FILTER (kind IN ('function', 'method')) AS functions,
         count(*) FILTER (kind <> 'file') AS testable, count(*) FILTER (kind <> 'file' AND list_contains(tags, 'test')) AS tested
  FROM placed GROUP BY module)"""
_PLAIN = "CASE WHEN classes + functions = 0 THEN 'module' ELSE concat_ws(', ', CASE WHEN classes > 0 THEN classes || ' classes' END, CASE WHEN functions > 0 THEN functions || ' functions' END) END"
_FIRST = "WHEN tests > total * 0.3 THEN 'tests' WHEN routes > total * 0.3 THEN 'API routes/handlers' WHEN models > total * 0.3 THEN 'data models'"


@query("module_map", f"""{GRAPH}, placed AS (SELECT *, {_MODULE} AS module FROM nodes WHERE contains(file_path, '/')),{_COUNTS}
SELECT module, CASE {_FIRST} WHEN callbacks > total * 0.3 THEN 'event handlers' ELSE {_PLAIN} END AS description FROM counted""")
def _(spark, d):
    return scores.module_map(b.nodes(spark, d))


@query("module_rollup", f"""{GRAPH},{ORDER_COMMITS},{_stats(b.AS_OF_ORDERS)}, placed AS (SELECT *, CASE WHEN contains(file_path, '/') THEN split_part(file_path, '/', 1) ELSE '(root)' END AS module FROM nodes),{_COUNTS},
heat AS (SELECT module, sum(commits_30d) AS h FROM (SELECT DISTINCT module, file_path FROM placed) JOIN stats USING (file_path) GROUP BY module)
SELECT module, CASE {_FIRST} ELSE {_PLAIN} END AS description, file_count::BIGINT AS file_count, total::BIGINT AS node_count, coalesce(h, 0)::BIGINT AS hotspot_score,
       CASE WHEN testable > 0 THEN round_even(tested / testable, 2) ELSE 0.0 END::DOUBLE AS test_coverage
FROM counted LEFT JOIN heat USING (module)""")
def _(spark, d):
    return scores.module_rollup(b.nodes(spark, d), history.file_stats(b.order_commits(spark, d), b.AS_OF_ORDERS))


# -- traversal


@query("test_coverage", f"{GRAPH},{COVER} SELECT id, direct_count, transitive, hops, via FROM cover")
def _(spark, d):
    return graph.test_coverage(*_graph(spark, d))


@query("test_coverage_multihop", SUCCESSION + f", nodes AS (SELECT 'p:' || p_partkey AS id, CASE WHEN p_size <= 5 THEN ['test'] ELSE [] END AS tags FROM part),{COVER.replace(' FROM edges WHERE edge_type = ' + chr(39) + 'calls' + chr(39), ' FROM edges')} SELECT id, direct_count, transitive, hops, via FROM cover")
def _(spark, d):
    return graph.test_coverage(*_succession(spark, d))


_START = "start AS (SELECT {c} AS id FROM edges GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_BACK = "levels(id, depth) AS (SELECT id, 0 FROM start UNION SELECT source_id, depth + 1 FROM levels JOIN edges ON target_id = id WHERE depth < {n}), dist AS (SELECT id, min(depth) AS depth FROM levels GROUP BY id)"
_AHEAD = "levels(id, depth) AS (SELECT id, 0 FROM start UNION SELECT target_id, depth + 1 FROM levels JOIN edges ON source_id = id WHERE depth < {n}), dist AS (SELECT id, min(depth) AS depth FROM levels GROUP BY id)"


@query("callers_depth", f"{SUCCESSION}, {_START.format(c='target_id')}, {_BACK.format(n=2)} SELECT id, depth, false AS uncertain FROM dist WHERE depth > 0")
def _(spark, d):
    _, e = _succession(spark, d)
    return graph.callers(e, _busiest(e, "target_id"), 2)


@query("callers_uncertain", """SELECT 'p:' || l_partkey AS id, 1 AS depth, bool_and(l_returnflag = 'R') AS uncertain FROM lineitem WHERE l_suppkey = 1 GROUP BY l_partkey
UNION ALL SELECT DISTINCT 'c:' || o_custkey, 2, false FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1)""")
def _(spark, d):
    """The parts that a supplier sent, doubtful where all came back, and who ordered them."""
    return graph.callers(stash(b.edges(spark, d), "edges"), "s:1", 2)


@query("blast_radius", f"{SUCCESSION}, {_START.format(c='target_id')}, {_BACK.format(n=3)} SELECT id, depth, CASE depth WHEN 1 THEN 'direct' WHEN 2 THEN 'indirect' ELSE 'distant' END AS bucket FROM dist WHERE depth > 0")
def _(spark, d):
    _, e = _succession(spark, d)
    return graph.blast_radius(e, _busiest(e, "target_id"))


@query("affected_tests", f"{SUCCESSION}, {_START.format(c='target_id')}, hit AS (SELECT DISTINCT source_id AS id FROM edges JOIN start ON target_id = id WHERE source_id <> id), near AS (SELECT target_id AS id FROM edges WHERE source_id IN (SELECT id FROM hit) UNION SELECT source_id FROM edges WHERE target_id IN (SELECT id FROM hit)) SELECT id FROM near WHERE id IN (SELECT 'p:' || p_partkey FROM part WHERE p_size <= 5)")
def _(spark, d):
    n, e = _succession(spark, d)
    return graph.affected_tests(e, n, graph.blast_radius(e, _busiest(e, "target_id"), 1))


@query("read_context", f"{SUCCESSION}, {_START.format(c='source_id')}, {_AHEAD.format(n=2)} SELECT x.id, depth, p_brand || '/' || p_type AS file_path, p_size AS line_start, p_size + 9 AS line_end FROM dist x JOIN part ON x.id = 'p:' || p_partkey")
def _(spark, d):
    n, e = _succession(spark, d)
    return content.read_context(n, e, _busiest(e, "source_id"), 2)


_TRACE = f"""{SUCCESSION}, {_START.format(c='source_id')}, goal AS (SELECT target_id AS id FROM edges GROUP BY 1 ORDER BY count(*), 1 LIMIT 1), {_AHEAD.format(n=8)},
paths(id, path) AS (SELECT id, [id] FROM start UNION ALL SELECT e.target_id, list_append(path, e.target_id) FROM paths p JOIN edges e ON e.source_id = p.id JOIN dist a ON a.id = e.target_id AND a.depth = len(path)
  JOIN back k ON k.id = e.target_id AND k.depth + a.depth = (SELECT depth FROM dist WHERE id = (SELECT id FROM goal))),
up(id, depth) AS (SELECT id, 0 FROM goal UNION SELECT source_id, depth + 1 FROM up JOIN edges ON target_id = id WHERE depth < 8), back AS (SELECT id, min(depth) AS depth FROM up GROUP BY id),
best AS (SELECT min(path) AS path FROM paths WHERE id = (SELECT id FROM goal))"""
_TRACE = _TRACE.replace("paths(id, path) AS (", "@@", 1)
_head, _tail = _TRACE.split("@@")
_paths, _rest = _tail.split("\nup(id, depth)", 1)
_TRACE = _head + "up(id, depth)" + _rest.split("\nbest AS", 1)[0] + "\npaths(id, path) AS (" + _paths + "\nbest AS" + _rest.split("\nbest AS", 1)[1]


def _ends(e: DataFrame) -> tuple[str, str]:
    rare = e.groupBy("target_id").count().orderBy("count", "target_id").first()[0]
    return _busiest(e, "source_id"), rare


@query("trace_path", f"{_TRACE} SELECT unnest(range(len(path)))::INT AS pos, unnest(path) AS id FROM best")
def _(spark, d):
    _, e = _succession(spark, d)
    return graph.shortest_path(graph.steps(graph.strict(e), ["calls"]), *_ends(e), 8)


@query("trace_calls", f"{_TRACE} SELECT unnest(range(len(path)))::INT AS pos, unnest(path) AS id, 'calls_only' AS resolution FROM best")
def _(spark, d):
    _, e = _succession(spark, d)
    return graph.trace(e, *_ends(e))


@query("trace_soft", """WITH n AS (SELECT max(n_nationkey) AS k, n_regionkey AS r FROM nation WHERE n_nationkey <> 0 AND n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 0) GROUP BY n_regionkey)
SELECT 0 AS pos, 'n:0' AS id, 'soft' AS resolution UNION ALL SELECT 1, 'r:' || r, 'soft' FROM n UNION ALL SELECT 2, 'n:' || k, 'soft' FROM n""")
def _(spark, d):
    """From a nation to the last of its region: no calls lead there, but both inherit the region."""
    nation = b.table(spark, d, "nation")
    region = nation.where("n_nationkey = 0").first()["n_regionkey"]
    other = nation.where((F.col("n_regionkey") == region) & (F.col("n_nationkey") != 0)).agg(F.max("n_nationkey")).first()[0]
    return graph.trace(stash(b.edges(spark, d), "edges"), "n:0", f"n:{other}")


@query("verify", f"{GRAPH} SELECT 0 AS pos, 'c:1' AS id UNION ALL SELECT 1, 'n:' || c_nationkey FROM customer WHERE c_custkey = 1")
def _(spark, d):
    nation = b.table(spark, d, "customer").where("c_custkey = 1").first()["c_nationkey"]
    return composites.verify(b.edges(spark, d), f"c:1 imports n:{nation}")


_TURNS = """
WITH t AS (SELECT DISTINCT conv_id, turn, 't:' || lpad(conv_id::VARCHAR, 12, '0') || '/' || lpad(turn::VARCHAR, 6, '0') AS id FROM conversations),
runs AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t)"""


@query("ancestors", f"{_TURNS} SELECT a.id, b.id AS ancestor, (b.turn - a.turn)::INT AS depth FROM runs a JOIN runs b ON a.conv_id = b.conv_id AND a.run = b.run AND b.turn > a.turn")
def _(spark, d):
    return graph.ancestors(b.turns(spark, d)[1])


@query("flows_linear", f"{_TURNS} SELECT min(id) OVER (PARTITION BY conv_id, run) AS chain, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS pos, id FROM runs QUALIFY count(*) OVER (PARTITION BY conv_id, run) >= 3")
def _(spark, d):
    return graph.linear_chains(*b.turns(spark, d))


@query("dispatches", """WITH m AS (SELECT DISTINCT 'm:' || p_brand || '/' || p_type || '.' || p_name AS id, p_name AS name, p_brand, p_type FROM part),
k AS (SELECT *, dense_rank() OVER (ORDER BY p_type) AS r FROM m)
SELECT b.id AS source_id, a.id AS target_id, 'dispatches_to' AS edge_type, 0.5::DOUBLE AS weight, b.p_brand || '/' || b.p_type AS via
FROM k a JOIN k b ON a.p_brand = b.p_brand AND a.name = b.name AND b.r < a.r QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.r DESC) = 1""")
def _(spark, d):
    """A brand's types are classes, each heir of the one before in order; equal names are methods."""
    part = b.table(spark, d, "part")
    cls = F.concat("p_brand", F.lit("/"), "p_type")
    methods = part.select(F.concat(F.lit("m:"), cls, F.lit("."), "p_name").alias("id"), F.col("p_name").alias("name"), cls.alias("parent_id")).distinct()
    kinds = part.select("p_type").distinct().groupBy().agg(F.array_sort(F.collect_list("p_type")).alias("all"))
    pairs = kinds.select(F.explode(F.expr("transform(sequence(1, size(all) - 1), i -> struct(all[i] AS heir, all[i - 1] AS base))")).alias("x")).select("x.heir", "x.base")
    inherits = part.select("p_brand").distinct().crossJoin(pairs).select(F.concat("p_brand", F.lit("/"), "heir").alias("source_id"), F.concat("p_brand", F.lit("/"), "base").alias("target_id"))
    return graph.dispatches(methods, graph.ancestors(inherits))


# -- history


@query("file_stats", f"{EVENT_COMMITS},{_stats(b.AS_OF_EVENTS)} SELECT * FROM stats")
def _(spark, d):
    return history.file_stats(b.event_commits(spark, d), b.AS_OF_EVENTS)


@query("file_stats_orders", f"WITH {ORDER_COMMITS.strip()},{_stats(b.AS_OF_ORDERS)} SELECT * FROM stats")
def _(spark, d):
    return history.file_stats(b.order_commits(spark, d), b.AS_OF_ORDERS)


@query("cochanges", f"{EVENT_COMMITS},{PAIRS} SELECT * FROM pairs")
def _(spark, d):
    return history.cochanges(b.event_commits(spark, d)).drop("commit_ids")


@query("cochange_file", f"{EVENT_COMMITS},{PAIRS} SELECT CASE WHEN file_a = 'click' THEN file_b ELSE file_a END AS other, co_commit_count, coupling_score FROM pairs WHERE 'click' IN (file_a, file_b) AND co_commit_count >= 3")
def _(spark, d):
    return history.cochange_of(history.cochanges(b.event_commits(spark, d)), "click")


@query("couplings", f"{EVENT_COMMITS},{PAIRS} SELECT file_a, file_b, coupling_score, co_commit_count FROM pairs WHERE coupling_score >= 0.35")
def _(spark, d):
    return history.couplings(history.cochanges(b.event_commits(spark, d)), 0.35)


@query("diff_hotspots", f"WITH {ORDER_COMMITS.strip()} SELECT file_path, count(*) AS commits FROM (SELECT date, unnest(files) AS file_path FROM commits) WHERE date >= TIMESTAMP '{b.AS_OF_ORDERS}' - INTERVAL 7 DAY GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return history.hotspots(b.order_commits(spark, d), b.AS_OF_ORDERS)


@query("git_log", """SELECT md5(user_id::VARCHAR || strftime(ts, '%Y-%m-%d')) AS hash, CASE WHEN user_id % 2 = 0 THEN 'U' || user_id || ' (@u' || user_id || ')' ELSE 'U' || user_id || ' <u@x.org>' END AS author,
  date_trunc('day', min(ts))::TIMESTAMP AS date, count(DISTINCT event_type)::INT AS n_files FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d')""")
def _(spark, d):
    """events written as logs, a log for each user, and parsed."""
    e = b.table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    user = F.col("user_id").cast("string")
    mail = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("12+u"), user, F.lit("@users.noreply.github.com"))).otherwise("u@x.org")
    head = F.concat_ws("|", F.lit("COMMIT"), F.md5(F.concat(user, "day")), F.concat(F.lit("U"), user, F.lit(" <"), mail, F.lit(">")), F.concat("day", F.lit("T00:00:00+00:00")))
    per = e.groupBy("user_id", "day").agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    lines = per.select(user.alias("log"), "day", F.posexplode(F.concat(F.array(head), F.col("types"), F.array(F.lit("")))).alias("i", "line"))
    return history.parse_log(lines.select("log", (F.unix_date(F.to_date("day")) * 1000 + F.col("i")).cast("long").alias("n"), "line")).select("hash", "author", "date", F.size("files").alias("n_files"))


# -- text and search

TERMS, PREFIXES, QUESTION = ["the", "and", "que", "les", "der"], ["tion", "ent", "wh", "qua"], "where are the tioners of src12 and thering"
_IN = ", ".join(f"'{t}'" for t in TERMS)


def _keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.extract_keywords(b.document_nodes(spark, sf_dir))


@query("keywords", f"{KEYWORDS} SELECT keyword, node_id, source FROM keywords")
def _(spark, d):
    return _keywords(spark, d)


@query("kw_search", f"{KEYWORDS} SELECT node_id, count(DISTINCT keyword) AS matches FROM keywords WHERE keyword IN ({_IN}) GROUP BY 1")
def _(spark, d):
    return search.search_counts(_keywords(spark, d), TERMS)


@query("kw_weighted", f"{KEYWORDS} SELECT node_id, sum({_WEIGHT})::BIGINT AS score FROM keywords WHERE keyword IN ({_IN}) GROUP BY 1")
def _(spark, d):
    return search.search_weighted(_keywords(spark, d), TERMS)


@query("kw_prefix", f"{KEYWORDS} SELECT node_id, sum({_WEIGHT})::BIGINT AS score FROM keywords WHERE starts_with(keyword, 'tion') OR starts_with(keyword, 'ent') OR starts_with(keyword, 'qua') GROUP BY 1")
def _(spark, d):
    return search.search_prefix(_keywords(spark, d), PREFIXES)


@query("name_search", "SELECT 'd:' || doc_id AS node_id, (contains(lower(source || '_' || lang), 'src1')::INT + contains(lower(source || '_' || lang), 'fr')::INT)::BIGINT AS matches FROM documents WHERE matches > 0")
def _(spark, d):
    return search.search_names(b.document_nodes(spark, d), ["src1", "fr"])


_SEEDS = f"""{KEYWORDS}, sums AS (
  SELECT node_id, sum({_WEIGHT}) FILTER (keyword IN ('tioners', 'src12', 'thering')) AS e, sum({_WEIGHT}) FILTER (starts_with(keyword, 'tioner') OR starts_with(keyword, 'src12') OR starts_with(keyword, 'ther')) AS p
  FROM keywords GROUP BY 1),
seeds AS (SELECT node_id, CASE WHEN e IS NOT NULL THEN greatest(e, p)::DOUBLE ELSE p::DOUBLE * 0.6::DOUBLE END AS score FROM sums WHERE p IS NOT NULL)"""


@query("navigate_seeds", f"{_SEEDS} SELECT node_id, score FROM seeds")
def _(spark, d):
    return search.seed_scores(_keywords(spark, d), QUESTION)


@query("navigate", f"""{_SEEDS}, best AS (SELECT * FROM seeds ORDER BY score DESC, node_id LIMIT 40), kept AS (
  SELECT node_id, score, source || '_' || lang AS name, lang || '/' || source AS path, length(text) AS n FROM best JOIN documents ON node_id = 'd:' || doc_id ORDER BY score DESC, node_id LIMIT 20),
c AS (SELECT *, contains(path, 'tioners')::INT + (contains(path, 'src12') OR contains(name, 'src12'))::INT + contains(path, 'thering')::INT AS coverage FROM kept)
SELECT node_id, score AS match, coverage, coverage > 0 AS strong, score * 2.0::DOUBLE + n::DOUBLE / 1000 * 0.15::DOUBLE + 1.5::DOUBLE + coverage * 1.8::DOUBLE AS score FROM c""")
def _(spark, d):
    n = b.document_nodes(spark, d).withColumn("importance", F.col("n") / 1000)
    return search.navigate_scores(n, search.extract_keywords(n), QUESTION).select("node_id", "match", "coverage", "strong", "score")


@query("fuzzy_tiers", "SELECT 'c:' || c_custkey AS id, CASE WHEN lower(c_name) = 'customer#000000012' THEN 0.98 ELSE 0.70 END::DOUBLE AS score FROM customer WHERE contains(lower(c_name), 'customer#000000012')")
def _(spark, d):
    return search.fuzzy_scores(b.nodes(spark, d), "Customer#000000012", similar=False)


@query("fuzzy_find")
def _(spark, d):
    return search.fuzzy_find(b.nodes(spark, d), "Suplier#00000012")


@query("identifier_parts", "SELECT doc_id, array_to_string(list_transform(string_split(source || '_' || lang, '_'), lambda x: lower(x)), ' ') AS parts, regexp_replace(source, '^src', 'src') AS stem FROM documents")
def _(spark, d):
    docs = b.table(spark, d, "documents")
    return docs.select("doc_id", F.concat_ws(" ", tx.identifier_parts(F.concat("source", F.lit("_"), "lang"))).alias("parts"), tx.stem_col(F.col("source")).alias("stem"))


_STOP_WORDS = ", ".join(f"'{w}'" for w in sorted(tx.QUERY_STOPS))


@query("query_terms", rf"""WITH w AS (SELECT item_id, unnest(regexp_split_to_array(text, '\s+')) AS w, generate_subscripts(regexp_split_to_array(text, '\s+'), 1) AS i FROM benchmark),
k AS (SELECT item_id, lower(w) AS w, min(i) AS i FROM w WHERE length(w) >= 2 AND lower(w) NOT IN ({_STOP_WORDS}) GROUP BY item_id, lower(w))
SELECT item_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS terms FROM benchmark LEFT JOIN k USING (item_id) GROUP BY item_id""")
def _(spark, d):
    return b.table(spark, d, "benchmark").select("item_id", F.concat_ws(" ", tx.query_terms_col(F.col("text"))).alias("terms"))


@query("string_refs", r"""WITH l AS (SELECT lang || '/' || source || '/d' || lpad(doc_id::VARCHAR, 12, '0') || '.py' AS file_path, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\r\n|\r|\n'), 1)::INT AS line_number FROM documents)
SELECT DISTINCT unnest(regexp_extract_all(line, '["'']([A-Za-z_]\w{2,63})["'']', 1)) AS literal, file_path, line_number, 'string_literal' AS context FROM l WHERE NOT regexp_matches(line, '^\s*(#|//|/\*|\*)')""")
def _(spark, d):
    return content.string_refs(b.files(spark, d))


@query("uses", r"""WITH l AS (SELECT lang || '/' || source || '/d' || lpad(doc_id::VARCHAR, 12, '0') || '.py' AS file_path, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\r\n|\r|\n'), 1)::INT AS line_number FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_number) AS k FROM l WHERE regexp_matches(line, '\bthe\b') AND NOT regexp_matches(line, '^\s*(#|//|/\*|\*|--|;)'))
SELECT file_path, line_number, line FROM k WHERE k <= 200 ORDER BY file_path, line_number LIMIT 500""")
def _(spark, d):
    return content.uses(b.files(spark, d), "the")


@query("file_hash", "SELECT lang || '/' || source || '/d' || lpad(doc_id::VARCHAR, 12, '0') || '.py' AS file_path, md5(text) AS content_hash FROM documents")
def _(spark, d):
    return content.file_hashes(b.files(spark, d))


@query("file_hash_diff", "SELECT doc_id::VARCHAR AS file_path, CASE WHEN lang = 'fr' THEN 'new' WHEN lang = 'de' THEN 'deleted' ELSE 'changed' END AS status FROM documents WHERE lang IN ('fr', 'de') OR (lang = 'es' AND trim(text, ' ') <> text || 'x')")
def _(spark, d):
    """French documents are new, German ones gone, Spanish ones changed."""
    docs = b.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), "text", "lang")
    h = lambda c: F.md5(c).alias("content_hash")
    old = docs.where("lang <> 'fr'").select("file_path", h(F.col("text")))
    new = docs.where("lang <> 'de'").select("file_path", h(F.when(F.col("lang") == "es", F.concat("text", F.lit("x"))).otherwise(F.col("text"))))
    return content.hash_diff(old, new)


@query("symbol_hashes", r"SELECT 'd:' || doc_id AS id, substr(md5(array_to_string(regexp_split_to_array(text, '\r\n|\r|\n'), chr(10))), 1, 8) AS content_hash FROM documents")
def _(spark, d):
    n = b.document_nodes(spark, d).withColumn("line_end", F.size(tx.lines_of(F.col("docstring"))))
    return content.symbol_hashes(n.select("id", F.col("id").alias("file_path"), "line_start", "line_end"), n.select(F.col("id").alias("file_path"), F.col("docstring").alias("content")))


@query("path_categories", r"""SELECT page_id, CASE WHEN contains(p, '/fr/') THEN 'doc' WHEN contains(p, '/de/') THEN 'test' ELSE 'core' END AS category, CASE WHEN ends_with(p, '.html') THEN '' WHEN contains(p, '/es/') THEN 'go' ELSE 'python' END AS language, NOT contains(p, '/fr/') AND contains(p, '/es/') AS ignored
FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS p FROM pages)""")
def _(spark, d):
    """Page addresses as paths, languages as directories."""
    p = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    pages = b.table(spark, d, "pages").select("page_id", p.alias("p"))
    as_dirs = F.regexp_replace(F.regexp_replace(F.col("p"), "/fr/", "/docs/"), "/de/", "/tests/")
    path = F.substr(F.concat(as_dirs, F.when(F.col("p").endswith(".html"), "").when(F.col("p").contains("/es/"), "x.go").otherwise("x.py")), F.lit(2))
    rules = ["*.nothing", "es/", "!docs/"]
    return pages.select("page_id", tx.category(path).alias("category"), source_files.language(path).alias("language"), tx.ignored(path, rules).alias("ignored"))


@query("lang_counts", "SELECT CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'go' WHEN 'de' THEN 'rust' ELSE '' END AS language, count(*) AS files FROM documents GROUP BY 1")
def _(spark, d):
    ending = F.when(F.col("lang") == "en", ".PY").when(F.col("lang") == "fr", ".go").when(F.col("lang") == "de", ".rs").otherwise(".txt")
    return source_files.language_counts(b.table(spark, d, "documents").select(F.concat(F.lit("a/b"), ending).alias("file_path")))


@query("tech_stack", "SELECT 'Python' AS technology UNION SELECT CASE event_type WHEN 'click' THEN 'Flask' WHEN 'view' THEN 'React' WHEN 'purchase' THEN 'PyTorch' END FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def _(spark, d):
    """Some kinds of events stand for frameworks' names."""
    named = F.create_map(*(F.lit(x) for kv in (("click", "flask"), ("view", "react"), ("purchase", "torch")) for x in kv))[F.col("event_type")]
    return composites.tech_stack(b.table(spark, d, "events").select(F.coalesce(named, F.col("event_type")).alias("keyword")).distinct())


# -- linker, contracts, patterns

_LINK = """
WITH sym AS (SELECT 'p:' || p_partkey AS id, p_name || ' ' || p_size AS name, p_type || '/' || p_brand || '.py' AS file_path, p_brand, p_type, p_size FROM part),
e AS (SELECT DISTINCT 'p:' || a.l_partkey AS s, 'p:' || b.l_partkey AS t FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey),
c AS (SELECT e.s || '>' || e.t AS call_id, e.s AS caller_id, x.file_path AS caller_file, x.p_type AS caller_type, x.p_brand AS caller_brand, y.name, CASE WHEN y.p_size > 25 THEN y.p_brand ELSE '' END AS receiver, y.p_size AS size FROM e JOIN sym x ON x.id = e.s JOIN sym y ON y.id = e.t),
k AS (SELECT call_id, caller_id, m.id AS target_id, size, receiver <> '' AND m.p_brand = receiver AS r, m.file_path = caller_file AS f, m.file_path = 'PROMO/' || caller_brand || '.py' OR m.file_path = caller_file AS i, m.p_type = caller_type AS o FROM c JOIN sym m USING (name)),
n AS (SELECT *, count(*) OVER w AS total, sum(r::INT) OVER w AS rs FROM k WINDOW w AS (PARTITION BY call_id)),
z AS (SELECT *, sum(f::INT) OVER w AS fs, sum(i::INT) OVER w AS js, sum(o::INT) OVER w AS os, row_number() OVER (PARTITION BY call_id ORDER BY CASE WHEN f THEN 0 WHEN i THEN 1 ELSE 2 END, target_id) AS place FROM n WHERE total = 1 OR rs = 0 OR r WINDOW w AS (PARTITION BY call_id)),
q AS (SELECT *, CASE WHEN total = 1 THEN 2 WHEN rs = 1 THEN 3 WHEN fs = 1 THEN 4 WHEN js = 1 THEN 5 WHEN os = 1 THEN 7 ELSE 8 END AS rule FROM z),
linked AS (SELECT call_id, caller_id, target_id, size, CASE WHEN rule = 8 THEN 'low' ELSE 'high' END AS confidence, rule FROM q WHERE CASE rule WHEN 4 THEN f WHEN 5 THEN i WHEN 7 THEN o WHEN 8 THEN place <= 6 ELSE true END)"""


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    calls = b.part_calls(spark, sf_dir)
    return calls, linker.resolved(calls, b.part_symbols(spark, sf_dir), b.part_imports(spark, sf_dir), keep=["error_handling", "return_usage"])


@query("link_calls", f"{_LINK} SELECT call_id, caller_id, target_id, confidence, rule FROM linked")
def _(spark, d):
    return linker.link_calls(b.part_calls(spark, d), b.part_symbols(spark, d), b.part_imports(spark, d))


@query("call_edges", f"{_LINK} SELECT caller_id AS source_id, target_id, 'calls' AS edge_type, 1.0::DOUBLE AS weight, arg_min(confidence, call_id) AS confidence FROM linked GROUP BY caller_id, target_id")
def _(spark, d):
    return linker.call_edges(_linked(spark, d)[1].drop("error_handling", "return_usage"))


@query("contracts_linked", f"""{_LINK}, rows AS (SELECT target_id AS function_id, caller_id, CASE WHEN size > 45 THEN 'try_except:ValueError' WHEN size > 40 THEN 'try_except' ELSE 'none' END AS eh, CASE WHEN size > 10 THEN 'assigned' ELSE 'ignored' END AS ru, call_id FROM linked WHERE confidence = 'high')
SELECT function_id, caller_id, arg_max(eh, call_id) AS error_handling, arg_max(ru, call_id) AS return_usage FROM rows GROUP BY function_id, caller_id""")
def _(spark, d):
    return linker.contracts(*_linked(spark, d))


@query("resolve_imports", """WITH f AS (SELECT DISTINCT p_type, p_brand, p_type || '/' || p_brand || '.py' AS file_path FROM part)
SELECT file_path, 'PROMO.' || p_brand AS module_path, CASE WHEN 'PROMO/' || p_brand || '.py' IN (SELECT file_path FROM f) THEN 'PROMO/' || p_brand || '.py' ELSE '' END AS resolved_to_file FROM f
UNION ALL SELECT file_path, 'os.path', '' FROM f UNION ALL SELECT file_path, '..' || p_type || '.' || p_brand, file_path FROM f""")
def _(spark, d):
    return linker.resolve_imports(b.part_imports(spark, d), b.part_symbols(spark, d))


@query("import_edges", """WITH f AS (SELECT DISTINCT p_type, p_brand, p_type || '/' || p_brand || '.py' AS file_path FROM part),
r AS (SELECT file_path, 'PROMO/' || p_brand || '.py' AS t FROM f WHERE t IN (SELECT file_path FROM f) UNION SELECT file_path, file_path FROM f),
s AS (SELECT p_type || '/' || p_brand || '.py' AS t, min('p:' || p_partkey) AS id FROM part WHERE p_name = 'red widget' AND p_size = 7 GROUP BY 1)
SELECT file_path AS source_id, t AS target_id, 'imports' AS edge_type, 1.0::DOUBLE AS weight FROM r WHERE file_path <> t UNION SELECT file_path, id, 'imports', 1.0::DOUBLE FROM r JOIN s USING (t)""")
def _(spark, d):
    s = b.part_symbols(spark, d)
    return linker.import_edges(b.part_imports(spark, d), s, s)


@query("inherits_edges", """WITH c AS (SELECT DISTINCT p_type || '/' || p_brand AS id, p_brand AS name, p_type FROM part), base AS (SELECT name, min(id) AS id FROM c GROUP BY name)
SELECT c.id AS source_id, (SELECT min(o.id) FROM c o WHERE o.name = c.name AND o.id <> c.id) AS target_id, 'inherits' AS edge_type, 1.0::DOUBLE AS weight FROM c WHERE target_id IS NOT NULL""")
def _(spark, d):
    """A brand of a type extends the first other class of its name."""
    c = b.table(spark, d, "part").select(F.concat("p_type", F.lit("/"), "p_brand").alias("id"), F.col("p_brand").alias("name"), F.col("p_type").alias("file_path"), F.array(F.concat(F.lit("mod."), "p_brand")).alias("bases")).distinct()
    return linker.inherits_edges(c)


@query("contract_conflicts", f"{CONTRACTS} SELECT function_id FROM contracts GROUP BY 1 HAVING count(DISTINCT error_handling) > 1 OR count(DISTINCT return_usage) > 1")
def _(spark, d):
    return linker.contract_conflicts(b.contract_rows(spark, d))


@query("contract_report", f"""{CONTRACTS} SELECT function_id, count(*) AS caller_count, array_to_string(list_sort(list(DISTINCT error_handling)), ',') AS error_strategies, array_to_string(list_sort(list(DISTINCT return_usage)), ',') AS return_strategies
FROM contracts GROUP BY 1 HAVING count(DISTINCT error_handling) > 1 OR count(DISTINCT return_usage) > 1""")
def _(spark, d):
    r = linker.contract_report(b.contract_rows(spark, d))
    return r.select("function_id", "caller_count", F.concat_ws(",", "error_strategies").alias("error_strategies"), F.concat_ws(",", "return_strategies").alias("return_strategies"))


def _pattern_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as functions named by segment, nations as abstract classes, parts as methods named by size."""
    n = b.nodes(spark, sf_dir).where("kind <> 'method'")
    part = b.table(spark, sf_dir, "part")
    words = F.array(*map(F.lit, ["emit", "on", "get_x", "save_all", "update", "delete_one", "attach", "detach", "instance", "other"]))
    methods = part.select(
        F.concat(F.lit("b:"), "p_brand", F.lit("/"), "p_type", F.lit("."), F.get(words, F.col("p_size") % 10)).alias("id"), F.lit("method").alias("kind"), F.get(words, F.col("p_size") % 10).alias("name"),
        F.col("p_brand").alias("file_path"), F.lit("").alias("signature"), F.lit("").alias("docstring"), F.array().cast("array<string>").alias("tags"), F.concat(F.lit("b:"), "p_brand", F.lit("/"), "p_type").alias("parent_id"),
    ).distinct()
    classes = part.select(F.concat(F.lit("b:"), "p_brand", F.lit("/"), "p_type").alias("id"), F.lit("class").alias("kind"), F.col("p_brand").alias("name"), F.col("p_brand").alias("file_path"), F.lit("").alias("signature"), F.lit("").alias("docstring"), F.array().cast("array<string>").alias("tags"), F.lit("").alias("parent_id")).distinct()
    abstract = F.when(F.col("kind") == "file", F.array(F.lit("abstract"))).otherwise(F.col("tags"))
    named = n.withColumn("tags", abstract).withColumn("kind", F.when(F.col("kind") == "file", "class").otherwise(F.col("kind"))).withColumn("name", F.when(F.col("id").startswith("s:"), F.concat(F.lit("make_"), "name")).otherwise(F.col("name")))
    return stash(named.unionByName(methods).unionByName(classes), "pattern-nodes"), stash(b.edges(spark, sf_dir), "edges")


_PATTERNS = f"""{GRAPH}, m AS (SELECT DISTINCT 'b:' || p_brand || '/' || p_type AS id, ['emit', 'on', 'get_x', 'save_all', 'update', 'delete_one', 'attach', 'detach', 'instance', 'other'][p_size % 10 + 1] AS name FROM part),
g AS (SELECT id, list(name) AS names FROM m GROUP BY id),
found AS (
  SELECT id AS node_id, 'event_bus' AS pattern FROM g WHERE list_has_all(names, ['emit', 'on'])
  UNION ALL SELECT s.id, 'factory' FROM nodes s WHERE starts_with(s.id, 's:') AND s.id IN (SELECT target_id FROM edges WHERE edge_type = 'calls')
  UNION ALL SELECT target_id, 'strategy' FROM edges WHERE edge_type = 'inherits' GROUP BY target_id HAVING count(*) >= 2
  UNION ALL SELECT id, 'middleware_chain' FROM (SELECT id, count(*) OVER (PARTITION BY regexp_replace(file_path, '/?[^/]*$', '')) AS n FROM nodes WHERE kind = 'function' AND regexp_matches(lower(signature), 'next|handler|request|response|middleware')) WHERE n >= 3
  UNION ALL SELECT id, 'repository' FROM g WHERE list_contains(names, 'get_x')::INT + list_contains(names, 'save_all')::INT + list_contains(names, 'update')::INT + list_contains(names, 'delete_one')::INT >= 3
  UNION ALL SELECT id, 'singleton' FROM g WHERE list_contains(names, 'instance')
  UNION ALL SELECT id, 'observer' FROM g WHERE list_has_all(names, ['attach', 'detach']))"""


@query("patterns", f"{_PATTERNS} SELECT node_id, pattern FROM found")
def _(spark, d):
    return patterns.detect(*_pattern_graph(spark, d)).select("node_id", "pattern")


@query("patterns_grouped", f"{_PATTERNS} SELECT pattern, count(*) AS total, array_to_string(list_sort(list(node_id))[1:3], ',') AS shown FROM found GROUP BY pattern")
def _(spark, d):
    return patterns.grouped(patterns.detect(*_pattern_graph(spark, d))).select("pattern", "total", F.concat_ws(",", "shown").alias("shown"))


@query("stats_patterns", f"{_PATTERNS} SELECT pattern, count(*) AS n FROM found GROUP BY pattern")
def _(spark, d):
    return patterns.counts(patterns.detect(*_pattern_graph(spark, d)))


# -- reports


def _part_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = b.table(spark, sf_dir, "lineitem")
    rows = lines.groupBy("l_partkey", "l_suppkey").agg(F.min("l_returnflag").alias("error_handling"), F.min("l_linestatus").alias("return_usage"))
    return linker.contract_conflicts(rows.select(F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("function_id"), "error_handling", "return_usage"))


_BESIDE = "beside AS (SELECT target_id AS id FROM edges WHERE source_id IN (SELECT id FROM tests) UNION SELECT source_id FROM edges WHERE target_id IN (SELECT id FROM tests))"
_CALLERS = "callers AS (SELECT target_id AS id, count(*) AS n FROM edges WHERE edge_type = 'calls' GROUP BY 1)"


def _common_sql(who: str) -> str:
    return f"""
  SELECT id AS node_id, 'HIGH_IMPACT' AS category, 'high' AS confidence, n::VARCHAR AS evidence FROM callers JOIN {who} USING (id) WHERE n >= 5
  UNION ALL SELECT function_id, 'CONTRACT_CONFLICT', 'high', '' FROM conflicts JOIN {who} ON id = function_id
  UNION ALL SELECT id, 'ACTIVE_CHURN', 'high', commits_7d::VARCHAR FROM {who} JOIN stats USING (file_path) WHERE commits_7d >= 3
  UNION ALL SELECT id, 'MULTI_AUTHOR', 'high', author_count::VARCHAR FROM {who} JOIN stats USING (file_path) WHERE author_count >= 3
  UNION ALL SELECT id, 'PATTERN', 'low', 'middleware_chain' FROM (SELECT id, count(*) OVER (PARTITION BY regexp_replace(file_path, '/?[^/]*$', '')) AS n FROM nodes WHERE kind = 'function' AND regexp_matches(lower(signature), 'next|handler|request|response|middleware')) WHERE n >= 3
  UNION ALL SELECT target_id, 'PATTERN', 'low', 'strategy' FROM edges JOIN nodes ON id = target_id WHERE edge_type = 'inherits' AND kind = 'class' GROUP BY target_id HAVING count(*) >= 2"""


_WARN = f"{SCORED},{COVER},{ORDER_COMMITS},{_stats(b.AS_OF_ORDERS)},{PAIRS},{PART_CONFLICTS}, {_CALLERS}, {_BESIDE}, symbols AS (SELECT * FROM nodes WHERE kind <> 'file')"


def _reports(spark: SparkSession, sf_dir: str):
    """What the engine has stored when it makes reports."""
    n, e = _scored(spark, sf_dir)
    commits = stash(b.order_commits(spark, sf_dir), "commits")
    return n, e, stash(history.file_stats(commits, b.AS_OF_ORDERS), "stats"), stash(_part_conflicts(spark, sf_dir), "conflicts"), commits


@query("warnings", f"""{_WARN}{_common_sql('nodes')}
  UNION ALL SELECT id, 'NO_TESTS', 'medium', 'max_hops=3' FROM nodes JOIN importance USING (id) WHERE importance > 5 AND NOT list_contains(tags, 'test') AND id NOT IN (SELECT id FROM cover)
  UNION ALL SELECT id, 'TEMPORAL_COUPLING', 'medium', count(*)::VARCHAR FROM nodes JOIN pairs ON file_path IN (file_a, file_b) WHERE coupling_score >= 0.5 AND co_commit_count >= 3 GROUP BY id""".replace(f"{ORDER_COMMITS}", ORDER_COMMITS))
def _(spark, d):
    n, e, stats, conflicts, commits = _reports(spark, d)
    return composites.warnings(n, e, stats, conflicts, history.cochanges(commits), patterns.detect(n, e))


@query("warnings_viz", f"""{_WARN}{_common_sql('symbols')}
  UNION ALL SELECT id, 'NO_TESTS', 'medium', 'adjacent' FROM symbols JOIN importance USING (id) WHERE importance > 5 AND NOT list_contains(tags, 'test') AND id NOT IN (SELECT id FROM beside)""")
def _(spark, d):
    n, e, stats, conflicts, _ = _reports(spark, d)
    return composites.warnings_viz(n, e, stats, conflicts, patterns.detect(n, e))


def _fragile_sql(many: int) -> str:
    return f"""{SCORED},{PART_CONFLICTS}, {_CALLERS}, tests AS (SELECT id FROM nodes WHERE list_contains(tags, 'test')), {_BESIDE},
z AS (SELECT n.id, importance, NOT list_contains(tags, 'test') AND n.id NOT IN (SELECT id FROM beside) AS untested, CASE WHEN c.n >= {many} THEN c.n ELSE 0 END::BIGINT AS callers, n.id IN (SELECT function_id FROM conflicts) AS conflict
  FROM nodes n JOIN importance USING (id) LEFT JOIN callers c ON c.id = n.id WHERE importance >= 15 AND kind <> 'file')
SELECT id, importance, untested, callers, conflict FROM z WHERE (untested OR callers > 0 OR conflict) AND (importance >= 25 OR callers > 0 OR conflict)"""


@query("fragile_zones", _fragile_sql(8))
def _(spark, d):
    n, e = _scored(spark, d)
    return composites.fragile_zones(n, e, _part_conflicts(spark, d))


@query("fragile_zones_viz", f"{_fragile_sql(5)} ORDER BY importance DESC, id LIMIT 30")
def _(spark, d):
    n, e = _scored(spark, d)
    return composites.fragile_zones(n, e, _part_conflicts(spark, d), 5).orderBy(F.desc("importance"), "id").limit(30)


@query("peek", f"""{SCORED},{COVER}, goal AS (SELECT target_id AS id FROM calls GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT n.id, kind, name, file_path, signature, '' AS docstring_first_line, importance, array_to_string(tags, ',') AS tags,
  coalesce((SELECT array_to_string(list_sort(list(target_id))[1:8], ',') FROM calls WHERE source_id = n.id), '') AS callees, (SELECT count(*) FROM calls WHERE source_id = n.id) AS callees_total,
  (SELECT count(*) FROM calls WHERE target_id = n.id) AS caller_count, coalesce(direct_count, 0)::BIGINT AS direct_count, coalesce(transitive, false) AS transitive, coalesce(hops, 0)::INT AS hops
FROM nodes n JOIN goal USING (id) JOIN importance USING (id) LEFT JOIN cover USING (id)""")
def _(spark, d):
    n, e = _scored(spark, d)
    return composites.peek(n, e, _busiest(e.where("edge_type = 'calls'"), "target_id"))


@query("tree_file", f"""{GRAPH} SELECT n.id, kind, name, parent_id, (SELECT count(*) FROM edges WHERE edge_type = 'calls' AND target_id = n.id) AS caller_count,
  (SELECT count(*) FROM edges e JOIN nodes s ON s.id = e.source_id WHERE edge_type = 'calls' AND target_id = n.id AND s.file_path <> n.file_path) AS outside FROM nodes n WHERE file_path = 'Brand#2/PROMO'""")
def _(spark, d):
    return composites.tree(b.nodes(spark, d), b.edges(spark, d), "Brand#2/PROMO")


@query("tree_summary", f"""{GRAPH}, per AS (SELECT file_path, count(*) FILTER (kind = 'class') AS class_count, count(*) FILTER (kind = 'method') AS method_count, count(*) FILTER (kind = 'function') AS function_count FROM nodes WHERE kind <> 'file' GROUP BY 1),
o AS (SELECT t.file_path, count(DISTINCT source_id) AS n FROM edges JOIN nodes t ON t.id = target_id JOIN nodes s ON s.id = source_id WHERE edge_type = 'calls' AND s.file_path <> t.file_path GROUP BY 1)
SELECT file_path, class_count, method_count, function_count, coalesce(n, 0) AS called_by FROM per LEFT JOIN o USING (file_path)""")
def _(spark, d):
    return composites.tree_summary(b.nodes(spark, d), b.edges(spark, d)).select("file_path", *(F.col(c).cast("long").alias(c) for c in ("class_count", "method_count", "function_count", "called_by")))


@query("viz_export", f"""{SCORED}, top AS MATERIALIZED (SELECT n.id, parent_id FROM nodes n JOIN importance USING (id) WHERE kind <> 'file' ORDER BY importance DESC, n.id LIMIT 1000),
kept AS MATERIALIZED (
  SELECT id FROM top UNION SELECT n.id FROM nodes n SEMI JOIN top t ON t.parent_id = n.id WHERE kind = 'file'
  UNION SELECT id FROM nodes WHERE kind = 'file' AND (SELECT count(*) FROM nodes) <= 1000)
SELECT source_id, target_id, edge_type FROM edges SEMI JOIN kept a ON a.id = source_id SEMI JOIN kept z ON z.id = target_id""")
def _(spark, d):
    n, e = _scored(spark, d)
    return composites.viz_edges(e, composites.viz_nodes(n)).select("source_id", "target_id", "edge_type")


@query("ask_calls", "SELECT 'p:1' AS caller, 's:' || l_suppkey AS callee, NOT bool_and(l_returnflag = 'R') AS direct FROM lineitem WHERE l_partkey = 1 GROUP BY l_suppkey ORDER BY l_suppkey LIMIT 1")
def _(spark, d):
    callee = b.table(spark, d, "lineitem").where("l_partkey = 1").agg(F.min("l_suppkey")).first()[0]
    return composites.ask_calls(b.edges(spark, d), "p:1", f"s:{callee}")


@query("ask_all", f"""{GRAPH} SELECT n.id, signature, starts_with(signature, 'async ') AS is_async, CASE WHEN contains(signature, '-> ') THEN split_part(signature, '-> ', 2) ELSE '' END AS returns,
  (SELECT count(*) FROM edges WHERE edge_type = 'calls' AND target_id = n.id) AS callers_count FROM nodes n WHERE kind <> 'file'""")
def _(spark, d):
    return composites.ask_all(b.nodes(spark, d), b.edges(spark, d))


@query("domain_members", "WITH k AS (SELECT DISTINCT lower(p_name) || ' ' || p_size AS keyword, p_brand || '/' || p_type AS node_id FROM part) SELECT keyword, count(*)::INT AS n, min(node_id) AS first_id FROM k WHERE length(keyword) >= 4 GROUP BY keyword HAVING count(*) BETWEEN 3 AND 15")
def _(spark, d):
    k = b.table(spark, d, "part").select(F.concat(F.lower("p_name"), F.lit(" "), F.col("p_size").cast("string")).alias("keyword"), F.concat("p_brand", F.lit("/"), "p_type").alias("node_id"), F.lit("name").alias("source")).distinct()
    return concepts.cluster_members(k).select("keyword", F.size("node_ids").alias("n"), F.get("node_ids", F.lit(0)).alias("first_id"))


_CHAINS = f"""{_TURNS}, c AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, run) AS head, 1 + turn - min(turn) OVER (PARTITION BY conv_id, run) AS depth, count(*) OVER (PARTITION BY conv_id, run) AS n FROM runs)"""


@query("domain_clusters", f"""{_CHAINS} SELECT 'domain_conv' || conv_id AS id, string_agg(id, ',' ORDER BY depth, head) AS node_ids FROM c GROUP BY conv_id HAVING count(*) BETWEEN 3 AND 15""")
def _(spark, d):
    """Each conversation's turns are a cluster; turns call the next."""
    t = b.table(spark, d, "conversations")
    k = t.select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("keyword"), F.concat(F.lit("t:"), F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lit("/"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("node_id"), F.lit("name").alias("source"))
    return concepts.domain_clusters(k.distinct(), b.turns(spark, d)[1]).select("id", F.concat_ws(",", "node_ids").alias("node_ids"))


@query("flows_entry")
def _(spark, d):
    n, e = _succession(spark, d)
    return concepts.concept_flows(n.where(F.array_contains("tags", "test")), e)


@query("flows_turns", f"""{_CHAINS} SELECT a.id AS entry, string_agg(z.id, ',' ORDER BY z.turn) AS path FROM c a JOIN c z ON z.conv_id = a.conv_id AND z.run = a.run AND z.turn BETWEEN a.turn AND a.turn + 7 GROUP BY a.id HAVING count(*) >= 2""")
def _(spark, d):
    """From every turn of a conversation the turns that follow, eight in all."""
    n, e = b.turns(spark, d)
    return concepts.flow_paths(n, e).select("entry", F.concat_ws(",", "path").alias("path"))


@query("flows_nav", f"""{_CHAINS}, p AS (SELECT a.conv_id, a.turn, string_agg(z.id, ',' ORDER BY z.turn) AS path FROM c a JOIN c z ON z.conv_id = a.conv_id AND z.run = a.run AND z.turn BETWEEN a.turn AND a.turn + 3 GROUP BY a.conv_id, a.turn HAVING count(*) >= 2)
SELECT conv_id::VARCHAR AS "group", (row_number() OVER w - 1)::INT AS n, path FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY row_number() OVER w <= 3""")
def _(spark, d):
    """Each conversation's turns as an answer's symbols: no two of their flows share more than three of four turns."""
    n, e = b.turns(spark, d)
    entries = n.select(F.col("conv_id").cast("string").alias("group"), "id", F.col("turn").alias("rank"))
    return concepts.nav_flows(entries, e).select("group", "n", F.concat_ws(",", "path").alias("path"))


@query("flow_labels", f"""{_CHAINS} SELECT 'chain_' || first AS id, (depth - 1)::INT AS pos, id AS node_id, CASE WHEN turn_name IN (before, after) THEN id ELSE turn_name END AS label FROM (
  SELECT *, min(id) OVER (PARTITION BY conv_id, run) AS first, turn_name, lag(turn_name) OVER w AS before, lead(turn_name) OVER w AS after FROM (SELECT *, split_part(id, '/', 2) AS turn_name FROM c) WINDOW w AS (PARTITION BY conv_id, run ORDER BY turn))""")
def _(spark, d):
    n, e = b.turns(spark, d)
    heads = n.join(e.select(F.col("target_id").alias("id")), "id", "left_anti").select(F.col("id").alias("root"), "id")
    rows = graph.bfs_levels(e.select("source_id", "target_id"), heads, 1000)
    paths = rows.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "id"))), lambda x: x["id"]).alias("node_ids"))
    return concepts.flow_labels(paths.select(F.concat(F.lit("chain_"), "root").alias("id"), "node_ids"))


@query("read_order", f"""{_CHAINS} SELECT conv_id::VARCHAR AS "group", (row_number() OVER (PARTITION BY conv_id ORDER BY head DESC, turn) - 1)::INT AS pos, id FROM c""")
def _(spark, d):
    """Each conversation's turns in the order in which to read them."""
    n, e = b.turns(spark, d)
    return concepts.read_order(n.select(F.col("conv_id").cast("string").alias("group"), "id", F.col("turn").cast("double").alias("importance")), e)


@query("run_summary", "SELECT user_id::VARCHAR AS run, count(*) FILTER (event_type = 'view') AS passed, count(*) FILTER (event_type = 'error') AS failed, 0::BIGINT AS errors, 0::BIGINT AS skipped, 1.5::DOUBLE AS seconds, count(*) FILTER (event_type = 'error')::INT AS n_failures FROM events GROUP BY 1")
def _(spark, d):
    """Each user's events as a test log."""
    per = b.table(spark, d, "events").groupBy("user_id").agg(F.sum((F.col("event_type") == "view").cast("long")).alias("v"), F.sum((F.col("event_type") == "error").cast("long")).alias("x"))
    out = F.concat(F.lit("collected\n"), F.repeat(F.lit("FAILED tests/test_a.py::test_b - boom\n"), F.col("x").cast("int")), F.format_string("=== %d failed, %d passed in 1.5s ===\n", "x", "v"))
    r = composites.run_summary(per.select(F.col("user_id").cast("string").alias("run"), out.alias("output")))
    return r.select("run", "passed", "failed", "errors", "skipped", "seconds", F.size("failures").alias("n_failures"))


@query("parse_nodes")
def _(spark, d):
    """Documents as Python sources: a class and a function are put before each text, which becomes a comment."""
    docs = b.files(spark, d)
    head = F.lit("class Base:\n    def get(self) -> int:\n        return helper()\n\n\ndef helper():\n    return 1\n\n")
    code = docs.select("file_path", F.concat(head, F.lit("# "), F.regexp_replace("content", "[\r\n\f  \u0085\u000b\u001c-\u001e]", "\n# ")).alias("content"))
    return parse.nodes_of(parse.parse(code)).select("id", "kind", "name", "line_start", "line_end", "signature")


@query("stream_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    """events as a stream, all that is there, in daily windows."""
    from graphlode.streaming.refresh import running_counts

    source = spark.read.parquet(f"{d}/events.parquet")
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*")
    rows = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "value")
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = running_counts(rows, delay="30 days")
    done: list[DataFrame] = []

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out")
        done.append(batch)

    out.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    r = spark.read.parquet(f"{at}/out")
    return r.select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n", F.round("total", 4).alias("total"))
