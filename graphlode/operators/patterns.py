"""Design patterns that the graph's shape gives away. Each detector returns (node_id, pattern, detail, implication)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphlode.functions import text as tx

EMIT = ["dispatch", "emit", "fire", "notify", "publish", "trigger"]
LISTEN = ["add_listener", "bind", "listen", "on", "register", "subscribe"]
CRUD = {"read": "^(get|find|read|fetch|load)", "create": "^(create|save|write|store)", "update": "^update", "delete": "^(delete|remove)"}
SINGLETON = ["get_instance", "get_singleton", "instance", "shared"]
ADD, REMOVE = ["add_observer", "attach", "register_observer"], ["detach", "remove_observer"]
CHAIN_WORDS = "next|handler|request|response|middleware"


def _class_methods(nodes: DataFrame) -> DataFrame:
    methods = nodes.where("kind = 'method' AND parent_id <> ''").groupBy(F.col("parent_id").alias("id")).agg(F.collect_set("name").alias("methods"))
    return nodes.where("kind = 'class'").select("id", F.col("name").alias("class_name")).join(methods, "id")


def _has(names: list[str]) -> Column:
    return F.arrays_overlap("methods", F.array(*map(F.lit, names)))


def _row(df: DataFrame, pattern: str, detail: dict[str, Column], implication: Column) -> DataFrame:
    made = F.create_map(*(x for k, v in detail.items() for x in (F.lit(k), v.cast("string")))) if detail else F.create_map().cast("map<string,string>")
    return df.select(F.col("id").alias("node_id"), F.lit(pattern).alias("pattern"), made.alias("detail"), implication.alias("implication"))


def _counted(edges: DataFrame, kind: str, name: str) -> DataFrame:
    return edges.where(F.col("edge_type") == kind).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias(name))


def event_bus(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    cls = _class_methods(nodes).where(_has(EMIT) & _has(LISTEN)).withColumn("listening", F.array_intersect("methods", F.array(*map(F.lit, LISTEN))))
    calls = _counted(edges, "calls", "n").withColumnRenamed("id", "method_id")
    listeners = cls.select("id", F.explode("listening").alias("m")).withColumn("method_id", F.concat("id", F.lit("."), "m")).join(calls, "method_id").groupBy("id").agg(F.sum("n").alias("listeners"))
    met = cls.join(listeners, "id", "left").join(_counted(edges, "imports", "importers"), "id", "left").fillna(0, ["listeners", "importers"])
    said = F.format_string("Subscribers are registered at run time and are not in the call graph: %d registrations, %d importing files.", "listeners", "importers")
    return _row(met, "event_bus", {"listeners": F.col("listeners"), "importers": F.col("importers")}, said)


def factory(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    made = nodes.where("kind = 'function'").where(F.col("name").rlike("^(create|build|make)_")).join(_counted(edges, "calls", "callers"), "id")
    return _row(made, "factory", {"callers": F.col("callers")}, F.format_string("Factory with %d call sites; new types need a case here.", "callers"))


def strategy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    base = nodes.where((F.col("kind") == "class") & (F.col("name").rlike("^(Base|Abstract)") | F.array_contains("tags", "abstract"))).select("id", F.col("name").alias("class_name"))
    heirs = edges.where("edge_type = 'inherits'").select(F.col("source_id").alias("heir"), F.col("target_id").alias("id"))
    named = heirs.join(nodes.select(F.col("id").alias("heir"), "name"), "heir", "left").groupBy("id").agg(F.count("*").alias("n"), F.concat_ws(", ", F.array_sort(F.collect_list("name"))).alias("names"))
    met = base.join(named.where("n >= 2"), "id")
    return _row(met, "strategy", {"implementations": F.col("names")}, F.format_string("%s is a strategy base with %d implementations (%s); a change of its interface changes all.", "class_name", "n", "names"))


def middleware_chain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    funcs = nodes.where((F.col("kind") == "function") & F.lower(F.coalesce("signature", F.lit(""))).rlike(CHAIN_WORDS)).select("id", tx.dir_of(F.col("file_path")).alias("dir"))
    met = funcs.join(funcs.groupBy("dir").agg(F.count("*").alias("n")).where("n >= 3"), "dir")
    return _row(met, "middleware_chain", {"chain_size": F.col("n")}, F.format_string("One of %d functions of a middleware chain; their order matters.", "n"))


def repository(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    has = [F.when(F.expr(f"exists(methods, m -> m RLIKE '{p}')"), k) for k, p in CRUD.items()]
    met = _class_methods(nodes).withColumn("crud", F.array_sort(F.array_compact(F.array(*has)))).where(F.size("crud") >= 3)
    return _row(met, "repository", {"crud_categories": F.concat_ws(", ", "crud")}, F.format_string("%s is where data are read and written; don't go round it.", "class_name"))


def singleton(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _row(_class_methods(nodes).where(_has(SINGLETON)), "singleton", {}, F.format_string("%s is a singleton; take its instance by the class's method.", "class_name"))


def observer(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _row(_class_methods(nodes).where(_has(ADD) & _has(REMOVE)), "observer", {}, F.lit("Callbacks are registered at run time; look at all registrations."))


#: Add a detector here and it runs with the others.
DETECTORS = {f.__name__: f for f in (event_bus, factory, strategy, middleware_chain, repository, singleton, observer)}


def detect(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What all detectors find."""
    out = None
    for f in DETECTORS.values():
        out = f(nodes, edges) if out is None else out.unionByName(f(nodes, edges))
    return out


def grouped(found: DataFrame, shown: int = 3) -> DataFrame:
    """(pattern, total, shown): the pattern's count and its first node ids."""
    total = found.groupBy("pattern").agg(F.count("*").alias("total"))
    # The first few of each part, then of all parts: no list grows with the number of findings.
    part = F.pmod(F.xxhash64("node_id"), F.lit(32))
    place = F.row_number().over(Window.partitionBy("pattern", "part").orderBy("node_id"))
    first = found.select("pattern", "node_id", part.alias("part")).withColumn("place", place).where(F.col("place") <= shown)
    return total.join(first.groupBy("pattern").agg(F.slice(F.array_sort(F.collect_list("node_id")), 1, shown).alias("shown")), "pattern")


def counts(found: DataFrame) -> DataFrame:
    """(pattern, n) of what the detectors found."""
    return found.groupBy("pattern").agg(F.count("*").alias("n"))
