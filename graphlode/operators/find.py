"""Filters over nodes: by kind, tag, category, coverage and module; framework entry points and dead code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphlode.functions import text as tx
from graphlode.operators.graph import test_coverage
from graphlode.operators.scores import cross_module

LIVE_TAGS = """abstract callback classmethod dunder entrypoint exported hook overload override property route_handler static
test validator""".split()
#: Last parts of the decorators that frameworks call by; a decorator of the same last part counts too.
DECORATORS = """abstractmethod argument asyncio command delete fixture get group head on_event option options parametrize patch
post put receiver register route shared_task task websocket""".split()
LIFECYCLE = """__init_subclass__ apps clean delete dispatch full_clean get_queryset get_serializer_class lifespan on_shutdown
on_startup perform_create ready save setUp setUpClass setup_class setup_method tearDown tearDownClass teardown_class
teardown_method""".split()
#: What find() leaves out when it looks for untested nodes and no category is asked for.
UNTESTED_EXCLUDES = tx.LOW_PRIORITY


def framework_entry(name: Column, tags: Column) -> Column:
    """Whether a framework calls a symbol at run time: by tag, decorator, base class or naming convention."""
    by_tag = F.arrays_overlap(tags, F.array(*map(F.lit, LIVE_TAGS)))
    by_decorator = F.exists(tags, lambda t: t.startswith("decorator:") & F.substring_index(F.substr(t, F.lit(11)), ".", -1).isin(DECORATORS))
    by_base = F.exists(tags, lambda t: t.startswith("extends:"))
    by_name = name.rlike("^__.*__$|^test_|^Test|(View|Serializer|Admin|Form|ViewSet)$") | name.isin(LIFECYCLE)
    return by_tag | by_decorator | by_base | F.coalesce(by_name, F.lit(False))


def dead(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes that nothing uses and no framework or polymorphism may call.

    Kept as alive: files, main, framework entries, public methods, methods of classes with a base, data models. Those
    ladder rules that need a node alone are filters below the joins.
    """
    name, kind, tags = F.col("name"), F.col("kind"), F.col("tags")
    able = nodes.where((kind != "file") & ~framework_entry(name, tags) & (name != "main") & ~((kind == "method") & ~name.startswith("_")) & ~((kind == "class") & F.array_contains("tags", "data_model")))
    heirs = nodes.where((kind == "class") & F.exists("tags", lambda t: t.startswith("extends:"))).select(F.col("id").alias("parent_id"))
    used = edges.where(F.col("edge_type").isin("calls", "imports", "inherits", "instantiates")).select(F.col("target_id").alias("id"))
    methods = able.where("kind = 'method'").join(heirs, "parent_id", "left_anti").select(able.columns)
    return able.where("kind <> 'method'").unionByName(methods).join(used, "id", "left_anti")


def find(
    nodes: DataFrame, edges: DataFrame, tag: str | None = None, kind: str | None = None, no_direct_tests: bool = False, no_tests: bool = False, importance_gt: float | None = None,
    crosses: bool = False, is_dead: bool = False, exclude: list[str] = (), include: list[str] = (), include_fixtures: bool = False,
) -> DataFrame:
    """nodes that fit all that is asked for. Without tests: tests themselves are left out, and low-priority categories
    too unless a category is asked for or include_fixtures is set."""
    out = nodes
    if kind:
        out = out.where(F.col("kind") == kind)
    if importance_gt is not None:
        out = out.where(F.col("importance") > importance_gt)
    if tag:
        out = out.where(F.array_contains("tags", tag))
    if (no_tests or no_direct_tests) and not exclude and not include and not include_fixtures:
        exclude = UNTESTED_EXCLUDES
    if exclude:
        out = out.where(~tx.category_of_tags(F.col("tags")).isin(list(exclude)))
    if include:
        out = out.where(tx.category_of_tags(F.col("tags")).isin(list(include)))
    if no_tests or no_direct_tests:
        reached = test_coverage(nodes, edges)
        if not no_tests:
            reached = reached.where("direct_count > 0")
        out = out.where(~F.array_contains("tags", "test")).join(reached.select("id"), "id", "left_anti")
    if crosses:
        out = out.join(cross_module(nodes, edges), "id", "left_semi")
    if is_dead:
        out = out.join(dead(nodes, edges).select("id"), "id", "left_semi")
    return out


def entry_points(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.arrays_overlap("tags", F.array(F.lit("entrypoint"), F.lit("route_handler"))))
