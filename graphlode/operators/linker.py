"""Resolution of calls, imports and bases to symbols.

Inputs: symbols (id, kind, name, file_path, parent_id); calls (call_id, caller_id, caller_file, callee, receiver_type, ...);
imports (file_path, module_path, imported_names). Ids are unique; candidate order is by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphlode.functions import text as tx
from graphlode.storage import looked_up, stash

FAN_OUT = 6


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, module_path, resolved_to_file) of each import; empty for a module that is no file of the project."""
    each = imports.select("file_path", "module_path", F.posexplode_outer(tx.module_files(F.col("module_path"))).alias("ord", "file")).distinct()
    known = files.select(F.col("file_path").alias("file"), F.lit(True).alias("there")).distinct()
    hit = each.join(known, "file", "left")
    first = F.min_by("file", F.when(F.col("there"), F.col("ord")))
    return hit.groupBy("file_path", "module_path").agg(first.alias("f"), F.max("there").alias("there")).select("file_path", "module_path", F.when(F.col("there"), F.col("f")).otherwise("").alias("resolved_to_file"))


def import_edges(imports: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges (source_id, target_id, edge_type, weight) from a file to those it imports and to the symbols it names there."""
    found = resolve_imports(imports, files).where("resolved_to_file <> ''")
    to_files = found.select(F.col("file_path").alias("source_id"), F.col("resolved_to_file").alias("target_id"))
    named = imports.select("file_path", "module_path", F.explode("imported_names").alias("name")).where("name <> '*'")
    at = symbols.where("kind <> 'file'").groupBy(F.col("file_path").alias("resolved_to_file"), "name").agg(F.min("id").alias("target_id"))
    to_symbols = named.join(found, ["file_path", "module_path"]).join(at, ["resolved_to_file", "name"]).select(F.col("file_path").alias("source_id"), "target_id")
    return to_files.unionByName(to_symbols).where("source_id <> target_id").distinct().select("source_id", "target_id", F.lit("imports").alias("edge_type"), F.lit(1.0).alias("weight"))


def _first(symbols: DataFrame, keys: list[str], most: int, n: str, ids: str) -> DataFrame:
    """The number of symbols of each key, and the first ids of them. No list has more than `most`."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("target_id"))
    first = symbols.withColumn("place", place).where(F.col("place") <= most).groupBy(*keys).agg(F.array_sort(F.collect_list("target_id")).alias(ids))
    return symbols.groupBy(*keys).agg(F.count("*").alias(n)).join(first, keys)


def _by_qualifier(open_: DataFrame, grouped: DataFrame) -> DataFrame:
    """(name, cls, qualifier, hits, bests, best): how many parts of a qualifier the best symbol's id has, how many such
    there are, and the first. Each qualifier is looked up once, however many calls have it; what it meets is counted by
    hits before anything moves."""
    keys = ["name", "cls", "qualifier"]
    parts = F.filter(F.split("qualifier", r"\."), lambda x: x != "")
    hits = F.size(F.filter(parts, lambda x: F.lower("target_id").contains(x)))
    met = open_.where("qualifier <> ''").select(*keys).distinct().join(grouped.select("name", "cls", "target_id"), ["name", "cls"]).select(*keys, "target_id", hits.alias("hits")).where("hits > 0")
    per = met.groupBy(*keys, "hits").agg(F.count("*").alias("bests"), F.min("target_id").alias("best"))
    top = per.groupBy(*keys).agg(F.max(F.struct("hits", "bests", "best")).alias("x"))
    return top.select(*keys, "x.bests", "x.best")


def resolved(calls: DataFrame, symbols: DataFrame, imports: DataFrame | None = None, fan_out: int = FAN_OUT, keep: list[str] = ()) -> DataFrame:
    """(call_id, caller_id, targets, rule, keep) of each resolved call; keep: more columns of calls.

    The first rule that leaves one candidate decides: the only one; the receiver's type; the same file; an imported file;
    the best qualifier; the same module. Else the candidates, those of the same file first, then the imported, then the
    rest, are all taken, `fan_out` at most (rule 8). Candidates that the receiver's type narrows stay narrowed.

    What a call means depends on its name, receiver, qualifier and file alone, so each four of these are resolved once,
    however many calls have them; calls are shuffled to what was found only. These four never meet all symbols of their
    name: symbols are counted, and their first ids kept, by name (and class), file and module, and one row of each is met. So a
    name that calls and symbols by the million share costs their sum.
    """
    bare = F.regexp_replace("callee", r"^self\.", "")
    qualifier = F.lower(F.when(bare.contains("."), F.regexp_replace(bare, r"\.[^.]*$", "")).otherwise(""))
    c = stash(calls.select("call_id", "caller_id", "caller_file", F.substring_index(bare, ".", -1).alias("name"), qualifier.alias("qualifier"), F.coalesce("receiver_type", F.lit("")).alias("receiver"), *keep), "calls")
    owner = F.substring_index(F.substring_index("parent_id", "::", -1), ".", -1)
    s = symbols.where("kind <> 'file'").select(F.col("id").alias("target_id"), "name", "file_path", F.when(F.col("kind") == "method", owner).otherwise("").alias("cls"))
    # A symbol is a candidate by its name, and, if it is a method, by its name and class.
    grouped = stash(s.withColumn("cls", F.lit("")).unionByName(s.where("cls <> ''")).withColumn("module", tx.module_of(F.col("file_path"))), "symbols-by-name")
    heads = stash(_first(grouped, ["name", "cls"], 3 * fan_out, "n", "ids"), "names")
    keys = ["name", "receiver", "qualifier", "caller_file"]
    asked = c.select(*keys).distinct()
    named = asked.join(heads.where("cls = ''").select("name", F.col("n").alias("all"), F.col("ids").alias("all_ids")), "name")
    typed = heads.where("cls <> ''").select("name", F.col("cls").alias("receiver"), F.col("n").alias("receivers"), F.col("ids").alias("typed_ids"))
    met = named.join(typed, ["name", "receiver"], "left").withColumns({"cls": F.when(F.col("receivers").isNull(), "").otherwise(F.col("receiver")), "ids": F.coalesce("typed_ids", "all_ids"), "module": tx.module_of(F.col("caller_file"))})
    met = stash(met.select(*keys, "cls", "module", "all", "receivers", "ids"), "asked")
    plain = met.where("all = 1 OR receivers = 1").select(*keys, F.slice("ids", 1, 1).alias("targets"), F.when(F.col("all") == 1, 2).otherwise(3).alias("rule"))
    open_ = met.where("all > 1 AND (receivers IS NULL OR receivers > 1)")
    files = stash(_first(grouped, ["name", "cls", "file_path"], fan_out, "files", "file_ids"), "names-by-file")
    at = open_.join(files.withColumnRenamed("file_path", "caller_file"), ["name", "cls", "caller_file"], "left")
    none = F.array().cast("array<string>")
    if imports is None:
        at = at.withColumns({"imports": F.lit(0), "import_ids": none})
    else:
        paths = imports.select(F.col("file_path").alias("caller_file"), F.explode(tx.module_files(F.col("module_path"))).alias("file_path")).distinct()
        wanted = open_.select("name", "cls", "caller_file").distinct().join(paths, "caller_file").join(files, ["name", "cls", "file_path"])
        imported = wanted.groupBy("name", "cls", "caller_file").agg(F.sum("files").alias("imports"), F.slice(F.array_sort(F.flatten(F.collect_list("file_ids"))), 1, 2 * fan_out).alias("import_ids"))
        at = at.join(imported, ["name", "cls", "caller_file"], "left")
    at = at.join(_by_qualifier(open_, grouped), ["name", "cls", "qualifier"], "left")
    at = at.join(grouped.groupBy("name", "cls", "module").agg(F.count("*").alias("modules"), F.min("target_id").alias("module_id")), ["name", "cls", "module"], "left")
    same, near = F.coalesce("file_ids", none), F.coalesce("import_ids", none)
    some = F.slice(F.concat(same, F.array_except(near, same), F.array_except("ids", F.concat(same, near))), 1, fan_out)
    rules = [(4, F.col("files") == 1, same), (5, F.col("imports") == 1, near), (6, F.col("bests") == 1, F.array("best")), (7, F.col("modules") == 1, F.array("module_id"))]
    rule, targets = F.lit(8), some
    for number, fits, ids in reversed(rules):
        rule, targets = F.when(fits, number).otherwise(rule), F.when(fits, ids).otherwise(targets)
    found = plain.unionByName(at.select(*keys, targets.alias("targets"), rule.alias("rule")))
    found = found.select(*(F.col(k).alias(f"__{k}") for k in keys), "targets", "rule")
    same_four = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return c.join(looked_up(found), same_four).select("call_id", "caller_id", "targets", "rule", *keep)


def link_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame | None = None, fan_out: int = FAN_OUT) -> DataFrame:
    """(call_id, caller_id, target_id, confidence, rule) of each target of each resolved call; of several the confidence is low."""
    return resolved(calls, symbols, imports, fan_out).select("call_id", "caller_id", F.explode("targets").alias("target_id"), _confidence().alias("confidence"), "rule")


def _confidence() -> Column:
    return F.when(F.col("rule") == 8, "low").otherwise("high")


def call_edges(linked: DataFrame) -> DataFrame:
    """Edges of linked calls: one for each caller and target, as the first call has it. linked: as of link_calls() or of
    resolved(), whose calls are shuffled to their callers before they become a row for each target."""
    if "targets" in linked.columns:
        linked = linked.repartition("caller_id").select("call_id", "caller_id", F.explode("targets").alias("target_id"), _confidence().alias("confidence"))
    first = F.min_by("confidence", "call_id")
    return linked.groupBy(F.col("caller_id").alias("source_id"), "target_id").agg(first.alias("confidence")).select("source_id", "target_id", F.lit("calls").alias("edge_type"), F.lit(1.0).alias("weight"), "confidence")


def inherits_edges(classes: DataFrame) -> DataFrame:
    """Edges from each class (id, name, file_path, bases) to the class of each base's short name: one of the same file if
    there is, else the first by id."""
    each = classes.select(F.col("id").alias("source_id"), F.col("file_path").alias("f"), F.explode("bases").alias("base")).withColumn("name", F.substring_index("base", ".", -1))
    met = each.join(classes.select(F.col("id").alias("target_id"), "name", "file_path"), "name").where("source_id <> target_id")
    best = F.min_by("target_id", F.struct(F.col("file_path") != F.col("f"), F.col("target_id")))
    return met.groupBy("source_id", "base").agg(best.alias("target_id")).select("source_id", "target_id").distinct().select("source_id", "target_id", F.lit("inherits").alias("edge_type"), F.lit(1.0).alias("weight"))


# -- contracts


def contracts(calls: DataFrame, linked: DataFrame) -> DataFrame:
    """(function_id, caller_id, error_handling, return_usage) of the surely linked calls; the last call of a pair counts.
    linked: as of link_calls(), or of resolved() that has kept both columns, so that calls needn't be met again."""
    label = tx.error_label(F.col("error_handling.pattern"), F.col("error_handling.exception"))
    if "targets" in linked.columns:
        rows = linked.where("rule <> 8").select("call_id", "caller_id", label.alias("error_handling"), "return_usage", F.explode("targets").alias("function_id"))
    else:
        sure = linked.where("confidence = 'high'").select("call_id", F.col("target_id").alias("function_id"))
        rows = calls.select("call_id", "caller_id", label.alias("error_handling"), "return_usage").join(sure, "call_id")
    last = F.max_by(F.struct("error_handling", "return_usage"), "call_id")
    return rows.groupBy("function_id", "caller_id").agg(last.alias("x")).select("function_id", "caller_id", "x.error_handling", "x.return_usage")


def contract_conflicts(rows: DataFrame) -> DataFrame:
    """(function_id) of those whose callers differ in error handling or in what they do with the result."""
    differ = lambda c: F.min(c) != F.max(c)
    return rows.groupBy("function_id").agg((differ("error_handling") | differ("return_usage")).alias("x")).where("x").select("function_id")


def contract_report(rows: DataFrame) -> DataFrame:
    """(function_id, caller_count, error_strategies, return_strategies) of the conflicts; strategies sorted, without none."""
    e, r = F.col("error_handling"), F.col("return_usage")
    per = rows.groupBy("function_id").agg(
        F.count("*").alias("caller_count"), F.array_sort(F.collect_set(F.when((e != "none") & (e != ""), e))).alias("error_strategies"), F.array_sort(F.collect_set(F.when(r != "", r))).alias("return_strategies"),
        ((F.min(e) != F.max(e)) | (F.min(r) != F.max(r))).alias("x"),
    )
    return per.where("x").drop("x")
