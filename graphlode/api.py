"""The engine over one source tree: build and update its tables, then ask them. Every answer is a DataFrame."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphlode.functions import text as tx
from graphlode.operators import composites, concepts, content, find, graph, history, linker, patterns, scores, search
from graphlode.schema import TABLES
from graphlode.sources import files, gitlog, parse
from graphlode.sources.store import Store
from graphlode.storage import stash


class UnknownSymbol(LookupError):
    """No symbol, or more than one, fits a query; candidates has (id, score) of the best."""

    def __init__(self, query: str, candidates: list[tuple[str, float]]):
        super().__init__(f"{query!r} is not one symbol; candidates: {candidates}")
        self.candidates = candidates


class Engine:
    def __init__(self, spark: SparkSession, store: str, as_of: str | None = None):
        """as_of: the moment from which days are counted back, the time of the call by default."""
        self.spark, self.store, self._as_of = spark, Store(spark, store), as_of

    # -- building

    def build(self, root: str, commits: DataFrame | None = None, strict_callees: bool = True) -> None:
        """Scans, parses, links and scores the tree, and writes all tables. commits: (hash, author, date, files), taken from
        git by default. strict_callees: callees are parted at dots only; else at :: and -> too, and new and ! are dropped."""
        scanned = stash(files.scan(self.spark, root), "files")
        self._write(scanned, parse.parse(scanned), gitlog.commits_of(self.spark, root) if commits is None else commits, strict_callees)

    def update(self, root: str, commits: DataFrame | None = None) -> DataFrame:
        """(file_path, status) of what is new, changed or deleted since the last build; if anything is, all tables are made
        anew, but only files whose content's hash has no stored parse are parsed."""
        scanned = stash(files.scan(self.spark, root), "files")
        plan = stash(content.hash_diff(self.store.read("file_hashes"), content.file_hashes(scanned)), "plan")
        if not plan.isEmpty():
            now = content.file_hashes(scanned)
            kept = stash(self.store.read("parsed").join(now, ["file_path", "content_hash"], "left_semi").drop("content_hash"), "kept")
            fresh = parse.parse(scanned.join(kept, "file_path", "left_anti"))
            self._write(scanned, kept.unionByName(fresh), gitlog.commits_of(self.spark, root) if commits is None else commits, True)
        return plan

    def _write(self, scanned: DataFrame, parsed: DataFrame, commits: DataFrame, strict_callees: bool) -> None:
        nodes, calls, imports = stash(parse.nodes_of(parsed), "nodes"), parse.calls_of(parsed), stash(parse.imports_of(parsed), "imports")
        if not strict_callees:
            calls = calls.withColumn("callee", F.regexp_replace(F.regexp_replace(F.regexp_replace("callee", r"^new\s+", ""), "!$", ""), "::|->", "."))
        linked = stash(linker.link_calls(calls, nodes, imports), "linked")
        called = linker.call_edges(linked)
        bases = linker.inherits_edges(parse.bases_of(nodes))
        methods = nodes.where("kind = 'method'").select("id", "name", "parent_id")
        overrides = graph.dispatches(methods, graph.ancestors(bases))
        wanted = ["source_id", "target_id", "edge_type", "weight", "confidence", "via"]
        parts = [called, bases, overrides, linker.import_edges(imports, nodes.where("kind = 'file'"), nodes)]
        edges = None
        for p in parts:
            p = p.select(*(F.col(c) if c in p.columns else F.lit(None).cast("string").alias(c) for c in wanted))
            edges = p if edges is None else edges.unionByName(p)
        edges = stash(edges, "edges")
        hashes = content.symbol_hashes(nodes, scanned.select("file_path", "content"))
        scored = stash(scores.scored_nodes(nodes, edges).join(hashes, "id", "left"), "scored")
        known = commits.select("hash", "author", "date", F.explode("files").alias("file_path")).join(nodes.where("kind = 'file'").select("file_path"), "file_path", "left_semi")
        commits = stash(known.groupBy("hash", "author", "date").agg(F.array_sort(F.collect_set("file_path")).alias("files")), "commits")
        stored_edges = graph.reverse_edges(edges).select(
            "source_id", "target_id", "edge_type", "weight",
            F.struct("confidence", F.lit(None).cast("int").alias("line"), F.lit(None).cast("struct<pattern:string,exception:string>").alias("error_handling"), "via").alias("metadata"),
        )
        plain = edges.select("source_id", "target_id", "edge_type", "confidence")
        calls_only = plain.where("edge_type = 'calls'")
        flows = concepts.concept_flows(find.entry_points(scored), calls_only)
        keywords = stash(search.extract_keywords(nodes.withColumn("tags", F.filter("tags", lambda t: ~t.startswith("category:")))), "keywords")
        paths = flows.unionByName(concepts.domain_clusters(keywords, calls_only)).unionByName(concepts.concept_chains(graph.linear_chains(scored, calls_only))).dropDuplicates(["id"])
        self.store.write("parsed", parsed.join(content.file_hashes(scanned), "file_path"))
        self.store.write("nodes", scored)
        self.store.write("edges", stored_edges)
        self.store.write("keywords", keywords)
        self.store.write("file_hashes", content.file_hashes(scanned).withColumn("last_parsed", F.date_format(F.current_timestamp(), history.ISO)))
        self.store.write("file_stats", history.file_stats(commits, self.as_of))
        self.store.write("cochanges", history.cochanges(commits))
        self.store.write("patterns", patterns.detect(scored, plain))
        self.store.write("contracts", linker.contracts(calls, linked))
        self.store.write("concept_paths", paths)
        self.store.write("string_refs", content.string_refs(scanned))
        self.store.write("raw_imports", imports.join(linker.resolve_imports(imports, nodes.where("kind = 'file'")), ["file_path", "module_path"]))
        self.store.write("meta", scores.meta_counts(nodes, edges).unionByName(self.spark.range(1).select(F.lit("last_build").alias("key"), F.date_format(F.current_timestamp(), history.ISO).alias("value"))))
        for name in ("nodes", "edges"):
            self.__dict__.pop(name, None)

    @property
    def as_of(self) -> str:
        import datetime

        return self._as_of or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%d %H:%M:%S")

    # -- tables

    @cached_property
    def nodes(self) -> DataFrame:
        return self.store.read("nodes")

    @cached_property
    def edges(self) -> DataFrame:
        """The forward edges, with their confidence as a column."""
        from graphlode.schema import REVERSE

        e = self.store.read("edges").where(~F.col("edge_type").isin(list(REVERSE.values())))
        return e.select("source_id", "target_id", "edge_type", "weight", F.col("metadata.confidence").alias("confidence"), F.col("metadata.via").alias("via"))

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def symbol(self, query: str, pick: int | None = None) -> str:
        found, candidates = search.resolve(self.nodes, query, pick)
        if found is None:
            raise UnknownSymbol(query, candidates)
        return found

    # -- questions

    def nav(self, query: str, budget: int = 5, include_category: list[str] = (), exclude_category: list[str] = ()) -> dict[str, DataFrame]:
        """primary, secondary, cochange, warnings, read_order and flows of a question in plain words."""
        seeds = stash(search.navigate_scores(self.nodes, self.table("keywords"), query, exclude_category, include_category), "seeds")
        ranked = self._cohesive(seeds, budget)
        primary = self.spark.createDataFrame([(r["node_id"], i) for i, r in enumerate(ranked[:budget])], "id string, rank int").join(self.nodes, "id")
        primary = stash(primary, "primary")
        ids = primary.select("id")
        near = [self.edges.join(ids.withColumnRenamed("id", a), a, "left_semi").select(F.col(b_).alias("id"), "edge_type") for a, b_ in (("source_id", "target_id"), ("target_id", "source_id"))]
        around = near[0].unionByName(near[1]).groupBy("id").agg(F.min("edge_type").alias("relation")).join(ids, "id", "left_anti").join(self.nodes.where("kind <> 'file'").select("id", "name", "kind", "file_path", "importance"), "id").orderBy(F.desc("importance"), "id").limit(8)
        weak = seeds.where("NOT strong").orderBy(F.desc("score"), "node_id").limit(4).select(F.col("node_id").alias("id"), F.lit("docstring-match").alias("relation"), "name", "kind", "file_path", "importance")
        paths = primary.select(F.col("file_path").alias("f")).distinct()
        close = self.table("cochanges").where("coupling_score >= 0.4 AND co_commit_count >= 3")
        both = close.select(F.col("file_a").alias("f"), F.col("file_b").alias("other"), "coupling_score").unionByName(close.select(F.col("file_b").alias("f"), F.col("file_a").alias("other"), "coupling_score"))
        calls = self.edges.where("edge_type = 'calls'")
        flows = concepts.nav_flows(primary.select(F.lit("nav").alias("group"), "id", "rank"), calls).select(F.get("path", F.lit(0)).alias("entry"), "n", "path")
        return {
            "primary": primary.orderBy("rank"), "secondary": around.unionByName(weak), "cochange": both.join(paths, "f", "left_semi").orderBy(F.desc("coupling_score"), "other").limit(3),
            "warnings": self.warnings().join(ids.withColumnRenamed("id", "node_id"), "node_id", "left_semi"), "read_order": concepts.read_order(primary.select(F.lit("nav").alias("group"), "id", "importance"), calls), "flows": flows,
        }

    @staticmethod
    def _cohesive(seeds: DataFrame, budget: int) -> list:
        """The strong seeds (20 at most) in order: those apart from the directory that most of the best share have their
        match cut to 0.3; those with most of the query's words come first."""
        import re

        rows = seeds.where("strong").orderBy(F.desc("score"), "node_id").collect()
        top, shared = rows[:budget], {}
        if len(top) >= 2:
            for r in top:
                parts = r["file_path"].split("/")
                for at in (x for x in (1, 2, 3) if x < len(parts)):
                    shared["/".join(parts[:at])] = shared.get("/".join(parts[:at]), 0) + 1
        fits = [p for p, n in shared.items() if n >= max(2, len(top) // 2 + 1)]
        words = lambda p: {t for t in re.split(r"[-_./\\]", p.lower()) if t}
        prefix = words(max(fits, key=len)) if fits else set()
        score = lambda r: r["score"] - (r["match"] * 2 * 0.7 if prefix and not prefix & words(r["file_path"]) else 0)
        most = max((r["coverage"] for r in rows), default=0)
        return sorted(rows, key=lambda r: (most >= 2 and r["coverage"] < most, -score(r), r["node_id"]))

    def blast_radius(self, symbol: str, pick: int | None = None, depth: int = 3, include_category: list[str] = (), exclude_category: list[str] = ()) -> DataFrame:
        found = graph.blast_radius(self.edges, self.symbol(symbol, pick), depth).join(self.nodes, "id")
        kind = tx.category_of_tags(F.col("tags"))
        if exclude_category:
            found = found.where(~kind.isin(list(exclude_category)))
        if include_category:
            found = found.where(kind.isin(list(include_category)))
        return found.select("id", "depth", "bucket", "name", "kind", "file_path")

    def affected_tests(self, symbol: str, pick: int | None = None) -> DataFrame:
        at = self.symbol(symbol, pick)
        hit = graph.blast_radius(self.edges, at).select("id").unionByName(self.spark.createDataFrame([(at,)], "id string"))
        return graph.affected_tests(self.edges, self.nodes, hit)

    def callers(self, symbol: str, depth: int = 1, pick: int | None = None) -> DataFrame:
        return graph.callers(self.edges, self.symbol(symbol, pick), depth)

    def read(self, symbol: str, root: str, context: int = 0, pick: int | None = None) -> DataFrame:
        return content.read_source(content.read_context(self.nodes, self.edges, self.symbol(symbol, pick), context), files.scan(self.spark, root))

    def read_since(self, symbol: str, since: str) -> DataFrame:
        return content.changed_since(self.nodes, self.symbol(symbol), since)

    def peek(self, symbol: str, pick: int | None = None) -> DataFrame:
        return composites.peek(self.nodes, self.edges, self.symbol(symbol, pick))

    def tree(self, file: str) -> DataFrame:
        paths = [r[0] for r in self.nodes.where(F.col("kind") == "file").where((F.col("file_path") == file) | F.col("file_path").endswith("/" + file)).select("file_path").orderBy(F.length("file_path")).limit(1).collect()]
        if not paths:
            raise LookupError(f"no file {file!r}")
        return composites.tree(self.nodes, self.edges, paths[0])

    def verify(self, statement: str) -> DataFrame:
        parsed = composites.parse_statement(statement)
        if parsed is None:
            raise ValueError("say: A calls B, A imports B, A extends B, A is called by B")
        a, kind, c = parsed
        return composites.verify(self.edges, f"{self.symbol(a)} {'extends' if kind == 'inherits' else kind} {self.symbol(c)}")

    def trace(self, source: str, target: str, calls_only: bool = False, via_inheritance: bool = False, root: str | None = None, pick_source: int | None = None, pick_target: int | None = None) -> DataFrame:
        """The path from source to target: over certain calls, else over calls, inheritance and dispatch; calls_only and
        via_inheritance leave one of the two. With root, the source lines of each symbol on it."""
        if calls_only and via_inheritance:
            raise ValueError("calls_only and via_inheritance exclude each other")
        a, c = self.symbol(source, pick_source), self.symbol(target, pick_target)
        if calls_only:
            path = graph.shortest_path(graph.steps(graph.strict(self.edges), ["calls"]), a, c, 8)
        else:
            path = graph.trace_via_inheritance(self.edges, a, c) if via_inheritance else graph.trace(self.edges, a, c)
        if root is None:
            return path
        path = stash(path, "path")
        at = path.join(self.nodes.select("id", "file_path", "line_start", "line_end"), "id").withColumn("depth", F.col("pos"))
        source_of = content.read_source(at, files.scan(self.spark, root)).select("id", "file_path", "line_start", "line_end", "source")
        return path.join(source_of, "id", "left").orderBy("pos")

    def ask(self, what: str, *args: str, pick: int | None = None) -> DataFrame:
        """exists, signature, calls, imports, is-async, returns-type, callers-count, has-tests."""
        if what == "exists":
            found = search.resolve(self.nodes, args[0], pick)[0]
            return self.spark.createDataFrame([(args[0], found is not None, found)], "query string, result boolean, resolved_id string")
        if what == "calls":
            return composites.ask_calls(self.edges, self.symbol(args[0], pick), self.symbol(args[1]))
        if what == "imports":
            return self.table("raw_imports").where((F.col("file_path") == args[0]) | F.col("file_path").endswith("/" + args[0])).orderBy("is_from_import", "module_path")
        at = self.symbol(args[0], pick)
        if what == "has-tests":
            return graph.test_coverage(self.nodes, self.edges).where(F.col("id") == at)
        column = {"signature": "signature", "is-async": "is_async", "returns-type": "returns", "callers-count": "callers_count"}[what]
        return composites.ask_all(self.nodes, self.edges).where(F.col("id") == at).select("id", column)

    def string_refs(self, identifier: str) -> DataFrame:
        return content.refs_of(self.table("string_refs"), identifier)

    def uses(self, identifier: str, root: str, path_glob: str | None = None, limit: int = 500) -> DataFrame:
        return content.uses(files.scan(self.spark, root), identifier, path_glob, limit=limit)

    def flows(self, keyword: str | None = None) -> DataFrame:
        return concepts.flows(self.table("concept_paths"), keyword)

    def find(self, **wanted) -> DataFrame:
        """See operators.find.find()."""
        return find.find(self.nodes, self.edges, **wanted)

    def warnings(self) -> DataFrame:
        return composites.warnings(self.nodes, self.edges, self.table("file_stats"), linker.contract_conflicts(self.table("contracts")), self.table("cochanges"), self.table("patterns"))

    def hotspots(self, top: int = 10) -> DataFrame:
        return self.table("file_stats").where("commits_7d >= 1").orderBy(F.desc("commits_7d"), "file_path").limit(top)

    def cochange(self, file: str, min_count: int = 3, min_score: float = 0.2) -> DataFrame:
        return history.cochange_of(self.table("cochanges"), file, min_count, min_score)

    def why(self, file: str, other: str) -> DataFrame:
        """The commits that changed both files."""
        a, c = sorted((file, other))
        return self.table("cochanges").where((F.col("file_a") == a) & (F.col("file_b") == c)).select(F.explode("commit_ids").alias("commit"))

    def stats(self) -> DataFrame:
        kinds = self.nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.concat(F.lit("nodes:"), "kind").alias("key"), F.col("n").cast("string").alias("value"))
        found = self.table("patterns").groupBy("pattern").agg(F.count("*").alias("n")).select(F.concat(F.lit("pattern:"), "pattern").alias("key"), F.col("n").cast("string").alias("value"))
        return self.table("meta").unionByName(kinds).unionByName(found)

    def doctor(self, root: str | None = None) -> DataFrame:
        """(check, ok, detail): each table has rows, and, with root, how many files differ from the stored hashes."""
        checks = None
        for t in TABLES:
            one = self.table(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("check"), (F.col("n") > 0).alias("ok"), F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("detail"))
            checks = one if checks is None else checks.unionByName(one)
        if root is not None:
            stale = self.staleness(root)
            checks = checks.unionByName(stale.select(F.lit("fresh").alias("check"), ((F.col("stale") <= 5) & (F.col("stale") <= F.col("files") * 0.1)).alias("ok"), F.concat(F.col("stale").cast("string"), F.lit(" stale files")).alias("detail")))
        return checks

    def staleness(self, root: str) -> DataFrame:
        """One row (files, stale)."""
        diff = content.hash_diff(self.table("file_hashes"), content.file_hashes(files.scan(self.spark, root)))
        return diff.agg(F.count("*").alias("stale")).crossJoin(self.table("file_hashes").agg(F.count("*").alias("files"))).select("files", "stale")

    def briefing(self) -> dict[str, DataFrame]:
        """The briefing's sections."""
        conflicts = linker.contract_conflicts(self.table("contracts"))
        return {
            "tech_stack": composites.tech_stack(self.table("keywords")), "module_map": scores.module_map(self.nodes).orderBy("module").limit(15),
            "entry_points": find.entry_points(self.nodes).orderBy(F.desc("importance"), "id").limit(10), "key_flows": self.table("concept_paths").where("path_type = 'call_chain'").orderBy("id").limit(5),
            "patterns": patterns.grouped(self.table("patterns")), "hotspots": self.table("file_stats").where("commits_30d > 0").orderBy(F.desc("commits_30d"), "file_path").limit(5),
            "fragile_zones": composites.fragile_zones(self.nodes, self.edges, conflicts).orderBy(F.desc("importance"), "id").limit(5), "couplings": history.couplings(self.table("cochanges")).orderBy(F.desc("coupling_score"), "file_a", "file_b").limit(5),
        }

    def briefing_markdown(self, title: str) -> str:
        """The briefing as Markdown. Each section has a fixed number of lines at most, and says how many there are besides."""
        from graphlode.functions.markdown import section

        parts = self.briefing()
        meta = {r["key"]: r["value"] for r in self.table("meta").collect()}
        more = {
            "module_map": scores.module_map(self.nodes).count(), "entry_points": find.entry_points(self.nodes).count(), "hotspots": self.table("file_stats").where("commits_30d > 0").count(),
        }
        rows = {k: df.collect() for k, df in parts.items()}  # at most 15 rows each
        named = {r["id"]: r for r in self.nodes.join(parts["fragile_zones"].select("id"), "id", "left_semi").select("id", "name", "file_path").collect()}
        fragile = [(named[r["id"]], r) for r in rows["fragile_zones"]]
        hazards = lambda r: ", ".join(x for x in ("no tests" if r["untested"] else "", f"{r['callers']} callers" if r["callers"] else "", "callers disagree" if r["conflict"] else "") if x)
        short = lambda i: i.rsplit("::", 1)[-1]
        flow = lambda ids: " → ".join([*map(short, ids[:6]), *(["…"] if len(ids) > 6 else [])])
        return "\n".join([
            f"# {title}", "", ", ".join(r["technology"] for r in rows["tech_stack"]), "", f"{meta.get('node_count', 0)} symbols, {meta.get('edge_count', 0)} edges.", "",
            *section("Modules", [f"`{r['module']}/`: {r['description']}" for r in rows["module_map"]], more["module_map"]),
            *section("Entry points", [f"`{r['file_path']}`: `{r['signature'] or r['name']}`" for r in rows["entry_points"]], more["entry_points"]),
            *section("Flows", [f"{r['name']}: {flow(r['node_ids'])}" for r in rows["key_flows"]]),
            *section("Patterns", [f"{r['pattern']} ({r['total']}): {', '.join(map(short, r['shown']))}" for r in sorted(rows["patterns"], key=lambda r: r["pattern"])]),
            *section("Hotspots of 30 days", [f"`{r['file_path']}`: {r['commits_30d']} commits, mostly {r['primary_author']}, {r['author_count']} authors" for r in rows["hotspots"]], more["hotspots"]),
            *section("Fragile zones", [f"`{n['file_path']}`: `{n['name']}`, importance {r['importance']:.1f}, {hazards(r)}" for n, r in fragile]),
            *section("Files that change together", [f"`{r['file_a']}` and `{r['file_b']}`: {r['co_commit_count']} commits, {r['coupling_score']:.0%}" for r in rows["couplings"]]),
        ])

    def viz(self, max_nodes: int = 1000) -> dict[str, DataFrame]:
        """The export's parts."""
        kept = stash(composites.viz_nodes(self.nodes, max_nodes), "viz-nodes")
        conflicts = linker.contract_conflicts(self.table("contracts"))
        ids = kept.select(F.col("id").alias("node_id"))
        paths = self.table("concept_paths").select("id", "name", "path_type", F.posexplode("node_ids").alias("pos", "node_id")).join(ids, "node_id", "left_semi").groupBy("id", "name", "path_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"]).alias("node_ids")).where("size(node_ids) >= 2")
        return {
            "modules": scores.module_rollup(kept, self.table("file_stats")), "nodes": kept, "edges": composites.viz_edges(self.edges, kept), "cochanges": self.table("cochanges"), "concept_paths": paths,
            "patterns": self.table("patterns").join(ids, "node_id", "left_semi"), "hotspots": self.table("file_stats").where("commits_30d > 0").orderBy(F.desc("commits_30d"), "file_path"),
            "warnings": composites.warnings_viz(kept, self.edges, self.table("file_stats"), conflicts, self.table("patterns")),
            "fragile_zones": composites.fragile_zones(kept, self.edges, conflicts, 5).orderBy(F.desc("importance"), "id").limit(30), "contract_conflicts": linker.contract_report(self.table("contracts")),
        }

    def export(self, path: str, max_nodes: int = 1000) -> None:
        """viz() as JSON lines, a folder for each part."""
        for name, df in self.viz(max_nodes).items():
            df.write.mode("overwrite").json(f"{path}/{name}")
