import random

from pyspark.sql import functions as F

from graphlode.operators import find, history, linker, patterns, search
from graphlode.schema import last_of, upsert

CALLS = "call_id string, caller_id string, caller_file string, callee string, receiver_type string, error_handling struct<pattern: string, exception: string>, return_usage string"
SYMBOLS = "id string, kind string, name string, file_path string, parent_id string"


def link(spark, symbols, calls, imports=()):
    s = spark.createDataFrame(symbols, SYMBOLS)
    c = spark.createDataFrame([(f"k{i}", "x::caller", file, callee, receiver, None, "ignored") for i, (file, callee, receiver) in enumerate(calls)], CALLS)
    m = spark.createDataFrame(list(imports), "file_path string, module_path string") if imports else None
    out = {}
    for r in linker.link_calls(c, s, m).orderBy("call_id", "target_id").collect():
        out.setdefault(r.call_id, []).append((r.target_id, r.confidence, r.rule))
    return out


def fn(name, file):
    return (f"{file}::{name}", "function", name, file, file)


def method(cls, name, file):
    return (f"{file}::{cls}.{name}", "method", name, file, f"{file}::{cls}")


def test_each_rule(spark):
    symbols = [
        fn("only", "a/x.py"), method("A", "get", "a/x.py"), method("B", "get", "b/y.py"), method("B", "get", "c/y.py"),
        fn("run", "a/x.py"), fn("run", "b/y.py"), fn("run", "c/z.py"), *(fn("many", f"m{i}/f.py") for i in range(8)), ("a/x.py", "file", "only", "a/x.py", ""),
    ]
    calls = [("q/q.py", "self.only", None), ("q/q.py", "x.get", "A"), ("q/q.py", "x.get", "B"), ("a/x.py", "run", ""), ("q/q.py", "run", ""), ("q/q.py", "b.y.run", ""), ("c/other.py", "run", ""), ("q/q.py", "many", ""), ("q/q.py", "none", "")]
    out = link(spark, symbols, calls)
    assert out["k0"] == [("a/x.py::only", "high", 2)]
    assert out["k1"] == [("a/x.py::A.get", "high", 3)]
    assert [x[1:] for x in out["k2"]] == [("low", 8)] * 2
    assert out["k3"] == [("a/x.py::run", "high", 4)]
    assert out["k5"] == [("b/y.py::run", "high", 6)]
    assert out["k6"] == [("c/z.py::run", "high", 7)]
    assert [x[0] for x in out["k7"]] == [f"m{i}/f.py::many" for i in range(6)]
    assert "k8" not in out and len(out["k4"]) == 3
    assert link(spark, symbols, [("q/q.py", "run", "")], [("q/q.py", "b.y"), ("q/q.py", "os")])["k0"] == [("b/y.py::run", "high", 5)]


def test_imports(spark):
    files = spark.createDataFrame([("a/b.py",), ("a/c/__init__.py",), ("m.py",)], "file_path string")
    raw = spark.createDataFrame([("m.py", "a.b", ["f", "*"]), ("m.py", "a.c", []), ("m.py", "os.path", ["join"]), ("m.py", "..m", []), ("m.py", ".", [])], "file_path string, module_path string, imported_names array<string>")
    got = {r.module_path: r.resolved_to_file for r in linker.resolve_imports(raw, files).collect()}
    assert got == {"a.b": "a/b.py", "a.c": "a/c/__init__.py", "os.path": "", "..m": "m.py", ".": ""}
    symbols = spark.createDataFrame([fn("f", "a/b.py"), fn("g", "a/b.py")], SYMBOLS)
    assert {(r.source_id, r.target_id) for r in linker.import_edges(raw, files, symbols).collect()} == {("m.py", "a/b.py"), ("m.py", "a/c/__init__.py"), ("m.py", "a/b.py::f")}


def test_bases(spark):
    c = spark.createDataFrame([("a::K", "K", "a", ["x.Base"]), ("a::Base", "Base", "a", []), ("0::Base", "Base", "0", []), ("b::L", "L", "b", ["Base", "Gone"])], "id string, name string, file_path string, bases array<string>")
    assert {(r.source_id, r.target_id) for r in linker.inherits_edges(c).collect()} == {("a::K", "a::Base"), ("b::L", "0::Base")}


def test_contracts(spark):
    linked = spark.createDataFrame([("k0", "f", "high"), ("k1", "f", "high"), ("k2", "f", "low"), ("k3", "g", "high")], "call_id string, target_id string, confidence string")
    calls = spark.createDataFrame([("k0", "c", "", "", "", ("try_except", "E"), "assigned"), ("k1", "c", "", "", "", ("try_except", ""), "ignored"), ("k2", "d", "", "", "", None, "ignored"), ("k3", "c", "", "", "", None, "returned")], CALLS)
    rows = linker.contracts(calls, linked)
    assert {tuple(r) for r in rows.collect()} == {("f", "c", "try_except", "ignored"), ("g", "c", "none", "returned")}
    assert linker.contract_conflicts(rows).collect() == []
    more = rows.unionByName(spark.createDataFrame([("f", "z", "none", "ignored")], rows.schema))
    assert [r.function_id for r in linker.contract_conflicts(more).collect()] == ["f"]
    r = linker.contract_report(more).first()
    assert (r.caller_count, r.error_strategies, r.return_strategies) == (2, ["try_except"], ["ignored"])


NODE = "id string, kind string, name string, file_path string, signature string, tags array<string>, parent_id string"


def test_dead_ladder(spark):
    rows = [
        ("file", "file", "file", "", "", [], ""), ("dead", "function", "dead", "", "", [], ""), ("used", "function", "used", "", "", [], ""), ("tagged", "function", "tagged", "", "", ["hook"], ""), ("main", "function", "main", "", "", [], ""),
        ("pub", "method", "pub", "", "", [], "K"), ("_priv", "method", "_priv", "", "", [], "K"), ("_heir", "method", "_heir", "", "", [], "H"), ("K", "class", "K", "", "", [], ""), ("H", "class", "H", "", "", ["extends:K"], ""),
        ("M", "class", "M", "", "", ["data_model"], ""), ("route", "function", "route", "", "", ["decorator:api.get"], ""), ("plain", "function", "plain", "", "", ["decorator:cache"], ""), ("UserView", "class", "UserView", "", "", [], ""), ("setUp", "function", "setUp", "", "", [], ""),
    ]
    nodes = spark.createDataFrame(rows, NODE)
    edges = spark.createDataFrame([("K", "used", "calls", "low"), ("x", "dead", "dispatches_to", None), ("H", "K", "inherits", None)], "source_id string, target_id string, edge_type string, confidence string")
    assert {r.id for r in find.dead(nodes, edges).collect()} == {"dead", "_priv", "plain"}


def test_patterns(spark):
    def m(cls, *names):
        return [(f"{cls}.{n}", "method", n, "d/x.py", "", [], cls) for n in names]

    rows = [
        *((c, "class", n, "d/x.py", "", [], "") for c, n in [("B", "Bus"), ("Half", "Half"), ("R", "Repo"), ("R2", "Repo2"), ("S", "One"), ("O", "Subj"), ("Base", "BaseThing"), ("Base1", "BaseLone"), ("u", "U"), ("v", "V")]),
        *m("B", "emit", "on"), *m("Half", "emit"), *m("R", "get_a", "save", "remove_b"), *m("R2", "get_a", "save"), *m("S", "instance"), *m("O", "attach", "detach"),
        *((f"mw{i}", "function", f"mw{i}", "d/m.py", "f(Request, next)", [], "") for i in range(3)), *((f"two{i}", "function", f"two{i}", "e/m.py", "f(request)", [], "") for i in range(2)),
        ("make", "function", "make_it", "d/f.py", "", [], ""), ("idle", "function", "make_idle", "d/f.py", "", [], ""),
    ]
    edges = spark.createDataFrame([("u", "make", "calls"), ("u", "B.on", "calls"), ("v", "B.on", "calls"), ("f", "B", "imports"), ("u", "Base", "inherits"), ("v", "Base", "inherits"), ("u", "Base1", "inherits")], "source_id string, target_id string, edge_type string")
    found = {(r.node_id, r.pattern): r.detail for r in patterns.detect(spark.createDataFrame(rows, NODE), edges).collect()}
    assert set(found) == {("B", "event_bus"), ("R", "repository"), ("S", "singleton"), ("O", "observer"), ("Base", "strategy"), ("make", "factory"), *((f"mw{i}", "middleware_chain") for i in range(3))}
    assert found["B", "event_bus"] == {"listeners": "2", "importers": "1"}
    assert found["R", "repository"] == {"crud_categories": "create, delete, read"}


def commits(spark, rows):
    df = spark.createDataFrame(rows, "hash string, author string, date string, files array<string>")
    return df.withColumn("date", F.col("date").cast("timestamp_ntz"))


def test_history_bounds(spark):
    files16 = [f"f{i:02}" for i in range(16)]
    rows = [("h1", "b", "2024-01-31 00:00:00", ["x", "y"]), ("h2", "a", "2024-01-24 00:00:00", ["y", "x"]), ("h3", "a", "2024-01-01 00:00:00", ["x"]), ("h4", "b", "2023-12-31 23:59:59", ["x"]), ("h5", "z", None, ["w", "v"]), ("h6", "z", "2024-01-01 00:00:00", files16), ("h7", "z", "2024-01-02 00:00:00", files16)]
    c = commits(spark, rows)
    s = {r.file_path: r for r in history.file_stats(c, "2024-01-31 00:00:00").collect()}
    assert (s["x"].total_commits, s["x"].commits_30d, s["x"].commits_7d, s["x"].primary_author, s["x"].author_count, s["x"].last_commit) == (4, 3, 2, "a", 2, "2024-01-31T00:00:00")
    assert s["w"].commits_7d == 1
    pairs = history.cochanges(c).collect()
    assert [(r.file_a, r.file_b, r.co_commit_count, r.coupling_score, r.commit_ids) for r in pairs] == [("x", "y", 2, 0.5, ["h2", "h1"])]
    assert history.cochanges(c, min_coupling=0.51).collect() == [] and history.cochanges(c, min_count=3).collect() == []
    sixteen = commits(spark, [("a", "a", "2024-01-01 00:00:00", ["p", "q"])] + [(f"s{i}", "a", "2024-01-01 00:00:00", ["p"]) for i in range(15)])
    assert history.cochanges(sixteen, 1, 0.0).first().coupling_score == 0.062


def test_git_log(spark):
    lines = ["noise", "COMMIT|h1|Al <1+al@users.noreply.github.com>|2024-01-02T03:04:05+01:00", "a.py", "", " b.py", "COMMIT|h2|B <b@c>|2024-01-01T00:00:00Z"]
    df = spark.createDataFrame([("l", i, x) for i, x in enumerate(lines)], "log string, n long, line string")
    got = {r.hash: (r.author, str(r.date), r.files) for r in history.parse_log(df).collect()}
    assert got == {"h1": ("Al (@al)", "2024-01-02 02:04:05", ["a.py", "b.py"]), "h2": ("B <b@c>", "2024-01-01 00:00:00", [])}


def test_keywords_and_seeds(spark):
    nodes = spark.createDataFrame([("n1", "function", "getUserName", "pkg/user_store.py", "Loads a user from disk", ["async", "extends:Base,Model"])], "id string, kind string, name string, file_path string, docstring string, tags array<string>")
    got = {(r.keyword, r.source) for r in search.extract_keywords(nodes).collect()}
    assert got == {("getusername", "name"), ("user", "name"), ("name", "name"), ("loads", "docstring"), ("user", "docstring"), ("disk", "docstring"), ("async", "tag"), ("extends", "tag"), ("base", "tag"), ("model", "tag"), ("pkg", "file_path"), ("user_store", "file_path"), ("user", "file_path"), ("store", "file_path")}
    k = spark.createDataFrame([("user", "n1", "name"), ("users", "n1", "docstring"), ("userland", "n2", "name"), ("member", "n3", "name"), ("odd", "n4", "name")], "keyword string, node_id string, source string")
    assert {r.node_id: r.score for r in search.seed_scores(k, "the user").collect()} == {"n1": 5.0, "n2": 3 * 0.6, "n3": 1.5}


def test_fuzzy(spark):
    rows = [("a/x.py::Foo.bar", "bar", "method"), ("b/foo.py::Foo.bar", "bar", "method"), ("a/x.py::barrier", "barrier", "function"), ("a/x.py::bra", "bra", "function"), ("a/x.py", "x.py", "file"), ("a/x.py::zzz", "zzz", "function")]
    nodes = spark.createDataFrame([(i, n, k, i.split("::")[0], ["category:core"], 1.0) for i, n, k in rows], "id string, name string, kind string, file_path string, tags array<string>, importance double")
    s = {r.id: round(r.score, 4) for r in search.fuzzy_scores(nodes, "Foo.bar").collect()}
    assert s["a/x.py::Foo.bar"] == s["b/foo.py::Foo.bar"] and s["a/x.py::Foo.bar"] >= 0.99 and s["a/x.py::barrier"] == 0.7 and "a/x.py::zzz" not in s
    assert round(s["a/x.py::bra"], 4) == round(0.5 * 2 / 3, 4)
    assert search.resolve(nodes, "Foo.bar")[0] == "b/foo.py::Foo.bar"
    assert search.resolve(nodes, "a\\x.py::barrier")[0] == "a/x.py::barrier"
    assert search.resolve(nodes, "bar")[0] is None and search.resolve(nodes, "bar", 2)[0] == "b/foo.py::Foo.bar" and search.resolve(nodes, "bar", 9)[0] is None
    assert search.resolve(nodes, "qqqqqq") == (None, [])


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), (None, 2)], "k string, v int")
    assert {tuple(r) for r in upsert(old, new, ["k"]).collect()} == {("a", 2), ("b", 1), (None, 2)}
    assert {tuple(r) for r in last_of(old.unionByName(new), ["k"], F.col("v")).collect()} == {("a", 2), ("b", 1), (None, 2)}


def brute_links(symbols, calls, imports, fan_out=6):
    """The rules over all candidates of each call."""
    out = {}
    paths = {}
    for file, module in imports:
        base = module.lstrip(".").replace(".", "/")
        paths.setdefault(file, set()).update({f"{base}.py", f"{base}/__init__.py"})
    module = lambda p: p.split("/")[0] if "/" in p else ""
    for k, (file, callee, receiver) in enumerate(calls):
        bare = callee.removeprefix("self.")
        qualifier, _, name = bare.rpartition(".")
        found = sorted((i, kind, path, parent.rsplit("::", 1)[-1].rsplit(".", 1)[-1]) for i, kind, n, path, parent in symbols if n == name and kind != "file")
        if not found:
            continue
        typed = [x for x in found if receiver and x[1] == "method" and x[3] == receiver]
        pool = typed or found
        hits = {x[0]: sum(part in x[0].lower() for part in qualifier.lower().split(".") if part) for x in pool}
        best = [x for x in pool if hits[x[0]] == max(hits.values()) > 0]
        same, near, mod = [x for x in pool if x[2] == file], [x for x in pool if x[2] in paths.get(file, ())], [x for x in pool if module(x[2]) == module(file)]
        ladder = [(2, found), (3, typed), (4, same), (5, near), (6, best), (7, mod)]
        rule, take = next(((r, x) for r, x in ladder if len(x) == 1), (8, sorted(pool, key=lambda x: (0 if x in same else 1 if x in near else 2, x[0]))[:fan_out]))
        out[f"k{k}"] = [(i, "low" if rule == 8 else "high", rule) for i in sorted(x[0] for x in take)]
    return out


def test_links_as_by_brute_force(spark):
    r = random.Random(3)
    files = [f"{m}/f{i}.py" for m in "abc" for i in range(6)] + ["root.py"]
    symbols = {}
    for _ in range(220):
        f, n = r.choice(files), r.choice(["get", "get", "get", "run", "put"])
        x = method(r.choice("ABCD"), n, f) if r.random() < 0.6 else fn(n, f)
        symbols[x[0]] = x
    for x in (fn("solo1", "a/f0.py"), method("E", "solo2", "b/f1.py"), method("E", "get", "b/f1.py")):
        symbols[x[0]] = x
    calls = [(r.choice(files), r.choice(["", "self.", "x.", "a.f1.", "F2.b.", "self.d."]) + r.choice(["get", "run", "put", "solo1", "solo2", "none"]), r.choice(["", None, "A", "B", "E", "Z"])) for _ in range(400)]
    imports = [(f, r.choice(["a.f1", "b.f2", "c.f3", ".a.f0", "os"])) for f in files for _ in range(2)]
    got = link(spark, list(symbols.values()), calls, imports)
    assert got == brute_links(symbols.values(), calls, imports) and {x[2] for v in got.values() for x in v} == {2, 3, 4, 5, 6, 7, 8}


def test_a_name_that_everything_has(spark):
    """20,000 calls and 20,000 symbols of one name: no row for each pair."""
    symbols = spark.range(20_000).selectExpr("concat('m', id % 50, '/f', id, '.py::get') AS id", "'function' AS kind", "'get' AS name", "concat('m', id % 50, '/f', id, '.py') AS file_path", "concat('m', id % 50, '/f', id, '.py') AS parent_id")
    calls = spark.range(20_000).selectExpr("concat('k', id) AS call_id", "'x' AS caller_id", "concat('q/', id, '.py') AS caller_file", "concat('v', id % 3, '.get') AS callee", "'' AS receiver_type")
    assert {(r.rule, r.n) for r in linker.link_calls(calls, symbols).groupBy("rule").agg(F.count("*").alias("n")).collect()} == {(8, 120_000)}


def test_equal_calls_are_resolved_once(spark, monkeypatch):
    """A thousand calls that differ in their callers alone meet symbols as one; forms with and without targets in a row agree."""
    stored = {}
    real = linker.stash
    monkeypatch.setattr(linker, "stash", lambda df, name, *a: stored.setdefault(name, []).append(real(df, name, *a)) or stored[name][-1])
    calls = spark.createDataFrame([(f"c{i}", f"f{i % 10}", "a.py", "go", None, ("try_except", None), "assigned") for i in range(1000)] + [("d", "f0", None, "stop", None, (None, None), "ignored")], "call_id string, caller_id string, caller_file string, callee string, receiver_type string, error_handling struct<pattern string, exception string>, return_usage string")
    symbols = spark.createDataFrame([(f"s{i}", "function", "go", f"m{i}/x.py", "") for i in range(9)] + [("t", "function", "stop", "z.py", "")], "id string, kind string, name string, file_path string, parent_id string")
    linked = linker.link_calls(calls, symbols)
    assert linked.where("rule = 8 AND confidence = 'low'").count() == 6000 and linked.where("rule = 2").count() == 1
    assert max(df.count() for name, tables in stored.items() for df in tables if name != "calls") <= 20
    one_row = linker.resolved(calls, symbols, keep=["error_handling", "return_usage"])
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(linker.call_edges(one_row)) == rows(linker.call_edges(linked)) and linker.call_edges(linked).count() == 61
    assert rows(linker.contracts(calls, one_row)) == rows(linker.contracts(calls, linked)) == [("t", "f0", "none", "ignored")]
