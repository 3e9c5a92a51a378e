"""From a small tree of sources to answers, and the refresh by stream."""

import json

import pytest

from graphlode.api import Engine, UnknownSymbol
from graphlode.operators import composites, content
from graphlode.sources.braces import parse_braces
from graphlode.sources.pyparse import parse_python
from graphlode.streaming import refresh

TREE = {
    "shop/models.py": '"""Models."""\nfrom abc import ABC\n\n__all__ = ["Item"]\n\n\nclass Base(ABC):\n    def price(self) -> int:\n        """What it costs."""\n        return 0\n\n\nclass Item(Base):\n    def price(self) -> int:\n        return compute_tax(1)\n\n\ndef compute_tax(n):\n    return n\n',
    "shop/store.py": 'from shop.models import Item, compute_tax\n\n\nclass Store:\n    def __init__(self):\n        self.item = Item()\n\n    async def total(self, extra: "Item | None" = None):\n        try:\n            x = self.item.price()\n        except (ValueError, KeyError):\n            x = 0\n        if compute_tax(2):\n            return extra.price()\n        return x\n\n\n@app.get("/total")\ndef handler(request):\n    name = "user_id"\n    return Store().total()\n\n\ndef _unused():\n    pass\n',
    "tests/test_store.py": "from shop.store import Store\n\n\ndef test_total():\n    s = Store()\n    s.total()\n",
    "shop/broken.py": "def x(:\n",
    "node_modules/a.js": "function no() {}\n",
    "web/app.js": "import { x } from './lib';\nexport class View extends Base {\n  render(a) {\n    helper(a);\n  }\n}\nfunction helper(a) { return a; }\n",
    "shop/__init__.py": "",
    "skip/me.py": "def skipped(): pass\n",
    ".graphlodeignore": "# rules\nskip/\n",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    rows = [("h1", "al", ["shop/models.py", "shop/store.py"]), ("h2", "al", ["shop/store.py", "shop/models.py", "gone.py"]), ("h3", "bo", ["shop/store.py", "shop/models.py"])]
    commits = spark.createDataFrame(rows, "hash string, author string, files array<string>").selectExpr("hash", "author", "TIMESTAMP_NTZ '2024-01-30 00:00:00' AS date", "files")
    e = Engine(spark, str(tmp_path_factory.mktemp("store")), "2024-01-31 00:00:00")
    e.build(str(root), commits)
    e.root, e.commits = root, commits
    return e


def test_nodes_and_edges(engine):
    ids = {r.id: r.kind for r in engine.nodes.collect()}
    assert ids["shop/store.py::Store.total"] == "method" and ids["shop/broken.py"] == "file" and ids["web/app.js::View.render"] == "method" and ids["web/app.js::helper"] == "function"
    assert not any(i.startswith(("node_modules", "skip")) for i in ids)
    edges = {(r.source_id, r.target_id, r.edge_type): r.confidence for r in engine.edges.collect()}
    assert edges["shop/store.py::Store.total", "shop/models.py::Item.price", "calls"] == "high"
    assert edges["shop/models.py::Item", "shop/models.py::Base", "inherits"] is None
    assert ("shop/models.py::Base.price", "shop/models.py::Item.price", "dispatches_to") in edges
    assert ("shop/store.py", "shop/models.py", "imports") in edges and ("shop/store.py", "shop/models.py::Item", "imports") in edges
    assert ("web/app.js::View.render", "web/app.js::helper", "calls") in edges
    tags = {r.id: r.tags for r in engine.nodes.collect()}
    assert "abstract" in tags["shop/models.py::Base"] and "exported" in tags["shop/models.py::Item"] and "async" in tags["shop/store.py::Store.total"] and "route_handler" in tags["shop/store.py::handler"] and "category:test" in tags["tests/test_store.py::test_total"]


def test_tables(engine):
    c = {(r.function_id, r.caller_id): (r.error_handling, r.return_usage) for r in engine.table("contracts").collect()}
    assert c["shop/models.py::compute_tax", "shop/store.py::Store.total"] == ("none", "checked")
    assert c["shop/models.py::Item.price", "shop/store.py::Store.total"] == ("none", "returned")
    assert [(r.literal, r.line_number) for r in engine.table("string_refs").where("literal = 'user_id'").collect()] == [("user_id", 20)]
    assert engine.table("cochanges").first().co_commit_count == 3
    assert {r.key: r.value for r in engine.table("meta").where("key LIKE '%count'").collect()}["file_count"] == "6"
    assert {r.check: r.ok for r in engine.doctor(str(engine.root)).collect()}["fresh"]
    assert engine.stats().count() > 5


def test_questions(engine):
    root = str(engine.root)
    assert [r.id for r in engine.trace("handler", "compute_tax").orderBy("pos").collect()][-1] == "shop/models.py::compute_tax"
    assert {r.id for r in engine.callers("compute_tax").collect()} == {"shop/models.py::Item.price", "shop/store.py::Store.total"}
    assert "tests/test_store.py::test_total" in {r.id for r in engine.blast_radius("compute_tax").collect()}
    assert [r.id for r in engine.affected_tests("Store.total").collect()] == ["tests/test_store.py::test_total"]
    assert engine.peek("Store.total").first().direct_count == 1
    assert {r.id for r in engine.find(is_dead=True).collect()} == {"shop/store.py::_unused"}
    assert [r.source for r in engine.read("compute_tax", root).collect()] == ["def compute_tax(n):\n    return n"]
    assert engine.ask("exists", "nothing_like_it_at_all").first().result is False
    assert engine.ask("is-async", "Store.total").first().is_async and engine.ask("calls", "handler", "_unused").first().direct is False
    assert engine.ask("has-tests", "Store.total").first().direct_count == 1
    assert {r.module_path: r.resolved_to_file for r in engine.ask("imports", "store.py").collect()} == {"shop.models": "shop/models.py"} or engine.ask("imports", "shop/store.py").count() == 1
    assert engine.verify("handler calls Store.total").count() >= 2
    assert {r.id for r in engine.tree("store.py").collect()} >= {"shop/store.py::Store", "shop/store.py::handler"}
    assert engine.uses("compute_tax", root, "shop/*").count() == 4
    assert engine.string_refs("user_id").first().lines == [20]
    assert [r.other for r in engine.cochange("shop/models.py").collect()] == ["shop/store.py"] and engine.why("shop/store.py", "shop/models.py").count() == 3
    assert [r.commits_7d for r in engine.hotspots().collect()] == [3, 3]
    with pytest.raises(UnknownSymbol):
        engine.peek("qqqqqqqq")
    assert engine.read_since("compute_tax", "x").first().unchanged is False
    assert engine.flows().count() >= 1


def test_nav_and_reports(engine, tmp_path):
    nav = engine.nav("compute the tax")
    assert nav["primary"].first().id == "shop/models.py::compute_tax"
    assert nav["secondary"].count() >= 1 and nav["read_order"].count() == nav["primary"].count()
    assert [r.other for r in nav["cochange"].collect()] == ["shop/store.py"]
    assert {k for k, v in engine.briefing().items() if v is not None} >= {"tech_stack", "module_map", "key_flows"}
    engine.export(str(tmp_path), 3)
    lines = [json.loads(x) for p in (tmp_path / "nodes").glob("*.json") for x in p.read_text().splitlines()]
    assert len([x for x in lines if x["kind"] != "file"]) == 3


def test_update_by_stream(spark, engine, tmp_path):
    assert engine.update(str(engine.root), engine.commits).count() == 0
    (engine.root / "shop/new.py").write_text("def fresh():\n    return compute_tax(1)\n")
    (engine.root / "shop/broken.py").unlink()
    events = tmp_path / "events"
    events.mkdir()
    (events / "1.json").write_text("\n".join(json.dumps({"file_path": p, "event": "modified"}) for p in ["shop/new.py", "shop/new.py", "node_modules/a.js", "notes.txt"]))
    seen, plans = [], []

    def run(paths, batch_id):
        seen.extend(r.file_path for r in paths.collect())
        plans.extend(tuple(r) for r in engine.update(str(engine.root), engine.commits).collect())

    refresh.watch(refresh.file_events(spark, str(events)), run, str(tmp_path / "checkpoint"), once=True).awaitTermination()
    assert seen == ["shop/new.py"] and sorted(plans) == [("shop/broken.py", "deleted"), ("shop/new.py", "new")]
    assert engine.nodes.where("id = 'shop/new.py::fresh'").count() == 1 and engine.nodes.where("id = 'shop/broken.py'").count() == 0


def test_python_parser():
    out = parse_python("a.py", "class K:\n    @property\n    def x(self):\n        await f(g())\n        assert h()\n        def inner():\n            hidden()\n        y = a().b()\n        yield z()\n")
    calls = {c["callee"]: c["return_usage"] for c in out["calls"]}
    assert calls == {"f": "awaited_ignored", "g": "assigned", "h": "checked", "a().b": "assigned", "z": "returned"}
    assert [n["tags"] for n in out["nodes"] if n["id"] == "a.py::K.x"] == [["decorator:property", "property"]]
    assert len(parse_python("b.py", "")["nodes"]) == 1


BRACES = {
    "java": ("A.java", "import java.util.List;\npublic class A extends B implements C {\n  @Override\n  public int run(int x) throws E {\n    try {\n      go(x);\n    } catch (E e) { stop(); }\n    return x;\n  }\n}\n", {"A.java::A", "A.java::A.run"}, {"go", "stop"}),
    "go": ("a.go", 'package a\nimport "fmt"\ntype T struct {\n  x int\n}\nfunc (t *T) Run(a int) error {\n\tfmt.Println(a)\n\treturn nil\n}\nfunc main() {\n\thelp()\n}\n', {"a.go::T", "a.go::T.Run", "a.go::main"}, {"fmt.Println", "help"}),
    "rust": ("a.rs", "use std::io;\npub struct T { x: u8 }\nimpl Show for T {\n    pub fn show(&self) -> u8 {\n        helper(self.x)\n    }\n}\nfn helper(x: u8) -> u8 { x }\n", {"a.rs::T", "a.rs::T.show", "a.rs::helper"}, {"helper"}),
    "cpp": ("a.cpp", "#include <x.h>\nclass A : public B {\n public:\n  int get() { return calc(1); }\n};\nint A::put(int x) {\n  store(x);\n}\n", {"a.cpp::A", "a.cpp::A::get", "a.cpp::A::put"}, {"calc", "store"}),
    "csharp": ("a.cs", "using System;\nnamespace N {\n public class A : B {\n  public async Task Run(int x)\n  {\n    await Go(x);\n  }\n }\n}\n", {"a.cs::A", "a.cs::A.Run"}, {"Go"}),
    "ruby": ("a.rb", "require 'x'\nclass A < B\n  def run(x)\n    go(x)\n    if x\n      stop(1)\n    end\n  end\n\n  def other\n    more(2)\n  end\nend\n", {"a.rb::A", "a.rb::A.run", "a.rb::A.other"}, {"go", "stop", "more"}),
    "typescript": ("a.ts", "import { q } from 'q';\nexport interface I { a: number }\nexport const f = async (x: number) => {\n  return q(x);\n};\n", {"a.ts::I", "a.ts::f"}, {"q"}),
    "c": ("a.c", "#include \"b.h\"\nstatic int add(int a, int b)\n{\n  return sum(a, b);\n}\n", {"a.c::add"}, {"sum"}),
}


@pytest.mark.parametrize("language", BRACES)
def test_brace_parsers(language):
    path, source, ids, callees = BRACES[language]
    out = parse_braces(path, source, language)
    assert {n["id"] for n in out["nodes"]} == ids | {path}
    assert {c["callee"] for c in out["calls"]} == callees
    assert out["imports"]


def test_statements():
    assert composites.parse_statement("'A is called by B'") == ("B", "calls", "A")
    assert composites.parse_statement("A extends B") == ("A", "inherits", "B")
    assert composites.parse_statement("recalls B") is None and composites.parse_statement("A calls") is None


def test_run_summary(spark):
    logs = [("r1", "FAILED a::b - x\nERROR c\n=== 1 failed, 2 passed, 1 error, 3 skipped in 0.42s ===\n"), ("r2", "5 passed in 1s\n1 failed in 2.5s"), ("r3", "nothing"), ("r4", None)]
    got = {r.run: (r.passed, r.failed, r.errors, r.skipped, r.seconds) for r in composites.run_summary(spark.createDataFrame(logs, "run string, output string")).collect()}
    assert got == {"r1": (2, 1, 1, 3, 0.42), "r2": (0, 1, 0, 0, 2.5), "r3": (0, 0, 0, 0, 0.0), "r4": (0, 0, 0, 0, 0.0)}


def test_uses(spark):
    f = spark.createDataFrame([("b.py", "x\n# x\nxx\ny x"), ("a.py", "x\n" * 300)], "file_path string, content string")
    rows = content.uses(f, "x").collect()
    assert len(rows) == 202 and (rows[0].file_path, rows[199].line_number) == ("a.py", 200) and [(r.file_path, r.line_number) for r in rows[200:]] == [("b.py", 1), ("b.py", 4)]
    assert len(content.uses(f, "x", limit=5).collect()) == 5 and content.uses(f, "x", "b*").count() == 2
    with pytest.raises(ValueError):
        content.uses(f, "a b")


def test_hash_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "file_path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "file_path string, content_hash string")
    assert {tuple(r) for r in content.hash_diff(old, new).collect()} == {("b", "changed"), ("c", "deleted"), ("d", "new")}


def test_trace_options(engine):
    path = engine.trace("handler", "compute_tax", root=str(engine.root))
    rows = path.collect()
    assert [r.pos for r in rows] == list(range(len(rows))) and "def handler" in rows[0].source and "def compute_tax" in rows[-1].source
    assert {r.resolution for r in engine.trace("handler", "compute_tax", via_inheritance=True).collect()} == {"soft"}
    with pytest.raises(ValueError, match="exclude"):
        engine.trace("handler", "compute_tax", calls_only=True, via_inheritance=True)


def test_briefing_as_markdown(engine):
    text = engine.briefing_markdown("shop")
    assert text.startswith("# shop\n") and "Python" in text and "## Entry points" in text and "- `shop/store.py`" in text
    assert "## Files that change together" in text and "- `shop/models.py` and `shop/store.py`: 3 commits, 100%" in text


def test_update_parses_changed_files_only(spark, tmp_path, monkeypatch):
    from graphlode import api

    root, store = tmp_path / "tree", tmp_path / "store"
    (root / "a").mkdir(parents=True)
    for i in range(4):
        (root / "a" / f"m{i}.py").write_text(f"def f{i}():\n    return {i}\n")
    commits = spark.createDataFrame([], "hash string, author string, date timestamp_ntz, files array<string>")
    e = Engine(spark, str(store), "2024-01-31 00:00:00")
    e.build(str(root), commits)
    seen = []
    real = api.parse.parse
    monkeypatch.setattr(api.parse, "parse", lambda files: seen.extend(r.file_path for r in files.select("file_path").collect()) or real(files))
    (root / "a" / "m1.py").write_text("def g():\n    return f0()\n")
    (root / "a" / "m2.py").unlink()
    plan = {r.file_path: r.status for r in e.update(str(root), commits).collect()}
    assert plan == {"a/m1.py": "changed", "a/m2.py": "deleted"} and seen == ["a/m1.py"]
    assert {r.id for r in e.nodes.where("kind = 'function'").collect()} == {"a/m0.py::f0", "a/m1.py::g", "a/m3.py::f3"}
    assert e.edges.where("edge_type = 'calls'").select("source_id", "target_id").collect() == [("a/m1.py::g", "a/m0.py::f0")]
    assert e.update(str(root), commits).collect() == []


def test_store_keeps_a_table_at_every_step(spark, tmp_path):
    from graphlode.sources.store import Store

    store = Store(spark, str(tmp_path / "s"))
    for i in range(4):
        before = store.read("meta")
        store.write("meta", spark.createDataFrame([("k", str(i))], "key string, value string"))
        assert [r.value for r in before.collect()] == ([str(i - 1)] if i else [])  # a reader of the version before goes on
        assert store.read("meta").collect() == [("k", str(i))]
    (tmp_path / "s" / "meta" / ("f" * 32)).mkdir()  # a write that failed before its pointer
    assert store.read("meta").collect() == [("k", "3")]


def test_large_files_are_reported(spark, tmp_path):
    from graphlode.sources import files

    (tmp_path / "big.py").write_text("x = 1\n" * 200)
    (tmp_path / "small.py").write_text("y = 1\n")
    assert [r.file_path for r in files.scan(spark, str(tmp_path), largest=100).collect()] == ["small.py"]
    assert [r.file_path for r in files.too_large(spark, str(tmp_path), largest=100).collect()] == ["big.py"]
    assert files.scan(spark, str(tmp_path), largest=None).count() == 2


def test_runs_of_tests(spark, tmp_path):
    from graphlode.sources import testrun

    (tmp_path / "test_a.py").write_text("def test_x():\n    pass\n\n\ndef test_y():\n    assert 0\n")
    (row,) = testrun.run_pytest(spark, str(tmp_path), str(tmp_path / "logs"), ["-p", "no:cacheprovider"]).collect()
    assert (row.passed, row.failed) == (1, 1) and row.failures[0].startswith("FAILED test_a.py::test_y")
    assert "assert 0" in testrun.raw(str(tmp_path / "logs"), row.run)
    assert [(r.run, r.failed) for r in testrun.stored(spark, str(tmp_path / "logs")).collect()] == [(row.run, 1)]
    with pytest.raises(ValueError, match="no run"):
        testrun.raw(str(tmp_path), "../x")


RECEIVERS = {
    ("java", "a/B.java"): ("public class B extends D {\n  private Store store;\n  public int total(Item item) {\n    Cart cart = new Cart();\n    try {\n      int x = cart.sum(1);\n      store.save(item);\n    } catch (IOException e) {\n      log(e);\n    }\n    this.help();\n    return item.price();\n  }\n}\n",
                         {"cart.sum": ("Cart", "assigned", "IOException"), "store.save": ("Store", "ignored", "IOException"), "this.help": ("B", "ignored", None), "item.price": ("Item", "returned", None), "log": ("", "ignored", None)}),
    ("typescript", "a/b.ts"): ("export class View {\n  private repo: Repo;\n  render(a: Item) {\n    const c = new Cart();\n    if (c.ok()) {\n      this.repo.find(a);\n    }\n    await a.price();\n  }\n}\n", {"c.ok": ("Cart", "checked", None), "this.repo.find": ("Repo", "ignored", None), "a.price": ("Item", "awaited", None)}),
    ("go", "a/b.go"): ("func (s *Store) Total(c *Cart) int {\n\tx := NewItem(1)\n\ty := &Box{}\n\ts.help()\n\tx.Price()\n\ty.Open()\n\treturn c.Sum()\n}\n", {"s.help": ("Store", "ignored", None), "x.Price": ("Item", "ignored", None), "y.Open": ("Box", "ignored", None), "c.Sum": ("Cart", "returned", None)}),
    ("rust", "a/b.rs"): ("struct S {}\nimpl S {\n    pub fn total(&self, c: &Cart) -> i32 {\n        let x = Item::new(1);\n        self.help();\n        x.price();\n        c.sum()\n    }\n}\n", {"self.help": ("S", "ignored", None), "x.price": ("Item", "ignored", None), "c.sum": ("Cart", "ignored", None)}),
    ("csharp", "a/B.cs"): ("public class B : D {\n  private Store _store;\n  public int Total(Item item) {\n    var cart = new Cart();\n    cart.Sum();\n    _store.Save(item);\n  }\n}\n", {"cart.Sum": ("Cart", "ignored", None), "_store.Save": ("Store", "ignored", None)}),
    ("cpp", "a/b.cpp"): ("class B : public D {\n  Store store;\n  int total(Item* item) {\n    auto p = new Pen();\n    p->draw();\n    store.save();\n    return item->price();\n  }\n};\n", {"p->draw": ("Pen", "ignored", None), "store.save": ("Store", "ignored", None), "item->price": ("Item", "returned", None)}),
    ("ruby", "a/b.rb"): ("class B < D\n  def total(item)\n    @store = Store.new\n    begin\n      c = Cart.new(1)\n      c.sum(1)\n    rescue IOError => e\n      log(e)\n    end\n    self.help(2)\n    @store.save(3)\n  end\nend\n", {"c.sum": ("Cart", "ignored", "IOError"), "log": ("", "ignored", None), "self.help": ("B", "ignored", None), "store.save": ("Store", "ignored", None)}),
}


@pytest.mark.parametrize("case", RECEIVERS, ids=lambda c: c[0])
def test_receivers_and_results_by_their_look(case):
    source, want = RECEIVERS[case]
    got = {c["callee"]: (c["receiver_type"], c["return_usage"], c["error_handling"] and c["error_handling"]["exception"]) for c in parse_braces(case[1], source, case[0])["calls"]}
    assert {k: got[k] for k in want} == want
