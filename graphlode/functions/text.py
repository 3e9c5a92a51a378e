"""Scalar text functions as columns, and their twins in Python for query strings, which are single values."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

KEYWORD_STOPS = """a an and as bool class cls def dict elif else except false float for from get if import in init int is
list new none not of or return self set str the to true try tuple type while with""".split()
QUERY_STOPS = """a about also an and any are at be been but by can could did do does find for from help here how i in into
is it its just like look me my need not of on or our please should show some tell that the there this to very want was we
were what when where which who why with would""".split()

#: Term: what it may also be called. Order within a line has no meaning.
SYNONYM_LINES = """
auth: authenticate authorization credential login permission session token
cache: buffer memoize pool store
config: env environment options params preferences settings
connect: attach bind join link register subscribe
create: build construct factory generate initialize make spawn
database: db persistence query repository sql store
decide: choose compute determine pick resolve select
delete: cleanup clear destroy drop purge remove
disconnect: close detach leave terminate unregister
error: abort crash exception failure fault panic
find: fetch get lookup query resolve retrieve search
format: convert encode marshal serialize transform
load: deserialize fetch ingest parse read restore
log: audit debug journal record trace
message: alert event notification packet payload signal
parse: decode deserialize extract interpret tokenize
receive: accept consume handle incoming listen subscribe
render: component display draw paint template view
route: api endpoint handler path url
save: commit dump persist record store write
send: broadcast dispatch emit notify publish push transmit
start: begin boot init launch run startup
stop: close end halt kill shutdown terminate
update: change edit modify mutate patch set
user: account agent client member participant player
validate: assert check confirm ensure test verify
vote: ballot choose elect nominate pick poll
win: final leaderboard outcome result score victory winner
"""
SYNONYMS = {k: v.split() for k, v in (line.split(":") for line in SYNONYM_LINES.strip().splitlines())}

_SUFFIX = f"(?:{'|'.join('able al ed er es ful ible ing ive ly ment ness ous tion'.split())})$"
#: Between a small letter or digit and a capital, and before the last capital of several that a small letter follows.
_BREAK = "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


# -- identifiers


def _humps(c: Column) -> Column:
    return F.regexp_replace(c, _BREAK, "_")


def identifier_parts(name: Column) -> Column:
    """The lower-case words of a snake_case name, or else of a camelCase one."""
    parts = F.split(F.when(name.contains("_"), name).otherwise(_humps(name)), "_")
    return F.transform(F.filter(parts, lambda x: x != ""), F.lower)


def split_humps(text: str) -> list[str]:
    return re.sub(_BREAK, "_", text).split("_")


def query_terms(query: str) -> list[str]:
    """A query's terms: words of its words, without stop words, in order, each once."""
    words = (p.lower().strip() for token in query.split() for p in split_humps(token))
    return list(dict.fromkeys(w for w in words if len(w) >= 2 and w not in QUERY_STOPS))


def query_terms_col(text: Column) -> Column:
    """The same of a column."""
    parts = F.flatten(F.transform(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda t: F.split(_humps(t), "_")))
    kept = F.filter(F.transform(parts, F.lower), lambda w: (F.length(w) >= 2) & ~w.isin(QUERY_STOPS))
    return F.array_distinct(kept)


def stem(word: str) -> str:
    s = re.sub(_SUFFIX, "", word)
    if s == word:
        s = re.sub(r"(?<!s)s$", "", word)
    return s if len(s) >= 3 else word


def stem_col(word: Column) -> Column:
    cut = F.regexp_replace(word, _SUFFIX, "")
    cut = F.when(cut == word, F.regexp_replace(word, "(?<!s)s$", "")).otherwise(cut)
    return F.when(F.length(cut) >= 3, cut).otherwise(word)


def with_synonyms(terms: list[str]) -> list[str]:
    return list(dict.fromkeys(x for t in terms for x in (t, *SYNONYMS.get(t, []))))


def keyword_array(words: Column) -> Column:
    """Words fit for the index: trimmed, lower case, of three letters or more, no stop words, each once."""
    low = F.transform(words, lambda w: F.lower(F.trim(w)))
    return F.array_distinct(F.filter(low, lambda w: (F.length(w) >= 3) & ~w.isin(KEYWORD_STOPS)))


# -- paths

#: Category: (parts anywhere in the path, beginnings of the file's name), in order of precedence.
CATEGORIES: list[tuple[str, str, str]] = [
    ("vendor", r"/(node_modules|vendor|third_party|3rdparty|thirdparty|third-party)/", ""),
    ("generated", r"/(dist|build|\.next|target|out)/|\.min\.js|\.min\.css|\.bundle\.js|\.generated\.|_pb\.py|_pb2\.py|\.pb\.go", ""),
    ("test", r"/(tests?|__tests__|specs?)/|_test\.|\.test\.|\.spec\.|_spec\.", "test_"),
    ("script", r"/(scripts|ci|build_scripts|\.github)/", ""),
    ("example", r"/(examples?|samples?|demos?)/", ""),
    ("doc", r"/(docs?|documentation)/", ""),
]
LOW_PRIORITY = "doc example generated script test vendor".split()


def _rooted(path: Column) -> Column:
    low = F.lower(F.translate(path, "\\", "/"))
    return F.when(low.startswith("/"), low).otherwise(F.concat(F.lit("/"), low))


def category(path: Column) -> Column:
    """The first category that a path fits, else core."""
    rooted = _rooted(path)
    base = F.substring_index(rooted, "/", -1)
    out = None
    for name, anywhere, begins in CATEGORIES:
        fits = rooted.rlike(anywhere)
        if begins:
            fits = fits | base.startswith(begins)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("core")


def category_of_tags(tags: Column) -> Column:
    """What the first tag category:<x> says, in lower case; empty without one."""
    found = F.filter(tags, lambda t: t.startswith("category:"))
    return F.coalesce(F.lower(F.substr(F.get(found, F.lit(0)), F.lit(10))), F.lit(""))


def module_of(path: Column) -> Column:
    """The first directory; empty for a file at the root."""
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("")


def dir_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def short_name(node_id: Column) -> Column:
    return F.when(node_id.contains("::"), F.substring_index(node_id, "::", -1)).otherwise(F.substring_index(node_id, "/", -1))


def slug_name(node_id: Column) -> Column:
    """A node's name inside the name of a flow."""
    return F.when(node_id.contains("::"), F.translate(F.substring_index(node_id, "::", -1), ".", "_")).otherwise(F.translate(node_id, "/.", "__"))


def module_files(module: Column) -> Column:
    """The files that a dotted module may be: itself, then its package; leading dots are dropped."""
    bare = F.regexp_replace(module, r"^\.+", "")
    path = F.translate(bare, ".", "/")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(path, F.lit(".py")), F.concat(path, F.lit("/__init__.py"))))


def glob_regex(pattern: str, crosses: bool = True) -> str:
    """A shell glob as a regular expression, without anchors; crosses: whether * and ? take slashes."""
    one = "." if crosses else "[^/]"
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(one + "*")
        elif c == "?":
            out.append(one)
        elif end > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else "\\" + inner if inner[0] == "^" else inner) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def glob_matches(path: Column, pattern: str) -> Column:
    """Shell glob; * crosses slashes."""
    return path.rlike(f"^(?s:{glob_regex(pattern)})$")


def _component(pattern: str, only_dirs: bool) -> str:
    """Some component of the path matches; with only_dirs one that something follows."""
    return f"(^|/)(?s:{glob_regex(pattern, False)})" + ("/" if only_dirs else "(/|$)")


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last of the patterns that fits a path isn't a negation. A path with a slash at its end is a directory.

    dir/ means a directory of that name at any depth, a/b a path from the root, ** is *, which crosses slashes.
    """
    p = F.translate(path, "\\", "/")
    bare = F.regexp_replace(p, "/+$", "")
    out = None
    for raw in reversed(patterns):
        negated = raw.startswith("!")
        pattern = raw[1:] if negated else raw
        only_dirs = pattern.endswith("/")
        pattern = pattern.rstrip("/")
        pattern = re.sub(r"^(\*\*/)+", "", pattern)
        if not pattern:
            continue
        if "**" in pattern:
            fits = glob_matches(bare, pattern.replace("**", "*"))
        elif "/" in pattern:
            fits = glob_matches(bare, pattern)
            if only_dirs:
                fits = fits | glob_matches(bare, pattern + "/*")
        else:
            fits = p.rlike(_component(pattern, only_dirs))
        out = F.when(fits, F.lit(not negated)) if out is None else out.when(fits, F.lit(not negated))
    return F.lit(False) if out is None else out.otherwise(False)


# -- lines, literals, signatures

LINE_ENDS = r"\r\n|\r|\n"
COMMENT = r"^\s*(#|//|/\*|\*|--|;)"
STRING_COMMENT = r"^\s*(#|//|/\*|\*)"


def lines_of(content: Column) -> Column:
    return F.split(content, LINE_ENDS, -1)


def symbol_hash(content: Column, line_start: Column, line_end: Column) -> Column:
    """Eight hex digits of the MD5 of lines line_start .. line_end, counted from 1."""
    body = F.slice(lines_of(content), line_start, F.greatest(line_end - line_start + 1, F.lit(0)))
    return F.substring(F.md5(F.array_join(body, "\n")), 1, 8)


def literals(line: Column) -> Column:
    """The identifier-shaped texts of 3 to 64 characters in quotes on a line that is no comment."""
    found = F.regexp_extract_all(line, F.lit("[\"']([A-Za-z_]\\w{2,63})[\"']"), F.lit(1))
    return F.when(line.rlike(STRING_COMMENT), F.array().cast("array<string>")).otherwise(found)


def author(raw: Column) -> Column:
    """Name (@handle) where a forge's no-reply address hides a handle; a bare address without its brackets."""
    r = F.trim(raw)
    name = F.trim(F.regexp_extract(r, "^(.*)<[^<]*>$", 1))
    mail = F.trim(F.regexp_extract(r, "<([^<]*)>$", 1))
    handle = F.regexp_extract(mail, r"^(?:\d+\+)?(\p{Alnum}[\p{Alnum}._-]*)@" + r"users\.noreply\.github\.com$", 1)
    named = F.when(name == "", F.concat(F.lit("@"), handle)).otherwise(F.concat(name, F.lit(" (@"), handle, F.lit(")")))
    return F.when(~r.rlike("<[^<]*>$"), r).when(handle != "", named).when(name == "", mail).otherwise(r)


def return_type(signature: Column) -> Column:
    """What follows the last arrow of a signature, without a colon; empty without one."""
    return F.when(signature.contains("->"), F.trim(F.rtrim(F.substring_index(signature, "->", -1), F.lit(": ")))).otherwise("")


def is_async(signature: Column, tags: Column) -> Column:
    return F.array_contains(tags, "async") | F.lower(signature).startswith("async ")


def error_label(pattern: Column, exception: Column) -> Column:
    """pattern:exception, pattern, or none."""
    return F.when(F.coalesce(pattern, F.lit("")) == "", "none").when(F.coalesce(exception, F.lit("")) == "", pattern).otherwise(F.concat(pattern, F.lit(":"), exception))
