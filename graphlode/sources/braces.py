"""The other languages' sources to nodes, calls and imports, by lines and braces: no grammar is at hand, so this finds
definitions, bases, imports, calls, what is done with a call's result and declared types of receivers by their look."""

from __future__ import annotations

import re
from typing import NamedTuple


class Dialect(NamedTuple):
    cls: re.Pattern  # groups: name, bases
    fn: re.Pattern  # group: name
    imports: re.Pattern  # first group that matched: module
    comment: str = "//"
    method: re.Pattern | None = None  # inside a class; fn if None
    joint: str = "."
    caught: str = ""  # keyword that begins a guarded block
    pattern: str = ""  # what such a block's calls are marked with


def _re(p: str) -> re.Pattern:
    return re.compile(p)


_NOT = r"(?!if\b|for\b|while\b|switch\b|catch\b|return\b|else\b|do\b|new\b|throw\b|using\b|lock\b|foreach\b|sizeof\b)"
_JS = Dialect(
    _re(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface|enum|type)\s+(\w+)(?:<[^>]*>)?(?:\s+(?:extends|implements)\s+([\w.,\s]+))?"),
    _re(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s*\*?\s*(\w+)\s*\(|(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?function)"),
    _re(r"""^\s*(?:import\b.*?from\s+|export\b.*?from\s+|import\s+|.*\brequire\()\s*["']([^"']+)["']"""),
    method=_re(rf"^\s*(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*{_NOT}(#?\w+)\s*(?:<[^>]*>)?\([^;]*\{{"), caught="try", pattern="try_catch",
)
DIALECTS: dict[str, Dialect] = {
    "javascript": _JS, "typescript": _JS, "tsx": _JS,
    "java": Dialect(_re(r"^\s*(?:[\w@]+\s+)*(?:class|interface|enum|record)\s+(\w+)(?:<[^>]*>)?(?:\([^)]*\))?(?:\s+(?:extends|implements)\s+([\w.,\s<>]+))?"), _re(r"(?!)()"), _re(r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;"),
                    method=_re(rf"^\s*(?:@\w+\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|default|native)\s+)*(?:<[^>]+>\s*)?(?:[\w.<>\[\],?]+\s+)?{_NOT}(\w+)\s*\([^;=]*\)\s*(?:throws\s+[\w.,\s]+)?\{{"), caught="try", pattern="try_catch"),
    "csharp": Dialect(_re(r"^\s*(?:[\w\[\]]+\s+)*(?:class|interface|struct|enum|record)\s+(\w+)(?:<[^>]*>)?(?:\s*:\s*([\w.,\s<>]+))?"), _re(r"(?!)()"), _re(r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"),
                      method=_re(rf"^\s*(?:(?:public|private|protected|internal|static|virtual|override|abstract|sealed|async|partial)\s+)+(?:[\w.<>\[\],?]+\s+)?{_NOT}(\w+)\s*(?:<[^>]*>)?\([^;]*"), caught="try", pattern="try_catch"),
    "go": Dialect(_re(r"^\s*type\s+(\w+)\s+(?:struct|interface)()"), _re(r"^func\s+(?:\(\s*\w*\s*\*?\w+(?:\[[^\]]*\])?\s*\)\s*)?(\w+)\s*[\[(]"), _re(r'^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"\s*$')),
    "rust": Dialect(_re(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union)\s+(\w+)()"), _re(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"C\"\s+)?fn\s+(\w+)"), _re(r"^\s*(?:pub\s+)?use\s+([\w:]+)")),
    "c": Dialect(_re(r"^\s*(?:typedef\s+)?(?:struct|enum|union)\s+(\w+)()\s*\{"), _re(rf"^(?:[\w*]+\s+)+\**{_NOT}(\w+)\s*\([^;]*$"), _re(r'^\s*#\s*include\s*[<"]([^>"]+)[>"]'), joint="::"),
    "cpp": Dialect(_re(r"^\s*(?:class|struct|enum(?:\s+class)?|union)\s+(\w+)(?:\s*final)?(?:\s*:\s*(?!:)([\w:,\s<>]+))?\s*\{?"), _re(rf"^(?:[\w:<>*&~]+\s+)*\**&?{_NOT}((?:\w+::)*~?\w+)\s*\([^;]*$"), _re(r'^\s*#\s*include\s*[<"]([^>"]+)[>"]'),
                   method=_re(rf"^\s*(?:[\w:<>*&]+\s+)*[*&]?{_NOT}(~?\w+)\s*\([^;]*\)[^;]*\{{"), joint="::", caught="try", pattern="try_catch"),
    "ruby": Dialect(_re(r"^\s*(?:class|module)\s+([\w:]+)(?:\s*<\s*([\w:]+))?"), _re(r"^\s*def\s+(?:self\.)?([\w?!=]+)"), _re(r"""^\s*require(?:_relative)?\s*\(?["']([^"']+)["']"""), comment="#", caught="begin", pattern="begin_rescue"),
}
_GO_RECEIVER = _re(r"^func\s+\(\s*\w*\s*\*?(\w+)")
_RUST_IMPL = _re(r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:([\w:]+)(?:<[^>]*>)?\s+for\s+)?(\w+)")
_CALL = _re(r"([A-Za-z_][\w.:>-]*?)!?\s*\(")
_WORDS = {"if", "for", "while", "switch", "catch", "return", "else", "function", "elif", "match", "fn", "func", "def", "new", "sizeof", "typeof", "super", "when", "unless", "until", "throw", "using", "lock", "foreach", "not", "and", "or"}
_BODIES = ("function", "method")
#: Declarations by language, as (name, type) groups: a type begins with a capital. Those of parameters too.
_T = r"([A-Z]\w*)(?:<[^<>]*(?:<[^<>]*>[^<>]*)*>)?"
_C_LIKE = [rf"\b(?:const\s+)?(?:\w+::)*{_T}(?:\[\])?\??(?:\s*[*&]+\s*|\s+)(?P<n>[a-z_]\w*)\s*(?=[=;,)({{]|$)", rf"\b(?:var|auto)\s*[*&]?\s*(?P<n>\w+)\s*=\s*new\s+(?:\w+::)*{_T}"]
_COLON = [rf"(?P<n>\w+)\??\s*:\s*(?:&\s*)?(?:mut\s+|dyn\s+)?(?:\w+::)*{_T}"]
_DECLARED: dict[str, list[re.Pattern]] = {
    language: [_re(p) for p in patterns]
    for languages, patterns in (
        ("javascript typescript tsx", [*_COLON, rf"(?P<n>\w+)\s*(?::[^=]+)?=\s*(?:await\s+)?new\s+{_T}"]),
        ("java csharp", _C_LIKE),
        ("c cpp", [*_C_LIKE, rf"\bauto\s*[*&]?\s*(?P<n>\w+)\s*=\s*(?:std::)?make_(?:unique|shared)<(?:\w+::)*{_T}"]),
        ("go", [rf"(?P<n>\w+)(?:\s*,\s*\w+)?\s*:?=\s*&?(?:\w+\.)?{_T}\{{", r"(?P<n>\w+)(?:\s*,\s*\w+)?\s*:?=\s*(?:\w+\.)?New([A-Z]\w*)\(", rf"(?:\bvar\s+|[(,]\s*)(?P<n>[a-z]\w*)\s+\*?(?:\w+\.)?{_T}(?=[\s,)=]|$)", rf"^\s+(?P<n>[a-z]\w*)\s+\*?(?:\w+\.)?{_T}\s*$"]),
        ("rust", [*_COLON, rf"let\s+(?:mut\s+)?(?P<n>\w+)\s*=\s*(?:\w+::)*{_T}\s*(?:::\w+\s*\(|\{{)"]),
        ("ruby", [rf"(?P<n>@?\w+)\s*=\s*(?:\w+::)*{_T}\.new\b"]),
    )
    for language in languages.split()
}
_TESTED = _re(r"(?:\}?\s*els(?:e\s+|))?(?:if|while|unless)\b\s*[(!]*")
_HANDLER = _re(r"\s*(?:\}\s*(?:catch|finally)|rescue|ensure)\b")
_CAUGHT = _re(r"\b(?:catch\s*\(\s*(?:final\s+|const\s+)?([A-Z][\w.:]*)|rescue\s+([A-Z][\w:]*))")


def _declared(line: str, language: str) -> dict[str, str]:
    """Name: type of what a line declares."""
    return {m.group("n"): next(g for g in m.groups() if g and g != m.group("n")) for p in _DECLARED.get(language, ()) for m in p.finditer(line) if m.group("n") not in _WORDS and any(g and g != m.group("n") for g in m.groups())}


def _receiver(callee: str, owner: str, local: dict[str, str], fields: dict[str, str]) -> str:
    """The type of what a call's last name is called on: the class itself, or as declared in the function or the class."""
    parts = re.split(r"\.|->|::", callee)[:-1]
    own = parts and parts[0] in ("this", "self", "$self")
    if own:
        parts = parts[1:]
        if not parts:
            return owner
    if len(parts) != 1:
        return ""
    known = fields if own else fields | local
    return known.get(parts[0]) or known.get("@" + parts[0], "")


_FACTORY = _re(r"^(create|build|make|New|Create|Make|Build)(?=[A-Z_]|$)")


def _tags(name: str, line: str, kind: str, path: str, language: str, bases: list[str]) -> list[str]:
    joined = language in ("javascript", "typescript", "tsx")
    tags = [f"extends:{','.join(bases)}"] if bases and joined else [f"extends:{b}" for b in bases]
    low = path.lower()
    tests = {"go": name.startswith(("Test", "Bench", "Example")), "rust": "test" in low, "c": "test" in name.lower(), "cpp": "test" in name.lower(), "ruby": name.startswith(("test_", "it_", "Test"))}
    if tests.get(language, name.startswith(("test", "Test")) or joined and ("test" in low or "spec" in low)):
        tags.append("test")
    if kind in ("function", "method"):
        if name.lower() == "main":
            tags.append("entrypoint")
        if re.match(r"^(on|handle|On|Handle)([A-Z_])", name):
            tags.append("callback")
        if _FACTORY.match(name):
            tags.append("factory")
        if re.search(r"\basync\b", line):
            tags.append("async")
    if re.search(r"\bexport\b", line) and joined:
        tags.append("export")
    if language == "go":
        tags.append("exported" if name[:1].isupper() else "private")
    elif language == "rust":
        tags.append("exported" if re.match(r"\s*pub", line) else "private")
    elif re.search(r"\bprivate\b", line) or name.startswith(("_", "#")):
        tags.append("private")
    tags += [t for t in ("abstract", "static", "virtual", "override") if re.search(rf"\b{t}\b", line)]
    return tags


def _bare(line: str, comment: str) -> str:
    """A line without its texts in quotes and its comment."""
    line = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`[^`]*`", '""', line)
    return line.split(comment, 1)[0]


def parse_braces(path: str, source: str, language: str) -> dict:
    """{nodes, calls, imports} of a file."""
    d = DIALECTS[language]
    lines = re.split(r"\r\n|\r|\n", source)
    count = max(1, len(lines) - (lines[-1] == ""))
    out = {"nodes": [{"id": path, "kind": "file", "name": path.rsplit("/", 1)[-1], "file_path": path, "line_start": 1, "line_end": count, "signature": "", "docstring": None, "tags": [], "parent_id": ""}], "calls": [], "imports": []}
    ruby = language == "ruby"
    stack: list[dict] = []  # what is open: node or None, depth at which it opened, kind, name
    depth, guard, in_block = 0, [], False
    local: dict[str, str] = {}  # types in the function that is open
    fields: dict[str, dict[str, str]] = {}  # types by class
    caught: list[dict] = []  # what the guarded block that ended last calls

    def top(kind: tuple[str, ...]) -> dict | None:
        return next((s for s in reversed(stack) if s["kind"] in kind), None)

    for number, raw in enumerate(lines, 1):
        if in_block or raw.lstrip().startswith("/*"):
            in_block = "*/" not in raw
            continue
        m = d.imports.match(raw)
        if m:
            out["imports"].append({"file_path": path, "module_path": m.group(1), "imported_names": [], "is_from_import": "from" in raw})
            continue
        line = _bare(raw, d.comment)
        if not line.strip():
            continue
        opened = None
        cls, fn = top(("class", "impl")), top(("function", "method"))
        impl = _RUST_IMPL.match(line) if language == "rust" else None
        c = d.cls.match(line) if not impl else None
        f = None if c or impl or (fn and not ruby) else ((d.method if cls and d.method else d.fn).match(line))
        if impl:
            opened = {"node": None, "kind": "impl", "name": impl.group(2), "id": f"{path}::{impl.group(2)}"}
            owner = next((x for x in out["nodes"] if x["id"] == opened["id"]), None)
            if owner and impl.group(1):
                owner["tags"].append(f"impl:{impl.group(1)}")
        elif c and c.group(1):
            bases = [re.sub(r"<.*", "", b).replace("public ", "").replace("private ", "").replace("virtual ", "").strip() for b in re.split(r",|\bimplements\b", c.group(2) or "")]
            bases = [b for b in bases if re.fullmatch(r"[\w.:]+", b)]
            name = f"{cls['name']}.{c.group(1)}" if cls and language in ("java", "ruby") else c.group(1)
            node = {"id": f"{path}::{name}", "kind": "class", "name": c.group(1), "file_path": path, "line_start": number, "line_end": number, "signature": raw.strip().rstrip("{").strip(), "docstring": None, "tags": _tags(c.group(1), line, "class", path, language, bases), "parent_id": cls["id"] if cls else path}
            opened = {"node": node, "kind": "class", "name": name, "id": node["id"]}
        elif f and any(f.groups()):
            name = next(g for g in f.groups() if g)
            owner = _GO_RECEIVER.match(line) if language == "go" else None
            parent = owner.group(1) if owner else name.rpartition("::")[0] if "::" in name else cls["name"] if cls else ""
            name = name.rpartition("::")[2]
            kind = "method" if parent else "function"
            node = {"id": f"{path}::{parent}{d.joint}{name}" if parent else f"{path}::{name}", "kind": kind, "name": name, "file_path": path, "line_start": number, "line_end": number, "signature": raw.strip().rstrip("{").strip(), "docstring": None, "tags": _tags(name, line, kind, path, language, []), "parent_id": f"{path}::{parent}" if parent else path}
            opened = {"node": node, "kind": kind, "name": name, "id": node["id"]}
        if opened and opened["node"]:
            out["nodes"].append(opened["node"])
        if _HANDLER.match(line) and guard and guard[-1][0] == depth - 1:
            caught = guard.pop()[1]
        exception = _CAUGHT.search(line)
        if exception:
            for error in caught:
                error["exception"] = error["exception"] or (exception.group(1) or exception.group(2)).rpartition(".")[2].rpartition("::")[2]
        if d.caught and re.search(rf"\b{d.caught}\b", line):
            guard.append((depth, []))
        body = fn if not (opened and opened["kind"] in ("function", "method")) else opened
        starts = bool(f and opened and opened["kind"] in _BODIES)
        if starts:
            local = {}
            if language == "go" and (me := re.match(r"^func\s+\(\s*(\w+)\s+\*?(\w+)", line)):
                local[me.group(1)] = me.group(2)
        own_class = body["node"]["parent_id"].rpartition("::")[2] if body and body["node"] and body["kind"] == "method" else cls["name"] if cls else ""
        if body:
            local |= _declared(line, language)
            for name, kind_of in _declared(line, "ruby").items() if ruby else ():
                fields.setdefault(own_class, {}).setdefault(name, kind_of)
        elif cls and not opened:
            fields.setdefault(cls["name"], {}).update(_declared(line, language))
        rest = line[f.end() :] if starts else "" if opened else line
        if body:
            for call in _CALL.finditer(rest):
                if call.group(1) not in _WORDS:
                    error = {"pattern": d.pattern, "exception": ""} if guard else None
                    if guard:
                        guard[-1][1].append(error)
                    before = rest[: call.start()].strip()
                    usage = "returned" if before.endswith("return") else "checked" if _TESTED.fullmatch(before) else "assigned" if before.endswith(("=", "(", ",")) else "checked" if re.match(r"(if|while)\b", before) else "awaited" if before.endswith("await") else "ignored"
                    out["calls"].append({"caller_id": body["id"], "callee": call.group(1), "line": number, "error_handling": error, "return_usage": usage, "receiver_type": _receiver(call.group(1), own_class, local, fields.get(own_class, {}))})
        if ruby:
            up = len(re.findall(r"^\s*(?:class|module|def|if|unless|while|until|case|begin|for)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$", line))
            down = len(re.findall(r"^\s*end\b", line))
        else:
            up, down = line.count("{"), line.count("}")
        if opened and (up or ";" not in line):
            opened["at"] = depth
            stack.append(opened)
        depth += up - down
        if down or (opened and up and up == down):
            while stack and depth <= stack[-1]["at"]:
                s = stack.pop()
                if s["node"]:
                    s["node"]["line_end"] = number
            while guard and depth <= guard[-1][0]:
                caught = guard.pop()[1]
    for s in stack:
        if s["node"]:
            s["node"]["line_end"] = count
    return out
