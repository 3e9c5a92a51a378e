"""Python sources to nodes, calls and imports, by the standard library's syntax tree."""

from __future__ import annotations

import ast

ROUTE_WORDS = ("api_view", "delete", "get", "patch", "post", "put", "route")
VALIDATOR_WORDS = ("computed_field", "serializer", "validate", "validator")
HOOK_WORDS = ("after_request", "before_request", "event_handler", "hookimpl", "hookspec", "lifespan", "listener", "middleware", "on_event", "receiver", "shutdown", "signal", "startup")
MODEL_BASES = {"BaseModel", "Model", "NamedTuple", "Schema", "TypedDict"}
FACTORIES, SERIALIZERS = tuple("build_ create_ get_or_create_ make_".split()), tuple("deserialize format_ from_ parse_ serialize to_".split())


def _dunder(name: str) -> bool:
    return name[:2] == name[-2:] == "__"


def _simple(base: str) -> str:
    return base.partition("[")[0].rpartition(".")[2]


def _decorator_names(decorators: list[str]) -> list[str]:
    return [f"decorator:{d.split('(', 1)[0].strip()}" for d in decorators]


def class_tags(name: str, decorators: list[str], bases: list[str]) -> list[str]:
    tags = _decorator_names(decorators)
    if bases:
        tags.append("extends:" + ",".join(bases))
    if any(_simple(b) in MODEL_BASES for b in bases) or any("dataclass" in d for d in decorators):
        tags.append("data_model")
    tags += ["test"] * name.startswith("Test") + (["dunder"] if _dunder(name) else ["private"] * name.startswith("_"))
    if any(_simple(b) in ("ABC", "ABCMeta") for b in bases):
        tags.append("abstract")
    return tags


def function_tags(name: str, decorators: list[str], is_async: bool) -> list[str]:
    tags = _decorator_names(decorators)
    bare = name.lstrip("_")
    by_name = {
        "async": is_async, "entrypoint": name in ("main", "__main__"), "test": name.startswith(("test_", "Test")), "callback": bare.startswith(("on_", "handle_")),
        "factory": name.startswith(FACTORIES), "serializer": name.startswith(SERIALIZERS), "dunder": _dunder(name), "private": name.startswith("_") and not _dunder(name),
    }
    tags += [t for t, fits in by_name.items() if fits]
    for d in decorators:
        low, last = d.lower(), d.rsplit(".", 1)[-1]
        fits = {
            "route_handler": any(w in low for w in ROUTE_WORDS), "property": d == "property" or last in ("setter", "deleter") and "." in d or d in ("cached_property", "functools.cached_property"),
            "static": d == "staticmethod", "classmethod": d == "classmethod", "abstract": last == "abstractmethod", "validator": any(w in low for w in VALIDATOR_WORDS),
            **{t: d == t or last == t and d.partition(".")[0] in ("typing", "typing_extensions") for t in ("overload", "override")}, "hook": any(w in low for w in HOOK_WORDS),
        }
        tags += [t for t, yes in fits.items() if yes and t not in tags]
    return tags


def _type_name(annotation: ast.expr | None) -> str:
    """The class that an annotation names; Optional and | None are unwrapped."""
    if isinstance(annotation, ast.Constant) and isinstance(annotation.value, str):
        try:
            return _type_name(ast.parse(annotation.value, mode="eval").body)
        except SyntaxError:
            return ""
    if isinstance(annotation, ast.BinOp) and isinstance(annotation.op, ast.BitOr):
        sides = [x for x in (annotation.left, annotation.right) if not (isinstance(x, ast.Constant) and x.value is None)]
        return _type_name(sides[0]) if len(sides) == 1 else ""
    if isinstance(annotation, ast.Subscript):
        return _type_name(annotation.slice) if _simple(ast.unparse(annotation.value)) == "Optional" else ""
    return _simple(ast.unparse(annotation)) if isinstance(annotation, ast.Name | ast.Attribute) else ""


def _made_type(value: ast.expr | None) -> str:
    """The class of x in x = Class(...)."""
    if isinstance(value, ast.Call) and isinstance(value.func, ast.Name | ast.Attribute):
        name = _simple(ast.unparse(value.func))
        return name if name[:1].isupper() else ""
    return ""


def _inside(body: list[ast.stmt]):
    """All nodes of a body but those of inner definitions."""
    todo = list(body)
    while todo:
        n = todo.pop(0)
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            continue
        yield n
        todo += list(ast.iter_child_nodes(n))


def _local_types(fn: ast.FunctionDef | ast.AsyncFunctionDef) -> dict[str, str]:
    known = {a.arg: _type_name(a.annotation) for a in (*fn.args.posonlyargs, *fn.args.args, *fn.args.kwonlyargs) if a.annotation}
    for n in _inside(fn.body):
        if isinstance(n, ast.AnnAssign):
            known[ast.unparse(n.target)] = _type_name(n.annotation) or _made_type(n.value)
        elif isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name | ast.Attribute) and _made_type(n.value):
            known[ast.unparse(n.targets[0])] = _made_type(n.value)
    return {k: v for k, v in known.items() if v}


_USAGE = [
    ((ast.Assign, ast.AnnAssign, ast.AugAssign, ast.NamedExpr), "assigned"), ((ast.Return, ast.Yield, ast.YieldFrom), "returned"), ((ast.If, ast.While, ast.BoolOp, ast.Compare, ast.IfExp, ast.Assert), "checked"),
    ((ast.Expr,), "ignored"), ((ast.Call, ast.keyword, ast.Starred, ast.List, ast.Tuple, ast.Dict, ast.Set, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp, ast.Subscript, ast.Attribute), "assigned"),
]


def _usage(parents: list[ast.AST]) -> str:
    parent = parents[-1] if parents else None
    if isinstance(parent, ast.Await):
        return "awaited_ignored" if len(parents) > 1 and isinstance(parents[-2], ast.Expr) else "awaited"
    if isinstance(parent, ast.UnaryOp):
        return "checked" if isinstance(parent.op, ast.Not) else "ignored"
    return next((u for kinds, u in _USAGE if isinstance(parent, kinds)), "ignored")


class _Calls:
    """The calls of one function's body."""

    def __init__(self, caller: str, types: dict[str, str]):
        self.caller, self.types, self.found = caller, types, []

    def walk(self, n: ast.AST, error: dict | None, parents: list[ast.AST]) -> None:
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            return
        if isinstance(n, ast.Try | ast.TryStar):
            named = [x for h in n.handlers for x in ([h.type] if not isinstance(h.type, ast.Tuple) else h.type.elts) if isinstance(x, ast.Name)]
            inner = {"exception": ",".join(x.id for x in named) or "BaseException", "pattern": "try_except"}
            for s in n.body:
                self.walk(s, inner, [])
            for s in [x for h in n.handlers for x in h.body] + n.orelse + n.finalbody:
                self.walk(s, None, [])
            return
        if isinstance(n, ast.Call):
            callee = ast.unparse(n.func)
            receiver, kind = callee.rpartition(".")[0], ""
            while receiver and not (kind := self.types.get(receiver, "")):
                receiver = receiver.rpartition(".")[0]
            self.found.append({"caller_id": self.caller, "callee": callee, "line": n.lineno, "error_handling": error, "return_usage": _usage(parents), "receiver_type": kind})
            for x in (*n.args, *n.keywords):
                self.walk(x, error, [*parents, n])
            return
        for x in ast.iter_child_nodes(n):
            self.walk(x, error, [*parents, n])


def parse_python(path: str, source: str) -> dict:
    """{nodes, calls, imports} of a file. One that can't be parsed has its file node only."""
    lines = max(1, source.count("\n") + (0 if source.endswith("\n") or not source else 1))
    file_node = {"id": path, "kind": "file", "name": path.rsplit("/", 1)[-1], "file_path": path, "line_start": 1, "line_end": lines, "signature": "", "docstring": None, "tags": [], "parent_id": ""}
    out = {"nodes": [file_node], "calls": [], "imports": []}
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return out
    file_node["docstring"] = ast.get_docstring(tree)

    def add(n, kind: str, node_id: str, parent: str, signature: str, tags: list[str]) -> None:
        first = min([n.lineno, *(d.lineno for d in n.decorator_list)])
        out["nodes"].append({"id": node_id, "kind": kind, "name": n.name, "file_path": path, "line_start": first, "line_end": n.end_lineno, "signature": signature, "docstring": ast.get_docstring(n), "tags": tags, "parent_id": parent})

    def function(n, parent: str, cls: str | None, self_types: dict[str, str]) -> None:
        node_id = f"{path}::{cls}.{n.name}" if cls else f"{path}::{n.name}"
        returns = f" -> {ast.unparse(n.returns)}" if n.returns else ""
        decorators = [ast.unparse(d) for d in n.decorator_list]
        add(n, "method" if cls else "function", node_id, parent, f"{n.name}({ast.unparse(n.args)}){returns}", function_tags(n.name, decorators, isinstance(n, ast.AsyncFunctionDef)))
        calls = _Calls(node_id, {**self_types, **_local_types(n)})
        for s in n.body:
            calls.walk(s, None, [])
        out["calls"] += calls.found

    def klass(n: ast.ClassDef, parent: str) -> None:
        bases = [ast.unparse(b) for b in n.bases if isinstance(b, ast.Name | ast.Attribute | ast.Subscript)]
        node_id = f"{path}::{n.name}"
        add(n, "class", node_id, parent, f"class {n.name}({', '.join(bases)})" if bases else f"class {n.name}", class_tags(n.name, [ast.unparse(d) for d in n.decorator_list], bases))
        methods = [m for m in n.body if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef)]
        self_types = {k: v for m in methods for k, v in _local_types(m).items() if k.startswith("self.")}
        for m in n.body:
            if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef):
                function(m, node_id, n.name, self_types)
            elif isinstance(m, ast.ClassDef):
                klass(m, node_id)

    exported: set[str] = set()
    for n in tree.body:
        if isinstance(n, ast.ClassDef):
            klass(n, path)
        elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            function(n, path, None, {})
        elif isinstance(n, ast.Import):
            out["imports"] += [{"file_path": path, "module_path": a.name, "imported_names": [], "is_from_import": False} for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            out["imports"].append({"file_path": path, "module_path": "." * n.level + (n.module or ""), "imported_names": [a.name for a in n.names], "is_from_import": True})
        elif isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets) and isinstance(n.value, ast.List):
            exported |= {e.value for e in n.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)}
    for x in out["nodes"]:
        if x["name"] in exported:
            x["tags"].append("exported")
    return out
