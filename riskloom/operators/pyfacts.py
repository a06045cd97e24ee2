"""Facts about one Python file that need its syntax tree: routes and data flows.

One Arrow function per file row parses the text once.  Spark decides which rows
reach it (see ``operators.detect``) and partitions the work; nothing here holds
more than one file.
"""

from __future__ import annotations

import ast
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions import fixed as K
from riskloom.functions.workers import by_value
from riskloom.model import PY_FACTS

# breaks that split a text into lines but not a Python program
_ODD_BREAKS = "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


def _dotted(node: ast.AST) -> str:
    """``a.b.c`` of a name, attribute chain or call; unknown roots are left out."""
    parts: list[str] = []
    while True:
        if isinstance(node, ast.Call):
            node = node.func
        elif isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        else:
            break
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def _sink(call: ast.Call) -> str | None:
    name = _dotted(call)
    last = name.rpartition(".")[2]
    if last in ("execute", "executemany") or (last == "raw" and "." in name):
        return "sql_injection"
    if name.startswith("subprocess.") or name in ("os.system", "os.popen", "eval", "exec"):
        return "command_injection"
    if name.startswith(("logger.", "logging.")) or name == "print":
        return "log_injection"
    return None


# fields that hold no call, function or name, and nodes without any below them
_BARE_FIELDS = {"ctx", "op", "ops", "id", "attr", "arg", "name", "names", "kind", "type_comment", "type_ignores", "module", "level", "simple", "is_async", "conversion"}
_LEAVES = (ast.Name, ast.Constant)
_fields: dict[type, tuple[str, ...]] = {}


def _fields_of(kind: type) -> tuple[str, ...]:
    if kind not in _fields:
        _fields[kind] = () if kind in _LEAVES else tuple(f for f in kind._fields if f not in _BARE_FIELDS)
    return _fields[kind]


def _children(node: ast.AST) -> list[ast.AST]:
    """Like ``ast.iter_child_nodes``, without nodes that hold no call, function or name."""
    out = []
    for field in _fields_of(node.__class__):
        value = getattr(node, field, None)
        if value.__class__ is list:
            out += [x for x in value if isinstance(x, ast.AST)]
        elif isinstance(value, ast.AST):
            out.append(value)
    return out


def _walk(node: ast.AST) -> list[ast.AST]:
    """The node and all below it, breadth first."""
    out = [node]
    for n in out:
        if n.__class__ not in _LEAVES:
            out += _children(n)
    return out


def _survey(tree: ast.AST) -> tuple[list[tuple[ast.AST, ast.AST | None]], list[ast.AST], list[str]]:
    """One walk over the tree: (call, innermost function) in source order, outer calls first; the
    functions breadth first; and the quoted texts."""
    calls, functions, quoted = [], [], []
    stack: list[tuple[ast.AST, ast.AST | None, int]] = [(tree, None, 0)]
    while stack:
        node, function, depth = stack.pop()
        kind = node.__class__
        if kind is ast.Constant:
            if node.value.__class__ is str:
                quoted.append(node.value)
            continue
        if kind in _FUNCTION:
            function = node
            functions.append((depth, len(functions), node))
        elif kind is ast.Call:
            calls.append((node, function))
        below = [(child, function, depth + 1) for child in _children(node) if child.__class__ is not ast.Name]
        below.reverse()
        stack += below
    # nodes of one depth come in source order, as breadth first
    return calls, [f[2] for f in sorted(functions, key=lambda f: f[:2])], quoted


def _handler_arguments(function: ast.AST | None) -> list[str]:
    """Argument names of a function that a route decorator registers, else none."""
    if function is None:
        return []
    if not any(_dotted(d).rpartition(".")[2] in K.HANDLER_DECORATORS for d in function.decorator_list):
        return []
    return [a.arg for a in [*function.args.args, *function.args.kwonlyargs]]


def _reads_request(node: ast.AST) -> bool:
    while isinstance(node, ast.Subscript):
        node = node.value
    if isinstance(node, ast.Call):
        return _dotted(node) in K.SOURCE_CALLS
    if not (isinstance(node, ast.Attribute) and node.attr in K.SOURCE_ATTRIBUTES):
        return False
    while isinstance(node, (ast.Attribute, ast.Subscript)):
        node = node.value
    return isinstance(node, ast.Name) and node.id in K.REQUEST_NAMES


def _flows(calls: list, text: str, lines: list[str], path: str) -> list[dict]:
    def quoted(line: int) -> str:
        return lines[line - 1].strip()[: K.QUOTE_CHARS] if 1 <= line <= len(lines) else ""

    def ref(kind: str, line: int, quote: str | None = None) -> dict:
        quote = quoted(line) if quote is None else quote[: K.QUOTE_CHARS]
        at = max(line, 1)
        return {"kind": kind, "file_path": path, "line_start": at, "line_end": at, "quote": quote}

    plain = not any(mark in text for mark in _ODD_BREAKS)

    def segment(node: ast.AST) -> str:
        """The node's own text, its line where that is not to be had."""
        if plain and node.lineno == node.end_lineno and node.lineno <= len(lines):
            return lines[node.lineno - 1].encode()[node.col_offset : node.end_col_offset].decode()
        return ast.get_source_segment(text, node) or quoted(node.lineno)

    flows = []
    known: dict[int, list[str]] = {}
    for call, function in calls:
        category = _sink(call)
        if category is None:
            continue
        if id(function) not in known:
            known[id(function)] = _handler_arguments(function)
        arguments = known[id(function)]
        sources, paths, sanitizers = [], [], []
        for arg in call.args:
            inner = _walk(arg)
            for node in inner:
                if sources:
                    pass  # only the first source is reported
                elif _reads_request(node):
                    sources.append(ref("source", node.lineno, segment(node)))
                elif isinstance(node, ast.Name) and node.id in arguments:
                    sources.append(ref("source", node.lineno))
                if isinstance(node, ast.Call):
                    name = _dotted(node)
                    if name in K.SANITIZER_CALLS or name.endswith(".replace"):
                        sanitizers.append(ref("sanitizer", node.lineno))
            steps = [n for n in inner if isinstance(n, (ast.JoinedStr, ast.BinOp, ast.Name))]
            paths += [ref("path", n.lineno) for n in steps[: K.PATH_REFS]]
        bound = len(call.args) >= 2 or any(k.arg in ("parameters", "params") for k in call.keywords)
        if category == "sql_injection" and bound:
            sanitizers.append(ref("sanitizer", call.lineno))
        if not sources:
            asked = [a for a in arguments if a not in ("self", "request")]
            used = {n.id for n in _walk(call) if isinstance(n, ast.Name)} if asked else ()
            if not any(a in used for a in asked):
                continue
            sources = [ref("source", function.lineno)]
        chain = [sources[0], *paths, ref("sink", call.lineno), *sanitizers]
        distinct = list({(r["line_start"], r["kind"], r["quote"]): r for r in chain}.values())
        flows.append(
            {
                "category": category,
                "line": call.lineno,
                "confidence": K.FLOW_CONFIDENCE_SANITIZED if sanitizers else K.FLOW_CONFIDENCE_CLEAN,
                "sanitized": bool(sanitizers),
                "refs": distinct,
            }
        )
    return flows


def _quotes_auth_word(node: ast.AST) -> bool:
    texts = (n.value for n in ast.walk(node) if isinstance(n, ast.Constant) and isinstance(n.value, str))
    return any(w in t for t in texts for w in K.AUTH_WORDS_PY)


def _routes(functions: list, quoted: list[str], text: str) -> list[dict]:
    routes = []
    # writing a function out again is slow; without one of the words there is no need
    named = any(w.rstrip("(") in text for w in K.AUTH_WORDS_PY)
    said = any(w in t for t in quoted for w in K.AUTH_WORDS_PY)
    signals = [w.lower() for w in K.AUTH_WORDS_PY]
    for node in functions:  # breadth first: the order in which routes are reported
        route = method = None
        guarded = False
        for decorator in node.decorator_list:
            source = ast.unparse(decorator).lower()
            guarded = guarded or any(s in source for s in signals)
            if not (isinstance(decorator, ast.Call) and any(m in source for m in K.AST_ROUTE_MARKERS)):
                continue
            texts = [a.value for a in decorator.args if isinstance(a, ast.Constant) and isinstance(a.value, str)]
            route = texts[-1] if texts else route
            if isinstance(decorator.func, ast.Attribute):
                method = decorator.func.attr.upper()
        if route is None:
            continue
        if not guarded and (named or (said and _quotes_auth_word(node))):
            body = ast.unparse(node)
            guarded = any(w in body for w in K.AUTH_WORDS_PY)
        routes.append(
            {"route": route, "method": method, "line": node.lineno, "guarded": guarded, "seq": len(routes)}
        )
    return routes


def file_facts(text: str, path: str, routes: bool = True, flows: bool = True) -> dict | None:
    """Facts of one file; ``parses`` is false on a syntax error, and a file that
    breaks the parser in any other way yields no facts at all."""
    try:
        tree = ast.parse(text)
    except SyntaxError:
        return {"parses": False, "routes": [], "flows": []}
    except (ValueError, RecursionError, MemoryError):
        return None
    try:
        calls, functions, quoted = _survey(tree)
        return {
            "parses": True,
            "routes": _routes(functions, quoted, text) if routes else [],
            "flows": _flows(calls, text, text.splitlines(), path) if flows else [],
        }
    except (RecursionError, MemoryError):
        return None


_REF_FIELDS = [("kind", pa.string()), ("file_path", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("quote", pa.string())]
_ROUTE_FIELDS = [("route", pa.string()), ("method", pa.string()), ("line", pa.int32()), ("guarded", pa.bool_()), ("seq", pa.int32())]
_FLOW_FIELDS = [("category", pa.string()), ("line", pa.int32()), ("confidence", pa.float64()), ("sanitized", pa.bool_())]


def _structs(rows: list[dict], fields: list[tuple[str, pa.DataType]], **more: pa.Array) -> pa.StructArray:
    columns = {name: pa.array([r[name] for r in rows], kind) for name, kind in fields} | more
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


def _lists(groups: list[list], values: pa.Array) -> pa.ListArray:
    """``values``, the members of all groups in a row, as one list for each group."""
    ends = np.cumsum([0, *map(len, groups)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _arrow_facts(rows: list[dict | None]) -> pa.StructArray:
    """Facts of files column by column, which is faster than row by row."""
    routes, flows = ([r[name] if r else [] for r in rows] for name in ("routes", "flows"))
    each = [f for group in flows for f in group]
    refs = [f["refs"] for f in each]
    made = _structs(each, _FLOW_FIELDS, refs=_lists(refs, _structs([x for group in refs for x in group], _REF_FIELDS)))
    columns = [pa.array([r["parses"] if r else None for r in rows], pa.bool_()), _lists(routes, _structs([x for g in routes for x in g], _ROUTE_FIELDS)), _lists(flows, made)]
    return pa.StructArray.from_arrays(columns, names=["parses", "routes", "flows"], mask=pa.array([r is None for r in rows], pa.bool_()))


def python_facts(text: Column, path: Column, wanted: Column, *, routes: bool = True, flows: bool = True) -> Column:
    """Facts of the rows where ``wanted`` holds; the others send no text to Python."""
    by_value(sys.modules[__name__], K)

    def facts(text: pa.Array, path: pa.Array) -> pa.Array:
        rows = [
            file_facts(t, p, routes, flows) if t is not None else None
            for t, p in zip(text.to_pylist(), path.to_pylist(), strict=True)
        ]
        return _arrow_facts(rows)

    return F.arrow_udf(facts, PY_FACTS)(F.when(wanted, text), path)


def _syntax(text: pa.Array) -> pa.Array:
    out = []
    for t in text.to_pylist():
        if t is None:
            out.append(None)
            continue
        try:
            ast.parse(t)
            out.append({"ok": True, "message": None})
        except SyntaxError as exc:
            out.append({"ok": False, "message": exc.msg})
        except (ValueError, RecursionError, MemoryError) as exc:
            out.append({"ok": False, "message": type(exc).__name__})
    return pa.array(out, type=pa.struct([("ok", pa.bool_()), ("message", pa.string())]))


def python_syntax(text: Column) -> Column:
    """``struct<ok, message>`` of a Python text; null for null."""
    by_value(sys.modules[__name__], K)
    return F.arrow_udf(_syntax, "struct<ok:boolean,message:string>")(text)
