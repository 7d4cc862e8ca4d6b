"""Python texts by the interpreter's own syntax tree: symbols with metrics, references, and markers."""

from __future__ import annotations

import ast
import warnings

import xxhash

# Names by which calls are told apart.
IO_CALLS = frozenset("read readline readlines write writelines execute fetchone fetchall fetchmany urlopen urlretrieve".split())
BLOCKING = frozenset("time.sleep requests.get requests.post requests.put requests.delete requests.head requests.request subprocess.run subprocess.call subprocess.check_output os.system open".split())
COMBINATORS = frozenset(("gather", "as_completed"))
CONSTRUCTORS = frozenset("Session ThreadPoolExecutor ProcessPoolExecutor Pool".split())
FRAME_CONCATS = frozenset(("pd.concat", "pandas.concat"))
JSON_PARSES = frozenset(("json.loads", "json.load"))
PRIMITIVES = frozenset("int float str bool bytes complex".split())
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
LOOPS = (ast.For, ast.While, ast.AsyncFor)
DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.match_case)
BLOCKS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)


def dotted(node) -> str:
    """`a.b.c` of a name or attribute chain; what is called or indexed on the way is left out."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        left = dotted(node.value)
        return f"{left}.{node.attr}" if left else node.attr
    return ""


def own_nodes(func):
    """The nodes of a function's body without those of functions and classes inside it."""
    todo = list(func.body)
    while todo:
        n = todo.pop()
        yield n
        if not isinstance(n, (*FUNCTIONS, ast.ClassDef, ast.Lambda)):
            todo += ast.iter_child_nodes(n)


def complexity(func) -> int:
    return 1 + sum(isinstance(n, DECISIONS) for n in own_nodes(func)) + sum(len(n.values) - 1 for n in own_nodes(func) if isinstance(n, ast.BoolOp))


def _is_elif(parent, child) -> bool:
    return isinstance(parent, ast.If) and isinstance(child, ast.If) and parent.orelse == [child]


def nesting(func) -> int:
    """How deep blocks stand in each other; an elif stands beside its if."""

    def depth(node, d):
        best = d
        for c in ast.iter_child_nodes(node):
            if isinstance(c, (*FUNCTIONS, ast.ClassDef, ast.Lambda)):
                continue
            best = max(best, depth(c, d + (isinstance(c, BLOCKS) and not _is_elif(node, c))))
        return best

    return depth(func, 0)


def bumps(func) -> int:
    """Top-level blocks of the body that hold blocks in blocks."""

    def depth(node):
        kids = [depth(c) for c in ast.iter_child_nodes(node) if not isinstance(c, (*FUNCTIONS, ast.ClassDef, ast.Lambda))]
        return max(kids, default=0) + isinstance(node, BLOCKS)

    return sum(isinstance(n, BLOCKS) and depth(n) >= 2 for n in func.body)


def parameters(func) -> list[ast.arg]:
    a = func.args
    return [x for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *([a.vararg] if a.vararg else []), *([a.kwarg] if a.kwarg else [])] if x.arg not in ("self", "cls")]


def in_loops(func):
    """(node, loops about it, innermost loop first) of the function's own nodes. A loop's iterable and condition stand outside of it, but for a while's."""

    def walk(node, loops):
        for name, value in ast.iter_fields(node):
            for c in value if isinstance(value, list) else [value]:
                if not isinstance(c, ast.AST) or isinstance(c, (*FUNCTIONS, ast.ClassDef, ast.Lambda)):
                    continue
                inner = [node, *loops] if isinstance(node, LOOPS) and (name == "body" or isinstance(node, ast.While) and name == "test") else loops
                yield c, inner
                yield from walk(c, inner)

    yield from walk(func, [])


def _target(call) -> str:
    return dotted(call.func).rpartition(".")[2] or (call.func.attr if isinstance(call.func, ast.Attribute) else "")


def _string_growth(n):
    if isinstance(n, ast.AugAssign) and isinstance(n.op, ast.Add) and isinstance(n.target, ast.Name):
        return n.target.id
    if isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name) and isinstance(n.value, ast.BinOp) and isinstance(n.value.op, ast.Add):
        x = n.targets[0].id
        if any(isinstance(s, ast.Name) and s.id == x for s in (n.value.left, n.value.right)):
            return x
    return None


def _lists(func) -> set[str]:
    """Names that the function binds to lists and to nothing else."""
    yes, no = set(), set()
    for n in own_nodes(func):
        if isinstance(n, ast.Assign):
            is_list = isinstance(n.value, (ast.List, ast.ListComp)) or isinstance(n.value, ast.Call) and dotted(n.value.func) in ("list", "sorted")
            for t in n.targets:
                if isinstance(t, ast.Name):
                    (yes if is_list else no).add(t.id)
        elif isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name):
            (yes if dotted(getattr(n.annotation, "value", n.annotation)) in ("list", "List") else no).add(n.target.id)
    return yes - no


def cartesian_tables(sql: str) -> list[str]:
    """Tables that a query joins by commas with fewer equalities of qualified columns than it takes to link them; else none."""
    import re

    m = re.search(r"(?is)\bfrom\s+(.*?)(?:\bwhere\b|\bgroup\b|\border\b|\bhaving\b|\blimit\b|\bunion\b|;|$)(.*)", sql)
    if not m or not re.match(r"(?is)\s*select\b", sql) or re.search(r"(?i)\bjoin\b", m[1]):
        return []
    tables = [t.strip().split()[0] for t in m[1].split(",") if t.strip() and "(" not in t]
    where = re.search(r"(?is)\bwhere\b(.*)", sql)
    links = len(re.findall(r"\b\w+\.\w+\s*=\s*\w+\.\w+", where[1])) if where else 0
    return tables if len(tables) >= 2 and links < len(tables) - 1 else []


def markers(func) -> list[tuple[str, int, str]]:
    """(kind, line, name) of what the function does in loops, under locks and in asynchronous code."""
    out = []
    lists = _lists(func)
    is_async = isinstance(func, ast.AsyncFunctionDef)
    awaited = {id(n.value) for n in own_nodes(func) if isinstance(n, ast.Await)}
    for n, loops in in_loops(func):
        line = getattr(n, "lineno", 0)
        if isinstance(n, ast.BoolOp):
            ops = sum(len(b.values) - 1 for b in ast.walk(n) if isinstance(b, ast.BoolOp))
            if ops >= 3 and not any(n in list(ast.walk(p))[1:] for p, _ in in_loops(func) if isinstance(p, ast.BoolOp) and p is not n):
                out.append(("complex-conditional", line, str(ops)))
        if isinstance(n, ast.Call):
            full, last = dotted(n.func), _target(n)
            if last in IO_CALLS or full == "open":
                out.append(("sync-io", line, last))
            if loops:
                if last in IO_CALLS:
                    out.append(("io-in-loop", line, last))
                    if len(loops) >= 2:
                        out.append(("nested-loop-with-io", line, last))
                if last in CONSTRUCTORS:
                    out.append(("resource-construction-in-loop", line, last))
                if last == "acquire":
                    out.append(("lock-in-loop", line, dotted(n.func)))
                if last == "insert" and len(n.args) == 2 and isinstance(n.args[0], ast.Constant) and n.args[0].value == 0 and isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Name):
                    out.append(("list-insert-zero-in-loop", line, n.func.value.id))
                if full in JSON_PARSES:
                    out.append(("json-parse-in-loop", line, full))
                if full == "re.compile":
                    out.append(("regex-compile-in-loop", line, full))
                if full in FRAME_CONCATS:
                    out.append(("pd-concat-in-loop", line, full))
            if is_async and full in BLOCKING and id(n) not in awaited:
                out.append(("blocking-sync-in-async", line, full))
        elif loops and (x := _string_growth(n)):
            out.append(("string-concat-in-loop", line, x))
        elif loops and isinstance(n, ast.Await):
            if not (isinstance(n.value, ast.Call) and _target(n.value) in COMBINATORS):
                out.append(("serial-await-in-loop", line, _target(n.value) if isinstance(n.value, ast.Call) else ""))
        elif isinstance(n, (ast.For, ast.AsyncFor)) and loops:
            same = [p for p in loops if isinstance(p, (ast.For, ast.AsyncFor)) and ast.dump(p.iter) == ast.dump(n.iter)]
            if same:
                out.append(("nested-loop-quadratic", line, dotted(n.iter)))
        elif isinstance(n, (ast.With, ast.AsyncWith)):
            names = [dotted(i.context_expr.func if isinstance(i.context_expr, ast.Call) else i.context_expr) for i in n.items]
            if any(w in x.lower() for x in names for w in ("lock", "mutex")):
                for c in (c for b in n.body for c in ast.walk(b) if isinstance(c, ast.Call)):
                    if _target(c) in IO_CALLS:
                        out.append(("blocking-io-under-lock", c.lineno, _target(c)))
        if isinstance(n, ast.Compare) and loops and any(isinstance(o, (ast.In, ast.NotIn)) for o in n.ops):
            for o, c in zip(n.ops, n.comparators, strict=True):
                if isinstance(o, (ast.In, ast.NotIn)) and (isinstance(c, ast.Name) and c.id in lists):
                    out.append(("membership-test-in-loop", line, c.id))
        if isinstance(n, ast.Constant) and isinstance(n.value, str) and "from" in n.value.lower():
            if t := cartesian_tables(n.value):
                out.append(("sql-cartesian-join", line, ",".join(t)))
    return out


def body_hash(text_lines: list[str], start: int, end: int) -> int | None:
    """A hash of the body, white space aside; None for bodies of fewer than four lines."""
    if end - start + 1 < 4:
        return None
    return xxhash.xxh64_intdigest(" ".join(" ".join(text_lines[start:end]).split())) - (1 << 63)


def extract(file: str, text: str) -> dict[str, list[tuple]] | None:
    """Rows of symbols, imports, calls, field accesses and markers; None for text that does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines = text.split("\n")
    out: dict[str, list[tuple]] = {"symbols": [], "imports": [], "calls": [], "field_accesses": [], "markers": []}
    order = 0

    def symbol(node, kind, parent):
        nonlocal order
        sid = f"{file}::{node.name}@{node.lineno}"
        m = (None,) * 6
        if kind != "Class":
            params = parameters(node)
            prim = sum(p.annotation is not None and dotted(p.annotation) in PRIMITIVES for p in params)
            m = (complexity(node), nesting(node), bumps(node), len(params), prim, body_hash(lines, node.lineno, node.end_lineno))
        out["symbols"].append((sid, file, order, node.name, kind, node.lineno, node.end_lineno, parent, *m))
        order += 1
        return sid

    def walk(nodes, parent, caller):
        for n in nodes:
            if isinstance(n, ast.ClassDef):
                sid = symbol(n, "Class", parent)
                walk(n.body, sid, caller)
                continue
            if isinstance(n, FUNCTIONS):
                sid = symbol(n, "Method" if parent and "::" in parent else "Function", parent)
                out["markers"] += [(sid, k, ln, name) for k, ln, name in markers(n)]
                walk(n.body, None, sid)
                for d in n.decorator_list:
                    walk([d], None, caller)
                continue
            if isinstance(n, ast.Import):
                out["imports"] += [(file, a.name, n.lineno, None) for a in n.names]
            elif isinstance(n, ast.ImportFrom):
                out["imports"].append((file, "." * n.level + (n.module or ""), n.lineno, None))
            elif isinstance(n, ast.Call) and (name := _target(n)):
                out["calls"].append((file, caller, name, n.lineno))
            elif isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "self" and caller:
                out["field_accesses"].append((file, caller, n.attr, n.lineno))
            walk(list(ast.iter_child_nodes(n)), parent if isinstance(n, (ast.If, ast.Try, ast.With)) else None, caller)

    walk(tree.body, None, None)
    return out
