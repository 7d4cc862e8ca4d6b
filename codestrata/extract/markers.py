"""Markers of Rust, JavaScript and TypeScript functions by their lexical form: what they do in loops, under locks and in asynchronous code.

A body comes with its comments and literals blanked and its places kept, so that brackets nest truly. Loops and inner
functions are spans of it; a call's loops are those of its own function that hold it. What inner functions do is not
the outer function's.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

from codestrata.extract.python import cartesian_tables


@dataclass(frozen=True)
class Rules:
    """What a language calls what. The names by which calls are told apart."""

    io: frozenset
    blocking: frozenset = frozenset()
    combinators: frozenset = frozenset()
    constructors: frozenset = frozenset()
    locks: frozenset = frozenset()
    json: frozenset = frozenset()
    regexes: frozenset = frozenset()
    loop: re.Pattern = field(default=None)
    inner: re.Pattern = field(default=None)


def _names(s: str) -> frozenset:
    return frozenset(s.split())


RUST = Rules(
    io=_names("read_to_string read_to_end read_line read_exact write_all execute query query_row fetch_one fetch_all recv"),
    blocking=_names("thread::sleep fs::read_to_string fs::read fs::write fs::copy fs::remove_file fs::create_dir_all"), combinators=_names("join_all try_join_all join try_join select_all"),
    constructors=_names("HttpClient::new Client::new ThreadPool::new ConnectionPool::new Pool::new"), locks=_names("lock try_lock"), json=_names("serde_json::from_str serde_json::from_slice"), regexes=_names("Regex::new"),
    loop=re.compile(r"\b(?:for\b(?!\s*<)[^{};]*?\bin\b(?P<over>[^{;]*)|while\b[^{;]*|loop\s*)\{"), inner=re.compile(r"\bfn\s+\w+[^{;]*\{|\|[^|{};\n]*\|\s*(?:->\s*[\w<>:]+\s*)?\{"),
)
SCRIPT = Rules(
    io=_names("readFile readFileSync writeFile writeFileSync fetch query execute"), combinators=_names("Promise.all Promise.allSettled Promise.race Promise.any"), constructors=_names("ThreadPool Pool HttpClient Client"),
    locks=_names("acquire"), json=_names("JSON.parse"), regexes=_names("RegExp"), loop=re.compile(r"\b(?:for\s*(?:await\s*)?|while\s*)\(|\bdo\s*\{"), inner=re.compile(r"=>\s*\{|\bfunction\b[^({]*\("),
)
RULES = {"Rust": RUST, "JavaScript": SCRIPT, "TypeScript": SCRIPT}

_CALL = re.compile(r"((?:[A-Za-z_$][\w$]*(?:::<[^<>()]*>)?\s*(?:::|\?*\.)\s*)*)([A-Za-z_$][\w$]*)(?:::<[^<>()]*>)?\s*\(")
_NO_CALL = _names("if for while match switch return fn function catch in of await new typeof loop move")
_GROWTH = re.compile(r"(?<![\w$.\])])([A-Za-z_$][\w$]*)\s*(?:\+=(?!=)|=(?![=>])\s*(?:\1\s*\+(?![+=])|[^;{}=\n]*[^+;{}=\n]\+\s*\1\s*[;\n)]))|(?<![\w.])(\w+)\.push_str\s*\(")
_CONDITION = {"Rust": re.compile(r"\b(?:if|while)\b([^{;]*)\{"), "script": re.compile(r"\b(?:if|while)\s*(\()")}
_RUST_LIST = re.compile(r"\blet\s+(?:mut\s+)?(\w+)\s*(?::\s*&?\s*(?:mut\s+)?(?:Vec|VecDeque)\b|=\s*(?:vec!|(?:Vec|VecDeque)\s*::))|[(,]\s*(?:mut\s+)?(\w+)\s*:\s*&?\s*(?:mut\s+)?(?:(?:Vec|VecDeque)\s*<|\[)")
_RUST_OTHER = re.compile(r"\blet\s+(?:mut\s+)?(\w+)\s*(?::\s*&?\s*(?:mut\s+)?(?:HashSet|BTreeSet|HashMap|BTreeMap)\b|=\s*(?:HashSet|BTreeSet|HashMap|BTreeMap)\s*::)")
_SCRIPT_LIST = re.compile(r"\b(?:const|let|var)\s+([\w$]+)\s*(?::[^=;]*)?=\s*(?:\[|[\w$.]+\.(?:map|filter|split|concat|slice|flat)\s*\()")
_SCRIPT_OTHER = re.compile(r"\b(?:const|let|var)\s+([\w$]+)\s*(?::[^=;]*)?=\s*new\s+(?:Set|Map)\b")
_SPREAD = re.compile(r"\.\s*(?:reduce|reduceRight)\s*\(\s*(?:async\s*)?(?:function\b[^(]*)?\(?\s*([A-Za-z_$][\w$]*)\b")
_AWAIT = {"Rust": re.compile(r"\.\s*await\b"), "script": re.compile(r"(?<![\w$.])await\b(?!\s*\()")}
_GUARD = re.compile(r"\blet\s+(?:mut\s+)?\w+\s*=[^;{}]*\.\s*(?:lock|try_lock)\s*\(\s*\)[^;{}]*;")


def closing(code: str, at: int) -> int:
    """The place behind the bracket that closes the one at `at`; the end of the code if none does."""
    pairs = {"(": ")", "[": "]", "{": "}"}
    stack = []
    for m in re.compile(r"[()\[\]{}]").finditer(code, at):
        c = m[0]
        if c in pairs:
            stack.append(pairs[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return m.end()
    return len(code)


def _loops(rules: Rules, body: str, script: bool) -> list[tuple[int, int, int, str]]:
    """Start of the keyword, span of the body and what is looped over, of each loop."""
    out = []
    for m in rules.loop.finditer(body):
        over = ""
        if not script:
            a = m.end() - 1
            b = closing(body, a)
            over = (m["over"] or "").strip()
        elif m[0][-1] == "(":
            head = closing(body, m.end() - 1)
            inside = body[m.end() : head - 1]
            of = re.search(r"\b(?:of|in)\b(.*)$", inside, re.S)
            over = of[1].strip() if of and ";" not in inside else ""
            a = head
            block = re.compile(r"\s*\{").match(body, head)
            if block:
                b = closing(body, block.end() - 1)
            elif body[head : head + 1] == ";" or m[0].startswith("while") and re.search(r"\}\s*$", body[: m.start()]) and re.match(r"\s*;", body[head:]):
                continue  # the end of a do loop, or a loop without a body
            else:
                end = re.compile(r";|\n\s*\n|\}").search(body, head)
                b = end.start() if end else len(body)
        else:
            a = m.end() - 1
            b = closing(body, a)
        over = re.sub(r"^&\s*(?:mut\s+)?|\.(?:iter|iter_mut|into_iter)\s*\(\s*\)|\s+", "", over)
        out.append((m.start(), a, b, over))
    return out


def _inner(rules: Rules, body: str) -> list[tuple[int, int]]:
    """Spans of the functions within the body, without those in others."""
    out: list[tuple[int, int]] = []
    for m in rules.inner.finditer(body):
        if out and m.start() < out[-1][1]:
            continue
        if m[0][-1] == "(":
            block = body.find("{", closing(body, m.end() - 1))
            if block < 0:
                continue
            out.append((m.start(), closing(body, block)))
        else:
            out.append((m.start(), closing(body, m.end() - 1)))
    return out


def _callee_before(body: str, at: int) -> str:
    """The name of the call that ends before `at`, as in `f(x).await`; "" if none does."""
    left = body[:at].rstrip()
    if not left.endswith(")"):
        return ""
    depth = 0
    for k in range(len(left) - 1, -1, -1):
        depth += (left[k] == ")") - (left[k] == "(")
        if not depth:
            m = re.search(r"([A-Za-z_]\w*)!?\s*$", left[:k])
            return m[1] if m else ""
    return ""


def markers(language: str, head: str, body: str, literals: list[tuple[int, str]]) -> list[tuple[str, int, str]]:
    """(kind, place in the body, name) of what a function does.

    head: its code before the body; body: from the opening brace to the closing one, blanked; literals: the texts of
    its strings and their places.
    """
    rules = RULES[language]
    script = rules is SCRIPT
    loops, inner = _loops(rules, body, script), _inner(rules, body)
    starts = [a for a, _ in inner]

    def own(at: int) -> bool:
        k = bisect_right(starts, at) - 1
        return k < 0 or at >= inner[k][1]

    depth = lambda at: sum(a <= at < b for _, a, b, _ in loops)
    out: list[tuple[str, int, str]] = []
    is_list, other = (_SCRIPT_LIST, _SCRIPT_OTHER) if script else (_RUST_LIST, _RUST_OTHER)
    lists = {x for m in is_list.finditer(head + body) for x in m.groups() if x} - {m[1] for m in other.finditer(head + body)}
    is_async = bool(re.search(r"\basync\b", head))
    for m in _CONDITION["script" if script else "Rust"].finditer(body):
        text = body[m.start(1) : closing(body, m.start(1))] if script else m[1]
        ops = len(re.findall(r"&&|\|\|", text))
        if ops >= 3 and own(m.start()):
            out.append(("complex-conditional", m.start(), str(ops)))
    for m in _CALL.finditer(body):
        at, last = m.start(2), m[2]
        if last in _NO_CALL and not m[1] or not own(at):
            continue
        full = re.sub(r"\s|::<[^<>()]*>|\?", "", m[1] + last)
        tail = "::".join(full.split("::")[-2:])
        loop = depth(at)
        if last in rules.io:
            out.append(("sync-io", at, last))
        awaited = re.match(r"\s*\.\s*await\b", body[closing(body, m.end() - 1) :])
        if is_async and tail in rules.blocking and not awaited:
            out.append(("blocking-sync-in-async", at, tail))
        if not loop:
            continue
        if last in rules.io:
            out.append(("io-in-loop", at, last))
            if loop >= 2:
                out.append(("nested-loop-with-io", at, last))
        if (last if script else tail) in rules.constructors:
            out.append(("resource-construction-in-loop", at, last if script else tail))
        if last in rules.locks and "." in full:
            out.append(("lock-in-loop", at, full))
        if (full if script else tail) in rules.json:
            out.append(("json-parse-in-loop", at, tail))
        if (full if script else tail) in rules.regexes:
            out.append(("regex-compile-in-loop", at, tail))
        owner = re.fullmatch(r"([\w$]+)\.(\w+)", full)
        if owner and not script and owner[2] == "insert" and re.match(r"\s*0\s*,", body[m.end() :]):
            out.append(("list-insert-zero-in-loop", at, owner[1]))
        if owner and owner[1] in lists and owner[2] in (("includes", "indexOf") if script else ("contains",)):
            out.append(("membership-test-in-loop", at, owner[1]))
    for m in _GROWTH.finditer(body):
        if own(m.start()) and depth(m.start()):
            out.append(("string-concat-in-loop", m.start(), m[1] or m[2]))
    for m in _AWAIT["script" if script else "Rust"].finditer(body):
        if not own(m.start()) or not depth(m.start()):
            continue
        if script:
            call = _CALL.match(body, m.end() + len(body[m.end() :]) - len(body[m.end() :].lstrip()))
            full = re.sub(r"\s|\?", "", call[1] + call[2]) if call else ""
            name = call[2] if call else ""
        else:
            full = name = _callee_before(body, m.start())
        if full not in rules.combinators:
            out.append(("serial-await-in-loop", m.start(), name))
    for at, a, _b, over in loops:
        if over and own(at) and any(x <= at < y and o == over for s, x, y, o in loops if s != at and x < a):
            out.append(("nested-loop-quadratic", at, over))
    if not script:
        for m in _GUARD.finditer(body):
            if not own(m.start()):
                continue
            end = _block_end(body, m.end())
            for c in _CALL.finditer(body, m.end(), end):
                if c[2] in rules.io and own(c.start(2)):
                    out.append(("blocking-io-under-lock", c.start(2), c[2]))
    else:
        for m in _SPREAD.finditer(body):
            call = body[m.end(1) : closing(body, body.index("(", m.start()))]
            if re.search(rf"(?:=>|\breturn)\s*\(?\s*\[\s*\.\.\.\s*{re.escape(m[1])}(?![\w$])", call):
                out.append(("array-spread-in-reduce", m.start() + 1, m[1]))
    for at, text in literals:
        if "from" in text.lower() and own(at) and (t := cartesian_tables(text)):
            out.append(("sql-cartesian-join", at, ",".join(t)))
    return sorted(out, key=lambda x: (x[1], x[0]))


def _block_end(body: str, at: int) -> int:
    """Where the block that holds `at` closes."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(body, at):
        depth += 1 if m[0] == "{" else -1
        if depth < 0:
            return m.start()
    return len(body)
