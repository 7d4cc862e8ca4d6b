"""Symbols and references of the other languages, by their lexical form.

Comments and literals are blanked, lines keep their places, and declarations are told by their first words. A
symbol ends where its braces close (or, for shell and SQL, its block). Metrics count decision words and braces.
"""

from __future__ import annotations

import re

import xxhash

from codestrata.extract import markers as M

_STRINGS = r'"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'|`[^`]*+`'
_LITERAL = re.compile(_STRINGS)
_SLASH = re.compile(rf"//[^\n]*|/\*[\s\S]*?\*/|({_STRINGS})")
_HASH = re.compile(rf"(?<!\$)\#[^\n]*|({_STRINGS})")
_DASH = re.compile(r"--[^\n]*|/\*[\s\S]*?\*/|('(?:[^']|'')*+')")

# Per language: comment form; (kind, pattern with group `n`, or `p` for a receiver); import patterns; words that decide.
_C_FN = r"^[ \t]*(?!return\b|else\b|if\b|for\b|while\b|switch\b|do\b)(?:[\w:<>,*&\[\]~]+[ \t*&]+)+(?P<n>[A-Za-z_]\w*)[ \t]*\([^;{}]*\)[^;{}=]*\{"
_IF = r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?![.?:])"
RULES = {
    "Go": (_SLASH, [("Function", r"^func[ \t]+(?P<n>\w+)[ \t]*[\[(]"), ("Method", r"^func[ \t]*\([ \t]*(?:\w+[ \t]+)?\*?(?P<p>\w+)[^)]*\)[ \t]*(?P<n>\w+)[ \t]*\("), ("Struct", r"^type[ \t]+(?P<n>\w+)[ \t]+struct\b"), ("Interface", r"^type[ \t]+(?P<n>\w+)[ \t]+interface\b")], [r'^\s*(?:import\s+)?(?:\w+\s+)?"([^"\n]+)"\s*$'], r"\b(?:if|for|case)\b|&&|\|\|"),
    "Rust": (_SLASH, [("Function", r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:(?:async|const|unsafe|extern(?:[ \t]+\"\w+\")?)[ \t]+)*fn[ \t]+(?P<n>\w+)"), ("Struct", r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?struct[ \t]+(?P<n>\w+)"), ("Enum", r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?enum[ \t]+(?P<n>\w+)"), ("Trait", r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?trait[ \t]+(?P<n>\w+)"), ("Impl", r"^[ \t]*impl\b(?:<[^>{]*>)?[ \t]+(?:[\w:<>, ]+[ \t]+for[ \t]+)?(?P<n>\w+)")], [r"^\s*(?:pub\s+)?use\s+([\w:]+)"], r"\b(?:if|for|while|loop)\b|=>|&&|\|\|"),
    "Java": (_SLASH, [("Class", r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|sealed)[ \t]+)*(?:class|record)[ \t]+(?P<n>\w+)"), ("Interface", r"^[ \t]*(?:(?:public|private|protected|static)[ \t]+)*interface[ \t]+(?P<n>\w+)"), ("Enum", r"^[ \t]*(?:(?:public|private|protected|static)[ \t]+)*enum[ \t]+(?P<n>\w+)"), ("Function", _C_FN)], [r"^\s*import\s+(?:static\s+)?([\w.]+)"], _IF),
    "C": (_SLASH, [("Struct", r"^[ \t]*(?:typedef[ \t]+)?struct[ \t]+(?P<n>\w+)[ \t]*\{"), ("Enum", r"^[ \t]*(?:typedef[ \t]+)?enum[ \t]+(?P<n>\w+)[ \t]*\{"), ("Function", _C_FN)], [r'^\s*#\s*include\s*[<"]([^>"\n]+)[>"]'], _IF),
    "JavaScript": (_SLASH, [("Function", r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<n>[\w$]+)"), ("Class", r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:abstract[ \t]+)?class[ \t]+(?P<n>[\w$]+)"), ("Interface", r"^[ \t]*(?:export[ \t]+)?interface[ \t]+(?P<n>[\w$]+)"), ("Enum", r"^[ \t]*(?:export[ \t]+)?(?:const[ \t]+)?enum[ \t]+(?P<n>[\w$]+)"), ("Function", r"^[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<n>[\w$]+)[ \t]*=[ \t]*(?:async[ \t]*)?(?:\([^)]*\)|[\w$]+)[ \t]*=>[ \t]*\{"), ("Method", r"^[ \t]+(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(?:(?:public|private|protected|static|async|get|set|readonly)[ \t]+)*(?P<n>[\w$]+)[ \t]*\([^;{}]*\)[^;{}=]*\{")], [r"""^\s*(?:import|export)\b[^;'"\n]*?['"]([^'"\n]+)['"]""", r"""require\(\s*['"]([^'"\n]+)['"]\s*\)"""], _IF),
    "Shell": (_HASH, [("Function", r"^[ \t]*(?:function[ \t]+)?(?P<n>[\w.-]+)[ \t]*\(\)[ \t]*\{")], [r"^\s*(?:\.|source)\s+(\S+)"], r"\b(?:if|elif|for|while|until)\b|&&|\|\||;;"),
    "SQL": (_DASH, [("Struct", r"(?i)^[ \t]*create[ \t]+(?:or[ \t]+replace[ \t]+)?(?:temp(?:orary)?[ \t]+)?(?:table|view|materialized[ \t]+view)[ \t]+(?:if[ \t]+not[ \t]+exists[ \t]+)?(?P<n>[\w.\"]+)"), ("Function", r"(?i)^[ \t]*create[ \t]+(?:or[ \t]+replace[ \t]+)?(?:function|procedure)[ \t]+(?P<n>[\w.\"]+)")], [], r"(?i)\b(?:when|if|and|or)\b"),
    "Kotlin": (_SLASH, [("Function", r"^[ \t]*(?:(?:public|private|protected|internal|override|suspend|inline|open|abstract|operator)[ \t]+)*fun[ \t]+(?:<[^>]*>[ \t]*)?(?:\w+\.)?(?P<n>\w+)"), ("Class", r"^[ \t]*(?:(?:public|private|internal|data|open|abstract|sealed|enum)[ \t]+)*(?:class|object)[ \t]+(?P<n>\w+)"), ("Interface", r"^[ \t]*(?:(?:public|private|internal)[ \t]+)*interface[ \t]+(?P<n>\w+)")], [r"^\s*import\s+([\w.]+)"], _IF),
    "Scala": (_SLASH, [("Function", r"^[ \t]*(?:(?:private|protected|override|final|implicit|inline)[ \t]+)*def[ \t]+(?P<n>\w+)"), ("Class", r"^[ \t]*(?:(?:private|final|sealed|abstract|case)[ \t]+)*(?:class|object)[ \t]+(?P<n>\w+)"), ("Trait", r"^[ \t]*(?:sealed[ \t]+)?trait[ \t]+(?P<n>\w+)")], [r"^\s*import\s+([\w.]+)"], _IF),
    "Swift": (_SLASH, [("Function", r"^[ \t]*(?:(?:public|private|internal|open|static|override|mutating|final)[ \t]+)*func[ \t]+(?P<n>\w+)"), ("Class", r"^[ \t]*(?:(?:public|private|open|final)[ \t]+)*(?:class|actor)[ \t]+(?P<n>\w+)"), ("Struct", r"^[ \t]*(?:(?:public|private)[ \t]+)*struct[ \t]+(?P<n>\w+)"), ("Enum", r"^[ \t]*(?:(?:public|private|indirect)[ \t]+)*enum[ \t]+(?P<n>\w+)"), ("Interface", r"^[ \t]*(?:public[ \t]+)?protocol[ \t]+(?P<n>\w+)")], [r"^\s*import\s+([\w.]+)"], _IF),
    "Php": (_SLASH, [("Function", r"^[ \t]*(?:(?:public|private|protected|static|final|abstract)[ \t]+)*function[ \t]+&?(?P<n>\w+)"), ("Class", r"^[ \t]*(?:(?:final|abstract|readonly)[ \t]+)*class[ \t]+(?P<n>\w+)"), ("Interface", r"^[ \t]*interface[ \t]+(?P<n>\w+)"), ("Trait", r"^[ \t]*trait[ \t]+(?P<n>\w+)")], [r"^\s*use\s+([\w\\]+)", r"(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"\n]+)"], _IF),
    "Dart": (_SLASH, [("Class", r"^[ \t]*(?:abstract[ \t]+)?(?:class|mixin|extension)[ \t]+(?P<n>\w+)"), ("Enum", r"^[ \t]*enum[ \t]+(?P<n>\w+)"), ("Function", _C_FN)], [r"""^\s*(?:import|export|part)\s+['"]([^'"\n]+)"""], _IF),
    "Ruby": (_HASH, [("Function", r"^[ \t]*def[ \t]+(?:self\.)?(?P<n>[\w?!=]+)"), ("Class", r"^[ \t]*class[ \t]+(?P<n>[\w:]+)"), ("Module", r"^[ \t]*module[ \t]+(?P<n>[\w:]+)")], [r"""^\s*require(?:_relative)?\s*\(?['"]([^'"\n]+)"""], r"\b(?:if|unless|while|until|when|rescue)\b|&&|\|\|"),
    "Luau": (_DASH, [("Function", r"^[ \t]*(?:local[ \t]+)?function[ \t]+(?:[\w]+[.:])?(?P<n>\w+)")], [r"""require\s*\(?\s*([^)\n]+)"""], r"\b(?:if|elseif|for|while|and|or)\b"),
}
RULES["TypeScript"] = RULES["JavaScript"]
RULES["Cpp"] = (_SLASH, [("Class", r"^[ \t]*(?:template[ \t]*<[^>]*>[ \t]*)?class[ \t]+(?P<n>\w+)[^;()]*\{"), ("Module", r"^[ \t]*namespace[ \t]+(?P<n>[\w:]+)"), *RULES["C"][1]], RULES["C"][2], _IF)
RULES["CSharp"] = (_SLASH, [*[(k, p.replace("public|private", "public|internal|partial|private")) for k, p in RULES["Java"][1][:3]], ("Struct", r"^[ \t]*(?:(?:public|private|internal|readonly)[ \t]+)*struct[ \t]+(?P<n>\w+)"), ("Function", _C_FN)], [r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"], _IF)
_COMPILED = {k: (c, [(kind, re.compile(p, re.M)) for kind, p in d], [re.compile(p, re.M) for p in i], re.compile(w)) for k, (c, d, i, w) in RULES.items()}
_CALL = re.compile(r"(?<![\w$])([A-Za-z_$][\w$]*)\s*\(")
_NO_CALL = frozenset("if for while switch catch return function func fn def sizeof match elif until when unless and or not in do else new await typeof instanceof struct class super".split())
_SHELL_CALL = re.compile(r"(?m)^[ \t]*([A-Za-z_][\w-]*)(?=[ \t]|$)")
_SHELL_WORDS = frozenset("if then else elif fi for while until do done case esac in function return local export set echo exit shift read cd printf test".split())
_FIELD = re.compile(r"\b(?:this|self|s)\.(\w+)\b(?!\s*\()")
# A parameter whose whole type is a primitive one, references aside.
_PRIMITIVE = r"(?:int|long|short|char|float|double|bool|boolean|string|String|str|number|byte|usize|isize|[iuf](?:8|16|32|64|128))"
_BARE = re.compile(rf"(?:mut\s+)?\w+\s*\??:\s*(?:&\s*(?:'\w+\s+)?(?:mut\s+)?)?{_PRIMITIVE}(?:\s*=.*)?|(?:(?:final|const|unsigned|signed)\s+)*{_PRIMITIVE}\s+\w+|\w+\s+{_PRIMITIVE}", re.S)
_DEFER, _SPAWN = re.compile(r"\bdefer\s+([\w.]+)"), re.compile(r"\bgo\s+(func\b|[\w.]+)")
CONTAINERS = ("Class", "Struct", "Interface", "Trait", "Impl", "Enum")


def blank(language: str, text: str) -> str:
    """The code with comments as spaces and literals as empty strings padded to their length; places stay."""

    def one(m: re.Match) -> str:
        s = m[0]
        body = re.sub(r"[^\n]", " ", s)
        return s[0] + body[1:-1] + s[-1] if m[1] and len(s) > 1 else body

    return _COMPILED[language][0].sub(one, text)


def _end(code: str, at: int, language: str) -> int:
    """Where the block that opens after `at` closes; the line's end if none opens before a statement ends."""
    if language in ("Ruby", "Luau"):
        indent = len(code[code.rfind("\n", 0, at) + 1 :]) - len(code[code.rfind("\n", 0, at) + 1 :].lstrip(" \t"))
        m = re.compile(rf"^[ \t]{{{indent}}}end\b", re.M).search(code, at)
        return m.end() if m else len(code)
    stop = ";" if language == "SQL" else None
    depth, i = 0, at
    for m in re.compile(r"[{};]").finditer(code, at):
        c = m[0]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif depth == 0:
            return m.end()
        i = m.end()
    return i if depth == 0 and stop is None else len(code)


def _metrics(body: str, words: re.Pattern) -> tuple[int, int, int]:
    depth = most = bumps = 0
    high = False
    for c in re.findall(r"[{}]", body):
        if c == "{":
            depth += 1
            most = max(most, depth - 1)
            high |= depth >= 3
        else:
            depth -= 1
            if depth == 1 and high:
                bumps += 1
                high = False
    return 1 + len(words.findall(body)), most, bumps


def extract(language: str, file: str, text: str) -> dict[str, list[tuple]] | None:
    """Rows of symbols, imports, calls, field accesses and markers; None for a language without rules."""
    if language not in _COMPILED:
        return None
    text = text.replace("\r\n", "\n")
    code = blank(language, text)
    _, kinds, imports, words = _COMPILED[language]
    lines = text.split("\n")
    line_of = lambda i: code.count("\n", 0, i) + 1
    spans, taken = [], set()
    for kind, p in kinds:
        for m in p.finditer(code):
            at = m.start("n")
            if at in taken:
                continue
            taken.add(at)
            spans.append([at, _end(code, m.end("n"), language), kind, m["n"].strip('"'), m.groupdict().get("p")])
    spans.sort()
    out: dict[str, list[tuple]] = {"symbols": [], "imports": [], "calls": [], "field_accesses": [], "markers": []}
    named = {s[3]: f"{file}::{s[3]}@{line_of(s[0])}" for s in spans if s[2] in CONTAINERS and s[2] != "Impl"}
    funcs = []
    for order, (a, b, kind, name, receiver) in enumerate(x for x in spans if x[2] != "Impl"):
        around = [s for s in spans if s[0] < a and b <= s[1] and s[2] in CONTAINERS]
        holder = receiver or (around[-1][3] if around else None)
        parent = named.get(holder, f"{file}::{holder}@0" if holder else None)
        start, end = line_of(a), line_of(max(a, b - 1))
        sid = f"{file}::{name}@{start}"
        m = (None,) * 6
        if kind in ("Function", "Method"):
            kind = "Method" if parent else "Function"
            body = code[a:b]
            head = re.search(r"\(([^)]*)\)", body[: body.find("{") if "{" in body else None])
            params = [p for p in (head[1].split(",") if head else []) if p.strip() and p.strip().lstrip("&").replace("mut ", "") not in ("self", "void")]
            prim = sum(bool(_BARE.fullmatch(p.strip())) for p in params)
            flat = " ".join(" ".join(lines[start:end]).split())
            m = (*_metrics(body, words), len(params), prim, xxhash.xxh64_intdigest(flat) - (1 << 63) if end - start >= 3 else None)
            funcs.append((a, b, sid))
            if language in M.RULES and "{" in body:
                paren = code.find("(", a, b)
                open_ = code.find("{", M.closing(code, paren) if 0 <= paren < code.find("{", a) else a, b)
                if open_ >= 0:
                    head = code[code.rfind("\n", 0, a) + 1 : open_]
                    literals = [(x.start() - open_, x[0][1:-1]) for x in _LITERAL.finditer(text, open_, b) if code[x.start()] == x[0][0] and code[x.end() - 1] == x[0][-1]]
                    out["markers"] += [(sid, k, line_of(open_ + at), n) for k, at, n in M.markers(language, head, code[open_:b], literals)]
            if language == "Go":
                for loop in re.finditer(r"\bfor\b[^{\n]*\{", body):
                    inner = body[loop.end() : _end(body, loop.end() - 1, language)]
                    ln = lambda x, base=a + loop.end(): line_of(base + x.start())
                    out["markers"] += [(sid, "defer-in-loop", ln(d), d[1]) for d in _DEFER.finditer(inner)]
                    if "<-" not in inner:
                        out["markers"] += [(sid, "goroutine-in-unbounded-loop", ln(g), "func literal" if g[1] == "func" else g[1]) for g in _SPAWN.finditer(inner)]
        out["symbols"].append((sid, file, order, name, kind, start, end, parent, *m))
    for p in imports:
        out["imports"] += [(file, m[1], text.count("\n", 0, m.start(1)) + 1, None) for m in p.finditer(text) if language != "Go" or _go_import(code, m.start(1))]

    def within(i):
        best = None
        for a, b, sid in funcs:
            if a <= i < b:
                best = sid
        return best

    starts = {s[0] for s in spans}
    for m in (_SHELL_CALL if language == "Shell" else _CALL).finditer(code):
        if m.start(1) not in starts and m[1] not in (_SHELL_WORDS if language == "Shell" else _NO_CALL):
            out["calls"].append((file, within(m.start(1)), m[1], line_of(m.start(1))))
    for m in _FIELD.finditer(code):
        if sid := within(m.start()):
            out["field_accesses"].append((file, sid, m[1], line_of(m.start())))
    return out


def _go_import(code: str, at: int) -> bool:
    """Whether a quoted line stands in an import declaration."""
    head = code[:at]
    one = re.search(r'import[ \t]+(?:\w+[ \t]+)?"?$', head.split("\n")[-1])
    return bool(one) or head.rfind("import (") > head.rfind(")")
