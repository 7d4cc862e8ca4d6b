"""Source files that do not parse, found by language-specific lexers with a pushdown stack.

For each language one pattern knows the comments, the literals, and what begins a literal that never ends. Both
are blanked, so that what is left holds code only; brackets are then pushed and popped, and the code outside all
brackets (the skeleton) is held against the forms that may stand at the top level of the language. That finds
unterminated literals, unbalanced or crossed delimiters, premature ends, conflict markers outside of literals,
stray bytes, and text of another language. For Python the interpreter's own parser then decides on files that
the lexer passes.
"""

from __future__ import annotations

import ast
import re
import unicodedata
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.session import table

LANGUAGES = ("C", "Go", "Java", "JavaScript", "Python", "Rust", "SQL", "Shell", "TypeScript")

_LINE, _BLOCK = r"//[^\n]*", r"/\*[\s\S]*?\*/"
_DQ, _SQ = r'"(?:[^"\\\n]|\\[\s\S])*+"', r"'(?:[^'\\\n]|\\[\s\S])*+'"
# Groups: 1 a comment, 2 a literal, 3 what opens a literal or comment that has no end.
_LEXERS = {
    "C": rf"({_LINE}|{_BLOCK})|((?<![\w'])\d[\w.]*(?:'[\w.]+)++|{_DQ}|{_SQ})|(\"|'|/\*)",
    "Java": rf'({_LINE}|{_BLOCK})|("""[\s\S]*?"""|{_DQ}|{_SQ})|("|\'|/\*)',
    "Go": rf"({_LINE}|{_BLOCK})|({_DQ}|{_SQ}|`[^`]*+`)|(\"|'|`|/\*)",
    "Rust": rf"""({_LINE}|{_BLOCK})|(b?r(\#*)"[\s\S]*?"\3|b?"(?:[^"\\]|\\[\s\S])*+"|b?'(?:[^'\\\n]|\\[^\n]{{1,8}}?)')|("|/\*)""",
    "SQL": rf"(--[^\n]*|{_BLOCK})|('(?:[^']|'')*+'|\"[^\"\n]*+\"|\$(\w*)\$[\s\S]*?\$\3\$)|('|\"|/\*)",
    "Shell": r"""((?:(?<=[\s;(])|^)\#[^\n]*)|(\$?\(\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*+\)\)|<<<|<<-?[ ]*+(['"]?)(\w+)\3[^\n]*\n(?:[\s\S]*?\n)??[ \t]*\4(?=\n|$)|\\[\s\S]|"(?:[^"\\]|\\[\s\S])*+"|\$'(?:[^'\\]|\\[\s\S])*+'|'[^']*+')|("|'|<<-?[ ]*+['"]?\w+)""",
    "Python": rf'(\#[^\n]*)|("""(?:[^"\\]|\\[\s\S]|"(?!""))*+"""|\'\'\'(?:[^\'\\]|\\[\s\S]|\'(?!\'\'))*+\'\'\'|{_DQ}|{_SQ})|("|\')',
}
_LEXERS = {k: re.compile(p) for k, p in _LEXERS.items()}

_MARKER = re.compile(r"^(?:<{7}|>{7}|\|{7})(?: |$)|^={7}$|^@@ -\d+(?:,\d+)? \+\d+|^\+\+\+ b/|^--- a/", re.M)
_STRAY = re.compile("[\x00-\x08\x0b\x0e-\x1f\x7f�]")
_NON_ASCII = re.compile(r"[^\x00-\x7f]")
_PAIR = {")": "(", "]": "[", "}": "{"}
_BRACKET = re.compile(r"[()\[\]{}]")


# JavaScript: comments, strings, what opens a template or a block, and a slash, which begins a regular expression or divides.
_JS_TOKEN = re.compile(rf"{_LINE}|{_BLOCK}|/\*|{_DQ}|{_SQ}|[\"'`{{}}/]")
_JS_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+(`|\$\{)")
_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+")
_JS_BEFORE_REGEX = re.compile(r"(?:^|[=(,:;!&|?{}\[+\-*%<>~^]|(?<![\w$.])(?:return|typeof|case|in|of|delete|void|throw|new|else|do|await|yield|instanceof))$")
_JSX_TEXT = re.compile(r"(?:^|[\s(>{}&?:,])<(?:[A-Za-z][\w.]*(?:\s[^<>]*)?)?>[^<>{}()=;`\"]*$")


def _blank_js(text: str) -> tuple[str, str | None]:
    """As `_blank`, with a stack of the templates that are open: what stands in `${}` is code again, to any depth."""
    out: list[str] = []
    open_: list[int] = []  # for each template, the braces open in its code
    at, tail = 0, ""
    markup = "</" in text or "/>" in text

    def template(start: int) -> int:
        """The end of the template's text from here on: of the whole template, or where code begins; -1 if it has no end."""
        m = _JS_TEMPLATE.match(text, start)
        if not m:
            return -1
        if m[1] == "`":
            out.append('""')
        else:
            open_.append(0)
            out.append('"" + (')
        return m.end()

    while m := _JS_TOKEN.search(text, at):
        before, t, c = text[at : m.start()], m[0], m[0][0]
        out.append(before)
        tail = before.rstrip()[-24:] or tail
        at = m.end()
        if c in "\"'":
            if c == "'" and markup and _JSX_TEXT.search(text, text.rfind("\n", 0, m.start()) + 1, m.start()):
                at = m.start() + 1  # an apostrophe in the text of an element
                continue
            if len(t) == 1:
                return "".join(out), "unterminated"
            out.append('""')
            tail = '"'
        elif t[:2] in ("//", "/*") and c == "/" and len(t) > 1:
            if t == "/*":
                return "".join(out), "unterminated"
            out.append("\n" if "\n" in t else " ")
        elif c == "`" or c == "}" and open_ and not open_[-1]:
            if c == "}":
                open_.pop()
                out.append(") + ")
            at = template(at)
            if at < 0:
                return "".join(out), "unterminated"
            tail = "(" if out[-1].endswith("(") else '"'
        elif c == "/":
            regex = _JS_REGEX.match(text, m.start())
            quotes = regex and sum(map(regex[0].count, "\"'`")) % 2
            if regex and text[m.start() - 1 : m.start()] != "<" and text[at : at + 1] != ">" and (_JS_BEFORE_REGEX.search(tail) or tail.endswith(")") and quotes):
                out.append('""')
                at, tail = regex.end(), '"'
            else:
                out.append("/")
                tail = "/"
        else:
            if open_:
                open_[-1] += 1 if c == "{" else -1
            out.append(c)
            tail = c
    out.append(text[at:])
    return "".join(out), "unterminated" if open_ else None


_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(include|define|undef|ifn?def|if|elif(?:n?def)?|else|endif|pragma|error|warning|line|embed)\b[ \t]*(\S*)")
_C_OPENS = re.compile(rf"//|/\*|{_DQ}|{_SQ}")


def _branches(text: str) -> tuple[str, str | None]:
    """The C text without its directives and with one branch of each conditional: the first, or the next one after `#if 0`; and what is wrong with the conditionals."""
    if "#" not in text:
        return text, None
    out, stack = [], []  # for each open conditional, whether its branch is kept and whether one was
    comment = more = False
    for line in text.split("\n"):
        directive = None if comment or more else _DIRECTIVE.match(line)
        if directive or more:
            more = line.endswith("\\")
            word = directive[1] if directive else ""
            if word in ("if", "ifdef", "ifndef"):
                stack.append([directive[2] != "0"] * 2)
            elif word.startswith("el") or word == "endif":
                if not stack:
                    return text, "unbalanced"
                if word == "endif":
                    stack.pop()
                else:
                    stack[-1] = [not stack[-1][1], True]
            opened = word in ("define", "include", "undef", "endif", "else") and _opens(line, False)
            out.append("/*" if opened else "")
            comment = comment or opened
        elif all(k for k, _ in stack) or comment:
            out.append(line)
            comment = _opens(line, comment)
        else:
            out.append("")
    return "\n".join(out), "premature end" if stack else None


def _opens(line: str, comment: bool) -> bool:
    """Whether a block comment is open at the end of a line, given whether one is at its start."""
    at = 0
    while True:
        if comment:
            at = line.find("*/", at) + 2
            if at < 2:
                return True
            comment = False
        m = _C_OPENS.search(line, at)
        if not m or m[0] == "//":
            return False
        at, comment = m.end(), m[0] == "/*"


_RUST_TOKEN = re.compile(rf"""b?r(\#*)"[\s\S]*?"\1|b?"(?:[^"\\]|\\[\s\S])*+"|b?'(?:[^'\\\n]|\\[^\n]{{1,8}}?)'|{_LINE}|/\*""")
_NESTED = re.compile(r"/\*|\*/")


def _flat_comments(text: str) -> str:
    """The Rust text with block comments, which nest to any depth, as spaces; one without an end stays."""
    if "/*" not in text:
        return text
    out, at, start = [], 0, 0
    while m := _RUST_TOKEN.search(text, at):
        at = m.end()
        if m[0] != "/*":
            continue
        depth = 1
        while depth:
            n = _NESTED.search(text, at)
            if not n:
                return "".join(out) + text[start : m.start()] + "/*"
            depth += 1 if n[0] == "/*" else -1
            at = n.end()
        out += [text[start : m.start()], "\n" if "\n" in text[m.start() : at] else " "]
        start = at
    return "".join(out) + text[start:]


def _blank(text: str, language: str) -> tuple[str, str | None]:
    """The code with each literal as `""` and each comment as a space; and why it ends here, if it does."""
    if language in ("JavaScript", "TypeScript"):
        return _blank_js(text)
    if language == "Rust":
        text = _flat_comments(text)
    bad = []

    def one(m: re.Match) -> str:
        if m.lastindex == 1:
            return "\n" if "\n" in m[1] else " "
        if m[2] is not None:
            return '""' if language != "Shell" else "_"
        bad.append(m.start())
        return m[0]

    code = _LEXERS[language].sub(one, text)
    return code, "unterminated" if bad else None


def _stray(code: str, language: str) -> bool:
    """Whether the code holds bytes, or signs beyond ASCII such as typographic quotes, that no token of the language begins with.

    Letters may stand in names. Shell and SQL take any sign for part of a word; so does the text of an element in markup.
    """
    if _STRAY.search(code):
        return True
    if language in ("Shell", "SQL") or language in ("JavaScript", "TypeScript") and ("</" in code or "/>" in code):
        return False
    return any(unicodedata.category(c)[0] not in "LMNZ" and unicodedata.category(c) not in ("Pc", "Cf") for c in set(_NON_ASCII.findall(code)))


def _skeleton(code: str) -> tuple[str, str | None]:
    """The code outside all brackets, each outermost pair kept as an empty one; and what is wrong with the nesting."""
    stack: list[str] = []
    out: list[str] = []
    at = 0
    for m in _BRACKET.finditer(code):
        c = m[0]
        if c in "([{":
            if not stack:
                out.append(code[at : m.start() + 1])
            stack.append(c)
        elif not stack or stack.pop() != _PAIR[c]:
            return "", "unbalanced"
        elif not stack:
            at = m.start()
    if stack:
        return "", "premature end"
    return "".join(out) + code[at:], None


# What may stand at the top level, over the skeleton.
_GO = re.compile(r"(?:package|import|func|type|var|const)\b|[)}]")
_GO_OPEN = re.compile(r"(?:[-+*/%&|^=<,.(!]|&&|\|\||:=|\b(?:func|type|var|const|import|package))$")
_JAVA = re.compile(r"(?:package|import|public|private|protected|final|abstract|static|class|interface|enum|record|sealed|non-sealed|strictfp)\b|@")
_JAVA_MODULE = re.compile(r"(?:open\s+)?module\s+[\w.]+\s*\{\}$")
_JAVA_MAIN = re.compile(r"\bvoid\s+main\s*\(\)")  # a file of methods and fields without a class needs one
_JAVA_MEMBER = re.compile(r"(?:<>\s*)?[A-Za-z_][\w.]*(?:<.*>)?(?:\[\])*\s+\w+\s*(?:\(\)[\w\s,.]*\{\}|=.*|(?:\[\])*)$", re.S)
_JAVA_IMPORT = re.compile(r"(?:package|import(?: static)?) [\w.]+(?:\.\*)?$")
_JAVA_TYPE = re.compile(r"\b(?:class|interface|enum|record|@interface)\s+\w+")
_RUST = re.compile(
    r"(?:pub(?:\(\))?\s+)?(?:(?:async|unsafe|default|extern(?:\s+\"\")?)\s+)*(?:(?:use\s+[\w:*]|use\s+\{|fn\s+\w+|struct\s+\w+|enum\s+\w+|union\s+\w+|trait\s+\w+|type\s+\w+|mod\s+\w+|impl\b|"
    r"static\s+(?:mut\s+)?\w+\s*:|const\s+(?:\w+\s*:|fn\b)|crate\b))|(?:unsafe\s+)?extern(?:\s+\"\")?\s*\{\}|\#!?\[\]|\w+!|macro_rules!"
)
_C_FOREIGN = re.compile(r"(?:package|import|from|def|fn|pub|use|func|export|function|let|impl|public|private|class|namespace|mod|async|CREATE|INSERT|SELECT|ALTER)\b")
_C = re.compile(r"[A-Za-z_]\w*[\s*(]")
_SQL = re.compile(
    r"(?:CREATE|INSERT|SELECT|UPDATE|DELETE|ALTER|DROP|WITH|BEGIN|START|COMMIT|ROLLBACK|SAVEPOINT|RELEASE|SET|GRANT|REVOKE|EXPLAIN|PRAGMA|VALUES|TRUNCATE|MERGE|REPLACE|USE|COMMENT|COPY|"
    r"ANALYZE|VACUUM|CALL|DECLARE|DO|END|EXECUTE|FETCH|LOCK|REFRESH|REINDEX|RESET|SHOW|DESCRIBE|ATTACH|DETACH|UPSERT|TABLE|IF|ELSE|LOOP|RETURN|\(\))(?![\w])", re.I,
)
_SQL_OPEN = re.compile(r"(?:[,=<>+*/|(-]|\b(?:AS|SELECT|FROM|WHERE|AND|OR|ON|BY|INTO|VALUES|SET|TABLE|VIEW|COLUMN|ADD|CREATE|INSERT|ALTER|JOIN|IN|NOT))$", re.I)
_JS_WORDS = frozenset(
    """abstract accessor as asserts async await break case catch class const continue debugger declare default delete do else enum export extends
    finally for from function get global if implements import in infer instanceof interface is keyof let module namespace new of out override package private
    protected public readonly return satisfies set static super switch this throw try type typeof unique using var void while with yield""".split()
)
_JS_PAIR = re.compile(r"(?<![\w.$])([A-Za-z_$][\w$]*)[ \t]+([A-Za-z_$][\w$]*)")
_JS_FOREIGN = re.compile(
    r"^\s*(?:#(?!!)|(?:pub|fn|impl|mod|use|def|func|package|elif|unsafe)\s+[\w\"]|from\s+\w|import\s+[\w.]+\s*(?:;|$)|import\s*\(\)\s*$|(?:public|private|protected|final|static)\s|"
    r"class\s+\w+\s*(?:\(\))?\s*:|\{\}\s*$(?![\s\S]))|:=|;\s*\}|->\s*\w+\s*\{\}", re.M,
)
_JS_OPEN = re.compile(
    r"(?:[-+*/%&|^=<>,.?:!~]|=>|\b(?:import|export|from|const|let|var|function|class|extends|new|return|typeof|in|of|async|await|if|while|for|else|default|interface|type|enum))$|"
    r"\b(?:import\s*(?:\w+\s*,\s*)?\{\}|function\s*\*?\s*\w*|class\s+\w+|import\s+\w+|function\s+\w+\s*\(\)(?:\s*:\s*\w+)?)$"
)
# Shell text: a function without a keyword, or block words alone on a line. And strings side by side, which only some languages join.
_JS_SHELL = re.compile(r"^\s*(?!(?:if|for|while|switch|catch|with|super|import)\b)[\w$]+\s*\(\)\s*\{\}", re.M)
_SHELL_WORDS = re.compile(r"^[ \t]*(?:fi|done|esac)[ \t]*;?[ \t]*$|;[ \t]*(?:then|do)[ \t]*$", re.M)
_SIDE_BY_SIDE = re.compile(r'\(\s*""\s+""')
_TS_IN_JS = re.compile(
    r"^\s*(?:(?:public|private|protected|readonly|declare|abstract)\s+\w|interface\s+\w+\s*\{|type\s+\w+\s*=|enum\s+\w+\s*\{|namespace\s+\w)|"
    r"\b(?:const|let|var)\s+[\w$]+\s*:|^[ \t]*[\w$]+\s*[?!]?:\s*[\w$<>\[\]|. ]+(?:=[^=>]|;)|\)\s*:\s*[\w$<>\[\]|. ]+\{|\([\w$]+\??\s*:\s*\w+\s*[,)=]", re.M,
)
_SH_CALL = re.compile(r"(?:^|[;&|]|\b(?:then|do|else)\b)[ \t]*+(?!function\b)[\w.:-]+(?:[ \t]+[\w.*&:-]+)*[ \t]*+\((?![ \t]*+\))|^[ \t]*\w[\w.-]*[ \t]+\w[\w.-]*[ \t]*\([ \t]*\)", re.M)
_SH_FOREIGN = re.compile(r"^[ \t]*(?:<[!/A-Za-z]|[\w.]+[ \t]+=[ \t]+(?:\(|[^\n]*?\w\()|[\[\]]{1,2}[ \t]*,?$|\},|(?:public|private) |use \w+::|package \w+;?$|import \w+|from \w+ import|const \w+ =|let \w+ =|\w+ := |CREATE TABLE|def \w+|class \w+|_:|\d+,\w+,)|;;?[ \t]*$(?<!;;)(?=\n[ \t]*\})(?!)", re.M)
_SH_WORD = re.compile(r"(?:^|[;&|(`]|\b(?:then|do|else|if|elif|while|until|in|not|time)\b|!|\)|\{)[ \t]*+(if|then|elif|else|fi|for|while|until|do|done|case|esac)(?=[\s;)&|]|$)", re.M)
_SH_CLOSE = {"fi": "if", "done": "do", "esac": "case"}
_TAIL_COMMA = re.compile(r"[,=+*/<>|&.-]$")


def _go(s: str) -> str | None:
    lines = [x.strip() for x in s.split("\n")]
    lines = [x for x in lines if x]
    if not lines[0].startswith("package ") or not re.fullmatch(r"package \w+;?", lines[0]):
        return "no package clause"
    for before, x in zip(lines, lines[1:], strict=False):
        if not _GO.match(x) and not _GO_OPEN.search(before):
            return "foreign top level"
    if _GO_OPEN.search(lines[-1]) or re.match(r"func\b(?!.*\{\}$)", lines[-1]) and not lines[-1].endswith(")"):
        return "premature end"
    return "premature end" if re.fullmatch(r"func( \(\))?( \w+)?( ?\(\))?( \w+)?", lines[-1]) else None


def _statements(s: str) -> tuple[list[str], str]:
    """Top-level statements of a language whose statements end in `;` or a block; and what comes after the last."""
    parts = re.split(r";|(?<=\{\})", s)
    return [p.strip() for p in parts[:-1] if p.strip()], parts[-1].strip()


def _java(s: str) -> str | None:
    done, rest = _statements(s)
    compact = bool(_JAVA_MAIN.search(s))
    for x in done:
        if compact and _JAVA_MEMBER.match(x) or _JAVA_MODULE.match(x):
            continue
        if not _JAVA.match(x) or x.startswith(("package", "import")) and not _JAVA_IMPORT.match(x):
            return "foreign top level"
        if x.endswith("{}") and not _JAVA_TYPE.search(x) or x.startswith("import static ") and " " in x[14:]:
            return "foreign top level"
    return "premature end" if rest else None


def _rust(s: str) -> str | None:
    s = re.sub(r"#!?\[\]", " ", s)
    done, rest = _statements(s)
    for x in done:
        if x and not _RUST.match(x):
            return "foreign top level"
    return "premature end" if rest else None


def _c(s: str) -> str | None:
    s = re.sub(r"^[ \t]*#[ \t]*(?:include|define|undef|ifn?def|if|elif|else|endif|pragma|error|warning|line)\b(?:\\\n|[^\n])*", "", s, flags=re.M)
    if re.search(r"^[ \t]*#|:=|^\s*\w+\s*\(\)\s*:|->\s*\w+\s*\{\}", s, re.M):
        return "foreign top level"
    done, rest = _statements(s)
    for x in done:
        if x != "extern" and (not _C.match(x) or _C_FOREIGN.match(x)) or re.search(r"\b\w+\s*:\s*\w+\s*=|\)\s*:\s*\w+\s*\{", x):
            return "foreign top level"
    return "premature end" if rest else None


def _sql(s: str) -> str | None:
    parts = s.split(";")
    for x in parts:
        if x.strip() and not _SQL.match(x.strip()):
            return "foreign statement"
        if _SQL_OPEN.search(x.strip()):
            return "premature end"
    last = parts[-1].strip()
    return "premature end" if re.fullmatch(r"(?i)create\s+table\s+\w+|alter\s+table\s+\w+|insert\s+into\s+\w+(\s*\(\))?|create\s+view\s+\w+|\w+", last) else None


def _js(s: str, code: str, language: str) -> str | None:
    if _JS_FOREIGN.search(s) or _JS_SHELL.search(s) or _SHELL_WORDS.search(code) or _SIDE_BY_SIDE.search(code):
        return "foreign top level"
    for m in _JS_PAIR.finditer(s):
        if m[1] not in _JS_WORDS and m[2] not in _JS_WORDS:
            return "foreign top level"
    if re.match(r'\s*\{\}\s*$', s) and re.match(r'\s*\{\s*""\s*:', code):
        return "foreign text"
    if _JS_OPEN.search(s.rstrip()):
        return "premature end"
    if language == "JavaScript" and _TS_IN_JS.search(code):
        return "foreign type notation"
    return None


def _shell(code: str) -> str | None:
    plain = re.sub(r"\$\(\([\s\S]*?\)\)|\$\{[^}\n]*\}|\w+\+?=\(", "_", code)
    if _SH_CALL.search(plain) or _SH_FOREIGN.search(plain):
        return "foreign text"
    stack = []
    for m in _SH_WORD.finditer(plain):
        w = m[1]
        if w in ("if", "case", "do"):
            stack.append(w)
        elif w in _SH_CLOSE:
            if not stack or stack.pop() != _SH_CLOSE[w]:
                return "unbalanced"
        elif w in ("then", "elif", "else") and (not stack or stack[-1] not in ("if", "case")):
            return "unbalanced"
    if stack or re.search(r"(?:&&|\|\||\||\\|\(\))$", plain.rstrip()):
        return "premature end"
    return None


def _nest_shell(code: str) -> str:
    """Case patterns end in a lone `)`; they are taken out before brackets are matched."""
    return re.sub(r"(?m)^[ \t]*[^\s()]+(?:[ \t]*\|[ \t]*[^\s()]+)*\)", "_", code) if "esac" in code else code


def _python(code: str, text: str) -> str | None:
    """Indentation against a stack, then the interpreter's parser."""
    stack, depth, opens = [0], 0, False
    for line in code.split("\n"):
        body = line.strip()
        if body and not depth:
            indent = len(line.expandtabs()) - len(line.expandtabs().lstrip())
            if opens != (indent > stack[-1]):
                return "indentation"
            if opens:
                stack.append(indent)
            while indent < stack[-1]:
                stack.pop()
            if indent != stack[-1]:
                return "indentation"
        depth += sum(map(line.count, "([{")) - sum(map(line.count, ")]}"))
        if body:
            opens = not depth and body.endswith(":")
            depth += body.endswith("\\") and not depth  # a continued line counts as nested until the next
            if depth and not body.endswith("\\") and not any(c in code for c in "([{"):
                depth = 0
    if opens:
        return "premature end"
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (RecursionError, MemoryError):
        return None  # too deep for the parser, which says nothing of the text
    except SyntaxError as e:
        return None if str(e.msg).startswith("too many nested") else "parser"
    except ValueError:
        return "parser"
    return None


def defect(language: str | None, text: str | None) -> str | None:
    """Why the text is not valid syntax of the language; None if nothing was found.

    NULL text or language, languages without a lexer, blank text and text of comments only are valid.
    """
    if text is None or language not in LANGUAGES:
        return None
    text = text.lstrip("﻿").replace("\r\n", "\n")
    code, why = _blank(text, language)
    if language == "C" and not _MARKER.search(code):
        branch, unended = _branches(text)
        code, why = _blank(branch, language)
        why = why or unended
    if not code.strip() and not why:
        return None
    if _MARKER.search(code):
        return "conflict marker"
    if _stray(code, language):
        return "stray bytes"
    if why:
        return why
    s, why = _skeleton(_nest_shell(code) if language == "Shell" else code)
    if why:
        return why
    match language:
        case "Go":
            return _go(s)
        case "Java":
            return _java(s)
        case "Rust":
            return _rust(s)
        case "C":
            return _c(s)
        case "SQL":
            return _sql(s)
        case "Shell":
            return _shell(code)
        case "Python":
            return "premature end" if _TAIL_COMMA.search(s.rstrip()) else _python(code, text)
        case _:
            return _js(s, code, language)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, repo, language, text): distinct rows of `files` with their texts."""
    files = table(spark, sf_dir, "files").select("file", "repo", "language").distinct()
    return files.join(table(spark, sf_dir, "file_texts").select("file", "text"), "file")


def syntax_defects(texts: DataFrame) -> DataFrame:
    """The rows of `texts` (language, text and others) that do not parse, with column `defect` in place of `text`.

    See `defect` for NULLs and empty texts. Repeated rows stay repeated. One text is held at a time with its
    blanked copy; Arrow batches keep the worker's memory at a few texts of any length.
    """
    rest = [f for f in texts.schema.fields if f.name not in ("text", "defect")]
    names = [f.name for f in rest]

    def run(batches):
        for pdf in batches:
            why = [defect(a, b) for a, b in zip(pdf["language"].tolist(), pdf["text"].tolist(), strict=True)]
            keep = np.array([w is not None for w in why], dtype=bool)
            out = {c: pdf[c].to_numpy(dtype=object)[keep] for c in names}
            yield pd.DataFrame(out | {"defect": np.array([w for w in why if w is not None], dtype=object)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return texts.mapInPandas(run, f"{schema}, defect string")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = sources(spark, sf_dir).where(F.col("language").isin(*LANGUAGES)).select("file", "language", "text")
    return syntax_defects(texts).select("file").distinct()


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repo and language: files with a text, files that do not parse, and their share."""
    texts = sources(spark, sf_dir).where(F.col("language").isin(*LANGUAGES))
    bad = syntax_defects(texts.select("file", "language", "text")).select("file", "language").distinct().withColumn("bad", F.lit(1))
    have = texts.select("repo", "file", "language").distinct()
    return (
        have.join(bad, ["file", "language"], "left")
        .groupBy("repo", "language")
        .agg(F.count("*").alias("files"), F.count("bad").alias("bad_files"))
        .withColumn("rate", F.round(F.col("bad_files") / F.col("files"), 6))
    )


QUERIES = {"p4_found": p4_found, "p4_rates": p4_rates}
SQL: dict = {}
