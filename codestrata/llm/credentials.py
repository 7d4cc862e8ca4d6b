"""Credentials embedded in source and configuration texts: found, and hidden in place.

Candidates are all quoted strings, values of assignments and long tokens, wherever they stand. A literal split by
concatenation counts as one, at the line it starts on. Its Shannon entropy must lie above a threshold for its
alphabet and length; a context that speaks of a secret lowers that threshold, and the length asked for, and does
nothing else. Excluded are placeholders, references to a secret kept elsewhere, public keys, hashes, ids and runs of
encoded data. Well-known forms (access key ids, key blocks, tokens with an issuer's prefix) are told by their
shape, which names their kind.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.session import table

KINDS = ("aws-access-key-id", "private-key-block", "github-token", "slack-token", "suspicious-assignment")

_JOIN = re.compile(r"""(["'`])[ \t]*(?:\+|\|\||\.{1,2}|&|\\(?=\n))?[ \t]*(?:\n[ \t]*(?:\+|\|\||\.{1,2}|&)?[ \t]*)?\1""")
_MAY_JOIN = re.compile(r"""["'`][ \t]*(?:\+|\|\||\.{1,2}|&|\n)[ \t\n]*["'`]""")
# What may stand between the BEGIN line and the key itself: line ends, comment and string signs, header lines, a blank line.
_DECO = r"(?:\\+[nr]|[\s\"'+\;#*/-])*?"
_HEAD = _DECO + rf"(?:[A-Za-z][A-Za-z-]*:(?:[ \t](?:(?!\\n)[^\n])*)?\r?(?:\\n|\n){_DECO})*"
_KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?P<a>(?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])(?P<g>gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,})(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])(?P<s>xox[abeoprs]-[A-Za-z0-9-]{16,})(?![A-Za-z0-9])"
    rf"|(?P<p>-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----{_HEAD}(?=[A-Za-z0-9+/]{{16}}))"
)
_KEY_EDGE = re.compile(r"-----(?:END (?:[A-Z0-9]+ )*(?P<end>PRIVATE KEY(?: BLOCK)?-----)|END|BEGIN)")
_BLANK = re.compile(r"\n[ \t\r]*\n")
_KIND = {"a": KINDS[0], "p": KINDS[1], "g": KINDS[2], "s": KINDS[3]}

# What names a secret, in English and by the usual words of the corpus's other languages. Each word stands alone between case changes, digits or signs.
_B, _E = r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))", r"(?:(?![A-Za-z])|(?<=[a-z])(?=[A-Z]))"
_WORD = r"(?:[Pp]assword|PASSWORD|[Pp]asswd|PASSWD|[Pp]assphrase|PASSPHRASE|[Pp]ass|PASS|[Pp]wd|PWD|[Pp]w|PW|[Ss]ecrets?|SECRETS?|[Tt]oken|TOKEN|[Cc]redentials?|CREDENTIALS?|[Bb]earer|BEARER|(?:[Aa]pi|API|[Aa]ccess|ACCESS|[Pp]rivate|PRIVATE|[Ss]igning|SIGNING|[Ee]ncryption|ENCRYPTION|[Ss]ervice|SERVICE|[Aa]uth|AUTH|[Mm]aster|MASTER)[_\-. ]?(?:[Kk]ey|KEY)|[Aa]uth|AUTH|[Aa]uthorization|AUTHORIZATION|[Cc]ontrase[ñn]a|CONTRASE[ÑN]A|[Pp]asswort|PASSWORT|[Kk]ennwort|KENNWORT|[Mm]ot_?[Dd]e_?[Pp]asse|MOT_?DE_?PASSE|[Ss]ecreto|[Gg]eheimnis)"
_SECRET = re.compile(_B + _WORD + _E)
_LOGIN = re.compile(r"(?i)(?:open_?session|log_?in|sign_?in|authenticate|connect|basic_?auth)\w*\s*\(|\bidentified\s+by\b|\b(?:curl|psql|mysql)\b.*\s-(?:u|p)")
# Names of settings about secrets, or of where they are kept.
_ABOUT = re.compile(r"(?i)[_\-.]?(?:name|length|len|ttl|seconds|secs|minutes|days|expiry|count|size|type|path|file|url|uri|endpoint|policy|env|field|header|prefix|ref|store|min|max|rotation|version|enabled|required|hash|digest|fingerprint|checksum)(?:[_\-]?\d+)?$")
_ABOUT_MID = re.compile(r"(?i)(?:min|max)_?(?:length|len)|ttl|expir")
_HASHED = re.compile(r"(?i)(?:^|[_\-.]|(?<=[a-z]))(?:e_?tag|checksum|revision|commit|sha\d*|md5|digest|fingerprint|hash|request_?id|trace_?id|public_?\w*|uuid|guid|integrity)(?:[_\-]?\d+)?$")
_PUBLIC = re.compile(r"(?i)public")

_QUOTED = re.compile(r"""(?P<q>["'`])(?P<v>(?:(?!(?P=q))[^\\\n]|\\.)*)(?P=q)""")
_NAMED = re.compile(r"""(?P<n>[^\W\d][\w.\-]*)["'`\]]*\s*(?::\s*[&\w<>\[\]*' ]+?=|=>|:=|=|:)\s*(?P<b>[^\s"'`,;(){}<>\[\]#][^\s"'`,;(){}<>\[\]]{5,}|(?=["'`]))""")
_URL = re.compile(r"[A-Za-z][\w+.\-]*://(?P<u>[^\s:/@\"'`<>{}$]*):(?P<v>[^\s@\"'`<>]+)@[\w.\-]+")
_PARAM = re.compile(r"(?i)[?&](?:access_|auth_|api_|refresh_)?(?:token|key|apikey|secret|password|passwd|pwd|sig)=(?P<v>[^\s&\"'`<>#]{8,})")
_BEARER = re.compile(r"\b(?:Bearer|Basic|Token|bearer|basic)\s+(?P<v>[A-Za-z0-9+/_=.\-~!#%]{12,})")
_FLAG = re.compile(r"(?i)(?:^|\s)--?(?:password|passwd|pwd|token|secret|api-?key|auth-?token)[= ](?P<v>[^\s\"'`]{8,})")
_USERPW = re.compile(r"\s-u\s+[\"']?[\w.\-]+:(?P<v>[^\s\"'@]{8,})")

_PLACEHOLDER = re.compile(
    r"(?i)example|placeholder|change[_-]?me|your[_-]|insert|dummy|sample|redacted|replace|todo|fixme|fake|not[_-]?real|unit[_-]?(?:run|test)|(?:^|[_\-.])test(?:[_\-.]|$)|x{5,}|\*{3,}|"
    r"^(?:none|null|true|false|undefined|default|secret|password|token)$|\.{3}|goes[_-]here|1234567|abcdef|(.)\1{5,}"
)
_ELSEWHERE = re.compile(
    r"[${}<>()]\w*\s*[({]|^\$|^%\w+%$|\$\{|\{\{|\}\}|<[^>]*>|^@|(?i:getenv|environ|process\.env|os\.env|vault[:/_]|secretsmanager|ssm:|keyring|arn:|env[:.(]|file:|op://)|^(?:/|\./|~/)|^[a-z_.\-]+\d{0,3}(?:/[a-z_.\-]+\d{0,3})+$|"
    r"^[A-Za-z][\w+.\-]*://|^(?:sha\d+|md5)[:\-]|^ssh-(?:rsa|ed25519)|^-----BEGIN"
)
# A host or a member of a module, unless one of its parts is random.
_DOTTED = re.compile(r"^[\w\-]+(?:\.[\w\-]+)+(?::\d+)?$")
_UUID = re.compile(r"(?i)^\{?[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\}?$")
_HEX = re.compile(r"(?i)^[0-9a-f]+$")
_CODE = re.compile(r"^[A-Za-z_$][\w$]*(?:[.:]{1,2}[A-Za-z_$][\w$]*)*(?:\(.*)?;?$")
# Words with a number or two, as variables are named.
_NAME = re.compile(r"^[A-Za-z_$]+\d{0,4}(?:[._:]+[A-Za-z_$]*\d{0,2})*$")

# Words and a number, joined by signs.
_PHRASE = re.compile(r"^[A-Za-z]+(?:[^A-Za-z0-9\s][A-Za-z]+)+(?:[^A-Za-z0-9\s]?\d+)?$")

MIN_LENGTH = 8
# From this length on, a part of a dotted value may be a key's: where it mixes cases and digits, or not; and how often, at least, its characters change between cases and digits.
MIXED_PART, PLAIN_PART = (12, 0.5), (20, 0.25)


def entropy(s: str) -> float:
    """Shannon entropy in bits per character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _threshold(s: str) -> float:
    """The least entropy of a random-looking string of this alphabet and length.

    A random string of n characters over k letters comes close to log2(min(n, k)) bits; digits stay below
    hexadecimal, hexadecimal below letters and digits, and words joined by signs below those.
    """
    size = 10 if s.isdigit() else 16 if _HEX.match(s) else 36 if s.lower() == s or s.upper() == s else 64
    words = _PHRASE.match(s)
    return (0.55 if words else 0.74) * math.log2(min(len(s), size))


def _random_part(s: str) -> bool:
    """Whether a part of a dotted value is a piece of a key rather than a name: names are words with few numbers, in lower case if they are a host's."""
    for run in re.findall("[A-Za-z0-9]+", s):
        kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" for c in run]
        length, changes = MIXED_PART if len(set(kinds)) == 3 else PLAIN_PART
        if len(run) >= length and 1 < len(set(kinds)) and "d" in kinds and sum(a != b for a, b in pairwise(kinds)) >= changes * (len(run) - 1) and entropy(run) >= _threshold(run):
            return True
    return False


def looks_secret(s: str) -> bool:
    """Whether a literal in a secret's place is one, and not a placeholder or a reference."""
    if len(s) < MIN_LENGTH or any(c.isspace() for c in s):
        return False
    if _PLACEHOLDER.search(s) or _ELSEWHERE.search(s) or _UUID.match(s) or s.isdigit() or _NAME.match(s):
        return False
    if _DOTTED.match(s) and not any(_random_part(x) for x in s.split(".")):
        return False
    if not any(c.isdigit() for c in s) and (_CODE.match(s) or not (any(c.isupper() for c in s) and any(c.islower() for c in s))):
        return False
    return any(c.isalpha() for c in s) and entropy(s) >= _threshold(s)


# Strings and tokens long enough to be told by their entropy alone.
LONG = 20
_LONG = re.compile(r"""(?<![\w+/.~%-])[A-Za-z0-9+/_.~%-]{20,}={0,2}(?![\w+/=.~%-])""")
# Names of what is random but no secret.
_ID = re.compile(r"(?i)(?:^|[_\-.]|(?<=[a-z]))(?:ids?|uid|nonce|salt|iv|cursor|ref|slug|build|version|sri|fixture|snapshot|data|payload|blob|image|icon|font|cert(?:ificate)?|pem|signature|sig|table|chunk|sample)(?:[_\-]?\d+)?$")
# Names of several words, which change between cases as often as keys do.
_WORDY = re.compile(r"[A-Z]?[a-z]{2,}")
# Literals and signs only, as lists of data have them.
_BARE_LINE = re.compile(r"""^[\s\[({,]*["'`]?[A-Za-z0-9+/_=.~%-]+["'`]?[\s\])},;+\\]*$""")


def stands_out(s: str) -> bool:
    """Whether a string is told a secret by its entropy alone: a part of it is random for its alphabet and length."""
    if len(s) < LONG or _PLACEHOLDER.search(s) or _ELSEWHERE.search(s) or _UUID.match(s) or _HEX.match(s.strip("=")) or _NAME.match(s):
        return False
    if _CODE.match(s) and s.lower() != s and 5 * sum(len(x) for x in _WORDY.findall(s) if len(x) > 2) >= 3 * len(s):
        return False
    parts = [x for x in re.split(r"[./~%]", s) if x]
    if len(parts) > 3 and "/" in s and not any(len(x) >= LONG and _random_part(x) for x in parts):
        return False
    return any(len(x) >= MIXED_PART[0] and _random_part(x) for x in parts) and entropy(s) >= _threshold(s)


def _by_entropy(line: str) -> list[tuple[int, int]]:
    """Spans of the line that stand out by their entropy and are not called a hash, an id or data."""
    found = [m.span() for m in _LONG.finditer(line) if line[m.end() : m.end() + 1] != "(" and stands_out(m[0].rstrip("=."))]
    if len(found) > 2:  # a list of such strings is data
        return []
    out = []
    for a, b in found:
        before = line[:a]
        name = re.search(r"""([^\W\d][\w.\-]*)["'`\]]*\s*(?:=>|:=|[=:(,])[\s"'`(\[{]*(?:\w+\()?["'`]?$""", before)
        called = name[1] if name else ""
        if _HASHED.search(called) or _PUBLIC.search(before) or _ID.search(called) or (_ABOUT.search(called) and not _SECRET.search(called)) or re.search(r"(?:data:[\w/+.-]+;base64,|sha\d+-|\$\d\w?\$)$", before):
            continue
        out.append((a, b))
    return out


def _known(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and group of each literal of a well-known form.

    A key block runs to its END line, whatever its length. Without one it ends before the next block, or at a blank line after its headers.
    """
    at = 0
    while m := _KNOWN.search(text, at):
        at = m.end()
        if m.lastgroup == "p":
            edge = _KEY_EDGE.search(text, at)
            if edge and edge["end"]:
                at = edge.end()
            else:
                last = edge.start() if edge else len(text)
                blank = _BLANK.search(text, at, last)
                at = blank.start() if blank else last
        yield m.start(), at, m.lastgroup


def _known_is_real(kind: str, s: str) -> bool:
    if kind == "p":
        return True
    body = s.split("_", 1)[-1] if kind == "g" else s[4:] if kind == "a" else s[5:]
    return not _PLACEHOLDER.search(s) and not re.search("EXAMPLE|SAMPLE|TEST", s) and entropy(body) >= 0.6 * math.log2(min(len(body), 36))


_KNOWN_HINTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xox", "PRIVATE KEY")
_LITERAL = re.compile(r"""["'`][^"'`\s]{8}|[:=][ \t]*[^\s"'`(){};]{8}|://|\s-u\s|(?:Bearer|Basic|Token|bearer|basic)\s+\S{12}|[A-Za-z0-9+/_=.~%-]{20}""")


def _lines_to_see(text: str) -> list[tuple[int, int]]:
    """Start and end of each line that holds a candidate, in order."""
    out, at = [], 0
    while m := _LITERAL.search(text, at):
        a = text.rfind("\n", 0, m.start()) + 1
        b = text.find("\n", m.start() + 1)
        b = b if b >= 0 else len(text)
        out.append((a, b))
        at = b
    return out


def _joined(text: str) -> tuple[str, list[int], list[int]]:
    """The text with split literals as one; and, for each stretch, where it starts there and in the text."""
    if not _MAY_JOIN.search(text):
        return text, [0], [0]
    out, at_new, at_old, last, size = [], [0], [0], 0, 0
    for m in _JOIN.finditer(text):
        if m.start() + 1 == m.end() - 1 or "\n" not in m[0] and len(m[0]) == 2:
            continue  # an empty literal
        out.append(text[last : m.start()])
        size += m.start() - last
        last = m.end()
        at_new.append(size)
        at_old.append(last)
    out.append(text[last:])
    return "".join(out), at_new, at_old


def _in_run(text: str, a: int, b: int) -> bool:
    """Whether the line holds a literal only, as encoded data are laid out: one of several such lines, or one without a key's dots."""
    if not _BARE_LINE.match(text[a:b]):
        return False
    if text.count(".", a, b) < 2:
        return True
    before, after = text[text.rfind("\n", 0, max(a - 1, 0)) + 1 : max(a - 1, 0)], text[b + 1 : (text.find("\n", b + 1) + 1 or len(text) + 1) - 1]
    return any(len(x.strip()) >= MIN_LENGTH and _BARE_LINE.match(x) for x in (before, after))


def _in_line(line: str, in_run: bool = False) -> list[tuple[int, int]]:
    """Spans of the line that hold a secret of no well-known form."""
    found = []
    for p in (_URL, _PARAM, _BEARER, _FLAG, _USERPW):
        for m in p.finditer(line):
            if looks_secret(m["v"]):
                found.append(m.span("v"))
    if not in_run:
        found += _by_entropy(line)
    login, secret = _LOGIN.search(line), _SECRET.search(line)
    if not (login or secret):
        return found
    named = list(_NAMED.finditer(line))
    for m in named:
        if m["b"] and _SECRET.search(m["n"]) and not _ABOUT.search(m["n"]) and not _ABOUT_MID.search(m["n"]) and not _PUBLIC.search(m["n"]):
            v = m["b"].rstrip(".")
            if line[m.end() : m.end() + 1] != "(" and looks_secret(v) and not _NAME.match(v):
                found.append((m.start("b"), m.start("b") + len(v)))
    for m in _QUOTED.finditer(line):
        v = m["v"]
        if len(v) < MIN_LENGTH or " " in v or not looks_secret(v):
            continue
        before = line[: m.start()]
        own = [n for n in named if n.end() == m.start()]
        args = re.search(r"""["'`](\w[\w.\-]*)["'`]\s*(?:,|=>|:)\s*$""", before)
        name = own[-1]["n"] if own else args[1] if args else None
        if name and _SECRET.search(name):
            ok = not (_ABOUT.search(name) or _ABOUT_MID.search(name) or _PUBLIC.search(name))
        elif own:
            ok = False
        else:
            ok = bool(login or _SECRET.search(before)) and not (name and _HASHED.search(name))
        if ok:
            found.append(m.span("v"))
    return found


def find_credentials(text: str | None) -> list[tuple[int, str, list[tuple[int, int]]]]:
    """(line, kind, spans in the text) of each credential, in order of place. NULL or empty text: none."""
    if not text:
        return []
    flat, at_new, at_old = _joined(text)

    def spans(a: int, b: int) -> list[tuple[int, int]]:
        out, k = [], bisect_right(at_new, a) - 1
        while a < b:
            end = at_new[k + 1] if k + 1 < len(at_new) else len(flat)
            if end > a:
                shift = at_old[k] - at_new[k]
                out.append((a + shift, min(b, end) + shift))
                a = min(b, end)
            k += 1
        return out

    hits = []
    for a, b, group in _known(flat) if any(w in flat for w in _KNOWN_HINTS) else ():
        if _known_is_real(group, flat[a:b]):
            hits.append((a, b, _KIND[group]))
    starts = None
    masked = flat
    if hits:
        parts, last = [], 0
        for a, b, _ in hits:
            parts += [flat[last:a], re.sub(r"[^\n]", " ", flat[a:b])]
            last = b
        masked = "".join(parts) + flat[last:]
    for a, b in _lines_to_see(masked):
        line = masked[a:b]
        taken: list[tuple[int, int]] = []
        for x, y in sorted(set(_in_line(line, _in_run(masked, a, b)))):
            if not any(x < q and p < y for p, q in taken):
                taken.append((x, y))
                hits.append((a + x, a + y, KINDS[4]))
    out = []
    for a, b, kind in sorted(hits):
        where = spans(a, b)
        if starts is None:
            starts = [0] + [m.end() for m in re.finditer("\n", text)]
        out.append((bisect_right(starts, where[0][0]), kind, where))
    return out


def redact(text: str | None, found: list | None = None) -> str | None:
    """The text with every credential's characters as `*`; line breaks, escapes and all else stay, as does the length. found: what `find_credentials` says of it, if known."""
    if text is None:
        return None
    chars = None
    for _, _, spans in find_credentials(text) if found is None else found:
        chars = chars or list(text)
        for a, b in spans:
            for m in re.finditer(r"\\[nr]|[\s\"'`+\\]+|(.)", text[a:b]):
                if m[1]:
                    chars[a + m.start()] = "*"
    return "".join(chars) if chars else text


def credentials(texts: DataFrame) -> DataFrame:
    """(file, line, kind) of each credential in `texts` (file, text); other columns are ignored.

    Lines count from 1 and are parted by `\\n`. NULL and empty texts hold none. Repeated texts give repeated
    rows; two credentials of a kind on one line give two. A text of any length is taken whole.
    """

    def run(batches):
        for pdf in batches:
            rows = [(f, n, k) for f, t in zip(pdf["file"], pdf["text"], strict=True) for n, k, _ in find_credentials(t)]
            yield pd.DataFrame(rows, columns=["file", "line", "kind"])

    return texts.select("file", "text").mapInPandas(run, "file string, line int, kind string")


def redacted(texts: DataFrame) -> DataFrame:
    """(file, text, hidden): the texts that hold credentials, with those hidden, and how many."""

    def run(batches):
        for pdf in batches:
            found = map(find_credentials, pdf["text"])
            rows = [(f, redact(t, x), len(x)) for f, t, x in zip(pdf["file"], pdf["text"], found, strict=True) if x]
            yield pd.DataFrame(rows, columns=["file", "text", "hidden"])

    return texts.select("file", "text").mapInPandas(run, "file string, text string, hidden int")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials(table(spark, sf_dir, "file_texts")).distinct()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(table(spark, sf_dir, "file_texts")).distinct()


QUERIES = {"p6_found": p6_found, "p6_redacted": p6_redacted}
SQL: dict = {}
