"""Generated, minified, vendored and data files among source files, told by grammars over their tokens.

Each text becomes a token sequence (identifiers, numbers and strings by class; keywords, signs and line ends as
they are), and a Re-Pair grammar is inferred for it: digrams that repeat are replaced by rules until none
repeats, all locally most frequent digrams of a round at once. A grammar far smaller than its text, for the
text's length, means that a few rules are used over and over, as in generated tables and accessors. Literals that
make up most of a text, and whose compressed size comes close to what their alphabet allows, are data. A text without line ends among its tokens is minified.

Copies of outside libraries are found by rules shared across repositories. Re-Pair's rules depend on the whole
text, so that a notice put before a copy could change them all; for this purpose rules are formed at places that
the tokens themselves choose (hash minima), level by level, and are named by a hash of what they expand to.
A notice at the head of the file that names the tool or the library, or the library's directory, decides only where the grammar is silent.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.syntax import sources
from codestrata.session import Scratch

_TOKEN = re.compile(r'"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'|`[^`]*+`|[A-Za-z0-9+/]{48,}={0,2}|\w+|[^\w\s]|\n')
_KEYWORDS = frozenset(
    """if else elif for while do done fi then return switch case break function func fn def class struct interface enum impl const var let int static public private
    final import from use package type new this self in range end insert into values create table alter add column where and or not null primary key""".split()
)
# Re-Pair: a digram must occur so often to become a rule; rounds end when none does.
MIN_COUNT, MAX_ROUNDS = 3, 64
MIN_TOKENS = 60
# A grammar this small against its text, falling with the text's length as grammars of written code do.
REUSE_AT, REUSE_LENGTH, REUSE_POWER = 0.29, 200, -0.22
NAMED_REUSE = 1.25  # the same, by this factor, where the file's name says generated
LITERAL_SHARE, LITERAL_CHARS, LITERAL_DENSITY = 0.6, 300, 0.75
DATA_WORDS, DATA_WORD_SHARE = 12, 0.2  # a data file has no more words outside its literals than one of these
LAYOUT_SHARE, LINE_CHARS = 0.012, 250
RULE_LEVELS, RULE_TOKENS = 3, 8
SHARED, MIN_SHARED, MIN_REPOS = 0.75, 3, 2
CHUNK_CHARS = 4_000_000

_GENERATED_NAME = re.compile(r"(?i)(?:[._-](?:generated|autogen|gen|pb|g|designer)\.\w+|_pb2(?:_grpc)?\.py|\.min\.\w+|^zz_generated\..*)$")
_GENERATED_NOTICE = re.compile(
    r"(?i)<auto-?generated>|^\W*(?:this (?:file|code) (?:is|was|has been) )?(?:code |file |source |automatically |machine[- ])*(?:generated|created|written|produced|emitted|built)(?: automatically)? (?:by|from|with) (?:\S+ ){1,6}?.*"
    r"(?:do not (?:edit|modify|change)|regenerate|overwritten|will be lost|v\d)|\b(?:automatically|auto-?) ?(?:generated|created|written) by \S+|^\W*auto-?generated (?:file|code)\b|^\W*@generated\b|regenerate (?:it )?with\b|"
    r"manual (?:edits|changes) (?:are|will be) (?:overwritten|lost)|changes will be (?:lost|overwritten)|^\W*autogenerado por|generado autom\w+ por|\bno (?:modificar|editar)\W*$|automatisch (?:erzeugt|generiert|erstellt)|"
    r"nicht (?:bearbeiten|ändern)\W*$|généré (?:automatiquement )?par|ne pas (?:modifier|éditer)\W*$"
)
_QUOTED = re.compile(r"'[^'\n]*'|\"[^\"\n]*\"")
_VERSIONED = re.compile(r"^\W*([A-Za-z][\w.-]*) v?(\d+\.\d+(?:\.\d+)?)(?=\W|$)")
_AUTHORS = re.compile(r"(?i)(?:\(c\)|copyright|©)\s*(?:\(c\)\s*)?\d{4}(?:-\d{4})?,?\s+(?:by\s+)?(?:the\s+)?([\w.-]+)(?: (?:authors|contributors|developers|project))")
_PART_OF = re.compile(r"(?i)(?:this file is part of|(?:copied|vendored|imported|taken) (?:verbatim )?from|local copy of|fork of|mirror of)\s+(?:the\s+)?([A-Za-z][\w.-]*)(?: v?\d+\.\d|.*(?:local copy|upstream|licen[sc]e))")
_UPSTREAM = re.compile(r"(?i)\bupstream:\s*([A-Za-z][\w.-]*)")
_COMMENT = re.compile(r"\s*(?://|#|--|/?\*+|<!--|;|\"\"\"|''')")
_LIBRARY_PATH = re.compile(r"(?:^|/)(?:third_party|thirdparty|node_modules|external|externals|deps|vendor|vendored|contrib)/(?:@[\w.-]+/)?([A-Za-z]\w*)(?:[-@]v?\d[\w.]*)?/(?:(?:dist|lib|src|build)/)*\1(?:_impl|_core|[_.-]\w+)?\.\w+$")
_GENERIC_DIRS = frozenset("src lib test tests docs include internal core app pkg util tools".split())


_BLOCK = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}


def _head(text: str) -> list[str]:
    """The comment lines before any code, however many; lines within a block comment or a docstring need no sign of their own."""
    out = []
    at, close = 1 if text[:1] == "\ufeff" else 0, ""
    while at < len(text):
        end = text.find("\n", at)
        end = end if end >= 0 else len(text)
        if not close:
            sign = _COMMENT.match(text, at, end)
            opened = next((x for x in _BLOCK if sign and sign[0].lstrip().startswith(x)), None)
            if opened:
                close, start = _BLOCK[opened], sign.end() - len(sign[0].lstrip()) + len(opened)
            elif text[at:end].strip() and not text.startswith("#!", at):
                if not sign:
                    break
                out.append(text[at:end].strip())
        else:
            start = at
        if close:
            stop = text.find(close, start, end)
            line = text[at : stop if stop >= 0 else end].strip()
            if line:
                out.append(line)
            if stop >= 0:  # the rest of the line may be a comment as well
                at, close = stop + len(close), ""
                continue
        at = end + 1
    return out


def notice(repo: str, text: str) -> tuple[bool, bool]:
    """Whether the head says that a tool wrote the file; and that it belongs to something other than its repo."""
    made, foreign = False, False
    head = _head(text)
    for x in head:
        plain = _QUOTED.sub(" ", x)
        made = made or bool(_GENERATED_NOTICE.search(plain))
        for p in (_VERSIONED, _AUTHORS, _PART_OF, _UPSTREAM):
            m = p.search(plain)
            if m and m[1].lower() != "version" and m[1].lower() != repo.lower() and m[1].lower() not in repo.lower():
                foreign = foreign or p is not _VERSIONED or bool(re.search(r"(?i)licen[sc]e|upstream|\(c\)", " ".join(head)))
    return made, foreign


def tokenize(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Token ids and text numbers of all texts, and the vocabulary."""
    vocab: dict[str, int] = {}
    ids: list[int] = []
    sizes = []
    for t in texts:
        found = _TOKEN.findall(t)
        sizes.append(len(found))
        ids += [vocab.setdefault(x, len(vocab)) for x in found]
    return np.array(ids, dtype=np.int64), np.repeat(np.arange(len(texts)), sizes), list(vocab)


def classes(words: list[str]) -> np.ndarray:
    """The class of each word of the vocabulary: itself, or one number each for identifiers, numbers and strings."""
    n = len(words)
    out = np.arange(n, dtype=np.int64)
    for i, w in enumerate(words):
        c = w[0]
        if c in "\"'`":
            if len(w) > 1:
                out[i] = n
        elif len(w) >= 48:  # a run of encoded bytes without quotes, as in a here-document
            out[i] = n
        elif c.isdigit():
            out[i] = n + 1
        elif (c.isalpha() or c == "_") and w.lower() not in _KEYWORDS:
            out[i] = n + 2
    return out


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def repair(seq: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: symbols left in the start rule, and rules inferred, by Re-Pair on all texts side by side.

    A round replaces each digram that occurs at least MIN_COUNT times in its text and no less often than the
    digrams it overlaps; texts never influence each other.
    """
    rules = np.zeros(n_docs, dtype=np.int64)
    seq = seq.astype(np.uint64)
    for _ in range(MAX_ROUNDS):
        if len(seq) < 2:
            break
        d = doc[:-1].astype(np.uint64)
        key = (seq[:-1] * _M1) ^ (seq[1:] * _M2 + (d + np.uint64(1)) * _M3)
        _, where, counts = np.unique(key, return_inverse=True, return_counts=True)
        c = np.where(doc[1:] == doc[:-1], counts[where], 0)
        pick = c >= MIN_COUNT
        pick[1:] &= c[1:] > c[:-1]
        # the first of a run of equals is taken as well
        first = np.ones(len(c), dtype=bool)
        first[1:] = c[1:] != c[:-1]
        start = np.maximum.accumulate(np.where(first, np.arange(len(c)), 0))
        equal = (c >= MIN_COUNT) & ((np.arange(len(c)) - start) % 2 == 0)
        before = np.ones(len(c), dtype=bool)
        before[1:] = c[:-1] <= c[1:]
        pick = (pick | (equal & before[start])) & np.concatenate([c[1:] <= c[:-1], [True]])
        pick[1:] &= ~pick[:-1]
        at = np.flatnonzero(pick)
        if not len(at):
            break
        _, once = np.unique(key[at], return_index=True)
        rules += np.bincount(doc[at[once]], minlength=n_docs)
        seq[at] = key[at]
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        seq, doc = seq[keep], doc[keep]
    return np.bincount(doc, minlength=n_docs), rules


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def shared_rules(names: np.ndarray, doc: np.ndarray, n_docs: int) -> list[np.ndarray]:
    """Per text: names of the rules of RULE_LEVELS levels of content-chosen blocks, those of RULE_TOKENS tokens or more."""
    seq, width = _mix(names), np.ones(len(names), dtype=np.int64)
    for _ in range(RULE_LEVELS):
        if not len(seq):
            break
        h = _mix(seq * _M1)
        cut = np.ones(len(seq), dtype=bool)
        cut[1:] = doc[1:] != doc[:-1]
        inner = np.zeros(len(seq), dtype=bool)
        if len(seq) > 2:
            inner[1:-1] = (h[1:-1] < h[:-2]) & (h[1:-1] <= h[2:])
        cut |= inner
        starts = np.flatnonzero(cut)
        pos = (np.arange(len(seq)) - np.repeat(starts, np.diff(np.append(starts, len(seq))))).astype(np.uint64)
        seq = _mix(np.add.reduceat(_mix(seq + pos * _M3), starts))
        width = np.add.reduceat(width, starts)
        doc = doc[starts]
    ok = width >= RULE_TOKENS
    seq, doc = seq[ok].view(np.int64), doc[ok]
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    return [np.unique(seq[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def measure(repos: list[str], texts: list[str]) -> pd.DataFrame:
    """One row of measures per text."""
    n = len(texts)
    ids, doc, words = tokenize(texts)
    kind = classes(words)
    size = np.bincount(doc, minlength=n)
    chars = np.array([len(w) for w in words] or [0], dtype=np.int64)
    names = pd.util.hash_array(np.array(words or [""], dtype=object)).astype(np.uint64)
    if len(ids):
        left, rules = repair(kind[ids], doc, n)
        literal = (kind[ids] == len(words)) | (kind[ids] == len(words) + 1)
        line = np.array([w == "\n" for w in words])[ids]
        shape = np.where(line, 0, chars[ids])
        text_chars = np.bincount(doc, weights=shape, minlength=n)
        lit_chars = np.bincount(doc, weights=shape * literal, minlength=n)
        lines = np.bincount(doc, weights=line, minlength=n)
        dense = np.zeros(n)
        edges = np.searchsorted(doc, np.arange(n + 1))
        for t in np.flatnonzero((lit_chars >= LITERAL_CHARS) & (lit_chars >= LITERAL_SHARE * text_chars)):
            own = ids[edges[t] : edges[t + 1]][literal[edges[t] : edges[t + 1]]]
            dense[t] = density([words[k] for k in own])
        words_in = np.bincount(doc[~literal & ((kind[ids] == len(words) + 2) | np.array([w[0].isalpha() for w in words])[ids])], minlength=n)
        solid = ~line
        own, odoc = names[ids[solid]], doc[solid]
        found = shared_rules(own, odoc, n)
    else:
        left = rules = words_in = np.zeros(n, dtype=np.int64)
        text_chars = lit_chars = lines = dense = np.zeros(n)
        found = [np.array([], dtype=np.int64)] * n
    said = [notice(r or "", t) for r, t in zip(repos, texts, strict=True)]
    longest = np.array([len(t) / (t.count("\n") + 1) for t in texts])
    return pd.DataFrame(
        {
            "tokens": size, "words": words_in, "grammar": left + 2 * rules, "literal_share": lit_chars / np.maximum(text_chars, 1), "literal_chars": lit_chars.astype(np.int64),
            "literal_density": dense, "layout_share": lines / np.maximum(size, 1), "line_chars": longest,
            "says_generated": [a for a, _ in said], "says_foreign": [b for _, b in said], "rules": [list(map(int, x)) for x in found],
        }
    )


def density(literals: list[str]) -> float:
    """Compressed bits a character of the literals, against those that their alphabet could hold; 0 without literals."""
    joined = "".join(x.strip("\"'`") for x in literals)
    alphabet = len(set(joined))
    if alphabet < 2:
        return 0.0
    return 8 * len(zlib.compress(joined.encode("utf-8", "surrogatepass"), 6)) / len(joined) / math.log2(alphabet)


MEASURES = (
    "tokens long, words long, grammar long, literal_share double, literal_chars long, literal_density double, layout_share double, line_chars double, "
    "says_generated boolean, says_foreign boolean, rules array<long>"
)


def measures(texts: DataFrame) -> DataFrame:
    """(file, repo, measures) of texts (file, repo, text), in chunks of some CHUNK_CHARS characters; a longer text is a chunk of its own."""

    def run(batches):
        for pdf in batches:
            pdf = pdf[pdf["text"].notna()]
            size = pdf["text"].str.len().cumsum() // CHUNK_CHARS
            for _, part in pdf.groupby(size, sort=True):
                out = measure(part["repo"].tolist(), part["text"].tolist())
                out.insert(0, "repo", part["repo"].tolist())
                out.insert(0, "file", part["file"].tolist())
                yield out

    return texts.select("file", "repo", "text").mapInPandas(run, f"file string, repo string, {MEASURES}")


def verdicts(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """(file, repo, generated, minified, vendored, data, signals): what each text (file, repo, text) is, and what tells it.

    NULL texts are left out; empty texts and those of fewer than MIN_TOKENS tokens are judged by their notice and
    literals only. Repeated rows give repeated rows. A rule counts as shared once two repos hold it; rows of a
    rule that half of all files hold are counted by partial aggregates and never gathered.
    """
    scratch = Scratch(spark, "provenance")
    m = scratch.write(measures(texts), "measures")
    per_rule = m.select("repo", F.explode("rules").alias("rule")).distinct().groupBy("rule").agg(F.count("*").alias("repos")).where(F.col("repos") >= MIN_REPOS)
    held = m.select(F.xxhash64("file").alias("key"), F.explode("rules").alias("rule")).distinct()
    shared = held.join(per_rule.select("rule"), "rule", "left_semi").groupBy("key").agg(F.count("*").alias("shared"))
    m = m.withColumn("key", F.xxhash64("file")).join(shared, "key", "left")
    size = F.greatest(F.col("tokens"), F.lit(1))
    limit = F.lit(REUSE_AT) * F.pow(size / REUSE_LENGTH, F.lit(REUSE_POWER))
    name = F.element_at(F.split("file", "/"), -1)
    named = name.rlike(_GENERATED_NAME.pattern)
    reuse = F.col("grammar") / size
    library = F.regexp_extract("file", _LIBRARY_PATH.pattern, 1)
    blob = (F.col("literal_share") >= LITERAL_SHARE) & (F.col("literal_chars") >= LITERAL_CHARS) & (F.col("literal_density") >= LITERAL_DENSITY) & (F.col("words") <= F.greatest(F.lit(DATA_WORDS), size * DATA_WORD_SHARE))
    signals = {
        "grammar": (F.col("tokens") >= MIN_TOKENS) & (reuse < F.when(named, limit * NAMED_REUSE).otherwise(limit)), "layout": (F.col("tokens") >= MIN_TOKENS) & (F.col("layout_share") < LAYOUT_SHARE) & (F.col("line_chars") > LINE_CHARS),
        "literals": blob, "shared rules": (F.coalesce("shared", F.lit(0)) >= MIN_SHARED) & (F.coalesce("shared", F.lit(0)) >= SHARED * F.size("rules")),
        "tool's notice": F.col("says_generated"), "library's notice": F.col("says_foreign"), "library's path": (library != "") & ~library.isin(*_GENERIC_DIRS),
    }
    m = m.select("file", "repo", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in signals.items()])
    return m.select(
        "file", "repo", (F.col("grammar") | F.col("tool's notice")).alias("generated"), F.col("layout").alias("minified"),
        (F.col("shared rules") | F.col("library's notice") | F.col("library's path")).alias("vendored"), F.col("literals").alias("data"),
        F.array_join(F.filter(F.array(*[F.when(F.col(k), F.lit(k)) for k in signals]), lambda x: x.isNotNull()), ", ").alias("signals"),
    )


def p5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source file with what it is."""
    texts = sources(spark, sf_dir).where("language <> 'Other'").select("file", "repo", "text")
    return verdicts(spark, texts).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_files(spark, sf_dir).where("generated OR minified OR vendored OR data").select("file").distinct()


QUERIES = {"p5_found": p5_found, "p5_files": p5_files}
SQL: dict = {}
