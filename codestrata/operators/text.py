"""Line-wise reading of texts: secrets, distillation of output, decisions and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The signatures of known credentials and what marks a value as a placeholder.
SIGNATURES = {
    "aws-access-key-id": r"\bAKIA[0-9A-Z]{16}\b",
    "private-key-block": r"-----BEGIN (RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----",
    "github-token": r"\bgh[pousr]_[A-Za-z0-9]{36}\b",
    "slack-token": r"\bxox[baprs]-[A-Za-z0-9-]{10,48}\b",
}
ASSIGNMENT = r"""(?i)\b(?:api[_-]?key|secret[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret|private[_-]?key|password|passwd)\s*[:=]\s*["']([^"'\s]{16,})["']"""
PLACEHOLDERS = ("example", "changeme", "change_me", "your_", "your-", "xxx", "todo", "fixme", "placeholder", "dummy", "sample", "insert_", "replace_", "<", "fake", "test_secret", "notasecret", "not-a-secret")
# What a reader of a command's output must see.
ERROR_MARKERS = ("error", "err!", "failed", "failure", "fail:", "fatal", "panic", "exception", "traceback", "assert", "cannot", "can't", "unable to", "not found", "denied", "refused", "timed out", "timeout",
                 "warning", "warn:", "abort", "segmentation fault", "undefined reference", "unresolved")
SUMMARY_MARKERS = ("test result:", "tests passed", "tests failed", "passed;", " passed,", " failed,", "summary", "total:", "finished in", "compiling", "built in", "exit code")
MIN_LINES = 20
# Words that tell of a decision.
DECISION_WORDS = ("decide", "decision", "chose", "chosen", "switch to", "adopt", "instead of", "migrate", "replace", "deprecate", "drop", "rewrite", "split", "revert", "opt for", "in favor of", "settle on",
                  "consolidate", "standardize on")
INLINE_MARKERS = ("WHY", "DECISION", "TRADEOFF", "ADR", "RATIONALE", "REJECTED")


def any_of(words) -> str:
    return "|".join(w.replace("\\", "\\\\").replace("(", r"\(").replace(".", r"\.").replace("!", "!") for w in words)


def lines_of(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, content) of each line, from 1; a NULL text has none. A final line break opens no line."""
    parts = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    return texts.where(F.col(text).isNotNull() & (F.col(text) != "")).select(key, F.posexplode(parts).alias("i", "content")).select(key, (F.col("i") + 1).alias("line"), F.regexp_replace("content", r"\r\z", "").alias("content"))


def is_placeholder(value: Column) -> Column:
    return F.lower(value).rlike(any_of(PLACEHOLDERS)) | value.rlike(r"^(.)\1*$")


def secret_scan(texts: DataFrame, key: str) -> DataFrame:
    """(key, line, kind): one finding per line and signature, and assignments whose value is not a placeholder. The secret itself is not returned."""
    hint = F.col("text").rlike("|".join(["AKIA", "PRIVATE KEY", r"\bgh[pousr]_", "xox", "(?i)key", "(?i)token", "(?i)secret", "(?i)passw"]))
    x = lines_of(texts.where(hint), key)
    value = F.regexp_extract("content", ASSIGNMENT, 1)
    kinds = [F.when(F.col("content").rlike(p), F.lit(k)) for k, p in SIGNATURES.items()] + [F.when((value != "") & ~is_placeholder(value), F.lit("suspicious-assignment"))]
    return x.select(key, "line", F.explode(F.filter(F.array(*kinds), lambda k: k.isNotNull())).alias("kind"))


def must_keep(line: Column) -> Column:
    return F.lower(line).rlike(any_of(ERROR_MARKERS + SUMMARY_MARKERS))


def is_noise(line: Column) -> Column:
    t = F.trim(line)
    low = F.lower(t)
    return (t == "") | t.rlike(r"^[.o=\-# ]{3,}$") | low.rlike(r"^test .* \.\.\. ok$") | (low == "ok") | low.rlike(r"^pass(ed)? ")


def distill(texts: DataFrame, key: str, noise=is_noise) -> DataFrame:
    """(key, line, content, kept): every line of each text and whether it stays.

    Texts of fewer than MIN_LINES lines stay whole; else a line stays if it must, or is no noise.
    """
    x = lines_of(texts, key)
    n = texts.select(F.col(key).alias("_k"), F.size(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("_n")).distinct()
    x = x.join(n, x[key] == n["_k"]).drop("_k")
    return x.select(key, "line", "content", ((F.col("_n") < MIN_LINES) | must_keep(F.col("content")) | ~noise(F.col("content"))).alias("kept"))


def rendered(distilled: DataFrame, key: str) -> DataFrame:
    """(key, text): the lines that stayed, with a last line that tells how many are gone, unless that would not be shorter."""
    g = distilled.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line", "content", "kept"))).alias("x"))
    kept = F.filter("x", lambda v: v["kept"])
    gone = F.size("x") - F.size(kept)
    whole = F.array_join(F.transform("x", lambda v: v["content"]), "\n")
    short = F.concat(F.array_join(F.transform(kept, lambda v: v["content"]), "\n"), F.lit("\n["), gone.cast("string"), F.lit(" lines left out]"))
    return g.select(key, F.when((gone > 0) & (F.length(short) < F.length(whole)), short).otherwise(whole).alias("text"))


def approx_tokens(n_bytes: Column) -> Column:
    return F.floor(n_bytes / 4)


def is_decision(text: Column, words=DECISION_WORDS) -> Column:
    return F.coalesce(F.lower(text).rlike(any_of(words)), F.lit(False))


def issue_refs(text: Column) -> Column:
    """Numbers of the issues a text names as `#n`, each once, where neither letter nor digit touches it."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}])#(\d+)(?![\p{L}\p{N}])"), F.lit(1)), lambda x: x.cast("long"))))


def owner_repo(url: Column) -> Column:
    """`owner/repo` of a hosted repository's https or ssh address; NULL for others."""
    m = F.regexp_extract(url, r"github\.com[:/]([^/\s]+/[^/\s]+?)(?:\.git)?/?$", 1)
    return F.when(m != "", m)


def inline_markers(texts: DataFrame, key: str) -> DataFrame:
    """(key, line, marker, text): comment lines that begin with one of INLINE_MARKERS and a colon."""
    p = r"^\s*(?://+|#+|--|/?\*+|;+)\s*(" + "|".join(INLINE_MARKERS) + r"):\s*(.*\S)\s*$"
    x = lines_of(texts.where(F.col("text").rlike("|".join(f"{m}:" for m in INLINE_MARKERS))), key).where(F.col("content").rlike(p))
    return x.select(key, "line", F.regexp_extract("content", p, 1).alias("marker"), F.regexp_extract("content", p, 2).alias("text"))


COMMENT = r"^\s*(?://|#(?!include|!)|--|/?\*|\*/)"


def comment_blocks(texts: DataFrame, symbols: DataFrame, key: str = "file") -> DataFrame:
    """(id, from_line, text): the comment lines that stand directly above each symbol, as one text.

    Comment lines form islands (line less rank); the one that ends above the symbol's first line is its own.
    """
    x = lines_of(texts, key).where(F.col("content").rlike(COMMENT))
    w = Window.partitionBy(key).orderBy("line")
    x = x.withColumn("island", F.col("line") - F.row_number().over(w)).groupBy(key, "island").agg(F.array_sort(F.collect_list(F.struct("line", "content"))).alias("x"))
    x = x.select(key, F.col("x")[0]["line"].alias("from_line"), F.element_at("x", -1)["line"].alias("to_line"), F.array_join(F.transform("x", lambda v: F.trim(F.regexp_replace(v["content"], r"^\s*(?://+|#+|--|/?\*+/?)", ""))), " ").alias("text"))
    return symbols.select("id", key, "start_line").join(x, key).where("start_line = to_line + 1").select("id", "from_line", "text")


def sections(texts: DataFrame, key: str, heading: str = r"^(#{1,6})\s+(.*\S)\s*$") -> DataFrame:
    """(key, line, level, title, body): each heading with the lines down to the next one; what stands before the first is left out."""
    x = lines_of(texts, key)
    h = F.col("content").rlike(heading)
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("head", F.last(F.when(h, F.col("line")), ignorenulls=True).over(w)).where("head IS NOT NULL")
    g = x.groupBy(key, "head").agg(F.array_sort(F.collect_list(F.struct("line", "content"))).alias("x"))
    first = F.col("x")[0]["content"]
    body = F.array_join(F.transform(F.slice("x", F.lit(2), F.size("x")), lambda v: v["content"]), "\n")
    return g.select(key, F.col("head").alias("line"), F.length(F.regexp_extract(first, heading, 1)).alias("level"), F.regexp_extract(first, heading, 2).alias("title"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))


def decision_files(texts: DataFrame, key: str) -> DataFrame:
    """(key, number, title, status, date, superseded_by): records of the form `# n. Title` with a last `Status:` and a last `Date:` line; titles in angle brackets are templates."""
    head = r"(?m)^# *(?:ADR[- ]?)?(\d+)[.:]\s*(.*\S)\s*$"
    status = F.element_at(F.regexp_extract_all("text", F.lit(r"(?m)^Status: *(.*\S) *$"), F.lit(1)), -1)
    date = F.element_at(F.regexp_extract_all("text", F.lit(r"(?m)^Date: *(.*\S) *$"), F.lit(1)), -1)
    x = texts.where(F.col("text").rlike(head)).select(key, F.regexp_extract("text", head, 1).cast("int").alias("number"), F.regexp_extract("text", head, 2).alias("title"), F.when(F.col("text").rlike(r"(?m)^Status: *\S"), status).alias("status"), F.when(F.col("text").rlike(r"(?m)^Date: *\S"), date).alias("date"))
    by = F.regexp_extract("status", r"(?i)superseded by[^0-9]*(\d+)", 1)
    return x.where("title NOT LIKE '<%'").withColumn("superseded_by", F.when(by != "", by.cast("int")))


CHANGE_SECTIONS = ("changed", "removed", "deprecated", "security")  # fixed values: sections of a changelog that hold decisions


def changelog_decisions(texts: DataFrame, key: str) -> DataFrame:
    """(key, line, title, body): each section of a changelog, headed `### `, on what was changed, removed, deprecated or secured, down to the next heading."""
    x = sections(texts, key).where((F.col("level") == 3) & F.lower("title").isin(*CHANGE_SECTIONS))
    kept = F.filter(F.transform(F.split("body", "\n"), F.trim), lambda v: v != "")
    return x.select(key, "line", F.concat(F.initcap("title"), F.lit(": "), F.coalesce(F.get(kept, F.lit(0)), F.lit(""))).alias("title"), F.array_join(kept, "\n").alias("body"))


CONFIDENCE_ORDER = ("inferred", "readme", "comment", "changelog", "commit", "pull-request", "inline-marker", "manual", "decision-file")


def confidence(source: Column) -> Column:
    """0.4 to 0.9 by how directly a source states a decision; NULL for unknown ones."""
    out = F.lit(None).cast("double")
    for rank, name in enumerate(CONFIDENCE_ORDER):
        out = F.when(source == name, F.least(F.lit(0.4 + 0.5 * rank / len(CONFIDENCE_ORDER)), F.lit(0.99))).otherwise(out)
    return out


SOURCES = ("decision-file", "commit", "pull-request", "comment", "inline-marker", "changelog", "readme", "inferred", "manual")


def decisions(mined: dict[str, DataFrame]) -> DataFrame:
    """(id, title, source, confidence): the decisions (id, title) of each of SOURCES that is given, in that order."""
    if unknown := set(mined) - set(SOURCES):
        raise ValueError(f"no such sources: {sorted(unknown)}")
    out = None
    for source in (s for s in SOURCES if s in mined):
        one = mined[source].select(F.col("id").cast("string").alias("id"), "title", F.lit(source).alias("source"), F.round(confidence(F.lit(source)), 4).alias("confidence"))
        out = one if out is None else out.unionByName(one)
    return out


def link_decisions(decisions: DataFrame, names: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(id, target): decisions (id, body), the names (name, target) they mention as whole words of four letters or more, and the paths (path, target) of four or more that they hold.

    Words are exploded and joined by equality, a path by the first word of its last part, and only then looked for in
    full; no text is compared with every name. A path without directories must begin a word.
    """
    word = decisions.select("id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("name"))
    out = word.join(names.where(F.length("name") >= 4).select("name", "target"), "name").select("id", "target")
    if paths is not None:
        by = paths.where(F.length("path") > 3).select("path", "target", F.regexp_extract("path", r"([\p{L}\p{N}_]+)[^/]*$", 1).alias("name")).where("name <> ''")
        near = word.join(by, "name").select("id", "path", "target").distinct()
        out = out.unionByName(near.join(decisions.select("id", "body"), "id").where(F.contains("body", F.col("path"))).select("id", "target"))
    return out.distinct()
