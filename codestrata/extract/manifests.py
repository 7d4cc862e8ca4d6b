"""Declarations in other files: dependencies, container stages, schemas, services and infrastructure."""

from __future__ import annotations

import json
import re
import tomllib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPENDENCY = "file string, ecosystem string, name string, version string, scope string"


def _toml(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return {}


def _json(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return {}


def cargo(text: str) -> list[tuple[str, str, str]]:
    """(name, version, scope); entries by path alone are left out."""
    doc, out = _toml(text), []
    tables = [(s, doc.get(s, {})) for s in ("dependencies", "dev-dependencies", "build-dependencies")] + [("workspace", doc.get("workspace", {}).get("dependencies", {}))]
    for scope, deps in tables:
        for name, spec in deps.items() if isinstance(deps, dict) else ():
            version = spec if isinstance(spec, str) else spec.get("version") if isinstance(spec, dict) else None
            if version or isinstance(spec, dict) and ("git" in spec or spec.get("workspace")):
                out.append((name, version or "", scope))
    return out


def npm(text: str) -> list[tuple[str, str, str]]:
    doc, out = _json(text), []
    for scope in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
        deps = doc.get(scope, {}) if isinstance(doc, dict) else {}
        for name, spec in deps.items() if isinstance(deps, dict) else ():
            if isinstance(spec, str) and not spec.startswith(("file:", "link:", "workspace:")):
                out.append((name, spec, scope))
    return out


_REQ = re.compile(r"^([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]]*\])?\s*([^;#@]*)")


def requirements(text: str) -> list[tuple[str, str, str]]:
    out = []
    for x in text.splitlines():
        x = x.split(" #")[0].strip()
        if x and not x.startswith(("#", "-")) and (m := _REQ.match(x)):
            out.append((m[1], m[2].strip(), "dependencies"))
    return out


def pyproject(text: str) -> list[tuple[str, str, str]]:
    doc, out = _toml(text), []
    for x in doc.get("project", {}).get("dependencies", []):
        if isinstance(x, str) and (m := _REQ.match(x.strip())):
            out.append((m[1], m[2].strip(), "dependencies"))
    for name, spec in doc.get("tool", {}).get("poetry", {}).get("dependencies", {}).items():
        if name.lower() != "python":
            out.append((name, spec if isinstance(spec, str) else spec.get("version", "") if isinstance(spec, dict) else "", "dependencies"))
    return out


def go_mod(text: str) -> list[tuple[str, str, str]]:
    out, block = [], False
    for x in text.splitlines():
        s = x.strip()
        if re.match(r"require\s*\($", s):
            block = True
        elif s == ")":
            block = False
        elif "// indirect" not in s and (m := re.match(r"(?:require\s+)?([\w./~-]+\.[\w./~-]+)\s+(v\S+)", s)) and (block or s.startswith("require")):
            out.append((m[1], m[2], "require"))
    return out


def composer(text: str) -> list[tuple[str, str, str]]:
    doc, out = _json(text), []
    for scope in ("require", "require-dev"):
        deps = doc.get(scope, {}) if isinstance(doc, dict) else {}
        out += [(n, v, scope) for n, v in (deps.items() if isinstance(deps, dict) else ()) if isinstance(v, str) and "/" in n]
    return out


MANIFESTS = {"Cargo.toml": ("cargo", cargo), "package.json": ("npm", npm), "requirements.txt": ("pip", requirements), "pyproject.toml": ("pip", pyproject), "go.mod": ("go", go_mod), "composer.json": ("composer", composer)}


def _rows(texts: DataFrame, schema: str, fn) -> DataFrame:
    columns = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [(f, *r) for f, t in zip(pdf["file"].tolist(), pdf["text"].tolist(), strict=True) if t is not None for r in fn(f, t)]
            yield pd.DataFrame(rows, columns=columns)

    return texts.select("file", "text").mapInPandas(run, schema)


def dependencies(texts: DataFrame) -> DataFrame:
    """All declared dependencies of the manifests among `texts` (file, text); a manifest that does not parse declares none."""

    def one(file, text):
        eco, fn = MANIFESTS[file.rsplit("/", 1)[-1]]
        return [(eco, *r) for r in fn(text)]

    named = F.element_at(F.split("file", "/"), -1).isin(*MANIFESTS)
    return _rows(texts.where(named), DEPENDENCY, one)


def docker_stages(file: str, text: str) -> list[tuple]:
    """(stage, name, base, from_stage): stages in order, and the earlier stages they copy from (one row each, or one without)."""
    joined = re.sub(r"\\\s*\n", " ", text)
    stages: list[dict] = []
    for x in joined.splitlines():
        if m := re.match(r"(?i)^\s*FROM\s+(?:--\S+\s+)*(\S+)(?:\s+AS\s+(\S+))?", x):
            stages.append({"base": m[1], "name": m[2], "from": []})
        elif stages and (m := re.match(r"(?i)^\s*COPY\s+.*--from=(\S+)", x)):
            earlier = {s["name"].lower(): i for i, s in enumerate(stages[:-1]) if s["name"]} | {str(i): i for i in range(len(stages) - 1)}
            if m[1].lower() in earlier:
                stages[-1]["from"].append(earlier[m[1].lower()])
    for i, s in enumerate(stages):
        early = {t["name"].lower(): k for k, t in enumerate(stages[:i]) if t["name"]}
        if s["base"].lower() in early:
            s["from"].append(early[s["base"].lower()])
    return [(i, s["name"], s["base"], f) for i, s in enumerate(stages) for f in (sorted(set(s["from"])) or [None])]


_DDL = re.compile(r"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:(?:global|local)\s+)?(?:temp(?:orary)?\s+)?(?:materialized\s+)?(table|view|function|procedure)\s+(?:if\s+not\s+exists\s+)?([\w.\"`\[\]]+)")


def sql_objects(file: str, text: str) -> list[tuple]:
    """(kind, name, line); a file with template braces is one view named after it."""
    if "{{" in text:
        return [("view", file.rsplit("/", 1)[-1].rsplit(".", 1)[0], 1)]
    plain = re.sub(r"--[^\n]*|/\*[\s\S]*?\*/|'(?:[^']|'')*'", lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    return [(m[1].lower(), re.sub(r'["`\[\]]', "", m[2]), plain.count("\n", 0, m.start()) + 1) for m in _DDL.finditer(plain)]


def dbt_lineage(file: str, text: str) -> list[tuple]:
    """(kind, target, line) of references to models and sources, each within its line."""
    out = []
    for n, x in enumerate(text.split("\n"), 1):
        out += [("ref", m[1], n) for m in re.finditer(r"\{\{\s*ref\(\s*['\"]([^'\"]+)['\"]\s*\)\s*\}\}", x)]
        out += [("source", f"{m[1]}.{m[2]}", n) for m in re.finditer(r"\{\{\s*source\(\s*['\"]([^'\"]+)['\"]\s*,\s*['\"]([^'\"]+)['\"]\s*\)\s*\}\}", x)]
    return out


METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


_YAML_PAIR = re.compile(r"""^(['"]?)((?:(?!\1)[^:]|:(?=\S))+?|[^'"]+?)\1\s*:(?:\s+(.*?)|)\s*$""")


def _yaml(text: str):
    """Mappings, lists and plain scalars by indentation, which is what service descriptions need here."""
    lines = []
    for x in text.splitlines():
        body = re.sub(r"\s+#.*$", "", x).rstrip()
        if body.strip() and not body.lstrip().startswith(("#", "---")):
            lines.append((len(body) - len(body.lstrip()), body.strip()))

    def plain(v: str):
        return v.strip("'\"")

    def block(at: int, depth: int):
        """The value that begins at a line of some depth, and the line behind it."""
        out = [] if lines[at][1] == "-" or lines[at][1].startswith("- ") else {}
        while at < len(lines) and lines[at][0] == depth:
            body = lines[at][1]
            is_item = body == "-" or body.startswith("- ")
            if is_item != isinstance(out, list):
                break
            if is_item:
                rest = body[1:].lstrip()
                if _YAML_PAIR.match(rest):  # a mapping whose first pair stands behind the hyphen
                    lines[at] = (depth + len(body) - len(rest), rest)
                    value, at = block(at, lines[at][0])
                else:
                    at += 1
                    value = plain(rest)
                    if not rest and at < len(lines) and lines[at][0] > depth:
                        value, at = block(at, lines[at][0])
                out.append(value)
                continue
            m = _YAML_PAIR.match(body)
            at += 1
            if not m:
                continue
            value = plain(m[3] or "")
            if not m[3] and at < len(lines) and (lines[at][0] > depth or lines[at][0] == depth and lines[at][1].startswith("-")):
                value, at = block(at, lines[at][0])
            out[plain(m[2])] = value if m[3] or not isinstance(value, str) else {}
        while at < len(lines) and lines[at][0] > depth:
            at += 1  # deeper lines that belong to nothing
        return out, at

    return block(0, lines[0][0])[0] if lines else {}


def openapi(file: str, text: str) -> list[tuple]:
    """(kind, name, detail): endpoints `METHOD /path` and schemas with their sorted properties."""
    doc = _json(text) if text.lstrip().startswith("{") else _yaml(text)
    if not isinstance(doc, dict) or not ("openapi" in doc or "swagger" in doc):
        return []
    out = [("endpoint", f"{m.upper()} {p}", str(op.get("operationId", "")) if isinstance(op, dict) else "") for p, ops in (doc.get("paths") or {}).items() if isinstance(ops, dict) for m, op in ops.items() if m in METHODS]
    schemas = (doc.get("components") or {}).get("schemas") or doc.get("definitions") or {}
    return out + [("schema", n, ",".join(sorted((s.get("properties") or {}) if isinstance(s, dict) else ()))) for n, s in schemas.items()]


def _strip(text: str, hashes: bool = False) -> str:
    return re.sub(r"//[^\n]*|/\*[\s\S]*?\*/" + (r"|#[^\n]*" if hashes else ""), lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _block(text: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(text)


def _top(text: str, pattern: str):
    """Matches of the pattern outside of all braces, each with its block."""
    p, at = re.compile(pattern), 0
    while m := p.search(text, at):
        if text.count("{", 0, m.start()) == text.count("}", 0, m.start()):
            end = _block(text, m.end() - 1)
            yield m, text[m.end() : end - 1]
            at = end
        else:
            at = m.end()


def protobuf(file: str, text: str) -> list[tuple]:
    """(kind, name, detail): top-level messages with their fields, services, and calls with what they take and give."""
    plain, out = _strip(text), []
    for m, body in _top(plain, r"\b(message|service)\s+(\w+)\s*\{"):
        if m[1] == "message":
            flat = re.sub(r"\b(?:message|enum)\s+\w+\s*\{[^{}]*\}", "", body)
            out.append(("message", m[2], ",".join(re.findall(r"(\w+)\s*=\s*\d+", flat))))
        else:
            out.append(("service", m[2], ""))
            out += [("rpc", f"{m[2]}.{r[1]}", f"{r[2].strip()} -> {r[3].strip()}") for r in re.finditer(r"\brpc\s+(\w+)\s*\(([^)]*)\)\s*returns\s*\(([^)]*)\)", body)]
    return out


def graphql(file: str, text: str) -> list[tuple]:
    """(kind, name, detail): types with their fields; each field of a root type is an operation."""
    plain = re.sub(r'"""[\s\S]*?"""|#[^\n]*', lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    out = []
    for m, body in _top(plain, r"\b(?:extend\s+)?(type|interface|input|enum)\s+(\w+)[^{}]*\{"):
        bare = re.sub(r"\([^)]*\)", "", body)
        fields = re.findall(r"\w+" if m[1] == "enum" else r"(\w+)\s*:", bare)
        if m[2] in ("Query", "Mutation", "Subscription"):
            out += [(m[2].lower(), f, "") for f in fields]
        else:
            out.append((m[1], m[2], ",".join(fields)))
    return out


def terraform(file: str, text: str) -> list[tuple]:
    """(kind, type, name) of top-level resources and modules."""
    plain = _strip(text, True)
    return [(m[1], m[2] if m[1] == "resource" else "", m[3] if m[1] == "resource" else m[2]) for m, _ in _top(plain, r'\b(resource|module)\s+"([^"]+)"(?:\s+"([^"]+)")?\s*\{') if m[1] == "module" or m[3]]


READERS = {
    "docker": (docker_stages, "file string, stage int, name string, base string, from_stage int", r"(?i)(?:^|/)(?:dockerfile(?:\.[^/]*)?|[^/]*\.dockerfile)$"),
    "sql": (sql_objects, "file string, kind string, name string, line int", r"(?i)\.sql$"),
    "dbt": (dbt_lineage, "file string, kind string, target string, line int", r"(?i)\.sql$"),
    "openapi": (openapi, "file string, kind string, name string, detail string", r"(?i)\.(?:json|ya?ml)$"),
    "protobuf": (protobuf, "file string, kind string, name string, detail string", r"(?i)\.proto$"),
    "graphql": (graphql, "file string, kind string, name string, detail string", r"(?i)\.(?:graphql|gql)$"),
    "terraform": (terraform, "file string, kind string, type string, name string", r"(?i)\.tf$"),
}


def declared(texts: DataFrame, what: str) -> DataFrame:
    """Rows of one of READERS for the files whose names it reads."""
    fn, schema, names = READERS[what]
    return _rows(texts.where(F.col("file").rlike(names)), schema, fn)


def lineage(references: DataFrame, objects: DataFrame) -> DataFrame:
    """(file, kind, target, to_file): references by name; of several objects of a name the last file holds, references to oneself stay unresolved."""
    last = objects.groupBy("name").agg(F.max("file").alias("to_file"))
    x = references.join(last, references.target == last.name, "left")
    return x.select("file", "kind", "target", F.when(F.col("to_file") != F.col("file"), F.col("to_file")).alias("to_file"))


def module_paths(file, language):
    """A file's module path by its language: dots below the source root for Python and the JVM, `::` for Rust, folders for Go, C# and PHP."""
    inner = F.regexp_replace(file, r"^[^/]*/", "")
    bare = F.regexp_replace(inner, r"\.[^./]*$", "")
    jvm = F.regexp_replace(F.regexp_replace(bare, r"^(?:.*/)?src/main/(?:java|kotlin|scala)/", ""), "/", ".")
    py = F.regexp_replace(F.regexp_replace(bare, r"/?__init__$", ""), "/", ".")
    rust = F.concat(F.lit("crate"), F.when(F.regexp_replace(bare, r"^(?:.*/)?src/|/?(?:mod|lib|main)$", "") == "", "").otherwise(F.concat(F.lit("::"), F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"^(?:.*/)?src/", ""), r"/(?:mod|lib|main)$|^(?:mod|lib|main)$", ""), "/", "::"))))
    folder = F.regexp_replace(inner, r"/?[^/]*$", "")
    return (
        F.when(language == "Python", py).when(language.isin("Java", "Kotlin", "Scala"), jvm).when(language == "Rust", rust).when(language == "Go", folder)
        .when(language == "CSharp", F.regexp_replace(folder, "/", ".")).when(language == "Php", F.regexp_replace(folder, "/", r"\\\\"))
    )


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(file, path, line, to_file): each import's longest leading part that is a module of its language.

    imports: file, language, path, line; modules: language, module, file. JVM languages share one map; of several
    files of a module the last by name holds. A trailing `*` is cut first. Prefixes are exploded and joined by equality.
    """
    family = lambda c: F.when(F.col(c).isin("Java", "Kotlin", "Scala"), "jvm").otherwise(F.col(c))
    clean = F.regexp_replace("path", r"(?:::|\.|/|\\)\*$", "")
    sep = F.when(F.contains(clean, F.lit("::")), F.lit("::")).when(F.contains(clean, F.lit("\\")), F.lit("\\")).when(F.contains(clean, F.lit("/")), F.lit("/")).otherwise(F.lit("."))
    x = imports.select("file", "path", "line", family("language").alias("family"), clean.alias("c"), sep.alias("sep"))
    parts = F.when(F.col("sep") == "::", F.split("c", "::")).when(F.col("sep") == "\\", F.split("c", r"\\")).when(F.col("sep") == "/", F.split("c", "/")).otherwise(F.split("c", r"\."))
    x = x.select("*", F.explode(F.array(parts)).alias("parts"))
    x = x.select("file", "path", "line", "family", "sep", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("n"))
    x = x.withColumn("module", F.expr("array_join(slice(parts, 1, n), sep)"))
    last = modules.select(family("language").alias("family"), "module", F.col("file").alias("to_file")).groupBy("family", "module").agg(F.max("to_file").alias("to_file"))
    hit = x.join(last, ["family", "module"]).where("to_file <> file").groupBy("file", "path", "line").agg(F.max(F.struct("n", "to_file")).alias("m"))
    return imports.join(hit, ["file", "path", "line"], "left").select("file", "path", "line", F.col("m.to_file").alias("to_file"))
