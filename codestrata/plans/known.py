"""Small inputs whose results are known, written down by hand, for operators whose sources the tables do not hold: texts of code, manifests, schemas, reports, logs, blame, diffs.

Each query reads its input from here and not from the tables; its SQL lists the rows that must come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.extract import manifests as X
from codestrata.extract.run import extracted, table_of
from codestrata.operators import contracts, coverage, domains, health, ledger, refactor, text
from codestrata.session import Scratch
from codestrata.sources import git, reports, sinks
from codestrata.sources.languages import language, line_count

PYTHON = '''import os
from . import sib
import pandas as pd

class A:
    def m(self, a: int, b: str, c: bool):
        "doc"
        self.x = a
        if a and b and c or os.sep:
            for i in b:
                for j in b:
                    print(self.x)
        return helper(a)

def helper(a, *rest, k=1):
    out = ""
    seen = []
    for r in rest:
        out += r
        if r in seen:
            continue
        f.read()
        x = json.loads(r)
        re.compile(r)
        seen.insert(0, r)
        df = pd.concat([df, r])
        pool = Pool(3)
        while lock.acquire():
            f.write(r)
    with my_lock:
        f.readline()
    sql = "SELECT * FROM a, b, c WHERE a.x = b.x"
    return out

async def go(xs):
    time.sleep(1)
    for x in xs:
        await fetch(x)
    for x in xs:
        await gather(x)
'''

RUST = '''use std::fs;

async fn go(items: &Vec<u32>, names: Vec<String>) -> u32 {
    let mut seen = Vec::new();
    let text = fs::read_to_string("a").await;
    fs::write("a", "b");
    if a && b && c || d {
        return 1;
    }
    for x in items.iter() {
        for y in items {
            file.read_line(&mut buf);
        }
        if seen.contains(x) { continue; }
        seen.insert(0, x);
        out.push_str("x");
        total += 1;
        let c = Client::new();
        let re = Regex::new("x");
        let v: u32 = serde_json::from_str("1");
        state.lock();
        fetch(x).await;
        join_all(x).await;
        let f = |z| { file.recv() };
    }
    let guard = m.lock().unwrap();
    db.execute("SELECT * FROM a, b, c WHERE a.x = b.x");
    4
}

fn quiet(xs: Vec<u32>) -> u32 {
    let set = HashSet::new();
    for x in xs { set.contains(x); }
    // for y in xs { file.read_line() }
    0
}
'''

TYPESCRIPT = '''export async function go(items: string[]): Promise<number> {
    const known = ["a"];
    const open = new Set(known);
    for (const x of items) {
        if (known.includes(x) || open.has(x)) continue;
        const y = JSON.parse(x);
        const p = new Pool(3);
        const r = new RegExp(x);
        text += x;
        await fetch(x);
        await Promise.all(x);
        lock.acquire();
        while (a && b && c && d) {
            db.query("select 1 from t1, t2");
        }
        items.forEach((q) => { readFile(q); });
    }
    for (let i = 0; i < 3; i++) for (const z of items) { n = n + 1; }
    do { step(); } while (open);
    readFileSync("x");
    return items.reduce((acc, x) => [...acc, x], []);
}

function quiet(xs) {
    return xs.reduce((acc, x) => acc.concat(x), []).filter((x) => x > 1);
}
'''

GO = """package a

func run(items []string) {
	for _, x := range items {
		defer close(x)
		go work(x)
	}
}
"""

TEXTS = [("k/a.py", "Python", PYTHON), ("k/a.rs", "Rust", RUST), ("k/a.ts", "TypeScript", TYPESCRIPT), ("k/a.go", "Go", GO), ("k/none.txt", "Other", "for"), ("k/null.py", "Python", None)]
HOT = "k/a.rs"

# (file, symbol, line, kind, detail)
FINDINGS = [
    ("k/a.py", "k/a.py::m@6", 9, "complex-conditional", "3"), ("k/a.py", "k/a.py::m@6", 11, "nested-loop-quadratic", "b"), ("k/a.py", "k/a.py::helper@15", 19, "string-concat-in-loop", "out"),
    ("k/a.py", "k/a.py::helper@15", 20, "membership-test-in-loop", "seen"), ("k/a.py", "k/a.py::helper@15", 22, "io-in-loop", "read"), ("k/a.py", "k/a.py::helper@15", 23, "json-parse-in-loop", "json.loads"),
    ("k/a.py", "k/a.py::helper@15", 24, "regex-compile-in-loop", "re.compile"), ("k/a.py", "k/a.py::helper@15", 25, "list-insert-zero-in-loop", "seen"), ("k/a.py", "k/a.py::helper@15", 26, "pd-concat-in-loop", "pd.concat"),
    ("k/a.py", "k/a.py::helper@15", 27, "resource-construction-in-loop", "Pool"), ("k/a.py", "k/a.py::helper@15", 28, "lock-in-loop", "lock.acquire"), ("k/a.py", "k/a.py::helper@15", 29, "io-in-loop", "write"),
    ("k/a.py", "k/a.py::helper@15", 29, "nested-loop-with-io", "write"), ("k/a.py", "k/a.py::helper@15", 31, "blocking-io-under-lock", "readline"), ("k/a.py", "k/a.py::helper@15", 32, "sql-cartesian-join", "a,b,c"),
    ("k/a.py", "k/a.py::go@35", 36, "blocking-sync-in-async", "time.sleep"), ("k/a.py", "k/a.py::go@35", 38, "serial-await-in-loop", "fetch"),
    ("k/a.rs", "k/a.rs::go@3", 5, "hot-path-sync-io", "read_to_string"), ("k/a.rs", "k/a.rs::go@3", 6, "blocking-sync-in-async", "fs::write"), ("k/a.rs", "k/a.rs::go@3", 7, "complex-conditional", "3"),
    ("k/a.rs", "k/a.rs::go@3", 11, "nested-loop-quadratic", "items"), ("k/a.rs", "k/a.rs::go@3", 12, "io-in-loop", "read_line"), ("k/a.rs", "k/a.rs::go@3", 12, "nested-loop-with-io", "read_line"), ("k/a.rs", "k/a.rs::go@3", 12, "hot-path-sync-io", "read_line"),
    ("k/a.rs", "k/a.rs::go@3", 14, "membership-test-in-loop", "seen"), ("k/a.rs", "k/a.rs::go@3", 15, "list-insert-zero-in-loop", "seen"), ("k/a.rs", "k/a.rs::go@3", 16, "string-concat-in-loop", "out"), ("k/a.rs", "k/a.rs::go@3", 17, "string-concat-in-loop", "total"),
    ("k/a.rs", "k/a.rs::go@3", 18, "resource-construction-in-loop", "Client::new"), ("k/a.rs", "k/a.rs::go@3", 19, "regex-compile-in-loop", "Regex::new"), ("k/a.rs", "k/a.rs::go@3", 20, "json-parse-in-loop", "serde_json::from_str"),
    ("k/a.rs", "k/a.rs::go@3", 21, "lock-in-loop", "state.lock"), ("k/a.rs", "k/a.rs::go@3", 22, "serial-await-in-loop", "fetch"), ("k/a.rs", "k/a.rs::go@3", 27, "blocking-io-under-lock", "execute"), ("k/a.rs", "k/a.rs::go@3", 27, "hot-path-sync-io", "execute"),
    ("k/a.rs", "k/a.rs::go@3", 27, "sql-cartesian-join", "a,b,c"),
    ("k/a.ts", "k/a.ts::go@1", 5, "membership-test-in-loop", "known"), ("k/a.ts", "k/a.ts::go@1", 6, "json-parse-in-loop", "JSON.parse"), ("k/a.ts", "k/a.ts::go@1", 7, "resource-construction-in-loop", "Pool"), ("k/a.ts", "k/a.ts::go@1", 8, "regex-compile-in-loop", "RegExp"),
    ("k/a.ts", "k/a.ts::go@1", 9, "string-concat-in-loop", "text"), ("k/a.ts", "k/a.ts::go@1", 10, "serial-await-in-loop", "fetch"), ("k/a.ts", "k/a.ts::go@1", 10, "io-in-loop", "fetch"), ("k/a.ts", "k/a.ts::go@1", 12, "lock-in-loop", "lock.acquire"),
    ("k/a.ts", "k/a.ts::go@1", 13, "complex-conditional", "3"), ("k/a.ts", "k/a.ts::go@1", 14, "io-in-loop", "query"), ("k/a.ts", "k/a.ts::go@1", 14, "nested-loop-with-io", "query"), ("k/a.ts", "k/a.ts::go@1", 14, "sql-cartesian-join", "t1,t2"),
    ("k/a.ts", "k/a.ts::go@1", 18, "string-concat-in-loop", "n"), ("k/a.ts", "k/a.ts::go@1", 21, "array-spread-in-reduce", "acc"), ("k/a.go", "k/a.go::run@3", 5, "defer-in-loop", "close"), ("k/a.go", "k/a.go::run@3", 6, "goroutine-in-unbounded-loop", "work"),
]


def _texts(spark, texts: dict):
    return spark.createDataFrame(list(texts.items()), "file string, text string")


def _lines(spark, text_: str, key: str = "report"):
    return spark.createDataFrame([("x", i, v) for i, v in enumerate(text_.split("\n"))], f"{key} string, ord int, value string")


MANIFESTS = {
    "a/Cargo.toml": '[dependencies]\nserde = "1"\nlocal = { path = "../l" }\nt = { version = "2", features = [] }\n[workspace.dependencies]\nw = "3"\n', "a/package.json": '{"dependencies": {"x": "^1", "y": "file:../y"}, "devDependencies": {"d": "2"}}',
    "a/requirements.txt": "# c\n-r o.txt\nreq[extra]>=1.0 ; python_version > '3'\nplain\n", "a/pyproject.toml": '[project]\ndependencies = ["p>=1"]\n[tool.poetry.dependencies]\npython = "^3"\nq = "1"\n',
    "a/go.mod": "module m\nrequire (\n\tg.org/a v1.0.0\n\tg.org/b v2.0.0 // indirect\n)\nrequire g.org/c v3.0.0\n", "a/composer.json": '{"require": {"php": ">=8", "v/p": "1"}}', "b/Cargo.toml": "not [ toml",
}
DECLARED = {
    "Dockerfile": "FROM go:1 AS build\nRUN a \\\n  b\nFROM build as mid\nFROM scratch\nCOPY --from=build /a /a\nCOPY --from=1 /b /b\n", "a.sql": "-- CREATE TABLE no\nCREATE TABLE s.t (x INT);\ncreate or replace view v as select 1;\n", "m.sql": "select * from {{ ref('t') }} join {{ source('a', 'b') }}",
    "api.json": '{"openapi": "3", "paths": {"/a": {"get": {"operationId": "ga"}, "x": 1}}, "components": {"schemas": {"S": {"properties": {"q": {}, "p": {}}}}}}',
    "api.yaml": "openapi: 3.0.0\nservers:\n- url: http://a.invalid\npaths:\n  /b:\n    post:\n      tags:\n        - one\n      operationId: pb\n      parameters:\n        - name: id\n          in: query\ncomponents:\n  schemas:\n    T:\n      required:\n      - u\n      properties:\n        u:\n          type: string\n",
    "p.proto": "message A { string x = 1; enum E { Z = 0; } }\nservice S { rpc F (A) returns (B); }\nenum Q { O = 0; }", "g.graphql": "type T { a: Int b(x: Int): Int }\ntype Query { q(id: ID): T }\n", "i.tf": 'resource "aws_x" "n" {\n  resource "no" "no" {\n  }\n}\nmodule "m" {\n}\ndata "d" "e" {\n}\n',
}


def _declared(spark):
    out = None
    for what in ("sql", "dbt", "openapi", "protobuf", "graphql", "terraform"):
        one = X.declared(_texts(spark, DECLARED), what)
        one = one.select(F.lit(what).alias("what"), *[F.col(c).cast("string").alias(n) for c, n in zip(one.columns, ("file", "kind", "name", "detail"), strict=True)])
        out = one if out is None else out.unionByName(one)
    return out


LCOV = "TN:one\nSF:/w/p/src/a.py\nDA:1,2\nDA:2,0,abc\nend_of_record\nTN: \nSF:src/a.py\nDA:1,1\nend_of_record\nSF:/else/z.py\nDA:1,1\nend_of_record"


def _placed(spark):
    hits, _ = reports.parse_lcov(_lines(spark, LCOV))
    placed, lost = reports.place(hits, spark.createDataFrame([("p/src/a.py",), ("q/b.py",)], "file string"))
    return placed.select("file", "line", "hits").unionByName(lost.select(F.col("path").alias("file"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("long").alias("hits")))


def _impacted(spark):
    _, tests = reports.parse_lcov(_lines(spark, LCOV))
    hits = tests.withColumnRenamed("path", "file")
    changed = spark.createDataFrame([("/w/p/src/a.py", 1), ("/w/p/src/a.py", 9)], "file string, line int")
    return coverage.impacted_tests(hits, changed).join(coverage.impact_status(hits, changed).select("status"))


DIFF = "--- a/x.c\n+++ b/x.c\n@@ -1,3 +1,4 @@ f\n a\n-b\n+c\n+d\n e\n@@ -9 +10 @@\n-q\n+r\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-z"
LOG = ["h1\x1fAnn\x1fa@x\x1f12\x1fSay: a\nf1\nf2\n", "h2\x1fBo\x1fb@x\x1fzz\x1f", "\n"]
MODULES = [("r/pkg/a/__init__.py", "Python"), ("r/pkg/a/b.py", "Python"), ("r/x/src/main/java/org/q/C.java", "Java"), ("r/src/lib.rs", "Rust"), ("r/src/a/mod.rs", "Rust"), ("r/src/a/b.rs", "Rust"), ("r/in/x/f.go", "Go"), ("r/A/B/c.cs", "CSharp"), ("r/a.txt", "Other")]
ROUTES = {"a.rs": '.route("/x/{id}", get(show))', "b.py": '@app.post("/y")\ndef f(): requests.put("http://h.invalid/z?q=1")', "c.js": "router.get('/w/:id', f);\nfetch('/x/1'); axios.delete(\"/y\");", "d.rs": 'ureq::get("https://h.invalid/v#f")', "e.js": "other.get('/no')"}
MARKDOWN = [
    ("adr", "# 7. Use it\n\nStatus: Proposed\nStatus: Superseded by ADR-9\nDate: 2024-01-02\n"), ("template", "# 1. <title>\nStatus: x\n"), ("log", "# Log\n## 2.0\n### Changed\n\n- Moved to rows\n- More\n### Added\n- x\n### security\nKeys rotate\n"),
]


def _decisions(spark):
    d = spark.createDataFrame(MARKDOWN, "id string, text string")
    files = text.decision_files(d, "id").select("id", "title", "status", "date", F.col("superseded_by").cast("string").alias("other"))
    nothing = F.lit(None).cast("string")
    return files.unionByName(text.changelog_decisions(d, "id").select("id", "title", nothing.alias("status"), nothing.alias("date"), F.col("body").alias("other")))


def _inline(spark):
    return text.inline_markers(_texts(spark, {"f.go": "x := 1\n// WHY: because\n// NOTE: no\n    # DECISION: use rows\ny // WHY: behind code\n"}), "file")


def _linked(spark):
    d = spark.createDataFrame([("d1", "The TaskQueue moves to src/queue.rs now"), ("d2", "see lib/src/cache.rs, not src/queue.rsx"), ("d3", "the abc"), ("d4", None)], "id string, body string")
    names = spark.createDataFrame([("TaskQueue", "queue"), ("abc", "short")], "name string, target string")
    paths = spark.createDataFrame([("src/queue.rs", "queue"), ("src/cache.rs", "cache"), ("a.c", "tiny")], "path string, target string")
    return text.link_decisions(d, names, paths)


def _matched(spark):
    c = spark.createDataFrame([("c1", "a", "GET", "/x/1"), ("c2", "b", "GET", "/x/1"), ("c3", "a", "POST", "/x/1"), ("c4", "a", "GET", "/no"), ("c5", "a", None, "/q/7"), ("c6", "a", "GET", "/1/2/3")], "id string, repo string, method string, path string")
    p = spark.createDataFrame([("p1", "b", "GET", "/x/{id}"), ("p2", "c", None, "/:any/7"), ("p3", "b", "GET", "/:a/:b/:c"), ("p4", "c", "GET", "/{a}/{b}/{c}"), ("p5", "a", "GET", "/no")], "id string, repo string, method string, path string")
    return contracts.match(c, p).select("id", "producer_id", "reason")


def _fumbles(spark):
    rows = [("u", 1, 1, "ran", "go", 2), ("u", 2, 1, "note", "go", 0), ("u", 3, 1, "ran", "ls", 0), ("u", 4, 1, "distilled", "go", 0), ("u", 5, 1, "ran", "npm", 1), ("u", 6, 1, "ran", "a", 0), ("u", 7, 1, "ran", "b", 0), ("u", 8, 1, "ran", "c", 0), ("u", 9, 1, "ran", "npm", 0), ("v", 1, 1, "ran", "go", 9), ("v", 2, 1, "ran", "go", None), ("v", 3, 1, "ran", "go", 0)]
    runs = spark.createDataFrame(rows, "who string, at long, ord long, kind string, program string, exit_code int")
    x = ledger.fumbles(Scratch(spark, "known"), runs, "who").select("program", "fumbles", F.concat_ws(",", "exit_codes").alias("exit_codes"))
    return x.unionByName(ledger.observed(runs).select(F.lit("(runs)").alias("program"), F.col("runs").alias("fumbles"), F.lit("").alias("exit_codes")))


def _containers(spark):
    files = [("r", f"r/a/b/{x}{i}.c") for i in range(10) for x in "mn"] + [("r", "r/a/z.c"), ("q", "q/x/1.c"), ("q", "q/y/2.c")]
    return domains.containers(spark.createDataFrame(files, "repo string, file string")).select("repo", "depth", "dir", "files")


def _freshness(spark):
    pages = spark.createDataFrame([("a", "1"), ("b", "2"), ("n", "3")], "file string, digest string")
    return sinks.freshness(pages, spark.createDataFrame([("a", "1"), ("b", "x"), ("gone", "y")], "file string, digest string"))


def _pruned(spark):
    s = spark.createDataFrame([("old", 1, 0), ("a", 6, 900_000), ("b", 6, 900_001), ("c", 3, 890_000), ("mine", 50, 1)], "ref string, size long, at long")
    return sinks.prune(s, 900_010, "mine", ttl=20_000, room=12).select("ref")


def _paths(spark):
    p = spark.createDataFrame([("/w/a.py",), ("/w",), ("/else",), (None,)], "path string")
    return p.select("path", sinks.relative(F.col("path"), "/w").alias("below"), sinks.anchored(sinks.relative(F.col("path"), "/w"), "/v").alias("anchored"))


def _pages(spark):
    files = spark.createDataFrame([("a", "Go", 3), ("b", "Go", 4)], "file string, language string, lines long")
    edges = spark.createDataFrame([("b", "a", "imports"), ("b", "a", "imports")], "src string, dst string, kind string")
    symbols = spark.createDataFrame([("b", 1, "Function", "f")], "file string, start_line int, kind string, name string")
    found = spark.createDataFrame([("b", "long-function", 1), ("b", "churn-risk", None)], "file string, kind string, line int")
    return sinks.wiki_pages(files, symbols, edges, found).select("file", F.regexp_replace("page", "\n+", "|").alias("page"))


def _json(spark):
    edges = spark.createDataFrame([("b", "a", "imports"), ("b", "a", "imports")], "src string, dst string, kind string")
    return sinks.graph_json(spark.createDataFrame([("a",), ("b",)], "id string"), edges, spark.createDataFrame([("b", 2)], "id string, n int"))


def _symbols(spark):
    x = table_of(extracted(spark.createDataFrame(TEXTS, "file string, language string, text string")), "symbols")
    return x.select("id", "kind", "start_line", "end_line", "complexity", "max_nesting_depth", "bumpy_road_bumps", "param_count", "primitive_param_count")


CODE = {
    "Kotlin": "import a.B\nclass A {\n    fun b() {\n        c()\n    }\n}\n", "Java": "import a.B;\nclass A {\n    int b() {\n        return c();\n    }\n}\n", "Cpp": "#include <a>\nclass A {\n    int b() {\n        return c();\n    }\n};\n",
    "CSharp": "using a;\nclass A {\n    int b() {\n        return c();\n    }\n}\n", "Scala": "import a.B\nclass A {\n    def b() = {\n        c()\n    }\n}\n", "Swift": "import a\nclass A {\n    func b() {\n        c()\n    }\n}\n", "Php": "use a;\nclass A {\n    public function b() {\n        c();\n    }\n}\n",
    "Dart": "import 'a';\nclass A {\n    int b() {\n        return c();\n    }\n}\n", "Ruby": "require 'a'\nclass A\n  def b\n    c()\n  end\nend\n", "Luau": "local x = require(a)\nlocal function b()\n    c()\nend\n", "C": "#include <a>\nint b(void) {\n    return c();\n}\n", "Shell": ". ./a\nb() {\n    c x\n}\n",
}


def _languages(spark):
    rows = extracted(spark.createDataFrame([(k, k, v) for k, v in CODE.items()], "file string, language string, text string"))
    names = lambda t, c: table_of(rows, t).groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(c)), ",").alias(t))
    symbol = F.concat_ws(":", "name", "kind", "start_line", "end_line")
    return names("symbols", symbol).join(names("imports", F.col("path")), "file").join(names("calls", F.concat_ws("<", "callee_name", F.regexp_extract("caller", "::(.*)$", 1))), "file")


def _files(spark):
    p = [("a/b.rs", "x\n"), ("x.h", ""), ("Dockerfile", "a"), ("d/Dockerfile.dev", "a\n\n"), ("a.tsx", None), ("noext", "b"), ("A.PY", "c\nd")]
    return spark.createDataFrame(p, "file string, text string").select("file", language(F.col("file")).alias("language"), line_count(F.col("text")).cast("long").alias("lines"))


def _imports(spark):
    files = spark.createDataFrame(MODULES, "file string, language string").withColumn("module", X.module_paths(F.col("file"), F.col("language"))).where("module IS NOT NULL")
    i = spark.createDataFrame([("r/z.py", "Python", "pkg.a.b.name", 1), ("r/z.py", "Python", "pkg.a.*", 2), ("r/z.py", "Python", "other", 3), ("r/K.kt", "Kotlin", "org.q.C", 1), ("r/m.rs", "Rust", "crate::a::b::F", 1)], "file string, language string, path string, line int")
    return X.resolve_imports(i, files).select("file", "line", "to_file")


def _queries(spark):
    q = [("select * from a, b where a.x = b.y",), ("SELECT 1 FROM a, b, c WHERE a.x = b.x",), ("select 1 from a join b",), ("delete from a, b",)]
    return spark.createDataFrame(q, "q string").select("q", F.concat_ws(",", refactor.cartesian_tables(F.col("q"))).alias("tables"))


def _anchored(spark):
    p = spark.createDataFrame([("p1", "f", "a  b\n\n c"), ("p2", "f", "nowhere"), ("p3", "f", "c")], "id string, file string, anchor string")
    return refactor.anchored_proposals(p, _texts(spark, {"f": "x\na b\n\nc d\n"}))


def _weights(spark):
    return health.weights_from_toml(spark, 'long_function = 2\n"god-class" = 0.25\n').where("penalty IN (2.0, 0.25)")


def _blame(spark):
    return git.parse_blame(_lines(spark, "author Ann\nauthor-mail x\nauthor Bo\nauthor Ann\nauthor Ann", "file"))


def _notes(spark):
    t = ["fix #12, (#3) a#4 #5b #12", "https://github.com/a/b.git", "git@github.com:a/b", "https://x.org/a/b"]
    return spark.createDataFrame([(x,) for x in t], "t string").select("t", F.concat_ws(",", text.issue_refs(F.col("t"))).alias("issues"), F.coalesce(text.owner_repo(F.col("t")), F.lit("")).alias("repo"))


# Query: what makes it, its columns, its rows.
KNOWN = {
    "known_dependencies": (lambda s: X.dependencies(_texts(s, MANIFESTS)).select("ecosystem", "name", "version").distinct(), "ecosystem string, name string, version string", [
        ("cargo", "serde", "1"), ("cargo", "t", "2"), ("cargo", "w", "3"), ("npm", "x", "^1"), ("npm", "d", "2"), ("pip", "req", ">=1.0"), ("pip", "plain", ""), ("pip", "p", ">=1"), ("pip", "q", "1"), ("go", "g.org/a", "v1.0.0"), ("go", "g.org/c", "v3.0.0"), ("composer", "v/p", "1")]),
    "known_declarations": (_declared, "what string, file string, kind string, name string, detail string", [
        ("sql", "a.sql", "table", "s.t", "2"), ("sql", "m.sql", "view", "m", "1"), ("sql", "a.sql", "view", "v", "3"), ("dbt", "m.sql", "ref", "t", "1"), ("dbt", "m.sql", "source", "a.b", "1"), ("openapi", "api.json", "endpoint", "GET /a", "ga"), ("openapi", "api.yaml", "endpoint", "POST /b", "pb"),
        ("openapi", "api.json", "schema", "S", "p,q"), ("openapi", "api.yaml", "schema", "T", "u"), ("protobuf", "p.proto", "message", "A", "x"), ("protobuf", "p.proto", "rpc", "S.F", "A -> B"), ("protobuf", "p.proto", "service", "S", ""), ("graphql", "g.graphql", "query", "q", ""), ("graphql", "g.graphql", "type", "T", "a,b"),
        ("terraform", "i.tf", "module", "", "m"), ("terraform", "i.tf", "resource", "aws_x", "n")]),
    "known_stages": (lambda s: (lambda d: d.select(*[F.col(c).cast("string").alias(n) for c, n in zip(d.columns, ("file", "stage", "name", "base", "copies_from"), strict=True)]))(X.declared(_texts(s, DECLARED), "docker")), "file string, stage string, name string, base string, copies_from string", [
        ("Dockerfile", "0", "build", "go:1", None), ("Dockerfile", "1", "mid", "build", "0"), ("Dockerfile", "2", None, "scratch", "0"), ("Dockerfile", "2", None, "scratch", "1")]),
    "known_coverage": (_placed, "file string, line int, hits long", [("p/src/a.py", 1, 1), ("p/src/a.py", 2, 0), ("/else/z.py", None, None)]),
    "known_impact": (_impacted, "test string, status string", [("one", "covered")]),
    "known_diff": (lambda s: git.parse_diff(_lines(s, DIFF, "diff")), "file string, line int", [("x.c", 2), ("x.c", 3), ("x.c", 10)]),
    "known_numstat": (lambda s: git.parse_numstat(_lines(s, "3\t1\ta b\n-\t-\tbin\njunk")), "added long, deleted long, file string", [(3, 1, "a b"), (0, 0, "bin")]),
    "known_blame": (lambda s: _blame(s).select("author", "lines", "percentage"), "author string, lines long, percentage double", [("Ann", 3, 75.0), ("Bo", 1, 25.0)]),
    "known_log": (lambda s: git.parse_log(s.createDataFrame([(x,) for x in LOG], "value string")).select("hash", "author", "author_email", "ts", "message", F.concat_ws(",", "files").alias("files")), "hash string, author string, author_email string, ts long, message string, files string", [("h1", "Ann", "a@x", 12, "Say: a", "f1,f2"), ("h2", "Bo", "b@x", None, "", "")]),
    "known_modules": (lambda s: s.createDataFrame(MODULES, "file string, language string").select("file", X.module_paths(F.col("file"), F.col("language")).alias("module")), "file string, module string", [
        ("r/pkg/a/__init__.py", "pkg.a"), ("r/pkg/a/b.py", "pkg.a.b"), ("r/x/src/main/java/org/q/C.java", "org.q.C"), ("r/src/lib.rs", "crate"), ("r/src/a/mod.rs", "crate::a"), ("r/src/a/b.rs", "crate::a::b"), ("r/in/x/f.go", "in/x"), ("r/A/B/c.cs", "A.B"), ("r/a.txt", None)]),
    "known_imports": (_imports, "file string, line int, to_file string", [("r/z.py", 1, "r/pkg/a/b.py"), ("r/z.py", 2, "r/pkg/a/__init__.py"), ("r/z.py", 3, None), ("r/K.kt", 1, "r/x/src/main/java/org/q/C.java"), ("r/m.rs", 1, "r/src/a/b.rs")]),
    "known_routes": (lambda s: contracts.scan(_texts(s, ROUTES)), "file string, side string, method string, path string", [
        ("a.rs", "producer", "GET", "/x/{id}"), ("b.py", "producer", "POST", "/y"), ("b.py", "consumer", "PUT", "/z"), ("c.js", "producer", "GET", "/w/:id"), ("c.js", "consumer", None, "/x/1"), ("c.js", "consumer", "DELETE", "/y"), ("d.rs", "consumer", "GET", "/v")]),
    "known_contracts": (_matched, "id string, producer_id string, reason string", [("c1", "p1", "matched"), ("c2", None, "same-repo-only"), ("c3", None, "method-mismatch"), ("c4", None, "same-repo-only"), ("c5", "p2", "matched"), ("c6", "p3", "matched")]),
    "known_decisions": (_decisions, "id string, title string, status string, date string, other string", [("adr", "Use it", "Superseded by ADR-9", "2024-01-02", "9"), ("log", "Changed: - Moved to rows", None, None, "- Moved to rows\n- More"), ("log", "Security: Keys rotate", None, None, "Keys rotate")]),
    "known_inline_markers": (_inline, "file string, line int, marker string, text string", [("f.go", 2, "WHY", "because"), ("f.go", 4, "DECISION", "use rows")]),
    "known_links": (_linked, "id string, target string", [("d1", "queue"), ("d2", "cache"), ("d2", "queue")]),
    "known_fumbles": (_fumbles, "program string, fumbles long, exit_codes string", [("go", 2, "2,9"), ("(runs)", 10, "")]),
    "known_containers": (_containers, "repo string, depth int, dir string, files long", [("r", 0, "a", 21), ("r", 1, "b", 20)]),
    "known_freshness": (_freshness, "file string, state string", [("a", "unchanged"), ("b", "changed"), ("n", "new"), ("gone", "missing")]),
    "known_pruned": (_pruned, "ref string", [("a",), ("b",), ("mine",)]),
    "known_paths": (_paths, "path string, below string, anchored string", [("/w/a.py", "a.py", "/v/a.py"), ("/w", ".", "/v"), ("/else", "/else", "/else"), (None, None, None)]),
    "known_pages": (_pages, "file string, page string", [("a", "# a|Go, 3 lines|## Symbols|## Imports|Imported by 1 files"), ("b", "# b|Go, 4 lines|## Symbols|- Function `f` at line 1|## Imports|- a|Imported by 0 files|## Findings|- churn-risk|- long-function at line 1")]),
    "known_graph_json": (_json, "json string", [('{"id":"a","edges":[],"unresolved":0}',), ('{"id":"b","edges":[{"dst":"a","kind":"imports"}],"unresolved":2}',)]),
    "known_files": (_files, "file string, language string, lines long", [("a/b.rs", "Rust", 1), ("x.h", "Other", 0), ("Dockerfile", "Dockerfile", 1), ("d/Dockerfile.dev", "Dockerfile", 2), ("a.tsx", "TypeScript", 0), ("noext", "Other", 1), ("A.PY", "Python", 2)]),
    "known_cartesian": (_queries, "q string, tables string", [("select * from a, b where a.x = b.y", ""), ("SELECT 1 FROM a, b, c WHERE a.x = b.x", "a,b,c"), ("select 1 from a join b", ""), ("delete from a, b", "")]),
    "known_anchors": (_anchored, "id string, file string, line int", [("p1", "f", 2), ("p3", "f", 4)]),
    "known_weights": (_weights, "kind string, penalty double", [("long-function", 2.0), ("god-class", 0.25)]),
    "known_notes": (_notes, "t string, issues string, repo string", [("fix #12, (#3) a#4 #5b #12", "3,12", ""), ("https://github.com/a/b.git", "", "a/b"), ("git@github.com:a/b", "", "a/b"), ("https://x.org/a/b", "", "")]),
    "known_symbols": (_symbols, "id string, kind string, start_line int, end_line int, complexity int, max_nesting_depth int, bumpy_road_bumps int, param_count int, primitive_param_count int", [
        ("k/a.py::A@5", "Class", 5, 13, None, None, None, None, None), ("k/a.py::m@6", "Method", 6, 13, 7, 3, 1, 3, 3), ("k/a.py::helper@15", "Function", 15, 33, 4, 2, 1, 3, 0), ("k/a.py::go@35", "Function", 35, 40, 3, 1, 0, 1, 0), ("k/a.rs::go@3", "Function", 3, 29, 8, 2, 1, 2, 0), ("k/a.rs::quiet@31", "Function", 31, 36, 2, 1, 0, 1, 0),
        ("k/a.ts::go@1", "Function", 1, 22, 11, 2, 1, 1, 0), ("k/a.ts::quiet@24", "Function", 24, 26, 1, 0, 0, 1, 0), ("k/a.go::run@3", "Function", 3, 8, 2, 1, 0, 1, 0)]),
    "known_languages": (_languages, "file string, symbols string, imports string, calls string", [
        *[(k, "A:Class:2:6,b:Method:3:5", p, "c<b@3") for k, p in (("Kotlin", "a.B"), ("Java", "a.B"), ("Cpp", "a"), ("CSharp", "a"), ("Scala", "a.B"), ("Swift", "a"), ("Php", "a"), ("Dart", "a"), ("Ruby", "a"))],
        ("Luau", "b:Function:2:4", "a", "c<b@2,require"), ("C", "b:Function:2:4", "a", "c<b@2"), ("Shell", "b:Function:2:4", "./a", "c<b@2")]),
}
_TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE"}
_NONE = {"string": "(none)", "int": -1, "long": -1, "double": -1.0}  # what stands for NULL in these results


def values(schema: str, rows: list[tuple]) -> str:
    """SQL of a table of literals."""
    names, types = zip(*(c.split(" ") for c in schema.split(", ")), strict=True)

    def one(v, t: str) -> str:
        v = _NONE[t] if v is None else v
        return f"CAST({repr(v) if not isinstance(v, str) else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39)} AS {_TYPES[t]})"

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r, types)) + ")" for r in rows) + f") AS t({', '.join(names)})"


def _query(make, schema: str):
    columns = [c.split(" ") for c in schema.split(", ")]
    return lambda spark, sf_dir: make(spark).select(*[F.coalesce(F.col(c).cast(t), F.lit(_NONE[t]).cast(t)).alias(c) for c, t in columns])


QUERIES = {name: _query(make, schema) for name, (make, schema, _) in KNOWN.items()}
SQL = {name: values(schema, rows) for name, (_, schema, rows) in KNOWN.items()}
