from pyspark.sql import functions as F

from codestrata.extract import lexical, python
from codestrata.extract import manifests as M
from codestrata.extract.run import extracted, light_imports, table_of
from codestrata.plans import known

PY = known.PYTHON


def test_python():
    got = python.extract("r/a.py", PY)
    s = {r[3]: r for r in got["symbols"]}
    assert [(k, v[4], v[7]) for k, v in s.items()] == [("A", "Class", None), ("m", "Method", "r/a.py::A@5"), ("helper", "Function", None), ("go", "Function", None)]
    assert s["m"][8:13] == (7, 3, 1, 3, 3) and s["helper"][11] == 3
    assert [r[1] for r in got["imports"]] == ["os", ".", "pandas"]
    assert ("r/a.py", "r/a.py::m@6", "helper", 13) in got["calls"] and ("r/a.py", "r/a.py::m@6", "x", 8) in got["field_accesses"]
    kinds = [k for _, k, _, _ in got["markers"]]
    for k in ("nested-loop-quadratic", "complex-conditional", "string-concat-in-loop", "membership-test-in-loop", "io-in-loop", "json-parse-in-loop", "regex-compile-in-loop", "list-insert-zero-in-loop", "pd-concat-in-loop",
              "resource-construction-in-loop", "lock-in-loop", "nested-loop-with-io", "blocking-io-under-lock", "sql-cartesian-join", "blocking-sync-in-async", "serial-await-in-loop"):
        assert k in kinds, k
    assert kinds.count("serial-await-in-loop") == 1 and python.extract("a", "def (") is None
    assert python.extract("a", "") == {"symbols": [], "imports": [], "calls": [], "field_accesses": [], "markers": []}
    assert python.cartesian_tables("select * from a, b where a.x = b.y") == [] and python.cartesian_tables("select 1 from a join b") == []


def test_lexical():
    go = 'package a\n\nimport (\n    "x/y"\n)\n\ntype T struct {\n    n int\n}\nfunc (s *T) m(a int, b string) int {\n    s.n = f(a) // g(\n    for i := 0; i < 3; i++ {\n        defer close(i)\n        go run(i)\n    }\n    return 1\n}\nfunc f(a int) int {\n    return a\n}\n'
    got = lexical.extract("Go", "r/a.go", go)
    assert [(r[3], r[4], r[5], r[6], r[7]) for r in got["symbols"]] == [("T", "Struct", 7, 9, None), ("m", "Method", 10, 17, "r/a.go::T@7"), ("f", "Function", 18, 20, None)]
    assert [r[1] for r in got["imports"]] == ["x/y"] and ("r/a.go", "r/a.go::m@10", "f", 11) in got["calls"] and not [c for c in got["calls"] if c[2] == "g"]
    assert {(k, n) for _, k, _, n in got["markers"]} == {("defer-in-loop", "close"), ("goroutine-in-unbounded-loop", "run")}
    assert ("r/a.go", "r/a.go::m@10", "n", 11) in got["field_accesses"]
    one = {"Kotlin": "class A {\n    fun b() {\n    }\n}\n", "Rust": "struct A {\n}\nimpl A {\n    pub fn b(&self) {\n    }\n}\n", "Java": "class A {\n    int b() {\n        return 1;\n    }\n}\n", "TypeScript": "export class A {\n    b(x: number): number {\n        return 1;\n    }\n}\n",
           "Php": "class A {\n    public function b() {\n    }\n}\n", "Swift": "class A {\n    func b() {\n    }\n}\n", "Cpp": "class A {\n    int b() {\n        return 1;\n    }\n};\n", "CSharp": "class A {\n    int b() {\n        return 1;\n    }\n}\n", "Scala": "class A {\n    def b() = {\n    }\n}\n",
           "Dart": "class A {\n    int b() {\n        return 1;\n    }\n}\n"}
    for language, text in one.items():
        rows = [(r[3], r[4]) for r in lexical.extract(language, "f", text)["symbols"]]
        assert [n for n, _ in rows] == ["A", "b"] and rows[1][1] == "Method", language
    assert [r[3] for r in lexical.extract("Ruby", "f", "class A\n  def b\n  end\nend\n")["symbols"]] == ["A", "b"]
    assert [r[3] for r in lexical.extract("Luau", "f", "local function b()\nend\n")["symbols"]] == ["b"]
    assert lexical.extract("Other", "f", "x") is None


RS, TS = known.RUST, known.TYPESCRIPT


def test_markers_of_rust_and_scripts():
    def of(language, text):
        rows = lexical.extract(language, "f", text)["markers"]
        assert not [r for r in rows if "quiet" in r[0]], rows
        return sorted((k, ln, n) for _, k, ln, n in rows)

    assert of("Rust", RS) == sorted(
        [
            ("complex-conditional", 7, "3"), ("blocking-sync-in-async", 6, "fs::write"), ("nested-loop-quadratic", 11, "items"), ("io-in-loop", 12, "read_line"), ("nested-loop-with-io", 12, "read_line"),
            ("membership-test-in-loop", 14, "seen"), ("list-insert-zero-in-loop", 15, "seen"), ("string-concat-in-loop", 16, "out"), ("string-concat-in-loop", 17, "total"), ("resource-construction-in-loop", 18, "Client::new"),
            ("regex-compile-in-loop", 19, "Regex::new"), ("json-parse-in-loop", 20, "serde_json::from_str"), ("lock-in-loop", 21, "state.lock"), ("serial-await-in-loop", 22, "fetch"), ("blocking-io-under-lock", 27, "execute"),
            ("sql-cartesian-join", 27, "a,b,c"), ("sync-io", 5, "read_to_string"), ("sync-io", 12, "read_line"), ("sync-io", 27, "execute"),
        ]
    )
    for language in ("TypeScript", "JavaScript"):
        assert of(language, TS) == sorted(
            [
                ("membership-test-in-loop", 5, "known"), ("json-parse-in-loop", 6, "JSON.parse"), ("resource-construction-in-loop", 7, "Pool"), ("regex-compile-in-loop", 8, "RegExp"), ("string-concat-in-loop", 9, "text"),
                ("serial-await-in-loop", 10, "fetch"), ("io-in-loop", 10, "fetch"), ("sync-io", 10, "fetch"), ("lock-in-loop", 12, "lock.acquire"), ("complex-conditional", 13, "3"), ("io-in-loop", 14, "query"),
                ("nested-loop-with-io", 14, "query"), ("sync-io", 14, "query"), ("sql-cartesian-join", 14, "t1,t2"), ("string-concat-in-loop", 18, "n"), ("sync-io", 20, "readFileSync"), ("array-spread-in-reduce", 21, "acc"),
            ]
        ), language


def test_frames(spark):
    rows = [("r/a.py", "Python", PY), ("r/b.py", "Python", "def ("), ("r/c.txt", "Other", "x"), ("r/d.go", "Go", None), ("r/e.hs", "Haskell", "import qualified Data.Map as M\n")]
    df = spark.createDataFrame(rows, "file string, language string, text string")
    x = extracted(df)
    assert {r.file: r.parsed for r in x.collect()} == {"r/a.py": True, "r/b.py": False, "r/c.txt": False, "r/d.go": False, "r/e.hs": False}
    assert table_of(x, "symbols").count() == 4 and table_of(x, "calls").where("caller IS NULL").count() == 0
    assert [tuple(r) for r in light_imports(df).collect()] == [("r/e.hs", "Data.Map", 1)]


def test_manifests(spark):
    texts = {
        "a/Cargo.toml": '[dependencies]\nserde = "1"\nlocal = { path = "../l" }\nt = { version = "2", features = [] }\n[workspace.dependencies]\nw = "3"\n', "a/package.json": '{"dependencies": {"x": "^1", "y": "file:../y", "z": 3}, "devDependencies": {"d": "2"}}',
        "a/requirements.txt": "# c\n-r o.txt\nreq[extra]>=1.0 ; python_version > '3'\nplain\n", "a/pyproject.toml": '[project]\ndependencies = ["p>=1"]\n[tool.poetry.dependencies]\npython = "^3"\nq = "1"\n',
        "a/go.mod": "module m\nrequire (\n\tg.org/a v1.0.0\n\tg.org/b v2.0.0 // indirect\n)\nrequire g.org/c v3.0.0\n", "a/composer.json": '{"require": {"php": ">=8", "v/p": "1"}}', "b/Cargo.toml": "not [ toml",
    }
    df = spark.createDataFrame(list(texts.items()), "file string, text string")
    got = {(r.ecosystem, r.name, r.version) for r in M.dependencies(df).collect()}
    assert got == {("cargo", "serde", "1"), ("cargo", "t", "2"), ("cargo", "w", "3"), ("npm", "x", "^1"), ("npm", "d", "2"), ("pip", "req", ">=1.0"), ("pip", "plain", ""), ("pip", "p", ">=1"), ("pip", "q", "1"),
                   ("go", "g.org/a", "v1.0.0"), ("go", "g.org/c", "v3.0.0"), ("composer", "v/p", "1")}


def test_declarations(spark):
    texts = {
        "Dockerfile": "FROM go:1 AS build\nRUN a \\\n  b\nFROM build as mid\nFROM scratch\nCOPY --from=build /a /a\nCOPY --from=1 /b /b\n", "a.sql": "-- CREATE TABLE no\nCREATE TABLE s.t (x INT);\ncreate or replace view v as select 1;\n", "m.sql": "select * from {{ ref('t') }} join {{ source('a', 'b') }}",
        "api.json": '{"openapi": "3", "paths": {"/a": {"get": {"operationId": "ga"}, "x": 1}}, "components": {"schemas": {"S": {"properties": {"q": {}, "p": {}}}}}}', "api.yaml": "openapi: 3.0.0\npaths:\n  /b:\n    post:\n      operationId: pb\n",
        "p.proto": "message A { string x = 1; enum E { Z = 0; } }\nservice S { rpc F (A) returns (B); }\nenum Q { O = 0; }", "g.graphql": "type T { a: Int b(x: Int): Int }\ntype Query { q(id: ID): T }\n", "i.tf": 'resource "aws_x" "n" {\n  resource "no" "no" {\n  }\n}\nmodule "m" {\n}\ndata "d" "e" {\n}\n',
    }
    df = spark.createDataFrame(list(texts.items()), "file string, text string")
    rows = lambda what: sorted((tuple(r)[1:] for r in M.declared(df, what).collect()), key=str)
    assert rows("docker") == [(0, "build", "go:1", None), (1, "mid", "build", 0), (2, None, "scratch", 0), (2, None, "scratch", 1)]
    assert rows("sql") == [("table", "s.t", 2), ("view", "m", 1), ("view", "v", 3)]
    assert rows("dbt") == [("ref", "t", 1), ("source", "a.b", 1)]
    assert rows("openapi") == [("endpoint", "GET /a", "ga"), ("endpoint", "POST /b", "pb"), ("schema", "S", "p,q")]
    assert rows("protobuf") == [("message", "A", "x"), ("rpc", "S.F", "A -> B"), ("service", "S", "")]
    assert rows("graphql") == [("query", "q", ""), ("type", "T", "a,b")]
    assert rows("terraform") == [("module", "", "m"), ("resource", "aws_x", "n")]
    line = M.lineage(M.declared(df, "dbt"), M.declared(df, "sql").withColumn("name", F.element_at(F.split("name", r"\."), -1)))
    assert {(r.target, r.to_file) for r in line.collect()} == {("t", "a.sql"), ("a.b", None)}


def test_modules(spark):
    files = [("r/pkg/a/__init__.py", "Python", "pkg.a"), ("r/pkg/a/b.py", "Python", "pkg.a.b"), ("r/x/src/main/java/org/q/C.java", "Java", "org.q.C"), ("r/src/lib.rs", "Rust", "crate"), ("r/src/a/mod.rs", "Rust", "crate::a"), ("r/src/a/b.rs", "Rust", "crate::a::b"), ("r/in/x/f.go", "Go", "in/x"), ("r/A/B/c.cs", "CSharp", "A.B"), ("r/a.txt", "Other", None)]
    df = spark.createDataFrame([x[:2] for x in files], "file string, language string").withColumn("module", M.module_paths(F.col("file"), F.col("language")))
    assert {r.file: r.module for r in df.collect()} == {f: m for f, _, m in files}
    imports = spark.createDataFrame([("r/z.py", "Python", "pkg.a.b.name", 1), ("r/z.py", "Python", "pkg.a.*", 2), ("r/z.py", "Python", "other", 3), ("r/K.kt", "Kotlin", "org.q.C", 1), ("r/m.rs", "Rust", "crate::a::b::F", 1)], "file string, language string, path string, line int")
    got = {(r.file, r.line): r.to_file for r in M.resolve_imports(imports, df.where("module IS NOT NULL")).collect()}
    assert got == {("r/z.py", 1): "r/pkg/a/b.py", ("r/z.py", 2): "r/pkg/a/__init__.py", ("r/z.py", 3): None, ("r/K.kt", 1): "r/x/src/main/java/org/q/C.java", ("r/m.rs", 1): "r/src/a/b.rs"}
