import subprocess

import pytest
from pyspark.sql import functions as F

from codestrata.sources import git, hosting, reports, sinks
from codestrata.sources.languages import language, line_count
from codestrata.sources.tree import indexed, read_tree, reindexable


def lines(spark, text, **cols):
    rows = [(*cols.values(), i, x) for i, x in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, ", ".join([*(f"{c} string" for c in cols), "ord int", "value string"]))


def test_languages(spark):
    cases = {"a/b.rs": "Rust", "x.h": "Other", "Dockerfile": "Dockerfile", "d/Dockerfile.dev": "Dockerfile", "a.dockerfile": "Dockerfile", "a.tsx": "TypeScript", "noext": "Other", "A.PY": "Python", "a.lua": "Other"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.l for r in df.select("p", language(F.col("p")).alias("l")).collect()} == cases
    t = spark.createDataFrame([("",), ("a",), ("a\n",), ("a\n\n",), (None,)], "t string")
    assert [r.n for r in t.select(line_count(F.col("t")).alias("n")).collect()] == [0, 1, 1, 2, 0]


@pytest.fixture
def repo(tmp_path):
    r = tmp_path / "proj"
    (r / "src").mkdir(parents=True)
    (r / "build").mkdir()
    (r / "src" / "a.py").write_text("x = 1\n")
    (r / "src" / ".env").write_text("A=1\n")
    (r / "build" / "o.py").write_text("y\n")
    (r / "b.bin").write_bytes(b"\xff\xfe\x00")
    (r / "c.log").write_text("l")
    (r / "keep.log").write_text("l")
    (r / ".gitignore").write_text("build/\n*.log\n!keep.log\n")
    return r


def test_tree(spark, repo):
    t = read_tree(spark, str(repo))
    got = {x.file: (x.language, x.lines, x.readable) for x in t.collect()}
    assert got == {"proj/src/a.py": ("Python", 1, True), "proj/src/.env": ("Other", 1, True), "proj/b.bin": ("Other", 0, False), "proj/keep.log": ("Other", 1, True), "proj/.gitignore": ("Other", 3, True)}
    known, rest = indexed(t)
    assert known.count() == 1 and rest.collect()[0].other_files == 4
    assert reindexable("src/a.py") and not reindexable(".git/HEAD") and not reindexable("x/.codestrata/y")


def test_log(spark, repo):
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=Ann", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "src/a.py")
    run("commit", "-qm", "Add a\n\nbody #1")
    (repo / "src" / "a.py").write_text("x = 2\n")
    run("commit", "-qam", "Fix a")
    got = git.read_log(spark, str(repo)).orderBy("log_ord").collect()
    assert [(r.log_ord, r.author, r.author_email, r.message, r.files) for r in got] == [(0, "Ann", "a@x", "Fix a", ["proj/src/a.py"]), (1, "Ann", "a@x", "Add a", ["proj/src/a.py"])]
    assert git.read_log(spark, str(repo), limit=1).count() == 1


def test_log_text(spark):
    df = spark.createDataFrame([("h1\x1fAnn\x1fa@x\x1f12\x1fSay: a\x1fb\nf1\nf2\n",), ("h2\x1fBo\x1fb@x\x1fzz\x1f",), ("\n",)], "value string")
    assert [tuple(r) for r in git.parse_log(df).collect()] == [("h1", "Ann", "a@x", 12, "Say: a\x1fb", ["f1", "f2"]), ("h2", "Bo", "b@x", None, "", [])]


def test_numstat_blame_diff(spark):
    assert [tuple(r) for r in git.parse_numstat(lines(spark, "3\t1\ta b\n-\t-\tbin\njunk")).collect()] == [(3, 1, "a b"), (0, 0, "bin")]
    b = git.parse_blame(lines(spark, "author Ann\nauthor-mail x\nauthor Bo\nauthor Ann\nauthor Ann", file="f").withColumn("file", F.lit("f")))
    assert {(r.author, r.lines, r.percentage) for r in b.collect()} == {("Ann", 3, 75.0), ("Bo", 1, 25.0)}
    diff = "--- a/x.c\n+++ b/x.c\n@@ -1,3 +1,4 @@ f\n a\n-b\n+c\n+d\n e\n@@ -9 +10 @@\n-q\n+r\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-z"
    rows = [("d", i, x) for i, x in enumerate(diff.split("\n"))]
    assert sorted(tuple(r) for r in git.parse_diff(spark.createDataFrame(rows, "diff string, ord int, value string")).collect()) == [("x.c", 2), ("x.c", 3), ("x.c", 10)]


def test_lcov(spark):
    text = "TN:one\nSF:/w/p/src/a.py\nDA:1,2\nDA:2,0,abc\nend_of_record\nTN: \nSF:src/a.py\nDA:1,1\nend_of_record\nSF:/else/z.py\nDA:1,1\nend_of_record"
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(text.split("\n"))], "report string, ord int, value string")
    hits, tests = reports.parse_lcov(df)
    assert {tuple(r) for r in tests.collect()} == {("one", "/w/p/src/a.py", 1)}
    placed, lost = reports.place(hits, spark.createDataFrame([("p/src/a.py",), ("q/b.py",)], "file string"))
    assert {tuple(r) for r in placed.collect()} == {("p/src/a.py", 1, 1), ("p/src/a.py", 2, 0)} and [r.path for r in lost.collect()] == ["/else/z.py"]
    for wrong in ("DA:1,1", "SF:a\nDA:x,1"):
        bad = spark.createDataFrame([("r", i, x) for i, x in enumerate(wrong.split("\n"))], "report string, ord int, value string")
        with pytest.raises(Exception, match="line data"):
            reports.parse_lcov(bad)[0].collect()


def test_stored_pages_of_a_host(spark, tmp_path):
    (tmp_path / "p1.json").write_text('[{"number": 1, "title": "Migrate to rows", "body": null, "merged_at": "2024", "files": [{"filename": "a.c"}]}, {"number": 2, "title": "x", "merged_at": null}, {"title": "no number", "merged_at": "2024"}]')
    (tmp_path / "p2.json").write_text('[{"number": 1, "title": "Migrate to rows", "body": null, "merged_at": "2024", "files": [{"filename": "a.c"}]}, {"number": 3, "title": "Typo", "body": "small", "merged_at": "2024", "other": 1}]')
    got = hosting.merged_changes(spark, str(tmp_path))
    assert {(r.number, tuple(r.files)) for r in got.collect()} == {(1, ("a.c",)), (3, ())}
    assert [r.id for r in hosting.change_decisions(got).collect()] == ["pr:1"]
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "1.json").write_text('[{"number": 5, "state": "closed", "labels": [{"name": "Bug: core"}]}, {"number": 6, "state": "open", "labels": [{"name": "bug"}]}, {"number": 7, "state": "closed", "labels": []}, {"number": 8, "state": "closed"}]')
    assert [r.number for r in hosting.closed_bugs(spark, str(tmp_path / "i")).collect()] == [5]
    (tmp_path / "d.jsonl").write_text('{"id": "m1", "title": "t"}\n{"title": "no id"}\n')
    assert [(r.id, r.title, r.body) for r in hosting.read_decisions(spark, str(tmp_path / "d.jsonl")).collect()] == [("m1", "t", None)]


def test_pages_are_exported_once(spark, tmp_path):
    pages = spark.createDataFrame([("a", "# a\n\nx"), ("b/c", "# b")], "file string, page string")
    out = str(tmp_path / "out")
    sinks.export_pages(pages, out)
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.export_pages(pages, out)
    sinks.export_pages(pages, out, overwrite=True)
    assert {(r.file, r.value) for r in spark.read.text(out, wholetext=True).collect()} == {("a", "# a\n\nx\n"), ("b/c", "# b\n")}


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rec = spark.createDataFrame([(1, "ran", "npm", 100, 10, "d", None), (2, "ran", "go", 5, 5, "", 1)], reports.LEDGER)
    reports.append_ledger(rec, path)
    (tmp_path / "ledger" / "part-x.csv").write_text("broken line\nzz\tran\n")
    got = {r.at: (r.program, r.exit_code) for r in reports.read_ledger(spark, path).collect()}
    assert got == {1: ("npm", None), 2: ("go", 1)}


def test_index_round_trips(spark, tmp_path):
    files = spark.createDataFrame([("r", "/w/a.py", 1), ("r", "/w/b.py", 2)], "repo string, file string, lines long")
    calls = spark.createDataFrame([("/w/a.py", "/w/a.py::f@1", "g", 2), ("/w/b.py", None, "g", 3), ("/w/b.py", "/w/b.py::h@1", "g", 3)], "file string, caller string, callee_name string, line int")
    p = str(tmp_path / "i")
    assert sinks.read_status(spark, p) is None
    with pytest.raises(FileNotFoundError):
        sinks.read_index(spark, p)
    sinks.write_index({"files": files, "calls": calls}, p, "0123456789abcdef")
    assert sinks.read_status(spark, p) == {"version": 2, "indexed_commit": "0123456789ab", "files": 2}
    assert sinks.read_index(spark, p)["calls"].count() == 3
    q = str(tmp_path / "p")
    sinks.write_portable({"files": files, "calls": calls}, "/w", q)
    assert {r.file for r in spark.read.parquet(q + "/files").collect()} == {"a.py", "b.py"}
    back = sinks.read_portable(spark, q, "/v", ["files", "calls"])
    assert {(r.file, r.caller) for r in back["calls"].select("file", "caller").collect()} == {("/v/a.py", "/v/a.py::f@1"), ("/v/b.py", None), ("/v/b.py", "/v/b.py::h@1")}


def test_dependents_pages_and_store(spark, tmp_path):
    edges = spark.createDataFrame([("b", "a", "imports"), ("c", "a", "imports"), ("b", "a", "imports")], "src string, dst string, kind string")
    p = str(tmp_path / "d")
    sinks.write_dependents(edges, p)
    assert sinks.dependents(spark, p, "a") == ["b", "c"] and sinks.dependents(spark, p, "z") == [] and sinks.dependents(spark, p + "x", "a") is None
    sinks.write_index({"files": edges}, str(tmp_path / "new"))
    assert sinks.dependents(spark, p, "a", str(tmp_path / "new")) is None and sinks.dependents(spark, p, "a", str(tmp_path / "none")) == ["b", "c"]
    files = spark.createDataFrame([("a", "Go", 3), ("b", "Go", 4)], "file string, language string, lines long")
    symbols = spark.createDataFrame([("b", 1, "Function", "f")], "file string, start_line int, kind string, name string")
    pages = sinks.wiki_pages(files, symbols, edges)
    held = pages.where("file = 'a'").select("file", "digest").union(spark.createDataFrame([("b", "x"), ("gone", "y")], "file string, digest string"))
    assert {(r.file, r.state) for r in sinks.freshness(pages, held).collect()} == {("a", "unchanged"), ("b", "changed"), ("gone", "missing")}
    assert "`f` at line 1" in pages.where("file = 'b'").first().page
    js = {r.json for r in sinks.graph_json(spark.createDataFrame([("a",), ("b",)], "id string"), edges).collect()}
    assert js == {'{"id":"a","edges":[]}', '{"id":"b","edges":[{"dst":"a","kind":"imports"}]}'}
    store = sinks.omissions(spark.createDataFrame([("x",), ("x",), (None,), ("yy",)], "text string"))
    assert store.count() == 2
    ref = store.where("text = 'x'").first().ref
    assert sinks.find_omission(store, ref) == "x"
    with pytest.raises(KeyError):
        sinks.find_omission(store, "none")
    s = spark.createDataFrame([("old", 1, 0), ("a", 6, 900_000), ("b", 6, 900_001), ("c", 3, 890_000), ("mine", 50, 1)], "ref string, size long, at long")
    assert {r.ref for r in sinks.prune(s, 900_010, "mine", ttl=20_000, room=12).collect()} == {"a", "b", "mine"}
    moved = spark.createDataFrame([("a", "b"), ("a", "a"), (None, "b"), ("a", None)], "x string, y string").select(sinks.head_moved(F.col("x"), F.col("y")).alias("m"))
    assert [r.m for r in moved.collect()] == [True, False, False, False]
