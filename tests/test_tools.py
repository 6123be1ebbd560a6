import json
import subprocess

import pytest
from pyspark.sql import functions as F

from loomgraph import api, sinks
from loomgraph.__main__ import main
from loomgraph.config import Config
from loomgraph.engine import Engine, render
from loomgraph.functions import extract
from loomgraph.functions import names as N
from loomgraph.operators import history, resolve
from loomgraph.sources import projects, readers, versions

from .test_engine import engine  # noqa: F401


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")

    def git(*args):
        subprocess.run(["git", "-c", "user.name=A B", "-c", "user.email=a@b", *args], cwd=root, check=True, capture_output=True)

    git("init", "-q")
    for k, text in enumerate(["def f():\n    return 1\n", "def f():\n    return 2\n", "def f():\n    return 2\n\ndef g():\n    pass\n"]):
        (root / "a.py").write_text(text)
        (root / f"b{k}.txt").write_text("x")
        git("add", "-A")
        git("commit", "-q", "-m", f"change {k}")
    return str(root)


def test_version_control(spark, repository):
    log = versions.run(spark, repository, versions.name_only_args(excluded=["b1.txt"]))
    files = sorted(r["file"] for r in readers.name_only_log(log).collect())
    assert files == ["a.py", "a.py", "a.py", "b0.txt", "b2.txt"]
    assert sorted(r["file"] for r in readers.name_only_log(versions.run(spark, repository, versions.name_only_args(path="b2.txt"))).collect()) == ["b2.txt"]
    stat = readers.numstat(versions.run(spark, repository, versions.diff_args("HEAD~1..HEAD", numstat=True)))
    assert sorted(map(tuple, stat.collect())) == [("a.py", 3, 0), ("b2.txt", 1, 0)]
    diff = versions.run(spark, repository, versions.diff_args("HEAD~2..HEAD~1", "a.py")).withColumnRenamed("log", "diff")
    assert sorted((r["line"], r["sign"]) for r in history.parse_diff(diff).collect()) == [(1, " "), (2, "+"), (2, "-")]
    own = versions.symbol_history(spark, repository, "a.py", "f", (1, 2)).orderBy("place").collect()
    assert [r["subject"] for r in own][-1] == "change 0" and own[0]["author"] == "A B" and sum(r["added"] for r in own) >= 2
    by_lines = versions.symbol_history(spark, repository, "a.py", "f?", (4, 5)).collect()
    assert by_lines and by_lines[0]["level"] == 1
    of_file = versions.symbol_history(spark, repository, "b0.txt", "<init>").collect()
    assert [(r["level"], r["subject"]) for r in of_file] == [(2, "change 0")]
    with pytest.raises(ValueError):
        versions.run(spark, repository, ["log", "nothing..here"])


def test_arguments():
    assert versions.time_args("last 2 weeks") == ["--since=14 days ago"] and versions.time_args("since v1") == ["v1..HEAD"]
    for bad in ("-x", "../a", "/etc/x", ":!x", "a\nb", ""):
        with pytest.raises(ValueError):
            versions.valid_path(bad)
    for bad in ("a b", "1x", "x;y"):
        with pytest.raises(ValueError):
            versions.history_args("a.py", bad)
    kept = versions.safe_env({"PATH": "x", "MY_TOKEN": "x", "DATABASE_URL": "x", "API_KEY": "x", "HOME": "y"})
    assert kept == {"PATH": "x", "HOME": "y"}
    assert projects.command("rust", "core", "o.scip", ("--quiet",)) == ["rust-analyzer", "scip", "core", "--output", "o.scip", "--quiet"]
    with pytest.raises(ValueError):
        projects.command("go", "", "o", ("rm",))
    assert projects.available("no-such-program-at-all") is None
    assert set(projects.status(lambda program: "1.0")) == set(projects.ADAPTERS)


def test_registered_language(spark):
    lua = extract.Language((".lua",), r"^$", r"^\s*(?:local\s+)?function\s+(?P<n>\w+)", r"^\s*require\s+'(?P<n>[^']+)'", comment="--", blocks="indent")
    extract.register("lua", lua)
    try:
        rows = extract.rows_of("x.lua", "require 'a'\nfunction go()\n  call() -- no()\nend\n")
        assert [r[3:5] for r in rows if r[0] == "node"] == [("File", "x.lua"), ("Function", "go")]
        assert ("FILE:x.lua::go", "REF:call") in [(r[7], r[8]) for r in rows if r[0] == "edge"]
    finally:
        del extract.LANGUAGES["lua"], extract.BY_EXTENSION[".lua"]
    long = "func F() {\n" + "\tx(1)\n" * 3000 + "}\n"
    assert [r[6] for r in extract.rows_of("a.go", long) if r[4] == "F"] == [3002]
    made = "// Code generated by x. DO NOT EDIT.\npackage p\nfunc F() {\n\tg()\n}\n"
    assert not [r for r in extract.rows_of("a.go", made) if r[9] == "CALLS"] and extract.rows_of("a.go", made)


def test_vectors_and_manifests(spark, tmp_path):
    rows = spark.createDataFrame([("a", "text a", [1.0, 0.0]), ("b", "text b", [0.0, 1.0])], "id string, text string, vector array<double>")
    path = str(tmp_path / "vectors")
    assert sinks.load_vectors(spark, path, "k1") is None
    sinks.save_vectors(rows, path, "k1")
    sinks.save_vectors(rows.limit(1), path, "k2")
    assert sinks.load_vectors(spark, path, "k1") is None and sinks.load_vectors(spark, path, "k2").count() == 1
    sinks.save_vectors(rows.withColumn("vector", F.when(F.col("id") == "a", F.col("vector"))), path, "k3")
    assert sinks.load_vectors(spark, path, "k3") is None
    with pytest.raises(Exception, match="no"):
        sinks.save_vectors(rows.withColumn("text", F.raise_error(F.lit("no")).cast("string")), path, "k3")
    sinks.save_vectors(rows, path, "k4")
    with pytest.raises(Exception, match="no"):
        sinks.save_vectors(rows.withColumn("text", F.raise_error(F.lit("no")).cast("string")), path, "k5")
    assert sinks.load_vectors(spark, path, "k4").count() == 2
    seen = sinks.Answered(3, 2)
    for k in "abcd":
        seen.note(k, "v1", f"node {k}")
    assert seen.again("a", "v1") is None and seen.again("d", "v1") == "node d" and seen.again("d", "v2") is None
    assert sinks.fenced("") == "" and "\nx\n" in sinks.fenced("x") and sinks.fenced("x") != sinks.fenced("x")
    told = list(sinks.events(iter([("scan", 3)])))
    assert [x.split("\n")[0] for x in told] == ["event: start", "event: output", "event: done"]


def test_reports(spark, engine):  # noqa: F811
    text = {r["section"]: r["text"] for r in engine.context("FILE:p/a.py::test_helper", depth=3, expand=True).collect()}
    assert "FILE:p/a.py::deep (inline)" in text["callees"] and "def helper" in text["expanded"]
    brief = [r["section"] for r in engine.context("FILE:p/a.py::helper", brief=True).collect()]
    assert brief == ["symbol", "callers"]
    head = {r["section"]: r["text"] for r in engine.context("FILE:p/a.py::helper", head_lines=1).collect()}
    assert head["source"].split("\n") == ["def helper():", "... (1 more lines)"]
    assert {r["type"]: r["shown"] for r in engine.structure("a/x.py").collect()}["Imports"] == "m.q, os"
    assert [r["text"] for r in readers.segment(engine.files, "p/a.py", 11, 12).orderBy("place").collect()] == ["def helper():", "    deep()"]
    assert engine.source("p/a.py", 12).first()["target" if False else "language"] == "python"
    assert engine.churn("files", time_range="last 30 days", today="2024-01-05").count() == 1
    assert engine.churn("files", time_range="2024-02-01").count() == 0
    assert engine.churn(path="q").count() == 0 and engine.churn(path="p").count() == 2
    assert engine.change_totals().first().asDict() == {"files": 1, "commits": 2, "symbols": 2}
    assert "STALE" in render(engine.status(), "s", nodes=1000, edges=2, age_hours=30.0)


def test_routes(spark, engine):  # noqa: F811
    status, body = api.respond(engine, "/api/callers", {"name": "helper", "limit": "2"})
    assert status == 200 and len(json.loads(body)["rows"]) == 2
    assert api.respond(engine, "/api/callers", {})[0] == 400 and api.respond(engine, "/api/none", {})[0] == 404
    assert api.respond(engine, "/api/flow", {"name": "helper", "direction": "up"})[0] == 400
    assert json.loads(api.respond(engine, "/api/status", {})[1])["rows"][0]["nodes"] > 10
    assert all(callable(getattr(Engine, method)) for method, _, _ in api.ROUTES.values())


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def f():\n    g()\n\n\ndef g():\n    pass\n")
    at = ["--graph", str(tmp_path / "graph"), "--root", str(tmp_path / "src")]
    assert main([*at, "ensure"], spark) == 0
    first = Engine.load(spark, str(tmp_path / "graph")).nodes.inputFiles()
    assert main([*at, "ensure"], spark) == 0 and Engine.load(spark, str(tmp_path / "graph")).nodes.inputFiles() == first
    assert main([*at, "ensure", "--max-age-hours", "0"], spark) == 0 and Engine.load(spark, str(tmp_path / "graph")).nodes.inputFiles() != first
    capsys.readouterr()
    assert main([*at, "--json", "callers", "g"], spark) == 0
    assert json.loads(capsys.readouterr().out)["name"] == "f"
    assert main([*at, "quick", "g"], spark) == 0 and "def g():" in capsys.readouterr().out
    assert main([*at, "health"], spark) == 0 and "false" in capsys.readouterr().out.lower()
    with pytest.raises(SystemExit):
        main(["nothing"])


def test_symbol_index_in_resolution(spark, tmp_path):
    (tmp_path / "web").mkdir()
    (tmp_path / "web" / "a.ts").write_text("export function one() {\n  two();\n}\n")
    (tmp_path / "web" / "b.ts").write_text("export function two() {\n}\n")
    (tmp_path / "web" / "c.ts").write_text("export function two() {\n}\n")
    symbol = "scip-typescript npm web 1.0 src/`c.ts`/two()."
    occurrences = spark.createDataFrame([(0, "c.ts", symbol, 0, True), (1, "a.ts", symbol, 1, False)], "place long, file string, symbol string, line int, is_definition boolean")
    e = Engine.index(spark, str(tmp_path), occurrences)
    calls = e.edges.where("relation = 'CALLS_RESOLVED'").collect()
    assert [r["target"] for r in calls] == ["FILE:web/c.ts::two"]
    plain = Engine.index(spark, str(tmp_path)).edges.where("relation = 'CALLS_RESOLVED'").collect()
    assert [r["target"] for r in plain] == ["FILE:web/b.ts::two"]


def test_vocabulary(spark):
    rows = spark.createDataFrame([("os.path.join",), ("strip",), ("mine",), ("x.mine",), ("Vec<Vec<u8>>::new",), ("Mine::new",), ("std::x::y",), ("console.log",), ("a.b.c.d",), ("fmt.Println",)], "c string")
    got = {r["c"]: r["out"] for r in rows.select("c", resolve.non_project(F.col("c")).alias("out")).collect()}
    assert got == {"os.path.join": True, "strip": True, "mine": False, "x.mine": False, "Vec<Vec<u8>>::new": True, "Mine::new": False, "std::x::y": True, "console.log": True, "a.b.c.d": False, "fmt.Println": True}
    assert len(resolve.STDLIB) > 500


def test_configuration(tmp_path):
    (tmp_path / "c.toml").write_text('test_dirs = ["/checks/"]\n[history]\nexcluded = ["gen/"]\n')
    c = Config.load(str(tmp_path / "c.toml"), {"LOOMGRAPH_HANDLERS": "core/,app/"})
    assert c.test_dirs == ("/checks/",) and c.excluded == ("gen/",) and c.handlers == ("core/", "app/")
    assert N.CODE and c.code == tuple(N.CODE)
