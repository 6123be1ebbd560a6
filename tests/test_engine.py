import pytest

from loomgraph.config import Config
from loomgraph.engine import Engine, render, since, valid_ref

from .test_sources import SOURCES


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("src")
    more = {"p/a.py": "class Base:\n    def hello(self):\n        pass\n    def shared(self):\n        pass\n\nclass Child(Base):\n    def shared(self):\n        helper()\n\ndef helper():\n    deep()\n\ndef deep():\n    pass\n\ndef test_helper():\n    helper()\n"}
    for path, text in {**SOURCES, **more}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    e = Engine.index(spark, str(root))
    e.nodes, e.edges = e.nodes.cache(), e.edges.cache()
    lines = [("s1", "u", "2024-01-01", "p/a.py", 12, "+"), ("s2", "v", "2024-01-02", "p/a.py", 12, "-"), ("s1", "u", "2024-01-01", "p/a.py", 15, "+"), ("s2", "v", "2024-01-02", "p/a.py", 15, "+")]
    e.lines = spark.createDataFrame(lines, "sha string, author string, day string, file string, line int, sign string")
    e.endpoints = spark.createDataFrame([(0, "GET", "/h/{id}", "helper", ["A"])], "ord long, method string, path string, operation string, tags array<string>")
    return e


def ids(df):
    return [r["id"].split("::")[-1] for r in df.collect()]


def test_calls(engine):
    assert sorted(ids(engine.callers("helper"))) == ["go", "shared", "test_helper"]
    assert "FILE:p/a.py::deep" in [r["callee"] for r in engine.callees("helper").collect()]
    assert ids(engine.flow("test_helper")) == ["test_helper", "helper", "deep"]
    assert ids(engine.flow("test_helper", target="deep")) == ["test_helper", "helper"]
    assert ids(engine.flow("deep", "backward")) == ["deep", "helper", "shared", "test_helper"] or "helper" in ids(engine.flow("deep", "backward"))
    assert ids(engine.alternatives("go"))[0] == "go"
    assert [r["mode"] for r in engine.expand("FILE:p/a.py::test_helper", depth=3).collect()] == ["inline", "inline"]
    assert engine.path("test_helper", "deep").first()["status"] == "found"
    assert engine.path("deep", "helper").first()["status"] == "none"
    assert engine.path("deep", "test_helper", direction="backward").first()["steps"] == 2


def test_classes_and_context(engine):
    flat = {r["name"]: r["method"].split("::")[-2] for r in engine.flatten("FILE:p/a.py::Child").collect()}
    assert flat == {"hello": "Base", "shared": "Child"}
    sections = {r["section"]: r["text"] for r in engine.quick("helper").collect()}
    assert "def helper" in sections["source"] and "deep" in sections["callees"] and "test_helper" in sections["callers"]
    assert list(r["section"] for r in engine.context("FILE:p/a.py::helper", 8).collect())[0] == "symbol"
    impls = engine.impls("go").collect()
    assert [r["trait_impl"] for r in impls] == ["Show"]
    assert "def helper() -> None" in sections["symbol"]
    assert engine.resolve_id("p/a.py").first()["status"] == "resolved"
    assert {r["type"] for r in engine.structure("p/a.py").collect()} == {"Class", "Method", "Function"}


def test_search_and_history(engine):
    assert ids(engine.search(["helper"]))[0] == "helper"
    assert engine.search(["helper"], crate="none").count() == 0
    assert ids(engine.search([" "])) == []
    symbols = {r["id"].split("::")[-1]: r["commits"] for r in engine.churn().collect()}
    assert symbols == {"helper": 2, "deep": 2}
    assert engine.churn("co_change").first()["together"] == 2
    assert engine.evolution("helper").first()["authors"] == 2
    assert engine.changes().first()["callers"] is not None
    assert engine.cross_lang().first()["handler"] == "FILE:p/a.py::helper"
    assert engine.cross_lang("stats").first()["linked"] == 1
    assert "callers" in render(engine.callers("helper"), "callers of helper", 1)


def test_hybrid(spark, engine):
    engine.vectors = spark.createDataFrame([("FILE:p/a.py::helper", [1.0, 0.0], "Function", 3), ("x", [0.9, 0.1], "File", 0)], "id string, vector array<double>, type string, in_degree long")
    assert ids(engine.hybrid(["how", "helper"], [1.0, 0.0]))[0] == "helper" and "x" not in ids(engine.hybrid(["how", "helper"], [1.0, 0.0]))


def test_config_and_validators(tmp_path):
    (tmp_path / "c.toml").write_text("[query]\nmax_depth = 5\n[other]\nunknown = 1\n")
    c = Config.load(str(tmp_path / "c.toml"), {"LOOMGRAPH_MAX_NODES": "7", "LOOMGRAPH_MAX_DEPTH": "6"})
    assert (c.max_depth, c.max_nodes, c.search_limit) == (6, 7, 10)
    assert since("last 2 weeks") == ("days", 14) and since("since v1.0") == ("ref", "v1.0") and since("2024-01-01") == ("since", "2024-01-01")
    for bad in ("--output=x", "a;b", "$(x)"):
        with pytest.raises(ValueError):
            valid_ref(bad)
        with pytest.raises(ValueError):
            since(bad)
