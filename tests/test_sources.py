import json

import pytest
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.engine import Engine
from loomgraph.functions import extract
from loomgraph.sources import readers

SOURCES = {
    "a/x.py": "import os\nfrom m import q\nLIMIT = 3\n\nclass A(B):\n    def go(self):\n        return q(self.stop())\n\ndef top():\n    def inner():\n        work()\n    inner()\n",
    "b/y.rs": "use std::fs;\npub struct S;\nimpl Show for S {\n    pub fn go(&self) { // helper()\n        helper(1);\n        Self::other();\n    }\n}\nconst MAX: u32 = 3;\nfn free() {\n    s.go();\n}\n",
    "c/z.ts": "import { a } from './mod';\nexport class K extends Base {\n  run(x: number): void {\n    call(x); // no()\n  }\n}\nexport function f() {\n  g('// s', h());\n}\nconst arrow = (x) => {\n  k();\n};\n",
    "d/M.java": "import java.util.List;\npublic class M extends N {\n  public static final int TOP = 1;\n  public void go(int a) {\n    other.call();\n  }\n}\n",
    "e/w.go": "package p\nimport \"fmt\"\ntype T struct {\n}\nfunc (t *T) Go(x int) {\n\tDo(x)\n}\n",
    "f/r.rb": "require 'set'\nclass R < Q\n  def go?(a)\n    call(a) # no(1)\n  end\nend\n",
    "g/v.svelte": "<h1>x</h1>\n<script>\nfunction s() {\n  t();\n}\n</script>\n",
    "h/p.proto": "message Ask {\n}\nservice S {\n  rpc Get (Ask) returns (Reply);\n}\n",
    "bad.py": "def (:\n",
    "k/a.php": "<?php\nuse A\\B;\nclass P extends Q {\n  const TOP = 1;\n  public function go($a) {\n    $this->call($a); // no()\n  }\n}\n",
    "k/b.cs": "using System;\npublic class C : Base {\n  public int Go(int a) {\n    return Call(a);\n  }\n}\n",
    "k/c.dart": "import 'x.dart';\nclass D extends E {\n  void go(int a) {\n    call(a);\n  }\n}\n",
    "i/c.c": "#include <stdio.h>\n#define TOP 3\nstatic int run(int a) {\n  go(a);\n}\n",
}


def found(path):
    rows = extract.rows_of(path, SOURCES[path])
    nodes = [(r[3], r[4], r[5]) for r in rows if r[0] == "node"]
    edges = [(r[7].split("::")[-1], r[8], r[9]) for r in rows if r[0] == "edge"]
    return nodes, edges


def test_python():
    nodes, edges = found("a/x.py")
    assert nodes == [("File", "x.py", 1), ("Constant", "LIMIT", 3), ("Class", "A", 5), ("Method", "go", 6), ("Function", "top", 9), ("Function", "inner", 10)]
    assert ("A", "REF:B", "INHERITS") in edges and ("go", "REF:m.q", "CALLS") in edges and ("go", "REF:self.stop", "CALLS") in edges
    assert ("top", "REF:work", "CALLS") in edges and ("inner", "REF:work", "CALLS") in edges
    assert extract.rows_of("bad.py", SOURCES["bad.py"]) == []


@pytest.mark.parametrize(
    ("path", "symbols", "links", "absent"),
    [
        ("b/y.rs", {("Class", "S"), ("Method", "go"), ("Constant", "MAX"), ("Function", "free")}, {("S", "REF:Show", "INHERITS"), ("go", "REF:helper", "CALLS"), ("go", "REF:Self::other", "CALLS"), ("free", "REF:s.go", "CALLS")}, set()),
        ("c/z.ts", {("Class", "K"), ("Method", "run"), ("Function", "f"), ("Function", "arrow")}, {("K", "REF:Base", "INHERITS"), ("run", "REF:call", "CALLS"), ("f", "REF:g", "CALLS"), ("f", "REF:h", "CALLS"), ("arrow", "REF:k", "CALLS")}, {"REF:no"}),
        ("d/M.java", {("Class", "M"), ("Method", "go"), ("Constant", "TOP")}, {("M", "REF:N", "INHERITS"), ("go", "REF:other.call", "CALLS")}, set()),
        ("e/w.go", {("Class", "T"), ("Method", "Go")}, {("Go", "REF:Do", "CALLS")}, set()),
        ("f/r.rb", {("Class", "R"), ("Method", "go?")}, {("R", "REF:Q", "INHERITS"), ("go?", "REF:call", "CALLS")}, {"REF:no"}),
        ("h/p.proto", {("Class", "Ask"), ("Class", "S"), ("Function", "Get")}, {("Get", "REF:Ask", "CALLS"), ("Get", "REF:Reply", "CALLS")}, {"REF:returns"}),
        ("k/a.php", {("Class", "P"), ("Constant", "TOP"), ("Method", "go")}, {("P", "REF:Q", "INHERITS"), ("go", "REF:this.call", "CALLS")}, {"REF:no"}),
        ("k/b.cs", {("Class", "C"), ("Method", "Go")}, {("C", "REF:Base", "INHERITS"), ("Go", "REF:Call", "CALLS")}, set()),
        ("k/c.dart", {("Class", "D"), ("Method", "go")}, {("D", "REF:E", "INHERITS"), ("go", "REF:call", "CALLS")}, set()),
        ("i/c.c", {("Constant", "TOP"), ("Function", "run")}, {("run", "REF:go", "CALLS")}, set()),
    ],
)
def test_scanner(path, symbols, links, absent):
    nodes, edges = found(path)
    assert symbols <= {n[:2] for n in nodes}
    assert links <= set(edges)
    assert not absent & {e[1] for e in edges}


def test_block_ends():
    ends = {r[4]: r[6] for p in ("b/y.rs", "f/r.rb", "c/z.ts") for r in extract.rows_of(p, SOURCES[p]) if r[0] == "node" and r[3] in ("Class", "Method", "Function")}
    assert ends == {"S": 2, "go": 7, "free": 12, "R": 6, "go?": 5, "K": 6, "run": 5, "f": 9, "arrow": 12}


def details(path, text):
    names = [c.split()[0] for c in extract.SCHEMA.split(", ")]
    return {r["name"]: r for r in (dict(zip(names, x)) for x in extract.rows_of(path, text)) if r["kind"] == "node"}


def test_details():
    py = details("a.py", 'import os.path as p\nX = 3\nclass A:\n    """Doc."""\n    @p.wrap\n    def go(self, n: dict[str, int], *, k=1) -> "B | None":\n        "Does."\n        p.join()\n')
    assert py["go"]["signature"] == "def go(self, n: dict[str, int]) -> 'B | None'" and py["go"]["param_types"] == ["Any", "dict[str, int]"]
    assert (py["go"]["docstring"], py["A"]["docstring"], py["X"]["value"], py["go"]["token_count"]) == ("Does.", "Doc.", "3", 30)
    rs = details("a.rs", "/// A kind.\npub enum Kind {\n    First,\n    Other(u8),\n}\nimpl Show for Kind {\n    /// Shows it.\n    /// Twice.\n    fn show(&self, m: HashMap<String, u8>,\n        n: &str) -> Result<(), E> {\n        Kind::new(1);\n        let x = Point { x: 1 };\n    }\n}\nconst TOP: u8 = 7;\n")
    show = rs["show"]
    assert (show["signature"], show["trait_impl"], show["docstring"]) == ("fn show(...) -> Result<(), E>", "Show", "Shows it.\nTwice.")
    assert show["param_types"] == ["&self", "HashMap<String, u8>", "&str"] and show["end_lineno"] == 13 and show["token_count"] == 50
    assert rs["First"]["signature"] == "Kind::First" and rs["Other"]["type"] == "Function" and rs["Kind"]["docstring"] == "A kind." and rs["TOP"]["value"] == "7"
    links = {(r[7].split("::")[-1], r[8]) for r in extract.rows_of("a.rs", "fn f() {\n    Kind::new(1);\n    let x = Point { x: 1 };\n}\n") if r[9] == "INSTANTIATES"}
    assert links == {("f", "REF:Kind"), ("f", "REF:Point")}
    ts = details("a.ts", "class K {\n  run(x: Map<string, number>, y = 1): Promise<void> {\n  }\n  get size(): number {\n  }\n}\nconst arrow = (x) => {\n};\napi.interceptors.request.use((c) => {\n  return c;\n});\napp.use(cors);\nbus.on('a:b', go);\nconst LIMIT = 4;\n")
    assert ts["run"]["signature"] == "function run(p0: Map<string, number>, p1: any): Promise<void>" and ts["size"]["signature"] == "get size(): number"
    assert ts["arrow"]["signature"] == "const arrow = (...) => ..." and ts["LIMIT"]["value"] == "4"
    assert {n: (r["lineno"], r["end_lineno"]) for n, r in ts.items() if r["type"] == "Configuration"} == {"api_request_interceptor": (9, 11), "middleware_cors": (12, 12), "bus_on_a_b": (13, 13)}


def test_block_that_ends_after_a_call():
    assert details("a.java", "class A {\n  public int f() {\n    return b(); }\n  public int g() {\n    return c();\n")["f"]["end_lineno"] == 3
    rows = extract.rows_of("a.cs", "class A\n{\n  public int F(int a,\n    int b)\n  {\n    Go(a);\n  }\n  public int G()\n  {\n    Do();\n  }\n}\n")
    assert [(r[7].split("::")[-1], r[8]) for r in rows if r[9] == "CALLS"] == [("F", "REF:Go"), ("G", "REF:Do")]
    assert {r[4]: r[6] for r in rows if r[0] == "node" and r[3] != "File"} == {"A": 12, "F": 7, "G": 11}


def test_svelte_lines():
    assert ("Function", "s", 3) in found("g/v.svelte")[0]


def test_extract_and_tree(spark, tmp_path):
    for path, text in SOURCES.items():
        file = tmp_path / "src" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    (tmp_path / "src" / "node_modules").mkdir()
    (tmp_path / "src" / "node_modules" / "n.ts").write_text("function z() {}")
    (tmp_path / "src" / "a" / "sub").mkdir()
    (tmp_path / "src" / "a" / "sub" / "a.py").write_text("x = 1\n")
    tree = readers.source_tree(spark, str(tmp_path / "src"))
    paths = [r["path"] for r in tree.orderBy("order_key").collect()]
    assert set(paths) == {*SOURCES, "a/sub/a.py"} and paths[0] == "bad.py" and paths.index("a/x.py") < paths.index("a/sub/a.py")
    rows = extract.extract(tree)
    assert rows.where("type = 'File'").count() == len(SOURCES)


def test_graph_gate(spark, tmp_path):
    graph = {"schema_version": 1, "nodes": [{"id": "FILE:a.py", "type": "File", "metadata": {"name": "a.py"}}], "edges": [{"source": "FILE:a.py", "target": "REF:x", "relation": "CALLS"}]}
    (tmp_path / "g.json").write_text(json.dumps(graph))
    nodes, edges = schema.read_graph(spark, str(tmp_path / "g.json"))
    assert nodes.collect()[0]["name"] == "a.py" and edges.collect()[0]["target"] == "REF:x"
    schema.write_graph(nodes, edges, str(tmp_path / "out"))
    broken = nodes.withColumn("name", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        schema.write_graph(broken, edges, str(tmp_path / "out"))
    kept = Engine.load(spark, str(tmp_path / "out"))
    assert [r["id"] for r in kept.nodes.collect()] == ["FILE:a.py"] and kept.edges.count() == 1
    schema.export_graph(nodes, edges, str(tmp_path / "doc"))
    assert [r["name"] for r in Engine.load(spark, str(tmp_path / "doc")).nodes.collect()] == ["a.py"]
    (tmp_path / "h.json").write_text(json.dumps(graph | {"schema_version": 2}))
    with pytest.raises(ValueError, match="version"):
        schema.read_graph(spark, str(tmp_path / "h.json"))


def test_text_sources(spark, tmp_path):
    a, b = "a" * 40, "b" * 40
    lines = spark.createDataFrame([(0, k, t) for k, t in enumerate([a, "", "x.py", "y.py", b, "x.py", "x.py"])], "log int, k int, text string")
    assert sorted(map(tuple, readers.name_only_log(lines).collect())) == [(a, "x.py"), (a, "y.py"), (b, "x.py")]
    stat = spark.createDataFrame([("3\t1\ta.py",), ("-\t-\tb.png",), ("noise",)], "text string")
    assert sorted(map(tuple, readers.numstat(stat).collect())) == [("a.py", 3, 1), ("b.png", 0, 0)]
    (tmp_path / "o.json").write_text(json.dumps({"paths": {"/u/{id}": {"get": {"operationId": "getU", "tags": ["T"]}, "head": {"operationId": "no"}, "post": {}}}}))
    assert [tuple(r)[:3] for r in readers.openapi(spark, str(tmp_path / "o.json")).collect()] == [("GET", "/u/{id}", "getU")]
    part = lambda n, raw: bytes([n << 3 | 2, len(raw)]) + raw
    occurrence = part(1, bytes([4, 0, 3])) + part(2, b"sym a") + bytes([3 << 3, 1])
    (tmp_path / "i.scip").write_bytes(part(2, part(1, b"src/a.ts") + part(2, occurrence)))
    assert [tuple(r) for r in readers.symbol_index(spark, str(tmp_path / "i.scip")).collect()] == [("src/a.ts", "sym a", 4, True)]
