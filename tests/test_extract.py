"""Symbols, relations, side lists and recovery on small sources of every language."""

import json

import pytest
from pyspark.sql import functions as F

from symlake.functions import scan
from symlake.operators.extract import analyse
from symlake.plans import project as P
from symlake.schemas import CONTROL_WORDS

# Sources of our own: stock keeping, each with nesting, modifiers or an error that the rules of the survey tell apart.
SOURCES = {
    "js/stock.js": "// counts of a shelf\nvar shelf = {\n  add: function (n) { return total(n) + 1 },\n  'cap': 12,\n};\nasync function total(n) {\n  const price = (k) => tax(k) * n;\n  return price(2);\n}\nexports.tax = (k) => k / 5;\n",
    "js/till.js": 'let { total: sum, tax } = require("./stock");\nconst paper = require(\'left-pad\');\nfunction close(day) {\n  if (day) { sum(day); }\n  return paper("close(1)");\n}\n',
    "ts/units.ts": "export enum Size { S, M }\nexport type Grams = number;\nexport const round = (g: Grams): Grams => Math.floor(g);\nexport default class Scale<T> {\n  private zero = 0;\n  constructor(readonly step: Grams) { this.reset(step); }\n  async reset(to: Grams): Promise<void> {\n    this.zero = round(to);\n  }\n}\n",
    "ts/weigh.ts": "import * as units from './units';\nimport { round as near, Size } from \"./units\";\n\nexport async function weigh(box: Map<string, Size>, gap = 3, ...rest: number[]): Promise<number> {\n  for (const [k] of box) { near(gap); }\n  return units.round(gap);\n}\n",
    "ts/torn.ts": "export interface Slip { no: number }\nexport async function print(s: Slip) {\n  while (s.no {\n    feed(s);\n  }\n}\nfunction feed(s: Slip) { return ink(s) }\nconst ink = (s: Slip) => s.no;\n",
    "php/Depot.php": "<?php\nnamespace Yard;\nabstract class Depot implements Countable {\n    const ROWS = 9;\n    protected static ?int $free = null;\n    public function __construct(private int $rows) { $this->clear(); }\n    final protected function clear(): void { self::$free = rows_of($this); }\n}\ninterface Gate { public function open(string $by = 'x'); }\nfunction rows_of(Depot $d) { return 1; }\n",
    "php/Torn.php": "<?php\ntrait Moves {\n    private function lift($n) { return [$n; }\n    public function drop($n) { return $this->lift($n); }\n}\n",
    "swift/Crate.swift": "import UIKit\n\nindirect enum Crate {\n    case open\n    case shut(Int)\n    var full: Bool { weight() > 3 }\n    mutating func weight() -> Int { scale(1) }\n}\nextension Crate {\n    init?(raw: Int) { nil }\n}\nfunc scale(_ by: Int) -> Int { by }\n",
    "py/route.py": "from . import maps as m\nimport json, heapq as hq\n\nLIMIT = 3\n\n@cache\ndef near(a, *, far: float = 1.0, **more) -> list[int]:\n    def inner(): return m.at(a)\n    return hq.nsmallest(2, inner())\n\nclass Van(Truck):\n    class Door:\n        def shut(self): ...\n    @property\n    def load(self): return near(1)\n    @staticmethod\n    async def drive(km: int): await go(near(km))\n\nasync def go(x): return x\n",
    "py/torn.py": "class Fleet:\n    size = [1, 2\n\n    def grow(self, by):\n        return more(by)\n\ndef more(by):\n    return Fleet(by\n",
    "rs/dock.rs": "#![allow(dead_code)]\nuse std::{fmt, io::Read as R};\npub(crate) trait Moor { fn tie(&self) -> bool; }\npub enum Ship { Tug, Liner { decks: u8 } }\nimpl<'a> Moor for Ship {\n    fn tie(&self) -> bool { knots('x', 2) > 1 }\n}\npub mod quay {\n    pub fn length() -> u32 { 9 }\n}\nconst PIERS: usize = 4;\nunsafe fn knots<T>(c: T, n: u8) -> u8 { n }\n",
    "rs/torn.rs": "struct Rope { len: u8 }\nfn cut(r: Rope) -> u8 {\n    r.len + join(r)]\n}\nfn join(r: Rope) -> u8 { r.len }\n",
    "java/Silo.java": "package farm;\nimport static java.lang.Math.max;\nimport java.util.*;\n@Deprecated\npublic abstract class Silo<T extends Grain> implements Store {\n    public static final int TOP = 40;\n    protected Map<String, T> held;\n    Silo(int top) { fill(top, null); }\n    @Override\n    public synchronized <K> int fill(int n, K by) throws Full { return weigh(n); }\n    private int weigh(int n) { return max(n, TOP); }\n    enum State { EMPTY, FULL }\n    interface Grain { int grams(); }\n}\n",
    "java/Torn.java": "class Mill {\n    int grind(int n) {\n        for (int k = 0; k < n; k++) {\n            turn(k);\n        return n;\n    }\n    int turn(int k) { return k; }\n}\n",
    "cs/Kiln.cs": "using System.Linq;\nnamespace Clay.Fire {\n    public sealed record Pot(int Size);\n    internal partial class Kiln : IDisposable {\n        public int Heat { get; private set; } = 20;\n        protected Kiln(int heat) : base() { Heat = Warm(heat); }\n        public async Task<int> Bake(Pot p) { return Warm(p.Size); }\n        private static int Warm(int by) => by + 1;\n    }\n}\n",
    "cpp/loom.cpp": "#include <map>\n#include \"yarn.hpp\"\nnamespace mill {\ntemplate <class T> struct Loom final : Base<T> {\n  virtual ~Loom();\n  inline int weave(const T& t, int rows = 2) const noexcept { return rows; }\n};\n}\nstatic unsigned spin(char* c) { return *c; }\n",
    "m/Wheel.m": "#import \"Wheel.h\"\n#include <math.h>\n@implementation Wheel\n+ (instancetype)wheelOf:(double)radius { return nil; }\n- (void)turn { spin(1); }\n@end\nstatic int spin(int n) { return n; }\n",
    "web/shop.html": "<!doctype html><html><head><script>var x = '<div class=\"never\">';</script><LINK HREF='look.css' REL='stylesheet'><script type=module src=\"./cart.js?v=2\"></script></head>\n<body class='page wide'><p class=\"price  low\">1</p></body></html>",
    "web/look.css": "/* .not { } */\n:root { --gap: 4px; }\n.page > .price:hover, .wide { margin: var(--gap) }\n",
    "web/cart.js": "class Cart {\n  #sum = 0;\n  static of(n) { return new Cart().put(n); }\n  put(n) { this.count = n; return this; }\n}\nrouter.put('/cart/:id', Cart.of);\n",
    "qml/Dial.qml": "import QtQuick\n\nItem {\n    id: dial\n    readonly property real turn: 0.5\n    signal moved(real by)\n    onTurnChanged: moved(turn)\n    function step(n) { return n + turn }\n    Text { text: qsTr(\"at\") }\n}\n",
    "package.json": json.dumps({"name": "yard", "version": "2.1", "main": "./js/till.js", "scripts": {"lint": "x -q"}, "devDependencies": {"b": "2", "a": "1"}, "dependencies": {"z": "^3"}}),
}

EXPECTED = [
    ("js/stock.js", "function", "total", {"tax"}), ("js/stock.js", "variable", "shelf", set()), ("js/stock.js", "method", "add", {"total"}), ("js/till.js", "function", "close", {"sum", "paper"}), ("ts/units.ts", "enum", "Size", set()), ("ts/units.ts", "type", "Grams", set()),
    ("ts/units.ts", "method", "reset", {"round"}), ("ts/units.ts", "constructor", "constructor", {"reset"}), ("ts/weigh.ts", "function", "weigh", {"near", "round"}), ("ts/torn.ts", "function", "feed", {"ink"}), ("ts/torn.ts", "props", "Slip", set()),
    ("php/Depot.php", "constructor", "__construct", {"clear"}), ("php/Depot.php", "method", "clear", {"rows_of"}), ("php/Depot.php", "constant", "ROWS", set()), ("php/Depot.php", "interface", "Gate", set()), ("php/Torn.php", "trait", "Moves", set()), ("php/Torn.php", "method", "drop", {"lift"}),
    ("swift/Crate.swift", "enum", "Crate", set()), ("swift/Crate.swift", "variant", "shut", set()), ("swift/Crate.swift", "method", "weight", {"scale"}), ("swift/Crate.swift", "function", "scale", set()), ("py/route.py", "function", "near", {"nsmallest", "at"}), ("py/route.py", "property", "load", {"near"}),
    ("py/route.py", "method", "drive", {"go", "near"}), ("py/route.py", "class", "Door", set()), ("py/torn.py", "class", "Fleet", set()), ("py/torn.py", "method", "grow", {"more"}), ("rs/dock.rs", "impl", "Moor for Ship", set()), ("rs/dock.rs", "variant", "Tug", set()), ("rs/dock.rs", "module", "quay", set()),
    ("rs/dock.rs", "function", "knots", set()), ("rs/dock.rs", "constant", "PIERS", set()), ("rs/torn.rs", "function", "cut", {"join"}), ("java/Silo.java", "constructor", "Silo", {"fill"}), ("java/Silo.java", "method", "fill", {"weigh"}), ("java/Silo.java", "constant", "TOP", set()), ("java/Silo.java", "variant", "FULL", set()),
    ("java/Silo.java", "interface", "Grain", set()), ("java/Torn.java", "method", "turn", set()), ("cs/Kiln.cs", "constructor", "Kiln", {"Warm"}), ("cs/Kiln.cs", "property", "Heat", set()), ("cs/Kiln.cs", "method", "Bake", {"Warm"}), ("cpp/loom.cpp", "class", "Loom", set()), ("cpp/loom.cpp", "function", "weave", set()),
    ("cpp/loom.cpp", "function", "spin", set()), ("m/Wheel.m", "method", "turn", set()), ("m/Wheel.m", "function", "spin", set()), ("web/look.css", "class", "price", set()), ("web/look.css", "custom-property", "--gap", set()), ("web/cart.js", "method", "put", set()), ("qml/Dial.qml", "component", "Item", set()),
    ("qml/Dial.qml", "property", "turn", set()), ("qml/Dial.qml", "signal", "moved", set()), ("qml/Dial.qml", "method", "onTurnChanged", set()), ("package.json", "script", "lint", set()),
]

LANGUAGE = {"js": "script", "ts": "ts", "php": "php", "swift": "swift", "py": "python", "rs": "rust", "java": "java", "cs": "csharp", "cpp": "cpp", "m": "objc", "html": "html", "css": "css", "qml": "qml", "json": "json"}


def doc(path):
    return analyse(path, path, SOURCES[path], LANGUAGE[path.rsplit(".", 1)[-1]])


@pytest.mark.parametrize("path,kind,name,calls", EXPECTED)
def test_symbols(path, kind, name, calls):
    found = [s for s in doc(path)["symbols"] if (s["kind"], s["name"]) == (kind, name)]
    assert len(found) == 1
    assert calls <= set(found[0]["calls"])
    # a declaration begins with its annotations
    lines = SOURCES[path].split("\n")[found[0]["line"] - 1 :]
    assert name.split(".")[0] in "\n".join(lines[: 2 if lines[0].lstrip().startswith("@") else 1]) or path.endswith(".json")


@pytest.mark.parametrize("path", [p for p in SOURCES if "orn." in p])
def test_recovery(path):
    found = doc(path)
    assert found["source_mode"] == "recovered" and found["partial"] and found["confidence"] == "medium" and len(found["notices"]) == 1


@pytest.mark.parametrize("path", sorted(SOURCES))
def test_invariants(path):
    found = doc(path)
    assert not [s for s in found["symbols"] if s["kind"] in ("function", "method") and s["name"] in CONTROL_WORDS]
    for s in found["symbols"]:
        assert not s["snippet"].startswith(("}", "public:", "private:"))
        assert s["parent_id"] is None or found["symbols"][s["parent_id"]]["depth"] == s["depth"] - 1


@pytest.mark.parametrize("language", sorted(set(LANGUAGE.values())))
@pytest.mark.parametrize("text", ["", "\n", "{{{{", "}}}}", "((\"", "'" * 99, "é" * 50, "class", "function (", "<" * 200])
def test_odd_texts(language, text):
    assert analyse("f", "f", text, language)["file_id"] == "f"


def test_unreadable():
    assert analyse("f", "f", None, "ts")["summary"] == "Unable to read file"


def test_signatures():
    found = lambda path, name: next(s for s in doc(path)["symbols"] if s["name"] == name)
    weigh = found("ts/weigh.ts", "weigh")
    assert weigh["parameters"] == [{"name": "box", "type": "Map<string, Size>"}, {"name": "gap", "type": ""}, {"name": "rest", "type": "number[]"}] and weigh["returns"] == ["Promise<number>"]
    near = found("py/route.py", "near")
    assert near["parameters"] == [{"name": "a", "type": ""}, {"name": "far", "type": "float"}, {"name": "more", "type": ""}] and near["returns"] == ["list[int]"]
    spin = found("cpp/loom.cpp", "spin")
    assert spin["parameters"] == [{"name": "c", "type": "char*"}] and spin["returns"] == ["unsigned"]


def test_deep_and_long_files_parse_in_linear_time():
    import time

    def seconds(n):
        texts = [("ts", "".join(f"function f{k}(a) {{\n  return g{k}(a);\n}}\n" for k in range(n))), ("css", "".join(f".a{k} {{ color: red }}\n" for k in range(n))), ("java", "class A {\n" + "".join(f"  int f{k}(int a) {{\n    return g{k}(a);\n  }}\n" for k in range(n)) + "}\n")]
        began = time.process_time()
        assert all(len(analyse("f", "f", text, language)["symbols"]) >= n for language, text in texts)
        return time.process_time() - began

    seconds(200)
    one, four = seconds(4000), seconds(16000)
    assert four < 8 * one + 1


def test_scan():
    assert scan.split_top("a, b<c, d>, (e, f), 'g,h'") == ["a", "b<c, d>", "(e, f)", "'g,h'"]
    assert scan.brace_block("x\nvoid f() {\n  a();\n}\nrest", 2) == "void f() {\n  a();\n}"
    assert scan.tag_problems("<a><b></a>\n<br></c>") == [("Mismatched closing tag </a>, expected </b>", 1, 7), ("Mismatched closing tag </c>, expected </a>", 2, 5)]
    assert scan.expand_tabs("\ta\n b\tc") == "  a\n b  c"


def test_present():
    from symlake.functions import present

    assert present.highlighted('if x < 1: # "a"', "python").startswith('<span class="keyword">if</span> x &lt; <span class="number">1</span>')
    assert present.highlighted("<a b='c'>&</a>", "html") == '<span class="tag">&lt;a</span> <span class="attr">b</span>=<span class="string">\'c\'</span><span class="tag">&gt;</span>&amp;<span class="tag">&lt;/a</span><span class="tag">&gt;</span>'
    assert present.diagnostics("f(1]\n}", "js", "parse_snippet", False) == [("Missing ')'", 1, 2), ("Unexpected ']'", 1, 4), ("Unexpected '}'", 2, 1)]
    assert present.diagnostics("f(1]", "js", "none", False) == present.diagnostics("f(1]", "js", "parse_snippet", True) == []
    assert present.diagnostics('{"a": }', "json", "parse_snippet", False) == [("JSON does not parse", 1, 7)]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [("demo", path, text) for path, text in SOURCES.items()]
    return P.from_texts(spark.createDataFrame(rows, "root string, rel_path string, text string"))


def names(spark, p, edges):
    s = {(r.file_id, r.sym_id): r.name for r in p.symbols.collect()}
    return {(s[e["file_id"], e["owner_id"]], s[e["target_file_id"] if "target_file_id" in e else e["file_id"], e["target_id"]]) for e in (r.asDict() for r in edges.collect())}


def test_call_edges(spark, tables):
    same = names(spark, tables, tables.calls)
    assert {("total", "tax"), ("reset", "round"), ("drop", "lift"), ("weight", "scale"), ("drive", "go"), ("fill", "weigh"), ("Bake", "Warm"), ("grow", "more"), ("Cart", "put")} <= same
    assert {("close", "total"), ("weigh", "round")} <= names(spark, tables, tables.cross_calls)
    both = {(r.direction, r.symbol_id, r.other_id) for r in tables.relations.collect()}
    assert len([x for x in both if x[0] == "calls"]) == len([x for x in both if x[0] == "calledBy"]) > 0


def test_side_tables(spark, tables):
    path = {r.file_id: r.rel_path for r in tables.files.collect()}
    deps = {(r.path.removeprefix("demo/"), r.target, r.target_path, r.exists) for r in tables.dependencies.collect()}
    assert {("js/till.js", "./stock", "js/stock.js", True), ("js/till.js", "left-pad", None, False), ("ts/weigh.ts", "./units", "ts/units.ts", True), ("py/route.py", "heapq", None, True), ("cpp/loom.cpp", "yarn.hpp", None, True)} <= deps
    links = {(path[r.file_id], r.type, r.rel_path, r.exists) for r in tables.quick_links.collect()}
    assert links == {("web/shop.html", "script", "web/cart.js", True), ("web/shop.html", "stylesheet", "web/look.css", True)}
    usage = {(r["class"], r.role) for r in tables.css_usage.collect()}
    assert usage == {("page", "matched"), ("wide", "matched"), ("price", "matched"), ("low", "missing")}
    style = {(r["class"], r.role, r.page, r.rule) for r in tables.style_usage.collect()}
    assert ("low", "missing", "shop.html", None) in style and ("wide", "matched", "shop.html", ".page > .price:hover, .wide { margin: var(--gap) }") in style
    assert {path[r.file_id] for r in tables.script_consumers.collect()} == {"web/cart.js"}
    row = tables.packages.collect()[0]
    assert row.name == "yard" and [(d.name, d.section) for d in row.deps] == [("z", "dependencies"), ("a", "devDependencies"), ("b", "devDependencies")] and row.scripts == {"lint": "x -q"}
    total = tables.summary.collect()[0]
    assert total.total_files == len(SOURCES) and total.main_entry == "js/till.js" and total.file_types["python"] == 2


def test_style_consumers_are_siblings(spark):
    page = '<link rel="stylesheet" href="%s"><p class="a b">'
    rows = [("r", "x/s.css", ".a { }"), ("r", "x/z.html", page % "s.css"), ("r", "x/B.html", page % "./s.css"), ("r", "y/o.html", page % "../x/s.css")]
    p = P.from_texts(spark.createDataFrame(rows, "root string, rel_path string, text string"))
    assert {r.page for r in p.style_consumers.collect()} == {"z.html", "B.html"}
    assert {(r["class"], r.role, r.page) for r in p.style_usage.collect()} == {("a", "matched", "B.html"), ("b", "missing", "B.html")}


def test_relations_are_compared_with_what_was_kept(spark):
    from symlake.operators import merge

    rows = [(1, "f", "g", 1, "g(1)", 0), (1, "f", "g", 2, "g(2)", 1), (1, "f", "g", 3, "g(3)", 2), (1, "f", "g", 9, "x g(3) y", 3), (1, "f", "g", 20, " ", 4), (2, "f", "g", 0, "a", 0), (2, "f", "g", 0, "b", 1), (2, "f", "h", 1, "", 2), (2, "f", "h", 8, "c", 3)]
    df = spark.createDataFrame(rows, "owner_id int, kind string, name string, line int, snippet string, ord int")
    assert sorted((r.owner_id, r.name, r.line, r.ord) for r in merge.dedupe_relations(df, ["owner_id"]).collect()) == [(1, "g", 1, 0), (1, "g", 3, 2), (2, "g", 0, 0), (2, "g", 0, 1), (2, "h", 1, 2)]
    assert merge.dedupe_relations(df.limit(0), ["owner_id"]).count() == 0
    symbols = spark.createDataFrame([(0, 5, "f", "g", 12, "p"), (0, 6, "f", "g", 2, "g(2)")], "depth int, sym_id int, kind string, name string, line int, snippet string").withColumn("of", F.lit(0))
    found = merge.canonical(df.withColumn("of", F.lit(0)), symbols, ["of"])
    assert sorted((r.owner_id, r.name, r.line, r.target_id) for r in found.collect() if r.owner_id == 1) == [(1, "g", 2, 6), (1, "g", 9, 5)] or {r.target_id for r in found.collect() if r.owner_id == 1} == {6, None}


def test_merged_symbols_take_the_first_that_fits(spark):
    from symlake.operators import merge

    shape = "file_id int, kind string, name string, line int, snippet string, ord int, detail string"
    first = spark.createDataFrame([(1, "f", "a", 10, "x", 0, ""), (1, "f", "a", 12, "y", 1, "kept"), (1, "f", "b", 0, "", 2, "")], shape)
    second = spark.createDataFrame([(1, "f", "a", 11, "q", 0, "d"), (1, "f", "a", 30, "", 1, ""), (1, "f", "a", 31, "z", 2, "later"), (1, "f", "b", 7, "new", 3, "e"), (2, "f", "a", 1, "", 4, "")], shape)
    rows = sorted((r.file_id, r.name, r.line, r.snippet, r.detail) for r in merge.merge_symbol_tables(first, second, ["file_id"], ["detail"]).collect())
    assert rows == [(1, "a", 10, "x", "d"), (1, "a", 12, "y", "kept"), (1, "a", 30, "z", "later"), (1, "b", 7, "new", "e"), (2, "a", 1, "", "")]


def test_partial_constructs_are_anchored():
    from symlake.operators.extract.languages import anchored

    assert anchored("}\n\n};\n  */\nrest\nasync function go() {\n}", "go") == "async function go() {\n}"
    assert anchored("return 1", "go") == "return 1" and anchored("}", "") == ""


def test_gates(spark):
    long = "x" * 5000 + "\n" + "y" * 12000
    rows = [("r", "a.js", long), ("r", "b.js", "ok"), ("r", "c.js", None), ("r", "d.js", "z" * (2 * 1024 * 1024 + 1)), ("r", "node_modules/e.js", "no"), ("r", "f.txt", "no")]
    p = P.from_texts(spark.createDataFrame(rows, "root string, rel_path string, text string"))
    assert {(r.rel_path, r.gate) for r in p.files.collect()} == {("a.js", "minified"), ("b.js", "ok"), ("c.js", "unreadable"), ("d.js", "oversized")}
    notices = {r.path: [n.message for n in r.notices] for r in p.analyses.collect()}
    assert notices["r/b.js"] == [] and all(len(notices[f"r/{x}.js"]) == 1 for x in "acd")


def test_session_and_tree(spark, tmp_path):
    from symlake.plans.session import Session

    for path in ("ts/units.ts", "ts/weigh.ts", "web/shop.html", "web/look.css"):
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(SOURCES[path])
    commands = [
        {"command": "setRootPath", "params": {"path": str(tmp_path)}}, {"command": "toggleExpanded", "params": {"path": "ts"}}, {"command": "selectPath", "params": {"path": "ts/weigh.ts"}},
        {"command": "selectSymbolByData", "params": {"name": "weigh", "kind": "function", "line": 4}}, {"command": "getProjectSummary"}, {"command": "exit"},
    ]
    out = [json.loads(x) for x in Session(spark).run([json.dumps(commands[0]), "no json", *map(json.dumps, commands[1:])])]
    assert len(out) == 5
    assert [e["path"] for e in out[1]["fileSystem"]] == ["ts", "ts/units.ts", "ts/weigh.ts", "web"]
    assert out[3]["selectedSymbol"]["sym_id"] == 0 and out[3]["selectedSnippet"]["name"] == "weigh"
    assert out[4]["total_files"] == 4


def test_command_line(spark, tmp_path, capsys):
    from symlake.__main__ import main

    (tmp_path / "torn.ts").write_text(SOURCES["ts/torn.ts"])
    assert main(["--dump-file", str(tmp_path / "torn.ts")]) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["source_mode"] == "recovered" and {s["name"] for s in found["symbols"]} >= {"feed", "ink"} and {"relations", "relatedFiles", "quickLinks", "cssSummary"} <= set(found)
    assert main([str(tmp_path), "-p", "torn.ts", "-s", "0"]) == 0
    assert json.loads(capsys.readouterr().out)["selectedSymbol"]["name"] == "Slip"
    assert main([]) == 1


def test_lost_files_are_unreadable(spark, tmp_path):
    for name in ("a.js", "b.js"):
        (tmp_path / name).write_text("let a = 1;\n")
    from symlake.sources import tree

    crawled = tree.crawl(tree.read_tree(spark, str(tmp_path)))
    listing = tree.sources(crawled.withColumn("content", F.lit(None).cast("binary")))
    read = tree.sources(crawled).where("name <> 'b.js'")
    found = {r.path.rsplit("/", 1)[-1]: [n.message for n in r.notices] for r in P.project(read, listing=listing).analyses.collect()}
    assert found == {"a.js": [], "b.js": ["Unable to read file"]}


def test_stream(spark, tmp_path):
    from symlake.streaming import analyse_stream

    rows = [("r", "ts/units.ts", SOURCES["ts/units.ts"]), ("r", "x.txt", "no")]
    spark.createDataFrame(rows, "root string, rel_path string, text string").selectExpr("*", "timestamp'2026-01-01' AS seen").write.parquet(str(tmp_path / "in"))
    query = analyse_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("analysed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    assert [r.path for r in spark.sql("SELECT path FROM analysed").collect()] == ["ts/units.ts"]
