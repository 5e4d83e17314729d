"""Queries over whole tables, each with one operator or a chain of them, and the SQL that says the same.

Text queries read pages and documents. For source code, which the tables do not hold, a corpus is rendered from
relational rows inside the query; its SQL computes the expected entities from the rows, never through text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, links, merge, summary, web
from ..sources import tree
from . import project as P
from .shared import Shared


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# pages and documents


def w2_html_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = read(spark, sf_dir, "pages").select(F.explode(web.html_classes(F.col("html"))).alias("class"))
    return classes.groupBy("class").agg(F.count(F.lit(1)).alias("pages"))


def w3_css_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(web.css_classes(F.col("html")), ",").alias("classes"))


def w1_html_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", F.size(web.script_sources(F.col("html"))).cast("long").alias("scripts"), F.size(web.stylesheets(F.col("html"))).cast("long").alias("styles"))


def t1_lines_of_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.located(read(spark, sf_dir, "documents"), ["doc_id"], "text", r"\b([A-Z][a-z]+)\.", 1)
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("matches"), F.min("line").cast("long").alias("first_line"), F.max("line").cast("long").alias("last_line"))


def t2_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text"), F.lit(3), 1).alias("excerpt"))


def t4_first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.first_lines(F.col("text"))).alias("snippet_md5"))


def t6_call_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").withColumn("code", F.concat(F.lit("  make_"), F.col("p_size").cast("string"), F.lit("(x, load(y)); if (z) { make_"), F.col("p_size").cast("string"), F.lit(" (1) }")))
    return parts.select("p_partkey", F.array_join(T.call_names(F.col("code")), ",").alias("names"))


def t7_import_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation").withColumn("clause", F.format_string("{ part%d as p%d, region%d: r%d , same }", "n_nationkey", "n_nationkey", "n_regionkey", "n_regionkey"))
    return nations.select("n_nationkey", F.explode(T.import_bindings(F.col("clause"))).alias("b")).select("n_nationkey", "b.local", "b.imported")


def t9_signature_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("  int get_"), F.col("s_suppkey").cast("string"), F.lit("(int a)\n{ return a; }"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", T.signature_head(code).alias("head"))


def t13_byte_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.byte_size(F.octet_length("text").cast("long")).alias("size"))


def t15_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", T.truncation(T.first_lines(F.col("text"), 5)).alias("t"))
    return docs.select("doc_id", "t.truncated", F.md5("t.code").alias("code_md5"), "t.marker")


def t16_tag_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tag_diagnostics(read(spark, sf_dir, "pages"), "page_id", "html")


def t24_relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("root"), F.regexp_replace("url", r"^https?://", "").alias("path"))
    return rows.select("page_id", T.relative_path(F.col("path"), F.col("root")).alias("relative"))


def s12_line_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = read(spark, sf_dir, "documents").select("doc_id", tree.line_stats(F.col("text")).alias("s"), tree.minified(F.lit("a.js"), F.lit("script"), F.col("text")).alias("minified"))
    return stats.select("doc_id", F.col("s.longest").cast("long").alias("longest"), F.col("s.lines").cast("long").alias("lines"), "minified")


def s14_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(tree.preview(F.col("text"), F.octet_length("text"))).alias("preview_md5"))


# a table of paths


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root, rel_path: per supplier files of many types, some in directories that a crawl leaves out."""
    rows = read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    kinds = F.array(*[F.lit(x) for x in (*tree.SUFFIXES, "txt", "md", "JS")])
    folders = F.array(*[F.lit(x) for x in ("src", "node_modules/x", "lib/Build/out", "src/a", "dist", "app/src/main/java", "")])
    k = F.col("s_suppkey")
    suffix, folder = F.element_at(kinds, (k % F.size(kinds) + 1).cast("int")), F.element_at(folders, (k % F.size(folders) + 1).cast("int"))
    name = F.when(k % 11 == 0, "main").otherwise(F.concat(F.lit("file_"), k.cast("string")))
    return rows.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("root"), F.concat(folder, F.when(folder == "", "").otherwise("/"), name, F.lit("."), suffix).alias("rel_path")).distinct()


_PATHS = f"""
WITH numbered AS (
  SELECT 'r' || n_regionkey AS root, CAST(s_suppkey AS BIGINT) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey),
parts AS (
  SELECT root, {list((*tree.SUFFIXES, "txt", "md", "JS"))}[k % {len(tree.SUFFIXES) + 3} + 1] AS suffix,
         ['src', 'node_modules/x', 'lib/Build/out', 'src/a', 'dist', 'app/src/main/java', ''][k % 7 + 1] AS dir,
         CASE WHEN k % 11 = 0 THEN 'main' ELSE 'file_' || k END AS base FROM numbered),
paths AS (
  SELECT DISTINCT root, dir, base || '.' || suffix AS name, lower(suffix) AS suffix, CASE WHEN dir = '' THEN '' ELSE dir || '/' END || base || '.' || suffix AS rel_path FROM parts),
taken AS (
  SELECT *, CASE WHEN suffix IN ('js', 'ts') THEN 'script' WHEN suffix IN ('jsx', 'tsx') THEN 'react' WHEN suffix = 'py' THEN 'python' WHEN suffix = 'cs' THEN 'csharp'
       WHEN suffix = 'rs' THEN 'rust' WHEN suffix IN ('m', 'mm') THEN 'objc' WHEN suffix IN ('c', 'cc', 'cpp', 'cxx', 'h', 'hh', 'hpp', 'hxx') THEN 'cpp' ELSE suffix END AS file_type
  FROM paths WHERE suffix NOT IN ('txt', 'md') AND dir NOT IN ('node_modules/x', 'lib/Build/out', 'dist'))
"""


def s2_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.crawl(paths(spark, sf_dir)).select("root", "rel_path", "name", "suffix", "dir", F.col("depth").cast("long").alias("depth"), "file_type")


def s5_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.limited(tree.crawl(paths(spark, sf_dir)), per_dir=3, per_root=8).select("root", "rel_path")


def q1_file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.crawl(paths(spark, sf_dir)).groupBy("root", "file_type").agg(F.count(F.lit(1)).alias("files"))


def q3_main_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.main_entry(tree.crawl(paths(spark, sf_dir)).withColumn("text", F.lit(None).cast("string")))


# a rendered corpus: a file per supplier with a function per part, a file per order that imports and calls them


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (o, s, p)."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()


def _join(parts, sep: str):
    return F.array_join(F.array_sort(F.collect_set(parts)), sep)


def supplier_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.format_string("export function part_%d() {\n  note_%d();\n  return %d;\n}\n", "p", "s", "p")
    files = supplies(spark, sf_dir).select("s", "p").distinct().groupBy("s").agg(_join(part, "\n").alias("body"))
    head = F.format_string("const app = router();\napp.get('/supplier/%d', list);\n\nfunction note_%d() {\n  return \"note_%d() is text\";\n}\n\n", "s", "s", "s")
    return files.select(F.lit("shop").alias("root"), F.format_string("lib/sup_%d.ts", "s").alias("rel_path"), F.concat(head, F.col("body")).alias("text"))


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = supplies(spark, sf_dir).groupBy("o", "s").agg(_join(F.format_string("part_%d as item_%d", "p", "p"), ", ").alias("names"), _join(F.format_string("  item_%d();", "p"), "\n").alias("calls"))
    lines = lines.select("o", F.format_string('import { %s } from "../lib/sup_%d";', "names", "s").alias("import"), "calls")
    files = lines.groupBy("o").agg(_join(F.col("import"), "\n").alias("imports"), _join(F.col("calls"), "\n").alias("body"))
    return files.select(F.lit("shop").alias("root"), F.format_string("src/order_%d.ts", "o").alias("rel_path"), F.concat("imports", F.format_string("\n\nexport function order_%d(count: number): number {\n", "o"), "body", F.lit("\n  return count;\n}\n")).alias("text"))


def _project(texts: DataFrame, **how) -> P.Project:
    """The rendered texts are small and parsing them is not, so they are dealt to all tasks."""
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return P.from_texts(texts.repartition(tasks, "rel_path"), **how)


_SHOPS: dict[tuple[str, str], P.Project] = {}


def shop(spark: SparkSession, sf_dir: str) -> P.Project:
    """The project of supplier and order files; a session renders and parses it once, for all queries over it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SHOPS:
        _SHOPS[key] = _project(order_files(spark, sf_dir).unionByName(supplier_files(spark, sf_dir)), shared=Shared(spark, "shop"))
    return _SHOPS[key]


def h8_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shop(spark, sf_dir).symbols.where("file_path LIKE 'shop/lib/%'")
    return found.where("kind = 'function'").select("file_path", "kind", "name", F.element_at("returns", 1).alias("returns"))


def t12_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shop(spark, sf_dir).symbols.where("file_path LIKE 'shop/src/%' AND kind = 'function'")
    one = F.element_at("parameters", 1)
    return found.select("name", one["name"].alias("parameter"), one["type"].alias("type"), F.element_at("returns", 1).alias("returns"))


def g3_same_file_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = shop(spark, sf_dir)
    names, edges = p.symbols.where("file_path LIKE 'shop/lib/%'").select("file_id", "file_path", "sym_id", "name"), p.calls
    owner = names.select("file_id", F.col("sym_id").alias("owner_id"), "file_path", F.col("name").alias("owner"))
    target = names.select("file_id", F.col("sym_id").alias("target_id"), F.col("name").alias("target"))
    return edges.join(owner, ["file_id", "owner_id"]).join(target, ["file_id", "target_id"]).groupBy("file_path", "target").agg(F.count(F.lit(1)).alias("callers"))


def d1_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = shop(spark, sf_dir)
    return p.dependencies.groupBy("target_path").agg(F.count(F.lit(1)).alias("importers"), F.sum(F.size("bindings")).alias("bindings"))


def x1_cross_file_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = shop(spark, sf_dir)
    place = p.files.select(F.col("file_id").alias("target_file_id"), "rel_path")
    return p.cross_calls.join(place, "target_file_id").groupBy("rel_path").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("file_id").alias("files"))


def x2_incoming_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = shop(spark, sf_dir)
    names = p.symbols.select("file_id", F.col("sym_id").alias("symbol_id"), "name")
    return p.incoming_calls.join(names, ["file_id", "symbol_id"]).where("name LIKE 'part%'").groupBy("name").agg(F.countDistinct("caller_file_id").alias("callers"))


def r1_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shop(spark, sf_dir).analyses.select(F.explode("routes").alias("r"))
    return found.select("r.owner", "r.method", "r.path", "r.label", F.col("r.line").cast("long").alias("line"))


def f1_related_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select(F.lit("r").alias("root"), F.explode(F.array(F.format_string("src/m_%d.cpp", k), F.when(k % 2 == 0, F.format_string("src/m_%d.h", k)), F.format_string("py/m_%d.py", k), F.when(k % 3 == 0, F.format_string("py/tests/test_m_%d.py", k)))).alias("rel_path")).where("rel_path IS NOT NULL")
    files = tree.crawl(rows).withColumn("file_id", F.col("rel_path"))
    return links.related(files).select(F.col("file_id").alias("file"), "path", "type")


def w6_class_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    sup = read(spark, sf_dir, "supplier")
    html = sup.select(F.lit("w").alias("root"), F.format_string("n%d/p%d.html", n, k).alias("rel_path"), F.format_string('<html><head><link href="../css/main.css" rel="stylesheet"></head><body><div class="c%d hero"></div></body></html>', k % 10).alias("text"))
    style = sup.select(F.lit("w").alias("root"), F.lit("css/main.css").alias("rel_path"), F.lit(".hero { }\n.c1, .c2 { color: red }\n").alias("text")).limit(1)
    local = sup.select(F.lit("w").alias("root"), F.format_string("n%d/local.css", n).alias("rel_path"), F.format_string(".c%d { margin: 0 }", n % 10).alias("text")).distinct()
    return _project(html.unionByName(style).unionByName(local)).css_usage.groupBy("class", "role").agg(F.count(F.lit(1)).alias("pages"))


def p1_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.to_json(F.struct(F.col("s_name").alias("name"), F.lit("1.0").alias("version"), F.create_map(F.lit("build"), F.concat(F.lit("make "), F.col("s_suppkey").cast("string"))).alias("scripts"), F.create_map(F.format_string("dep-%d", "s_nationkey"), F.lit("^1")).alias("dependencies")))
    files = read(spark, sf_dir, "supplier").select(F.lit("r").alias("root"), F.format_string("m%d/package.json", "s_suppkey").alias("rel_path"), text.alias("text"))
    found = links.packages(tree.crawl(files))
    return found.select("rel_path", "name", "version", F.col("scripts")["build"].alias("build"), F.element_at("deps", 1)["name"].alias("dependency"), F.col("dep_count").cast("long").alias("dep_count"))


def h12_json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = read(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return keys.groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("long")).alias("total"))


def m3_flat_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    side = lambda status: orders.where(F.col("o_orderstatus") == status).select(F.lit("import").alias("type"), F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("ord"), F.lit(status).alias("origin"))
    return merge.merge_flat(side("O"), side("F"), ["type", "target"], ["ord"])


def m1_band_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols of suppliers, merged from two lists whose lines are near each other, some with snippets in common."""
    snippet = F.when(F.col("l_quantity") >= 48, "").otherwise(F.concat(F.lit("f"), (F.col("l_orderkey") % 100).cast("string")))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file_id"), F.lit("method").alias("kind"), (F.col("l_partkey") % 10).cast("string").alias("name"), (F.col("l_partkey") % 41).cast("int").alias("line"), snippet.alias("snippet"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), F.when(F.col("l_linenumber") > 2, F.col("l_returnflag")).otherwise("").alias("detail"))
    out = merge.merge_symbol_tables(rows.where("ord % 2 = 0"), rows.where("ord % 2 = 1"), ["file_id"], ["detail"])
    return out.groupBy("file_id", "name").agg(F.count(F.lit(1)).alias("symbols"), F.sum(F.when(F.col("detail") != "", 1).otherwise(0)).alias("filled"), F.sum("line").alias("lines"), F.sum("ord").alias("ords"))


def j1_analysis_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .session import analyses_json

    return analyses_json(shop(spark, sf_dir).analyses.where("path LIKE 'shop/lib/%'")).select("path", F.get_json_object("value", "$.language").alias("language"), F.get_json_object("value", "$.source_mode").alias("source_mode"))


# a rendered corpus of all languages: a file per nation and template, @ being the nation's key

# (path, text, symbols (kind, name, depth), dependencies (type, target), routes (method, path))
TEMPLATES = (
    ("a/m_@.py", "import os@\n@app.route('/n@', methods=['GET', 'POST'])\ndef help_@(a: int) -> str:\n    return a\n\nclass C@:\n    def run_@(self):\n        return help_@(1)\n", (("function", "help_@", 0), ("class", "C@", 0), ("method", "run_@", 1)), (("import", "os@"),), (("GET, POST", "/n@"),)),
    ("a/C@.java", "import a.b@;\npublic class C@ {\n    private int f@;\n    public C@(int a) {\n        f@ = a;\n    }\n    static int go_@() {\n        return 1;\n    }\n}\n", (("class", "C@", 0), ("property", "f@", 1), ("constructor", "C@", 1), ("method", "go_@", 1)), (("import", "a.b@"),), ()),
    ("a/C@.cs", "using Sys@;\nclass P@ {\n    public int Q@ { get; set; }\n    int Go@(int a) {\n        app.MapGet(\"/c@\", Go);\n        return 1;\n    }\n}\n", (("class", "P@", 0), ("property", "Q@", 1), ("method", "Go@", 1)), (("using", "Sys@"),), (("GET", "/c@"),)),
    ("a/r_@.rs", "use std::n@;\npub struct S@ {\n    v: i32,\n}\nimpl S@ {\n    pub fn get_@(&self) -> i32 {\n        help_@()\n    }\n}\nfn help_@() -> i32 {\n    1\n}\n", (("struct", "S@", 0), ("impl", "S@", 0), ("method", "get_@", 1), ("function", "help_@", 0)), (("use", "std::n@"),), ()),
    ("a/p_@.php", "<?php\nclass W@ {\n    private $x@;\n    const MAX@ = 1;\n    public function go_@() {\n        return 1;\n    }\n}\nfunction top_@() {\n    return 2;\n}\n", (("class", "W@", 0), ("property", "x@", 1), ("constant", "MAX@", 1), ("method", "go_@", 1), ("function", "top_@", 0)), (), ()),
    ("a/s_@.swift", "protocol P@ {\n}\nstruct S@ {\n    var v@: Int\n    func go_@() {\n        top_@()\n    }\n}\nfunc top_@() {\n}\n", (("protocol", "P@", 0), ("struct", "S@", 0), ("property", "v@", 1), ("method", "go_@", 1), ("function", "top_@", 0)), (), ()),
    ("a/c_@.cpp", "#include \"h@.h\"\nclass K@ {\n};\nint do_@(int a) {\n    return a;\n}\n", (("class", "K@", 0), ("function", "do_@", 0)), (("include", "h@.h"),), ()),
    ("a/o_@.m", "#import \"O@.h\"\n@implementation O@\n- (int)say_@ {\n    return 1;\n}\n@end\n".replace("@implementation", "\u0002implementation").replace("@end", "\u0002end"), (("class", "O@", 0), ("method", "say_@", 1)), (("import", "O@.h"),), ()),
    ("a/q_@.qml", "import Qt@ 2.0\nItem {\n    property int w@: 1\n    signal done@()\n    function f@(a) {\n        return a\n    }\n}\n", (("component", "Item", 0), ("property", "w@", 1), ("signal", "done@", 1), ("function", "f@", 1)), (("import", "Qt@"),), ()),
    ("a/y_@.css", ".a@ {\n  --v@: 1;\n}\n.b@:hover, .d@ {\n}\n", (("class", "a@", 0), ("custom-property", "--v@", 0), ("class", "b@", 0), ("class", "d@", 0)), (), ()),
    ("a/x_@.jsx", "import Z@ from 'z@';\nexport function Card@(props) {\n  return null;\n}\nconst useIt@ = () => {\n  return 1;\n};\nrouter.post('/x@', it);\n", (("component", "Card@", 0), ("hook", "useIt@", 0)), (("import", "z@"),), (("POST", "/x@"),)),
    ("a/w_@.py", "\u0002route('/b@')\ndef b_@():\n    return 1\n\n@app.post('/p@')\ndef p_@():\n    return 2\n", (("function", "b_@", 0), ("function", "p_@", 0)), (), (("GET", "/b@"), ("POST", "/p@"))),
    ("a/W@.cs", "class W@ {\n    void Map@() {\n        app.MapMethods(\"/m@\", verbs, it);\n        app.MapControllerRoute(name: \"d@\", pattern: \"{controller}/x@\");\n        app.MapControllerRoute(it);\n    }\n}\n", (("class", "W@", 0), ("method", "Map@", 1)), (), (("METHODS", "/m@"), ("ROUTE", "{controller}/x@"), ("ROUTE", "{controller=Home}/{action=Index}/{id?}"))),
    ("a/openapi_@.json", '{"openapi": "3.0.0", "paths": {"/n@": {"get": {}, "post": {}}, "/m@": {"delete": {}}}}', (("route", "DELETE /m@", 0), ("route", "GET /n@", 0), ("route", "POST /n@", 0)), (), ()),
    ("k@/package.json", '{"name": "k@", "scripts": {"start": "node @", "test": "node t"}}', (("script", "start", 0), ("script", "test", 0)), (), ()),
    ("a/t_@.ts", "export interface I@ {\n}\ntype T@ = string;\nclass D@ {\n  constructor(a: number) {\n  }\n  run_@(): void {\n  }\n}\n", (("props", "I@", 0), ("type", "T@", 0), ("class", "D@", 0), ("constructor", "constructor", 1), ("method", "run_@", 1)), (), ()),
)


def many_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.explode(F.array(*[F.struct(F.lit(path).alias("path"), F.lit(text).alias("text")) for path, text, *_ in TEMPLATES])).alias("t")
    put = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("@app"), F.lit("\u0002app")), F.lit("@"), F.col("n").cast("string")), F.lit("\u0002"), F.lit("@"))
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), template)
    return rows.select(F.lit("all").alias("root"), put("t.path").alias("rel_path"), put("t.text").alias("text"))


def h1_all_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _project(many_languages(spark, sf_dir)).symbols
    return found.select("file_path", "kind", "name", F.col("depth").cast("long").alias("depth"))


def d3_language_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.dependency_rows(_project(many_languages(spark, sf_dir)).analyses).select(F.col("path").alias("file_path"), "type", "target")


def r2_language_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _project(many_languages(spark, sf_dir)).analyses.select(F.col("path").alias("file_path"), F.explode("routes").alias("r"))
    return found.select("file_path", "r.method", F.col("r.path").alias("route"))


def t22_shown_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .snippets import shown

    p = _project(many_languages(spark, sf_dir))
    return shown(p.symbols).join(p.symbols.select("file_id", "sym_id", "language"), ["file_id", "sym_id"]).groupBy("language").agg(F.count(F.lit(1)).alias("snippets"), F.sum(F.size("diagnostics")).alias("problems"), F.sum(F.when(F.col("display_html").contains("keyword"), 1).otherwise(0)).alias("coloured"))


def _called(spark: SparkSession, sf_dir: str) -> DataFrame:
    """owner_id, kind, name, line, snippet, ord: parts as relations of suppliers; snippets hold each other, or are blank."""
    snippet = F.when(F.col("l_quantity") >= 48, "").otherwise(F.concat(F.lit("f"), (F.col("l_orderkey") % 100).cast("string")))
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("owner_id"), F.lit("function").alias("kind"), (F.col("l_partkey") % 10).cast("string").alias("name"), (F.col("l_partkey") % 37).alias("line"), snippet.alias("snippet"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"))


def m4_canonical_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = _called(spark, sf_dir).withColumn("file_id", F.col("owner_id") % 5)
    k = F.col("p_partkey")
    symbols = read(spark, sf_dir, "part").where("p_partkey <= 100").select((k % 5).alias("file_id"), F.lit("function").alias("kind"), (k % 10).cast("string").alias("name"), (k % 37 + 2).alias("line"), F.concat(F.lit("f"), (k % 100).cast("string")).alias("snippet"), k.alias("sym_id"), F.lit(0).alias("depth"))
    found = merge.canonical(relations, symbols, ["file_id"])
    return found.groupBy("owner_id", "name").agg(F.count(F.lit(1)).alias("relations"), F.countDistinct("target_id").alias("targets"), F.sum("line").alias("lines"), F.sum("ord").alias("ords"))


def g6_deduped_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merge.dedupe_relations(_called(spark, sf_dir), ["owner_id"])
    return found.groupBy("owner_id", "name").agg(F.count(F.lit(1)).alias("relations"), F.sum("line").alias("lines"), F.sum("ord").alias("ords"))


# resolution of what files of several languages name; a corpus of web files; notices, packages and gates


# (path, text, every how many nations have the file)
LINKED = (
    ("c/m_@.cpp", '#include "h_@.h"\n#include <vector>\n#include "sub/gone_@.h"\n', 1), ("c/h_@.h", "int h_@();\n", 2),
    ("o/O_@.m", '#import "O_@.h"\n#import <Foundation/Foundation.h>\n', 1), ("o/O_@.h", "int o_@();\n", 3),
    ("r/lib_@.rs", "use std::fmt_@ as short_@;\nmod a_@;\npub mod b_@;\nmod c_@;\n", 1), ("r/a_@.rs", "fn a_@() {}\n", 2), ("r/b_@/mod.rs", "fn b_@() {}\n", 3),
    ("p/m_@.py", "import os, sys_@ as s, json.x_@\nfrom pkg_@ import z\n", 1), ("j/M_@.java", "import a.b_@;\n", 1), ("s/S_@.cs", "using S_@;\n", 1),
    ("t/m_@.ts", 'import x from "./n_@";\nimport y from "pkg_@";\n', 1), ("t/n_@.tsx", "export const x = 1;\n", 2),
)
# (path, type, target, target_path, every how many nations have it, exists without it, label with it, label without it)
NAMED = (
    ("c/m_@.cpp", "include", "h_@.h", "c/h_@.h", 2, True, "h_@.h", "h_@.h"), ("c/m_@.cpp", "include", "vector", "", 0, True, "", "vector"), ("c/m_@.cpp", "include", "sub/gone_@.h", "", 0, False, "", "sub/gone_@.h"),
    ("o/O_@.m", "import", "O_@.h", "o/O_@.h", 3, True, "O_@.h", "O_@.h"), ("o/O_@.m", "import", "Foundation/Foundation.h", "", 0, False, "", "Foundation/Foundation.h"),
    ("r/lib_@.rs", "use", "std::fmt_@ as short_@", "", 0, True, "", "short_@"), ("r/lib_@.rs", "module", "a_@", "r/a_@.rs", 2, False, "a_@.rs", "a_@"), ("r/lib_@.rs", "module", "b_@", "r/b_@/mod.rs", 3, False, "mod.rs", "b_@"), ("r/lib_@.rs", "module", "c_@", "", 0, False, "", "c_@"),
    ("p/m_@.py", "import", "os", "", 0, True, "", "os"), ("p/m_@.py", "import", "sys_@", "", 0, True, "", "sys_@"), ("p/m_@.py", "import", "json.x_@", "", 0, True, "", "json.x_@"), ("p/m_@.py", "import", "pkg_@", "", 0, True, "", "pkg_@"),
    ("j/M_@.java", "import", "a.b_@", "", 0, True, "", "a.b_@"), ("s/S_@.cs", "using", "S_@", "", 0, True, "", "S_@"),
    ("t/m_@.ts", "import", "./n_@", "t/n_@.tsx", 2, False, "n_@.tsx", "./n_@"), ("t/m_@.ts", "import", "pkg_@", "", 0, False, "", "pkg_@"),
)


def d5_resolved_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    files = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("text"), F.lit(every).alias("every")) for p, t, every in LINKED])).alias("f")
    put = lambda c: F.replace(F.col(c), F.lit("@"), F.col("n").cast("string"))
    texts = read(spark, sf_dir, "nation").select(n.alias("n"), files).where("n % f.every = 0").select(F.lit("x").alias("root"), put("f.path").alias("rel_path"), put("f.text").alias("text"))
    found = _project(texts).dependencies
    return found.select(F.col("path").alias("file_path"), "type", "target", F.coalesce("target_path", F.lit("")).alias("target_path"), "exists", "label")


def web_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with styles and scripts, in a folder per nation."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    sup = read(spark, sf_dir, "supplier")
    page = '<html><head>\n<link href="../css/main.css" rel="stylesheet">\n<link rel="stylesheet" href="local.css?v=1">\n<script src="./app_%d.js"></script>\n<script src="https://cdn/x.js"></script>\n<script src="/static/boot.js"></script></head>\n<body><div class="c%d hero"></div></body></html>'
    rows = [
        (F.format_string("n%d/p%d.html", n, k), F.format_string(page, k, k % 10), F.lit(True)), (F.format_string("n%d/app_%d.js", n, k), F.lit("function go() {\n}\n"), k % 2 == 0),
        (F.lit("css/main.css"), F.lit(".hero { }\n.c1, .c2 { color: red }\n"), F.lit(True)), (F.format_string("n%d/local.css", n), F.format_string("\n  .c%d { margin: 0 }\n", n % 10), F.lit(True)), (F.format_string("n%d/boot.js", n), F.lit("var x = 1;\n"), F.lit(True)),
    ]
    files = F.explode(F.array(*[F.struct(p.alias("rel_path"), t.alias("text"), has.alias("has")) for p, t, has in rows])).alias("f")
    return sup.select(files).where("f.has").select(F.lit("w").alias("root"), "f.rel_path", "f.text").distinct()


def w5_quick_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _project(web_files(spark, sf_dir))
    pages = p.files.select("file_id", F.col("rel_path").alias("page"))
    return p.quick_links.join(pages, "file_id").select("page", F.col("ord").cast("long").alias("ord"), "type", "target", F.col("line").cast("long").alias("line"), "rel_path", "exists")


def w8_style_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _project(web_files(spark, sf_dir))
    styles = p.files.select("file_id", F.col("rel_path").alias("style"))
    return p.style_usage.join(styles, "file_id").select("style", "class", "role", "page", F.coalesce("rule", F.lit("")).alias("rule"))


def w9_script_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _project(web_files(spark, sf_dir))
    place = p.files.select("file_id", "rel_path")
    return p.script_consumers.join(place.withColumnRenamed("rel_path", "script"), "file_id").join(place.select(F.col("file_id").alias("page_id"), F.col("rel_path").alias("page")), "page_id").select("script", "page")


def j2_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .session import documents

    found = documents(_project(web_files(spark, sf_dir), shared=Shared(spark, "documents")))
    count = lambda c: F.size(c).cast("long")
    return found.select("path", count("quickLinks").alias("links"), count("cssSummary").alias("classes"), count(F.filter("cssSummary", lambda c: c["role"] == "missing")).alias("missing"))


def g5_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    text = F.format_string("class D%d {\n  run_%d() {\n    help_%d();\n  }\n}\n\nfunction help_%d() {\n}\n", n, n, n, n)
    java = F.format_string("class D%d {\n    int run_%d() {\n        return help_%d();\n    }\n\n    int help_%d() {\n        return 1;\n    }\n}\n", n, n, n, n)
    rows = F.explode(F.array(F.struct(F.format_string("d_%d.ts", n).alias("rel_path"), text.alias("text")), F.struct(F.format_string("D%d.java", n).alias("rel_path"), java.alias("text")))).alias("f")
    p = _project(read(spark, sf_dir, "nation").select(rows).select(F.lit("g").alias("root"), "f.*"))
    name = p.symbols.select("file_id", "file_path", F.col("sym_id").alias("symbol_id"), F.col("name").alias("symbol"))
    other = p.symbols.select("file_id", F.col("sym_id").alias("other_id"), F.col("name").alias("other"))
    return p.relations.join(name, ["file_id", "symbol_id"]).join(other, ["file_id", "other_id"]).select("file_path", "symbol", "direction", "other")


def g8_symbol_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _project(many_languages(spark, sf_dir))
    files = p.symbols.select("file_id", "sym_id", "file_path", "kind")
    return graph.paths_of_names(p.symbols).join(files, ["file_id", "sym_id"]).where("depth > 0").select("file_path", "kind", F.element_at(F.split("path", r"\."), -1).alias("name"), F.col("depth").cast("long").alias("depth"))


def x3_cut_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = shop(spark, sf_dir)
    found = graph.noticed(p.analyses, p.dependencies, p.cross_calls, 2, 3)
    return found.where("partial").select("path", F.col("notices")[0]["message"].alias("message"), F.col("summary").endswith(graph.CUT_SUFFIX).alias("said"))


def x4_incoming_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _project(many_languages(spark, sf_dir))
    return graph.worth_incoming(p.symbols).join(p.files.select("file_id", "language"), "file_id").groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def m5_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    ts = F.format_string("export function one_%d(v: number) {\n  if (v) {\n    return two_%d(v);\n  return 1;\n}\n\nexport function two_%d(v: number) {\n  return v;\n}\n", n, n, n)
    cs = F.format_string("class K%d {\n    int Go%d(int a) {\n        var x%d = a;\n        return Up%d(a;\n    }\n\n    int Up%d(int a) {\n        return a;\n    }\n}\n", n, n, n, n, n)
    rows = F.explode(F.array(F.struct(F.format_string("b_%d.ts", n).alias("rel_path"), ts.alias("text")), F.struct(F.format_string("B%d.cs", n).alias("rel_path"), cs.alias("text")))).alias("f")
    p = _project(read(spark, sf_dir, "nation").select(rows).select(F.lit("m").alias("root"), "f.*"))
    state = p.analyses.select("file_id", F.col("source_mode").alias("mode"), "partial", F.size("notices").cast("long").alias("notices"))
    return p.symbols.join(state, "file_id").select("file_path", "kind", "name", "mode", "partial", "notices")


def q2_package_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    package = F.when(k % 4 == 0, '{"main": "./lib/a.js"}').when(k % 4 == 1, '{"main": "lib/a.js", "browser": "web.js"}').when(k % 4 == 2, '{"main": "gone.js", "scripts": {"build": "x"}}').otherwise('{"name": "none"}')
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("rel_path"), t.alias("text")) for p, t in (("package.json", package), ("lib/a.js", F.lit("")), ("web.js", F.lit("")), ("src/index.ts", F.lit("")), ("src/index.js", F.lit("")))])).alias("f")
    files = tree.crawl(read(spark, sf_dir, "supplier").select(F.format_string("r%d", k).alias("root"), rows).select("root", "f.*"))
    return summary.package_entry(files).select("root", "entry")


def q5_visible_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .session import Session

    session = Session(spark, P.from_texts(paths(spark, sf_dir).withColumn("text", F.lit(""))))
    session.toggle_expanded("src")
    return session.visible_entries().select("path", "is_dir", F.col("depth").cast("long").alias("depth"))


def q6_selected_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of one selected file, by index and by data."""
    from .session import Session

    session = Session(spark, _project(many_languages(spark, sf_dir)))
    out = []
    for choose in (lambda: session.select_symbol(1), lambda: session.select_symbol_by_data("run_1", "method", 7), lambda: session.select_symbol(99)):
        session.select_path("a/m_1.py")
        choose()
        found, shown = session.symbol or {}, session.snippet()
        out.append((found.get("name", ""), found.get("kind", ""), shown["name"], shown["kind"]))
    return spark.createDataFrame(out, "name string, kind string, shown string, shown_kind string")


def s7_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.skipped(tree.crawl(paths(spark, sf_dir).withColumn("root", F.lit("all")).distinct()), per_dir=1).select("root", "dir", "skipped")


def s10_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.when(k % 50 == 1, F.repeat(F.lit("x"), 2 * 1024 * 1024 + 1)).when(k % 50 == 2, F.repeat(F.lit("y"), 17000)).when(k % 50 == 3, F.lit(None).cast("string")).otherwise("let a = 1;\n")
    p = _project(read(spark, sf_dir, "supplier").where("s_suppkey <= 100").select(F.lit("z").alias("root"), F.format_string("f%d.js", k).alias("rel_path"), text.alias("text")))
    return p.analyses.select("path", "partial", F.coalesce(F.get("notices", F.lit(0))["message"], F.lit("")).alias("message"))


def t5_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.format_string("  ($v_%d = call_%d(x)) end_%d ", "p_size", "p_partkey", "p_size")
    return read(spark, sf_dir, "part").select("p_partkey", T.first_identifier(code).alias("first"), T.variable_name(code).alias("variable"), T.last_identifier(code).alias("last"), T.unquoted(F.concat(F.lit(" '"), "p_name", F.lit("'"))).alias("bare"))


def t8_rust_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    use = F.explode(F.array(F.format_string("std::fmt_%d as f_%d", n, n), F.format_string("crate_%d::{a, b as c}", n), F.format_string("::core_%d::x", n))).alias("use")
    return read(spark, sf_dir, "nation").select(use).select("use", T.rust_label(F.col("use")).alias("label"))


def t23_target_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    source, own = F.when(k % 3 == 0, F.format_string("/s/%d", k)).otherwise(""), F.when(k % 2 == 0, F.format_string("/p/%d", k))
    return read(spark, sf_dir, "supplier").select("s_suppkey", T.target_path(source, own, F.lit("/f")).alias("path"))


QUERIES = {
    f.__name__: f
    for f in (
        w2_html_classes, w3_css_classes, w1_html_assets, t1_lines_of_links, t2_excerpts, t4_first_lines, t6_call_names, t7_import_bindings, t9_signature_heads, t13_byte_sizes,
        t15_truncation, t16_tag_diagnostics, t24_relative_paths, s12_line_statistics, s14_previews, s2_crawl, s5_limits, q1_file_types, q3_main_entries, h8_symbols, t12_signatures,
        g3_same_file_calls, d1_dependencies, x1_cross_file_calls, x2_incoming_calls, r1_routes, f1_related_files, w6_class_usage, p1_packages, h12_json_keys, m3_flat_merge, m1_band_merge, j1_analysis_json,
        h1_all_languages, d3_language_dependencies, r2_language_routes, t22_shown_snippets, m4_canonical_relations, g6_deduped_relations,
        d5_resolved_targets, w5_quick_links, w8_style_consumers, w9_script_consumers, j2_documents, g5_relations, g8_symbol_paths, x3_cut_relations, x4_incoming_surface, m5_recovered, q2_package_entries,
        q5_visible_entries, q6_selected_symbols, s7_skipped, s10_gates, t5_identifiers, t8_rust_labels, t23_target_paths,
    )
}

_CLASSES = r"""regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g')"""
_SUPPLIES = "WITH supplies AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s, l_partkey AS p FROM lineitem)"
_HEAD5 = "array_to_string(string_split(text, chr(10))[1:5], chr(10))"



def _expected(columns: str, pick) -> str:
    """A SELECT per template row, @ replaced by the nation's key."""
    rows = [(path, row) for template in TEMPLATES for path in template[:1] for row in pick(template)]
    value = lambda x: str(x) if isinstance(x, int) else f"replace('{x}', '@', CAST(n_nationkey AS VARCHAR))"
    names = columns.split(", ")
    return "\nUNION ALL ".join("SELECT " + ", ".join(f"{f'CAST({value(v)} AS BIGINT)' if isinstance(v, int) else value(v)} AS {n}" for v, n in zip(("all/" + path, *row), names, strict=True)) + " FROM nation" for path, row in rows)


_CALLED = """
WITH RECURSIVE called AS (
  SELECT l_suppkey AS owner_id, CAST(l_partkey % 10 AS VARCHAR) AS name, l_partkey % 37 AS line, CASE WHEN l_quantity >= 48 THEN '' ELSE 'f' || l_orderkey % 100 END AS snippet, l_orderkey * 8 + l_linenumber AS ord FROM lineitem)"""
# keeps, in order, the relations of `given` that repeat none kept before
_FOLD = """steps AS (SELECT *, row_number() OVER (PARTITION BY owner_id, name ORDER BY ord) AS n FROM given),
run AS (
  SELECT owner_id, name, n, [{'line': line, 'snippet': snippet, 'ord': ord, 'target_id': target_id}] AS kept FROM steps WHERE n = 1
  UNION ALL
  SELECT r.owner_id, r.name, s.n, CASE WHEN len(list_filter(r.kept, lambda k: (k.line > 0 AND s.line > 0 AND abs(k.line - s.line) <= 1) OR k.snippet = '' OR s.snippet = '' OR contains(k.snippet, s.snippet) OR contains(s.snippet, k.snippet))) > 0
    THEN r.kept ELSE list_append(r.kept, {'line': s.line, 'snippet': s.snippet, 'ord': s.ord, 'target_id': s.target_id}) END
  FROM run r JOIN steps s ON s.owner_id = r.owner_id AND s.name = r.name AND s.n = r.n + 1),
left_over AS (SELECT owner_id, name, unnest(max_by(kept, n)) AS k FROM run GROUP BY owner_id, name)"""


def _named() -> str:
    """What d5_resolved_targets should find: a row per nation and entry of NAMED."""
    put = lambda x: f"replace('{x}', '@', CAST(n AS VARCHAR))"
    rows = []
    for path, kind, target, at, every, alone, label, other in NAMED:
        has = f"n % {every} = 0" if every else "false"
        rows.append(f"SELECT {put('x/' + path)} AS file_path, '{kind}' AS type, {put(target)} AS target, CASE WHEN {has} THEN {put(at)} ELSE '' END AS target_path, {has} OR {str(alone).lower()} AS \"exists\", CASE WHEN {has} THEN {put(label)} ELSE {put(other)} END AS label FROM nations")
    return "WITH nations AS (SELECT n_nationkey AS n FROM nation)\n" + "\nUNION ALL ".join(rows)


# tags of pages in order, with their places, and the stack that each leaves
_TAGS = r"""
WITH RECURSIVE marked AS (
  SELECT page_id, string_split(regexp_replace(coalesce(html, ''), '(?is)(<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|</?[a-z][a-zA-Z0-9_:-]*(?:"[^"]*"|''[^'']*''|[^>"''])*>)', chr(1) || '\1', 'g'), chr(1)) AS pieces FROM pages),
parts AS (SELECT page_id, generate_subscripts(pieces, 1) AS pos, unnest(pieces) AS piece, pieces FROM marked),
placed AS (
  SELECT page_id, pos, regexp_extract(piece, '(?is)^</?([a-z][a-zA-Z0-9_:-]*)', 1) AS tag, regexp_extract(piece, '(?is)^<[^!](?:"[^"]*"|''[^'']*''|[^>"''])*>') AS whole, array_to_string(pieces[1:pos - 1], '') AS earlier, piece FROM parts WHERE pos > 1),
tags AS (
  SELECT page_id, lower(tag) AS tag, starts_with(piece, '</') AS closes, len(string_split(earlier, chr(10))) AS line, length(string_split(earlier, chr(10))[-1]) + 1 AS col,
         row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n
  FROM placed WHERE tag <> '' AND NOT regexp_matches(piece, '(?is)^(<script\b[^>]*>.*</script\s*>|<style\b[^>]*>.*</style\s*>)') AND NOT regexp_matches(whole, '/\s*>$')
    AND lower(tag) NOT IN ('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'param', 'source', 'track', 'wbr')),
run AS (
  SELECT page_id, 0::BIGINT AS n, []::STRUCT(tag VARCHAR, line BIGINT, col BIGINT)[] AS stack, NULL::VARCHAR AS message, 0::BIGINT AS line, 0::BIGINT AS col FROM (SELECT DISTINCT page_id FROM tags)
  UNION ALL
  SELECT r.page_id, t.n, CASE WHEN NOT t.closes THEN list_append(r.stack, {'tag': t.tag, 'line': t.line, 'col': t.col}) WHEN len(r.stack) = 0 THEN r.stack ELSE r.stack[1:len(r.stack) - 1] END,
         CASE WHEN NOT t.closes THEN NULL WHEN len(r.stack) = 0 THEN 'Unexpected closing tag </' || t.tag || '>' WHEN r.stack[-1].tag <> t.tag THEN 'Mismatched closing tag </' || t.tag || '>, expected </' || r.stack[-1].tag || '>' END, t.line, t.col
  FROM run r JOIN tags t ON t.page_id = r.page_id AND t.n = r.n + 1),
ends AS (SELECT page_id, unnest(max_by(stack, n)) AS s, generate_subscripts(max_by(stack, n), 1) AS k FROM run GROUP BY page_id),
found AS (
  SELECT page_id, 0 AS late, n AS k, message, line, col FROM run WHERE message IS NOT NULL
  UNION ALL SELECT page_id, 1, k, 'Unclosed tag <' || s.tag || '>', s.line, s.col FROM ends)
SELECT page_id AS key, CAST(row_number() OVER (PARTITION BY page_id ORDER BY late, k) - 1 AS INTEGER) AS ord, message, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS col FROM found"""

_FIRST = _SUPPLIES + """, names AS (SELECT o, s, string_agg('part_' || p || ' as item_' || p, ', ' ORDER BY 'part_' || p || ' as item_' || p) AS names FROM supplies GROUP BY o, s),
first AS (SELECT o, p, min_by(s, 'import { ' || names || ' } from "../lib/sup_' || s || '";') AS s FROM supplies JOIN names USING (o, s) GROUP BY o, p)"""


ORACLES = {
    "h1_all_languages": _expected("file_path, kind, name, depth", lambda t: t[2]),
    "d3_language_dependencies": _expected("file_path, type, target", lambda t: t[3]),
    "r2_language_routes": _expected("file_path, method, route", lambda t: t[4]),
    "m4_canonical_relations": _CALLED + """,
symbols AS (SELECT p_partkey % 5 AS file_id, CAST(p_partkey % 10 AS VARCHAR) AS name, p_partkey % 37 + 2 AS line, 'f' || p_partkey % 100 AS snippet, p_partkey AS sym_id FROM part WHERE p_partkey <= 100),
meant AS (SELECT c.owner_id, c.name, c.ord, c.line, c.snippet, min(s.sym_id) AS target_id FROM called c LEFT JOIN symbols s ON s.file_id = c.owner_id % 5 AND s.name = c.name
  AND ((s.line > 0 AND c.line > 0 AND abs(s.line - c.line) <= 1) OR ((s.line <= 0 OR c.line <= 0 OR abs(s.line - c.line) <= 3) AND (s.snippet = '' OR c.snippet = '' OR contains(s.snippet, c.snippet) OR contains(c.snippet, s.snippet))))
  GROUP BY ALL),
given AS (SELECT m.owner_id, m.name, m.ord, coalesce(s.line, m.line) AS line, coalesce(s.snippet, m.snippet) AS snippet, m.target_id FROM meant m LEFT JOIN symbols s ON m.target_id = s.sym_id),
""" + _FOLD + """
SELECT owner_id, name, count(*) AS relations, count(DISTINCT k.target_id) AS targets, CAST(sum(k.line) AS BIGINT) AS lines, CAST(sum(k.ord) AS BIGINT) AS ords FROM left_over GROUP BY owner_id, name""",
    "g6_deduped_relations": _CALLED + """,
given AS (SELECT *, NULL::BIGINT AS target_id FROM called),
""" + _FOLD + """
SELECT owner_id, name, count(*) AS relations, CAST(sum(k.line) AS BIGINT) AS lines, CAST(sum(k.ord) AS BIGINT) AS ords FROM left_over GROUP BY owner_id, name""",
    "w2_html_classes": f"""
WITH lists AS (SELECT page_id, unnest(regexp_extract_all({_CLASSES}, '(?i)\\bclass\\s*=\\s*"([^"]*)"', 1)) AS l FROM pages),
names AS (SELECT DISTINCT page_id, unnest(regexp_split_to_array(trim(l), '\\s+')) AS class FROM lists)
SELECT class, count(*) AS pages FROM names WHERE class <> '' GROUP BY class""",
    "w3_css_classes": r"""
WITH names AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '\.(-?[A-Za-z_][A-Za-z0-9_-]*)', 1)) AS c FROM pages),
lists AS (SELECT page_id, string_agg(c, ',' ORDER BY lower(c), c) AS classes FROM names GROUP BY page_id)
SELECT p.page_id, coalesce(l.classes, '') AS classes FROM pages p LEFT JOIN lists l USING (page_id)""",
    "w1_html_assets": r"""
SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, '(?i)<script\b[^>]*\bsrc\s*=\s*["'']([^"'']+)["'']', 1))) AS BIGINT) AS scripts,
       CAST(len(list_distinct(list_filter(regexp_extract_all(html, '(?i)<link\b[^>]*>'), lambda x: regexp_matches(x, '(?i)rel\s*=\s*["'']stylesheet["'']') AND regexp_matches(x, '(?i)href\s*=')))) AS BIGINT) AS styles FROM pages""",
    "t1_lines_of_links": r"""
WITH lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS l FROM documents),
counts AS (SELECT doc_id, line, len(regexp_extract_all(l, '\b([A-Z][a-z]+)\.')) AS n FROM lines)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS matches, CAST(min(line) AS BIGINT) AS first_line, CAST(max(line) AS BIGINT) AS last_line FROM counts WHERE n > 0 GROUP BY doc_id""",
    "t2_excerpts": r"""
WITH cut AS (SELECT doc_id, trim(array_to_string(string_split(text, chr(10))[2:4], chr(10)), ' ') AS e FROM documents)
SELECT doc_id, CASE WHEN length(e) <= 220 THEN e ELSE trim(substr(e, 1, 220), ' ') || ' ...' END AS excerpt FROM cut""",
    "t4_first_lines": """
SELECT doc_id, md5(CASE WHEN len(string_split(text, chr(10))) > 10 THEN array_to_string(string_split(text, chr(10))[1:10], chr(10)) || chr(10) || '...' ELSE text END) AS snippet_md5 FROM documents""",
    "t6_call_names": "SELECT p_partkey, 'make_' || p_size || ',load,if' AS names FROM part",
    "t7_import_bindings": """
SELECT n_nationkey, 'p' || n_nationkey AS local, 'part' || n_nationkey AS imported FROM nation
UNION ALL SELECT n_nationkey, 'r' || n_regionkey, 'region' || n_regionkey FROM nation UNION ALL SELECT n_nationkey, 'same', 'same' FROM nation""",
    "t9_signature_heads": "SELECT s_suppkey, 'int get_' || s_suppkey || '(int a)' AS head FROM supplier",
    "t13_byte_sizes": """
WITH n AS (SELECT doc_id, strlen(text) AS b FROM documents)
SELECT doc_id, CASE WHEN b < 1024 THEN printf('%.0f B', b::DOUBLE) WHEN b < 10240 THEN printf('%.1f KB', b / 1024.0::DOUBLE) WHEN b < 1048576 THEN printf('%.0f KB', b / 1024.0::DOUBLE)
       WHEN b < 10485760 THEN printf('%.1f MB', b / 1048576.0::DOUBLE) ELSE printf('%.0f MB', b / 1048576.0::DOUBLE) END AS size FROM n""",
    "t15_truncation": f"""
SELECT doc_id, len(string_split(text, chr(10))) > 5 AS truncated, md5(CASE WHEN len(string_split(text, chr(10))) > 5 THEN {_HEAD5} ELSE text END) AS code_md5,
       CASE WHEN len(string_split(text, chr(10))) > 5 THEN chr(10) || '...' ELSE '' END AS marker FROM documents""",
    "t24_relative_paths": r"""
WITH rows AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS root, regexp_replace(url, '^https?://', '') AS path FROM pages)
SELECT page_id, CASE WHEN path = root THEN '/' WHEN starts_with(path, root || '/') THEN substr(path, length(root) + 2) ELSE path END AS relative FROM rows""",
    "s12_line_statistics": """
WITH lines AS (SELECT doc_id, length(text) AS n, list_filter(list_transform(string_split(text, chr(10)), lambda x: length(trim(x, ' '))), lambda k: k > 0) AS l FROM documents),
stats AS (SELECT doc_id, n, CAST(coalesce(list_max(l), 0) AS BIGINT) AS longest, CAST(len(l) AS BIGINT) AS lines, coalesce(list_avg(l), 0) AS average FROM lines)
SELECT doc_id, longest, lines, n >= 16384 AND (longest >= 4000 OR (longest >= 2000 AND average >= 350) OR (lines <= 8 AND average >= 1200)) AS minified FROM stats""",
    "s14_previews": """
WITH cut AS (SELECT doc_id, strlen(text) AS b, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, md5(array_to_string(l[1:40], chr(10)) || CASE WHEN b > 262144 THEN chr(10) || '... [preview truncated: file too large to load fully]' WHEN len(l) > 40 THEN chr(10) || '...' ELSE '' END) AS preview_md5 FROM cut""",
    "s2_crawl": _PATHS + "SELECT root, rel_path, name, suffix, dir, CAST(len(string_split(rel_path, '/')) - 1 AS BIGINT) AS depth, file_type FROM taken",
    "s5_limits": _PATHS + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY root, dir ORDER BY lower(name), name) AS n FROM taken),
kept AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY lower(dir), dir, n) AS m FROM ranked WHERE n <= 3) SELECT root, rel_path FROM kept WHERE m <= 8""",
    "q1_file_types": _PATHS + "SELECT root, file_type, count(*) AS files FROM taken GROUP BY root, file_type",
    "h8_symbols": _SUPPLIES + """
SELECT 'shop/lib/sup_' || s || '.ts' AS file_path, 'function' AS kind, 'part_' || p AS name, CAST(p AS VARCHAR) AS returns FROM (SELECT DISTINCT s, p FROM supplies)
UNION ALL SELECT 'shop/lib/sup_' || s || '.ts', 'function', 'note_' || s, '"note_' || s || '() is text"' FROM (SELECT DISTINCT s FROM supplies)""",
    "t12_signatures": "SELECT DISTINCT 'order_' || l_orderkey AS name, 'count' AS parameter, 'number' AS type, 'number' AS returns FROM lineitem",
    "g3_same_file_calls": _SUPPLIES + "SELECT 'shop/lib/sup_' || s || '.ts' AS file_path, 'note_' || s AS target, count(DISTINCT p) AS callers FROM supplies GROUP BY s",
    "d1_dependencies": _SUPPLIES + "SELECT 'lib/sup_' || s || '.ts' AS target_path, count(DISTINCT o) AS importers, count(*) AS bindings FROM supplies GROUP BY s",
    "x1_cross_file_calls": _SUPPLIES + """, names AS (SELECT o, s, string_agg('part_' || p || ' as item_' || p, ', ' ORDER BY 'part_' || p || ' as item_' || p) AS names FROM supplies GROUP BY o, s),
first AS (SELECT o, p, min_by(s, 'import { ' || names || ' } from "../lib/sup_' || s || '";') AS s FROM supplies JOIN names USING (o, s) GROUP BY o, p)
SELECT 'lib/sup_' || s || '.ts' AS rel_path, count(*) AS calls, count(DISTINCT o) AS files FROM first GROUP BY s""",
    "x2_incoming_calls": "SELECT 'part_' || l_partkey AS name, count(DISTINCT l_orderkey) AS callers FROM lineitem GROUP BY l_partkey",
    "r1_routes": "SELECT DISTINCT 'app' AS owner, 'GET' AS method, '/supplier/' || l_suppkey AS path, 'GET /supplier/' || l_suppkey AS label, CAST(2 AS BIGINT) AS line FROM lineitem",
    "f1_related_files": """
SELECT 'src/m_' || s_suppkey || '.cpp' AS file, 'src/m_' || s_suppkey || '.h' AS path, 'header' AS type FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'src/m_' || s_suppkey || '.h', 'src/m_' || s_suppkey || '.cpp', 'implementation' FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'py/m_' || s_suppkey || '.py', 'py/tests/test_m_' || s_suppkey || '.py', 'test' FROM supplier WHERE s_suppkey % 3 = 0""",
    "w6_class_usage": """
WITH used AS (SELECT 'c' || (s_suppkey % 10) AS class, s_suppkey % 10 IN (1, 2) OR s_suppkey % 10 = s_nationkey % 10 AS has FROM supplier UNION ALL SELECT 'hero', true FROM supplier)
SELECT class, CASE WHEN has THEN 'matched' ELSE 'missing' END AS role, count(*) AS pages FROM used GROUP BY ALL""",
    "p1_packages": "SELECT 'm' || s_suppkey || '/package.json' AS rel_path, s_name AS name, '1.0' AS version, 'make ' || s_suppkey AS build, 'dep-' || s_nationkey AS dependency, CAST(1 AS BIGINT) AS dep_count FROM supplier",
    "h12_json_keys": """
WITH keys AS (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events)
SELECT event_type, key, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.' || key) AS BIGINT)) AS BIGINT) AS total FROM keys GROUP BY event_type, key""",
    "d5_resolved_targets": _named(),
    "t16_tag_diagnostics": _TAGS,
    "q3_main_entries": _PATHS + f""", lists AS (SELECT {list(summary.CONVENTIONAL)} AS conventional, {list(summary.PREFERRED)} AS preferred),
points AS (SELECT unnest({list(summary.NAME_POINTS)}) AS name, unnest({list(summary.NAME_POINTS.values())}) AS points),
scored AS (
  SELECT t.root, t.rel_path, list_position(l.conventional, t.rel_path) AS place, regexp_matches(lower(t.rel_path), '/src/main/java/.*mainactivity\\.java$') AS android,
         regexp_matches(lower(t.rel_path), '^(third_party|vendor|node_modules|dist|build|coverage|tests|test|docs)/|/src/test/|/src/androidtest/|/tests/|/test/') AS never,
         CASE WHEN list_position(l.preferred, lower(t.rel_path)) > 0 THEN 201 - list_position(l.preferred, lower(t.rel_path)) ELSE 0 END + CASE WHEN starts_with(lower(t.rel_path), 'src/') THEN 80 ELSE 0 END
         + CASE WHEN contains(lower(t.rel_path), '/src/main/') THEN 95 ELSE 0 END + CASE WHEN regexp_matches(lower(t.rel_path), '/src/main/(java|kotlin|csharp|cs)/') THEN 45 ELSE 0 END
         + CASE WHEN dir = '' THEN 30 ELSE 0 END - CASE WHEN regexp_matches(lower(t.rel_path), '/(assets|wwwroot|www)/') THEN 40 ELSE 0 END - 8 * (len(string_split(t.rel_path, '/')) - 1) + coalesce(p.points, 0) AS score
  FROM taken t CROSS JOIN lists l LEFT JOIN points p ON p.name = lower(t.name))
SELECT root, coalesce(min_by(rel_path, place) FILTER (place > 0), min(rel_path) FILTER (android AND NOT never), min_by(rel_path, (-score, rel_path)) FILTER (NOT never), '') AS main_entry FROM scored GROUP BY root""",
    "w5_quick_links": """
WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier),
rows AS (
  SELECT k, n, 0 AS ord, 'script' AS type, './app_' || k || '.js' AS target, 4 AS line, 'n' || n || '/app_' || k || '.js' AS rel_path, k % 2 = 0 AS has FROM s
  UNION ALL SELECT k, n, 2, 'script', '/static/boot.js', 6, 'n' || n || '/static/boot.js', false FROM s
  UNION ALL SELECT k, n, 3, 'stylesheet', '../css/main.css', 2, 'css/main.css', true FROM s
  UNION ALL SELECT k, n, 4, 'stylesheet', 'local.css?v=1', 3, 'n' || n || '/local.css', true FROM s)
SELECT 'n' || n || '/p' || k || '.html' AS page, CAST(ord AS BIGINT) AS ord, type, target, CAST(line AS BIGINT) AS line, rel_path, has AS "exists" FROM rows""",
    "w8_style_consumers": """
WITH used AS (SELECT s_nationkey AS n, 'c' || s_suppkey % 10 AS class, 'p' || s_suppkey || '.html' AS page FROM supplier UNION ALL SELECT s_nationkey, 'hero', 'p' || s_suppkey || '.html' FROM supplier)
SELECT 'n' || n || '/local.css' AS style, class, CASE WHEN class = 'c' || n % 10 THEN 'matched' ELSE 'missing' END AS role, min(page) AS page, CASE WHEN class = 'c' || n % 10 THEN '.' || class || ' { margin: 0 }' ELSE '' END AS rule FROM used GROUP BY n, class""",
    "w9_script_consumers": """
SELECT 'n' || s_nationkey || '/app_' || s_suppkey || '.js' AS script, 'n' || s_nationkey || '/p' || s_suppkey || '.html' AS page FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'n' || s_nationkey || '/boot.js', 'n' || s_nationkey || '/p' || s_suppkey || '.html' FROM supplier""",
    "j2_documents": """
WITH pages AS (SELECT s_nationkey AS n, s_suppkey AS k, 'c' || s_suppkey % 10 AS c FROM supplier),
styles AS (SELECT n, list_distinct(list_append(list(c), 'hero')) AS used FROM pages GROUP BY n)
SELECT 'w/n' || n || '/p' || k || '.html' AS path, CAST(4 AS BIGINT) AS links, CAST(2 AS BIGINT) AS classes, CAST(CASE WHEN c IN ('c1', 'c2', 'c' || n % 10) THEN 0 ELSE 1 END AS BIGINT) AS missing FROM pages
UNION ALL SELECT 'w/n' || n || '/app_' || k || '.js', 0, 0, 0 FROM pages WHERE k % 2 = 0 UNION ALL SELECT DISTINCT 'w/n' || n || '/boot.js', 0, 0, 0 FROM pages
UNION ALL SELECT 'w/css/main.css', 0, 0, 0 UNION ALL SELECT 'w/n' || n || '/local.css', 0, len(used), len(list_filter(used, lambda x: x <> 'c' || n % 10)) FROM styles""",
    "g5_relations": """
WITH calls AS (
  SELECT 'g/d_' || n_nationkey || '.ts' AS f, unnest(['D', 'D', 'run_']) || n_nationkey AS a, unnest(['run_', 'help_', 'help_']) || n_nationkey AS b FROM nation
  UNION ALL SELECT 'g/D' || n_nationkey || '.java', 'run_' || n_nationkey, 'help_' || n_nationkey FROM nation)
SELECT f AS file_path, a AS symbol, 'calls' AS direction, b AS other FROM calls UNION ALL SELECT f, b, 'calledBy', a FROM calls""",
    "g8_symbol_paths": _expected("file_path, kind, name, depth", lambda t: [x for x in t[2] if x[2] > 0]),
    "x3_cut_relations": _FIRST + f"""
SELECT 'shop/src/order_' || o || '.ts' AS path, '{graph.CUT_IMPORTED}' AS message, true AS said FROM supplies GROUP BY o HAVING count(DISTINCT s) > 2
UNION ALL SELECT 'shop/lib/sup_' || s || '.ts', '{graph.CUT_INCOMING}', true FROM first GROUP BY s HAVING count(DISTINCT o) > 3""",
    # per nation: symbols, and those whose snippet has a word that its language colours; all brackets match
    "t22_shown_snippets": """
SELECT language, (SELECT count(*) FROM nation) * n AS snippets, CAST(0 AS BIGINT) AS problems, (SELECT count(*) FROM nation) * c AS coloured
FROM (VALUES ('python', 5, 5), ('java', 4, 4), ('csharp', 5, 4), ('rust', 4, 4), ('php', 5, 5), ('swift', 5, 2), ('cpp', 2, 2), ('objc', 2, 2), ('qml', 4, 4), ('css', 4, 0), ('jsx', 2, 2), ('ts', 5, 3), ('json', 5, 0)) v(language, n, c)""",
    "x4_incoming_surface": "SELECT language, (SELECT count(*) FROM nation) * n AS files FROM (VALUES ('python', 2), ('java', 1), ('csharp', 2), ('rust', 1), ('php', 1), ('swift', 1), ('cpp', 1), ('objc', 1), ('qml', 1), ('css', 1), ('jsx', 1), ('ts', 1)) v(language, n)",
    "m5_recovered": """
SELECT 'm/b_' || n_nationkey || '.ts' AS file_path, 'function' AS kind, unnest(['one_', 'two_']) || n_nationkey AS name, 'recovered' AS mode, true AS partial, CAST(1 AS BIGINT) AS notices FROM nation
UNION ALL SELECT 'm/B' || n_nationkey || '.cs', unnest(['class', 'method', 'method', 'variable']), unnest(['K', 'Go', 'Up', 'x']) || n_nationkey, 'recovered', true, 1 FROM nation""",
    "q2_package_entries": "SELECT 'r' || s_suppkey AS root, CASE s_suppkey % 4 WHEN 0 THEN 'lib/a.js' WHEN 1 THEN 'web.js' ELSE 'src/index.ts' END AS entry FROM supplier WHERE s_suppkey % 4 < 3",
    "q5_visible_entries": _PATHS + """, entries AS (SELECT string_split(rel_path, '/') AS p FROM taken)
SELECT DISTINCT p[1] AS path, len(p) > 1 AS is_dir, CAST(0 AS BIGINT) AS depth FROM entries UNION SELECT p[1] || '/' || p[2], len(p) > 2, 1 FROM entries WHERE p[1] = 'src'""",
    "q6_selected_symbols": "SELECT * FROM (VALUES ('C1', 'class', 'C1', 'class'), ('run_1', 'method', 'run_1', 'method'), ('', '', 'm_1.py', 'file')) v(name, kind, shown, shown_kind)",
    "s7_skipped": _PATHS + "SELECT 'all' AS root, dir, count(DISTINCT rel_path) - 1 AS skipped FROM taken GROUP BY dir HAVING count(DISTINCT rel_path) > 1",
    "s10_gates": """
SELECT 'z/f' || s_suppkey || '.js' AS path, s_suppkey % 50 IN (1, 2, 3) AS partial, CASE s_suppkey % 50 WHEN 1 THEN 'Analysis skipped: file is too large (2.0 MB, limit 2.0 MB)' WHEN 2 THEN 'Analysis skipped: file looks minified' WHEN 3 THEN 'Unable to read file' ELSE '' END AS message
FROM supplier WHERE s_suppkey <= 100""",
    "t5_identifiers": "SELECT p_partkey, 'v_' || p_size AS first, '$v_' || p_size AS variable, 'end_' || p_size AS last, p_name AS bare FROM part",
    "t8_rust_labels": """
SELECT 'std::fmt_' || n_nationkey || ' as f_' || n_nationkey AS use, 'f_' || n_nationkey AS label FROM nation
UNION ALL SELECT 'crate_' || n_nationkey || '::{a, b as c}', 'crate_' || n_nationkey FROM nation UNION ALL SELECT '::core_' || n_nationkey || '::x', 'core_' || n_nationkey FROM nation""",
    "t23_target_paths": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '/s/' || s_suppkey WHEN s_suppkey % 2 = 0 THEN '/p/' || s_suppkey ELSE '/f' END AS path FROM supplier",
    "m3_flat_merge": """
WITH sides AS (SELECT o_custkey AS target, o_orderkey AS ord, o_orderstatus AS origin, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END, o_orderkey) AS n FROM orders WHERE o_orderstatus IN ('O', 'F'))
SELECT 'import' AS type, target, ord, origin FROM sides WHERE n = 1""",
    "m1_band_merge": """
WITH RECURSIVE given AS (
  SELECT l_suppkey AS f, CAST(l_partkey % 10 AS VARCHAR) AS name, l_partkey % 41 AS line, CASE WHEN l_quantity >= 48 THEN '' ELSE 'f' || l_orderkey % 100 END AS snippet,
         l_orderkey * 8 + l_linenumber AS ord, CASE WHEN l_linenumber > 2 THEN l_returnflag ELSE '' END AS detail FROM lineitem),
steps AS (SELECT *, row_number() OVER (PARTITION BY f, name ORDER BY ord) AS n FROM given WHERE ord % 2 = 1),
groups AS (SELECT DISTINCT f, name FROM given),
firsts AS (SELECT g.f, g.name, coalesce(list({'line': x.line, 'snippet': x.snippet, 'ord': x.ord, 'detail': x.detail} ORDER BY x.ord) FILTER (x.ord IS NOT NULL), []) AS kept
  FROM groups g LEFT JOIN given x ON x.f = g.f AND x.name = g.name AND x.ord % 2 = 0 GROUP BY g.f, g.name),
run AS (
  SELECT f, name, 0::BIGINT AS n, kept FROM firsts
  UNION ALL
  SELECT r.f, r.name, s.n, CASE WHEN p.place IS NULL OR p.place = 0 THEN list_append(r.kept, {'line': s.line, 'snippet': s.snippet, 'ord': s.ord, 'detail': s.detail})
    ELSE list_transform(r.kept, lambda k, i: CASE WHEN i = p.place THEN {'line': CASE WHEN k.line <= 0 THEN s.line ELSE k.line END, 'snippet': CASE WHEN k.snippet = '' THEN s.snippet ELSE k.snippet END, 'ord': k.ord, 'detail': CASE WHEN k.detail = '' THEN s.detail ELSE k.detail END} ELSE k END) END
  FROM run r JOIN steps s ON s.f = r.f AND s.name = r.name AND s.n = r.n + 1,
  LATERAL (SELECT list_position(list_transform(r.kept, lambda k: (k.line > 0 AND s.line > 0 AND abs(k.line - s.line) <= 1)
    OR ((k.line <= 0 OR s.line <= 0 OR abs(k.line - s.line) <= 3) AND (k.snippet = '' OR s.snippet = '' OR contains(k.snippet, s.snippet) OR contains(s.snippet, k.snippet)))), true) AS place) p),
last AS (SELECT f, name, unnest(max_by(kept, n)) AS k FROM run GROUP BY f, name)
SELECT f AS file_id, name, count(*) AS symbols, CAST(count(*) FILTER (k.detail <> '') AS BIGINT) AS filled, CAST(sum(k.line) AS BIGINT) AS lines, CAST(sum(k.ord) AS BIGINT) AS ords FROM last GROUP BY f, name""",
    "j1_analysis_json": "SELECT DISTINCT 'shop/lib/sup_' || l_suppkey || '.ts' AS path, 'ts' AS language, 'ast' AS source_mode FROM lineitem",
}
