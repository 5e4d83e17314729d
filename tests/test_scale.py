"""What must not grow faster than the input: resolution of dependencies, calls across files, merges; each against plain Python."""

import posixpath
import random
import re

from symlake.operators import graph, links, merge


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_targets_are_resolved_once_for_all_files_that_name_them(spark):
    paths = ["a/b/x.ts", "a/b/x/index.js", "a/y.js", "a/b/.js", "a/.json", "z.tsx", "a/b/index.ts", "index.js", "a/b/h.h", "a/h.h", "q/..ts/index.js"]
    targets = ["./x", "./", ".", "..", "../", "../y", "../y.js", "./.", "./x/", "./x/.", "../../z", "../../../z", "/a/y", "./../b/./x", "../..", "h.h", "../h.h", "react", "./q", "/", ".x/", "..", "../../q/..ts"]
    files = spark.createDataFrame([("r", p, f"id{n}") for n, p in enumerate(paths)], "root string, rel_path string, file_id string")
    rows = [("r", f"f{k}", d, lang, n, "import", t) for k in range(3) for lang, d in (("ts", "a/b"), ("cpp", "a/b"), ("ts", ""), ("python", "a")) for n, t in enumerate(targets)]
    rows = [(root, f"{f}{lang}{d}", d, lang, n, kind, t) for root, f, d, lang, n, kind, t in rows]
    found = links.resolve(spark.createDataFrame(rows, "root string, file_id string, dir string, language string, ord int, type string, target string"), files)

    def normal(path):
        parts = []
        for x in path.split("/"):
            if x == ".." and not parts:
                return None
            parts = parts[:-1] if x == ".." else parts if x in ("", ".") else [*parts, x]
        return "/".join(parts)

    def want(directory, language, target):
        ends = [""] if language == "cpp" else links.CANDIDATES if language == "ts" and re.match(r"\.{0,2}/", target) else []
        return next((p for p in (normal(posixpath.join(directory, "") + "/" + target + end) for end in ends) if p in paths), None)

    got = {(r["file_id"], r["ord"]): r["target_path"] for r in found.collect()}
    assert len(got) == len(rows)
    assert got == {(f, n): want(d, lang, t) for _, f, d, lang, n, _, t in rows}
    lines = plan_of(found).split("\n")
    tried = next(k for k, line in enumerate(lines) if "posexplode" in line)
    assert any("Aggregate" in line for line in lines[tried:])  # distinct targets are tried, not the rows of every file


def test_names_that_no_script_has_do_not_meet_all_imports(spark):
    shape = "file_id string, language string, sym_id int, kind string, name string, calls array<string>"
    symbols = [("m", "ts", 0, "function", "main", ["log", "help", "other", "main2", "aliased"]), ("m", "ts", 1, "function", "main2", []), ("a", "ts", 0, "function", "help", []), ("b", "ts", 0, "class", "help", []), ("b", "ts", 1, "function", "real", []), ("c", "python", 0, "function", "log", [])]
    deps = [("m", 0, "b", [("aliased", "real")]), ("m", 1, "a", []), ("m", 2, "c", []), ("m", 3, None, [])]
    found = graph.cross_file_calls(spark.createDataFrame(symbols, shape), spark.createDataFrame(deps, "file_id string, ord int, target_file_id string, bindings array<struct<local:string,imported:string>>"))
    assert sorted(tuple(r) for r in found.collect()) == [("m", 0, "b", 0, "help"), ("m", 0, "b", 1, "aliased")]
    assert "LeftSemi" in plan_of(found)


def test_symbol_tables_merge_as_in_a_plain_list_and_without_a_fold_over_arrays(spark):
    rnd = random.Random(3)
    words = ["", " ", None, "a", "ab", "b", "cab", " ab "]
    shape = "f long, kind string, name string, line int, snippet string, ord long, detail string"
    make = lambda n, at: [(rnd.choice([1, 2, None]), "k", rnd.choice(["x", "y"]), rnd.choice([None, -1, 0, *range(1, 40)]), rnd.choice(words), at + k, rnd.choice(["", "d", None])) for k in range(n)]
    first, second = make(150, 0), make(250, 1000)
    found = merge.merge_symbol_tables(spark.createDataFrame(first, shape), spark.createDataFrame(second, shape), ["f"], ["detail"])
    bare = lambda x: (x or "").strip(" ")

    def near(a, b):
        a_line, b_line = a[3], b[3]
        alike = not bare(a[4]) or not bare(b[4]) or bare(a[4]) in bare(b[4]) or bare(b[4]) in bare(a[4])
        if (a_line is not None and a_line <= 0) or (b_line is not None and b_line <= 0):
            return alike
        return a_line is not None and b_line is not None and (abs(a_line - b_line) <= 1 or (abs(a_line - b_line) <= 3 and alike))

    out = [list(r) for r in first]
    for new in second:
        old = next((o for o in out if (o[0], o[2]) == (new[0], new[2]) and near(o, new)), None)
        if old is None:
            out.append(list(new))
            continue
        line = new[3] if old[3] is not None and old[3] <= 0 else old[3]
        old[3], old[4], old[6] = line, old[4] if bare(old[4]) else new[4], old[6] if bare(old[6]) else new[6]
    assert sorted(map(repr, (tuple(r) for r in out))) == sorted(repr(tuple(r)) for r in found.collect())
    assert "aggregate(" not in plan_of(found)


def test_call_names_of_a_symbol_are_put_together_in_its_row(spark):
    shape = "file_id string, language string, sym_id int, kind string, name string, snippet string, calls array<string>"
    rows = [("f", "ts", 0, "function", "a", "b(); c(); b();", ["b", "d"]), ("f", "ts", 1, "class", "b", "a() d()", ["d"]), ("f", "ts", 2, "function", "c", None, None), ("f", "ts", 3, "function", "d", "d()", []), ("g", "cpp", 0, "function", "a", "b()", ["c"]), ("g", "cpp", 1, "function", "b", "", []), ("g", "cpp", 2, "function", "c", "", [])]
    found = graph.relations(spark.createDataFrame(rows, shape))
    assert sorted(tuple(r) for r in found.collect()) == [("f", 0, 1), ("f", 0, 2), ("f", 0, 3), ("f", 1, 0), ("f", 1, 3), ("g", 0, 2)]
    assert "Union" not in plan_of(found)
