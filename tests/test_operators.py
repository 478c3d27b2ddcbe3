"""Operators and commands on a small hand-made code base."""

from __future__ import annotations

import pytest

from lodestar.functions import commandline, names, predicates, text
from lodestar.operators import aggregates, graph, lookup, rank, report, xref
from lodestar.plans import workspace
from lodestar.plans.commands import CodeBase
from lodestar.plans.tools import tools
from lodestar.schema import DEFINITION, TABLES, VIRTUAL, kinds
from lodestar.sources import readers
from lodestar.streaming import incremental

SYMBOL = "file_id int, line int, col int, symbol_name string, usr string, base_classes array<string>, kind string, flags int, symbol_length int, start_line int, start_col int, end_line int, end_col int"


@pytest.fixture(scope="module")
def code(spark):
    """shared.hpp declares what a.cpp defines and b.cpp uses; a class with an override; one function nobody calls."""
    d = DEFINITION
    symbols = [
        (0, 3, 6, "void shared_function(int)", "c:@F@shared", [], "FunctionDecl", 0, 15, 3, 1, 3, 25),
        (0, 5, 8, "Base", "c:@S@Base", [], "ClassDecl", d, 4, 5, 1, 9, 2),
        (0, 6, 10, "void Base::vfunc()", "c:@S@Base@vfunc", [], "CXXMethod", VIRTUAL, 5, 6, 3, 6, 22),
        (0, 11, 8, "Derived", "c:@S@Derived", ["c:@S@Base"], "ClassDecl", d, 7, 11, 1, 15, 2),
        (0, 12, 10, "void Derived::vfunc()", "c:@S@Derived@vfunc", [], "CXXMethod", VIRTUAL | d, 5, 12, 3, 14, 4),
        (1, 3, 6, "void shared_function(int)", "c:@F@shared", [], "FunctionDecl", d, 15, 3, 1, 6, 2),
        (1, 8, 6, "void lonely()", "c:@F@lonely", [], "FunctionDecl", d, 6, 8, 1, 10, 2),
        (1, 9, 3, "shared_function", "", [], "DeclRefExpr", 0, 15, 9, 3, 9, 18),
        (2, 4, 5, "int main()", "c:@F@main", [], "FunctionDecl", d, 4, 4, 1, 8, 2),
        (2, 5, 3, "shared_function", "", [], "DeclRefExpr", 0, 15, 5, 3, 5, 18),
        (2, 6, 5, "vfunc", "", [], "MemberRefExpr", 0, 5, 6, 5, 6, 10),
    ]
    s = spark.createDataFrame(symbols, SYMBOL)
    usrs = s.where("usr <> ''").select("usr", "file_id", "line", "col")
    targets = spark.createDataFrame(
        [("c:@F@shared", 1, 9, 3), ("c:@F@shared", 2, 5, 3), ("c:@S@Base@vfunc", 2, 6, 5), ("c:@S@Base@vfunc", 0, 12, 10)], "usr string, file_id int, line int, col int"
    )
    files = spark.createDataFrame([(0, "/w/inc/shared.hpp", True, False, 50, 100), (1, "/w/src/a.cpp", False, False, 10, 100), (2, "/w/src/b.cpp", False, False, 200, 100), (3, "/usr/include/x.h", True, True, 1, 1)], TABLES["files"])
    includes = spark.createDataFrame([(1, 0), (2, 0), (0, 3), (2, 3)], TABLES["includes"])
    name_rows = aggregates.name_index(s.where("usr <> ''").select("file_id", "line", "col", names.strip_parentheses(s.symbol_name).alias("symbol_name")).union(s.where("usr <> ''").select("file_id", "line", "col", "symbol_name")))
    return CodeBase(spark, {"symbols": s, "usrs": usrs, "targets": targets, "files": files, "includes": includes, "symbol_names": name_rows}, root="/w/")


def places(df):
    return sorted((r.file_id, r.line, r.col) for r in df.collect())


def test_follow_and_references(code):
    assert places(code.follow_location(2, 5, 10)) == [(1, 3, 6)]
    assert places(code.follow_location(0, 3, 6)) == [(1, 3, 6)]
    assert places(code.follow_location(2, 5, 10, all_targets=True)) == [(0, 3, 6), (1, 3, 6)]
    assert places(code.follow_location(2, 1, 1)) == []
    assert places(code.references(0, 3, 8)) == [(1, 9, 3), (2, 5, 3)]
    assert [r.position for r in code.references(1, 9, 3).collect()] == [1, 2]
    assert places(code.references(1, 9, 3, mode="all")) == [(0, 3, 6), (1, 3, 6), (1, 9, 3), (2, 5, 3)]
    assert places(code.rename(2, 5, 3)) == [(0, 3, 6), (1, 3, 6), (1, 9, 3), (2, 5, 3)]
    assert places(code.references(2, 6, 5, mode="virtuals")) == [(0, 6, 10), (0, 12, 10)]
    assert places(code.references_by_name("void shared_function")) == [(1, 9, 3), (2, 5, 3)]
    assert [r.usr for r in code.target_usrs(2, 6, 7).collect()] == ["c:@S@Base@vfunc"]


def test_names_and_reports(code):
    assert places(code.find_symbols("vfunc()")) == [(0, 6, 10), (0, 12, 10)]
    assert code.find_symbols("void shared_f*", wildcards=True, definitions_only=True).count() == 1
    assert code.find_symbols("void", kind_filter="-cxxmethod", path_filters=["/w/src/a.cpp"], wildcards=True).count() == 2
    assert {r.name for r in code.list_symbols("void lon").collect()} == {"void lonely", "void lonely()"}
    assert {(r.usr, r.callers) for r in code.dead_functions().collect()} == {("c:@F@lonely", 0), ("c:@S@Derived@vfunc", 0)}
    assert {(r.direction, r.usr) for r in code.class_hierarchy("c:@S@Derived").collect()} == {("super", "c:@S@Base")}
    assert {(r.src_file, r.dst_file) for r in code.check_includes().collect()} == {(0, 3), (2, 3)}
    assert [r.text for r in code.include_path(2, 6, 5).collect()] == ["src/b.cpp -> inc/shared.hpp"]
    assert [r.text for r in code.include_path(2, 6, 5, absolute=True).collect()] == ["/w/src/b.cpp -> /w/inc/shared.hpp"]
    # the definition's file is not included; the declaration's is
    assert [(r.file_id, r.text) for r in code.include_path(2, 5, 3).collect()] == [(0, "src/b.cpp -> inc/shared.hpp")]
    assert code.include_path(2, 5, 3, max_nodes=1).count() == 0
    assert {r.path for r in code.find_file("b.cpp", prefer_exact=True).collect()} == {"src/b.cpp"}
    assert {r.name: r.rows for r in code.table_counts().collect()}["files"] == 4
    assert {(r.section, r.text) for r in code.status("Proj").collect()} == {("project", "Path: /w/")}
    assert {r.section for r in code.status().collect()} == {"fileids", "watchedpaths", "dependencies", "symbols", "targets", "symbolnames", "memory", "project"}
    assert code.status("cursors").count() == code["symbols"].count() and code.status("none").count() == 0
    assert code.is_indexed("/w/src/a.cpp") == "indexed" and code.is_indexed("/nope") == "unknown"
    assert {r.text for r in code.include_for("Derived", 1, ["/w/inc"]).collect()} == {"#include <shared.hpp>"}
    assert places(code.called_by(1, (8, 1), (10, 2))) == [(1, 3, 6)]
    assert code.generate_test().count() == 5
    assert code.dump_file(2).count() > 3 and code.cursor_kinds().count() == kinds(code.spark).count()
    assert {r.name for r in code.complete_includes(["/w"], 1).collect()} == {"inc/shared.hpp"}


def test_enclosing_container(code):
    probes = code["symbols"].where("kind in ('DeclRefExpr', 'MemberRefExpr')").select("file_id", "line", "col")
    got = {(r.file_id, r.line): r.enclosing_symbol_name for r in lookup.enclosing_container(probes, code["symbols"]).collect()}
    assert got == {(1, 9): "void lonely()", (2, 5): "int main()", (2, 6): "int main()"}
    rows = report.location_text(report.with_context(lookup.enclosing_container(probes, code["symbols"]), code["files"], code.spark.createDataFrame([(1, 9, "  shared_function(1);")], TABLES["lines"])), "/w/", ("context", "containing_function"))
    assert "src/a.cpp:9:3:\t  shared_function(1);\tfunction: void lonely()" in {r.text for r in rows.collect()}


def test_argument_index(spark):
    """Neither side is broadcast, however small its file; arguments without a place or length hold nothing; of two that start together the later counts."""
    a = [(1, i, 1, 1, c, 1, 999) for i, c in ((1, 5), (2, 900), (3, 5), (4, None))] + [(2, i, 2, 1, c, 1, 999) for i, c in ((1, 8), (2, 3))]
    a = spark.createDataFrame(a, "call_id int, index int, file_id int, line int, col int, end_line int, end_col int")
    p = spark.createDataFrame([(1, 1, 1, 600), (2, 1, 1, 4), (3, 2, 1, 8), (4, 2, 1, 2), (5, 3, 1, 8)], "probe_id int, file_id int, line int, col int")
    got = lookup.argument_index(p, a)
    assert {(r.probe_id, r.enclosing_index) for r in got.collect()} == {(1, 3), (3, 2)}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert lookup.argument_index(p, a.where("false")).count() == 0


def test_predicates(spark):
    df = spark.createDataFrame([("foo",), ("foo(int)",), ("foobar",), ("foo(int)::x",), ("a.b",), ("aXb",), (None,)], "name string")
    hit = lambda c: {r.name for r in df.where(c).collect()}
    assert hit(predicates.overload(df.name, "foo")) == {"foo", "foo(int)"}
    assert hit(predicates.wildcard(df.name, "a.b")) == {"a.b"} and hit(predicates.wildcard(df.name, "A?b", True)) == {"a.b", "aXb"}
    assert hit(predicates.matches(df.name, "(", True)) == {"foo(int)", "foo(int)::x"}
    assert hit(predicates.name_search(df.name, "")) == {r.name for r in df.collect()}
    with pytest.raises(ValueError):
        predicates.line_range(5, 5)


def test_templates(spark):
    df = spark.createDataFrame([("c:@S@v<int, char>",), ("a<b<c>, d>::e<>",), ("plain",), ("x<",), ("",), (None,)], "usr string")
    assert [r[0] for r in df.select(names.template_canonical(df.usr)).collect()] == ["c:@S@v<T0, T1>", "a<b<T0>, d>::e<>", "plain", "x<", "", None]


def test_overrides_climb(spark):
    """C overrides B which overrides A, each known to its direct base only."""
    rows = [(0, 10 * k, 1, f"m{u}", u, [], "CXXMethod", VIRTUAL, 1, 10 * k, 1, 10 * k, 9) for k, u in enumerate("ABCX")]
    s = spark.createDataFrame(rows, SYMBOL)
    usrs = s.select("usr", "file_id", "line", "col")
    targets = spark.createDataFrame([("A", 0, 10, 1), ("B", 0, 20, 1)], "usr string, file_id int, line int, col int")
    for usr in "ABC":
        keys = spark.createDataFrame([(usr,)], "from_usr string")
        assert {r.usr for r in xref.virtuals(keys, s, usrs, targets).collect()} == set("ABC")


def test_names():
    assert names.split_scope("a::b<c::d>::e(f::g)") == ["a", "b<c::d>", "e(f::g)"]
    assert set(names.permutations("n::C<T>::f(int)")) == {"n::C<T>::f(int)", "n::C<T>::f", "n::C::f(int)", "n::C::f", "C<T>::f(int)", "C<T>::f", "C::f(int)", "C::f", "f(int)", "f"}


def test_command_line(spark, tmp_path):
    assert commandline.split_command('g++ -DA="b c" x.c') == ["g++", "-DA=b c", "x.c"] and commandline.split_command("g++ 'x") == ["g++", "'x"]
    (row,) = commandline.parse("clang++ -std=c++17 -DX -DY=2 -isystem /s -Iinc -o out.o -c main.cc", "/d")
    assert row["path"] == "/d/main.cc" and row["output"] == "/d/out.o" and row["standard"] == "c++17" and row["language"] == "c++"
    assert row["defines"] == [{"name": "X", "value": None}, {"name": "Y", "value": "2"}]
    assert row["includes"] == [{"type": "-isystem", "path": "/s"}, {"type": "-I", "path": "/d/inc"}]
    (tmp_path / "compile_commands.json").write_text('[{"directory": "/d", "file": "m.c", "command": "cc -O2 -c m.c"}, {"directory": "/d", "file": "m.c", "arguments": ["cc", "-O3", "-c", "m.c"]}]')
    got = readers.sources_of(readers.compile_database(spark, str(tmp_path / "compile_commands.json")))
    assert sorted((r.path, r.build_index) for r in got.collect()) == [("/d/m.c", 0), ("/d/m.c", 1)]
    builds = got.selectExpr("0 as file_id", "build_index", "arguments", "defines")
    assert aggregates.distinct_builds(builds).count() == 1


def test_scan_and_lines(spark, tmp_path):
    for p in ("a/x.cpp", "a/y.txt", "b/lodestar-ignore", "b/c/z.cpp"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("one\ntwo")
    assert {r.name for r in readers.scan(spark, str(tmp_path), ["*.txt"]).collect()} == {"x.cpp"}
    texts = spark.createDataFrame([(1, "one\n\ntwo words")], "file_id int, text string")
    assert [(r.line, r.text) for r in readers.lines(texts).orderBy("line").collect()] == [(1, "one"), (2, ""), (3, "two words")]
    assert readers.overlay(texts, spark.createDataFrame([(1, "new")], "file_id int, text string")).first().text == "new"


def test_save_and_load(spark, code, tmp_path):
    readers.save({"includes": code["includes"], "usrs": code["usrs"]}, str(tmp_path))
    got = readers.load(spark, str(tmp_path), ["includes", "usrs"])
    assert got["usrs"].count() == code["usrs"].count()
    with pytest.raises(ValueError):
        code["usrs"].withColumn("odd", code["usrs"].line).write.mode("overwrite").parquet(f"{tmp_path}/usrs")
        readers.load(spark, str(tmp_path), ["usrs"])


def test_text(spark):
    df = spark.createDataFrame([('a"\\<&~ /',)], "s string")
    got = df.select(text.quote_lisp(df.s), text.escape_xml(df.s), text.encode_path(df.s), text.restore(text.relocate(df.s, "a"), "a")).first()
    assert got[0] == '"a\\"\\\\<&~ /"' and got[1] == "a&quot;\\&lt;&amp;~ /" and got[2] == "a%22%5C%3C%26~+%2F" and got[3] == 'a"\\<&~ /'
    d = spark.createDataFrame([("/r/a/b",), ("/r/ac",)], "path string")
    assert names.shared_root(d).first().root == "/r"


def test_graph_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 9)], "src int, dst int")
    seed = spark.createDataFrame([(1,), (4,), (9,)], "seed int")
    got = sorted((r.seed, r.node, r.depth) for r in graph.closure(e, seed).collect())
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (4, 4, 0), (9, 9, 0)]
    one = lambda n: spark.createDataFrame([(n,)], "n int")
    assert [r.path for r in graph.simple_paths(e, one(1), one(4), 8).collect()] == [[1, 2, 3, 4]]
    both = spark.createDataFrame([(3,), (4,)], "n int")
    assert sorted((r.end, r.path) for r in graph.simple_paths(e, one(1), both, 8).collect()) == [(3, [1, 2, 3]), (4, [1, 2, 3, 4])]
    near = {r.node: (r.depth, r.seed) for r in graph.nearest(e, spark.createDataFrame([(1,), (2,)], "n int")).collect()}
    assert near == {1: (0, 1), 2: (0, 2), 3: (1, 2), 4: (2, 2)}
    inc = e.toDF("src_file", "dst_file")
    files = lambda *n: spark.createDataFrame([(i,) for i in n], "file_id int")
    assert {(r.header, r.source, r.depth) for r in graph.header_source(inc, files(1, 4, 9), files(1, 3)).collect()} == {(1, 3, 1), (4, 3, 1)}
    on = spark.createDataFrame([(i, False) for i in (1, 2, 3, 4, 9)], "file_id int, is_system boolean")
    assert {r.file_id for r in graph.reaches_buffer(inc, files(1, 2, 4, 9), files(4, 9, 1), on).collect()} == {1, 2}
    assert graph.simple_paths(e, one(1), one(4), 3).count() == 0
    h = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c")], "usr string, base string")
    assert graph.hierarchy(h, "a").count() == 3


def test_rank(spark):
    df = spark.createDataFrame([("p", "ab"), ("p", "abc"), ("q", "abc")], "k string, s string")
    assert sorted((r.k, r.s) for r in rank.drop_shadowed(df, ["k"], "s").collect()) == [("p", "ab"), ("q", "abc")]
    c = spark.createDataFrame([("getter", 2), ("get", 9), ("xgxext", 1), ("none", 0)], "name string, priority int")
    assert [r.name for r in rank.completions(c, "get").collect()] == ["getter", "get", "xgxext"]
    p = spark.createDataFrame([(1, 2, False), (2, 2, True), (3, 1, False), (4, 0, True)], "project_id int, match int, is_current boolean")
    assert [r.project_id for r in rank.project_choice(p).collect()] == [2] and rank.project_choice(p, multi=True).count() == 3


def test_pseudo_usr(spark, code):
    keys = spark.createDataFrame([("/w/src/b.cpp:5:3",), ("c:@F@main",)], "usr string")
    assert places(xref.find_by_usr(keys, code["usrs"], code["symbols"], code["files"])) == [(2, 4, 5), (2, 5, 3)]


def test_staleness(spark, code):
    changed = spark.createDataFrame([(0,)], "file_id int")
    assert {r.file_id for r in incremental.simple_dirty(code["includes"], changed).collect()} == {0, 1, 2}
    src = spark.createDataFrame([(1,), (2,)], "file_id int")
    assert {r.file_id for r in incremental.modified_dirty(code["includes"], code["files"], src).collect()} == {2}
    lost = code["includes"].union(spark.createDataFrame([(1, 77)], "a int, b int"))
    assert {r.file_id for r in incremental.modified_dirty(lost, code["files"], src).collect()} == {1, 2}


def test_stream_applies_deltas_once(spark, tmp_path):
    schema = "seq bigint, file_id int, message string"
    for i, rows in enumerate(([(1, 7, "old"), (2, 7, "new"), (3, 8, "x")], [(4, 8, "y"), (4, 8, "z")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in{i}")
    table = incremental.Versioned(spark, f"{tmp_path}/table", "file_id int, message string")
    for i in range(2):
        (tmp_path / "feed").mkdir(exist_ok=True)
        for f in (tmp_path / f"in{i}").glob("part-*.json"):
            f.rename(tmp_path / "feed" / f"{i}-{f.name}")
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/feed")
        incremental.apply_deltas(stream, table, ["file_id"], f"{tmp_path}/cp").awaitTermination(120)
    assert sorted((r.file_id, r.message) for r in table.current().collect()) == [(7, "new"), (8, "y"), (8, "z")]
    folders = table._folders()
    more = spark.createDataFrame([(9, "new key")], "file_id int, message string")
    bucket = table.touched(more, ["file_id"])
    table.write(table.current(bucket).union(more), 99, ["file_id"], bucket)
    assert {b: f for b, f in table._folders().items() if b not in bucket} == {b: f for b, f in folders.items() if b not in bucket}  # other buckets stay as they are
    assert table.current().count() == 4 and table.done(99)
    table.write(table.current(bucket).limit(0), 100, ["file_id"], bucket)
    assert set(table._folders()) == set(folders) - set(bucket)
    seen = []
    stream = spark.readStream.schema(schema).json(f"{tmp_path}/feed").selectExpr("file_id", "if(file_id = 7, 'error', 'note') as severity", "message")
    incremental.subscribe(stream, ["error"], lambda df, n: seen.extend(r.message for r in df.collect()), f"{tmp_path}/cp2").awaitTermination(120)
    assert sorted(seen) == ["new", "old"]


def test_workspace(spark, code):
    projects = spark.createDataFrame([(1, "/a/one", "db", False, 5), (2, "/a/two", None, True, 6), (3, "/b", "db", False, 7)], workspace.STATE["projects"])
    assert [r.text for r in workspace.listed_projects(projects).orderBy("index").collect()] == ["0: /a/one", "1: /b", "2: /a/two <="]
    assert workspace.select_project(projects, "/a")[1] == "Multiple matches for /a\n/a/one\n/a/two"
    assert workspace.select_project(projects, "zzz")[1] == "No matches for zzz" and workspace.select_project(projects, "/a/two")[1] == "/a/two is already the active project"
    chosen, said = workspace.select_project(projects, "1")
    assert said == "Selected project: /b for 1" and [r.project_id for r in chosen.where("is_current").collect()] == [3]
    gone = workspace.matching_projects(projects, "/a")
    assert {r.project_id for r in workspace.delete_projects(projects, "/a").collect()} == {3} and workspace.delete_projects(projects).count() == 0
    assert workspace.drop_facts({"x": projects, "f": code["files"]}, gone)["x"].count() == 1
    buffers = spark.createDataFrame([(0, "open"), (1, "active")], workspace.STATE["buffers"])
    added = workspace.set_buffers(buffers, spark.createDataFrame([(1, "open"), (2, "active")], workspace.STATE["buffers"]), "add")
    assert {(r.file_id, r.state) for r in added.collect()} == {(0, "open"), (1, "open"), (2, "active")}
    assert workspace.buffers_message(buffers, added) == "Added 1 buffers" and workspace.buffers_message(added, buffers) == "Removed 1 buffers" and workspace.buffers_message(added, added) == "We still have 3 buffers"
    assert incremental.active_only(code["symbols"], buffers.limit(0)).count() == code["symbols"].count()
    one = spark.createDataFrame([(1, 0)], workspace.STATE["suspended"])
    assert workspace.suspend(one, one, "off").count() == 0 == workspace.suspend(one, one, "toggle").count() and workspace.suspend(one, one, "on").count() == 1
    assert workspace.reindex_message(workspace.reindex(code["files"], "b.cpp")) == "Dirtied 1 files" and workspace.reindex_message(workspace.reindex(code["files"], "zzz")) == "No matches"
    assert {r.file_id for r in workspace.check_reindex(code["includes"], code["files"]).collect()} == {2}
    jobs = spark.createDataFrame([(1, 1, 0, "done", 3)], workspace.STATE["jobs"])
    assert workspace.is_indexing(jobs).first()[0] == 0 == workspace.is_indexing(jobs.limit(0)).first()[0]


def test_counts_and_debugging(code):
    jobs = workspace.JobCount(8)
    assert [jobs.command(q) for q in ("", "push:4", "2", "pop", "pop", "0x", "513", "default")] == [
        "Running with 8 jobs", "Changed jobs to 4", "Changed jobs to 2", "Changed jobs to 8", "Job count stack is empty", "Invalid job count 0x", "Invalid job count 513", "Changed jobs to 8",
    ]
    debug = workspace.DebugLocations()
    assert debug.command() == "No debug locations" and debug.selected(code["files"], "path").count() == 0
    assert debug.command("/w/src") == "Debug locations:\n/w/src" and debug.selected(code["files"], "path").count() == 2
    assert debug.command("all") == "Debug locations:\nall" and debug.selected(code["files"], "path").count() == 4 and debug.command("clear") == "No debug locations"


def test_tools_are_bounded(code):
    t = tools(code)
    assert sorted(t) == ["class_hierarchy", "code_complete", "diagnose", "find_symbols", "follow_location", "list_symbols", "references", "references_by_name", "symbol_info"]
    assert t["list_symbols"]("", most=2).count() == 2 and t["list_symbols"]("").count() > 2
    assert places(t["follow_location"](2, 5, 10)) == [(1, 3, 6)] and t["symbol_info"](2, 5, 4).count() == 1


def test_forms(spark):
    d = spark.createDataFrame([("/a", [(1, 2, -1, "error", 'x "y"')]), ("/b", [])], "path string, items array<struct<line: int, col: int, length: int, severity: string, message: string>>")
    assert [r.lisp for r in report.diagnostics_lisp(d).collect()] == ['(cons "/a" (list (list nil 1 2 nil \'error "x \\"y\\"" nil)))', '(cons "/b" nil)']
    line = spark.createDataFrame([("  ~Foo_1();", 3), ("ab", 2)], "s string, c int")
    assert [r[0] for r in line.select(report.coloured(line.s, line.c)).collect()] == ["  \x1b[32;1m~Foo_1\x1b[0;0m();", "ab"]
    assert [r.text for r in report.fitted_table(spark.createDataFrame([("a", 1), ("abc", 2)], "k string, v int"), "k", "v").collect()] == ["a   1", "abc 2"]
