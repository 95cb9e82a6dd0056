from __future__ import annotations

import pandas as pd
import pytest
from code_samples import EDGE, HELPER, SHAPES
from pyspark.sql import functions as F

from factlake import tools
from factlake.operators import rewrites
from factlake.plans import facts as plans
from factlake.sources import csharp, projects


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("s", "Shop", "/p/Shapes.cs", SHAPES), ("h", "Lib", "/q/helper.cs", HELPER)]
    frame = spark.createDataFrame(rows, "doc_id string, project string, path string, content string")
    return frame.withColumn("n_lines", F.size(F.split("content", "\n"))).withColumn("size", F.length("content").cast("long"))


@pytest.fixture(scope="module")
def facts(docs):
    return plans.build(docs, csharp.syntax_nodes(docs))


def _kinds(source):
    return [n.kind for n in csharp.parse(source)]


def test_counts_of_inline_sources():
    one = _kinds("using System; namespace TestNamespace { class TestClass { void TestMethod() { var x = 42; } } }")
    assert [one.count(k) for k in ("UsingDirective", "NamespaceDeclaration", "ClassDeclaration", "MethodDeclaration", "CompilationUnit")] == [1] * 5
    two = csharp.parse("namespace N { class TestClass { void Method1() {} void Method2() {} } class AnotherClass { void Method3() {} } }")
    types = [n for n in two if n.kind == "ClassDeclaration"]
    assert [t.ident for t in types] == ["TestClass", "AnotherClass"]
    assert [sum(m.parent == t.number for m in two) for t in types] == [2, 1]
    assert _kinds("class C { void M() { if (a && b) {} for (;;) {} var x = c ? 1 : 2; } }").count("ConditionalExpression") == 1
    assert _kinds("var x = 1;\nint? y = null;").count("ConditionalExpression") == 0


@pytest.mark.parametrize("source", EDGE)
def test_odd_sources_parse(source):
    nodes = csharp.parse(source)
    assert nodes[0].kind == "CompilationUnit" and all(n.parent < n.number and n.start <= n.end for n in nodes)


def test_nodes_have_their_places(docs):
    rows = csharp.syntax_nodes(docs).collect()
    for r in rows:
        content = (SHAPES if r["doc_id"] == "s" else HELPER.removeprefix("﻿")).split("\n")
        assert sum(len(x) + 1 for x in content[: r["line"]]) + r["column"] == r["start"]
    assert csharp.syntax_nodes(docs.limit(0)).count() == 0


def test_a_batch_of_documents_is_handed_on_in_parts():
    batch = pd.DataFrame({"doc_id": [f"d{i}" for i in range(900)], "content": [SHAPES, None, HELPER] * 300})
    frames = list(csharp.node_frames(iter([batch, batch[:0]])))
    one = len(csharp.parse(SHAPES))
    assert sum(map(len, frames)) == 300 * (one + len(csharp.parse(HELPER.removeprefix("\ufeff")))) > 2 * csharp.FRAME_ROWS
    assert all(0 < len(x) < csharp.FRAME_ROWS + one for x in frames)
    assert [d for x in frames for d in x["doc_id"].unique()] == [f"d{i}" for i in range(900) if i % 3 != 1]


def test_types_and_members(facts):
    t = {r["name"]: r for r in facts.types.collect()}
    assert {n: (r["kind"], r["namespace"]) for n, r in t.items()} == {
        "IShape": ("interface", "Shop.Core"), "Base": ("class", "Shop.Core"), "Circle": ("class", "Shop.Core"),
        "Inner": ("class", "Shop.Core"), "Helper": ("class", "Lib.Used"),
    }
    assert t["Base"]["is_abstract"] and t["Helper"]["is_static"] and t["Inner"]["accessibility"] == "private"
    m = {(r["type_name"], r["name"]): r for r in facts.members.collect()}
    assert m["Base", "Draw"]["n_params"] == 2 and m["Circle", "Area"]["is_override"] and m["Helper", "Twice"]["is_extension"]
    assert m["IShape", "Area"]["accessibility"] == "public" and m["Circle", "_r"]["kind"] == "field"


def test_complexity_counts_branches(facts):
    got = {(r["type_name"], r["name"]): r["complexity"] for r in plans.metrics_of(facts).collect()}
    assert got["Circle", "Area"] == 4 and got["Circle", "R"] == 3 and got["Circle", "Scale"] == 1 and got["Inner", "Deep"] == 2
    top = tools.get_code_metrics(facts).filter("namespace is null").collect()
    assert {r["doc_id"] for r in top} == {"s", "h"} and all(0 <= r["maintainability"] <= 100 for r in top)


def test_hierarchies(facts):
    name = {r["type_id"]: r["name"] for r in facts.types.collect()}
    rows = {(name[r["type_id"]], r["other_name"], r["relation"]) for r in tools.get_type_hierarchy(facts).collect()}
    assert {("Circle", "Base", "base"), ("Base", "Circle", "derived"), ("Circle", "IShape", "interface"), ("Base", "IShape", "interface")} <= rows
    m = {r["member_id"]: (r["type_name"], r["name"]) for r in facts.members.collect()}
    up = {(m[r["member_id"]], m[r["other"]], r["relation"]) for r in tools.get_member_hierarchy(facts).collect()}
    assert (("Circle", "Area"), ("Base", "Area"), "override") in up and (("Circle", "Area"), ("IShape", "Area"), "interface") in up
    depth = {name[r["type_id"]]: r["inheritance_depth"] for r in tools.inheritance_depth(facts).collect()}
    assert depth["Circle"] == 2 and depth["Base"] == 1
    assert {r["name"] for r in tools.generate_overrides(facts, "Circle").collect()} == {"Area", "Draw"}


def test_calls(facts):
    m = {r["member_id"]: r["name"] for r in facts.members.collect()}
    found = sorted((m[r["caller_id"]], m.get(r["callee_id"])) for r in facts.calls.collect())
    assert found == [("Area", "Log"), ("Area", "Scale"), ("Area", "Scale"), ("Log", "Scale"), ("Scale", "Log")]
    of = lambda name: tools.members_named(facts, name)
    assert {m[r["caller_id"]] for r in tools.get_caller_info(facts, of("Log"), indirect=True).collect()} == {"Area", "Log", "Scale"}
    assert {(m[r["caller_id"]], r["context"]) for r in tools.get_caller_info(facts, of("Scale")).collect()} >= {("Log", "double Log(object x) { return Scale(1); }")}
    assert {m[r["callee"]] for r in tools.get_callee_info(facts, of("Log")).collect()} == {"Scale"}
    nodes, sites, dot = tools.get_call_graph(facts, of("Scale"), 10)
    assert {m[r["node"]]: r["fan_in_sites"] for r in nodes.collect()} == {"Scale": 1, "Log": 1} and sites.count() == 2
    lines = [r["line"] for r in dot.orderBy("place", "line").collect()]
    assert lines == ["digraph CallGraph {", '  "Circle.Log" -> "Circle.Scale";', '  "Circle.Scale" -> "Circle.Log";', "}"]


def test_points_and_references(spark, facts):
    line = next(i for i, x in enumerate(SHAPES.split("\n")) if "Scale(_r)" in x)
    column = SHAPES.split("\n")[line].index("Scale") + 2
    points = spark.createDataFrame([("s", line, column), ("s", 999, 0)], "doc_id string, line int, column int")
    found = tools.go_to_definition(facts, points).collect()
    assert [(r["name"], r["kind"]) for r in found] == [("Scale", "method")]
    uses = tools.find_references(facts, points).collect()
    assert sum(r["is_definition"] for r in uses) == 1 and sum(not r["is_definition"] for r in uses) == 3
    assert all("Scale" in r["context"] for r in uses)
    scope = {r["name"] for r in tools.get_semantic_model(facts, points).collect()}
    assert {"Area", "_r", "R", "IShape", "Base"} <= scope
    assert [r["name"] for r in tools.get_completion_list(facts, points, "Sc").collect()] == ["Scale"]
    at = spark.createDataFrame([("s", 8, 22)], "doc_id string, line int, column int")
    info = [r for r in tools.get_symbol_info(facts, at.withColumn("line", F.lit(next(i for i, x in enumerate(SHAPES.split("\n")) if "interface IShape" in x)))).collect() if r["kind"] == "interface"]
    assert info[0]["documentation"]["summary"] == "A shape." and [tuple(p) for p in info[0]["documentation"]["params"]] == [("a", "x")]
    assert tools.find_declarations(facts, points).count() == 1
    assert tools.one_based(tools.go_to_definition(facts, points)).collect()[0]["line"] == line + 1


def test_imports(facts):
    assert [r["name"] for r in tools.remove_unused_usings(facts).collect()] == []
    got = tools.sort_usings(facts, "alphabetical").filter("doc_id = 's'").collect()[0]["content"].split("\n")[:4]
    assert got == ["using Lib.Unused;", "using Lib.Used;", "using System;", "using System.Text;"]
    assert {r["namespace"] for r in tools.add_missing_imports(facts, {"Scale": "X.Y"}).collect()} == set()
    kept = tools.organize_imports(facts).filter("doc_id = 's'").collect()[0]["content"].split("\n")[:5]
    assert kept == ["using System;", "using System.Text;", "", "using Lib.Unused;", "using Lib.Used;"]
    assert tools.extension_methods(facts).filter("doc_id = 's'").collect()[0]["name"] == "Twice"


def test_trees_actions_and_lists(spark, docs, facts):
    tree = tools.get_syntax_tree(facts, "h", max_depth=2).collect()
    assert max(r["depth"] for r in tree) == 2 and {"Identifier": "Helper", "Modifiers": "public static"} in [r["properties"] for r in tree]
    assert tools.get_syntax_tree(facts, "s", (0, 5)).count() == 2
    assert [r["name"] for r in tools.get_refactorings(facts, "h", (40, 60)).collect()].count("extract_interface") == 1
    assert tools.list_refactorers(spark).count() == 14
    assert tools.get_code_actions(spark, ["Convert"]).count() == 4
    assert [r["path"] for r in tools.get_document_list(docs, "*.CS").collect()].__len__() == 2
    assert tools.get_document_list(docs, "Sh?pes.cs").count() == 1
    assert tools.analyze_code(facts).filter("doc_id = 's'").collect()[0]["types"] == 4
    assert tools.hierarchy(facts).count() == 2


def test_generated_code(spark, facts):
    assert [r["code"] for r in tools.generate_interface_impl(facts, "IShape").collect()] == ["public double Area() => throw new NotImplementedException();"]
    code = tools.generate_constructor(spark, "A", [("int", "Size"), ("string", "name")], ["size"]).collect()[0]["code"]
    assert code == "public A(int size, string name) : base(size)\n{\n    _size = size;\n    _name = name;\n}"
    assert tools.generate_property(spark, "int", "Size", backing=True).startswith("private int _size;")
    shapes = [tools.generate_property(spark, "int", "A", **f) for f in ({}, {"read_only": True}, {"setter": False}, {"getter": False})]
    assert [x.split("{")[1] for x in shapes] == [" get; set; }", " get; }", " get; private set; }", " set; }"]
    assert "out int a" in tools.generate_deconstructor(spark, [("int", "A")])
    assert tools.generate_declaration("field", "x") == "private object _x;" and tools.generate_declaration("class", "A").startswith("public class A")
    with pytest.raises(ValueError):
        tools.generate_declaration("event", "x")


def _rewritten(source, rule, mark, **more):
    f = rewrites.File(source)
    out = source
    for e in sorted(rewrites.CATALOG[rule].run(f, source.index(mark), **more), key=lambda e: -e.start):
        out = out[: e.start] + e.new_text + out[e.start + e.length :]
    return out


def test_rewrites():
    s = "class A\n{\n    int Add(int a)\n    {\n        var q = 5;\n        return q + Add(a);\n    }\n}\n"
    assert "int Sum(int a)" in _rewritten(s, "rename_symbol", "Add", new_name="Sum") and "Sum(a)" in _rewritten(s, "rename_symbol", "Add", new_name="Sum")
    assert "return 5 + Add(a);" in _rewritten(s, "inline_temporary", "var q")
    assert "int Add(int a, int b)" in (x := _rewritten(s, "add_parameter", "Add", type_name="int", name="b")) and "Add(a, 0)" in x
    assert "class A : IA" in _rewritten(s.replace("int Add", "public int Add"), "extract_interface", "class")
    out = _rewritten(s, "extract_method", "var q", length=10, name="Make")
    assert "int q = Make();" in out and "private int Make()" in out
    with pytest.raises(rewrites.CannotRewrite):  # a type that the text doesn't show
        _rewritten(s.replace("= 5", "= Add(1)"), "extract_method", "var q", length=15, name="Make")
    assert "x is T" in _rewritten("class A { void M() { if (x as T != null) { } } }", "safely_remove_as", "x as")
    assert "!(x is T)" in _rewritten("class A { void M() { if (x as T == null) { } } }", "safely_remove_as", "x as")
    with pytest.raises(rewrites.CannotRewrite):
        _rewritten("class A { void M() { for (int i = 1; i < n; i++) { } } }", "convert_for_to_foreach", "for (")
    with pytest.raises(rewrites.CannotRewrite):
        _rewritten(s, "rename_symbol", "Add", new_name="class")
    plain = "// Foo and Foobar\nclass Foo { }\n"
    assert _rewritten(plain, "rename_symbol", "Foo {", new_name="Bar", in_comments=True) == "// Bar and Barbar\nclass Bar { }\n"


def test_rewrites_that_need_a_form():
    two = "class A { int a, b; void M() { int p = 1, q = 2; Go(p, q); } }"
    for rule, mark in (("encapsulate_field", "int a"), ("inline_temporary", "int p"), ("convert_if_to_switch", "Go"), ("convert_foreach_to_for", "Go"), ("reverse_for_statement", "Go")):
        with pytest.raises(rewrites.CannotRewrite):
            _rewritten(two, rule, mark)
    names = {"a.Total()": "total", "Total()": "value", "1.5": "value", "2m": "amount", '"x"': "str", "new DateTime(1)": "date"}
    for value, name in names.items():
        mark = value if value[0] not in "an" else value.split(".")[-1].removeprefix("new ")
        assert f"var {name} = {value};" in _rewritten(f"class A {{ void M() {{ Go({value}); }} }}", "introduce_variable", mark)


def test_refactor_over_a_table(spark, docs):
    other = "class Other { void M() { Scale(2); } double Scale(double x) { return x; } }"
    more = docs.unionByName(docs.limit(1).select(F.lit("o").alias("doc_id"), F.lit("X").alias("project"), F.lit("/x.cs").alias("path"), F.lit(other).alias("content"), F.lit(1).alias("n_lines"), F.lit(1).cast("long").alias("size")))
    target = spark.createDataFrame([("s", SHAPES.index("Scale"), "Grow")], "doc_id string, offset int, new_name string")
    out = {r["doc_id"]: r["content"] for r in tools.refactor(more, "rename_symbol", target).collect()}
    assert "Grow(_r)" in out["s"] and "Scale" not in out["s"] and out["o"] == other and out["h"] == HELPER
    at = spark.createDataFrame([("s", 2, 0)], "doc_id string, line int, column int")
    rows = {r["doc_id"]: r for r in tools.preview(docs, rewrites.edits(docs, "convert_for_to_foreach", at)).collect()}
    assert rows["s"]["error"] and rows["s"]["edits"] == 0 and set(rows) == {"s"}
    with pytest.raises(ValueError):
        rewrites.edits(docs, "inline_temporary")


def _facts_of(spark, **files):
    rows = [(k, v) for k, v in files.items()]
    frame = spark.createDataFrame(rows, "doc_id string, content string").withColumn("n_lines", F.size(F.split("content", "\n")))
    return frame, plans.build(frame, csharp.syntax_nodes(frame))


def test_rename_follows_the_symbol_through_files(spark):
    base = "namespace A { public class Box { public Box() { } public virtual int Name() { return 1; } } }"
    child = "using A;\nnamespace B { class Crate : Box { public override int Name() { return base.Name(); } } }"
    far = "namespace C { class Box { int Name() { return Name(); } } } // Box"
    user = "using A;\nclass User { Box box = new Box(); int M(Box x) { return box.Name() + x.Name() + this.box.Name(); } } // Box"
    docs, f = _facts_of(spark, base=base, child=child, far=far, user=user)
    target = spark.createDataFrame([("base", base.index("Box"), "Chest")], "doc_id string, offset int, new_name string")
    out = {r["doc_id"]: r["content"] for r in rewrites.applied(docs, tools.rename(f, target, in_comments=True)).collect()}
    assert out["base"] == base.replace("Box", "Chest") and out["child"] == child.replace("Box", "Chest")
    assert out["far"] == far and out["user"] == user.replace("Box", "Chest").replace("Box", "Chest")
    target = spark.createDataFrame([("child", child.index("Name()"), "Title")], "doc_id string, offset int, new_name string")
    out = {r["doc_id"]: r["content"] for r in rewrites.applied(docs, tools.rename(f, target)).collect()}
    assert out["far"] == far and all("Name" not in out[x] for x in ("base", "child", "user"))


def test_names_are_bound_by_scope(spark):
    a = "namespace A { public class T { public int F(int x) { return x; } public int F(int x, int y) { return F(x); } } }"
    b = "namespace B { public class T { public int F(int x) { return x; } } }"
    user = """using B;
namespace A.Inner
{
    class User
    {
        T near;
        B.T far;
        int G(T t) { var made = new B.T(); return t.F(1, 2) + far.F(G(F2(1, 2), 3)) + made.F(3) + unknown.F(4); }
        int F2(int x, int y) { return 0; }
    }
}"""
    _, f = _facts_of(spark, a=a, b=b, user=user)
    name = {r["member_id"]: f"{r['namespace']}.{r['name']}/{r['n_params']}" for r in f.members.collect()}
    rows = [(r["callee_name"], name.get(r["callee_id"]), len(r["args"])) for r in f.calls.filter("doc_id = 'user'").collect()]
    assert sorted(rows, key=str) == sorted([("F", "A.F/2", 2), ("F", "B.F/1", 1), ("G", None, 2), ("F2", "A.Inner.F2/2", 2), ("F", "B.F/1", 1), ("F", None, 1)], key=str)
    assert [name.get(r["callee_id"]) for r in f.calls.filter("doc_id = 'a'").collect()] == ["A.F/1"]


def test_explicit_implementations(spark):
    text = "interface I { void M(); int P { get; } } interface J { void M(); } class C : I, J { void I.M() { } public void M() { } int I.P { get { return 1; } } }"
    _, f = _facts_of(spark, c=text)
    m = {r["member_id"]: r for r in f.members.collect()}
    rows = {(m[r["member_id"]]["start"], m[r["interface_member"]]["type_name"], m[r["interface_member"]]["name"], r["is_explicit"]) for r in tools.implementations(f).collect()}
    assert rows == {(text.index("void I.M"), "I", "M", True), (text.index("public void M"), "J", "M", False), (text.index("int I.P"), "I", "P", True)}


def test_declarators_holes_and_errors(spark):
    text = 'class C { int a, b = 2; void M() { int p = 1, q = F<int, string>(1, 2); var s = $"{H(a)} {{no}} {G(p):x}"; a.b = 3; y += x; foreach (var z in s) { } } string t = "open\n'
    docs, f = _facts_of(spark, c=text)
    assert sorted(r["name"] for r in f.members.filter("kind = 'field'").collect()) == ["a", "b", "t"]
    local = {r["name"]: r["type_text"] for r in f.locals.collect()}
    assert local == {"p": "int", "q": "int", "s": None, "z": None}
    detail = {r["ident"]: r["detail"] for r in f.nodes.filter("kind in ('LocalDeclarationStatement', 'LocalDeclarator')").collect()}
    assert detail["p"] == "1" and detail["q"] == "F<int, string>(1, 2)"
    assert {(r["callee_name"], tuple(r["args"])) for r in f.calls.collect()} == {("F", ("1", "2")), ("H", ("a",)), ("G", ("p",))}
    wrong = {r["id"]: (r["start_line"], r["start_column"]) for r in plans.diagnostics(f).filter("severity = 'Error'").collect()}
    assert wrong == {"CS1010": (0, text.index('"open')), "CS1513": (0, len(text) - 1)}
    assert [r["is_valid"] for r in tools.validated(docs).collect()] == [False]


def test_documentation_of_any_length(spark):
    lines = "\n".join(f"/// line {i}" for i in range(200))
    text = f"/// <summary>\n{lines}\n/// </summary>\n/// <remarks>r</remarks>\n/// <example>e</example>\n[Old]\n[New(1)]\nclass C {{ }}\n/// <summary>other</summary>\n\nclass D {{ }}"
    _, f = _facts_of(spark, c=text)
    rows = {r["symbol_id"]: r["documentation"] for r in tools.documentation(f).collect()}
    doc = next(iter(rows.values()))
    assert len(rows) == 1 and doc["summary"].startswith("line 0") and doc["summary"].endswith("line 199") and doc["remarks"] == "r" and doc["example"] == "e"


def test_changes_as_json(spark, docs):
    change = spark.createDataFrame([("h", '[{"start": 0, "length": 1, "newText": ""}]')], "doc_id string, changes string")
    out = {r["doc_id"]: r["content"] for r in tools.apply_code_change(docs, change, windows=True).collect()}
    assert out["h"] == HELPER[1:].replace("\n", "\r\n")


def test_solutions_and_projects(spark, tmp_path):
    (tmp_path / "A.sln").write_text('Project("{X}") = "App", "App\\App.csproj", "{1}"\nEndProject\nProject("{X}") = "Lib", "Lib\\Lib.csproj", "{2}"\n')
    (tmp_path / "B.slnx").write_text('<Solution><Project Path="Lib/Lib.csproj" /></Solution>')
    for name, body in (
        ("App", '<Project Sdk="S"><PropertyGroup><OutputType>Exe</OutputType><TargetFrameworks>net8.0;net9.0</TargetFrameworks></PropertyGroup><ItemGroup><PackageReference Include="P" Version="1.0"/><ProjectReference Include="..\\Lib\\Lib.csproj"/></ItemGroup></Project>'),
        ("Lib", "﻿<Project><PropertyGroup></PropertyGroup></Project>"),
    ):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.csproj").write_text(body)
        (tmp_path / name / "C.cs").write_text("class C {\n")
    (tmp_path / "Old.csproj").write_text('<Project xmlns="http://schemas"><PropertyGroup><TargetFrameworkVersion>v4.7.2</TargetFrameworkVersion></PropertyGroup></Project>')
    every = projects.texts(spark, f"{tmp_path}/*/*.csproj")
    solutions = projects.texts(spark, str(tmp_path / "A.sln"))
    assert sorted(r["project"] for r in projects.solution_projects(solutions).collect()) == ["App", "Lib"]
    assert [r["path"] for r in projects.solution_projects(projects.texts(spark, str(tmp_path / "B.slnx"))).collect()] == ["Lib/Lib.csproj"]
    assert sorted((r["project"], r["tfm"], r["output_type"]) for r in projects.projects(every).collect()) == [("App", "net8.0", "Exe"), ("Lib", "Unknown", "Library")]
    assert [r["tfm"] for r in projects.projects(projects.texts(spark, str(tmp_path / "Old.csproj"))).collect()] == ["net472"]
    assert [tuple(r) for r in projects.project_refs(every).collect()] == [("App", "Lib")]
    assert [tuple(r) for r in projects.package_refs(every).collect()] == [("App", "P", "1.0")]
    listed = tools.list_projects(solutions, every).collect()
    assert {r["project"]: r["n_packages"] for r in listed} == {"App": 1, "Lib": 0}
    info = tools.get_solution_info(projects.projects(every), projects.project_refs(every)).collect()
    assert {r["project"]: (r["level"], r["is_startup"]) for r in info} == {"Lib": (0, False), "App": (1, True)}
    (tmp_path / "App" / "Models").mkdir()
    (tmp_path / "App" / "Models" / "D.cs").write_text("class D { }")
    files = projects.documents(spark, str(tmp_path))
    owner = {r["path"].rsplit("/", 1)[1] + r["path"].split("/")[-2]: r["project"] for r in files.collect()}
    assert owner == {"C.csApp": "App", "C.csLib": "Lib", "D.csModels": "App"}
    wrong = plans.diagnostics(plans.build(files, csharp.syntax_nodes(files)))
    assert wrong.filter("id = 'CS1513'").count() == 2 and tools.get_diagnostics(wrong, "/z/c.CS").count() == wrong.count()
    seen = files.select("path", "mtime")
    assert projects.changed(files, seen).count() == 0 and projects.changed(files, seen.limit(1)).count() == 2


def test_path_guards(tmp_path):
    good = tmp_path / "a.cs"
    good.write_text("")
    assert projects.checked_path(str(good), "source", projects.Options(str(tmp_path))) == good.resolve()
    for bad, kind in ((None, "source"), (" ", "source"), ("../a.cs", "source"), (str(tmp_path / "CON.cs"), "source"), (str(good), "project"), (str(tmp_path / "b.cs"), "source"), ("/" + "x" * 300 + ".cs", "source")):
        with pytest.raises(projects.PathError):
            projects.checked_path(bad, kind)
    with pytest.raises(projects.PathError):
        projects.checked_path(str(good), "source", projects.Options(str(tmp_path / "sub")))


def test_smaller_lookups(spark, docs, facts):
    assert [r["name"] for r in tools.resolve_type(facts, "Shop.Core.Circle").collect()] == ["Circle"]
    assert [r["namespace"] for r in tools.resolve_type(facts, "Helper").collect()] == ["Lib.Used"]
    assert {(r["owner"], r["kind"]) for r in tools.name_conflicts(facts, "Area").collect()} == {("IShape", "method"), ("Base", "method"), ("Circle", "method")}
    spans = spark.createDataFrame([("s", 0, 10), ("s", 0, 10**6), ("s", SHAPES.index("double Scale"), SHAPES.index("return Scale(1)"))], "doc_id string, begin int, stop int")
    got = sorted((r["stop"], r["in_file"], r["crosses_methods"]) for r in tools.selection_problems(facts, spans).collect())
    assert [x[1:] for x in got] == [(True, False), (True, True), (False, True)]
    assert {r["type"] for r in tools.constants(facts).collect()} == {"string", "int"}
    assert tools.trivia(facts).filter("is_documentation").count() == 2
    assert "Inner" not in {r["name"] for r in tools.visible_members(facts).collect()}
    marked = spark.createDataFrame([("a", "class C { [Test(1, \"x\")] void M() { } }")], "doc_id string, content string").withColumn("n_lines", F.lit(1))
    found = tools.attributes(plans.build(marked, csharp.syntax_nodes(marked))).collect()
    assert [(r["name"], r["arguments"], r["named"]) for r in found] == [("Test", ["1", '"x"'], [])]
    both = spark.createDataFrame([("int", "int"), ("int", "long")], "a string, b string").select(tools.conversions(F.col("a"), F.col("b")).alias("c")).collect()
    assert [tuple(r["c"]) for r in both] == [(True, True, False), (False, False, True)]
