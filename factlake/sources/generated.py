"""C# sources, projects and solutions made from the rows of ``part``, to query code at any scale factor.

Each part is a class that derives from the part of half its key, in the namespace of its brand; every
brand has a class ``Label``. Parts of size 10 and less have a second file with other constructs, some
of them with a bracket missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rows(part: DataFrame) -> DataFrame:
    """``(k, s, b, hb, h, name, kind)``: key, size, brand and the base's brand; parts 0 and 1 have no base."""
    rows = part.select(
        F.col("p_partkey").alias("k"), F.col("p_size").alias("s"), F.replace("p_brand", F.lit("#"), F.lit("")).alias("b"),
        F.when(F.col("p_partkey") > 1, F.expr("p_partkey div 2")).alias("h"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"),
    )
    return rows.join(rows.select(F.col("k").alias("h"), F.col("b").alias("hb")), "h", "left")


def _lines(*parts: Column | str) -> Column:
    """Lines joined by line breaks; null ones are left out."""
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _text(pattern: str, *columns: str) -> Column:
    return F.format_string(pattern, *(F.col(c) for c in columns))


def part_source() -> Column:
    """The class of one row of ``_rows``."""
    based = F.col("h").isNotNull()
    tests = F.when(F.col("s") % 4 > 0, F.array_join(F.array_repeat(F.lit("            if (n == 0) { n++; }"), F.col("s") % 4), "\n"))
    return _lines(
        "using System;",
        F.when(based, _text("using Shop.%s;", "hb")),
        F.when(F.col("s") % 2 == 0, "using Shop.Spare;"),
        _text("namespace Shop.%s", "b"),
        "{",
        _text("    /// <summary> %s </summary>", "name"),
        _text('    /// <param name="n">%s</param>', "kind"),
        F.when(based, _text("    public class Part%d : Part%d, IPriced", "k", "h")).otherwise(_text("    public class Part%d : IPriced", "k")),
        "    {",
        _text("        private int _stock = %d, _spare;", "s"),
        "        public int Stock { get; set; }",
        F.when(based, "        public override int Total(int n)").otherwise("        public virtual int Total(int n)"),
        "        {",
        _text("            int left = %d;", "s"),
        tests,
        "            return Next(n) + Label.Text(n);",
        "        }",
        "        public int Next(int n)",
        "        {",
        F.when(based, _text("            Part%1$d other = new Part%1$d();", "h")),
        F.when(based, _text("            return other.Total(n + %d);", "s")).otherwise(_text("            return n + %d;", "s")),
        "        }",
        "        public int Next(int n, int m) { return n * m; }",
        "    }",
        "}",
    )


def small_source() -> Column:
    """A file of other constructs for one row of ``_rows``; those of keys divisible by three lack a bracket."""
    return _lines(
        _text("using X = Shop.%s.Part%d;", "b", "k"),
        "namespace Mini",
        "{",
        _text('    [Old("m%d", Level = %d)]', "k", "s"),
        _text("    public class Mini%d", "k"),
        "    {",
        "        public event Action Done;",
        _text("        public const int Most = %d;", "s"),
        "        Task Run(List<int> items, int? none)",
        "        {",
        _text("            // note %d", "k"),
        "            X made = null;",
        _text("            foreach (var item in items) { Go%d(item, 1); }", "k"),
        "            while (true) { break; }",
        "            int a, b = 2;",
        "            a = b;",
        "            try { Use(a); } catch (Exception e) { throw; }",
        '            string text = "t";',
        "            double half = 0.5;",
        "            return null;",
        "        }",
        "    }",
        F.when(F.col("k") % 3 != 0, "}"),
    )


_LABEL = """namespace Shop.%s
{
    public static class Label
    {
        public static int Text(int n) { return n; }
        public static int Twice(this int x) => x * 2;
    }
}"""
_PRICED = "namespace Shop\n{\n    public interface IPriced { int Total(int n); int Stock { get; set; } }\n}"
_SPARE = "namespace Shop.Spare\n{\n    public class Spare { }\n}"


def sources(part: DataFrame) -> DataFrame:
    """``(doc_id, project, path, content, n_lines, size)`` of all files; ids begin with P, M, L, I or S."""
    rows = _rows(part)
    key = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    out = rows.select(key("P", "k").alias("doc_id"), F.col("b").alias("project"), part_source().alias("content"))
    small = rows.filter("s <= 10").select(key("M", "k").alias("doc_id"), F.lit("Mini").alias("project"), small_source().alias("content"))
    labels = rows.select("b").distinct().select(key("L", "b").alias("doc_id"), F.col("b").alias("project"), F.format_string(_LABEL, "b").alias("content"))
    fixed = part.sparkSession.createDataFrame([("I", "Shop", _PRICED), ("S", "Spare", _SPARE)], "doc_id string, project string, content string")
    out = out.unionByName(small).unionByName(labels).unionByName(fixed)
    path = F.concat(F.lit("/src/"), "project", F.lit("/"), "doc_id", F.lit(".cs"))
    return out.select("doc_id", "project", path.alias("path"), "content", F.size(F.split("content", "\n")).alias("n_lines"), F.octet_length("content").cast("long").alias("size"))


def chain_source() -> Column:
    """A class of one row of ``_rows`` that reaches the class of half its key, and those above, through chains.

    Its method ``Walk`` climbs 1 + k % 6 steps, or as many as there are, by methods and fields in turn.
    """
    based = F.col("h").isNotNull()
    steps = F.least(F.col("k") % 6 + 1, F.length(F.bin("k")) - 1)
    step = lambda i: F.when(i % 2 == 1, F.concat(F.lit(".Climb("), i.cast("string"), F.lit(")"))).otherwise(".Up")
    climb = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(steps, F.lit(1)).cast("int")), step), "")
    own = _lines(
        _text("        public Node%d Up;", "h"),
        _text("        public Node%d Climb(int n) { return Up; }", "h"),
        _text("        public List<Node%d> Kids;", "h"),
        _text("        public Task<Node%d> Load() { return null; }", "h"),
        _text("        public Node%d this[int i] { get { return Up; } }", "h"),
        _text("        public void Each(Action<Node%d> act, int n) { }", "h"),
        "        public async Task<int> Walk(object o)",
        "        {",
        F.concat(F.lit("            var end = this"), climb, F.lit(";")),
        "            var first = Kids[0];",
        '            first.Rank("a");',
        "            foreach (var kid in Kids) { kid.Rank(1); }",
        "            await foreach (var late in Later()) { if (late == null) { continue; } }",
        '            Each(x => x.Rank(end.Rank("s")), 2);',
        "            var next = await Load();",
        _text("            next.Rank(((Node%d)o).Rank(3));", "h"),
        "            int Twice(int t) { return t * 2; }",
        "            this[0].Rank(Twice(4));",
        "            return end.Rank(5);",
        "        }",
    )
    return _lines(
        "using System;",
        "namespace Chain",
        "{",
        _text("    public class Node%d", "k"),
        "    {",
        F.when(based, own),
        "        public int Rank(int n) { return n; }",
        "        public string Rank(string s) { return s; }",
        "        public (int low, int high) Span(int n) { return Both(n); }",
        "    }",
        "}",
    )


def chain_sources(part: DataFrame) -> DataFrame:
    """``(doc_id, project, path, content)`` of a file for each part; ids begin with N."""
    rows = _rows(part).select(F.concat(F.lit("N"), F.col("k").cast("string")).alias("doc_id"), F.lit("Chain").alias("project"), chain_source().alias("content"))
    return rows.select("doc_id", "project", F.concat(F.lit("/src/Chain/"), "doc_id", F.lit(".cs")).alias("path"), "content")


def flow_sources(part: DataFrame) -> DataFrame:
    """``(doc_id, content)`` of a method with branches, loops and a statement out of reach for each part; ids begin with F."""
    rows = part.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    tests = F.when(F.col("s") % 4 > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.col("s") % 4, F.lit(1))), lambda i: F.concat(F.lit("        if (a == "), i.cast("string"), F.lit(") { total += b; }"))), "\n"))
    odd = F.col("k") % 2 == 1
    text = _lines(
        _text("class F%d", "k"),
        "{",
        "    int Run(int a, int b)",
        "    {",
        "        int total = 0;",
        tests,
        _text("        while (a > b) { a--; if (a == %d) { continue; } total = a; }", "s"),
        F.when(odd, F.lit("        return total;")).otherwise("        do { b++; } while (b < a);\n        return b;"),
        "        Go(total);",
        "    }",
        "}",
        "",
    )
    return rows.select(F.concat(F.lit("F"), F.col("k").cast("string")).alias("doc_id"), text.alias("content"))


def project_files(part: DataFrame) -> DataFrame:
    """``(path, text)`` of a project file for each part: it refers to that of half its key."""
    rows = _rows(part)
    text = _lines(
        '<Project Sdk="Web">',
        "  <PropertyGroup>",
        F.when(F.col("s") % 3 == 0, "    <TargetFramework>net8.0</TargetFramework>").when(F.col("s") % 3 == 1, "    <TargetFrameworks>net9.0;net8.0</TargetFrameworks>"),
        F.when(F.col("s") > 40, "    <OutputType>Exe</OutputType>"),
        "  </PropertyGroup>",
        "  <ItemGroup>",
        F.when(F.col("h").isNotNull(), _text('    <ProjectReference Include="..\\Part%1$d\\Part%1$d.csproj" />', "h")),
        _text('    <PackageReference Include="Log" Version="%d.0" />', "s"),
        F.when(F.col("s") % 2 == 0, '    <PackageReference Include="Json" Version="2.1" />'),
        "  </ItemGroup>",
        "</Project>",
    )
    return rows.select(F.format_string("/src/Part%1$d/Part%1$d.csproj", "k").alias("path"), text.alias("text"))


def solution_files(part: DataFrame) -> DataFrame:
    """``(path, text)`` of a solution for each brand, in the old format, and one of the new format for all of size 50."""
    rows = _rows(part).select("b", "k", "s")
    old = F.format_string('Project("{X}") = "Part%1$d", "Part%1$d\\Part%1$d.csproj", "{Y}"%nEndProject', "k")
    listed = rows.groupBy("b").agg(F.array_join(F.sort_array(F.collect_list(old)), "\n").alias("text"))
    new = F.format_string('  <Project Path="Part%1$d/Part%1$d.csproj" />', "k")
    slnx = rows.filter("s = 50").agg(F.array_join(F.sort_array(F.collect_list(new)), "\n").alias("text"))
    slnx = slnx.select(F.lit("/src/All.slnx").alias("path"), F.concat(F.lit("<Solution>\n"), "text", F.lit("\n</Solution>")).alias("text"))
    return listed.select(F.concat(F.lit("/src/"), "b", F.lit(".sln")).alias("path"), "text").unionByName(slnx)
