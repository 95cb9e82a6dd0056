"""Queries that run the parser, the relations and the tools over C# made from the rows of ``part``.

The SQL of each gives what the code must say by the way it was made; see
:mod:`factlake.sources.generated`. Relations of one folder are derived once a session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake import tools
from factlake.operators import metrics, rewrites
from factlake.plans import facts as plans
from factlake.plans import flow
from factlake.sources import csharp, generated
from factlake.sources import projects as source
from factlake.sources.tables import table
from factlake.storage import spread, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str, *ctes: str):
    """Register a query under its function's name, with its SQL below the common tables it names."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH RECURSIVE {', '.join(ctes)} {sql}" if ctes else sql
        return f

    return add


_KNOWN: dict[str, tuple[tuple, plans.Facts]] = {}


def _relations(spark: SparkSession, d: str, kind: str, make: Callable[[DataFrame], DataFrame]) -> plans.Facts:
    """Relations of sources made from ``part``, derived once for the same files of a session."""
    part = table(spark, d, "part")
    file = part.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = file.agg(F.count("*"), F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time"))).first()
    key = (spark.sparkContext.applicationId, d, *state)
    if kind not in _KNOWN or _KNOWN[kind][0] != key:
        docs = written(spread(make(part), "doc_id"), "sources")
        _KNOWN[kind] = (key, plans.build(docs, csharp.syntax_nodes(docs)))
    return _KNOWN[kind][1]


def facts_of(spark: SparkSession, d: str) -> plans.Facts:
    """The relations of the classes, interfaces and small files made from ``part``."""
    return _relations(spark, d, "shop", generated.sources)


def chains_of(spark: SparkSession, d: str) -> plans.Facts:
    """The relations of the classes whose methods call each other through chains."""
    return _relations(spark, d, "chain", generated.chain_sources)


# Rows of part as the sources see them: u lines of usings, q tests, e whether there is a base, a bases in all.
_P = """p AS (SELECT x.p_partkey AS k, x.p_size AS s, replace(x.p_brand, '#', '') AS b, y.p_partkey AS h, replace(y.p_brand, '#', '') AS hb,
  x.p_name AS name, x.p_type AS kind, (x.p_size % 4)::INT AS q, (x.p_partkey > 1)::INT AS e, 'P' || x.p_partkey AS doc,
  (1 + (x.p_partkey > 1)::INT + (x.p_size % 2 = 0)::INT)::INT AS u, CASE WHEN x.p_partkey > 1 THEN length(bin(x.p_partkey)) - 1 ELSE 0 END AS a
  FROM part x LEFT JOIN part y ON x.p_partkey > 1 AND y.p_partkey = x.p_partkey // 2)"""
_C = """c AS (SELECT *, concat_ws(chr(10), 'using System;', 'using Shop.' || hb || ';', CASE WHEN s % 2 = 0 THEN 'using Shop.Spare;' END,
  'namespace Shop.' || b, '{', '    /// <summary> ' || name || ' </summary>', '    /// <param name="n">' || kind || '</param>',
  '    public class Part' || k || ' : ' || coalesce('Part' || h || ', ', '') || 'IPriced', '    {', '        private int _stock = ' || s || ', _spare;',
  '        public int Stock { get; set; }', '        public ' || CASE e WHEN 1 THEN 'override' ELSE 'virtual' END || ' int Total(int n)', '        {',
  '            int left = ' || s || ';', nullif(rtrim(repeat('            if (n == 0) { n++; }' || chr(10), q), chr(10)), ''),
  '            return Next(n) + Label.Text(n);', '        }', '        public int Next(int n)', '        {', '            Part' || h || ' other = new Part' || h || '();',
  '            return ' || CASE e WHEN 1 THEN 'other.Total(n + ' || s || ')' ELSE 'n + ' || s END || ';', '        }',
  '        public int Next(int n, int m) { return n * m; }', '    }', '}') AS content FROM p)"""
_M = "m AS (SELECT *, 'M' || k AS mini FROM p WHERE s <= 10)"
_B = "b AS (SELECT DISTINCT b, 'L' || b AS doc FROM p)"
_UP = "up AS (SELECT k, h AS x, 1 AS distance FROM p WHERE h IS NOT NULL UNION ALL SELECT up.k, up.x // 2, distance + 1 FROM up WHERE up.x > 1)"


def _parts(rows: DataFrame, column: str = "doc_id") -> DataFrame:
    return rows.filter(F.col(column).startswith("P"))


def _in(content: Column, mark: str, shift: int = 0) -> Column:
    return (F.locate(mark, content) - 1 + shift).cast("int")


def _points(docs: DataFrame, mark: str, shift: int = 0) -> DataFrame:
    """(doc_id, line, column) of the first place of a mark in each document that has it."""
    before = F.split(F.left("content", _in(F.col("content"), mark, shift)), "\n")
    rows = docs.filter(F.col("content").contains(mark))
    return rows.select("doc_id", (F.size(before) - 1).alias("line"), F.length(F.element_at(before, -1)).alias("column"))


def _owner(symbol: str) -> Column:
    return F.substring_index(symbol, ":", 1)


# --- One file


@query("SELECT doc AS doc_id, u + 20 + q + e AS n_lines, strlen(content)::BIGINT AS size FROM c WHERE doc LIKE 'P1%'", _P, _C)
def code_documents(spark, d):
    return tools.get_document_list(facts_of(spark, d).documents, "p1*.cs").select("doc_id", "n_lines", "size")


@query("SELECT doc AS doc_id, u::BIGINT AS usings, 1::BIGINT AS namespaces, 1::BIGINT AS types, 3::BIGINT AS methods, true AS has_compilation_unit, (4 + 2 * q + e)::BIGINT AS statements FROM p", _P)
def code_analyze(spark, d):
    return _parts(tools.analyze_code(facts_of(spark, d))).drop("max_depth", "nodes")


@query("""SELECT doc AS doc_id, 'Shop.' || b AS namespace, 'Part' || k AS type, 'Part' || h AS base, 'IPriced' AS interfaces, 6::BIGINT AS n_members,
  'int Total(int n) int Next(int n) int Next(int n, int m)' AS methods, concat_ws(',', 'System', 'Shop.' || hb, CASE WHEN s % 2 = 0 THEN 'Shop.Spare' END) AS usings FROM p""", _P)
def code_lists(spark, d):
    rows = _parts(tools.code_lists(facts_of(spark, d)))
    method = lambda x: F.concat(x["returns"], F.lit(" "), x["name"], F.lit("("), F.array_join(x["params"], ", "), F.lit(")"))
    one = F.get("types", F.lit(0))
    return rows.select(
        "doc_id", F.get("namespaces", F.lit(0))["name"].alias("namespace"), one["name"].alias("type"), one["base"].alias("base"),
        F.array_join(one["interfaces"], ",").alias("interfaces"), one["n_members"].alias("n_members"),
        F.array_join(F.transform("methods", method), " ").alias("methods"), F.array_join(F.transform("usings", lambda x: x["name"]), ",").alias("usings"),
    )


@query("""SELECT doc AS doc_id, 'Shop.' || b AS namespace, 'Part' || k AS type, '_stock,_spare,Stock,Total,Next,Next' AS members FROM p
UNION ALL SELECT mini, 'Mini', 'Mini' || k, 'Done,Most,Run' FROM m""", _P, _M)
def code_hierarchy(spark, d):
    rows = tools.hierarchy(facts_of(spark, d)).filter("doc_id rlike '^[PM]'").select("doc_id", "namespace", F.explode("types").alias("t"))
    return rows.select("doc_id", "namespace", F.col("t.name").alias("type"), F.array_join("t.members", ",").alias("members"))


@query("""SELECT doc AS doc_id, 0 AS depth, 'CompilationUnit' AS kind, NULL AS ident, NULL AS modifiers FROM p
UNION ALL SELECT doc, 1, 'UsingDirective', 'System', NULL FROM p UNION ALL SELECT doc, 1, 'UsingDirective', 'Shop.' || hb, NULL FROM p WHERE h IS NOT NULL
UNION ALL SELECT doc, 1, 'UsingDirective', 'Shop.Spare', NULL FROM p WHERE s % 2 = 0 UNION ALL SELECT doc, 1, 'NamespaceDeclaration', 'Shop.' || b, NULL FROM p
UNION ALL SELECT doc, 2, 'ClassDeclaration', 'Part' || k, 'public' FROM p""", _P)
def code_tree(spark, d):
    rows = _parts(tools.get_syntax_tree(facts_of(spark, d), None, max_depth=2))
    return rows.select("doc_id", "depth", "kind", F.col("properties")["Identifier"].alias("ident"), F.col("properties")["Modifiers"].alias("modifiers"))


@query("""SELECT doc AS doc_id, 'UsingDirective' AS kind, unnest(['System'] || CASE WHEN h IS NULL THEN [] ELSE ['Shop.' || hb] END || CASE WHEN s % 2 = 0 THEN ['Shop.Spare'] ELSE [] END) AS ident, 0 AS depth, 0::BIGINT AS below FROM p
UNION ALL SELECT mini, 'UsingDirective', 'X', 0, 0 FROM m""", _P, _M)
def code_tree_structure(spark, d):
    rows = tools.tree_structure(facts_of(spark, d)).filter("kind = 'UsingDirective'")
    alias = facts_of(spark, d).usings.select("doc_id", "start", "alias")
    return rows.join(alias, ["doc_id", "start"]).select("doc_id", "kind", F.coalesce("alias", "ident").alias("ident"), "depth", "below")


@query("SELECT doc AS doc_id, 0 AS s, 13 AS e, 'UsingDirective' AS kind FROM p UNION ALL SELECT doc, 0, 13, 'CompilationUnit' FROM p", _P)
def code_span(spark, d):
    rows = _parts(tools.get_syntax_tree(facts_of(spark, d), None, span=(0, 12)))
    return rows.select("doc_id", F.lit(0).alias("s"), F.lit(13).alias("e"), "kind")


@query("SELECT doc AS doc_id, 'CompilationUnit,NamespaceDeclaration,ClassDeclaration,MethodDeclaration,Block' AS ancestors FROM p", _P)
def code_ancestors(spark, d):
    rows = _parts(facts_of(spark, d).nodes.filter("kind = 'LocalDeclarationStatement' and ident = 'left'"))
    return rows.select("doc_id", F.array_join("ancestors", ",").alias("ancestors"))


@query("SELECT mini AS doc_id, 'CS1513' AS id, 'Mini' || k AS type FROM m WHERE k % 3 = 0", _P, _M)
def code_node_errors(spark, d):
    f = facts_of(spark, d)
    return tools.node_errors(f).join(f.types.select("doc_id", "node_id", F.col("name").alias("type")), ["doc_id", "node_id"]).select("doc_id", "id", "type")


@query("SELECT doc AS doc_id, 0::BIGINT AS comments, 2::BIGINT AS documentation FROM p UNION ALL SELECT mini, 1, 0 FROM m", _P, _M)
def code_trivia(spark, d):
    count = lambda c: F.count_if(c)
    rows = tools.trivia(facts_of(spark, d)).groupBy("doc_id")
    return rows.agg(count(F.col("is_comment") & ~F.col("is_documentation")).alias("comments"), count("is_documentation").alias("documentation"))


@query("""SELECT doc AS doc_id, 'int' AS type, (3 + q)::BIGINT AS n FROM p UNION ALL SELECT mini, 'int', 3 FROM m UNION ALL SELECT mini, 'string', 1 FROM m
UNION ALL SELECT mini, 'double', 1 FROM m UNION ALL SELECT doc, 'int', 1 FROM b""", _P, _M, _B)
def code_constants(spark, d):
    return tools.constants(facts_of(spark, d)).groupBy("doc_id", "type").agg(F.count("*").alias("n"))


@query("""SELECT mini AS doc_id, 'Mini' || k AS type, 'Old' AS name, '"m' || k || '"' AS arguments, 'Level=' || s AS named FROM m""", _P, _M)
def code_attributes(spark, d):
    f = facts_of(spark, d)
    rows = tools.attributes(f).join(f.types.select("doc_id", "node_id", F.col("name").alias("type")), ["doc_id", "node_id"])
    named = F.array_join(F.transform("named", lambda x: F.concat_ws("=", x["name"], x["value"])), ",")
    return rows.select("doc_id", "type", "name", F.array_join("arguments", ",").alias("arguments"), named.alias("named"))


# --- Symbols


@query("SELECT doc AS doc_id, 'Next' AS name, 'method' AS kind, doc AS symbol_doc, u + 13 + q AS start_line, u + 16 + q + e AS end_line, 1::BIGINT AS n_candidates FROM p", _P)
def code_definition(spark, d):
    f = facts_of(spark, d)
    rows = tools.go_to_definition(f, _points(f.documents, "Next(n) +", 2))
    return rows.select("doc_id", "name", "kind", "symbol_doc", "start_line", "end_line", "n_candidates")


@query("""SELECT doc AS doc_id, 'Part' || k AS name, 'class' AS kind, 'Shop.' || b AS namespace, 'public' AS accessibility, name AS summary, kind AS param FROM p""", _P)
def code_symbol_info(spark, d):
    f = facts_of(spark, d)
    rows = tools.get_symbol_info(f, _points(_parts(f.documents), "class Part", 7))
    return rows.select("doc_id", "name", "kind", "namespace", "accessibility", F.col("documentation.summary").alias("summary"), F.get("documentation.params", F.lit(0))["text"].alias("param"))


@query("""SELECT doc AS doc_id, 'Total' AS name, doc AS symbol_doc, 'self' AS relation FROM p UNION ALL SELECT 'P' || k, 'Total', 'P' || x, 'override' FROM up
UNION ALL SELECT mini, 'Part' || k, doc, 'alias' FROM m""", _P, _M, _UP)
def code_resolve(spark, d):
    f = facts_of(spark, d)
    points = _points(_parts(f.documents), " Total(", 1).unionByName(_points(f.documents, "X made", 0))
    return tools.resolve_symbol(f, points, overrides_too=True, aliases=True).select("doc_id", "name", "symbol_doc", "relation")


@query("""SELECT doc AS from_doc, doc AS doc_id, u + 8 AS line, 27 + e AS "column", true AS is_definition,
  'public ' || CASE e WHEN 1 THEN 'override' ELSE 'virtual' END || ' int Total(int n)' AS context FROM p
UNION ALL SELECT 'P' || h, doc, u + 16 + q, 25, false, 'return other.Total(n + ' || s || ');' FROM p WHERE h IS NOT NULL""", _P)
def code_references(spark, d):
    f = facts_of(spark, d)
    rows = tools.find_references(f, _points(_parts(f.documents), " Total(", 1))
    return rows.select("from_doc", "doc_id", "line", "column", "is_definition", "context")


@query("SELECT p.doc AS from_doc, 1 AS definitions, count(x.k)::INT AS uses FROM p LEFT JOIN p x ON x.h = p.k GROUP BY p.doc", _P)
def code_definition_and_references(spark, d):
    f = facts_of(spark, d)
    rows = tools.get_definition_and_references(f, _points(_parts(f.documents), " Total(", 1))
    return rows.select("from_doc", F.size("definitions").alias("definitions"), F.size("references").alias("uses"))


@query("""SELECT doc AS symbol_doc, 'self' AS relation, doc AS doc_id, 'Total' AS name, u + 8 AS start_line FROM p
UNION ALL SELECT 'P' || up.k, 'override', y.doc, 'Total', y.u + 8 FROM up JOIN p y ON y.k = up.x UNION ALL SELECT doc, 'interface', 'I', 'Total', 2 FROM p""", _P, _UP)
def code_declarations(spark, d):
    f = facts_of(spark, d)
    rows = tools.find_declarations(f, _points(_parts(f.documents), " Total(", 1))
    return rows.select(_owner("symbol_id").alias("symbol_doc"), "relation", "doc_id", "name", "start_line")


@query("""SELECT doc AS doc_id, 'Next,Stock,Total,_spare,_stock,left,n' AS names, (9 + (SELECT count(*) FROM p y WHERE y.b = p.b))::BIGINT AS n FROM p""", _P)
def code_scope(spark, d):
    f = facts_of(spark, d)
    rows = tools.get_semantic_model(f, _points(f.documents, "Next(n) +"))
    plain = F.array_join(F.sort_array(F.collect_set(F.when(F.col("kind").isin("method", "property", "field", "parameter", "local"), F.col("name")))), ",")
    return rows.groupBy("doc_id").agg(plain.alias("names"), F.count("*").alias("n"))


@query("SELECT doc AS doc_id, 'Next' AS name, 'method' AS kind FROM p", _P)
def code_completion(spark, d):
    f = facts_of(spark, d)
    return tools.get_completion_list(f, _points(f.documents, "Next(n) +"), "ne").select("doc_id", "name", "kind")


@query("""SELECT doc AS doc_id, 'Shop.' || b AS namespace, 'Twice' AS name FROM p UNION SELECT doc, 'Shop.' || hb, 'Twice' FROM p WHERE h IS NOT NULL
UNION SELECT doc, 'Shop.' || b, 'Twice' FROM b""", _P, _B)
def code_extension_methods(spark, d):
    return tools.extension_methods(facts_of(spark, d)).select("doc_id", "namespace", "name")


@query("""SELECT doc AS doc_id, 'Total' AS name, 1::BIGINT AS overloads FROM p UNION ALL SELECT doc, 'Next', 2 FROM p UNION ALL SELECT doc, unnest(['Text', 'Twice']), 1 FROM b
UNION ALL SELECT mini, 'Run', 1 FROM m UNION ALL SELECT 'I', 'Total', 1""", _P, _M, _B)
def code_method_groups(spark, d):
    return tools.method_groups(facts_of(spark, d)).select(_owner("type_id").alias("doc_id"), "name", "overloads")


@query("""SELECT doc AS doc_id, 'left' AS name, 'Int32' AS type, true AS is_value FROM p UNION ALL SELECT mini, 'half', 'Double', true FROM m
UNION ALL SELECT mini, 'text', 'String', false FROM m""", _P, _M)
def code_infer_types(spark, d):
    f = facts_of(spark, d)
    out = None
    for name in ("left", "half", "text"):
        rows = tools.infer_types(f, _points(f.documents.filter("doc_id rlike '^[PM]'"), f" {name} =", 1))
        rows = rows.select("doc_id", F.lit(name).alias("name"), F.col("type.name").alias("type"), F.col("type.is_value").alias("is_value"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT mini AS doc_id, 'items' AS name, false AS nullable, false AS same FROM m UNION ALL SELECT mini, 'none', true, false FROM m UNION ALL SELECT doc, 'n', false, true FROM p", _P, _M)
def code_nullability(spark, d):
    rows = facts_of(spark, d).declared.filter("node_kind = 'Parameter' and doc_id rlike '^[PM]'").select("doc_id", "name", "type_text").filter("name <> 'm'").distinct()
    same = tools.conversions(F.col("type_text"), F.lit("int"))["is_identity"]
    return rows.select("doc_id", "name", tools.nullability(F.col("type_text")).alias("nullable"), same.alias("same"))


@query("SELECT 'Shop.IPriced' AS asked, 1::BIGINT AS n UNION ALL SELECT 'Label', count(*) FROM b UNION ALL SELECT 'Nothing', 0", _P, _B)
def code_resolve_type(spark, d):
    f = facts_of(spark, d)
    out = None
    for name in ("Shop.IPriced", "Label", "Nothing"):
        rows = tools.resolve_type(f, name).agg(F.lit(name).alias("asked"), F.count("*").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT 'get_Stock' AS asked, 'Stock' AS name UNION ALL SELECT 'Total', 'Total'")
def code_resolve_member(spark, d):
    f = facts_of(spark, d)
    one = lambda name: tools.resolve_member(f, "IPriced", name).select(F.lit(name).alias("asked"), "name")
    return one("get_Stock").unionByName(one("Total"))


@query("SELECT 'Shop.' || b AS namespace, 'Part' || k AS owner, 'method' AS kind FROM p", _P)
def code_name_conflicts(spark, d):
    return tools.name_conflicts(facts_of(spark, d), "Next")


@query("SELECT doc AS doc_id, 1 AS n, true AS in_file, false AS crosses_methods FROM p UNION ALL SELECT doc, 2, true, true FROM p UNION ALL SELECT doc, 3, false, true FROM p", _P)
def code_selection(spark, d):
    f = facts_of(spark, d)
    docs = _parts(f.documents)
    begin, stop = _in(F.col("content"), "int left"), _in(F.col("content"), "int Next(int n)", 20)
    cases = F.array(*(F.struct(F.lit(n).alias("n"), a.cast("int").alias("begin"), b.cast("int").alias("stop")) for n, a, b in ((1, F.lit(0), F.lit(5)), (2, begin, stop), (3, begin, F.length("content") + 1))))
    spans = docs.select("doc_id", F.inline(cases))
    return tools.selection_problems(f, spans.drop("n")).join(spans, ["doc_id", "begin", "stop"]).select("doc_id", "n", "in_file", "crosses_methods")


@query("SELECT doc AS doc_id, 4::BIGINT AS visible, 4::BIGINT AS instance FROM p UNION ALL SELECT mini, 2, 2 FROM m UNION ALL SELECT doc, 2, 0 FROM b UNION ALL SELECT 'I', 2, 2", _P, _M, _B)
def code_visible_members(spark, d):
    f = facts_of(spark, d)
    a = tools.visible_members(f).groupBy("doc_id").agg(F.count("*").alias("visible"))
    b = tools.visible_members(f, instance_only=True).groupBy("doc_id").agg(F.count("*").alias("instance"))
    return a.join(b, "doc_id", "left").select("doc_id", "visible", F.coalesce("instance", F.lit(0)).alias("instance"))


# --- Hierarchies


@query("""SELECT 'Part' || k AS name, 'Part' || x AS other_name, 'base' AS relation, distance FROM up UNION ALL SELECT 'Part' || x, 'Part' || k, 'derived', distance FROM up
UNION ALL SELECT 'Part' || k, 'IPriced', 'interface', 1 FROM p""", _P, _UP)
def code_type_hierarchy(spark, d):
    f = facts_of(spark, d)
    rows = tools.get_type_hierarchy(f).join(f.types.select("type_id", "name"), "type_id")
    return rows.select("name", "other_name", "relation", "distance")


@query("""SELECT 'Part' || k AS type_name, name, relation, n::BIGINT AS n FROM (
  SELECT k, 'Total' AS name, 'override' AS relation, a AS n FROM p UNION ALL SELECT k, unnest(['Total', 'Stock']), 'interface', 1 FROM p
  UNION ALL SELECT k, unnest(['Total', 'Stock', '_stock', '_spare']), 'same_name_in_bases', a FROM p UNION ALL SELECT k, 'Next', 'same_name_in_bases', 2 * a FROM p
  UNION ALL SELECT k, unnest(['Stock', '_stock', '_spare']), 'hides', a FROM p UNION ALL SELECT k, 'Next', 'hides', 2 * a FROM p) WHERE n > 0""", _P)
def code_member_hierarchy(spark, d):
    f = facts_of(spark, d)
    rows = tools.get_member_hierarchy(f).join(f.members.select("member_id", "type_name", "name"), "member_id")
    return rows.groupBy("type_name", "name", "relation").agg(F.count("*").alias("n"))


@query("SELECT 'Part' || k AS name, 'IPriced' AS interface, 'Stock,Total' AS members FROM p", _P)
def code_interfaces(spark, d):
    f = facts_of(spark, d)
    rows = tools.type_interfaces(f).join(f.types.select("type_id", "name"), "type_id")
    return rows.select("name", "interface", F.array_join("members", ",").alias("members"))


@query("""SELECT doc AS doc_id, (a + 1)::INT AS inheritance_depth FROM p UNION ALL SELECT mini, 1 FROM m UNION ALL SELECT doc, 1 FROM b UNION ALL SELECT 'S', 1""", _P, _M, _B)
def code_inheritance_depth(spark, d):
    return tools.inheritance_depth(facts_of(spark, d)).select(_owner("type_id").alias("doc_id"), "inheritance_depth")


# --- Metrics


@query("SELECT doc AS doc_id, (1 + e)::BIGINT AS coupling FROM p UNION ALL SELECT mini, 3 FROM m", _P, _M)
def code_coupling(spark, d):
    return tools.class_coupling(facts_of(spark, d)).select(_owner("type_id").alias("doc_id"), "coupling")


@query("""SELECT doc AS doc_id, (6 + q)::BIGINT AS complexity, 4::BIGINT AS members, (u + 20 + q + e)::INT AS loc,
  round(100 - 2 * (6 + q) - (u + 20 + q + e) / 1000 * 5, 6) AS maintainability, CASE WHEN 6 + q < 10 THEN 'low' ELSE 'medium' END AS level FROM p""", _P)
def code_metrics(spark, d):
    rows = _parts(tools.get_code_metrics(facts_of(spark, d)).filter("namespace is null"))
    return rows.select("doc_id", "complexity", "members", "loc", F.round("maintainability", 6).alias("maintainability"), "level")


@query("""SELECT doc AS doc_id, member AS name, loc, complexity::BIGINT AS complexity, 'low' AS level, a > 4 AS deep FROM (
  SELECT *, unnest(['Total', 'Next', 'Next', 'Stock']) AS member, unnest([5 + q, 4 + e, 1, 1]) AS loc, unnest([1 + q, 1, 1, 3]) AS complexity FROM p)""", _P)
def code_member_metrics(spark, d):
    rows = _parts(tools.member_metrics(facts_of(spark, d)))
    return rows.select("doc_id", "name", "loc", "complexity", "level", F.col("limits.deep").alias("deep"))


@query("SELECT doc AS doc_id, (1 + q)::BIGINT AS complexity FROM p UNION ALL SELECT mini, 4 FROM m UNION ALL SELECT doc, 1 FROM b UNION ALL SELECT unnest(['I', 'S']), 1", _P, _M, _B)
def code_branches(spark, d):
    return metrics.cyclomatic(facts_of(spark, d).nodes, "doc_id")


@query("""SELECT doc AS doc_id, 'left' AS name, u + 10 AS line FROM p UNION ALL SELECT mini, unnest(['made', 'e', 'text', 'half']), unnest([10, 15, 16, 17]) + 1 FROM m""", _P, _M)
def code_unused_locals(spark, d):
    return tools.unused_locals(facts_of(spark, d)).select("doc_id", "name", "line")


@query("""SELECT mini AS doc_id, 'a,b' AS declared, 'b' AS read_inside, 'a' AS written_inside, 'a,item,items' AS read_outside, '' AS written_outside FROM m""", _P, _M)
def code_data_flow(spark, d):
    f = facts_of(spark, d)
    docs = f.documents.filter("doc_id like 'M%'")
    spans = docs.select("doc_id", _in(F.col("content"), "int a, b").alias("begin"), _in(F.col("content"), "a = b;", 6).alias("stop"))
    rows = tools.data_flow(f, spans)
    return rows.select("doc_id", *(F.array_join(c, ",").alias(c) for c in ("declared", "read_inside", "written_inside", "read_outside", "written_outside")))


@query("SELECT mini AS doc_id, 1::BIGINT AS returns, 1::BIGINT AS breaks, 0::BIGINT AS continues, 1::BIGINT AS throws FROM m", _P, _M)
def code_control_flow(spark, d):
    f = facts_of(spark, d)
    spans = f.documents.filter("doc_id like 'M%'").select("doc_id", F.lit(0).alias("begin"), F.length("content").alias("stop"))
    return tools.control_flow(f, spans).drop("begin", "stop")


# --- Calls

_E = """e AS (SELECT doc || '.Total' AS src, doc || '.Next' AS dst FROM p UNION ALL SELECT doc || '.Total', 'L' || b || '.Text' FROM p
  UNION ALL SELECT doc || '.Next', 'P' || h || '.Total' FROM p WHERE h IS NOT NULL)"""
_NODE = "case when doc_id like 'L%' then concat(doc_id, '.Text') else concat(doc_id, '.', name) end"


def _named(f: plans.Facts, rows: DataFrame, *columns: str) -> DataFrame:
    """Member ids as document and name."""
    label = f.members.select("member_id", F.concat_ws(".", "doc_id", "name").alias("label"))
    for c in columns:
        rows = rows.join(label.withColumnsRenamed({"member_id": c, "label": f"{c}_"}), c).drop(c).withColumnRenamed(f"{c}_", c)
    return rows


@query("""SELECT 'P' || h || '.Total' AS callee, doc || '.Next' AS caller, u + 16 + q AS line, 'n + ' || s AS args, 'return other.Total(n + ' || s || ');' AS context FROM p WHERE h IS NOT NULL""", _P)
def code_callers(spark, d):
    f = facts_of(spark, d)
    rows = tools.get_caller_info(f, tools.members_named(f, "Total")).withColumnsRenamed({"callee_id": "callee", "caller_id": "caller"})
    return _named(f, rows.select("callee", "caller", "line", F.array_join("args", ",").alias("args"), "context"), "callee", "caller")


@query("SELECT doc || unnest(['.Total', '.Next']) AS caller FROM p WHERE k > 1", _P)
def code_callers_indirect(spark, d):
    f = facts_of(spark, d)
    rows = tools.get_caller_info(f, tools.members_named(f, "Total", "Part1"), indirect=True)
    return _named(f, rows.withColumnRenamed("caller_id", "caller"), "caller")


@query("""SELECT doc || '.Total' AS root, doc || '.Total' AS parent, dst AS callee, 0 AS depth FROM p JOIN e ON src = doc || '.Total' WHERE s = 50
UNION ALL SELECT doc || '.Total', doc || '.Next', dst, 1 FROM p JOIN e ON src = doc || '.Next' WHERE s = 50""", _P, _E)
def code_callees(spark, d):
    f = facts_of(spark, d)
    large = f.members.filter("name = 'Total'").join(table(spark, d, "part").filter("p_size = 50").select(F.concat(F.lit("P"), "p_partkey").alias("doc_id")), "doc_id")
    return _named(f, tools.get_callee_info(f, large.select("member_id"), 2), "root", "parent", "callee")


_WALK = """walk AS (SELECT doc || '.Total' AS node, 0 AS depth FROM p WHERE s = 50 UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.node WHERE w.depth < 10),
nodes AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node), sites AS (SELECT src, dst FROM e JOIN nodes ON node = src AND depth < 10)"""


@query("""SELECT node, depth, (SELECT count(*) FROM sites WHERE dst = node) AS fan_in, (SELECT count(*) FROM sites WHERE src = node) AS fan_out FROM nodes""", _P, _E, _WALK)
def code_call_graph(spark, d):
    f = facts_of(spark, d)
    large = f.members.filter("name = 'Total'").join(table(spark, d, "part").filter("p_size = 50").select(F.concat(F.lit("P"), "p_partkey").alias("doc_id")), "doc_id")
    nodes, _, _ = tools.get_call_graph(f, large.select("member_id"), 10)
    rows = nodes.select("node", "depth", F.col("fan_in_sites").alias("fan_in"), F.col("fan_out_sites").alias("fan_out"))
    return _named(f, rows, "node")


@query("""SELECT 0 AS place, 'digraph CallGraph {' AS line UNION ALL SELECT 2, '}'
UNION ALL SELECT DISTINCT 1, '  "' || src || '" -> "' || dst || '";' FROM t""", _P, _UP, """k AS (SELECT 7 AS k UNION SELECT x FROM up WHERE up.k = 7),
t AS (SELECT 'Part' || k || '.Total' AS src, unnest(['Part' || k || '.Next', 'Label.Text']) AS dst FROM k UNION ALL SELECT 'Part' || k || '.Next', 'Part' || k // 2 || '.Total' FROM k WHERE k > 1)""")
def code_dot(spark, d):
    f = facts_of(spark, d)
    return tools.get_call_graph(f, tools.members_named(f, "Total", "Part7"), 10)[2]


# --- Imports and generated code


@query("SELECT doc AS doc_id, 'Shop.Spare' AS name FROM p WHERE s % 2 = 0", _P)
def code_unused_usings(spark, d):
    return tools.remove_unused_usings(facts_of(spark, d)).select("doc_id", "name")


@query("SELECT doc AS doc_id, replace(content, 'using Shop.Spare;' || chr(10), '') AS content FROM c", _P, _C)
def code_remove_usings(spark, d):
    return _parts(tools.remove_unused_text(facts_of(spark, d))).select("doc_id", "content")


_REST = "substr(content, instr(content, 'namespace'))"


@query(f"""SELECT doc AS doc_id, concat_ws(chr(10), CASE WHEN 'Shop.' || hb < 'Shop.Spare' OR s % 2 = 1 THEN 'using Shop.' || hb || ';' END, CASE WHEN s % 2 = 0 THEN 'using Shop.Spare;' END,
  CASE WHEN 'Shop.' || hb >= 'Shop.Spare' AND s % 2 = 0 THEN 'using Shop.' || hb || ';' END, 'using System;', {_REST}) AS content FROM c""", _P, _C)
def code_sort_usings(spark, d):
    return _parts(tools.sort_usings(facts_of(spark, d), "alphabetical")).select("doc_id", "content")


@query(f"SELECT doc AS doc_id, 'using System;' || chr(10) || coalesce(chr(10) || 'using Shop.' || hb || ';' || chr(10), '') || {_REST} AS content FROM c", _P, _C)
def code_organize_imports(spark, d):
    return _parts(tools.organize_imports(facts_of(spark, d))).select("doc_id", "content")


@query("SELECT mini AS doc_id, unnest(['System.Collections.Generic', 'System.Threading.Tasks']) AS namespace FROM m", _P, _M)
def code_missing_imports(spark, d):
    return tools.add_missing_imports(facts_of(spark, d))


_STUB = "(int n) => throw new NotImplementedException();"


@query(f"SELECT 'IPriced' AS interface, 'Total' AS name, 'public int Total{_STUB}' AS code UNION ALL SELECT 'IPriced', 'Stock', 'public int Stock {{ get; set; }}'")
def code_interface_impl(spark, d):
    return tools.generate_interface_impl(facts_of(spark, d))


@query(f"SELECT 'Part' || k AS type_name, 'Total' AS name, 'public override int Total{_STUB}' AS code FROM p WHERE h IS NOT NULL", _P)
def code_overrides(spark, d):
    return tools.generate_overrides(facts_of(spark, d)).select("type_name", "name", "code")


def _fields(spark: SparkSession, d: str) -> DataFrame:
    fields = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(t).alias("type"), F.lit(n).alias("name")) for i, (t, n) in enumerate((("int", "Size"), ("string", "Name")))))
    return table(spark, d, "part").select(F.concat(F.lit("Part"), "p_partkey").alias("class_name"), F.inline(fields))


@query("""SELECT 'Part' || k AS class_name, 'public Part' || k || '(int size, string name)' || CASE WHEN h IS NULL THEN '' ELSE ' : base(size, "' || h || '")' END ||
  chr(10) || '{' || chr(10) || '    _size = size;' || chr(10) || '    _name = name;' || chr(10) || '}' AS code FROM p""", _P)
def code_constructor(spark, d):
    based = table(spark, d, "part").filter("p_partkey > 1").select(F.concat(F.lit("Part"), "p_partkey").alias("class_name"), F.format_string('size, "%d"', F.expr("p_partkey div 2")).alias("call"))
    return tools.generate_constructors(_fields(spark, d), based)


@query("""SELECT 'Part' || k AS class_name, 'public void Deconstruct(out int size, out string name)' || chr(10) || '{' || chr(10) || '    size = Size;' || chr(10) || '    name = Name;' || chr(10) || '}' AS code FROM p""", _P)
def code_deconstructor(spark, d):
    return tools.generate_deconstructors(_fields(spark, d))


@query("""SELECT k, 'private int _p' || k || ';' || chr(10) || 'public int P' || k || ' { get => _p' || k || '; set => _p' || k || ' = value; }' AS backed,
  'public int P' || k || ' { get; }' AS plain FROM p""", _P)
def code_property(spark, d):
    name = F.concat(F.lit("P"), "p_partkey")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("k"), tools.property_code(F.lit("int"), name, backing=True).alias("backed"), tools.property_code(F.lit("int"), name, read_only=True).alias("plain")
    )


@query("""SELECT 'Go' || k AS callee_name, 'public void Go' || k || '(object param0, object param1) => throw new NotImplementedException();' AS code FROM m
UNION ALL SELECT DISTINCT 'Use', 'public void Use(object param0) => throw new NotImplementedException();' FROM m""", _P, _M)
def code_from_usage(spark, d):
    return tools.generate_from_usage(facts_of(spark, d))


# --- Diagnostics, fixes and changes

_DIAGNOSTICS = """dg AS (SELECT 'CS0219' AS id, 'Warning' AS severity, doc AS doc_id, u + 10 AS start_line, 12 AS start_column FROM p
  UNION ALL SELECT 'CS0219', 'Warning', mini, unnest([11, 17, 18]), 12 FROM m UNION ALL SELECT 'CS0168', 'Warning', mini, 16, 45 FROM m
  UNION ALL SELECT 'CS1513', 'Error', mini, 21, 5 FROM m WHERE k % 3 = 0)"""


@query("SELECT * FROM dg", _P, _M, _DIAGNOSTICS)
def code_diagnostics(spark, d):
    rows = tools.get_diagnostics(plans.diagnostics(facts_of(spark, d)))
    return rows.select("id", "severity", "doc_id", "start_line", "start_column")


@query("SELECT id, doc_id FROM dg WHERE doc_id = 'P7'", _P, _M, _DIAGNOSTICS)
def code_file_diagnostics(spark, d):
    return tools.get_diagnostics(plans.diagnostics(facts_of(spark, d)), "/elsewhere/p7.CS").select("id", "doc_id")


@query("SELECT doc AS doc_id, 'CS0219' AS id, 'Remove the unused variable' AS fix FROM p", _P)
def code_quick_fixes(spark, d):
    f = facts_of(spark, d)
    return tools.quick_fixes(plans.diagnostics(f), _points(_parts(f.documents), "int left", 2)).select("doc_id", "id", "fix")


@query("SELECT count(*) AS diagnostics, count(DISTINCT doc_id) AS documents FROM dg WHERE id = 'CS0219'", _P, _M, _DIAGNOSTICS)
def code_scoped_diagnostics(spark, d):
    return tools.scoped_diagnostics(plans.diagnostics(facts_of(spark, d)), "CS0219", "solution")


@query("SELECT doc AS doc_id, replace(content, 'public int Next', 'internal int Next') AS content FROM c", _P, _C)
def code_accessibility(spark, d):
    f = facts_of(spark, d)
    return _parts(tools.set_accessibility(f, f.members.filter("name = 'Next'").select("doc_id", "node_id"), "Internal")).select("doc_id", "content")


@query("SELECT doc AS doc_id, true AS is_valid FROM p UNION ALL SELECT mini, k % 3 <> 0 FROM m", _P, _M)
def code_validate(spark, d):
    return tools.validated(facts_of(spark, d).documents).filter("doc_id rlike '^[PM]'").select("doc_id", "is_valid")


@query("SELECT doc AS doc_id, replace(content, 'Total', 'Sum') AS content FROM c UNION ALL SELECT 'I', 'namespace Shop' || chr(10) || '{' || chr(10) || '    public interface IPriced { int Sum(int n); int Stock { get; set; } }' || chr(10) || '}'", _P, _C)
def code_rename_member(spark, d):
    """The method of one part, its overrides, the interface's member and all calls."""
    f = facts_of(spark, d)
    target = f.documents.filter("doc_id = 'P1'").select("doc_id", _in(F.col("content"), "Total(").alias("offset"), F.lit("Sum").alias("new_name"))
    return rewrites.applied(f.documents, tools.rename(f, target)).filter("doc_id rlike '^[PI]'").select("doc_id", "content")


@query(r"""SELECT x.doc AS doc_id, CASE WHEN coalesce(y.s, 0) = 50 THEN replace(z, 'Part' || x.h || ' other = new Part' || x.h || '()', 'Item' || x.h || ' other = new Item' || x.h || '()') ELSE z END AS content FROM (
  SELECT *, replace(CASE WHEN s = 50 THEN replace(content, 'class Part' || k || ' :', 'class Item' || k || ' :') ELSE content END,
    ' : Part' || h || ',', CASE WHEN (SELECT t.s FROM p t WHERE t.k = c.h) = 50 THEN ' : Item' || h || ',' ELSE ' : Part' || h || ',' END) AS z FROM c WHERE h IS NOT NULL
  UNION ALL SELECT *, CASE WHEN s = 50 THEN replace(content, 'class Part' || k || ' :', 'class Item' || k || ' :') ELSE content END FROM c WHERE h IS NULL) x
LEFT JOIN p y ON y.k = x.h""", _P, _C)
def code_rename_type(spark, d):
    """All parts of size 50 at once: declarations, bases and uses in other files."""
    f = facts_of(spark, d)
    large = table(spark, d, "part").filter("p_size = 50").select(F.concat(F.lit("P"), "p_partkey").alias("doc_id"), F.concat(F.lit("Item"), "p_partkey").alias("new_name"))
    targets = f.documents.join(large, "doc_id").select("doc_id", _in(F.col("content"), "class Part", 6).alias("offset"), "new_name")
    return _parts(rewrites.applied(f.documents, tools.rename(f, targets))).select("doc_id", "content")


@query("""SELECT doc AS doc_id, unnest(['INVALID_NAME', 'INVALID_SYMBOL_LOCATION', 'NAME_CONFLICT']) AS error FROM p""", _P)
def code_rename_errors(spark, d):
    f = facts_of(spark, d)
    at = lambda mark, name, shift=0: _parts(f.documents).select("doc_id", _in(F.col("content"), mark, shift).alias("offset"), F.lit(name).alias("new_name"))
    targets = at("Total(", "1x").unionByName(at("{", "Fine")).unionByName(at("Stock {", "Next"))
    return tools.rename(f, targets).filter("error is not null").select("doc_id", "error")


@query("SELECT doc AS doc_id, 1::BIGINT AS edits, 'Replace' AS kinds, '@@ -' || (u + 5) || ',7 +' || (u + 5) || ',7 @@' AS head FROM p", _P)
def code_preview(spark, d):
    f = facts_of(spark, d)
    at = _in(F.col("content"), "Stock {")
    none = F.lit(None).cast("string")
    found = _parts(f.documents).select("doc_id", at.alias("start"), F.lit(5).alias("length"), F.lit("Stack").alias("new_text"), none.alias("error"))
    rows = tools.preview(f.documents, found)
    return rows.select("doc_id", "edits", F.array_join("kinds", ",").alias("kinds"), F.get(F.split("diff", "\n"), F.lit(2)).alias("head"))


@query("""SELECT '{"success":true,"isPreview":true,"affectedFileCount":1,"totalChangeCount":1,"fileChanges":[{"filePath":"P1","changeCount":1,"changes":[{"start":0,"kind":"Insert","oldText":"","newText":"// new"}]}]}' AS response
UNION ALL SELECT '{"success":false,"error":"no","isPreview":false}'""")
def code_result_json(spark, d):
    f = facts_of(spark, d)
    row = lambda *values: spark.createDataFrame([values], rewrites.EDIT_SCHEMA)
    return tools.result_json(f.documents, row("P1", 0, 0, "// new", None)).unionByName(tools.result_json(f.documents, row("P1", None, None, None, "no")))


@query("""SELECT doc AS key, 0 AS added, 0 AS removed, 1 AS modified, concat_ws(chr(10), '--- before', '+++ after', '@@ -' || (u + 5) || ',7 +' || (u + 5) || ',7 @@', ' ' || l[u + 5], ' ' || l[u + 6], ' ' || l[u + 7],
  '-' || l[u + 8], '+' || replace(l[u + 8], 'Stock', 'Stack'), ' ' || l[u + 9], ' ' || l[u + 10], ' ' || l[u + 11]) AS diff FROM (SELECT *, string_split(content, chr(10)) AS l FROM c)""", _P, _C)
def code_diff(spark, d):
    docs = _parts(facts_of(spark, d).documents)
    return tools.get_code_diff(docs.select(F.col("doc_id").alias("key"), F.col("content").alias("before"), F.replace("content", F.lit("Stock {"), F.lit("Stack {")).alias("after")))


@query("SELECT doc AS key, u + 7 AS line, 'Modified' AS kind FROM p", _P)
def code_compare(spark, d):
    docs = _parts(facts_of(spark, d).documents)
    after = F.replace(F.replace(F.regexp_replace("content", "(?m)^    ", "\t"), F.lit("Stock {"), F.lit("Stack {")), F.lit("int left"), F.lit("int  left"))
    pairs = docs.select(F.col("doc_id").alias("key"), F.col("content").alias("before"), F.regexp_replace(after, "(?m)n\\);$", "n); // more").alias("after"))
    return tools.compare_syntax_trees(pairs, ignore_whitespace=True, ignore_comments=True).select("key", "line", "kind")


@query("SELECT doc AS doc_id, replace('// ' || k || chr(10) || substr(content, 7), chr(10), chr(13) || chr(10)) AS content FROM c", _P, _C)
def code_apply_change(spark, d):
    docs = _parts(facts_of(spark, d).documents)
    change = F.concat(F.lit('[{"start":0,"length":6,"newText":"// '), F.substring("doc_id", 2, 20), F.lit('\\n"}]'))
    return tools.apply_code_change(docs, docs.select("doc_id", change.alias("changes")), windows=True).select("doc_id", "content")


# --- Projects and solutions


@query("""SELECT '/src/' || b || '.sln' AS solution, 'Part' || k AS project, 'Part' || k || '/Part' || k || '.csproj' AS path, coalesce('Part' || h, '') AS depends_on, (1 + (s % 2 = 0)::INT)::BIGINT AS n_packages FROM p
UNION ALL SELECT '/src/All.slnx', 'Part' || k, 'Part' || k || '/Part' || k || '.csproj', coalesce('Part' || h, ''), 2 FROM p WHERE s = 50""", _P)
def code_projects(spark, d):
    part = table(spark, d, "part")
    rows = tools.list_projects(generated.solution_files(part), generated.project_files(part))
    return rows.withColumn("depends_on", F.array_join("depends_on", ","))


@query("""SELECT 'Part' || k AS project, CASE s % 3 WHEN 0 THEN 'net8.0' WHEN 1 THEN 'net9.0' ELSE 'Unknown' END AS tfm, CASE WHEN s > 40 THEN 'Exe' ELSE 'Library' END AS output_type,
  'Part' || h AS project_references, CASE WHEN s % 2 = 0 THEN 'Json 2.1,' ELSE '' END || 'Log ' || s || '.0' AS packages, 0::BIGINT AS errors, 1::BIGINT AS warnings FROM p""", _P)
def code_project_info(spark, d):
    wrong = _parts(plans.diagnostics(facts_of(spark, d))).withColumn("project", F.concat(F.lit("Part"), F.substring("doc_id", 2, 20)))
    rows = tools.get_project_info(generated.project_files(table(spark, d, "part")), wrong)
    packages = F.array_join(F.transform("packages", lambda x: F.concat_ws(" ", x["name"], x["version"])), ",")
    return rows.select("project", "tfm", "output_type", F.array_join("project_references", ",").alias("project_references"), packages.alias("packages"), "errors", "warnings")


@query("SELECT 'Part' || k AS src, 'Part' || h AS direct, a::INT AS transitive, false AS cyclic FROM p WHERE h IS NOT NULL", _P)
def code_dependencies(spark, d):
    refs = source.project_refs(generated.project_files(table(spark, d, "part")))
    rows = tools.analyze_dependencies(refs)
    return rows.select("src", F.array_join("direct", ",").alias("direct"), F.size("transitive").alias("transitive"), "cyclic")


@query("SELECT 'Part' || k AS project, a::INT AS level, false AS in_cycle, s > 40 AND NOT EXISTS (SELECT 1 FROM p x WHERE x.h = p.k) AS is_startup FROM p", _P)
def code_solution(spark, d):
    files = generated.project_files(table(spark, d, "part"))
    return tools.get_solution_info(source.projects(files), source.project_refs(files))


@query("SELECT 'Part' || k AS src, 'Part' || h AS dst, CASE WHEN h % 2 = 0 THEN '/src/Part' || h || '/Part' || h || '.csproj' ELSE 'Unknown' END AS path FROM p WHERE h IS NOT NULL", _P)
def code_project_refs(spark, d):
    files = generated.project_files(table(spark, d, "part"))
    known = source.projects(files).filter("cast(substring(project, 5) as long) % 2 = 0")
    return tools.refs_to_projects(source.project_refs(files), known)


@query("SELECT 'P' || k AS doc_id, 'Part' || k AS project FROM p", _P)
def code_owning_project(spark, d):
    files = generated.project_files(table(spark, d, "part"))
    sources = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("doc_id"), F.format_string("/src/Part%d/Models/Deep/X.cs", "p_partkey").alias("path"))
    return source.owning(sources, files).select("doc_id", "project")


@query("SELECT 'P' || k || '.cs' AS path FROM p WHERE s % 3 <> 0", _P)
def code_changed(spark, d):
    """Files that are new, or newer than when they were last seen."""
    now = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey", F.lit(".cs")).alias("path"), (F.col("p_size") * 10).cast("timestamp").alias("mtime"), "p_size")
    seen = now.filter("p_size % 3 <> 2").select("path", F.when(F.col("p_size") % 3 == 1, F.col("mtime") - F.expr("INTERVAL 1 SECOND")).otherwise(F.col("mtime")).alias("mtime"))
    return source.changed(now.drop("p_size"), seen).select("path")


@query("""SELECT '{"success":true,"project":"Part1"}' AS response UNION ALL SELECT '{"success":false,"error":"no such file"}'""")
def code_answers(spark, d):
    def fails() -> DataFrame:
        raise source.PathError("no such file")

    good = source.projects(generated.project_files(table(spark, d, "part"))).filter("project = 'Part1'").select("project")
    return tools.answered(spark, lambda: good).unionByName(tools.answered(spark, fails))


@query("SELECT 'override' AS generator, count(*) AS n FROM p WHERE h IS NOT NULL UNION ALL SELECT 'interface', 2 UNION ALL SELECT 'from_usage', count(*) + (count(*) > 0)::INT FROM m", _P, _M)
def code_generators(spark, d):
    out = None
    for name in tools.GENERATORS:
        rows = tools.generate(facts_of(spark, d), name).agg(F.lit(name).alias("generator"), F.count("*").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


# --- Rewrites, each on one small file a part

_CATALOG = ", ".join(f"('{r.category}', '{r.name}')" for r in rewrites.CATALOG.values())


@query(f"SELECT * FROM (VALUES {_CATALOG}) AS t(category, name)")
def code_refactorers(spark, d):
    return tools.list_refactorers(spark).select("category", "name")


@query("SELECT * FROM (VALUES ('convert_for_to_foreach'), ('convert_foreach_to_for'), ('convert_if_to_switch'), ('reverse_for_statement')) AS t(name)")
def code_actions(spark, d):
    return tools.get_code_actions(spark, ["Convert"]).select("name")


@query("SELECT * FROM (VALUES ('extract_interface'), ('rename_symbol'), ('remove_unnecessary_code')) AS t(name)")
def code_refactorings(spark, d):
    return tools.get_refactorings(facts_of(spark, d), "S", (0, 1000)).select("name")


def _method(*lines: str) -> str:
    return "\n".join(["class A{k}", "{", "    void Run(int a)", "    {", *(f"        {x}" for x in lines), "    }", "}", ""])


def _rewrite(rule: str, before: str, mark: str | None, after: str, shift: int = 0, case: str = "", /, **arguments) -> None:
    """Register a query that runs a rewrite at a mark of a template filled in for each part; ``case`` tells several apart."""

    def run(spark, d):
        made = F.replace(F.replace(F.lit(before), F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{s}"), F.col("p_size").cast("string"))
        docs = table(spark, d, "part").select(F.concat(F.lit("R"), "p_partkey").alias("doc_id"), made.alias("content"))
        targets = docs.select("doc_id", _in(F.col("content"), mark, shift).alias("offset")) if mark else None
        return tools.refactor(docs, rule, targets, **arguments)

    run.__name__ = f"rewrite_{rule}{case}"
    filled = after.replace("'", "''")
    query(f"SELECT 'R' || p_partkey AS doc_id, replace(replace('{filled}', '{{k}}', p_partkey::VARCHAR), '{{s}}', p_size::VARCHAR) AS content, false AS conflict FROM part")(run)


_rewrite(
    "extract_method",
    "class A{k}\n{\n    int Run(int a)\n    {\n        int b = {s};\n        int c = b * a;\n        return c;\n    }\n}\n", "int c",
    "class A{k}\n{\n    int Run(int a)\n    {\n        int b = {s};\n        int c = Make(b, a);\n        return c;\n    }\n\n"
    "    private int Make(int b, int a)\n    {\n        int c = b * a;\n        return c;\n    }\n}\n", length=14, name="Make",
)
_SUM = "class A{k}\n{\n    int Run(int[] xs, int most)\n    {\n        int total = {s};\n        foreach (int x in xs)\n        {\n            "
_rewrite(
    "extract_method", _SUM + "total += x;\n            if (total > most) { break; }\n        }\n        return total;\n    }\n}\n", "total += x;",
    _SUM + "total = Add(total, x);\n            if (total > most) { break; }\n        }\n        return total;\n    }\n\n"
    "    private int Add(int total, int x)\n    {\n        total += x;\n        return total;\n    }\n}\n", 0, "_of_outer_local", length=11, name="Add",
)
_rewrite(
    "remove_unnecessary_code", _method("while (true)", "{", "    Go({s});", "    if (a > 1) { return; }", "}", "Go(a);", "Go(0);"), None,
    _method("while (true)", "{", "    Go({s});", "    if (a > 1) { return; }", "}"), 0, "_out_of_reach",
)
_rewrite("rename_symbol", "class A{k} { int Add(int a) { return Add({s}); } } // Add\n", "Add", "class A{k} { int Sum(int a) { return Sum({s}); } } // Sum\n", new_name="Sum", in_comments=True)
_rewrite("introduce_variable", _method("Go({s});"), "Go(", _method("var num = {s};", "Go(num);"), 3)
_rewrite(
    "encapsulate_field", "class A{k}\n{\n    public int size = {s};\n    int Get() { return size; }\n}\n", "public int",
    "class A{k}\n{\n    private int _size = {s};\n\n    public int Size { get => _size; set => _size = value; }\n    int Get() { return Size; }\n}\n",
)
_rewrite(
    "extract_interface", "public class A{k}\n{\n    public int Size { get; }\n    public int Run(int a) { return a; }\n    int Skip() { return {s}; }\n}\n", "public class",
    "public interface IA{k}\n{\n    int Size { get; }\n    int Run(int a);\n}\n\npublic class A{k} : IA{k}\n{\n    public int Size { get; }\n    public int Run(int a) { return a; }\n    int Skip() { return {s}; }\n}\n",
)
_ADD = "class A{k}\n{\n    int Add(int a) { return a; }\n    int Run() { return Add({s}); }\n}\n"
_rewrite(
    "change_signature", _ADD, "Add(int", "class A{k}\n{\n    long Add(int a, string b) { return a; }\n    int Run() { return Add({s}, null); }\n}\n",
    parameters=[{"type": "int", "name": "a"}, {"type": "string", "name": "b"}], return_type="long",
)
_rewrite("add_parameter", _ADD, "Add(int", "class A{k}\n{\n    int Add(int a, Size count) { return a; }\n    int Run() { return Add({s}, 0); }\n}\n", type_name="Size", name="count")
_rewrite("inline_temporary", _method("int b = {s} + 1;", "Go(b * a, b);"), "int b", _method("Go(({s} + 1) * a, ({s} + 1));"))
_rewrite("safely_remove_as", _method("if (x as T{s} != null) { }"), "if (", _method("if (x is T{s}) { }"))
_rewrite(
    "remove_unnecessary_code", "using A.Unused;\nusing B.Kept;\n" + _method("int left = {s};", "Kept.Go();", "return;", "Kept.Go();"), None,
    "using B.Kept;\n" + _method("Kept.Go();", "return;"),
)
_rewrite("convert_for_to_foreach", _method("for (int i = 0; i < x{s}.Count; i++) { Go(x{s}[i]); }"), "for (", _method("foreach (var item in x{s}) { Go(item); }"))
_rewrite("convert_foreach_to_for", _method("foreach (var y in x{s}) { Go(y); }"), "foreach", _method("for (int i = 0; i < x{s}.Count; i++) { Go(x{s}[i]); }"))
_rewrite(
    "convert_if_to_switch", _method("if (a == {s})", "{", "    Go();", "}", "else if (a == 0)", "{", "    return;", "}", "else", "{", "    Stop();", "}"), "if (",
    _method("switch (a)", "{", "    case {s}:", "        Go();", "        break;", "    case 0:", "        return;", "    default:", "        Stop();", "        break;", "}"),
)
_rewrite("reverse_for_statement", _method("for (int i = 0; i < {s}; i++) { Go(i); }"), "for (", _method("for (int i = {s} - 1; i >= 0; i--) { Go(i); }"))


# --- Chains of expressions

# Classes that have one above (h), the steps that they climb (d), and the class they reach (e).
_N = """n AS (SELECT k, h, d, k >> d AS e FROM (SELECT p_partkey AS k, p_partkey // 2 AS h, least(1 + p_partkey % 6, length(bin(p_partkey)) - 1)::INT AS d FROM part WHERE p_partkey > 1))"""


@query("""SELECT 'N' || k AS doc_id, v.name, 'Node' || CASE v.name WHEN 'end' THEN e ELSE h END AS type
FROM n, (VALUES ('end'), ('first'), ('kid'), ('x'), ('next')) v(name)""", _N)
def code_chain_types(spark, d):
    """Types of variables that have none written, by what they are given."""
    return chains_of(spark, d).locals.filter("inferred is not null and node_kind <> 'LocalFunctionStatement'").select("doc_id", "name", F.col("value_type").alias("type"))


@query("""SELECT 'N' || k AS doc_id, v.args, 'Node' || CASE WHEN v.far THEN e ELSE h END AS owner, v.type, 1::BIGINT AS n_candidates
FROM n, (VALUES ('"a"', false, 'string'), ('1', false, 'int'), ('end.Rank("s")', false, 'string'), ('"s"', true, 'string'), ('((Node)o).Rank(3)', false, 'int'),
  ('3', false, 'int'), ('Twice(4)', false, 'int'), ('5', true, 'int')) v(args, far, type)""", _N)
def code_chain_overloads(spark, d):
    """Of two overloads of one parameter, the one that the argument's type calls, behind receivers of every kind."""
    f = chains_of(spark, d)
    to = f.members.select(F.col("member_id").alias("callee_id"), F.col("type_name").alias("owner"), F.get("params", F.lit(0))["type"].alias("type"))
    rows = f.calls.filter("callee_name = 'Rank'").join(to, "callee_id", "left")
    return rows.select("doc_id", F.regexp_replace(F.array_join("args", ", "), r"\(Node\d+\)", "(Node)").alias("args"), "owner", "type", "n_candidates")


@query("""SELECT 'N' || k AS doc_id, CASE WHEN i % 2 = 1 THEN 'Climb' ELSE 'Up' END AS name, 'Node' || (k >> (i - 1)) AS owner, 1::BIGINT AS n
FROM (SELECT *, unnest(range(1, d + 1)) AS i FROM n) UNION ALL SELECT 'N' || k, 'Up', 'Node' || k, 2 FROM n""", _N)
def code_chain_steps(spark, d):
    """The members that each step of a chain means."""
    f = chains_of(spark, d)
    m = f.members.filter("name in ('Up', 'Climb')").select(F.col("member_id").alias("symbol_id"), "name", F.col("type_name").alias("owner"))
    return f.refs.filter("not is_definition").join(m, "symbol_id").groupBy("doc_id", "name", "owner").agg(F.count("*").alias("n"))


@query("""SELECT 'N' || k AS doc_id, '(int low, int high)' AS pair, 2::BIGINT AS loops, 'int Twice' AS inner, 4::BIGINT AS complexity, 0::BIGINT AS calls_of_inner FROM n""", _N)
def code_chain_constructs(spark, d):
    """Tuple results, loops over streams and functions inside methods, as the parser and the metrics see them."""
    f = chains_of(spark, d)
    n = f.nodes.groupBy("doc_id").agg(
        F.max(F.when((F.col("kind") == "MethodDeclaration") & (F.col("ident") == "Span"), F.col("type_text"))).alias("pair"),
        F.count_if(F.col("kind") == "ForEachStatement").alias("loops"),
        F.max(F.when(F.col("kind") == "LocalFunctionStatement", F.concat_ws(" ", "type_text", "ident"))).alias("inner"),
    )
    walk = plans.metrics_of(f).filter("name = 'Walk'").select("doc_id", "complexity")
    called = f.calls.groupBy("doc_id").agg(F.count_if(F.col("callee_name") == "Twice").alias("calls_of_inner"))
    return n.join(walk, "doc_id").join(called, "doc_id")


# --- Control and data flow

_F = "f AS (SELECT p_partkey AS k, (p_size % 4)::INT AS q, p_partkey % 2 = 1 AS odd FROM part)"


def _flow(spark: SparkSession, d: str) -> DataFrame:
    """Statements with their flow, with the text they begin with and the names of variables."""
    part = spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    return flow.units(generated.flow_sources(part), texts=True)


@query("""SELECT 'F' || k AS doc_id, (2 * q + CASE WHEN odd THEN 8 ELSE 10 END)::BIGINT AS units, (CASE q WHEN 0 THEN 1 ELSE 2 * q END + CASE WHEN odd THEN 6 ELSE 7 END)::BIGINT AS blocks,
  'Go(total);' AS unreachable FROM f""", _F)
def code_flow_blocks(spark, d):
    """Statements, basic blocks, and what control can't reach."""
    rows = _flow(spark, d)
    return rows.groupBy("doc_id").agg(F.count("*").alias("units"), F.countDistinct("block").alias("blocks"), F.max(F.when(~F.col("reachable"), F.col("text"))).alias("unreachable"))


@query("""SELECT 'F' || k AS doc_id, v.text, CASE WHEN v.text = 'int total = 0;' THEN CASE WHEN odd OR q > 0 THEN 3 ELSE 2 END WHEN odd THEN 3 ELSE 2 END::BIGINT AS live_out,
  0::BIGINT AS reaching FROM f, (VALUES ('int total = 0;'), ('total = a;')) v(text) WHERE v.text <> 'total = a;'
UNION ALL SELECT 'F' || k, 'total = a;', CASE WHEN odd THEN 3 ELSE 2 END, 1 FROM f
UNION ALL SELECT 'F' || k, CASE WHEN odd THEN 'return total;' ELSE 'return b;' END, 0, CASE WHEN odd THEN q + 2 ELSE 1 END FROM f""", _F)
def code_flow_live(spark, d):
    """How many variables are read after a statement before they are written again, and how many statements may have given what it reads."""
    rows = _flow(spark, d).filter("text in ('int total = 0;', 'total = a;') or kind = 'ReturnStatement'")
    return rows.select("doc_id", "text", F.size("live_out").cast("long").alias("live_out"), F.size("reaching").cast("long").alias("reaching"))


@query("""SELECT 'F' || k AS doc_id, q::BIGINT AS tests, (CASE q WHEN 0 THEN 1 ELSE 3 * q END + CASE WHEN odd THEN 8 ELSE 10 END)::BIGINT AS edges FROM f""", _F)
def code_flow_edges(spark, d):
    """Edges between basic blocks."""
    test = (F.col("kind") == "IfStatement") & F.col("text").contains("total +=")
    rows = _flow(spark, d).groupBy("doc_id").agg(F.sum(F.size("leads")).alias("edges"), F.count_if(test).alias("tests"))
    return rows.select("doc_id", "edges", "tests")
