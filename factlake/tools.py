"""Questions about source code, one function each, over the relations of :mod:`factlake.plans.facts`.

Lines and columns are 0-based throughout; :func:`one_based` converts a result for display.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.functions import names
from factlake.operators import graph, metrics, rewrites, text
from factlake.plans import facts as plans
from factlake.plans import flow
from factlake.plans.components import connected_components
from factlake.plans.expressions import bind_types, number_type
from factlake.plans.facts import NAMESPACE_KINDS, TYPE_KINDS, Facts
from factlake.sources import csharp
from factlake.sources import projects as source
from factlake.storage import written

POSITIONS = ("line", "column", "start_line", "end_line", "start_column", "end_column")
#: Namespaces of well-known types, whatever the case of the name.
KNOWN_TYPES = {
    "List": "System.Collections.Generic",
    "Dictionary": "System.Collections.Generic",
    "IEnumerable": "System.Collections.Generic",
    "Task": "System.Threading.Tasks",
    "ActionResult": "Microsoft.AspNetCore.Mvc",
    "Controller": "Microsoft.AspNetCore.Mvc",
    "HttpGet": "Microsoft.AspNetCore.Mvc",
    "HttpPost": "Microsoft.AspNetCore.Mvc",
    "ILogger": "Microsoft.Extensions.Logging",
}
#: What to say for a diagnostic.
QUICK_FIXES = {"CS0219": "Remove the unused variable", "CS0618": "Use the replacement of the obsolete member"}
#: Names of the types that have a keyword.
TYPE_NAMES = {
    "bool": "Boolean", "byte": "Byte", "sbyte": "SByte", "short": "Int16", "ushort": "UInt16", "int": "Int32", "uint": "UInt32", "long": "Int64",
    "ulong": "UInt64", "char": "Char", "float": "Single", "double": "Double", "decimal": "Decimal", "string": "String", "object": "Object", "void": "Void",
}


def one_based(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c) + 1 for c in POSITIONS if c in df.columns})


def response(df: DataFrame) -> DataFrame:
    """Rows as JSON objects with a success flag; nulls are left out."""
    return df.select(envelope(*df.columns).alias("response"))


def envelope(*columns: str) -> Column:
    """A JSON object with a success flag and some columns."""
    return F.to_json(F.struct(F.lit(True).alias("success"), *(F.col(c) for c in columns)))


def answered(spark: SparkSession, ask: Callable[[], DataFrame]) -> DataFrame:
    """The responses to a question, or one row that says why it failed."""
    try:
        return response(ask())
    except Exception as e:
        return spark.createDataFrame([(False, str(e))], "success boolean, error string").select(F.to_json(F.struct("success", "error")).alias("response"))


# --- Projects and solutions


def list_projects(solutions: DataFrame, project_files: DataFrame) -> DataFrame:
    """Projects of solutions with their numbers of references; unreadable ones count none.

    Both tables have (path, text), as :func:`factlake.sources.projects.texts` reads files.
    """
    listed = source.solution_projects(solutions)
    refs = source.project_refs(project_files).groupBy(F.col("src").alias("project")).agg(F.sort_array(F.collect_set("dst")).alias("depends_on"))
    packs = source.package_refs(project_files).groupBy("project").agg(F.count("*").alias("n_packages"))
    out = listed.join(refs, "project", "left").join(packs, "project", "left")
    return out.select("solution", "project", "path", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"), F.coalesce("n_packages", F.lit(0)).alias("n_packages"))


def get_project_info(project_files: DataFrame, diagnostics: DataFrame | None = None) -> DataFrame:
    """One row a project: framework, output, references, packages and numbers of errors and warnings."""
    refs = source.project_refs(project_files).groupBy(F.col("src").alias("project")).agg(F.sort_array(F.collect_set("dst")).alias("project_references"))
    packs = source.package_refs(project_files).groupBy("project").agg(F.sort_array(F.collect_list(F.struct("name", "version"))).alias("packages"))
    out = source.projects(project_files).join(refs, "project", "left").join(packs, "project", "left")
    if diagnostics is None:
        return out
    count = diagnostics.groupBy("project").agg(
        F.count_if(F.col("severity") == "Error").alias("errors"), F.count_if(F.col("severity") == "Warning").alias("warnings")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.join(count, "project", "left").select(*out.columns, zero("errors"), zero("warnings"))


def refs_to_projects(refs: DataFrame, projects: DataFrame) -> DataFrame:
    """``(src, dst, path)`` of project references; the path of an unknown project is Unknown."""
    known = projects.select(F.col("project").alias("dst"), "path")
    return refs.join(known, "dst", "left").select("src", "dst", F.coalesce("path", F.lit("Unknown")).alias("path"))


def analyze_dependencies(edges: DataFrame) -> DataFrame:
    """``(src, direct, transitive, cyclic)`` of every project with a dependency."""
    reach = graph.closure(edges)
    direct = edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("direct"))
    every = reach.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("transitive"))
    flags = graph.cyclic(direct.select(F.col("src").alias("node")), edges, reach=reach)
    return direct.join(every, "src").join(flags.select(F.col("node").alias("src"), F.col("reaches_cycle").alias("cyclic")), "src")


def get_solution_info(projects: DataFrame, edges: DataFrame, order: str = "build") -> DataFrame:
    """``(project, level, in_cycle, is_startup)``; a start-up project is executable and none needs it."""
    built = graph.build_order(projects.withColumnRenamed("project", "node"), edges, order=order).withColumnRenamed("node", "project")
    start = startup_projects(projects, edges).select("project", F.lit(True).alias("is_startup"))
    return built.join(start, "project", "left").withColumn("is_startup", F.coalesce("is_startup", F.lit(False)))


def startup_projects(projects: DataFrame, edges: DataFrame) -> DataFrame:
    """Executable projects that none depends on."""
    needed = edges.select(F.col("dst").alias("project")).distinct()
    return projects.filter(F.col("output_type").isin("Exe", "WinExe")).join(needed, "project", "left_anti")


def get_document_list(documents: DataFrame, pattern: str | None = None) -> DataFrame:
    """Documents whose path matches a pattern with ``*`` and ``?``."""
    out = documents.select("doc_id", "project", "path", "n_lines", "size")
    if not pattern:
        return out
    like = "".join({"*": ".*", "?": "."}.get(c) or (c if c.isalnum() else "\\" + c) for c in pattern)
    return out.filter(F.col("path").rlike(f"(?i)(^|/){like}$"))


def get_diagnostics(diagnostics: DataFrame, path: str | None = None) -> DataFrame:
    """All but hidden diagnostics; a path selects files of the same path or name, whatever the case."""
    out = diagnostics.filter("severity <> 'Hidden'")
    return out.filter(names.same_file(F.col("path"), F.lit(path))) if path else out


# --- One file


def code_lists(facts: Facts) -> DataFrame:
    """``(doc_id, namespaces, types, methods, usings)``: what each document declares, in order of its place."""
    listed = lambda rows, name, *c: rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*c))).alias(name))
    n = listed(facts.namespaces, "namespaces", "start", "name", "start_line", "end_line")
    bases = facts.type_edges.groupBy(F.col("src_type").alias("type_id")).agg(
        F.min_by(F.when(F.col("kind") == "base", F.col("dst_name")), "place").alias("base"),
        F.transform(F.sort_array(F.collect_set(F.when(F.col("kind") == "interface", F.struct("place", "dst_name")))), lambda x: x["dst_name"]).alias("interfaces"),
    )
    count = facts.members.groupBy("type_id").agg(F.count("*").alias("n_members"))
    t = facts.types.join(bases, "type_id", "left").join(count, "type_id", "left")
    t = t.withColumns({"interfaces": F.coalesce("interfaces", F.array().cast("array<string>")), "n_members": F.coalesce("n_members", F.lit(0))})
    t = listed(t, "types", "start", "name", "kind", "modifiers", "base", "interfaces", "n_members", "start_line", "end_line")
    m = facts.members.filter("kind = 'method'").withColumn("params", F.transform(F.coalesce("params", F.array().cast(facts.members.schema["params"].dataType)), lambda p: F.concat_ws(" ", p["type"], p["name"])))
    m = listed(m, "methods", "start", "name", "modifiers", F.col("type_text").alias("returns"), "params", "start_line", "end_line")
    u = listed(facts.usings, "usings", "start", "name", "is_static", "alias")
    out = facts.documents.select("doc_id")
    for part in (n, t, m, u):
        out = out.join(part, "doc_id", "left")
    return out


def analyze_code(facts: Facts) -> DataFrame:
    """Counts of each document: usings, namespaces, types, methods and statements."""
    of = lambda *k: F.count_if(F.col("kind").isin(*k))
    return facts.nodes.groupBy("doc_id").agg(
        of("UsingDirective").alias("usings"), of(*NAMESPACE_KINDS).alias("namespaces"), of(*TYPE_KINDS).alias("types"),
        of("MethodDeclaration").alias("methods"), (of("CompilationUnit") > 0).alias("has_compilation_unit"),
        F.count_if(F.col("kind").endswith("Statement")).alias("statements"), F.max("depth").alias("max_depth"), F.count("*").alias("nodes"),
    )


def hierarchy(facts: Facts) -> DataFrame:
    """``(doc_id, namespace, types)``: types with the names of their members, in order of their place."""
    per = facts.members.groupBy("type_id").agg(F.sort_array(F.collect_list(F.struct("start", "name"))).alias("m"))
    t = facts.types.join(per, "type_id", "left")
    named = F.struct("start_line", "name", F.transform("m", lambda x: x["name"]).alias("members"))
    return t.groupBy("doc_id", "namespace").agg(F.sort_array(F.collect_list(named)).alias("types"))


def get_syntax_tree(facts: Facts, doc_id: str | None, span: tuple[int, int] | None = None, max_depth: int = 100, trivia: bool = False) -> DataFrame:
    """Nodes of a document, or of all, to a depth, of which spans touching ``span`` (start, end), with a property map."""
    out = facts.nodes.filter(F.col("depth") <= max_depth)
    if doc_id is not None:
        out = out.filter(F.col("doc_id") == doc_id)
    if not trivia:
        out = out.filter(~F.col("kind").isin("Comment", "DocumentationComment", "Directive", "Error"))
    if span:
        out = out.filter((F.col("start") <= span[1]) & (F.col("start") + F.col("length") >= span[0]))
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in (("Identifier", "ident"), ("Modifiers", "modifiers"), ("Type", "type_text"))))
    return out.withColumn("properties", F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull())))


def tree_structure(facts: Facts) -> DataFrame:
    """The nodes right below each root, with depths from 0, and the numbers of nodes below them."""
    top = facts.nodes.filter("parent_id = 0 and kind not in ('Comment', 'DocumentationComment', 'Directive', 'Error')")
    top = top.select("doc_id", "node_id", "kind", "ident", "start", "length", F.lit(0).alias("depth"))
    below = facts.nodes.select("doc_id", F.col("start").alias("s"), (F.col("start") + F.col("length")).alias("e"), F.col("node_id").alias("n"), "ancestors")
    below = below.filter(F.size("ancestors") > 1).join(top.select("doc_id", "node_id", "start", "length"), "doc_id")
    below = below.filter("s >= start and e <= start + length and n <> node_id").groupBy("doc_id", "node_id").agg(F.count("*").alias("below"))
    return top.join(below, ["doc_id", "node_id"], "left").withColumn("below", F.coalesce("below", F.lit(0)))


def node_errors(facts: Facts, kinds: tuple[str, ...] = TYPE_KINDS) -> DataFrame:
    """``(doc_id, node_id, id, message, at)``: syntax errors that lie in a node of some kinds."""
    wrong = facts.nodes.filter("kind = 'Error'").select("doc_id", F.col("ident").alias("id"), F.col("detail").alias("message"), F.col("start").alias("at"))
    inside = facts.nodes.filter(F.col("kind").isin(*kinds)).select("doc_id", "node_id", "start", "length")
    return inside.join(wrong, "doc_id").filter("start <= at and at <= start + length").select("doc_id", "node_id", "id", "message", "at")


def node_at(facts: Facts, points: DataFrame) -> DataFrame:
    """The innermost node at each point (doc_id, offset): an equi-join by document with containment."""
    inside = points.join(facts.nodes, "doc_id").filter("start <= offset and offset <= start + length")
    best = F.max_by(F.struct(*(c for c in facts.nodes.columns if c != "doc_id")), F.struct("start", "depth"))
    return inside.groupBy("doc_id", "offset").agg(best.alias("n")).select("doc_id", "offset", "n.*")


def offsets(documents: DataFrame, points: DataFrame) -> DataFrame:
    """Points (doc_id, line, column) as offsets; lines that a document lacks are dropped."""
    lines = F.split("content", "\n")
    rows = points.join(documents.select("doc_id", "content"), "doc_id").filter(F.col("line") < F.size(lines))
    before = F.aggregate(F.slice(F.transform(lines, lambda x: F.length(x) + 1), F.lit(1), F.col("line")), F.lit(0), lambda a, x: a + x)
    return rows.select("doc_id", "line", "column", (before + F.col("column")).cast("int").alias("offset"))


def symbols(facts: Facts) -> DataFrame:
    """Types, members and locals as one table."""
    nothing = lambda name, kind="string": F.lit(None).cast(kind).alias(name)
    t = facts.types.select(
        F.col("type_id").alias("symbol_id"), "doc_id", "name", "kind", "namespace", nothing("type_name"), "accessibility",
        "is_static", "is_abstract", "start_line", "end_line", nothing("type_text"), "name_start",
    )
    m = facts.members.select(
        F.col("member_id").alias("symbol_id"), "doc_id", "name", "kind", "namespace", "type_name", "accessibility", "is_static",
        "is_abstract", "start_line", "end_line", "type_text", "name_start",
    )
    kind = F.when(F.col("node_kind") == "Parameter", "parameter").otherwise("local")
    v = facts.declared.select(
        "symbol_id", "doc_id", "name", kind.alias("kind"), nothing("namespace"), nothing("type_name"), nothing("accessibility"), F.lit(False).alias("is_static"),
        F.lit(False).alias("is_abstract"), F.col("line").alias("start_line"), F.col("line").alias("end_line"), "type_text", "name_start",
    )
    return t.unionByName(m).unionByName(v)


def symbols_at(facts: Facts, points: DataFrame) -> DataFrame:
    """Symbols that the name at each point (doc_id, line, column) is bound to, with their number."""
    at = offsets(facts.documents, points)
    refs = facts.refs.select("doc_id", "symbol_id", F.col("start").alias("s"), F.col("length").alias("n"), "n_candidates")
    found = at.join(refs, "doc_id").filter("s <= offset and offset <= s + n")
    # Between two names that touch, the one that begins at the point counts.
    best = found.groupBy("doc_id", "offset").agg(F.max("s").alias("s"))
    found = found.join(best, ["doc_id", "offset", "s"]).select("doc_id", "line", "column", "symbol_id", "n_candidates").distinct()
    return found.join(symbols(facts).withColumnRenamed("doc_id", "symbol_doc"), "symbol_id")


def documentation(facts: Facts) -> DataFrame:
    """``(symbol_id, documentation)``: the whole comment right above each declaration and its attributes."""
    place = ("doc_id", "node_id", "start_line")
    own = facts.types.select(*place).unionByName(facts.members.select(*place))
    lists = facts.nodes.filter("kind = 'AttributeList'").select("doc_id", "node_id", "line", "end_line")
    marked = attribute_owners(facts).join(lists.withColumnRenamed("node_id", "list_id"), ["doc_id", "list_id"]).groupBy("doc_id", "node_id").agg(F.min("line").alias("first"))
    own = own.join(marked, ["doc_id", "node_id"], "left").select("doc_id", "node_id", (F.least("start_line", "first") - 1).alias("last"))
    # Comments on lines that follow each other form a block; it belongs to the declaration below its last line.
    rows = facts.nodes.filter("kind = 'DocumentationComment'").select("doc_id", "line", "detail")
    block = F.col("line") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))
    blocks = rows.withColumn("block", block).groupBy("doc_id", "block").agg(
        F.max("line").alias("last"), F.sort_array(F.collect_list(F.struct("line", F.regexp_replace("detail", r"^///\s?|\s+$", "").alias("t")))).alias("c")
    )
    doc = F.array_join(F.transform("c", lambda x: x["t"]), "\n")
    return own.join(blocks, ["doc_id", "last"]).select(F.concat_ws(":", "doc_id", "node_id").alias("symbol_id"), text.xml_doc(doc).alias("documentation"))


def get_symbol_info(facts: Facts, points: DataFrame) -> DataFrame:
    """What stands behind a name: kind, type, accessibility, and the documentation in front of it."""
    return symbols_at(facts, points).join(documentation(facts), "symbol_id", "left")


def resolve_symbol(facts: Facts, points: DataFrame, overrides_too: bool = False, aliases: bool = False) -> DataFrame:
    """As ``get_symbol_info``; also the members it overrides, and what an alias at the point stands for."""
    out = get_symbol_info(facts, points).withColumn("relation", F.lit("self"))
    if overrides_too:
        up = overrides(facts).select(F.col("member_id").alias("symbol_id"), F.col("base_member").alias("to"))
        more = symbols_at(facts, points).select("symbol_id", "doc_id", "line", "column", "n_candidates").join(up, "symbol_id")
        more = more.drop("symbol_id").withColumnRenamed("to", "symbol_id").join(symbols(facts).withColumnRenamed("doc_id", "symbol_doc"), "symbol_id")
        out = out.unionByName(more.join(documentation(facts), "symbol_id", "left").withColumn("relation", F.lit("override")))
    if aliases:
        at = node_at(facts, offsets(facts.documents, points).select("doc_id", "offset")).filter("kind = 'IdentifierName'")
        at = at.select("doc_id", "offset", "ident").join(offsets(facts.documents, points), ["doc_id", "offset"])
        named = facts.usings.filter("alias is not null").select("doc_id", F.col("alias").alias("ident"), F.col("name").alias("full_name"))
        full = F.concat_ws(".", F.nullif("namespace", F.lit(plans.GLOBAL)), "name")
        known = facts.types.select("type_id", full.alias("full_name"))
        hit = at.join(named, ["doc_id", "ident"]).join(known, "full_name").select("doc_id", "line", "column", F.col("type_id").alias("symbol_id"), F.lit(1).cast("long").alias("n_candidates"))
        hit = hit.join(symbols(facts).withColumnRenamed("doc_id", "symbol_doc"), "symbol_id").join(documentation(facts), "symbol_id", "left")
        out = out.unionByName(hit.withColumn("relation", F.lit("alias")))
    return out


def go_to_definition(facts: Facts, points: DataFrame) -> DataFrame:
    """Where a name is declared; partial types give every declaration."""
    return symbols_at(facts, points).select("doc_id", "line", "column", "symbol_id", "name", "kind", "symbol_doc", "start_line", "end_line", "n_candidates")


def find_references(facts: Facts, points: DataFrame) -> DataFrame:
    """Uses and declarations of the symbol at each point, with the trimmed line they stand in."""
    found = symbols_at(facts, points).select(F.col("doc_id").alias("from_doc"), F.col("line").alias("from_line"), F.col("column").alias("from_column"), "symbol_id", "name")
    rows = found.join(references(facts), "symbol_id")
    rows = rows.select("from_doc", "from_line", "from_column", "symbol_id", "name", "doc_id", "start", "line", "column", "is_definition").distinct()
    context = F.trim(F.get(F.split("content", "\n"), F.col("line")))
    more = [c for c in ("path",) if c in facts.documents.columns]
    return rows.join(facts.documents.select("doc_id", *more, "content"), "doc_id").withColumn("context", context).drop("content")


def references(facts: Facts) -> DataFrame:
    """All bound names and declarations, with the line and column of the name."""
    lines = F.split(F.left("content", F.col("start")), "\n")
    declared = facts.refs.filter("is_definition").drop("line", "column", "end_line", "end_column").join(facts.documents.select("doc_id", "content"), "doc_id")
    declared = declared.withColumns({"line": F.size(lines) - 1, "column": F.length(F.element_at(lines, -1))}).drop("content")
    declared = declared.withColumns({"end_line": F.col("line"), "end_column": F.col("column") + F.col("length")})
    return facts.refs.filter("not is_definition").unionByName(declared)


def find_declarations(facts: Facts, points: DataFrame) -> DataFrame:
    """Declarations of the symbol, of what it overrides, and of interface members it implements."""
    found = symbols_at(facts, points).select("symbol_id", "name").distinct()
    up = overrides(facts).select(F.col("member_id").alias("symbol_id"), F.col("base_member").alias("to"), F.lit("override").alias("relation"))
    faces = implementations(facts).select(F.col("member_id").alias("symbol_id"), F.col("interface_member").alias("to"), F.lit("interface").alias("relation"))
    extra = facts.members.filter("is_extension").select(F.col("member_id").alias("symbol_id"), F.col("member_id").alias("to"), F.lit("extension").alias("relation"))
    own = found.select("symbol_id", F.col("symbol_id").alias("to"), F.lit("self").alias("relation"))
    rows = own.unionByName(found.join(up.unionByName(faces).unionByName(extra), "symbol_id").select("symbol_id", "to", "relation"))
    at = symbols(facts).select(F.col("symbol_id").alias("to"), "doc_id", "name", "start_line")
    return rows.join(at, "to")


def get_definition_and_references(facts: Facts, points: DataFrame) -> DataFrame:
    """One row a point and symbol: where it is declared, and the places that use it, in order."""
    key = ("from_doc", "from_line", "from_column", "symbol_id", "name")
    place = F.struct("doc_id", "line", "column", "context")
    some = lambda c: F.sort_array(F.collect_list(F.when(c, place)))
    return find_references(facts, points).groupBy(*key).agg(some(F.col("is_definition")).alias("definitions"), some(~F.col("is_definition")).alias("references"))


def get_semantic_model(facts: Facts, points: DataFrame, own_private: bool = True) -> DataFrame:
    """Symbols in scope at each point.

    Members of the type around it, and of its bases those that aren't private; types of the namespace
    around it and of the outer ones; and locals declared before the point in the same member. Without
    ``own_private`` the type's own private members are left out too.
    """
    at = offsets(facts.documents, points).select("doc_id", "offset")
    inside = lambda rows: at.join(rows.withColumnsRenamed({"start": "s", "length": "n"}), "doc_id").filter("s <= offset and offset <= s + n")
    around = inside(facts.types.select("doc_id", "start", "length", "type_id", "namespace")).select("doc_id", "offset", "type_id", "namespace")
    held = facts.members.filter("kind not in ('constructor', 'destructor')").select(F.col("type_id").alias("base_id"), "name", "kind", "accessibility")
    members = around.join(facts.bases, "type_id").join(held, "base_id")
    open_ = "accessibility <> 'private'" + (" or distance = 0" if own_private else "")
    members = members.filter(open_).select("doc_id", "offset", "name", "kind", "accessibility")
    spaces = inside(facts.namespaces.select("doc_id", "start", "length", F.col("name").alias("namespace"))).select("doc_id", "offset", "namespace")
    spaces = spaces.unionByName(at.withColumn("namespace", F.lit(plans.GLOBAL))).distinct()
    near = facts.scopes.filter(F.col("rank") < (1 << 20)).select("doc_id", "namespace", "target")
    types = spaces.join(near, ["doc_id", "namespace"]).select("doc_id", "offset", F.col("target").alias("namespace")).distinct()
    types = types.join(facts.types.select("namespace", "name", "kind", "accessibility"), "namespace")
    body = inside(facts.members.select("doc_id", "start", "length", "node_id")).select("doc_id", "offset", F.col("node_id").alias("member_node"))
    local = body.join(facts.declared, ["doc_id", "member_node"]).filter("name_start < offset")
    kind = F.when(F.col("node_kind") == "Parameter", "parameter").otherwise("local")
    local = local.select("doc_id", "offset", "name", kind.alias("kind"), F.lit(None).cast("string").alias("accessibility"))
    return members.unionByName(types.select("doc_id", "offset", "name", "kind", "accessibility")).unionByName(local).distinct()


def get_completion_list(facts: Facts, points: DataFrame, prefix: str = "", trigger: str = "invoked") -> DataFrame:
    """Names in scope that begin with a prefix, whatever the case; after a dot (``trigger``) only members."""
    rows = get_semantic_model(facts, points).filter(F.lower("name").startswith(prefix.lower()))
    if trigger == "dot":
        rows = rows.filter("kind in ('method', 'property', 'field', 'event')")
    return rows.orderBy("doc_id", "offset", "name")


def type_info(type_text: Column) -> Column:
    """What a type's text says: its name, and whether it is a value, reference, generic, nullable or dynamic type.

    Names without a keyword count as references; only a compiler knows structures by their name.
    """
    bare = F.regexp_extract(type_text, r"^([\w.]+)", 1)
    names_ = F.create_map(*(F.lit(x) for kv in TYPE_NAMES.items() for x in kv))
    array = type_text.endswith("]")
    plain = F.element_at(names_, bare)
    value = bare.isin(*(k for k in TYPE_NAMES if k not in ("string", "object", "void"))) & ~array
    return F.struct(
        F.coalesce(plain, F.substring_index(bare, ".", -1)).alias("name"), value.alias("is_value"), (~value & (bare != "void")).alias("is_reference"),
        type_text.contains("<").alias("is_generic"), nullability(type_text).alias("is_nullable"), (bare == "dynamic").alias("is_dynamic"),
    )


def infer_types(facts: Facts, points: DataFrame) -> DataFrame:
    """The type of the member, local or literal at each point; one that isn't written follows from the first value."""
    at = offsets(facts.documents, points)
    told = facts.locals.select("symbol_id", "value_type")
    named = symbols_at(facts, points).join(told, "symbol_id", "left").withColumn("type_text", F.coalesce("value_type", "type_text"))
    named = named.filter("type_text is not null").select("doc_id", "line", "column", "type_text")
    known = constants(facts).select("doc_id", F.col("start").alias("s"), F.col("length").alias("n"), F.col("type").alias("type_text"))
    fixed = at.join(known, "doc_id").filter("s <= offset and offset <= s + n").select("doc_id", "line", "column", "type_text")
    return named.unionByName(fixed).distinct().withColumn("type", type_info(F.col("type_text")))


def resolve_member(facts: Facts, type_name: str, member: str) -> DataFrame:
    """The first member of a name in a type; for an accessor's name, its property or event."""
    rows = facts.members.filter(F.col("type_name") == type_name)
    own = F.regexp_extract(F.lit(member), r"^(?:get|set|add|remove)_(\w+)$", 1)
    rank = F.when(F.col("name") == member, 0).when((F.col("name") == own) & F.col("kind").isin("property", "event"), 1)
    return rows.withColumn("rank", rank).filter("rank is not null").orderBy("rank", "doc_id", "start").limit(1).drop("rank")


def method_groups(facts: Facts) -> DataFrame:
    """Overloads: methods of one name in one type."""
    return facts.members.filter("kind = 'method'").groupBy("type_id", "name").agg(F.count("*").alias("overloads"), F.sort_array(F.collect_list("member_id")).alias("members"))


def extension_methods(facts: Facts) -> DataFrame:
    """Extension methods that a document's usings or namespaces bring into scope."""
    seen = facts.usings.filter("alias is null").select("doc_id", F.col("name").alias("namespace"))
    seen = seen.unionByName(facts.types.select("doc_id", "namespace")).distinct()
    return seen.join(facts.members.filter("is_extension").drop("doc_id"), "namespace").select("doc_id", "namespace", "type_name", "name", "member_id")


def nullability(type_text: Column) -> Column:
    return type_text.endswith("?") | type_text.startswith("Nullable<")


# --- Hierarchies


def _ties(facts: Facts, *kinds: str) -> DataFrame:
    return facts.type_edges.filter(F.col("kind").isin(*kinds)).filter("dst_type is not null and src_type <> dst_type")


def get_type_hierarchy(facts: Facts) -> DataFrame:
    """``(type_id, other, other_name, relation, distance)``: bases, interfaces and derived classes.

    The distance is the least number of steps; a base that no document declares has no id.
    """
    base = graph.base_chain(_ties(facts, "base").select(F.col("src_type").alias("src"), F.col("dst_type").alias("dst")))
    faces = facts.bases.filter("distance > 0").join(facts.types.filter("kind = 'interface'").select(F.col("type_id").alias("base_id")), "base_id")
    name = facts.types.select(F.col("type_id").alias("other"), F.col("name").alias("other_name"))
    rows = base.select(F.col("node").alias("type_id"), F.col("base").alias("other"), F.lit("base").alias("relation"), "distance")
    rows = rows.unionByName(base.select(F.col("base").alias("type_id"), F.col("node").alias("other"), F.lit("derived").alias("relation"), "distance"))
    rows = rows.unionByName(faces.select("type_id", F.col("base_id").alias("other"), F.lit("interface").alias("relation"), "distance"))
    unknown = facts.type_edges.filter("dst_type is null").select(
        F.col("src_type").alias("type_id"), F.lit(None).cast("string").alias("other"), F.col("dst_name").alias("other_name"), F.col("kind").alias("relation"), F.lit(1).alias("distance")
    )
    return rows.join(name, "other").select("type_id", "other", "other_name", "relation", "distance").unionByName(unknown)


def _base_members(facts: Facts, *kinds: str) -> DataFrame:
    ties = _ties(facts, *kinds).select(F.col("src_type").alias("src"), F.col("dst_type").alias("dst"))
    reach = graph.base_chain(ties).select(F.col("node").alias("src"), F.col("base").alias("dst"), "distance")
    kinds_ = F.concat_ws(",", F.transform(F.coalesce("params", F.array().cast(facts.members.schema["params"].dataType)), lambda p: p["type"]))
    rows = facts.members.filter("kind not in ('constructor', 'destructor')").withColumn("kinds", kinds_)
    up = rows.select(F.col("type_id").alias("dst"), F.col("member_id").alias("base_member"), "name", "kinds", F.col("is_virtual").alias("bv"), F.col("is_abstract").alias("ba"), F.col("is_override").alias("bo"))
    own = rows.select(F.col("type_id").alias("src"), "member_id", "name", "kinds", "is_override", "is_static", "accessibility", "explicit_of")
    return reach.join(own, "src").join(up, ["dst", "name", "kinds"])


def overrides(facts: Facts) -> DataFrame:
    """``(member_id, base_member, distance)``: overriding members and the overridable ones of all base types."""
    return _base_members(facts, "base").filter("is_override and (bv or ba or bo)").select("member_id", "base_member", "distance")


def implementations(facts: Facts) -> DataFrame:
    """``(member_id, interface_member, is_explicit)`` by name and types of parameters.

    An explicit implementation counts for the interface that it names, and then no other member of
    the type does.
    """
    face = facts.members.join(facts.types.filter("kind = 'interface'").select("type_id"), "type_id", "left_semi")
    face = face.select(F.col("member_id").alias("base_member"), F.col("type_name").alias("face"))
    rows = _base_members(facts, "base", "interface").join(face, "base_member")
    named = F.substring_index("explicit_of", ".", -1)
    rows = rows.filter(F.col("explicit_of").isNull() | (named == F.col("face"))).withColumn("is_explicit", F.col("explicit_of").isNotNull())
    only = rows.filter("is_explicit").select("src", "base_member").distinct().withColumn("taken", F.lit(True))
    rows = rows.join(only, ["src", "base_member"], "left").filter("is_explicit or taken is null")
    return rows.select("member_id", F.col("base_member").alias("interface_member"), "is_explicit").distinct()


def type_interfaces(facts: Facts) -> DataFrame:
    """``(type_id, interface, members)``: the interfaces of each class or structure, and the members that implement them."""
    own = facts.types.filter("kind <> 'interface'").select("type_id")
    faces = facts.types.filter("kind = 'interface'").select(F.col("type_id").alias("base_id"), F.col("name").alias("interface"))
    pairs = facts.bases.filter("distance > 0").join(own, "type_id", "left_semi").join(faces, "base_id").select("type_id", "base_id", "interface")
    held = facts.members.select(F.col("member_id").alias("interface_member"), F.col("type_id").alias("base_id"), "name")
    done = implementations(facts).join(facts.members.select("member_id", "type_id"), "member_id").join(held, "interface_member")
    done = done.groupBy("type_id", "base_id").agg(F.sort_array(F.collect_set("name")).alias("members"))
    return pairs.join(done, ["type_id", "base_id"], "left").select("type_id", "interface", F.coalesce("members", F.array().cast("array<string>")).alias("members"))


def get_member_hierarchy(facts: Facts) -> DataFrame:
    """``(member_id, other, relation)``: override, interface, same_name_in_bases and hides."""
    same = _base_members(facts, "base")
    row = lambda rows, to, name: rows.select("member_id", F.col(to).alias("other"), F.lit(name).alias("relation"))
    out = row(overrides(facts), "base_member", "override").unionByName(row(implementations(facts), "interface_member", "interface"))
    out = out.unionByName(row(same, "base_member", "same_name_in_bases"))
    return out.unionByName(row(same.filter("not is_override"), "base_member", "hides"))


def overridable_members(facts: Facts) -> DataFrame:
    """``(type_id, base_member, name, ...)``: members of base types that a type could override."""
    reach = facts.bases.filter("distance > 0").select("type_id", F.col("base_id").alias("dst"), "distance")
    up = facts.members.filter("kind in ('method', 'property', 'event') and (is_virtual or is_abstract or is_override) and not is_static and accessibility <> 'private'")
    up = up.join(facts.types.filter("kind = 'interface'").select("type_id"), "type_id", "left_anti")
    up = up.select(F.col("type_id").alias("dst"), F.col("member_id").alias("base_member"), "name", "kind", "type_text", "params", "n_params")
    rows = reach.join(up, "dst")
    # Of a chain of overrides, the nearest counts.
    best = rows.groupBy("type_id", "name", "n_params").agg(F.min("distance").alias("distance"))
    return rows.join(best, ["type_id", "name", "n_params", "distance"]).drop("distance", "dst")


# --- Metrics


def get_code_metrics(facts: Facts) -> DataFrame:
    """Roll-up over document, namespace, type and member: complexity and lines; maintainability of documents."""
    m = plans.metrics_of(facts)
    up = m.rollup("doc_id", "namespace", "type_id", "member_id").agg(F.sum("complexity").alias("complexity"), F.count("*").alias("members"))
    up = up.filter("doc_id is not null")
    spaces = facts.types.groupBy("doc_id").agg(F.countDistinct("namespace").alias("n_namespaces"))
    size = facts.documents.select("doc_id", F.col("n_lines").alias("file_lines"))
    lines = m.select("member_id", "loc").distinct()
    out = up.join(size, "doc_id").join(spaces, "doc_id", "left").join(lines, "member_id", "left")
    index = metrics.maintainability(F.col("file_lines"), F.col("complexity"), F.coalesce("n_namespaces", F.lit(1)))
    return out.select(
        "doc_id", "namespace", "type_id", "member_id", "complexity", "members",
        F.coalesce("loc", F.when(F.col("namespace").isNull(), F.col("file_lines"))).alias("loc"),
        F.when(F.col("namespace").isNull(), index).alias("maintainability"), metrics.complexity_level(F.col("complexity")).alias("level"),
    )


def inheritance_depth(facts: Facts) -> DataFrame:
    """``(type_id, inheritance_depth)``: length of the base chain, the root object included."""
    base = graph.base_chain(_ties(facts, "base").select(F.col("src_type").alias("src"), F.col("dst_type").alias("dst")))
    chain = base.select(F.col("node").alias("type_id"), F.col("base").alias("up"), "distance")
    chain = chain.unionByName(facts.types.select("type_id", F.col("type_id").alias("up"), F.lit(0).alias("distance")))
    # A base without source stands between the last known one and the root object.
    out_there = facts.type_edges.filter("dst_type is null and kind = 'base'").select(F.col("src_type").alias("up"), F.lit(1).alias("more")).distinct()
    depth = chain.join(out_there, "up", "left").groupBy("type_id").agg(F.max(F.col("distance") + F.coalesce("more", F.lit(0)) + 1).alias("inheritance_depth"))
    return facts.types.filter("kind = 'class'").select("type_id").join(depth, "type_id")


def class_coupling(facts: Facts) -> DataFrame:
    """``(type_id, coupling)``: distinct other types among the bases, and the types of members and parameters.

    Types are told apart by what they are bound to; those that no document declares by their name.
    """
    own = facts.types.select("doc_id", "namespace", "type_id")
    parts = F.array_union(F.array(F.coalesce("type_text", F.lit(""))), F.coalesce(F.transform("params", lambda x: x["type"]), F.array().cast("array<string>")))
    said = facts.members.select("type_id", F.explode(parts).alias("t"))
    said = said.unionByName(facts.types.filter("bases is not null").select("type_id", F.col("bases").alias("t")))
    said = said.select("type_id", F.explode(F.regexp_extract_all("t", F.lit(r"[A-Za-z_][\w.]*"), F.lit(0))).alias("full")).distinct()
    said = said.filter(~F.col("full").isin(*names.KEYWORDS, "var", "dynamic")).join(own, "type_id")
    last = F.substring_index("full", ".", -1)
    said = said.select("*", last.alias("name"), F.nullif(F.substring("full", F.lit(1), F.length("full") - F.length(last) - 1), F.lit("")).alias("qualifier"))
    found = bind_types(said, facts.types, facts.scopes, ["type_id", "full"])
    uses = said.select("type_id", "full").join(found, ["type_id", "full"], "left").select("type_id", F.coalesce("found_type", "full").alias("other"))
    return metrics.coupling(uses, "type_id", "other")


def member_metrics(facts: Facts, nested: str = "inclusive") -> DataFrame:
    """Complexity, lines, level and limits of each method and property with its type's depth and coupling."""
    m = plans.metrics_of(facts, nested)
    deep, tied = inheritance_depth(facts), class_coupling(facts)
    out = m.join(deep, "type_id", "left").join(tied, "type_id", "left")
    coupling = F.coalesce("coupling", F.lit(0))
    flags = metrics.threshold_flags(F.col("complexity"), F.coalesce("inheritance_depth", F.lit(0)), coupling, F.lit(100.0))
    return out.withColumns({"coupling": coupling, "level": metrics.complexity_level(F.col("complexity")), "limits": flags})


# --- Calls


def get_caller_info(facts: Facts, methods: DataFrame, indirect: bool = False) -> DataFrame:
    """Call sites of methods (member_id): caller, place, arguments and line; or all methods that reach them."""
    target = methods.select(F.col("member_id").alias("callee_id")).distinct()
    if not indirect:
        sites = facts.calls.join(target, "callee_id", "left_semi").join(facts.documents.select("doc_id", "content"), "doc_id")
        return sites.withColumn("context", F.trim(F.get(F.split("content", "\n"), F.col("line")))).drop("content")
    back = facts.calls.filter("callee_id is not null").select(F.col("callee_id").alias("src"), F.col("caller_id").alias("dst"))
    start = back.join(target.withColumnRenamed("callee_id", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
    return graph.reached(back, start).select(F.col("node").alias("caller_id"))


def members_named(facts: Facts, name: str, type_name: str | None = None) -> DataFrame:
    """``(member_id)`` of the members of a name, of one type if given."""
    rows = facts.members.filter(F.col("name") == name)
    return (rows.filter(F.col("type_name") == type_name) if type_name else rows).select("member_id")


def get_callee_info(facts: Facts, methods: DataFrame, depth: int = 0) -> DataFrame:
    """The tree of calls below methods (member_id); depth 0 means direct calls, callees without source are leaves."""
    e = facts.calls.select(F.col("caller_id").alias("src"), F.coalesce("callee_id", "callee_name").alias("dst"))
    return graph.callees(e, methods.select(F.col("member_id").alias("node")), max(1, depth))


def get_call_graph(facts: Facts, methods: DataFrame, max_depth: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with fan-in and fan-out, call sites, and the lines of the graph in DOT form, from methods (member_id) on."""
    e = facts.calls.filter("callee_id is not null").select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"), "line", "column")
    nodes, sites = graph.call_graph(e, methods.select(F.col("member_id").alias("node")), max_depth)
    label = facts.members.select(F.col("member_id").alias("node"), F.concat_ws(".", "type_name", "name").alias("label"))
    fans = graph.fan(nodes, sites).join(nodes, "node").join(label, "node", "left")
    named = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    ties = sites.select("src", "dst").distinct().join(named("src"), "src").join(named("dst"), "dst")
    return fans, sites, graph.dot_lines(ties.select(F.col("src_label").alias("src"), F.col("dst_label").alias("dst")).distinct())


# --- Imports and generated code


def remove_unused_usings(facts: Facts) -> DataFrame:
    """Usings that no name in the document needs, where the namespace's types are known here.

    A using counts as needed if a type that the document names, or one that has an extension method
    that it calls, lies in its namespace or below it; static usings, aliases and namespaces without a
    known type are left alone.
    """
    spaces = facts.types.select(F.col("type_id").alias("symbol_id"), "namespace").unionByName(
        facts.members.filter("is_extension").select(F.col("member_id").alias("symbol_id"), "namespace")
    )
    used = facts.refs.filter("not is_definition").select("doc_id", "symbol_id").distinct().join(spaces, "symbol_id").select("doc_id", "namespace").distinct()
    parts = F.split("namespace", r"\.")
    under = F.explode(F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), ".")))
    known = facts.types.select(under.alias("name")).distinct()
    open_ = facts.usings.filter("not is_static and alias is null").join(known, "name", "left_semi")
    return open_.join(used.select("doc_id", under.alias("name")).distinct(), ["doc_id", "name"], "left_anti")


def sort_usings(facts: Facts, style: str = "system") -> DataFrame:
    """``(doc_id, content, conflict)``: the i-th using directive's place gets the i-th in order."""
    moved = text.sort_in_place(facts.usings.filter("not is_static and alias is null"), "doc_id", "start", "name", style)
    spans = facts.usings.select("doc_id", "start", "length")
    changes = moved.filter("name <> sorted").join(spans, ["doc_id", "start"])
    edits = changes.select("doc_id", "start", "length", F.concat(F.lit("using "), "sorted", F.lit(";")).alias("new_text"))
    return text.apply_edits(facts.documents, edits, "doc_id", "content")


def organize_imports(facts: Facts, style: str = "system", gap: bool = True) -> DataFrame:
    """``(doc_id, content, conflict)``: without unused usings, sorted, with an empty line between groups.

    The i-th directive left gets the i-th name in order. Static ones and aliases keep their place.
    """
    plain = facts.usings.filter("not is_static and alias is null")
    unused = remove_unused_usings(facts).select("doc_id", "start").withColumn("unused", F.lit(True))
    marked = plain.join(unused, ["doc_id", "start"], "left")
    left = marked.filter("unused is null")
    moved = text.sort_in_place(left, "doc_id", "start", "name", style).select("doc_id", "start", "sorted")
    system = F.col("sorted").startswith("System")
    opens = F.coalesce(F.lag(system).over(Window.partitionBy("doc_id").orderBy("start")) != system, F.lit(False)) & F.lit(gap and style == "system")
    line = F.concat(F.when(opens, "\n").otherwise(""), F.lit("using "), "sorted", F.lit(";"))
    kept = moved.withColumn("new_text", line).join(left.select("doc_id", "start", "length", "name"), ["doc_id", "start"])
    kept = kept.filter(F.col("new_text") != F.concat(F.lit("using "), "name", F.lit(";"))).select("doc_id", "start", "length", "new_text")
    after = facts.documents.select("doc_id", "content")
    gone = marked.filter("unused").join(after, "doc_id")
    end = F.col("start") + F.col("length")
    whole = F.length(F.regexp_extract(F.substring("content", end + 1, F.lit(2)), "^\r?\n", 0))
    gone = gone.select("doc_id", "start", (F.col("length") + whole).alias("length"), F.lit("").alias("new_text"))
    return text.apply_edits(facts.documents, kept.unionByName(gone), "doc_id", "content")


def remove_unused_text(facts: Facts) -> DataFrame:
    """``(doc_id, content, conflict)`` without the unused usings, other lines as they are."""
    gone = remove_unused_usings(facts).join(facts.documents.select("doc_id", "content"), "doc_id")
    whole = F.length(F.regexp_extract(F.substring("content", F.col("start") + F.col("length") + 1, F.lit(2)), "^\r?\n", 0))
    edits = gone.select("doc_id", "start", (F.col("length") + whole).alias("length"), F.lit("").alias("new_text"))
    return text.apply_edits(facts.documents, edits, "doc_id", "content")


def add_missing_imports(facts: Facts, suggestions: dict[str, str] | None = None) -> DataFrame:
    """``(doc_id, namespace)`` to add: of names that nothing in scope declares and a table knows."""
    known_names = {k.lower(): v for k, v in {**KNOWN_TYPES, **(suggestions or {})}.items()}
    known = facts.nodes.sparkSession.createDataFrame(sorted(known_names.items()), "key string, namespace string")
    named = facts.nodes.filter("kind in ('IdentifierName', 'Attribute') and (receiver is null)").select("doc_id", "start", F.col("ident").alias("name"))
    bound = facts.refs.filter("not is_definition").select("doc_id", "start").distinct()
    named = named.join(bound, ["doc_id", "start"], "left_anti").select("doc_id", F.lower("name").alias("key")).distinct()
    wanted = named.join(F.broadcast(known), "key").select("doc_id", "namespace").distinct()  # as many as the table has
    return wanted.join(facts.usings.select("doc_id", F.col("name").alias("namespace")), ["doc_id", "namespace"], "left_anti")


def _listed(params: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(params, F.array().cast("array<struct<start:int,name:string,type:string>>")), lambda p: F.concat_ws(" ", p["type"], p["name"])), ", ")


def _stubs(members: DataFrame, head: str) -> Column:
    method = F.concat(F.lit(f"public {head}"), "type_text", F.lit(" "), "name", F.lit("("), _listed(F.col("params")), F.lit(") => throw new NotImplementedException();"))
    prop = F.concat(F.lit(f"public {head}"), "type_text", F.lit(" "), "name", F.lit(" { get; set; }"))
    event = F.concat(F.lit(f"public {head}event "), "type_text", F.lit(" "), "name", F.lit(";"))
    return F.when(F.col("kind") == "property", prop).when(F.col("kind") == "event", event).otherwise(method)


def generate_interface_impl(facts: Facts, interface: str | None = None) -> DataFrame:
    """``(interface, name, code)``: a stub for each member of an interface, or of all of them."""
    m = facts.members.filter(F.col("kind").isin("method", "property", "event") & ~F.col("is_static"))
    m = m.join(facts.types.filter("kind = 'interface'").select("type_id"), "type_id", "left_semi")
    m = m.filter(F.col("type_name") == interface) if interface else m
    return m.select(F.col("type_name").alias("interface"), "name", _stubs(m, "").alias("code"))


def generate_overrides(facts: Facts, type_name: str | None = None) -> DataFrame:
    """``(type_name, name, code)``: a stub for each member of its bases that a type could override, or for all types."""
    own = facts.types.filter("kind = 'class'").select("type_id", F.col("name").alias("type_name"))
    own = own.filter(F.col("type_name") == type_name) if type_name else own
    rows = overridable_members(facts).join(own, "type_id")
    return rows.select("type_name", "name", _stubs(rows, "override ").alias("code"))


def generate_constructors(fields: DataFrame, base_calls: DataFrame | None = None) -> DataFrame:
    """``(class_name, code)``: a constructor that assigns each field (class_name, place, type, name).

    ``base_calls`` has (class_name, call), the arguments for the base's constructor.
    """
    got = fields.groupBy("class_name").agg(F.sort_array(F.collect_list(F.struct("place", "type", "name"))).alias("f"))
    if base_calls is not None:
        got = got.join(base_calls.select("class_name", "call"), "class_name", "left")
    base = F.when(F.col("call").isNotNull(), F.concat(F.lit(" : base("), "call", F.lit(")"))) if base_calls is not None else F.lit("")
    params = F.array_join(F.transform("f", lambda x: F.concat_ws(" ", x["type"], names.camel(x["name"]))), ", ")
    body = F.array_join(F.transform("f", lambda x: F.concat(F.lit("    _"), names.camel(x["name"]), F.lit(" = "), names.camel(x["name"]), F.lit(";"))), "\n")
    head = F.concat(F.lit("public "), "class_name", F.lit("("), params, F.lit(")"), F.coalesce(base, F.lit("")))
    return got.select("class_name", F.concat(head, F.lit("\n{\n"), body, F.lit("\n}")).alias("code"))


def generate_constructor(spark: SparkSession, class_name: str, fields: list[tuple[str, str]], base_call: list[str] | None = None) -> DataFrame:
    """One row with a constructor that assigns each (type, name) to a field of that name."""
    rows = spark.createDataFrame([(class_name, i, t, n) for i, (t, n) in enumerate(fields)], "class_name string, place int, type string, name string")
    calls = spark.createDataFrame([(class_name, ", ".join(base_call))], "class_name string, call string") if base_call else None
    return generate_constructors(rows, calls).select("code")


def property_code(type_text: Column, name: Column, backing: bool = False, getter: bool = True, setter: bool = True, read_only: bool = False) -> Column:
    """A property of a type and name: automatic, or over a field of its own."""
    field = F.concat(F.lit("_"), names.camel(name))
    head = F.concat(F.lit("public "), type_text, F.lit(" "), name, F.lit(" { "))
    if backing:
        get = F.concat(F.lit("get => "), field, F.lit("; ")) if getter else F.lit("")
        set_ = F.concat(F.lit("set => "), field, F.lit(" = value; ")) if setter and not read_only else F.lit("")
        return F.concat(F.lit("private "), type_text, F.lit(" "), field, F.lit(";\n"), head, get, set_, F.lit("}"))
    both = "get; }" if getter and read_only else "get; set; }" if getter and setter else "get; private set; }" if getter else "set; }"
    return F.concat(head, F.lit(both))


def generate_property(spark: SparkSession, type_text: str, name: str, **flags: bool) -> str:
    row = spark.createDataFrame([(type_text, name)], "t string, n string")
    return row.select(property_code(F.col("t"), F.col("n"), **flags).alias("code")).first()["code"]


def generate_deconstructors(fields: DataFrame) -> DataFrame:
    """``(class_name, code)``: a Deconstruct method with an out parameter for each field (class_name, place, type, name)."""
    got = fields.groupBy("class_name").agg(F.sort_array(F.collect_list(F.struct("place", "type", "name"))).alias("f"))
    head = F.array_join(F.transform("f", lambda x: F.concat(F.lit("out "), x["type"], F.lit(" "), names.camel(x["name"]))), ", ")
    body = F.array_join(F.transform("f", lambda x: F.concat(F.lit("    "), names.camel(x["name"]), F.lit(" = "), x["name"], F.lit(";\n"))), "")
    return got.select("class_name", F.concat(F.lit("public void Deconstruct("), head, F.lit(")\n{\n"), body, F.lit("}")).alias("code"))


def generate_deconstructor(spark: SparkSession, fields: list[tuple[str, str]]) -> str:
    rows = spark.createDataFrame([("", i, t, n) for i, (t, n) in enumerate(fields)], "class_name string, place int, type string, name string")
    return generate_deconstructors(rows).first()["code"]


def generate_from_usage(facts: Facts) -> DataFrame:
    """``(callee_name, code)``: a method for each call without a known one, by number of arguments."""
    rows = facts.calls.filter("callee_id is null").select("callee_name", F.size("args").alias("n")).distinct()
    params = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat(F.lit("object param"), i.cast("string"))), ", ")
    head = F.concat(F.lit("public void "), "callee_name", F.lit("("), F.when(F.col("n") > 0, params).otherwise(""), F.lit(")"))
    return rows.select("callee_name", F.concat(head, F.lit(" => throw new NotImplementedException();")).alias("code"))


#: Generators of code by name; each takes the relations and its own arguments, and gives rows with ``code``.
GENERATORS: dict[str, Callable[..., DataFrame]] = {
    "interface": generate_interface_impl, "override": generate_overrides, "from_usage": generate_from_usage,
}


def generate(facts: Facts, generator: str, /, **arguments) -> DataFrame:
    """The rows of a generator; KeyError for an unknown one."""
    return GENERATORS[generator](facts, **arguments)


def generate_declaration(kind: str, name: str) -> str:
    """A declaration for a name in use that isn't a method."""
    shapes = {
        "class": "public class {0}\n{{\n}}", "interface": "public interface {0}\n{{\n}}",
        "property": "public object {0} {{ get; set; }}", "field": "private object _{0};",
    }
    if kind not in shapes:
        raise ValueError(f"no declaration of kind {kind}")
    return shapes[kind].format(name)


# --- Fixes, actions and changes


def quick_fixes(diagnostics: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """Diagnostics, of those whose span holds a point (doc_id, line, column) if given, with what could be done."""
    known = F.create_map(*(F.lit(x) for kv in QUICK_FIXES.items() for x in kv))
    title = F.coalesce(F.element_at(known, F.col("id")), F.concat(F.lit("Fix "), F.col("id")))
    rows = diagnostics
    if points is not None:
        at = F.struct("line", "column")
        inside = (F.struct("start_line", "start_column") <= at) & (at <= F.struct("end_line", "end_column"))
        rows = rows.join(points, "doc_id").filter(inside)
    return rows.withColumn("fix", title)


def scoped_diagnostics(diagnostics: DataFrame, diagnostic_id: str, scope: str, value: str | None = None) -> DataFrame:
    """Number of diagnostics of an id and of distinct documents, in a document, a project or everywhere."""
    rows = diagnostics.filter(F.col("id") == diagnostic_id)
    if scope in ("document", "project"):
        rows = rows.filter(F.col("path" if scope == "document" else "project") == value)
    return rows.agg(F.count("*").alias("diagnostics"), F.countDistinct("doc_id").alias("documents"))


def accessibility(kind: Column, wanted: str = "public") -> Column:
    """The modifier that a declaration of a kind gets: classes are always public."""
    word = wanted.lower() if wanted.lower() in ("public", "private", "protected", "internal") else "public"
    return F.when(kind == "ClassDeclaration", "public").when(kind.isin("MethodDeclaration", "FieldDeclaration", "PropertyDeclaration"), word)


def set_accessibility(facts: Facts, targets: DataFrame, wanted: str) -> DataFrame:
    """``(doc_id, content, conflict)``: each target (doc_id, node_id) with one modifier in place of all it has."""
    rows = facts.nodes.join(targets.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi").join(facts.documents.select("doc_id", "content"), "doc_id")
    one = "(?:public|private|protected|internal|static|abstract|sealed|virtual|override|async|readonly|const|new|extern|unsafe|partial|volatile|required|file)"
    head = F.length(F.regexp_extract(F.substring("content", F.col("start") + 1, F.col("length")), rf"^(?:{one}\s+)*", 0))
    word = accessibility(F.col("kind"), wanted)
    edits = rows.filter(word.isNotNull()).select("doc_id", "start", head.alias("length"), F.concat(word, F.lit(" ")).alias("new_text"))
    return text.apply_edits(facts.documents, edits, "doc_id", "content")


list_refactorers = rewrites.catalog


def get_code_actions(spark: SparkSession, categories: list[str] | None = None) -> DataFrame:
    rows = rewrites.catalog(spark)
    return rows.filter(F.col("category").isin(*categories)) if categories else rows


def get_refactorings(facts: Facts, doc_id: str, span: tuple[int, int]) -> DataFrame:
    """Rewrites that apply to a kind of node in a span."""
    kinds = get_syntax_tree(facts, doc_id, span).select("kind").distinct()
    rows = rewrites.catalog(facts.nodes.sparkSession).withColumn("kind", F.explode("applies_to"))
    return rows.join(kinds, "kind", "left_semi").select("category", "name").distinct().orderBy("category", "name")


def refactor(documents: DataFrame, rule: str, targets: DataFrame | None = None, /, **arguments) -> DataFrame:
    """``(doc_id, content, conflict)`` after a rewrite at each target (see :func:`rewrites.edits`); nothing is written."""
    return rewrites.applied(documents, rewrites.edits(documents, rule, targets, **arguments))


def rename(facts: Facts, targets: DataFrame, in_comments: bool = False, in_strings: bool = False) -> DataFrame:
    """Edits that rename the symbol at each target (doc_id, offset, new_name) in all documents.

    Uses, declarations, constructors of a type, and the members that override or implement a member or
    are overridden by it all follow; in documents that have one of them, also comments and strings,
    as plain text, if asked. A target without a symbol, a name that is no identifier, or one that the
    symbol's type or namespace already has gives a row with an error. Rows: :data:`rewrites.EDIT_SCHEMA`.
    """
    refs = facts.refs.select("doc_id", "start", "length", "symbol_id")
    asked = targets.select("doc_id", "offset", "new_name")
    at = asked.join(refs, "doc_id").filter("start <= offset and offset <= start + length")
    at = at.join(at.groupBy("doc_id", "offset").agg(F.max("start").alias("start")), ["doc_id", "offset", "start"])
    at = at.join(symbols(facts).select("symbol_id", "name", "kind", "namespace", "type_name"), "symbol_id")
    inside = facts.members.select("namespace", F.col("type_name").alias("owner"), F.col("name").alias("new_name")).unionByName(
        facts.types.select("namespace", F.lit("").alias("owner"), F.col("name").alias("new_name"))
    ).distinct().withColumn("taken", F.lit(True))
    at = at.withColumn("owner", F.coalesce("type_name", F.lit(""))).join(inside, ["namespace", "owner", "new_name"], "left")
    wrong = (
        F.when(F.col("symbol_id").isNull(), "INVALID_SYMBOL_LOCATION").when(~names.is_identifier(F.col("new_name")), "INVALID_NAME")
        .when(F.col("kind").isin("constructor", "destructor"), "INVALID_SYMBOL_LOCATION").when(F.col("taken"), "NAME_CONFLICT")
    )
    at = written(asked.join(at.drop("new_name", "length", "start", "owner", "taken").join(
        at.select("doc_id", "offset", "symbol_id", "taken").distinct(), ["doc_id", "offset", "symbol_id"]), ["doc_id", "offset"], "left").withColumn("error", wrong), "targets")
    good = at.filter("error is null").select("symbol_id", "name", "new_name").distinct()
    # Members that override or implement each other go together.
    tied = overrides(facts).select("member_id", F.col("base_member").alias("other")).unionByName(
        implementations(facts).filter("not is_explicit").select("member_id", F.col("interface_member").alias("other"))
    )
    family = connected_components(tied, "member_id", "other")
    of = family.join(good.select(F.col("symbol_id").alias("node"), "name", "new_name"), "node").select("component", "name", "new_name")
    more = family.join(of, "component").select(F.col("node").alias("symbol_id"), "name", "new_name")
    own = facts.members.filter("kind in ('constructor', 'destructor')").select("type_id", F.col("member_id").alias("made"))
    made = good.join(own, good.symbol_id == own.type_id).select(F.col("made").alias("symbol_id"), "name", "new_name")
    all_ = good.unionByName(more).unionByName(made).distinct()
    edits = refs.join(all_, "symbol_id").select("doc_id", "start", "length", F.col("new_name").alias("new_text")).distinct()
    kinds = ("Comment", "DocumentationComment") * in_comments + ("StringLiteralExpression",) * in_strings
    if kinds:
        touched = refs.join(all_, "symbol_id").select("doc_id", "name", "new_name").distinct()
        said = facts.nodes.filter(F.col("kind").isin(*kinds)).select("doc_id", "start", "detail").join(touched, "doc_id")
        parts = F.split("detail", F.concat(F.lit("\\Q"), "name", F.lit("\\E")))
        gaps = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: F.length(x))
        upto = F.transform(gaps, lambda _, i: F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x) + i * F.length("name"))
        plain = said.select("doc_id", F.explode(F.transform(upto, lambda x: x + F.col("start"))).alias("start"), F.length("name").alias("length"), F.col("new_name").alias("new_text"))
        edits = edits.unionByName(plain).distinct()
    failed = at.filter("error is not null").select("doc_id", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("string").alias("new_text"), "error").distinct()
    return edits.withColumn("error", F.lit(None).cast("string")).unionByName(failed)


def preview(documents: DataFrame, found: DataFrame, context: int = 3) -> DataFrame:
    """Per document with edits: their number and kinds, an error, and the hunks of the change as text."""
    after = rewrites.applied(documents, found).withColumnRenamed("content", "after")
    kind = F.when(F.col("length") == 0, "Insert").when(F.col("new_text") == "", "Delete").when(F.col("start").isNotNull(), "Replace")
    count = found.groupBy("doc_id").agg(
        F.count("start").alias("edits"), F.sort_array(F.collect_set(kind)).alias("kinds"), F.first("error", True).alias("error")
    )
    pairs = documents.select("doc_id", "content").join(after.select("doc_id", "after"), "doc_id")
    cut = text.hunks(pairs, "doc_id", "content", "after", context)
    diff = text.unified_text(cut, "doc_id", F.concat(F.lit("a/"), F.col("doc_id")), F.concat(F.lit("b/"), F.col("doc_id")))
    return count.join(diff, "doc_id", "left")


def edit_previews(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Each edit with its kind and its old and new text, both cut for display after 100 characters."""
    rows = found.filter("error is null").join(documents.select("doc_id", "content"), "doc_id")
    old = F.substring("content", F.col("start") + 1, F.col("length"))
    kind = F.when(F.col("length") == 0, "Insert").when(F.col("new_text") == "", "Delete").otherwise("Replace")
    return rows.select("doc_id", "start", kind.alias("kind"), names.preview(old).alias("old_text"), names.preview(F.col("new_text")).alias("new_text"))


def result_json(documents: DataFrame, found: DataFrame, applied: bool = False) -> DataFrame:
    """One row with the result of a rewrite as JSON: failed, done, or a preview of the changes."""
    edits = edit_previews(documents, found)
    files = edits.groupBy("doc_id").agg(
        F.count("*").alias("changeCount"), F.sort_array(F.collect_list(F.struct("start", "kind", F.col("old_text").alias("oldText"), F.col("new_text").alias("newText")))).alias("changes")
    )
    body = files.agg(
        F.count("*").alias("affectedFileCount"), F.coalesce(F.sum("changeCount"), F.lit(0)).alias("totalChangeCount"),
        F.sort_array(F.collect_list(F.struct(F.col("doc_id").alias("filePath"), "changeCount", "changes"))).alias("fileChanges"),
    )
    error = found.agg(F.first("error", True).alias("error"))
    one = F.lit(1).alias("one")
    row = body.select("*", one).join(error.select("*", one), "one")  # one row each
    done = F.to_json(F.struct(F.lit(True).alias("success"), F.lit(False).alias("isPreview")))
    shown = F.to_json(F.struct(F.lit(True).alias("success"), F.lit(True).alias("isPreview"), "affectedFileCount", "totalChangeCount", "fileChanges"))
    failed = F.to_json(F.struct(F.lit(False).alias("success"), "error", F.lit(False).alias("isPreview")))
    return row.select(F.when(F.col("error").isNotNull(), failed).otherwise(done if applied else shown).alias("response"))


def validated(documents: DataFrame) -> DataFrame:
    """``(doc_id, is_valid, errors)``: documents parsed again, with their syntax errors."""
    wrong = csharp.syntax_nodes(documents).filter("kind = 'Error'").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", F.col("ident").alias("id"), F.col("detail").alias("message")))).alias("errors"))
    out = documents.select(F.col("doc_id").cast("string").alias("doc_id")).join(wrong, "doc_id", "left")
    return out.select("doc_id", F.col("errors").isNull().alias("is_valid"), "errors")


def flow_units(facts: Facts) -> DataFrame:
    """The statements of all members with what control and data flow tell of them; see :func:`factlake.plans.flow.units`."""
    return flow.units(facts.documents)


def unreachable(facts: Facts) -> DataFrame:
    """``(doc_id, node_id, kind, start, length)``: the statements that control can't reach."""
    return flow_units(facts).filter("not reachable and kind <> 'LocalFunctionStatement'").select("doc_id", "node_id", "kind", "start", "length")


def data_flow(facts: Facts, spans: DataFrame) -> DataFrame:
    """For each span (doc_id, begin, stop): locals by what happens to them inside and outside of it, and what flows in and out.

    ``declared``, ``read_inside``, ``written_inside``, ``read_outside`` and ``written_outside`` go by places.
    ``flows_in`` are locals whose value from before the span may be read in it, ``flows_out`` those whose
    value from the span may be read after it.
    """
    uses = facts.local_uses.join(facts.nodes.filter("kind = 'IdentifierName'").select("doc_id", "start", F.col("detail").alias("how")), ["doc_id", "start"])
    own = facts.declared.select("symbol_id", "name", "member_node", "name_start")
    uses = uses.join(own, "symbol_id")
    members = facts.members.select("doc_id", F.col("node_id").alias("member_node"), F.col("start").alias("ms"), (F.col("start") + F.col("length")).alias("me"))
    inside = spans.join(members, "doc_id").filter("ms <= begin and stop <= me").join(uses, ["doc_id", "member_node"])
    within, writes = F.col("start").between(F.col("begin"), F.col("stop")), F.coalesce(F.col("how") == "write", F.lit(False))
    some = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("name"))))
    by_place = inside.groupBy("doc_id", "begin", "stop").agg(
        some(F.col("name_start").between(F.col("begin"), F.col("stop"))).alias("declared"), some(within & ~writes).alias("read_inside"),
        some(within & writes).alias("written_inside"), some(~within & ~writes).alias("read_outside"), some(~within & writes).alias("written_outside"),
    )
    units = written(flow.units(facts.documents.join(spans.select("doc_id").distinct(), "doc_id", "left_semi")), "units")
    key = ["doc_id", "begin", "stop"]
    here = units.join(spans, "doc_id").filter("begin <= start and start + length <= stop")
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    all_ = here.groupBy(*key).agg(
        flat(F.concat("reads", "writes")).alias("used"), flat("writes").alias("given"), F.min_by("live_in", "start").alias("before"),
        F.array_except(flat("next"), F.collect_list("node_id")).alias("exits"),
    )
    behind = all_.select(*key, F.explode("exits").alias("node_id")).join(units.select("doc_id", "node_id", "live_in"), ["doc_id", "node_id"])
    after = behind.groupBy(*key).agg(flat("live_in").alias("after"))
    locals_ = facts.declared.select("doc_id", "name", "name_start", F.substring_index("symbol_id", ":", -1).cast("long").alias("symbol"))
    both = all_.join(after, key, "left").select(*key, F.array_intersect("before", "used").alias("into"), F.array_intersect("given", F.coalesce("after", F.array().cast("array<long>"))).alias("out"))
    ends = both.select(*key, F.explode(F.concat(F.transform("into", lambda x: F.struct(x.alias("symbol"), F.lit(True).alias("into"))), F.transform("out", lambda x: F.struct(x.alias("symbol"), F.lit(False).alias("into"))))).alias("x"))
    ends = ends.select(*key, "x.*").join(locals_, ["doc_id", "symbol"])
    early = F.col("into") & ~F.col("name_start").between(F.col("begin"), F.col("stop"))
    flows = ends.groupBy(*key).agg(some(early).alias("flows_in"), some(~F.col("into")).alias("flows_out"))
    none = F.array().cast("array<string>")
    return by_place.join(flows, key, "left").withColumns({c: F.coalesce(c, none) for c in ("flows_in", "flows_out")})


def control_flow(facts: Facts, spans: DataFrame) -> DataFrame:
    """For each span (doc_id, begin, stop): the numbers of statements in it that leave it."""
    kinds = {"ReturnStatement": "returns", "BreakStatement": "breaks", "ContinueStatement": "continues", "ThrowStatement": "throws"}
    rows = facts.nodes.filter(F.col("kind").isin(*kinds)).select("doc_id", "start", "kind")
    out = spans.join(rows, "doc_id", "left").groupBy("doc_id", "begin", "stop")
    return out.agg(*(F.count_if((F.col("kind") == k) & F.col("start").between(F.col("begin"), F.col("stop"))).alias(n) for k, n in kinds.items()))


def compare_syntax_trees(pairs: DataFrame, ignore_whitespace: bool = False, ignore_comments: bool = False) -> DataFrame:
    """Lines of ``before`` and ``after`` of each pair (key) that differ, after normalising each line."""
    def clean(c: str) -> Column:
        out = F.col(c)
        if ignore_comments:
            out = F.regexp_replace(out, r"//[^\n]*", "")
        if ignore_whitespace:
            out = F.regexp_replace(F.regexp_replace(out, r"[ \t\r]+", " "), r"(?m)^ | $", "")
        return out

    return text.positional_diff(pairs.withColumns({"before": clean("before"), "after": clean("after")}), "key", "before", "after")


def get_code_diff(pairs: DataFrame, context: int = 3) -> DataFrame:
    """Per pair (key, before, after): numbers of lines and the hunks of the difference as text."""
    stats = text.diff_stats(F.col("before"), F.col("after"))
    diff = text.unified_text(text.hunks(pairs, "key", "before", "after", context), "key", F.lit("before"), F.lit("after"))
    return pairs.select("key", stats.alias("s")).select("key", "s.*").join(diff, "key", "left")


CHANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("newText", T.StringType())]))


def apply_code_change(documents: DataFrame, changes: DataFrame, windows: bool = False) -> DataFrame:
    """Apply edits given as JSON, ``changes`` (doc_id, changes), and normalise line ends."""
    rows = changes.select("doc_id", F.explode(F.from_json("changes", CHANGES)).alias("c"))
    edits = rows.select("doc_id", "c.start", "c.length", F.coalesce("c.newText", F.lit("")).alias("new_text"))
    out = text.apply_edits(documents, edits, "doc_id", "content")
    return out.withColumn("content", text.normalise_newlines(F.col("content"), windows))


def unused_locals(facts: Facts) -> DataFrame:
    """``(doc_id, symbol_id, name, line)``: locals that nothing names after their declaration."""
    used = facts.local_uses.select("symbol_id").distinct()
    local = facts.declared.filter("node_kind <> 'Parameter'").select("doc_id", "symbol_id", "name", "line")
    return local.join(used, "symbol_id", "left_anti")


# --- Smaller lookups


def resolve_type(facts: Facts, name: str) -> DataFrame:
    """Types of a full name, or else of a simple name."""
    full = facts.types.withColumn("full_name", F.concat_ws(".", F.nullif("namespace", F.lit("<global>")), "name"))
    hit = full.filter((F.col("full_name") == name) | (F.col("name") == name)).withColumn("exact", F.col("full_name") == name)
    best = hit.agg(F.max("exact").alias("best"))
    return hit.join(F.broadcast(best), F.col("exact") == F.col("best")).drop("exact", "best")


def name_conflicts(facts: Facts, name: str) -> DataFrame:
    """Types that already have a member of a name, and namespaces that have a type of it."""
    inside = facts.members.filter(F.col("name") == name).select("namespace", F.col("type_name").alias("owner"), "kind")
    around = facts.types.filter(F.col("name") == name).select("namespace", F.lit(None).cast("string").alias("owner"), "kind")
    return inside.unionByName(around).distinct()


def selection_problems(facts: Facts, spans: DataFrame) -> DataFrame:
    """For each span (doc_id, begin, stop): whether it lies in the file and in one method."""
    size = facts.documents.select("doc_id", F.length("content").alias("n"))
    method = facts.members.filter(F.col("kind").isin("method", "constructor")).select("doc_id", "start", (F.col("start") + F.col("length")).alias("end"))
    touched = spans.join(method, "doc_id").filter("start < stop and begin < end").groupBy("doc_id", "begin", "stop").agg(F.count("*").alias("methods"))
    out = spans.join(size, "doc_id", "left").join(touched, ["doc_id", "begin", "stop"], "left")
    inside = F.coalesce((F.col("begin") >= 0) & (F.col("begin") <= F.col("stop")) & (F.col("stop") <= F.col("n")), F.lit(False))
    return out.select("doc_id", "begin", "stop", inside.alias("in_file"), (F.coalesce("methods", F.lit(0)) > 1).alias("crosses_methods"))


def conversions(from_type: Column, to_type: Column) -> Column:
    """Equal types convert by identity; any others are reported as explicit."""
    same = from_type == to_type
    return F.struct(same.alias("is_identity"), same.alias("exists"), (~same).alias("is_explicit"))


def constants(facts: Facts) -> DataFrame:
    """Literal values with their type's name."""
    kind = F.when(F.col("kind") == "StringLiteralExpression", "string").otherwise(number_type(F.col("detail")))
    rows = facts.nodes.filter(F.col("kind").isin("StringLiteralExpression", "NumericLiteralExpression"))
    return rows.select("doc_id", "start", "length", F.col("detail").alias("value"), kind.alias("type"))


def attribute_owners(facts: Facts) -> DataFrame:
    """``(doc_id, list_id, node_id)``: lists of attributes and the declaration that follows them."""
    lists = facts.nodes.filter("kind = 'AttributeList'").select("doc_id", "parent_id", F.col("start").alias("at"), F.col("node_id").alias("list_id"))
    declared = (*TYPE_KINDS, *plans.MEMBER_KINDS)
    after = facts.nodes.filter(F.col("kind").isin(*declared)).select("doc_id", "parent_id", "node_id", "start")
    owner = lists.join(after, ["doc_id", "parent_id"]).filter("start > at")
    return owner.groupBy("doc_id", "list_id").agg(F.min_by("node_id", "start").alias("node_id"))


def attributes(facts: Facts) -> DataFrame:
    """``(doc_id, node_id, name, arguments, named)``: attributes of declarations, with plain and named arguments."""
    rows = facts.nodes.filter("kind = 'Attribute'").select("doc_id", F.col("parent_id").alias("list_id"), F.col("ident").alias("name"), "args")
    is_named = lambda x: x.rlike(r"^\w+\s*(=[^=]|:[^:])")
    pair = lambda x: F.struct(F.regexp_extract(x, r"^(\w+)", 1).alias("name"), F.regexp_extract(x, r"(?s)^\w+\s*[=:]\s*(.*)$", 1).alias("value"))
    return rows.join(attribute_owners(facts), ["doc_id", "list_id"]).select(
        "doc_id", "node_id", "name", F.filter("args", lambda x: ~is_named(x)).alias("arguments"), F.transform(F.filter("args", is_named), pair).alias("named")
    )


def trivia(facts: Facts) -> DataFrame:
    """Comments and directives with flags for what they are."""
    rows = facts.nodes.filter(F.col("kind").isin("Comment", "DocumentationComment", "Directive"))
    return rows.select(
        "doc_id", "start", "length", "line", "detail", F.col("kind").endswith("Comment").alias("is_comment"),
        (F.col("kind") == "Directive").alias("is_directive"), (F.col("kind") == "DocumentationComment").alias("is_documentation"),
    )


def visible_members(facts: Facts, instance_only: bool = False) -> DataFrame:
    """Members that aren't private; for ``instance_only`` public ones that aren't static."""
    rows = facts.members.filter("accessibility <> 'private'")
    return rows.filter("accessibility = 'public' and not is_static") if instance_only else rows
