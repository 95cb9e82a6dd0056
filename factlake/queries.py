"""One query for each kernel, over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlake import tools
from factlake.functions import names
from factlake.operators import cache, graph, lookup, metrics, text
from factlake.sources.tables import table
from factlake.streaming import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# A part depends on the part of half its key; the larger ones of size 50 also on the one of twice
# their key, which closes cycles.
def _part_edges(spark: SparkSession, d: str, cycles: bool) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_size")
    half = F.expr("p_partkey div 2")
    e = part.filter(half > 0).select(F.col("p_partkey").alias("src"), half.alias("dst"))
    if not cycles:
        return e
    twice = part.filter("p_size = 50").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") * 2).alias("dst"))
    known = part.select(F.col("p_partkey").alias("dst"))
    return e.unionByName(twice.join(known, "dst", "left_semi"))


_TREE = "SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey // 2 > 0"
_EDGES = f"""{_TREE} UNION SELECT p_partkey, p_partkey * 2 FROM part
  WHERE p_size = 50 AND p_partkey * 2 IN (SELECT p_partkey FROM part)"""
_REACH = f"""WITH RECURSIVE edges AS ({_EDGES}),
reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src)"""


@query("""SELECT c_custkey, n_name, coalesce(r_name, 'Unknown') AS region FROM customer
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def dep_direct(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    out = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, F.col("n_regionkey") == r.r_regionkey, "left")
    return out.select("c_custkey", "n_name", F.coalesce("r_name", F.lit("Unknown")).alias("region"))


@query(_REACH + " SELECT src, dst FROM reach")
def dep_closure(spark, d):
    return graph.closure(_part_edges(spark, d, True))


@query(_REACH + """, ring AS (SELECT src FROM reach WHERE src = dst)
SELECT p_partkey AS node, p_partkey IN (SELECT src FROM ring) AS on_cycle,
  p_partkey IN (SELECT r.src FROM reach r JOIN ring ON r.dst = ring.src) AS reaches_cycle FROM part""")
def dep_cycle(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    return graph.cyclic(nodes, _part_edges(spark, d, True))


@query(f"""WITH RECURSIVE e AS ({_TREE}),
up AS (SELECT p_partkey AS node, 0 AS level FROM part WHERE p_partkey NOT IN (SELECT src FROM e)
  UNION SELECT e.src, up.level + 1 FROM up JOIN e ON e.dst = up.node)
SELECT node, max(level)::INT AS level, false AS in_cycle FROM up GROUP BY node""")
def build_order(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    return graph.build_order(nodes, _part_edges(spark, d, False))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.1 AND l_returnflag = 'R')")
def startup_projects(spark, d):
    used = table(spark, d, "lineitem").filter("l_quantity >= 50 and l_discount >= 0.1 and l_returnflag = 'R'").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"))
    projects = table(spark, d, "supplier").select(F.col("s_suppkey").alias("project"), "s_name", F.lit("Exe").alias("output_type"))
    return tools.startup_projects(projects, used).select(F.col("project").alias("s_suppkey"), "s_name")


@query(f"""WITH RECURSIVE e AS ({_EDGES}), walk AS (
  SELECT p_partkey AS node, 0 AS depth FROM part WHERE p_size = 1
  UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.node WHERE w.depth < 10)
SELECT node, min(depth)::INT AS depth FROM walk GROUP BY node""")
def call_graph_bfs(spark, d):
    start = table(spark, d, "part").filter("p_size = 1").select(F.col("p_partkey").alias("node"))
    nodes, _ = graph.call_graph(_part_edges(spark, d, True), start)
    return nodes


@query("""WITH o AS (SELECT l_suppkey, count(*) AS fan_out_sites, count(DISTINCT l_partkey) AS fan_out_distinct
  FROM lineitem GROUP BY 1)
SELECT s_suppkey AS node, 0::BIGINT AS fan_in_sites, 0::BIGINT AS fan_in_distinct,
  coalesce(fan_out_sites, 0) AS fan_out_sites, coalesce(fan_out_distinct, 0) AS fan_out_distinct,
  coalesce(fan_out_sites, 0) + 1 AS complexity FROM supplier LEFT JOIN o ON s_suppkey = l_suppkey
UNION ALL SELECT -p_partkey - 1, coalesce(n, 0), coalesce(k, 0), 0, 0, 1 FROM part LEFT JOIN (
  SELECT l_partkey, count(*) AS n, count(DISTINCT l_suppkey) AS k FROM lineitem GROUP BY 1) ON p_partkey = l_partkey""")
def fan_in_out(spark, d):
    calls = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (-F.col("l_partkey") - 1).alias("dst"))
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))
    parts = table(spark, d, "part").select((-F.col("p_partkey") - 1).alias("node"))
    return graph.fan(suppliers.unionByName(parts), calls)


@query("""SELECT p_partkey, p_name, l_orderkey, l_suppkey, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE p_type LIKE '%BRASS%' OR p_size >= 40""")
def callers(spark, d):
    target = table(spark, d, "part").filter("p_type LIKE '%BRASS%' OR p_size >= 40").select("p_partkey", "p_name")
    sites = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_suppkey", "l_quantity")
    out = sites.join(target, sites.l_partkey == target.p_partkey)
    return out.select("p_partkey", "p_name", "l_orderkey", "l_suppkey", "l_quantity")


@query(f"""WITH e AS (SELECT DISTINCT src AS parent, dst AS callee FROM ({_EDGES})),
one AS (SELECT parent AS root, parent, callee, 0 AS depth FROM e)
SELECT * FROM one UNION ALL
SELECT DISTINCT one.root, e.parent, e.callee, 1 FROM one JOIN e ON one.callee = e.parent""")
def callees(spark, d):
    return graph.callees(_part_edges(spark, d, True), table(spark, d, "part").select(F.col("p_partkey").alias("node")), 2)


@query("""SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS base, 1 AS distance FROM customer
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1 FROM nation
UNION ALL SELECT 'c' || c_custkey, 'r' || n_regionkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def type_hierarchy(spark, d):
    key = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    a = table(spark, d, "customer").select(key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("dst"))
    b = table(spark, d, "nation").select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst"))
    return graph.base_chain(a.unionByName(b))


@query("""SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def metrics_rollup(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    out = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return out.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


_WORDS = r"(the|and|with|for|und|der|les|que)[ .,]"


@query(rf"SELECT doc_id, 1 + len(regexp_extract_all(lower(text), '{_WORDS}')) AS complexity FROM documents")
def cyclomatic(spark, d):
    hits = F.regexp_count(F.lower("text"), F.lit(_WORDS)).cast("long")
    return table(spark, d, "documents").select("doc_id", (hits + 1).alias("complexity"))


@query(rf"""WITH m AS (SELECT source, count(DISTINCT lang) AS spaces, sum(len(string_split(text, chr(10)))) AS loc,
  sum(1 + len(regexp_extract_all(lower(text), '{_WORDS}'))) AS complexity FROM documents GROUP BY source)
SELECT source, loc::BIGINT AS loc, complexity::BIGINT AS complexity, round(CASE WHEN loc = 0 THEN 100 ELSE greatest(0, least(100,
  100 - 2 * (CASE WHEN complexity > 0 THEN complexity / 1000 / spaces ELSE 1 END) - loc / 1000 * 5)) END, 6) AS maintainability FROM m""")
def maintainability(spark, d):
    hits = F.regexp_count(F.lower("text"), F.lit(_WORDS)).cast("long") + 1
    rows = table(spark, d, "documents").select("source", "lang", hits.alias("hits"), F.size(F.split("text", "\n")).cast("long").alias("n"))
    m = rows.groupBy("source").agg(F.countDistinct("lang").alias("spaces"), F.sum("n").alias("loc"), F.sum("hits").alias("complexity"))
    index = metrics.maintainability(F.col("loc"), F.col("complexity") / 1000, F.col("spaces"))
    return m.select("source", "loc", "complexity", F.round(index, 6).alias("maintainability"))


@query("""SELECT l_orderkey, count(DISTINCT k) AS coupling FROM (
  SELECT l_orderkey, 'p' || l_partkey AS k FROM lineitem UNION ALL SELECT l_orderkey, 's' || l_suppkey FROM lineitem) GROUP BY 1""")
def coupling(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    both = F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))
    uses = items.select(F.col("l_orderkey").cast("string").alias("k"), F.explode(both).alias("other"), "l_orderkey")
    out = metrics.coupling(uses.select("k", "other"), "k", "other")
    return out.select(F.col("k").cast("long").alias("l_orderkey"), "coupling")


@query("""WITH m AS (SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high,
  avg(l_extendedprice) AS mean, median(l_extendedprice) AS middle, stddev_pop(l_extendedprice) AS deviation FROM lineitem GROUP BY 1)
SELECT m.l_returnflag, n, low, high, round(mean, 4) AS mean, round(middle, 4) AS middle, round(deviation, 4) AS deviation,
  count(*) FILTER (abs(l_extendedprice - mean) > 2 * deviation) AS outliers
FROM m JOIN lineitem l ON m.l_returnflag = l.l_returnflag GROUP BY ALL""")
def stats_outliers(spark, d):
    out = metrics.statistics(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "middle", "deviation")})


@query("""SELECT doc_id, len(string_split(text, chr(10))) AS n, CASE WHEN n < 10 THEN 'low' WHEN n < 15 THEN 'medium'
  WHEN n <= 20 THEN 'high' ELSE 'very_high' END AS level, n > 15 AS complex FROM documents""")
def complexity_level(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n"))
    return rows.withColumn("level", metrics.complexity_level(F.col("n"))).withColumn("complex", F.col("n") > 15)


@query("""SELECT event_id, upper(event_type) AS event_type, value FROM events
WHERE event_type <> 'view' AND (lower(event_type) = 'click' OR value > 50)""")
def diagnostics_filter(spark, d):
    rows = table(spark, d, "events").filter("event_type <> 'view' AND (lower(event_type) = 'click' OR value > 50)")
    return rows.select("event_id", F.upper("event_type").alias("event_type"), "value")


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks,
  count(*) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY user_id""")
def severity_counts(spark, d):
    of = lambda t: F.count_if(F.col("event_type") == t)
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count("*").alias("n"), of("click").alias("clicks"), of("purchase").alias("purchases")
    )


@query(r"""SELECT page_id, len(regexp_extract_all(html, '<[a-zA-Z][^>]*>')) AS opens, len(regexp_extract_all(html, '</[a-zA-Z][^>]*>')) AS closes,
  len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<a ')) AS links FROM pages""")
def tree_counts(spark, d):
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, d, "pages").select(
        "page_id", count(r"<[a-zA-Z][^>]*>").alias("opens"), count(r"</[a-zA-Z][^>]*>").alias("closes"),
        count("<p>").alias("paragraphs"), count("<a ").alias("links"),
    )


@query(r"""WITH t AS (SELECT page_id, unnest(list_transform(regexp_extract_all(html, '</?[a-zA-Z]+'), lambda x: CASE WHEN x LIKE '</%' THEN -1 ELSE 1 END)) AS step,
  unnest(range(len(regexp_extract_all(html, '</?[a-zA-Z]+')))) AS i FROM pages)
SELECT page_id, max(depth)::BIGINT AS max_depth, count(*) AS tags FROM (
  SELECT page_id, sum(step) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM t) GROUP BY page_id""")
def node_depth(spark, d):
    tags = F.transform(F.regexp_extract_all("html", F.lit("</?[a-zA-Z]+"), F.lit(0)), lambda x: F.when(x.startswith("</"), -1).otherwise(1))
    walk = F.aggregate(
        "steps",
        F.struct(F.lit(0).alias("depth"), F.lit(-(1 << 30)).alias("most")),
        lambda a, x: F.struct((a["depth"] + x).alias("depth"), F.greatest(a["most"], a["depth"] + x).alias("most")),
    )
    rows = table(spark, d, "pages").select("page_id", tags.alias("steps")).filter(F.size("steps") > 0)
    return rows.select("page_id", walk["most"].cast("long").alias("max_depth"), F.size("steps").cast("long").alias("tags"))


@query("""SELECT e.event_id, arg_max(o.o_orderkey, (o.o_orderdate, o.o_orderkey)) AS order_key FROM events e
JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.ts GROUP BY e.event_id""")
def point_lookup(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("order_key"))
    return lookup.last_before(e, o, "user_id", "ts", "order_key", "order_key").filter("order_key is not null").select("event_id", "order_key")


@query("""WITH s AS (SELECT user_id, event_type, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1, 2)
SELECT x.user_id, x.event_type AS left_type, y.event_type AS right_type FROM s x JOIN s y
ON x.user_id = y.user_id AND x.event_type < y.event_type AND x.a <= y.b AND x.b >= y.a""")
def span_intersect(spark, d):
    s = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    y = s.select("user_id", F.col("event_type").alias("right_type"), F.col("a").alias("c"), F.col("b").alias("e"))
    hits = s.join(y, "user_id").filter("event_type < right_type and a <= e and b >= c")
    return hits.select("user_id", F.col("event_type").alias("left_type"), "right_type")


@query("""SELECT doc_id, unnest(string_split(text, chr(10))) AS content, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS line FROM documents""")
def line_split(spark, d):
    return text.lines(table(spark, d, "documents"), "doc_id", "text")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("after"))
    return docs.withColumnRenamed("text", "before").join(after, "doc_id")


_LINES = """p AS (SELECT a.doc_id, string_split(a.text, chr(10)) AS x, string_split(b.text, chr(10)) AS y
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.text <> b.text),
i AS (SELECT *, unnest(range(greatest(len(x), len(y)))) AS line FROM p),
diff AS (SELECT doc_id, line::INT AS line, x[line + 1] AS old, y[line + 1] AS new,
  CASE WHEN line >= len(x) THEN 'Added' WHEN line >= len(y) THEN 'Removed' ELSE 'Modified' END AS kind FROM i
  WHERE x[line + 1] IS DISTINCT FROM y[line + 1])"""


@query(f"WITH {_LINES} SELECT doc_id, line, kind, old, new FROM diff")
def positional_diff(spark, d):
    return text.positional_diff(_pairs(spark, d), "doc_id", "before", "after")


@query(f"""WITH {_LINES} SELECT doc_id, count(*) FILTER (kind = 'Added') AS added, count(*) FILTER (kind = 'Removed') AS removed,
count(*) FILTER (kind = 'Modified') AS modified, count(*) AS total FROM diff GROUP BY doc_id""")
def diff_summary(spark, d):
    return text.diff_summary(text.positional_diff(_pairs(spark, d), "doc_id", "before", "after"), "doc_id")


@query("""WITH p AS (SELECT a.doc_id, string_split(a.text, chr(10)) AS x, string_split(b.text, chr(10)) AS y
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, greatest(0, len(y) - len(x))::INT AS added, greatest(0, len(x) - len(y))::INT AS removed,
  len(list_filter(range(least(len(x), len(y))), lambda i: x[i + 1] <> y[i + 1]))::INT AS modified FROM p""")
def diff_stats(spark, d):
    stats = text.diff_stats(F.col("before"), F.col("after"))
    return _pairs(spark, d).select("doc_id", stats.alias("s")).select("doc_id", "s.added", "s.removed", "s.modified")


@query(f"""WITH {_LINES} SELECT doc_id, string_agg('@@ ' || (line + 1) || ' @@' || coalesce(chr(10) || '-' || old, '') ||
coalesce(chr(10) || '+' || new, ''), chr(10) ORDER BY line) AS diff FROM diff GROUP BY doc_id""")
def unified_diff(spark, d):
    return text.unified_diff(text.positional_diff(_pairs(spark, d), "doc_id", "before", "after"), "doc_id")


def _sorted(style: str, keys: str) -> None:
    def run(spark, d):
        part = table(spark, d, "part").select("p_brand", "p_partkey", "p_name")
        return text.sort_in_place(part, "p_brand", "p_partkey", "p_name", style)

    run.__name__ = f"sort_inplace_{style}"
    query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS a,
  row_number() OVER (PARTITION BY p_brand ORDER BY {keys}, p_partkey) AS b FROM part)
SELECT x.p_brand, x.p_partkey, x.p_name, y.p_name AS sorted FROM r x JOIN r y ON x.p_brand = y.p_brand AND x.a = y.b""")(run)


for _style, _keys in (("system", "p_name NOT LIKE 'System%', p_name"), ("alphabetical", "p_name"), ("length", "length(p_name), p_name")):
    _sorted(_style, _keys)


@query("""WITH t AS (SELECT DISTINCT replace(p_type, ' ', '.') AS name FROM part),
imports AS (SELECT DISTINCT array_to_string(string_split(name, '.')[1:2], '.') AS name FROM t),
used AS (SELECT DISTINCT replace(p_type, ' ', '.') AS namespace FROM part WHERE p_size > 45 AND p_brand = 'Brand#11')
SELECT name FROM imports i WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.namespace = i.name OR starts_with(u.namespace, i.name || '.'))""")
def unused_import(spark, d):
    dotted = F.replace("p_type", F.lit(" "), F.lit("."))
    part = table(spark, d, "part")
    imports = part.select(F.substring_index(dotted, ".", 2).alias("name")).distinct()
    used = part.filter("p_size > 45 and p_brand = 'Brand#11'").select(dotted.alias("namespace")).distinct()
    return text.unused_prefixes(imports, used)


@query("""SELECT e.event_id, m.namespace FROM events e LEFT JOIN (VALUES ('click', 'Ui.Input'), ('view', 'Ui.Render'),
('purchase', 'Shop.Orders')) AS m(name, namespace) ON lower(e.event_type) = m.name""")
def missing_import(spark, d):
    known = spark.sql("SELECT * FROM VALUES ('click', 'Ui.Input'), ('view', 'Ui.Render'), ('purchase', 'Shop.Orders') AS t(name, namespace)")
    e = table(spark, d, "events")
    return e.join(F.broadcast(known), F.lower(e.event_type) == known.name, "left").select("event_id", "namespace")


@query("SELECT doc_id, replace(text, 'the', 'THE') AS content, false AS conflict FROM documents")
def rename_apply(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    parts = F.split("text", "the")
    sizes = F.transform(parts, lambda x: F.length(x))
    begin = F.slice(sizes, F.lit(1), F.size(parts) - 1)
    gaps = docs.select("doc_id", F.posexplode(begin).alias("i", "gap"))
    upto = F.sum("gap").over(Window.partitionBy("doc_id").orderBy("i"))
    edits = gaps.select("doc_id", (upto + 3 * F.col("i")).cast("int").alias("start"), F.lit(3).alias("length"), F.lit("THE").alias("new_text"))
    return text.apply_edits(docs, edits, "doc_id", "text")


@query(r"""SELECT page_id, trim(regexp_extract(html, '<title>(.*?)</title>', 1, 's')) AS title,
len(regexp_extract_all(html, '<p>(.*?)</p>', 1, 's')) AS paragraphs, regexp_extract_all(html, '<p>(.*?)</p>', 1, 's')[1] AS first FROM pages""")
def xmldoc_extract(spark, d):
    found = F.regexp_extract_all("html", F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))
    return table(spark, d, "pages").select(
        "page_id", F.trim(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"),
        F.size(found).cast("long").alias("paragraphs"), F.get(found, F.lit(0)).alias("first"),
    )


@query(f"""SELECT p_partkey, token, regexp_matches(token, '{names.IDENTIFIER}') AND token NOT IN ({", ".join(f"'{k}'" for k in names.KEYWORDS)}) AS valid
FROM (SELECT p_partkey, unnest(string_split(p_name || ' 1x class', ' ')) AS token FROM part)""")
def identifier_valid(spark, d):
    tokens = F.explode(F.split(F.concat("p_name", F.lit(" 1x class")), " "))
    return table(spark, d, "part").select("p_partkey", tokens.alias("token")).withColumn("valid", names.is_identifier(F.col("token")))


@query("SELECT p_partkey, lower(left(p_name, 1)) || substr(p_name, 2) AS camel, upper(left(p_name, 1)) || substr(p_name, 2) AS capital FROM part")
def to_camel(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", names.camel(F.col("p_name")).alias("camel"), names.capitalised(F.col("p_name")).alias("capital")
    )


@query("SELECT page_id, list_last(string_split(html, '.')) AS segment FROM pages")
def last_segment(spark, d):
    return table(spark, d, "pages").select("page_id", names.last_segment(F.col("html")).alias("segment"))


@query(r"""SELECT page_id, regexp_extract(url, '([^/\\]*)$', 1) AS name, regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '\.[^.]*$', '') AS stem,
regexp_extract(regexp_extract(url, '([^/\\]*)$', 1), '(\.[^.]*)$', 1) AS extension FROM pages""")
def basename(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", names.file_name(u).alias("name"), names.file_stem(u).alias("stem"), names.extension(u).alias("extension")
    )


_TTL = """h AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR, false) AS hit FROM events)"""


@query(f"WITH {_TTL} SELECT event_id, user_id, hit FROM h")
def cache_ttl_hits(spark, d):
    return cache.ttl_hits(table(spark, d, "events"), "user_id", "ts", 3600, "event_id").select("event_id", "user_id", "hit")


@query(f"""WITH {_TTL} SELECT user_id, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, max(ts) AS last_access,
count(*) FILTER (hit) / count(*) AS rate FROM h GROUP BY user_id""")
def cache_hit_rate(spark, d):
    return cache.hit_rate(cache.ttl_hits(table(spark, d, "events"), "user_id", "ts", 3600, "event_id"), "user_id", "ts")


@query(f"""WITH {_TTL} SELECT count(DISTINCT user_id) AS keys, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(*) FILTER (hit) / count(*) AS rate FROM h""")
def cache_summary(spark, d):
    return cache.summary(cache.ttl_hits(table(spark, d, "events"), "user_id", "ts", 3600, "event_id"), "user_id")


@query("SELECT user_id, max(ts) AS last FROM events GROUP BY user_id HAVING (SELECT max(ts) FROM events) - max(ts) > INTERVAL 10 DAY")
def cache_expired(spark, d):
    e = table(spark, d, "events")
    return cache.expired(e, "user_id", "ts", 864_000, e.agg(F.max("ts")).first()[0])


@query("SELECT p_partkey, CASE WHEN p_size / 50 >= 0.9 THEN 'critical' WHEN p_size / 50 >= 0.85 THEN 'warning' ELSE 'normal' END AS level FROM part")
def cache_pressure(spark, d):
    return table(spark, d, "part").select("p_partkey", cache.pressure(F.col("p_size"), F.lit(50)).alias("level"))


@query(r"""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Unknown' ELSE p_size || '.0.1' END AS version FROM part""")
def version_in_path(spark, d):
    part = F.when(F.col("p_size") % 3 == 0, F.lit("net")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".0.1")))
    path = F.concat(F.lit("C:\\packages\\log\\"), part, F.lit("\\lib/x.dll"))
    return table(spark, d, "part").select("p_partkey", names.version_in_path(path).alias("version"))


@query("""WITH t AS (SELECT DISTINCT event_type AS k FROM events),
seen AS (SELECT e.event_id, e.event_type, t.k, max(CASE WHEN e.event_type = t.k THEN e.event_id END) OVER (
  PARTITION BY t.k ORDER BY e.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM events e, t),
own AS (SELECT *, max(CASE WHEN event_type = k THEN last END) OVER (PARTITION BY event_id) AS mine FROM seen)
SELECT event_id, event_type, mine IS NOT NULL AND count(*) FILTER (last > mine) < 2 AS hit FROM own GROUP BY event_id, event_type, mine""")
def cache_lru_hits(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    keys = sorted(r[0] for r in e.select("event_type").dropna().distinct().limit(65).collect())
    if len(keys) > 64:
        return cache.lru_hits_any(e, "event_type", "event_id", 2)
    return cache.lru_hits(e, "event_type", "event_id", 2, keys)


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS oldest, min(o_orderdate) AS since FROM orders GROUP BY o_custkey")
def topk_oldest(spark, d):
    return cache.oldest(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def set_except(spark, d):
    dear = table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").subtract(dear)


@query("SELECT * FROM (SELECT l_partkey, l_suppkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1, 2)")
def set_distinct_by(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("l_orderkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    return a.intersect(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("""SELECT r_regionkey, '{"success":true,"name":"' || r_name || '","nations":' || count(n_nationkey) || '}' AS response
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def to_json_response(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    rows = r.join(n, n.n_regionkey == r.r_regionkey, "left").groupBy("r_regionkey", "r_name").agg(F.count("n_nationkey").alias("nations"))
    return rows.withColumnRenamed("r_name", "name").select("r_regionkey", tools.envelope("name", "nations").alias("response"))


@query("""SELECT 'digraph Nations {' || chr(10) || string_agg(line, chr(10) ORDER BY line) || chr(10) || '}' AS dot FROM (
SELECT DISTINCT '  "' || n_name || '" -> "' || r_name || '";' AS line FROM nation JOIN region ON n_regionkey = r_regionkey)""")
def dot_export(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    e = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst")).distinct()
    return graph.to_dot(e, "Nations")


@query("""SELECT p_brand, 'public ' || replace(p_brand, '#', '') || '(' || string_agg('string ' || lower(left(f, 1)) || substr(f, 2), ', ' ORDER BY f) || ')' AS head
FROM (SELECT DISTINCT p_brand, replace(p_type, ' ', '') AS f FROM part) GROUP BY p_brand""")
def gen_constructor(spark, d):
    fields = table(spark, d, "part").select("p_brand", F.replace("p_type", F.lit(" "), F.lit("")).alias("f")).distinct()
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("f")), lambda x: F.concat(F.lit("string "), names.camel(x))), ", ")
    head = F.concat(F.lit("public "), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("("), listed, F.lit(")"))
    return fields.groupBy("p_brand").agg(head.alias("head")).select("p_brand", "head")


@query("""SELECT r_name, string_agg('void ' || n_name || '();', chr(10) ORDER BY n_name) AS members
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def gen_interface(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey)
    body = F.transform(F.sort_array(F.collect_list("n_name")), lambda x: F.concat(F.lit("void "), x, F.lit("();")))
    return rows.groupBy("r_name").agg(F.array_join(body, "\n").alias("members"))


@query("""SELECT user_id, max(ts) AS latest FROM events GROUP BY user_id
HAVING min(ts) >= (SELECT min(ts) FROM events) + INTERVAL 1 DAY""")
def incremental_changed(spark, d):
    e = table(spark, d, "events")
    start = e.agg(F.min("ts")).scalar()
    per = e.groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("latest"))
    return per.filter(F.col("first") >= start + F.expr("INTERVAL 1 DAY")).select("user_id", "latest")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS opened, max(ts) + INTERVAL 1 HOUR AS closed, count(*) AS n FROM s GROUP BY user_id, k""")
def session_batches(spark, d):
    out = sessions.sessions(table(spark, d, "events"), "user_id", "ts", "1 hour")
    return out.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("opened", "closed")), "n")
