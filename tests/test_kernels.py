from __future__ import annotations

import datetime
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from factlake import queries, storage
from factlake.functions import names
from factlake.operators import cache, graph, lookup, metrics, text
from factlake.plans.components import connected_components
from factlake.streaming.sessions import sessions

GRAPHS = {
    "chain": ([("A", "B"), ("B", "C")], "BC", False, "CBA", "ABC"),
    "diamond": ([("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")], "BCD", False, "DBCA", "ABCD"),
    "self-loop": ([("A", "A")], "A", True, "", ""),
    "2-cycle + tail": ([("A", "B"), ("B", "A"), ("C", "A")], "AB", True, "", "C"),
    "isolated": ([], "", False, "A", "A"),
    "missing target": ([("A", "X")], "X", False, "A", "A"),
}


@pytest.fixture(params=[2])
def short_rounds(request, monkeypatch):
    """Few steps a round, so that small graphs take several."""
    monkeypatch.setattr(graph, "_AT_ONCE", request.param)


@pytest.mark.parametrize("name", GRAPHS)
def test_graph_fixtures(spark, short_rounds, name):
    edges, reach, cyclic, build, reference = GRAPHS[name]
    known = sorted({x for e in edges for x in e if x != "X"} | {"A"})
    e = spark.createDataFrame(edges, "src string, dst string")
    n = spark.createDataFrame([(x,) for x in known], "node string")
    assert "".join(sorted(r["dst"] for r in graph.closure(e).filter("src = 'A'").collect())) == reach
    assert graph.cyclic(n, e).filter("node = 'A'").collect()[0]["reaches_cycle"] is cyclic
    for order, want in (("build", build), ("reference", reference)):
        rows = graph.build_order(n, e, order=order).filter("level is not null").collect()
        assert "".join(r["node"] for r in sorted(rows, key=lambda r: (r["level"], r["node"]))) == want
    flags = {r["node"]: r["in_cycle"] for r in graph.build_order(n, e).collect()}
    assert flags == {x: x in reach and cyclic for x in known} if name != "2-cycle + tail" else flags == {"A": True, "B": True, "C": False}


def _reach(edges):
    out = set(edges)
    while more := {(a, d) for a, b in out for c, d in edges if b == c} - out:
        out |= more
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, short_rounds, seed):
    r = random.Random(seed)
    edges = sorted({(r.randrange(14), r.randrange(14)) for _ in range(r.choice([8, 20, 40]))})
    e = spark.createDataFrame(edges + [(None, 1), (2, None)], "src long, dst long")
    assert {tuple(x) for x in graph.closure(e).collect()} == _reach(edges)
    start = spark.createDataFrame([(edges[0][0],)], "node long")
    depth, last = {edges[0][0]: 0}, {edges[0][0]}
    for d in range(1, 4):
        last = {b for a, b in edges if a in last} - set(depth)
        depth |= dict.fromkeys(last, d)
    assert {x["node"]: x["depth"] for x in graph.bounded_walk(e, start, 3).collect()} == depth
    label = {}
    for a, b in edges * 20:
        if a != b:
            low = min(label.get(a, a), label.get(b, b), a, b)
            label[a] = label[b] = low
    assert {x["node"]: x["component"] for x in connected_components(e, "src", "dst").collect()} == label


def test_components_of_a_long_path(spark):
    n = 3000
    e = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in connected_components(e, "a", "b").collect()} == {0}
    assert connected_components(e.limit(0), "a", "b").count() == 0


def test_calls(spark):
    calls = spark.createDataFrame([("M", "N"), ("M", "N"), ("M", "P"), ("N", "P")], "src string, dst string")
    start = spark.createDataFrame([("M",)], "node string")
    nodes, sites = graph.call_graph(calls, start, 10)
    assert sorted(r["node"] for r in nodes.collect()) == ["M", "N", "P"] and sites.count() == 4
    assert graph.call_graph(calls, start, 1)[1].count() == 3
    fans = {r["node"]: r for r in graph.fan(nodes, calls).collect()}
    assert (fans["M"]["fan_out_sites"], fans["M"]["fan_out_distinct"], fans["P"]["fan_in_sites"], fans["M"]["complexity"]) == (3, 2, 2, 4)
    assert graph.callees(calls, start, 0).count() == 2
    dot = graph.to_dot(calls.distinct()).collect()[0]["dot"]
    assert dot == 'digraph CallGraph {\n  "M" -> "N";\n  "M" -> "P";\n  "N" -> "P";\n}'


def test_base_chains_of_any_length(spark):
    rows = graph.base_chain(spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 4), (None, 1)], "src int, dst int")).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 2, 1), (1, 3, 2), (2, 3, 1), (3, 2, 1)]
    chain = graph.base_chain(spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    got = chain.agg(F.count("*"), F.min(F.col("base") - F.col("node") - F.col("distance")), F.max("distance")).first()
    assert tuple(got) == (300 * 301 // 2, 0, 300)
    diamond = graph.base_chain(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 4)], "src int, dst int"))
    assert {r["distance"] for r in diamond.filter("node = 1 and base = 4").collect()} == {1}


@pytest.mark.parametrize("seed", range(4))
def test_cycles_of_random_graphs(spark, short_rounds, seed):
    r = random.Random(seed + 50)
    edges = sorted({(r.randrange(20), r.randrange(20)) for _ in range(r.choice([6, 15, 30]))})
    reach = _reach(edges)
    on = {a for a, b in reach if a == b}
    to = on | {a for a, b in reach if b in on}
    nodes = spark.range(22).select(F.col("id").alias("node"))
    rows = graph.cyclic(nodes, spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {x["node"]: (x["on_cycle"], x["reaches_cycle"]) for x in rows} == {n: (n in on, n in to) for n in range(22)}


@pytest.mark.parametrize("seed", range(2))
def test_components_and_levels_of_many_graphs(spark, seed):
    """Random graphs side by side: sparse ones, ones with one way on from each node, and rings."""
    r = random.Random(seed)
    edges, component, level = [], {}, {}
    for g in range(60):
        n, kind = r.randint(1, 14), r.random()
        own = [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, n * (1 if kind < 0.5 else 2)))]
        own = [(i, r.randrange(n)) for i in range(n)] if kind < 0.3 else [*((i, (i + 1) % n) for i in range(n)), *own[:1]] if kind > 0.85 else own
        own = [(a + 100 * g, b + 100 * g) for a, b in own]
        reach = _reach(own)
        used = {x for e in own for x in e}
        component |= {a: min(b for b in used if (a, b) in reach and (b, a) in reach) for a in used if (a, a) in reach}
        free = {a for a in used if not any(b in component for x, b in reach if x == a) and a not in component}
        for _ in used:
            level |= {a: max((level.get(b, 0) + 1 for x, b in own if x == a), default=0) for a in free}
        edges += own
    r.shuffle(edges)
    e = spark.createDataFrame(edges, "src long, dst long")
    rest, levels = graph.peeled(e)
    assert {x["node"]: x["level"] for x in levels.collect()} == level
    assert {tuple(x) for x in rest.collect()} == {(a, b) for a, b in edges if a not in level and b not in level}
    assert {x["node"]: x["component"] for x in graph.strong_components(e).collect()} == component


def test_long_rings_and_chains(spark):
    n = 50_000
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    chain = spark.range(n).select((F.col("id") + n).alias("src"), (F.col("id") + n + 1).alias("dst"))
    nodes = spark.range(2 * n + 1).withColumnRenamed("id", "node")
    rows = graph.cyclic(nodes, ring.unionByName(chain)).groupBy("on_cycle", "reaches_cycle").count().collect()
    assert {tuple(x) for x in rows} == {(True, True, n), (False, False, n + 1)}
    built = graph.build_order(nodes, chain).filter(F.col("node") >= n)
    assert built.filter(F.col("level") != 2 * n - F.col("node")).isEmpty() and built.count() == n + 1


def test_dot_of_a_large_graph(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_DOT_LINES", 2)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    with pytest.raises(ValueError):
        graph.to_dot(edges)
    assert [r["line"] for r in graph.dot_lines(edges, "G").orderBy("place", "line").collect()] == ["digraph G {", *(f'  "{a}" -> "{b}";' for a, b in ("ab", "bc", "cd")), "}"]


def test_medians(spark):
    r = random.Random(3)
    groups = {
        "many": [r.gauss(0, 5) for _ in range(3001)], "even": [r.random() for _ in range(1000)], "same": [7.0] * 50, "one": [3.5],
        "skew": [10.0**r.randrange(12) for _ in range(400)] + [1.0] * 400, "odd values": [float("nan"), float("inf"), float("-inf"), 1.0, 2.0, 4.0], "none": [float("nan")],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("many", None), (None, 1.0)]
    got = {x["g"]: x["middle"] for x in metrics.medians(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    want = {g: statistics.median(v for v in values if abs(v) < float("inf")) for g, values in groups.items() if g != "none"}
    assert got == pytest.approx(want)


def test_last_before(spark):
    r = random.Random(4)
    rows = [(i, r.randrange(5), r.randrange(40)) for i in range(200)] + [(900, None, 3), (901, 2, None)]
    marks = [(r.randrange(5), r.randrange(40), i) for i in range(60)]
    a = spark.createDataFrame(rows, "id int, key int, at int")
    b = spark.createDataFrame(marks, "key int, at int, mark int")
    got = {x["id"]: x["mark"] for x in lookup.last_before(a, b, "key", "at", "mark", "mark").collect()}
    want = {i: max(((t, m) for k, t, m in marks if k == key and at is not None and t <= at), default=(0, None))[1] for i, key, at in rows}
    assert got == want


def test_hunks(spark):
    before = [f"line {i}" for i in range(40)]
    after = list(before)
    after[0], after[10], after[17], after[18], after[39] = "a", "b", "c", "d", "e"
    pairs = spark.createDataFrame([(1, "\n".join(before), "\n".join([*after, "new"])), (2, "x", "x"), (3, None, "y"), (4, "a\nb", "a")], "k int, a string, b string")
    rows = {(r["k"], r["place"]): r for r in text.hunks(pairs, "k", "a", "b").collect()}
    assert {k: (r["old_start"], r["old_count"], r["new_start"], r["new_count"]) for k, r in rows.items()} == {
        (1, 0): (1, 4, 1, 4), (1, 1): (8, 15, 8, 15), (1, 2): (37, 4, 37, 5), (3, 0): (1, 1, 1, 1), (4, 0): (1, 2, 1, 1),
    }
    assert rows[1, 2]["text"].split("\n") == [" line 36", " line 37", " line 38", "-line 39", "+e", "+new"]
    assert rows[4, 0]["text"] == " a\n-b"
    merged = text.hunks(pairs, "k", "a", "b", 0).filter("k = 1").count()
    assert merged == 4


def test_positional_diff(spark):
    pairs = spark.createDataFrame([(1, "x\ny\nz", "x\nq\nz\nw"), (2, "a\nb", "n\na\nb"), (3, "s", "s"), (4, None, ""), (5, "a\nb", None)], "k int, a string, b string")
    diff = text.positional_diff(pairs, "k", "a", "b")
    got = sorted(tuple(r) for r in diff.filter("k < 3").collect())
    assert got == [(1, 1, "Modified", "y", "q"), (1, 3, "Added", None, "w"), (2, 0, "Modified", "a", "n"), (2, 1, "Modified", "b", "a"), (2, 2, "Added", None, "b")]
    assert {r["k"]: (r["added"], r["removed"], r["modified"], r["total"]) for r in text.diff_summary(diff, "k").collect()} == {1: (1, 0, 1, 2), 2: (1, 0, 2, 3), 5: (0, 1, 1, 2)}
    stats = {r["k"]: tuple(r["s"]) for r in pairs.select("k", text.diff_stats(F.col("a"), F.col("b")).alias("s")).collect()}
    assert stats[1] == (1, 0, 1) and stats[4] == (0, 0, 0)
    assert {r["k"]: r["diff"] for r in text.unified_diff(diff, "k").collect()}[1] == "@@ 2 @@\n-y\n+q\n@@ 4 @@\n+w"


def test_edits(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, "abc"), (3, None), (4, "é🙂z")], "k int, t string")
    edits = spark.createDataFrame([(1, 0, 5, "HEY"), (1, 6, 5, "X"), (2, 0, 2, "x"), (2, 1, 1, "y"), (4, 1, 1, "")], "k int, start int, length int, new_text string")
    got = {r["k"]: (r["content"], r["conflict"]) for r in text.apply_edits(docs, edits, "k", "t").collect()}
    assert got == {1: ("HEY X", False), 2: ("abc", True), 3: (None, False), 4: ("éz", False)}
    long = "é🙂ab" * 5000
    many = spark.createDataFrame([(1, 4 * i, 2, f"<{i}>") for i in range(5000)] + [(1, 20_000, 0, "end")], "k int, start int, length int, new_text string")
    out = text.apply_edits(spark.createDataFrame([(1, long)], "k int, t string"), many, "k", "t").collect()[0]
    assert out["content"] == "".join(f"<{i}>ab" for i in range(5000)) + "end" and not out["conflict"]
    same = spark.createDataFrame([(1, 1, 0, "x"), (1, 1, 0, "w"), (1, 1, 1, "Q")], "k int, start int, length int, new_text string")
    assert text.apply_edits(spark.createDataFrame([(1, "abc")], "k int, t string"), same, "k", "t").collect()[0]["content"] == "awxQc"


def test_sorting_in_place(spark):
    def ordered(listed, style):
        frame = spark.createDataFrame([(1, i, n) for i, n in enumerate(listed)], "g int, slot int, name string")
        return [r["sorted"] for r in text.sort_in_place(frame, "g", "slot", "name", style).orderBy("slot").collect()]

    assert ordered(["B", "System.Text", "A"], "system") == ["System.Text", "A", "B"]
    assert ordered(["Abc", "Z", "Bb"], "length") == ["Z", "Bb", "Abc"]
    assert ordered(["b", "B", "a", "a"], "alphabetical") == ["B", "a", "a", "b"]


def test_text_functions(spark):
    row = spark.createDataFrame([('<summary> s </summary><param name="a">x</param>', "a\r\nb\rc")], "d string, n string")
    got = row.select(text.xml_doc(F.col("d")).alias("d"), text.normalise_newlines(F.col("n")).alias("n"), text.normalise_newlines(F.col("n"), True).alias("w")).collect()[0]
    assert got["d"]["summary"] == "s" and [tuple(p) for p in got["d"]["params"]] == [("a", "x")] and got["n"] == "a\nb\nc" and got["w"] == "a\r\nb\r\nc"
    words = spark.createDataFrame([("@ok_1",), ("1bad",), ("class",)], "w string")
    assert [r[0] for r in words.select(names.is_identifier(F.col("w"))).collect()] == [True, False, False]
    p = spark.createDataFrame([("/p/A.cs",), ("/q/a.CS",), ("/q/b.cs",)], "p string")
    assert [r[0] for r in p.select(names.same_file(F.col("p"), F.lit("/z/a.cs"))).collect()] == [True, True, False]
    imports = spark.createDataFrame([("A.B",), ("A",), ("C",)], "name string")
    used = spark.createDataFrame([("A.B.D",), ("CC",)], "namespace string")
    assert [r[0] for r in text.unused_prefixes(imports, used).collect()] == ["C"]


def test_metrics(spark):
    rows = spark.createDataFrame([(0, 5, 2), (1000, 20, 2), (100_000, 1, 1)], "l int, c int, n int")
    got = [r[0] for r in rows.select(metrics.maintainability(F.col("l"), F.col("c"), F.col("n"))).collect()]
    assert got == [100.0, 75.0, 0.0]
    levels = spark.createDataFrame([(9,), (10,), (15,), (20,), (21,)], "c int").select(metrics.complexity_level(F.col("c")))
    assert [r[0] for r in levels.collect()] == ["low", "medium", "high", "high", "very_high"]


def _log(spark, rows):
    start = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(k, start + datetime.timedelta(milliseconds=m), i) for i, (k, m) in enumerate(rows)], "key string, ts timestamp, seq long")


def test_cache_lifetimes(spark):
    log = _log(spark, [("a", 0), ("a", 150), ("b", 0), ("b", 100), ("b", 200)])
    got = {(r["key"], r["seq"]): r["hit"] for r in cache.ttl_hits(log, "key", "ts", 0.1, "seq").collect()}
    assert got == {("a", 0): False, ("a", 1): False, ("b", 2): False, ("b", 3): True, ("b", 4): True}
    rate = {r["key"]: r["rate"] for r in cache.hit_rate(cache.ttl_hits(log, "key", "ts", 0.1, "seq"), "key", "ts").collect()}
    assert rate == {"a": 0.0, "b": 2 / 3}


def test_lru(spark):
    r = random.Random(1)
    keys = [r.choice("abcdef") for _ in range(9000)]
    got = [x["hit"] for x in cache.lru_hits(_log(spark, [(k, i) for i, k in enumerate(keys)]), "key", "seq", 3, list("abcdef")).orderBy("seq").collect()]
    held, want = [], []
    for k in keys:
        want.append(k in held)
        held = [x for x in held if x != k][-2:] + [k]
    assert got == want


@pytest.mark.parametrize("capacity", [1, 2, 300])
def test_lru_of_any_number_of_keys(spark, capacity, tmp_path):
    r = random.Random(capacity)
    keys = [r.choice([None, r.randrange(3), r.randrange(2000), r.randrange(100_000)]) for _ in range(9000)]
    log = spark.createDataFrame([(str(k) if k is not None else None, i * 5) for i, k in enumerate(keys)], "event_type string, event_id long").repartition(5)
    held, want = [], []
    for k in keys:
        want.append(k in held)
        held = ([x for x in held if x != k] + [k])[-capacity:] if k is not None else held
    got = cache.lru_hits_any(log, "event_type", "event_id", capacity).orderBy("event_id").collect()
    assert [(x["event_id"], x["hit"]) for x in got] == [(i * 5, w) for i, w in enumerate(want)]
    if capacity == 2:
        log.write.parquet(str(tmp_path / "events.parquet"))
        rows = queries.QUERIES["cache_lru_hits"](spark, str(tmp_path)).collect()
        assert {r["event_id"]: r["hit"] for r in rows} == {r["event_id"]: r["hit"] for r in got} and len(rows) == len(got)


def test_lru_over_many_chunks(spark):
    r = random.Random(8)
    keys = [r.choice("abcdef") for _ in range(3000)]
    held, want = [], []
    for k in keys:
        want.append(k in held)
        held = [x for x in held if x != k][-2:] + [k]
    log = spark.createDataFrame([(k, i * 20_000) for i, k in enumerate(keys)], "key string, seq long")
    for out in (cache.lru_hits(log, "key", "seq", 3, list("abcdef")), cache.lru_hits_any(log, "key", "seq", 3)):
        assert [x["hit"] for x in out.orderBy("seq").collect()] == want


def test_cache_administration(spark):
    log = _log(spark, [("a", 0), ("a", 50), ("b", 0), ("b", 5000)])
    hits = cache.ttl_hits(log, "key", "ts", 0.1, "seq")
    assert tuple(cache.summary(hits, "key").first()) == (2, 1, 3, 0.25) and cache.summary(hits.limit(0), "key").first()["rate"] == 0.0
    assert [r["key"] for r in cache.expired(log, "key", "ts", 1.0, datetime.datetime(2024, 1, 1, 0, 0, 5)).collect()] == ["a"]


def test_tables_need_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda *_: None)}))
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))})

    with pytest.raises(RuntimeError):
        storage.shared_dir(type("Session", (), {"sparkContext": Context}))
    kept = storage.written(spark.range(3).toDF("x"), "test")
    folder = kept._written_to.removeprefix("file:")
    assert os.path.isdir(folder) and kept.count() == 3
    storage.discard(kept)
    assert not os.path.exists(folder)


def test_command_line(capsys):
    from factlake.__main__ import main

    assert main(["--version"]) == 0 and capsys.readouterr().out.startswith("factlake ")
    assert main([]) == 0 and "usage" in capsys.readouterr().out
    assert main(["list"]) == 0 and "code_metrics" in capsys.readouterr().out.split()
    assert main(["run", "nothing", "x"]) == 2


def test_stream_and_table_have_the_same_sessions(spark, tmp_path):
    log = _log(spark, [(r, m) for r, m in (("a", 0), ("a", 400), ("a", 1500), ("b", 100), ("b", 9000))])
    table = {tuple(r) for r in sessions(log, "key", "ts", "500 milliseconds").collect()}
    log.repartition(2).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    out = sessions(stream, "key", "ts", "500 milliseconds", "1 second")
    q = out.writeStream.outputMode("append").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    live = {tuple(r) for r in spark.sql("SELECT * FROM live").collect()}
    assert len(table) == 4 and live <= table and len(live) >= 3


def test_walks_write_after_few_steps_and_reach_the_same(spark, monkeypatch):
    written, joins = graph.written, []

    def counted(df, name):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return written(df, name)

    monkeypatch.setattr(graph, "written", counted)
    edges = spark.createDataFrame([(i, i + 1) for i in range(23)] + [(5, 3), (40, 41)], "src int, dst int")
    start = spark.createDataFrame([(1,)], "node int")
    assert {r["node"]: r["depth"] for r in graph.bounded_walk(edges, start, 10).collect()} == {i + 1: i for i in range(11)}
    assert {r["node"] for r in graph.reached(edges, start).collect()} == set(range(1, 24))
    assert max(joins) <= 5
