"""Kernels over edge tables: closure, cycles, build order, bounded walks, fan-in and fan-out.

Loops keep no state on the driver: each round is a join against what is known, written to the
shared folder, and ends when nothing new is found, however many rounds that takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.storage import discard, written


def closure(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """All (src, dst) with a path from src to dst of one edge or more.

    Semi-naive with doubling: what the last round found is joined with all that is known, so the
    rounds grow with the logarithm of the longest shortest path. Each round writes only what is new;
    all that is known is the union of the rounds. A node is its own descendant exactly if it lies on
    a cycle. Edges with a null end are ignored.
    """
    new = written(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).dropna().distinct(), "closure")
    seen = new
    while not new.isEmpty():
        ahead = seen.select(F.col("src").alias("mid"), F.col("dst").alias("dst"))
        behind = seen.select("src", F.col("dst").alias("mid"))
        step = new.select("src", F.col("dst").alias("mid")).join(ahead, "mid").select("src", "dst")
        back = behind.join(new.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        new = written(step.unionByName(back).distinct().join(seen, ["src", "dst"], "left_anti"), "closure")
        seen = seen.unionByName(new)
    return seen


#: Levels that are peeled off before a round is written.
_AT_ONCE = 8
#: Steps that are walked before one is; after each exchange Spark plans the rest anew, so a plan costs the square of its steps.
_STEPS = 4


def _reversed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _ends(pointers: DataFrame) -> DataFrame:
    """Pointers (node, next, length, base) followed to where they end: with ``low`` and ``looped``.

    A pointer says that a node's level is the greater of ``base`` and ``length`` plus the level of
    ``next``; following two gives another of that form. Each round doubles the steps, so a path takes a
    logarithm of rounds. Who still points to a node with a pointer after more steps than there are
    pointers leads into a ring, and then ``next`` lies on the ring; ``low`` is the least node passed.
    """
    pointers = pointers.withColumn("low", F.col("node"))
    nodes, n, steps, t = pointers.select(F.col("node").alias("next"), F.lit(True).alias("looped")), pointers.count(), 1, pointers
    while True:
        for _ in range(3):
            ahead = t.select(F.col("node").alias("next"), F.col("next").alias("then"), F.col("length").alias("more"), F.col("base").alias("their"), F.col("low").alias("least"))
            t = t.join(ahead, "next", "left").select(
                "node", F.coalesce("then", "next").alias("next"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"),
                F.greatest("base", F.col("length") + F.col("their")).alias("base"), F.least("low", "least").alias("low"),
            )
        t, steps = written(t, "ends"), steps * 8
        out = t.join(nodes, "next", "left").withColumn("looped", F.coalesce("looped", F.lit(False)))
        if steps > n or out.filter("looped").isEmpty():
            return out


def _pointers(edges: DataFrame) -> DataFrame:
    """``(node, next, length, base)`` of the sources of edges (src, dst, length, base) that have one target."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.max("dst").alias("next"), F.max("length").alias("length"), F.max("base").alias("base"))
    return out.filter("n = 1").drop("n")


def peeled(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges (src, dst) that lie on a path without end, and ``(node, level)`` of all nodes on no such path.

    A node's level is its longest path. A round takes off so many levels from the ends in one plan, one
    join a level, and then follows the nodes with one way on to where they end, however far that is, and
    puts the end in their place. So chains take a logarithm of rounds, and only nodes with several ways
    on take one for each eight levels.
    """
    whole = written(edges.select("src", "dst").dropna().distinct(), "peeled")
    if whole.isEmpty():
        return whole, None
    e = whole.select("src", "dst", F.lit(1).cast("long").alias("length"), F.lit(0).cast("long").alias("base"))
    ends = whole.select(F.col("dst").alias("node")).distinct().join(whole.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    ends = ends.withColumn("level", F.lit(0).cast("long"))
    levels, followed = ends, []
    while True:
        first = ends.withColumns({"done": F.lit(True), "old": F.lit(True)})
        reach = first
        for _ in range(_AT_ONCE):
            ahead = e.join(reach.select(F.col("node").alias("dst"), "level", "done"), "dst", "left")
            level = F.greatest(F.max("base"), F.max(F.col("length") + F.coalesce("level", F.lit(0))))
            ahead = ahead.groupBy(F.col("src").alias("node")).agg(level.alias("level"), F.bool_and(F.coalesce("done", F.lit(False))).alias("done"))
            reach = ahead.withColumn("old", F.lit(False)).unionByName(first)
        done = written(reach.filter("done"), "done")
        new = done.filter("not old").select("node", "level")
        left = e.join(done.select(F.col("node").alias("src")), "src", "left_anti").join(done.select(F.col("node").alias("dst"), "level"), "dst", "left")
        by_source = Window.partitionBy("src")
        gained = F.max(F.greatest("base", F.col("length") + F.col("level"))).over(by_source)
        left = written(left.withColumn("gained", F.coalesce(gained, "base")).withColumn("open", F.count_if(F.col("level").isNull()).over(by_source)), "left")
        ends = left.filter("open = 0").select(F.col("src").alias("node"), F.col("gained").alias("level")).distinct()
        levels = levels.unionByName(new).unionByName(ends)
        e = left.filter("level is null").select("src", "dst", "length", F.col("gained").alias("base"))
        if e.isEmpty():
            break
        pointers = written(_pointers(e), "pointers")
        stuck = pointers.isEmpty()
        if stuck:
            if new.isEmpty() and ends.isEmpty():
                break
            continue
        followed.append(_ends(pointers))
        to = followed[-1].filter("not looped").select(F.col("node").alias("dst"), F.col("next").alias("then"), F.col("length").alias("more"), F.col("base").alias("their"))
        e = e.join(pointers.select(F.col("node").alias("src")), "src", "left_anti").join(to, "dst", "left")
        e = e.select("src", F.coalesce("then", "dst").alias("dst"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"), F.greatest("base", F.col("length") + F.col("their")).alias("base"))
        e = e.groupBy("src", "dst").agg(F.max("length").alias("length"), F.max("base").alias("base"))
        e = written(e.withColumn("base", F.max("base").over(by_source)), "peeled")
        if e.isEmpty():
            break
    for f in reversed(followed):
        levels = written(levels, "levels")
        hit = f.filter("not looped").join(levels.withColumnRenamed("node", "next"), "next")
        levels = levels.unionByName(hit.select("node", F.greatest("base", F.col("length") + F.col("level")).alias("level")))
    levels = written(levels.select("node", F.col("level").cast("int").alias("level")), "levels")
    free = levels.select("node")
    rest = whole.join(free.withColumnRenamed("node", "src"), "src", "left_anti").join(free.withColumnRenamed("node", "dst"), "dst", "left_anti")
    return written(rest.select("src", "dst"), "rest"), levels


def strong_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of the nodes that lie on a cycle; nodes of one component reach each other.

    Edges into what lies on no path without end are peeled off. Nodes with one way on are left out,
    their ends in their place; what is left is peeled from the other side and coloured: every node gets
    the greatest node that reaches it, and those of a colour that reach that node are a component
    (forward-backward colouring). At last the nodes left out are in the component of their end if one of
    its nodes leads to them. Nothing is closed; chains and rings take a logarithm of rounds, the rest as
    many as its paths are long, eight steps a round.
    """
    core, _ = peeled(edges)
    return _components(core)


def _components(core: DataFrame) -> DataFrame:
    """As ``strong_components``, of edges that ``peeled`` has left."""
    if core.isEmpty():
        return core.select(F.col("src").alias("node"), F.col("src").alias("component"))
    node = F.col("src").alias("node")
    # Nodes that lead to themselves, at once or through nodes left out, are components of their own unless in a larger one.
    loops = core.filter("src = dst").select(node)
    found, left_out = core.limit(0).select(node, F.col("src").alias("component")), []
    e, both_sides = core.filter("src <> dst"), False
    while True:
        pointers = written(_pointers(e.withColumn("length", F.lit(1)).withColumn("base", F.lit(0))), "pointers")
        if pointers.isEmpty():
            if both_sides or e.isEmpty():
                break
            back, _ = peeled(_reversed(e))
            e, both_sides = _reversed(back), True
            continue
        ends = _ends(pointers)
        # Of nodes that lead into a ring, those that pointers of others come to lie on it.
        ring = ends.filter("looped")
        found = found.unionByName(ring.join(ring.select(F.col("next").alias("node")).distinct(), "node", "left_semi").select("node", F.col("low").alias("component")))
        straight = ends.filter("not looped").select("node", "next")
        left_out.append((e, pointers.select("node", "next").join(straight.select("node"), "node", "left_semi"), straight))
        e = e.join(pointers.select(F.col("node").alias("src")), "src", "left_anti").join(ring.select(F.col("node").alias("dst")), "dst", "left_anti")
        e = e.join(straight.select(F.col("node").alias("dst"), F.col("next").alias("then")), "dst", "left").select("src", F.coalesce("then", "dst").alias("dst"))
        e = written(e.distinct(), "core")
        loops = loops.unionByName(e.filter("src = dst").select(node))
        e = e.filter("src <> dst")
    while not e.isEmpty():
        nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
        colour = _coloured(nodes, e)
        of = lambda c: colour.select(F.col("node").alias(c), F.col("colour").alias(f"{c}_colour"))
        same = e.join(of("src"), "src").join(of("dst"), "dst").filter("src_colour = dst_colour").select("src", "dst")
        roots = colour.filter("node = colour").select("node")
        part = written(reached(_reversed(same), roots).join(colour, "node"), "part")
        found = found.unionByName(part.withColumn("n", F.count("*").over(Window.partitionBy("colour"))).filter("n > 1").select("node", F.col("colour").alias("component")))
        e = e.join(part.select(F.col("node").alias("src")), "src", "left_anti").join(part.select(F.col("node").alias("dst")), "dst", "left_anti")
        e = written(e.select("src", "dst"), "core")
    loops = loops.distinct().withColumn("component", F.col("node"))
    whole = lambda known: known.unionByName(loops.join(known.select("node"), "node", "left_anti"))
    for e, pointers, straight in reversed(left_out):
        # Into the chains from a node of the component of their end, and down them; what is found here counts before a loop.
        known = written(whole(found), "known")
        at = straight.join(known.select(F.col("node").alias("next"), "component"), "next").select(F.col("node").alias("dst"), "component")
        entered = e.join(at, "dst").join(known.select(F.col("node").alias("src"), "component"), ["src", "component"]).select(F.col("dst").alias("node")).distinct()
        passed = _downstream(pointers, entered).join(at.withColumnRenamed("dst", "node"), "node").select("node", "component")
        found = written(found.unionByName(passed), "found")
    known = written(whole(found), "known")
    low = known.groupBy("component").agg(F.min("node").alias("least"))
    return known.join(low, "component").select("node", F.col("least").alias("component"))


def _coloured(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, colour)``: the greatest node that reaches each one, itself included."""
    step = _looped(edges).select("src", "dst")
    colour = nodes.select("node", F.col("node").alias("colour"))
    step = written(step, "edges")
    while True:
        last = colour
        for _ in range(_AT_ONCE):
            colour = colour.withColumnRenamed("node", "src").join(step, "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("colour"))
        colour = written(colour, "colours")
        if colour.join(last, ["node", "colour"], "left_anti").isEmpty():
            return colour


def _downstream(pointers: DataFrame, start: DataFrame) -> DataFrame:
    """``(node)``: the start nodes and all that pointers (node, next) lead to from them, by doubling their steps."""
    seen, jump = start.select("node"), pointers
    while True:
        new = seen.join(jump, "node").select(F.col("next").alias("node"))
        seen = written(seen.unionByName(new).distinct(), "downstream")
        far = jump.select(F.col("node").alias("next"), F.col("next").alias("then"))
        jump = written(jump.join(far, "next").select("node", F.col("then").alias("next")), "jumps")
        if jump.isEmpty():
            return seen


def cyclic(nodes: DataFrame, edges: DataFrame, node: str = "node", reach: DataFrame | None = None) -> DataFrame:
    """``(node, on_cycle, reaches_cycle)``: whether a cycle passes through, or can be reached.

    What reaches a cycle has a path without end; what lies on one is in a strong component. Where the
    closure ``reach`` is at hand, it tells both.
    """
    if reach is not None:
        on = reach.filter("src = dst").select(F.col("src").alias("n"))
        to = reach.join(on.select(F.col("n").alias("dst")), "dst").select(F.col("src").alias("n")).distinct()
    else:
        core, _ = peeled(edges)
        on = _components(core).select(F.col("node").alias("n"))
        to = core.select(F.col("src").alias("n")).distinct()
    flags = to.withColumn("to", F.lit(True)).join(on.withColumn("on", F.lit(True)), "n", "left")
    return nodes.select(node).join(flags, F.col(node) == F.col("n"), "left").select(
        node, F.coalesce("on", F.lit(False)).alias("on_cycle"), F.coalesce("to", F.lit(False)).alias("reaches_cycle")
    )


def build_order(nodes: DataFrame, edges: DataFrame, node: str = "node", order: str = "build") -> DataFrame:
    """``(node, level, in_cycle)``: dependencies have lower levels; sort by (level, node).

    ``edges`` (src, dst) say that src depends on dst. A node's level is the longest path below it.
    Nodes on a cycle or depending on one get no level, and those on one are flagged. With
    ``order="reference"`` dependents come first instead. Edges to unknown nodes don't count. Several
    levels are peeled off before each write, which holds only the edges that are left.
    """
    known = nodes.select(F.col(node).alias("node")).dropna().distinct()
    e = edges.select("src", "dst") if order == "build" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    e = e.dropna().distinct().join(known.withColumnRenamed("node", "src"), "src", "left_semi")
    e = e.join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    rest, levels = peeled(e)
    if levels is None:
        return known.select(F.col("node").alias(node), F.lit(0).alias("level"), F.lit(False).alias("in_cycle"))
    stuck = rest.select(F.col("src").alias("node")).distinct().withColumn("stuck", F.lit(True))
    out = known.join(levels, "node", "left").join(stuck, "node", "left")
    flags = _components(rest).select("node", F.lit(True).alias("on"))
    return out.join(flags, "node", "left").select(
        F.col("node").alias(node), F.when(F.col("stuck").isNull(), F.coalesce("level", F.lit(0))).alias("level"), F.coalesce("on", F.lit(False)).alias("in_cycle")
    )


def _looped(edges: DataFrame) -> DataFrame:
    """``(src, dst, cost)``: edges of cost 1, and one of cost 0 from each node to itself.

    So many joins with them in a row reach all nodes within as many steps, without a union a step.
    """
    e = edges.select("src", "dst").dropna().distinct()
    nodes = e.select("src").unionByName(e.select(F.col("dst").alias("src"))).distinct()
    return e.withColumn("cost", F.lit(1)).unionByName(nodes.select("src", F.col("src").alias("dst"), F.lit(0).alias("cost")))


def bounded_walk(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """``(node, depth)`` of the nodes within ``max_depth`` edges of the ``start`` nodes (node)."""
    seen = start.select("node").dropna().distinct().withColumn("depth", F.lit(0))
    e = written(_looped(edges), "edges") if max_depth > 0 else edges
    depth = 0
    while depth < max_depth:
        found = seen.filter(F.col("depth") == depth)
        steps = min(_STEPS, max_depth - depth)
        for _ in range(steps):
            ahead = found.withColumnRenamed("node", "src").join(e, "src")
            found = ahead.groupBy(F.col("dst").alias("node")).agg(F.min(F.col("depth") + F.col("cost")).alias("depth"))
        depth += steps
        seen = written(seen.unionByName(found).groupBy("node").agg(F.min("depth").alias("depth")), "walk")
        if depth == max_depth or seen.filter(F.col("depth") == depth).isEmpty():
            break
    return seen


def reached(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``(node)``: the start nodes and all that they reach; several steps go into one round."""
    seen = frontier = written(start.select("node").dropna().distinct(), "reached")
    e = written(_looped(edges).select("src", "dst"), "edges")
    while not frontier.isEmpty():
        found = frontier
        for _ in range(_STEPS):
            found = found.withColumnRenamed("node", "src").join(e, "src").select(F.col("dst").alias("node")).distinct()
        frontier = written(found.join(seen, "node", "left_anti"), "reached")
        seen = seen.unionByName(frontier)
    return seen


def call_graph(calls: DataFrame, start: DataFrame, max_depth: int = 10) -> tuple[DataFrame, DataFrame]:
    """Nodes within reach and the call sites among them; a node at the greatest depth isn't expanded."""
    nodes = bounded_walk(calls, start, max_depth)
    inner = nodes.filter(F.col("depth") < max_depth).select(F.col("node").alias("src"))
    return nodes, calls.join(inner, "src", "left_semi")


def fan(nodes: DataFrame, calls: DataFrame, node: str = "node") -> DataFrame:
    """Call sites and distinct partners into and out of each node, and fan-out plus one."""
    out = calls.groupBy(F.col("src").alias(node)).agg(
        F.count("*").alias("fan_out_sites"), F.countDistinct("dst").alias("fan_out_distinct")
    )
    into = calls.groupBy(F.col("dst").alias(node)).agg(
        F.count("*").alias("fan_in_sites"), F.countDistinct("src").alias("fan_in_distinct")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    names = ("fan_in_sites", "fan_in_distinct", "fan_out_sites", "fan_out_distinct")
    joined = nodes.select(node).join(into, node, "left").join(out, node, "left").select(node, *map(zero, names))
    return joined.withColumn("complexity", F.col("fan_out_sites") + 1)


def callees(calls: DataFrame, start: DataFrame, max_depth: int = 1) -> DataFrame:
    """Call tree below the start nodes: ``(root, parent, callee, depth)``; depth 0 means direct calls.

    A parent's callees are distinct. The depth bounds the walk, so cycles do too.
    """
    e = calls.select(F.col("src").alias("parent"), F.col("dst").alias("callee")).distinct()
    level = start.select(F.col("node").alias("root"), F.col("node").alias("parent"))
    out = None
    for depth in range(max(1, max_depth)):
        found = level.join(e, "parent").select("root", "parent", "callee").distinct()
        found = found.withColumn("depth", F.lit(depth))
        out = found if out is None else out.unionByName(found)
        level = found.select("root", F.col("callee").alias("parent")).distinct()
    return out


def base_chain(edges: DataFrame) -> DataFrame:
    """``(node, base, distance)``: every ancestor along edges (src, dst) and its least distance.

    Paths double in each round, so a chain of any length takes a logarithm of rounds; a node is no
    base of itself.
    """
    seen = edges.select(F.col("src").alias("node"), F.col("dst").alias("base"), F.lit(1).alias("distance")).dropna().filter("node <> base")
    seen = written(seen.distinct(), "chain")
    state = None
    while True:
        now = seen.agg(F.count("*"), F.sum("distance")).first()
        if now == state or not now[0]:
            return seen
        state = now
        up = seen.select(F.col("node").alias("base"), F.col("base").alias("next"), F.col("distance").alias("more"))
        step = seen.join(up, "base").filter("next <> node").select("node", F.col("next").alias("base"), (F.col("distance") + F.col("more")).alias("distance"))
        last, seen = seen, written(seen.unionByName(step).groupBy("node", "base").agg(F.min("distance").alias("distance")), "chain")
        discard(last)


#: Lines of a DOT text that are put into one row.
MOST_DOT_LINES = 1_000_000


def dot_lines(edges: DataFrame, name: str = "CallGraph") -> DataFrame:
    """``(place, line)``: the graph in DOT form line by line, for graphs of any size; sort by place, line."""
    body = edges.select(F.lit(1).alias("place"), F.format_string('  "%s" -> "%s";', F.col("src").cast("string"), F.col("dst").cast("string")).alias("line"))
    ends = edges.sparkSession.createDataFrame([(0, f"digraph {name} {{"), (2, "}")], "place int, line string")
    return ends.unionByName(body)


def to_dot(edges: DataFrame, name: str = "CallGraph") -> DataFrame:
    """One row with the graph in DOT form, its edges in order.

    A graph of more than ``MOST_DOT_LINES`` edges raises an error: its text is in ``dot_lines``.
    """
    n = edges.limit(MOST_DOT_LINES + 1).count()
    if n > MOST_DOT_LINES:
        raise ValueError(f"more than {MOST_DOT_LINES} edges don't go into one row; use dot_lines")
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
    return dot_lines(edges, name).agg(rows.alias("dot"))
