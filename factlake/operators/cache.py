"""Cache behaviour as queries over access logs (key, ts)."""

from __future__ import annotations

from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ttl_hits(accesses: DataFrame, key: str, ts: str, seconds: float, tie: str | None = None) -> DataFrame:
    """``accesses`` with ``hit``: the key was used at most ``seconds`` before; each use renews it."""
    order = [ts, tie] if tie else [ts]
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(
        F.lag(ts).over(Window.partitionBy(key).orderBy(*order)).cast("timestamp")
    )
    return accesses.withColumn("hit", F.coalesce(gap <= int(seconds * 1e6), F.lit(False)))


def hit_rate(accesses: DataFrame, key: str, ts: str) -> DataFrame:
    """Hits, misses, rate and last access of each key; a key without accesses has no row."""
    out = accesses.groupBy(key).agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.max(ts).alias("last_access")
    )
    return out.withColumn("rate", F.col("hits") / (F.col("hits") + F.col("misses")))


def summary(hits: DataFrame, key: str) -> DataFrame:
    """One row over all accesses with ``hit``: keys, hits, misses and rate, 0 without accesses."""
    out = hits.agg(F.countDistinct(key).alias("keys"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return out.withColumn("rate", F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)))


def expired(accesses: DataFrame, key: str, ts: str, seconds: float, now) -> DataFrame:
    """``(key, last)`` of the keys that a sweep at ``now`` takes out: last used more than ``seconds`` before."""
    last = accesses.groupBy(key).agg(F.max(ts).alias("last"))
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))
    return last.filter(age > int(seconds * 1e6))


def oldest(entries: DataFrame, group: str, ts: str, tie: str) -> DataFrame:
    """``(group, oldest, since)``: the entry of each group that goes first, the one of the earliest time."""
    return entries.groupBy(group).agg(F.min_by(tie, F.struct(ts, tie)).alias("oldest"), F.min(ts).alias("since"))


def pressure(used: Column, most: Column, warning: float = 0.85, critical: float = 0.9) -> Column:
    """What the share of memory in use calls for: normal, warning or critical."""
    share = used / most
    return F.when(share >= critical, "critical").when(share >= warning, "warning").otherwise("normal")


def lru_hits(accesses: DataFrame, key: str, order: str, capacity: int, keys: list[str]) -> DataFrame:
    """``accesses`` with ``hit``: fewer than ``capacity`` other keys were used since this key's last use.

    For a known, small domain of ``keys``: every access looks up each key's last use with one running
    maximum a key. The log is cut into chunks by ``order`` whose maxima are carried over by a window
    over the chunks, so no task takes the whole log.
    """
    chunk = F.floor(F.col(order) / 4096).cast("long")
    rows = accesses.withColumn("_chunk", chunk)
    last = [F.max(F.when(F.col(key) == k, F.col(order))).alias(f"_c{i}") for i, k in enumerate(keys)]
    carried = rows.groupBy("_chunk").agg(*last)
    # Two levels: what the runs of 4096 chunks before bring, and the chunks before in the same run.
    carried = carried.withColumn("_run", F.floor(F.col("_chunk") / 4096))
    runs = carried.groupBy("_run").agg(*[F.max(f"_c{i}").alias(f"_c{i}") for i in range(len(keys))])
    earlier = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_run", *[F.max(f"_c{i}").over(earlier).alias(f"_r{i}") for i in range(len(keys))])
    before = Window.partitionBy("_run").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.join(runs, "_run").select(
        "_chunk", *[F.coalesce(F.max(f"_c{i}").over(before), F.col(f"_r{i}")).alias(f"_c{i}") for i in range(len(keys))]
    )
    inside = Window.partitionBy("_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(carried, "_chunk")
    seen = [
        F.greatest(F.max(F.when(F.col(key) == k, F.col(order))).over(inside), F.col(f"_c{i}")).alias(f"_l{i}")
        for i, k in enumerate(keys)
    ]
    wide = joined.select(*accesses.columns, *seen)
    own = F.coalesce(*[F.when(F.col(key) == k, F.col(f"_l{i}")) for i, k in enumerate(keys)])
    others = sum((F.coalesce(F.col(f"_l{i}") > own, F.lit(False)).cast("int") for i in range(len(keys))), F.lit(0))
    return wide.withColumn("hit", own.isNotNull() & (others < capacity)).drop(*[f"_l{i}" for i in range(len(keys))])


def lru_hits_any(accesses: DataFrame, key: str, order: str, capacity: int) -> DataFrame:
    """As ``lru_hits``, for any number of keys; ``order`` is a whole number, unique and not null.

    What a cache holds depends only on the last ``capacity`` keys. The log is cut into chunks, each
    gives its last ``capacity`` keys, one pass over these gives the cache at each chunk's begin, and
    the chunks are then replayed apart from each other. A chunk spans 64 capacities, so the pass reads
    at most a 64th of a log without gaps. A null key is never a hit and takes no place.
    """
    if capacity < 1:
        return accesses.withColumn("hit", F.lit(False))
    span = max(4096, 64 * capacity)
    # Names of their own, so that columns of the log may have any.
    rows = accesses.select(
        F.expr(f"cast(floor(`{order}` / {span}) as long)").alias("chunk"), F.col(order).cast("long").alias("at"),
        F.col(key).alias("key"), F.struct(*(F.col(c) for c in accesses.columns)).alias("row"),
    )
    code = F.when(F.col("key").isNotNull(), F.to_json(F.struct("key")))
    rows = rows.select("chunk", "at", code.alias("code"), "row")
    last = rows.filter("code is not null").groupBy("chunk", "code").agg(F.max("at").alias("at"))
    recent = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.col("at").desc())) <= capacity
    last = last.withColumn("new", recent("chunk")).filter("new").select("chunk", "code", "at")
    # Two levels again: one task goes over runs of 4096 chunks, then each run over its chunks.
    last = last.withColumn("run", F.floor(F.col("chunk") / 4096).cast("long"))
    of_run = last.groupBy("run", "code").agg(F.max("at").alias("at")).withColumn("new", recent("run")).filter("new").select("run", "code", "at")
    chunks = rows.select("chunk", F.floor(F.col("chunk") / 4096).cast("long").alias("run")).distinct()
    nothing = (F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("at"))

    def carry(name: str, table: pa.Table, begin: pa.Table | None) -> pa.Table:
        held: OrderedDict[str, None] = OrderedDict()
        if begin is not None:
            held.update((c, None) for _, c in sorted(zip(begin.column("at").to_pylist(), begin.column("code").to_pylist(), strict=True)))
        out: tuple[list, list, list] = ([], [], [])
        before = None
        places = zip(*(table.column(c).to_pylist() for c in (name, "code", "at")), strict=True)
        for place, code, _ in sorted(places, key=lambda x: (x[0], x[2] is not None, x[2] or 0)):
            if place != before:
                before = place
                for i, x in enumerate(held):
                    for column, value in zip(out, (place, x, i), strict=True):
                        column.append(value)
            if code is not None:
                _use(held, code, capacity)
        return pa.table({name: pa.array(out[0], pa.int64()), "code": pa.array(out[1], pa.string()), "at": pa.array(out[2], pa.int64())})

    def replay(left: pa.Table, right: pa.Table) -> pa.Table:
        held = OrderedDict((c, None) for _, c in sorted(zip(right.column("at").to_pylist(), right.column("code").to_pylist(), strict=True)))
        left = left.sort_by("at")
        hits = [c is not None and _use(held, c, capacity) for c in left.column("code").to_pylist()]
        return pa.table({"at": left.column("at"), "hit": pa.array(hits, pa.bool_())})

    runs = of_run.unionByName(chunks.select("run", *nothing).distinct()).withColumn("log", F.lit(0))
    opened = runs.groupBy("log").applyInArrow(lambda t: carry("run", t, None), "run long, code string, at long")
    marks = last.select("run", "chunk", "code", "at").unionByName(chunks.select("run", "chunk", *nothing))
    state = marks.groupBy("run").cogroup(opened.groupBy("run")).applyInArrow(lambda t, b: carry("chunk", t, b), "chunk long, code string, at long")
    log = rows.select("chunk", "at", "code")
    hits = log.groupBy("chunk").cogroup(state.groupBy("chunk")).applyInArrow(replay, "at long, hit boolean")
    return rows.join(hits, "at").select(*(F.col(f"row.`{c}`").alias(c) for c in accesses.columns), "hit")


def _use(held: OrderedDict[str, None], key: str, capacity: int) -> bool:
    """Whether ``key`` is held; it is the latest then, and the earliest one above ``capacity`` goes."""
    hit = key in held
    held[key] = None
    held.move_to_end(key)
    if len(held) > capacity:
        held.popitem(last=False)
    return hit
