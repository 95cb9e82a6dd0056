"""Mixing sources to target weights by a low-discrepancy schedule.

Every source gets a target in words, and its documents, in an order shuffled by the MD5 of their id,
form a stream that starts again at its end. The stream is cut into blocks of equally many words. The
mix is a schedule of slots: the slot's number times the golden ratio, modulo one and in steps of
2**-31, falls into one source's share of the cumulative targets, so any run of slots holds each
source in nearly its proportion, and the source's k-th slot takes its k-th block: a block is in the mix because a slot
takes it. Only the remainder is settled by count, so that a source ends exactly at its target: slots
beyond it stay empty, and the few blocks by which the schedule may fall short follow after the last
slot. More of those than the sequence's discrepancy allows is an error.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.storage import written

WORD = r"[^\x20\x09-\x0D]+"
#: The unit interval in whole steps, so that every engine draws the same points, and how many of them
#: make the golden ratio (an odd number, so that all points differ).
_UNIT, _GOLDEN = 1 << 31, 1327217885
#: Cells of the unit interval over which slots meet the sources' shares.
_CELLS = 4096
#: Slots that are numbered together.
_CHUNK = 1 << 16


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """``(source, s, source_size, target)`` from rows of (source, size).

    Sources in code-point order, null last, take the weights in turn. They share the sum of all
    sizes by weight; a target stops at ``cap`` times its source's size and the excess is shared
    again by weight until none is above. Sorted by cap over weight, the sources that stop are the
    first ones, so running sums give the level at which the others share the rest.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("s", F.row_number().over(by_name))
    turn = F.array(*(F.lit(w) for w in weights))
    per = per.withColumn("w", F.element_at(turn, F.pmod(F.col("s") - 1, F.lit(len(weights))) + 1))
    per = per.withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("r", F.col("most") / F.col("w"))
    order = Window.orderBy("r", "s")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(every) - F.coalesce(
        F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", rest / left)
    free = F.col("r") >= F.col("level")
    shared = F.min(F.when(free, F.struct("r", "s", "level"))).over(every)["level"]
    target = F.when(free, F.col("w") * shared).otherwise(F.col("most").cast("double"))
    return per.select("source", "s", "source_size", target.alias("target"))


def slot_schedule(targets: DataFrame, slots: int) -> DataFrame:
    """``(s, k, slot)``: each slot's source and its rank among that source's slots."""
    order = Window.orderBy("s")
    shares = targets.select("s", F.floor("target").alias("quota")).filter("quota > 0")
    total = F.sum("quota").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.coalesce(F.sum("quota").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    low = F.floor(before.cast("double") / total.cast("double") * _UNIT)
    shares = shares.select("s", low.alias("low")).withColumn("high", F.lead("low", 1, _UNIT).over(order)).filter("low < high")
    width = _UNIT // _CELLS
    shares = shares.withColumn("cell", F.explode(F.expr(f"sequence(low div {width}, (high - 1) div {width})")))
    drawn = targets.sparkSession.range(slots).select(F.col("id").alias("slot"), F.expr(f"id % {_UNIT} * {_GOLDEN} % {_UNIT}").alias("u"))
    drawn = drawn.withColumn("cell", F.expr(f"u div {width}"))
    placed = drawn.join(shares, "cell").filter("u >= low and u < high")
    placed = placed.select("s", "slot", F.floor(F.col("slot") / _CHUNK).alias("chunk"))
    counts = placed.groupBy("s", "chunk").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("s", "chunk", F.coalesce(earlier, F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot")) - 1
    return placed.withColumn("i", inside).join(counts, ["s", "chunk"]).select(
        "s", (F.col("base") + F.col("i")).alias("k"), "slot"
    )


def chosen_blocks(targets: DataFrame, schedule: DataFrame, slots: int, block_words: int) -> DataFrame:
    """``(s, k, slot, stop)``: the blocks that the slots take, and the remainder after the last slot.

    ``stop`` is the word of the source's stream at which the block ends. Two bounds of a share each
    deviate by less than log2(slots) + 1 slots; a schedule that leaves over more isn't one.
    """
    given = schedule.groupBy("s").agg(F.count("*").alias("given"))
    per = targets.select("s", F.floor("target").alias("quota")).join(given, "s", "left")
    per = per.select("s", "quota", F.coalesce("given", F.lit(0)).alias("given"), F.expr(f"(quota + {block_words - 1}) div {block_words}").alias("need"))
    per = written(per, "quotas")
    short = per.agg(F.max(F.col("need") - F.col("given"))).first()[0] or 0
    if short > 2 * math.log2(slots + 2) + 4:
        raise RuntimeError(f"the schedule leaves over {short} blocks of a source")
    taken = schedule.join(per.select("s", "quota", "need"), "s").filter("k < need").select("s", "k", "slot", "quota")
    late = per.filter("given < need").select("s", F.explode(F.expr("sequence(given, need - 1)")).alias("k"), "quota")
    late = late.select("s", "k", (F.lit(slots) + F.col("k")).alias("slot"), "quota")
    stop = F.least((F.col("k") + 1) * block_words, F.col("quota"))
    return taken.unionByName(late).select("s", "k", "slot", stop.alias("stop"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    block_words: int = 4096,
    carry: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The documents with their sizes and targets, and the pieces of them that the mix takes.

    Documents: ``(row, id, source, size, source_size, target, carried)``, one for each input row.
    Pieces: ``(row, epoch, first_word, n_words, slot)``; a piece is a run of words of one block, and
    the slot that took the block says where in the mix it stands. A source's pieces hold ``floor(target)`` words.

    Defined results: null and wordless texts have size 0 and no piece; a null source is a source of
    its own, last in order; equal rows are separate documents; null ids are ordered by a hash of their text; a text of
    any length is counted whole and falls into as many pieces as blocks; an empty table gives empty
    results. Columns not named are ignored unless carried, so their names can't clash. One task
    orders the sources, of which it reads one row each.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    carried = F.struct(*(F.col(c) for c in carry)) if carry else F.struct(F.lit(1).alias("none"))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        size.alias("size"),
        F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col).cast("string"))).alias("mark"),
        carried.alias("carried"),
    )
    rows = written(rows, "sized")
    targets = written(source_targets(rows, weights, cap), "targets")
    total = rows.agg(F.sum("size")).first()[0] or 0
    slots = -(-total // block_words)
    schedule = written(slot_schedule(targets, slots), "slots")
    blocks = written(chosen_blocks(targets, schedule, slots, block_words), "blocks")
    ends = written(blocks.groupBy("s").agg(F.max("stop").alias("end")), "ends")

    sized = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).select(
        "row", "id", rows["source"], "size", "mark", "s", "source_size", "target", "carried"
    )
    placed = sized.drop("carried", "source").withColumn("key", F.md5(F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null "), F.col("mark").cast("string"))).cast("binary")))
    placed = placed.withColumn("bucket", F.substring("key", 1, 4))
    sums = placed.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
    # Words before a bucket: those before its 256 neighbours, and those before it among them, so that
    # no window holds more than 256 rows, whatever the share of a source.
    sums = sums.withColumn("group", F.substring("bucket", 1, 2))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("s", "group").agg(F.sum("n").alias("m"))
    groups = groups.select("s", "group", F.coalesce(F.sum("m").over(before("s", "group")), F.lit(0)).alias("far"))
    near = F.coalesce(F.sum("n").over(before("s", "group", "bucket")), F.lit(0))
    sums = sums.withColumn("near", near).join(groups, ["s", "group"]).select("s", "bucket", (F.col("far") + F.col("near")).alias("base"))
    inside = Window.partitionBy("s", "bucket").orderBy("key", F.col("id").asc_nulls_first(), "size", "row")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("upto", upto).join(sums, ["s", "bucket"])
    start = F.col("base") + F.col("upto") - F.col("size")
    copies = placed.filter("size > 0").join(ends, "s").select(
        "row", "s", "size", start.alias("start"), "source_size", "end",
        F.explode(F.sequence(F.lit(0), F.lit(cap - 1))).alias("epoch"),
    )
    copies = copies.withColumn("low", F.col("start") + F.col("epoch") * F.col("source_size"))
    copies = copies.filter("low < end").withColumn("high", F.least(F.col("low") + F.col("size"), "end"))
    block = F.explode(F.expr(f"sequence(low div {block_words}, (high - 1) div {block_words})"))
    cut = copies.withColumn("k", block).join(blocks, ["s", "k"])
    begin = F.greatest("low", F.col("k") * block_words)
    pieces = cut.select(
        "row", "epoch", (begin - F.col("low")).alias("first_word"), (F.least("high", "stop") - begin).alias("n_words"), "slot"
    )
    return sized.drop("s", "mark"), pieces


def mixed_words(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """Documents with ``taken``, the words that the mix takes of each, repeats counted, and ``first_slot``.

    ``first_slot`` is the first slot whose block has words of the document; null if none has.
    """
    taken = pieces.groupBy("row").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"))
    return documents.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


TARGET_SQL = r"""
sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS s FROM per),
weighed AS (SELECT *, [5, 2, 1][((s - 1) % 3 + 1)::INT] AS w, 3 * source_size AS most FROM ranked),
levels AS (
  SELECT *, most / w AS r,
    (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY most / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, CASE WHEN r >= level
    THEN w * (SELECT arg_min(level, (r, s)) FROM levels WHERE r >= level) ELSE most::DOUBLE END AS target
  FROM levels)"""

MIX_SQL = (
    "WITH "
    + TARGET_SQL
    + f""",
numbered AS (SELECT *, floor(target)::BIGINT AS quota, row_number() OVER (ORDER BY source NULLS LAST) AS s FROM targets),
shares AS (SELECT s, low, lead(low, 1, {_UNIT}) OVER (ORDER BY s) AS high FROM (
  SELECT s, floor(coalesce(sum(quota) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE
    / (sum(quota) OVER ())::DOUBLE * {_UNIT})::BIGINT AS low FROM numbered WHERE quota > 0)),
slots AS (SELECT slot, s, row_number() OVER (PARTITION BY s ORDER BY slot) - 1 AS k
  FROM (SELECT unnest(range((SELECT (sum(size) + 4095) // 4096 FROM sized)::BIGINT)) AS slot)
  JOIN shares ON slot % {_UNIT} * {_GOLDEN} % {_UNIT} >= low AND slot % {_UNIT} * {_GOLDEN} % {_UNIT} < high),
placed AS (
  SELECT d.doc_id, d.size, t.s, t.source_size, t.target, t.quota, row_number() OVER () AS row,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.doc_id, d.size
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS start
  FROM sized d JOIN numbered t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT row, s, start + epoch * source_size AS low, least(start + epoch * source_size + size, quota) AS high
  FROM placed, (SELECT unnest([0, 1, 2]) AS epoch) WHERE size > 0 AND start + epoch * source_size < quota),
pieces AS (SELECT row, s, low, high, unnest(range(low // 4096, (high - 1) // 4096 + 1)) AS k FROM copies),
taken AS (
  SELECT row, sum(least(high, (k + 1) * 4096) - greatest(low, k * 4096))::BIGINT AS taken,
    min(coalesce(slot, (SELECT (sum(size) + 4095) // 4096 FROM sized)::BIGINT + k)) AS first_slot
  FROM pieces LEFT JOIN slots USING (s, k) GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot FROM placed LEFT JOIN taken USING (row)"""
)
