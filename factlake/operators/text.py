"""Text kernels: lines, positional diffs, edits, sorted slots and documentation tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, line, content)``, lines from 0; a trailing line break leaves an empty last line."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "content"))


def positional_diff(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """``(key, line, kind, old, new)`` of the lines that differ at equal positions.

    Equal texts are dropped before lines are made; both sides stay in one row, so nothing is joined.
    """
    changed = pairs.filter(F.coalesce(F.col(before), F.lit("")) != F.coalesce(F.col(after), F.lit("")))
    side = lambda c: F.split(F.coalesce(F.col(c), F.lit("")), "\n")
    both = changed.select(key, F.posexplode(F.arrays_zip(side(before).alias("old"), side(after).alias("new"))).alias("line", "x"))
    old, new = F.col("x.old"), F.col("x.new")
    kind = F.when(old.isNull(), "Added").when(new.isNull(), "Removed").otherwise("Modified")
    return both.filter(~old.eqNullSafe(new)).select(key, "line", kind.alias("kind"), old.alias("old"), new.alias("new"))


def diff_summary(diff: DataFrame, key: str) -> DataFrame:
    count = lambda k: F.count_if(F.col("kind") == k).alias(k.lower())
    out = diff.groupBy(key).agg(count("Added"), count("Removed"), count("Modified"))
    return out.withColumn("total", F.col("added") + F.col("removed") + F.col("modified"))


def diff_stats(before: Column, after: Column) -> Column:
    """Added and removed by the difference in lines, modified by unequal lines at equal positions."""
    a, b = F.split(F.coalesce(before, F.lit("")), "\n"), F.split(F.coalesce(after, F.lit("")), "\n")
    unequal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: F.coalesce(x, F.lit(False))))
    return F.struct(
        F.greatest(F.lit(0), F.size(b) - F.size(a)).alias("added"),
        F.greatest(F.lit(0), F.size(a) - F.size(b)).alias("removed"),
        unequal.alias("modified"),
    )


def unified_diff(diff: DataFrame, key: str) -> DataFrame:
    """``(key, diff)``: the changed lines of each pair as one text, in order of their position."""
    minus = F.when(F.col("old").isNotNull(), F.concat(F.lit("-"), "old"))
    plus = F.when(F.col("new").isNotNull(), F.concat(F.lit("+"), "new"))
    text = F.concat_ws("\n", F.concat(F.lit("@@ "), (F.col("line") + 1).cast("string"), F.lit(" @@")), minus, plus)
    rows = F.sort_array(F.collect_list(F.struct("line", text.alias("text"))))
    return diff.groupBy(key).agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("diff"))


def hunks(pairs: DataFrame, key: str, before: str, after: str, context: int = 3) -> DataFrame:
    """``(key, place, old_start, old_count, new_start, new_count, text)`` of the hunks of a positional diff.

    Changed lines that lie at most twice ``context`` lines apart share a hunk, with ``context`` equal
    lines around it; lines count from 1. Each line of a hunk starts with a space, - or +.
    """
    side = lambda c: F.split(F.coalesce(F.col(c), F.lit("")), "\n")
    both = pairs.filter(F.coalesce(F.col(before), F.lit("")) != F.coalesce(F.col(after), F.lit(""))).select(key, side(before).alias("x"), side(after).alias("y"))
    most = F.greatest(F.size("x"), F.size("y"))
    changed = F.filter(F.sequence(F.lit(0), most - 1), lambda i: ~F.get("x", i).eqNullSafe(F.get("y", i)))
    both = both.select(key, "x", "y", changed.alias("c"))
    opens = F.filter("c", lambda i, k: F.coalesce(i - F.get("c", k - 1) > 2 * context + 1, F.lit(True)))
    closes = F.filter("c", lambda i, k: F.coalesce(F.get("c", k + 1) - i > 2 * context + 1, F.lit(True)))
    both = both.select(key, "x", "y", F.posexplode(F.arrays_zip(opens.alias("a"), closes.alias("b"))).alias("place", "h"))
    low, high = F.greatest(F.lit(0), F.col("h.a") - context), F.least(F.greatest(F.size("x"), F.size("y")) - 1, F.col("h.b") + context)
    both = both.select(key, "place", "x", "y", low.alias("low"), high.alias("high"))
    minus, plus = (lambda c, m: lambda i: F.concat(F.lit(m), F.get(c, i)))("x", "-"), (lambda c, m: lambda i: F.concat(F.lit(m), F.get(c, i)))("y", "+")
    line = lambda i: F.when(F.get("x", i).eqNullSafe(F.get("y", i)), F.concat(F.lit(" "), F.get("x", i))).otherwise(F.concat_ws("\n", minus(i), plus(i)))
    count = lambda c: F.greatest(F.lit(0), F.least(F.size(c) - 1, F.col("high")) - F.col("low") + 1)
    return both.select(
        key, "place", (F.col("low") + 1).alias("old_start"), count("x").alias("old_count"), (F.col("low") + 1).alias("new_start"), count("y").alias("new_count"),
        F.array_join(F.transform(F.sequence("low", "high"), line), "\n").alias("text"),
    )


def unified_text(hunks_: DataFrame, key: str, before: Column, after: Column) -> DataFrame:
    """``(key, diff)``: hunks under their heads and the names of both sides."""
    head = F.format_string("@@ -%d,%d +%d,%d @@", "old_start", "old_count", "new_start", "new_count")
    rows = F.sort_array(F.collect_list(F.struct("place", F.concat_ws("\n", head, "text").alias("text"))))
    body = F.array_join(F.transform(rows, lambda x: x["text"]), "\n")
    return hunks_.groupBy(key).agg(F.concat(F.lit("--- "), F.first(before), F.lit("\n+++ "), F.first(after), F.lit("\n"), body).alias("diff"))


def apply_edits(docs: DataFrame, edits: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, content, conflict)``: replacements (key, start, length, new_text) spliced from the end.

    Starts count code points from 0; edits of equal start apply in order of length and text. Overlapping
    edits leave the text as it is and set ``conflict``.
    """
    all_ = edits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "length", "new_text"))).alias("edits"))
    ends = lambda e, i: F.coalesce(F.get("edits", i - 1)["start"] + F.get("edits", i - 1)["length"] > e["start"], F.lit(False))
    all_ = all_.withColumn("conflict", F.exists(F.transform("edits", ends), lambda x: x))
    joined = docs.select(key, text).join(all_, key, "left")
    conflict = F.coalesce("conflict", F.lit(False))
    spliced = _spliced(F.coalesce(F.col(text), F.lit("")), F.col("edits"))
    content = F.when(F.col("edits").isNotNull() & ~conflict, spliced).otherwise(F.col(text))
    return joined.select(key, content.alias("content"), conflict.alias("conflict"))


def _spliced(text: Column, edits: Column) -> Column:
    """The text between the edits, in order of their start, joined with the new texts at once.

    Four bytes a code point make every cut a plain copy, so the work is in proportion to the text.
    """

    def whole(wide: Column) -> Column:
        end = lambda i: F.coalesce(F.get(edits, i)["start"] + F.get(edits, i)["length"], F.lit(0))
        between = lambda a, n: F.decode(F.substring(wide, 4 * a + 1, 4 * n), "UTF-32")
        pieces = F.transform(edits, lambda e, i: F.concat(between(end(i - 1), e["start"] - end(i - 1)), e["new_text"]))
        last = end(F.size(edits) - 1)
        tail = between(last, F.greatest(F.lit(0), (F.octet_length(wide) / 4).cast("int") - last))
        return F.array_join(F.concat(pieces, F.array(tail)), "")

    return F.get(F.transform(F.array(F.encode(text, "UTF-32")), whole), F.lit(0))


def sort_in_place(items: DataFrame, group: str, slot: str, name: str, style: str = "alphabetical") -> DataFrame:
    """``(group, slot, name, sorted)``: the i-th slot of a group gets the i-th name in the chosen order.

    Styles: ``system`` (names that start with System first), ``alphabetical`` and ``length``; names
    compare by code point.
    """
    keys = {
        "system": [F.when(F.col(name).startswith("System"), 0).otherwise(1), F.col(name)],
        "alphabetical": [F.col(name)],
        "length": [F.length(name), F.col(name)],
    }[style]
    at = F.row_number().over(Window.partitionBy(group).orderBy(slot))
    to = F.row_number().over(Window.partitionBy(group).orderBy(*keys, slot))
    ranked = items.select(group, slot, name, at.alias("at"), to.alias("to"))
    moved = ranked.select(group, F.col("to").alias("at"), F.col(name).alias("sorted"))
    return ranked.join(moved, [group, "at"]).select(group, slot, name, "sorted")


def unused_prefixes(imports: DataFrame, used: DataFrame, name: str = "name", namespace: str = "namespace") -> DataFrame:
    """Imports that no used namespace equals or lies under.

    Each namespace is exploded into its dotted prefixes, so the test is an equi-join.
    """
    parts = F.split(namespace, r"\.")
    prefixes = F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "."))
    under = used.select(F.explode(prefixes).alias(name)).distinct()
    return imports.join(under, name, "left_anti")


def xml_doc(text: Column) -> Column:
    """Summary, returns, remarks, example and parameters of a documentation comment."""
    tag = lambda t: F.btrim(F.regexp_extract(text, rf"(?s)<{t}>(.*?)</{t}>", 1), F.lit(" \t\r\n"))
    param = r'(?s)<param name="([^"]*)">(.*?)</param>'
    names, bodies = (F.regexp_extract_all(text, F.lit(param), F.lit(g)) for g in (1, 2))
    return F.struct(
        tag("summary").alias("summary"), tag("returns").alias("returns"), tag("remarks").alias("remarks"), tag("example").alias("example"),
        F.arrays_zip(names.alias("name"), bodies.alias("text")).alias("params"),
    )


def normalise_newlines(text: Column, windows: bool = False) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n", "\r\n" if windows else "\n")
