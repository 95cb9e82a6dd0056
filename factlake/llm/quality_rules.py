"""Quality rules: fixed base metrics and a learned decision list, in DataFrame functions only.

Statistics of every text are Spark expressions. The list is learned by sequential covering, as in
IREP: on a bounded sample of labelled statistics a rule grows by the threshold with the best
information gain until it covers no good text, is pruned on rows it did not grow on, and is
accepted while it stays precise there; what it covers leaves the sample, and the next rule follows.
The list becomes one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
_SPACES = " \t\n\x0b\f\r"

#: What rules can test, from the counts below.
FEATURES: dict[str, str] = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "bar_share": "n_bars / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Settings:
    """``most_rows`` bounds the labelled rows that the driver learns from."""

    most_rows: int = 12_000
    cuts: int = 48
    most_conditions: int = 3
    most_rules: int = 12
    precision: float = 0.9
    support: int = 3


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and features of each whole text; null counts as empty.

    Repeated rows and null ids stay, texts of any length are read whole, an empty table gives an empty
    result, and columns other than the two are ignored, so their names can't clash.

    ``n_repeat_words`` counts the words inside three-word windows that occur twice or more in the
    text. Windows are compared by a 64-bit hash, sorted with their position, so the work is in
    proportion to n log n whatever the number of repeats.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias(id_col), text.alias("_t"))
    bare = F.btrim("_t", F.lit(_SPACES))
    d = d.select(
        id_col,
        "_t",
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE)).alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "").alias("_l"),
    )
    n = F.size("_w")
    windows = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.slice("_w", F.lit(1), F.greatest(n - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)),
        )
    )
    gone = lambda pattern: F.length(F.regexp_replace("_t", pattern, ""))
    d = d.select(
        id_col,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - gone(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.length("_t") - gone("[A-Z]+")).cast("long").alias("n_upper"),
        (F.length("_t") - gone("!+")).cast("long").alias("n_marks"),
        (F.length("_t") - gone(r"\|+")).cast("long").alias("n_bars"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        windows.alias("_g"),
    )
    d = d.withColumn("n_repeat_words", _repeat_words(F.col("_g")).cast("long")).drop("_g")
    return d.withColumns({name: F.expr(rule) for name, rule in FEATURES.items()})


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(windows: Column) -> Column:
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s, i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
    twice = lambda s: F.filter(
        s, lambda x, i: F.coalesce(same(s, i, i - 1), F.lit(False)) | F.coalesce(same(s, i, i + 1), F.lit(False))
    )
    places = F.sort_array(F.transform(_let(placed, twice), lambda x: x["i"]))
    spans = lambda p: F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
    covered = F.aggregate(_let(places, spans), F.lit(0), lambda a, x: a + x)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def learn_rules(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str, settings: Settings) -> list[list[Condition]]:
    """Ordered rules that recognise label 0, from at most ``settings.most_rows`` labelled rows.

    Takes the rows whose ids hash lowest and that pass the base rules. Without rows of both labels
    there are no rules, and everything that passes the base rules is kept.
    """
    chosen = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("_y")).filter("_y in (0, 1)")
    chosen = chosen.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("_y").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(settings.most_rows)
    rows = stats.filter(~base_failed()).join(F.broadcast(chosen), id_col)  # at most most_rows
    rows = rows.select(F.xxhash64(id_col).alias("_h"), "_y", *FEATURES)
    return cover(sorted(tuple(r) for r in rows.collect()), list(FEATURES), settings)


def cover(rows: list[tuple], features: list[str], settings: Settings) -> list[list[Condition]]:
    """Sequential covering over (order, label, features...) rows; sets of rows are bits of an integer."""
    if not rows:
        return []
    grow = sum(1 << i for i in range(len(rows)) if i % 3)
    prune = ((1 << len(rows)) - 1) & ~grow
    bad = sum(1 << i for i, r in enumerate(rows) if r[1] == 0)
    tests: list[tuple[Condition, int]] = []
    for f, name in enumerate(features):
        order = sorted((r[2 + f], i) for i, r in enumerate(rows))
        values = sorted({r[2 + f] for r in rows if r[1] == 0} | {v for v, _ in order[:: max(1, len(order) // 256)]})
        cuts = sorted({values[len(values) * c // settings.cuts] for c in range(settings.cuts)})
        below, j = 0, 0
        for cut in cuts:
            while j < len(order) and order[j][0] < cut:
                below |= 1 << order[j][1]
                j += 1
            tests.append((Condition(name, True, cut), ((1 << len(rows)) - 1) & ~below))
            tests.append((Condition(name, False, cut), below))
    rules: list[list[Condition]] = []
    left = (1 << len(rows)) - 1
    while len(rules) < settings.most_rules and (left & grow & bad):
        conditions = _grown(tests, left & grow, bad, settings)
        conditions = _pruned(conditions, left & prune, bad)
        rule = left
        for _, rows_ in conditions:
            rule &= rows_
        hits, all_ = (rule & prune & bad).bit_count(), (rule & prune).bit_count()
        if not conditions or hits < settings.support or hits < settings.precision * all_:
            break
        rules.append([c for c, _ in conditions])
        left &= ~rule
    return rules


def _grown(tests, rows: int, bad: int, settings: Settings):
    chosen = []
    while len(chosen) < settings.most_conditions and (rows & ~bad):
        p0, n0 = (rows & bad).bit_count(), (rows & ~bad).bit_count()
        before = math.log2(p0 / (p0 + n0)) if p0 else 0.0
        best = (0.0, None)
        for test in tests:
            p = (rows & test[1] & bad).bit_count()
            if p:
                n = (rows & test[1] & ~bad).bit_count()
                gain = p * (math.log2(p / (p + n)) - before)
                if gain > best[0] + 1e-12:
                    best = (gain, test)
        if best[1] is None:
            break
        chosen.append(best[1])
        rows &= best[1][1]
    return chosen


def _pruned(conditions, rows: int, bad: int):
    """Drop last conditions as long as that doesn't lower (p - n) / (p + n) on the pruning rows."""

    def value(upto: int) -> float:
        covered = rows
        for _, test in conditions[:upto]:
            covered &= test
        p, n = (covered & bad).bit_count(), (covered & ~bad).bit_count()
        return (p - n) / (p + n) if p + n else -1.0

    best = len(conditions)
    for upto in range(len(conditions) - 1, 0, -1):
        if value(upto) >= value(best):
            best = upto
    return conditions[:best]


def verdict(rules: list[list[Condition]]) -> Column:
    """The ordered conditional expression of a decision list: false where a rule fires."""
    out = F.lit(True)
    for rule in reversed(rules):
        fires = rule[0].column()
        for condition in rule[1:]:
            fires = fires & condition.column()
        out = F.when(fires, F.lit(False)).otherwise(out)
    return out


def apply_rules(stats: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """``stats`` with ``base_failed`` and ``kept``.

    Defined results: null and empty texts have no words and fail; repeated rows are judged alike; an
    empty table stays empty.
    """
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
