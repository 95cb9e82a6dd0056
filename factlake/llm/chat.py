"""Chat formatting of reply trees.

Messages form trees by their parents. Iterative self-joins double the reach of every message's link
to an ancestor, summing scores on the way, so a tree of depth d takes log d joins. Leaves are ranked
by the score of their path, and the same links, taken from the longest to the shortest, enumerate
the messages of the chosen paths. Each path is formatted as one conversation.

A control string of the template can't occur in a formatted text: every ``<``, followed by any
number of backslashes and ``|``, gets one backslash more, and reading back takes it away again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.storage import written

START, END = "<|im_start|>", "<|im_end|>"
PROBE = "<|im_end|><|im_start|>assistant ok"
_MARK, _MARKED = r"<(\\*)\|", r"<(\\*)\\\|"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _MARK, r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _MARKED, "<$1|")


def escape_role(role: Column) -> Column:
    """As ``escape``; line breaks, which end a role, and backslashes are escaped before."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The messages and conversation -1, whose two texts consist of control strings."""
    rows = f"(-1L, 0L, 'user', '{PROBE}'), (-1L, 1L, 'assistant', '{PROBE}')"
    probe = conversations.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(conv_id, turn, role, text)")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def linear_tree(messages: DataFrame) -> DataFrame:
    """Conversations without branches as trees: each message replies to the one before.

    Messages are ordered by turn, nulls first, then by role and text; all score 0. Null conversation
    ids form one conversation, repeated messages stay, an empty table gives an empty result, and other
    columns are ignored.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    rows = messages.withColumn("node", node)
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select("conv_id", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def best_paths(tree: DataFrame, most: int = 1) -> DataFrame:
    """The ``most`` best root-to-leaf paths of each tree: ``(conv_id, path, above, role, text)``.

    ``tree`` has (conv_id, node, parent, role, text, score); ``path`` counts from 1, the best score
    first, and equal scores by leaf; ``above`` is the number of messages between this one and the leaf.

    Defined results: a parent that isn't in the tree counts as none; a null score counts as 0;
    messages that reply to themselves, over however many steps, lead to no root and are left out;
    null conversation ids form one tree; of messages with the same id in a tree one is kept, the
    first in order of role and text; texts of any length stay whole; an empty table gives an empty
    result. Other columns are ignored, so their names can't clash.
    """
    first = Window.partitionBy("conv_id", "node").orderBy("parent", "role", "text", "score")
    tree = tree.select("conv_id", "node", "parent", "role", "text", "score").filter("node is not null")
    tree = tree.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    tree = tree.withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(0.0)))
    # A struct compares null-safely, so a null id joins with itself.
    tree = written(tree.withColumn("tree", F.struct("conv_id")), "messages")
    ids = tree.select("tree", F.col("node").alias("up"), F.col("score").alias("s"))
    link = written(
        tree.select("tree", "node", F.col("parent").alias("up")).join(ids, ["tree", "up"]).select("tree", "node", "up", "s"),
        "links",
    )
    links = []
    n = link.count()
    most_rounds, size = max(1, tree.count()).bit_length() + 1, n
    while size and len(links) < most_rounds:
        links.append(link)
        further = link.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("s").alias("s2"))
        link = link.join(further, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("s") + F.col("s2")).alias("s"))
        link = written(link, "links")
        size = link.count()
    endless = link.select("tree", "node") if size else None
    # The root's own score and all between it and a message, from links of falling length.
    at = tree.select("tree", "node", F.col("node").alias("at"), F.col("score").alias("total"))
    parents = tree.select("tree", F.col("parent").alias("node")).filter("node is not null").distinct()
    at = at.join(parents, ["tree", "node"], "left_anti")
    if endless is not None:
        at = at.join(endless, ["tree", "node"], "left_anti")
    for link in reversed(links):
        step = link.select("tree", F.col("node").alias("at"), "up", "s")
        at = at.join(step, ["tree", "at"], "left").select(
            "tree", "node", F.coalesce("up", "at").alias("at"), (F.col("total") + F.coalesce("s", F.lit(0.0))).alias("total")
        )
    rank = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    chosen = at.withColumn("path", F.row_number().over(rank)).filter(F.col("path") <= most)
    on = written(chosen.select("tree", "path", "node", F.lit(0).cast("long").alias("above")), "leaves")
    for power in reversed(range(len(links))):
        step = links[power].select("tree", "node", "up")
        more = on.join(step, ["tree", "node"]).select("tree", "path", F.col("up").alias("node"), (F.col("above") + (1 << power)).alias("above"))
        on = written(on.unionByName(more), "path")  # each round reads it twice: an unwritten plan would double
    return on.join(tree.select("tree", "node", "conv_id", "role", "text"), ["tree", "node"]).select(
        "tree", "conv_id", "path", "above", "role", "text"
    )


def format_paths(paths: DataFrame) -> DataFrame:
    """``(conv_id, path, formatted, loss)``; ``loss`` has the (start, length) of assistant texts.

    Offsets count code points. Null roles and texts are formatted as empty, a text of any length
    whole; an empty table gives an empty result. A conversation becomes one row, so it is one task's
    work.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = paths.select("tree", "conv_id", "path", "above", "role", escape_role(role).alias("r"), escape(text).alias("t"))
    rows = rows.withColumn("piece", F.concat(F.lit(START), "r", F.lit("\n"), "t", F.lit(END + "\n")))
    before = Window.partitionBy("tree", "path").orderBy(F.desc("above")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + len(START) + F.length("r") + 1
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start"), F.length("t").cast("long").alias("length")))
    rows = rows.withColumn("start", start).withColumn("span", span)
    order = F.struct((-F.col("above")).alias("place"), "piece", "span")
    out = rows.groupBy("tree", "path").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(order)).alias("all"))
    return out.select(
        "conv_id",
        "path",
        F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("all", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) of each turn of a formatted conversation."""
    cut = F.split(formatted, START.replace("|", r"\|"))
    body = F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0)))
    role = lambda x: F.substring_index(x, "\n", 1)
    text = lambda x: F.substring(x, F.length(role(x)) + 2, F.length(x) - F.length(role(x)) - len(END) - 2)
    return F.transform(body, lambda x: F.struct(unescape_role(role(x)).alias("role"), unescape(text(x)).alias("text")))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text and its loss mask say, read back from them: a row for each, repeats kept."""
    rows = formatted.withColumn("turns", read_turns(F.col("formatted")))
    rows = rows.withColumn(
        "learnt",
        F.array_join(
            F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), x["length"].cast("int")))), ""
        ),
    )
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


DIGEST_SQL = rf"""
WITH said AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')),
parts AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS escaped FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({len(START) + len(END) + 2} + length(role) + length(escaped))::BIGINT AS formatted_chars
FROM parts GROUP BY conv_id
"""
