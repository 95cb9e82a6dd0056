"""Importance resampling towards a target distribution, over word tries.

Features are runs of words, hashed into buckets by the CRC-32 of their text. Each task keeps a trie of
the runs that it has read: a node stands for a run, its children for the run with one word more. A node
counts its feature, and holds the CRC state of its text, from which a child's follows by feeding the
next word alone, so a run's text is never built or hashed as a whole. The nodes' counts are added up by
bucket, in the task and then over all tasks, which gives a gain for each bucket: the logarithm of how
much likelier the target is to use it. In a second pass documents walk tries whose nodes have the gains
attached, and the mean gain of a document's features is its weight. A Gumbel variate, drawn from a hash
of the row's key, is added to the weight; the highest sums are a sample without replacement.

A trie is kept as arrays, one level for each length of run: a node is a pair of its parent and a word,
numbered in the order in which pairs were met.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.llm.textwords import LOWER, slices, utf8
from factlake.storage import written

#: Bytes that words are made of, after A-Z are lower-cased: digits, letters, everything beyond ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass(frozen=True)
class Settings:
    """Longest run of words that is a feature, buckets, share and length of drawn documents, seed of the draw.

    ``most_nodes`` bounds a task's trie; beyond it the trie is emptied into the bucket totals, or started
    anew, which changes no result.
    """

    longest: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: int = 2024
    most_nodes: int = 1 << 18


def word_table(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """For a column of texts: which distinct word each word is, those words, and each text's first word."""
    data, offsets = utf8(texts)
    data = LOWER[data]
    inside = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (~np.r_[False, inside[:-1]][: len(data)] | edge[:-1]))
    ends = np.flatnonzero(inside & (~np.r_[inside[1:], False][: len(data)] | edge[1:])) + 1
    where = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=where[1:])
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(where), pa.py_buffer(data[inside])])
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), np.searchsorted(starts, offsets)


class Trie:
    """Runs of up to ``longest`` words: a node's CRC state, and how often its run was met."""

    def __init__(self, longest: int):
        self.longest = longest
        self.words: dict[bytes, int] = {}
        self.text: list[bytes] = []
        self.children: list[dict[int, int]] = [{} for _ in range(longest)]
        self.crc: list[list[int]] = [[] for _ in range(longest)]
        self.count = [np.zeros(0, np.int64) for _ in range(longest)]

    def __len__(self) -> int:
        return sum(map(len, self.crc))

    def walk(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length of run: the node and the text of every occurrence. Unknown runs become nodes."""
        index, distinct, first = word_table(texts)
        known = np.fromiter((self._word(w) for w in distinct), np.int64, len(distinct))
        word = known[index] if len(index) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        node = np.zeros(len(word), np.int64)
        at = np.arange(len(word))
        for level in range(self.longest):
            node = self._step(level, node, word[at + level])
            yield node, owner[at]
            more = (at + level + 1 < len(word)) & (owner[np.minimum(at + level + 1, len(word) - 1)] == owner[at]) if len(at) else at > 0
            at, node = at[more], node[more]

    def _word(self, word: bytes) -> int:
        i = self.words.setdefault(word, len(self.text))
        if i == len(self.text):
            self.text.append(word)
        return i

    def _step(self, level: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The children of ``parent`` nodes by ``word``; the states of new ones continue their parents'."""
        pair, which = np.unique(parent << 32 | word, return_inverse=True)
        children, crc = self.children[level], self.crc[level]
        nodes = np.empty(len(pair), np.int64)
        for k, p in enumerate(pair.tolist()):
            n = children.get(p)
            if n is None:
                n = children[p] = len(crc)
                text = self.text[p & 0xFFFFFFFF]
                crc.append(zlib.crc32(b" " + text, self.crc[level - 1][p >> 32]) if level else zlib.crc32(text))
            nodes[k] = n
        return nodes[which]

    def add(self, texts: pa.Array) -> None:
        """Count every run of the texts at its node."""
        for level, (node, _) in enumerate(self.walk(texts)):
            met = np.bincount(node, minlength=len(self.crc[level]))
            met[: len(self.count[level])] += self.count[level]
            self.count[level] = met

    def totals(self, buckets: int) -> np.ndarray:
        """The counts of all nodes, added up by bucket."""
        out = np.zeros(buckets, np.int64)
        for crc, count in zip(self.crc, self.count, strict=True):
            np.add.at(out, np.array(crc, np.int64) % buckets, count)
        return out


def bucket_totals(texts: DataFrame, text_col: str, settings: Settings) -> DataFrame:
    """``(bucket, n)``: how many features of all texts fall into each bucket that has any."""
    source = texts.select(F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, total = Trie(settings.longest), np.zeros(settings.buckets, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                trie.add(batch.column("text"))
                if len(trie) > settings.most_nodes:
                    total += trie.totals(settings.buckets)
                    trie = Trie(settings.longest)
        total += trie.totals(settings.buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"])

    return source.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, settings: Settings) -> np.ndarray:
    """The gain of every bucket: 1000 times the logarithm of target share over source share, one added to each count.

    Only the gains reach the driver, as many as there are buckets.
    """
    spark, n = source.sparkSession, settings.buckets
    both = spark.range(n).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    counts = written(both.select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t"))), "buckets")
    all_s, all_t = counts.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + 1) * F.lit(all_s + n) / ((F.col("s") + 1) * F.lit(all_t + n))
    rows = counts.select("bucket", F.floor(1000 * F.log(ratio)).cast("long")).collect()
    gains = np.zeros(n, np.int64)
    gains[[b for b, _ in rows]] = [g for _, g in rows]
    return gains


def score(docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str, settings: Settings) -> DataFrame:
    """Per row of ``docs``: ``(id, n_words, n_features, weight, score)``, the score with the row's Gumbel variate."""
    shared = docs.sparkSession.sparkContext.broadcast(np.asarray(gains, np.int64))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, gain = Trie(settings.longest), [np.zeros(0, np.int64)] * settings.longest
        for whole in batches:
            for batch in slices(whole, "text"):
                total, n, words = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
                for level, (node, owner) in enumerate(trie.walk(batch.column("text"))):
                    crc = np.array(trie.crc[level][len(gain[level]) :], np.int64)
                    gain[level] = np.append(gain[level], shared.value[crc % settings.buckets])
                    met = np.bincount(owner, minlength=batch.num_rows)
                    words = words if level else met
                    n += met
                    np.add.at(total, owner, gain[level][node])
                weight = pc.if_else(pa.array(n > 0), pa.array(total // np.maximum(n, 1)), pa.scalar(0, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words), pa.array(n), weight], ["id", "n_words", "n_features", "weight"])
                if len(trie) > settings.most_nodes:
                    trie, gain = Trie(settings.longest), [np.zeros(0, np.int64)] * settings.longest

    kind = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + gumbel(F.col("id"), settings.seed))


def gumbel(key: Column, seed: int) -> Column:
    """1000 times a Gumbel variate, floored, from the first 32 bits of a SHA-256 of seed and key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def rank_highest(scored: DataFrame, settings: Settings) -> DataFrame:
    """``scored`` with ``rank``, from 1 on, for the share of the long enough rows that scores highest; null for others.

    ``scored`` must be a written table, as it is read several times. Scores are integers within some
    60,000 of each other, so the rows above each score are counted from a histogram, in two steps: blocks
    of scores, then scores. Only rows at or above the last score drawn are sorted, each score by itself;
    as each key has its own variate, no score has more than a fraction of a percent of the keys.
    """
    width = 64
    long_enough = F.col("n_words") >= settings.least_words
    histogram = scored.filter(long_enough).groupBy("score").agg(F.count("*").alias("n"))
    histogram = histogram.withColumn("block", F.floor(F.col("score") / width))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = histogram.groupBy("block").agg(F.sum("n").alias("n_block"))
    blocks = blocks.withColumn("above_block", F.coalesce(F.sum("n_block").over(before(Window.orderBy(F.desc("block")))), F.lit(0)))
    within = F.coalesce(F.sum("n").over(before(Window.partitionBy("block").orderBy(F.desc("score")))), F.lit(0))
    drawn = scored.filter(long_enough).count() * settings.percent // 100
    above = histogram.withColumn("within", within).join(F.broadcast(blocks), "block")
    above = above.select("score", (F.col("within") + F.col("above_block")).alias("above"))
    above = above.filter(F.col("above") < drawn)  # the scores that someone is drawn from
    order = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_words", "n_features", "weight")
    ranked = scored.filter(long_enough).join(F.broadcast(above), "score").withColumn("rank", F.col("above") + F.row_number().over(order))
    names = scored.columns
    ranked = ranked.select(*names, F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank"))
    kept = F.broadcast(above.select("score", F.lit(True).alias("near")))
    rest = scored.join(kept, "score", "left").filter(~long_enough | F.col("near").isNull())
    return ranked.unionByName(rest.select(*names, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """Per row of ``docs``: ``(id, n_words, n_features, weight, score, rank)``; drawn rows have a rank.

    ``target`` has texts in a column ``text_col`` too. Features are counted over all rows of both.

    Defined results: null and wordless texts have no features and weight 0; a text of any length is
    read whole, by one task; rows of one id have one variate, and a null id's is that of an empty key; of
    equal scores the smaller id comes first, null ids last, and rows alike in all columns in any order;
    an empty target gives every bucket a target count of 0, an empty table an empty result; other
    columns are ignored, so their names can't clash.
    """
    settings = settings or Settings()
    gains = bucket_gains(bucket_totals(docs, text_col, settings), bucket_totals(target, text_col, settings), settings)
    return rank_highest(written(score(docs, gains, id_col, text_col, settings), "scored"), settings)


#: CRC-32 of the hex digits ``x`` of some bytes, from the polynomial.
CRC_SQL = """crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS tab)"""


def crc_sql(x: str) -> str:
    each = f"list_transform(range(len({x}) // 2), lambda i: ('0x' || substr({x}, 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({each}, lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295)"


RESAMPLE_SQL = rf"""
WITH {CRC_SQL},
texts AS (SELECT true AS own, doc_id AS id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark),
said AS (SELECT own, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
counts AS (SELECT own, id, word, count(*) AS n FROM said GROUP BY ALL),
hashed AS (SELECT word, {crc_sql("hex(word)")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM counts), crc_table),
b AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM counts JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM b),
gains AS (SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * (all_s + 10000) / ((s::DOUBLE + 1) * (all_t + 10000))))::BIGINT AS gain FROM b, sums),
weights AS (SELECT id AS doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n)::DOUBLE)::BIGINT AS weight
  FROM counts JOIN hashed USING (word) JOIN gains USING (bucket) WHERE own GROUP BY id),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS all_n FROM scored WHERE n_features >= 20)
SELECT s.*, r.rank FROM scored s LEFT JOIN (SELECT doc_id, rank FROM ranked WHERE rank <= all_n * 10 // 100) r USING (doc_id)
"""
