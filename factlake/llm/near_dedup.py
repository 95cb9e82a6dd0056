"""MinHash near-dedup by SetSketch registers.

A document's set is its distinct five-word shingles. Register i of its SetSketch (Ertl, 2021) holds
``floor(1 - log_b(min h_i))``, where h_i of each shingle is exponential: an exponentially spaced,
truncated minimum. Registers merge by maximum, agree with a probability that follows the Jaccard
similarity, and two sketches give a likelihood of the similarity through the numbers of registers
that are larger, equal and smaller.

The plan: texts of equal words collapse to one row first, by a 128-bit digest; runs of registers
become band keys; each bucket of a band links its members to its smallest id, which keeps the pairs
linear in the bucket; the likelihood estimate thins them, and the full sets decide. Buckets whose
members are then still in different components get every such pair compared, block against block, so
no pair that shares a band is lost; pairs inside one component need no test, since they can't change
the result. Hashes only find links: each link that is used is confirmed on the words themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.textwords import U, Words, mix, phrases, release, slices, split_words
from factlake.plans.components import connected_components
from factlake.storage import written

#: SetSketch parameters: base and rate of the registers, and their largest value.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: A pair is verified if the estimate is at least the threshold less so many standard errors.
DEVIATIONS = 5.0
#: Rows of one side of a block comparison, and shingles in all its sets together.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
#: Set sizes by which hashes that collide may mislead before the words are looked at.
SLACK = 2


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a text of fewer words is one shingle."""
    return _sets(split_words(texts, lower=True), width)


def _sets(words: Words, width: int) -> list[np.ndarray]:
    h = words.hashes()
    found, at = phrases(h, words.first, width)
    cut = np.searchsorted(at, words.first)
    out = []
    for d, n in enumerate(words.counts):
        if 0 < n < width:
            short = h[words.first[d] : words.first[d + 1]]
            whole = U(int(n))
            for x in short:
                whole = mix(whole ^ x)
            out.append(np.atleast_1d(whole).astype(U))
        else:
            out.append(np.unique(found[cut[d] : cut[d + 1]]))
    return out


def sketch_sets(sets: list[np.ndarray], registers: int) -> np.ndarray:
    """SetSketch of each non-empty set: an array (sets, registers) of 16-bit registers."""
    rng = np.random.default_rng(5)
    salt, factor = rng.integers(0, 1 << 32, (2, registers), np.uint32)
    factor |= np.uint32(1)
    sizes = np.array([len(s) for s in sets], np.int64)
    lowest = np.full((len(sets), registers), np.uint32(0xFFFFFFFF))
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + sizes[j] <= 1 << 14):
            n += sizes[j]
            j += 1
        if n:
            h = (np.concatenate(sets[i:j]) >> U(32)).astype(np.uint32)
            full = np.flatnonzero(sizes[i:j])
            cuts = (np.cumsum(sizes[i:j]) - sizes[i:j])[full]
            work = np.empty_like(h)
            for r in range(registers):
                np.bitwise_xor(h, salt[r], out=work)
                np.multiply(work, factor[r], out=work)
                lowest[i + full, r] = np.minimum.reduceat(work, cuts) if len(cuts) > 1 else work.min()
        i = j
    with np.errstate(divide="ignore"):
        least = -np.log1p(-(lowest.astype(np.float64) + 0.5) / 4294967296.0) / RATE
        return np.clip(np.floor(1 - np.log(least) / math.log(BASE)), 0, TOP).astype(np.uint16)


def merge_sketches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def estimate_similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of most likelihood, for rows of sketches with known set sizes.

    The registers of a that are larger, of b that are larger, and the equal ones are three outcomes
    whose probabilities depend on the sizes and the similarity; bisection finds the similarity at
    which the log-likelihood stops rising (it is concave between 0 and its largest possible value).
    """
    more = (a > b).sum(1).astype(float)
    less = (a < b).sum(1).astype(float)
    same = a.shape[1] - more - less
    u = size_a / (size_a + size_b)
    v = 1 - u
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u) * (1 - 1e-9)
    log_b, k = math.log(BASE), (BASE - 1) / BASE
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * k) / log_b
    slope = lambda x: k / (1 - np.clip(x, 0, 1) * k) / log_b
    for _ in range(40):
        j = (low + high) / 2
        x, y = u - v * j, v - u * j
        px, py = np.maximum(p(x), 1e-300), np.maximum(p(y), 1e-300)
        dx, dy = -v * slope(x), -u * slope(y)
        rising = more * dx / px + less * dy / py - same * (dx + dy) / np.maximum(1 - px - py, 1e-300) > 0
        low, high = np.where(rising, j, low), np.where(rising, high, j)
    return (low + high) / 2


def set_sketches(docs: DataFrame, id_col: str, text_col: str, width: int, registers: int) -> DataFrame:
    """``(id, n_shingles, d1, d2, sketch)`` of every text; d1 and d2 are a digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = split_words(batch.column("text"), lower=True)
                sets = _sets(words, width)
                regs = sketch_sets(sets, registers)
                raw = words.data.tobytes()
                said = (b" ".join(_word_list(raw, words, i)) for i in range(len(sets)))
                digests = (blake2b(w, digest_size=16).digest() for w in said)
                d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(d[:, 0]),
                        pa.array(d[:, 1]),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                    ],
                    ["id", "n_shingles", "d1", "d2", "sketch"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, n_shingles long, d1 long, d2 long, sketch binary")


def _bands(reps: DataFrame, rows: int, registers: int) -> DataFrame:
    n = registers // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = _registers(batch.column("sketch"), registers)[:, : n * rows].reshape(-1, n, rows)
            key = mix(np.arange(1, n + 1, dtype=U))[None, :].repeat(len(regs), 0)
            for r in range(rows):
                key = mix(key ^ regs[:, :, r].astype(U))
            ids = batch.column("rep").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.reshape(-1).astype(np.int64)), pa.array(np.repeat(ids, n))], ["key", "rep"]
            )

    return reps.select("rep", "sketch").mapInArrow(run, "key long, rep long")


def _registers(column: pa.Array, registers: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, registers)


def _likely(pairs: DataFrame, reps: DataFrame, registers: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sketches don't rule out the threshold."""
    side = lambda c: reps.select(
        F.col("rep").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")
    )
    floor = _floor(percent / 100, registers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_registers(batch.column(c), registers) for c in ("sa", "sb"))
                na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
                keep = estimate_similarity(a, b, na, nb) >= floor
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    joined = pairs.join(side("b"), "b").join(side("a"), "a").filter(near)
    return joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _floor(threshold: float, registers: int) -> float:
    return threshold - DEVIATIONS * math.sqrt(threshold * (1 - threshold) / registers)


def _word_list(raw: bytes, words: Words, i: int) -> list[bytes]:
    """The words of text i; ``raw`` is ``words.data`` as bytes, which split at the same six spaces."""
    a, b = words.first[i], words.first[i + 1]
    return raw[words.starts[a] : words.ends[b - 1]].split() if b > a else []


def _linked(a: list[bytes], b: list[bytes], width: int, percent: int) -> bool:
    """Whether the shingles of two lists of words, compared as words, have enough in common."""
    x, y = ({tuple(w)} if len(w) < width else set(zip(*(w[k:] for k in range(width)), strict=False)) for w in (a, b))
    both = len(x & y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, texts: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets have 100 * intersection >= percent * union.

    The partners of one a are cut into parts of bounded size, each of which gets a's text once.
    """
    sizes = pairs.join(reps.select(F.col("rep").alias("b"), "n_shingles"), "b")
    parts = sizes.groupBy("a").agg(F.ceil(F.greatest(F.sum("n_shingles") / BLOCK_SHINGLES, F.count("*") / BLOCK)).alias("parts"))
    parts = written(parts, "parts")
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    members = dealt.join(texts.select(F.col("id").alias("b"), "text"), "b")
    pivots = parts.join(texts.select(F.col("id").alias("a"), "text"), "a")
    pivots = pivots.select("a", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    rows = pivots.unionByName(members.select("a", "part", "b", "text")).repartition("a", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, mine, said = None, np.zeros(0, U), []
        for whole in batches:
            for batch in slices(whole, "text"):
                words = split_words(batch.column("text"), lower=True)
                sets, raw = _sets(words, width), words.data.tobytes()
                places = zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b")), strict=True)
                out: tuple[list, list] = ([], [])
                for i, (a, part, b) in enumerate(places):
                    if b is None:
                        of, mine, said = (a, part), sets[i], _word_list(raw, words, i)
                    elif of == (a, part):
                        both = len(np.intersect1d(mine, sets[i], assume_unique=True)) + SLACK
                        near = 100 * both >= percent * (len(mine) + len(sets[i]) - both)
                        if near and _linked(said, _word_list(raw, words, i), width, percent):
                            out[0].append(a)
                            out[1].append(b)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    in_order = rows.sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return in_order.mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.join(wanted, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))


def _links_between(mixed: DataFrame, texts: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """Links of one bucket between different components; mixed: (key, rep, c).

    Only members outside the bucket's largest component, the strays, need a comparison with all
    others. Blocks of strays meet blocks of members, each pair of blocks in one task, which counts
    all intersections by matrix products over the shared shingles and returns a spanning forest of
    the links, not the pairs. So a member is copied once for each block of strays.
    """
    sized = mixed.join(reps.select("rep", "n_shingles"), "rep")
    per = sized.groupBy("key", "c").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    top = per.groupBy("key").agg(
        F.max(F.struct("n", (-F.col("c")).alias("c"), "s")).alias("m"), F.sum("n").alias("n"), F.sum("s").alias("s")
    )
    blocks = lambda n, s: F.ceil(F.greatest(n / BLOCK, s / BLOCK_SHINGLES, F.lit(1.0)))
    top = top.select(
        "key", (-F.col("m.c")).alias("top"), blocks(F.col("n"), F.col("s")).alias("n_all"),
        blocks(F.col("n") - F.col("m.n"), F.col("s") - F.col("m.s")).alias("n_stray"),
    )
    placed = mixed.join(top, "key").withColumns({"col": F.pmod(F.xxhash64("rep"), "n_all"), "row": F.pmod(F.xxhash64("rep"), "n_stray")})
    side = lambda stray, row, col: ("key", "rep", "c", F.lit(stray).alias("stray"), row.alias("row"), col.alias("col"))
    every = lambda n: F.explode(F.expr(f"sequence(0L, {n} - 1)"))
    members = placed.select(*side(False, every("n_stray"), F.col("col")))
    strays = placed.filter("c <> top").select(*side(True, F.col("row"), every("n_all")))
    spread = members.unionByName(strays).join(texts.select(F.col("id").alias("rep"), "text"), "rep")

    def run(table: pa.Table) -> pa.Table:
        release()
        ids, comp = (table.column(c).to_numpy() for c in ("rep", "c"))
        stray = table.column("stray").to_numpy(zero_copy_only=False)
        a, b = [], []
        if stray.any() and not stray.all():
            words = split_words(table.column("text"), lower=True)
            raw = words.data.tobytes()
            names, comp = np.unique(comp, return_inverse=True)
            row, col = np.flatnonzero(stray), np.flatnonzero(~stray)
            found = _similar(_sets(words, width), row, percent)[:, col] & (comp[row][:, None] != comp[col][None, :])
            root = list(range(len(names)))
            for i, j in zip(*np.nonzero(found), strict=True):
                i, j = row[i], col[j]
                x, y = comp[i], comp[j]
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                if x != y and _linked(_word_list(raw, words, i), _word_list(raw, words, j), width, percent):
                    root[x] = y
                    a.append(ids[i])
                    b.append(ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return spread.groupBy("key", "row", "col").applyInArrow(run, "a long, b long")


def _similar(sets: list[np.ndarray], some: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets named in ``some`` may be similar to which of all sets, as a matrix."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[token] > 1
    number = np.cumsum(seen > 1) - 1
    owner, token = owner[shared], number[token[shared]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    both = np.zeros((len(some), len(sets)), np.float32)
    for low in range(0, int(token[-1]) + 1 if len(token) else 0, 4096):
        i, j = np.searchsorted(token, (low, low + 4096))
        held = np.zeros((len(sets), 4096), np.float32)
        held[owner[i:j], token[i:j] - low] = 1
        both += held[some] @ held.T
    both = both.astype(np.int64) + SLACK
    return 100 * both >= percent * (sizes[some][:, None] + sizes[None, :] - both)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 75,
    registers: int = 256,
    rows: int = 5,
) -> DataFrame:
    """Per row of ``docs``: ``(id_col, n_shingles, component_id, kept)``.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; two texts are linked if
    100 * |A & B| >= percent * |A | B| over their distinct shingles of ``width`` words. At 75 percent
    a pair misses all of the 51 bands of five registers with probability 1e-6.

    Defined results: a null or wordless text has an empty set and links with nothing, so it is its
    own component; equal texts are linked whatever their number; a repeated row is returned as often
    as it occurs; a row with a null id gets a null component and is kept; of different texts with one
    id, equal ones stay linked and the greatest decides all other links; a text of any length is
    compared whole, and is read at once by a task; an empty table gives an empty result. Other columns are ignored, so their
    names can't clash.
    """
    sketches = written(set_sketches(docs, id_col, text_col, width, registers), "sketches")
    full = sketches.filter("n_shingles > 0 and id is not null")
    reps = written(
        full.groupBy("d1", "d2").agg(
            F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")
        ),
        "classes",
    )
    bands = _bands(reps, rows, registers)
    shared = bands.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("cnt")).filter("cnt > 1")
    members = written(bands.join(shared, "key"), "buckets")
    wanted = members.select(F.col("rep").alias("id")).distinct()
    texts = written(_texts(docs, id_col, text_col, wanted), "texts")

    stars = members.filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    likely = written(_likely(stars, reps, registers, percent), "likely")
    first = _verified(likely, texts, reps, width, percent)
    found = written(connected_components(first, "a", "b"), "components")

    labelled = members.filter("cnt > 2").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = labelled.select("key", "rep", F.coalesce("component", "rep").alias("c"))
    split = labelled.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x <> y").select("key")
    mixed = written(labelled.join(split, "key", "left_semi"), "mixed")
    second = _links_between(mixed, texts, reps, width, percent)
    label = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    lifted = second.join(label("a"), "a", "left").join(label("b"), "b", "left")
    lifted = lifted.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    again = written(connected_components(lifted, "a", "b"), "components")

    joined = reps.select("d1", "d2", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    joined = joined.select("d1", "d2", F.coalesce("component", "rep").alias("node"))
    classes = joined.join(again, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("c"))
    out = sketches.select("id", "n_shingles", "d1", "d2").join(classes, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(
        F.col("id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS words
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i + 1:i + 5], ' ') AS s
  FROM (SELECT *, unnest(range(greatest(1, len(words) - 4))) AS i FROM w WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
lowest AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest ON a = doc_id
"""
