"""Embedding near-dedup by an epsilon grid order join.

Unit vectors have a cosine of at least t exactly if their distance is at most sqrt(2 - 2t), the
epsilon. Projections on the leading principal directions, with the length of what they leave out as
one more coordinate, never lengthen a distance, so vectors are sorted by the grid cells, of side
epsilon, that these coordinates fall into (Boehm et al., 2001). The sequence is cut into blocks. Each
vector descends the intervals of the sequence, skips those whose box lies further from it than
epsilon, and visits the later blocks that remain, so every pair within epsilon meets in one block.
Tasks join parts of bounded size of a block and its visitors, and go on with the recursion over
intervals; what is left is tested by the coordinates and then multiplied in double precision.

The directions and the places of the cuts come from a bounded sample; they decide how much is
skipped, never what is found.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.textwords import U, mix
from factlake.plans.components import connected_components
from factlake.storage import written

#: Vectors of the sample, leading directions, vectors of a block and of a side of a task, and vectors
#: compared at once.
SAMPLE, DIRECTIONS, BLOCK, LEAF = 8192, 16, 16384, 256
#: Blocks whose boxes the driver and each task hold, 272 bytes each. Beyond that many, blocks get
#: larger, tasks don't.
MOST_BLOCKS = 1 << 16
_SIDES = "dim long, block long, i long, j long, row boolean, home boolean, rep long, n long, unit binary"


def embedding_links(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95
) -> DataFrame:
    """Per row of ``vectors``: ``(id_col, n_links, component_id, kept)``.

    All pairs with a cosine of at least ``threshold``, in double precision, are links. Equal vectors
    are joined as one and counted by their number. Each task returns sums and a spanning forest of
    its pairs, so a large group of similar vectors gives no more rows than it has members a task.

    Defined results: a vector that is null, empty or zero, or holds a null or non-finite component,
    and a row with a null id, links with nothing and is its own component (null for a null id) and
    kept; vectors of different lengths don't link; repeated rows are separate vectors; an empty
    table gives an empty result. Other columns, labels among them, are ignored, so their names can't
    clash.
    """
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = source.mapInArrow(_keyed, "id long, key binary, unit binary")
    classes = rows.filter("key is not null and id is not null").groupBy("key").agg(
        F.min("id").alias("rep"), F.count("*").alias("n"), F.first("unit").alias("unit")
    )
    classes = written(classes, "vectors")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_length(batch):
                block, at = grid.place(_matrix(part.column("unit"), dim), part.column("rep").to_numpy())
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(at) + 1) * at.shape[1], pa.int32()), pa.array(at.reshape(-1))
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), dim)), pa.array(block), *(part.column(c) for c in ("rep", "n", "unit")), lists],
                    ["dim", "block", "rep", "n", "unit", "at"],
                )

    total = classes.count()
    grid = _Grid(classes, total, math.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-6) + 1e-6)
    placed = classes.mapInArrow(place, "dim long, block long, rep long, n long, unit binary, at array<double>")
    placed = written(placed, "grid")
    edge = lambda f: [f(F.get("at", F.lit(j))).alias(f"{f.__name__}{j}") for j in range(DIRECTIONS + 1)]
    boxes = placed.groupBy("dim", "block").agg(F.count("*").alias("n"), *edge(F.min), *edge(F.max)).orderBy("dim", "block").collect()
    tree = _Tree([tuple(b) for b in boxes], grid.epsilon)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, block in _placed(batch):
                to, n = np.unique(tree.visits(dim, at, block)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(to), dim)), pa.array(to), pa.array(n)], ["dim", "block", "n"])

    visits = placed.select("dim", "block", "at").mapInArrow(count, "dim long, block long, n long")
    tree.visitors = {(d, b): n for d, b, n in visits.groupBy("dim", "block").agg(F.sum("n")).collect()}
    made = sum(tree.visitors.values())
    logging.getLogger(__name__).info("%d vectors, %d blocks, %d visits of %d", total, len(boxes), made, tree.possible())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column("rep").to_numpy()
            for dim, take, sides in tree.sides(batch, reps):
                for i in range(0, len(take), 8192):
                    part = batch.take(pa.array(take[i : i + 8192]))
                    made = [pa.array(x[i : i + 8192]) for x in sides]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(part.num_rows, dim)), *made, *(part.column(c) for c in ("rep", "n", "unit"))],
                        ["dim", "block", "i", "j", "row", "home", "rep", "n", "unit"],
                    )

    def join(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        rep, n = (table.column(c).to_numpy() for c in ("rep", "n"))
        row, home = (table.column(c).to_numpy(zero_copy_only=False) for c in ("row", "home"))
        unit = _matrix(table.column("unit"), dim)
        return pa.table(dict(zip(("rep", "root", "links"), grid.join(unit, rep, n, row, home, threshold), strict=True)))

    dealt = placed.mapInArrow(spread, _SIDES).groupBy("dim", "block", "i", "j")
    found = written(dealt.applyInArrow(join, "rep long, root long, links long"), "links")
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = connected_components(found, "rep", "root").withColumnRenamed("node", "rep")
    done = classes.drop("unit").join(sums, "rep", "left").join(labels, "rep", "left").select(
        "key", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("c")
    )
    mine = rows.select("id", F.when(F.col("id").isNotNull(), F.col("key")).alias("key"))
    out = mine.join(done, "key", "left")
    component = F.coalesce("c", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(F.col("n") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's id, a 128-bit digest of its vector, and the vector at length 1; null where it can't link."""
    for batch in batches:
        v = batch.column("v")
        sizes = pc.fill_null(pc.list_value_length(v), 0).to_numpy()
        keys: list[bytes | None] = [None] * len(sizes)
        units: list[bytes | None] = [None] * len(sizes)
        for dim in np.unique(sizes[sizes > 0]):
            of = np.flatnonzero(sizes == dim)
            m = pc.fill_null(v.take(pa.array(of)).flatten(), math.nan).to_numpy(zero_copy_only=False).reshape(-1, dim) + 0.0
            good = np.isfinite(m).all(1) & (m != 0).any(1)
            of, m = of[good], m[good]
            u = m / np.abs(m).max(1, keepdims=True)  # scaled first, so that no square overflows or vanishes
            u /= np.sqrt((u * u).sum(1, keepdims=True))
            for i, x, y in zip(of, m, u, strict=True):
                keys[i], units[i] = blake2b(x.tobytes(), digest_size=16).digest(), y.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], ["id", "key", "unit"]
        )


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = pc.binary_length(batch.column("unit")).to_numpy() // 8 if batch.num_rows else np.zeros(0, int)
    for dim in np.unique(sizes):
        yield int(dim), batch.take(pa.array(np.flatnonzero(sizes == dim)))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _placed(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length in a batch: the coordinates and blocks of its vectors."""
    dims = batch.column("dim").to_numpy()
    at = np.asarray(batch.column("at").flatten()).reshape(len(dims), DIRECTIONS + 1) if len(dims) else np.zeros((0, DIRECTIONS + 1))
    for dim in np.unique(dims):
        yield int(dim), at[dims == dim], batch.column("block").to_numpy()[dims == dim]


class _Grid:
    """Directions, grid and cuts of the sequence, for each vector length in the sample."""

    def __init__(self, classes: DataFrame, total: int, epsilon: float):
        self.epsilon = epsilon
        self.blocks = max(1, min(MOST_BLOCKS, -(-total // BLOCK)))
        chosen = classes.select("rep", "unit").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).toArrow()
        self.axes: dict[int, np.ndarray] = {}
        self.cuts: dict[int, np.ndarray] = {}
        for dim, part in _by_length(chosen.combine_chunks().to_batches()[0]) if chosen.num_rows else ():
            unit = _matrix(part.column("unit"), dim)
            centred = unit - unit.mean(0)
            _, axes = np.linalg.eigh(centred.T @ centred)
            self.axes[dim] = axes[:, ::-1][:, :DIRECTIONS].copy()
            key = np.sort(self.keys(self.coordinates(unit), part.column("rep").to_numpy()))
            want = max(1, round(self.blocks * len(key) / chosen.num_rows))
            self.cuts[dim] = key[(np.arange(1, want) * len(key)) // want]

    def coordinates(self, unit: np.ndarray) -> np.ndarray:
        """Projections, filled up with zeros, and the length of what they leave out."""
        dim = unit.shape[1]
        at = unit @ self.axes.get(dim, np.eye(dim)[:, :DIRECTIONS])
        rest = np.sqrt(np.maximum(0, 1 - (at * at).sum(1)))
        return np.concatenate([at, np.zeros((len(at), DIRECTIONS - at.shape[1])), rest[:, None]], 1)

    def keys(self, at: np.ndarray, rep: np.ndarray) -> np.ndarray:
        """Grid order as comparable bytes: the cells, most important first, then a hash of the id."""
        cells = np.clip(np.floor(at / self.epsilon), -(1 << 30), 1 << 30).astype(np.int64) + (1 << 31)
        last = mix(rep.astype(U)).astype(">u8").view(np.uint8).reshape(len(at), 8)
        full = np.concatenate([cells.astype(">u4").view(np.uint8).reshape(len(at), -1), last], 1)
        return np.ascontiguousarray(full).view(f"S{full.shape[1]}").reshape(-1)

    def place(self, unit: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block of each vector, and its coordinates."""
        at = self.coordinates(unit)
        keys = self.keys(at, rep)
        cuts = self.cuts.get(unit.shape[1], np.zeros(0, keys.dtype))
        return np.searchsorted(cuts, keys, "right").astype(np.int64), at

    def join(
        self, unit: np.ndarray, rep: np.ndarray, n: np.ndarray, row: np.ndarray, home: np.ndarray, threshold: float
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors with links, one of their component each, and the weighted numbers of links.

        Rows meet the others. A vector of the block may be both, and a pair of two of them occurs both
        ways round and counts once.
        """
        at = self.coordinates(unit)
        order = np.lexsort((*np.floor(at / self.epsilon).T[::-1], ~row))
        a, b = order[: int(row.sum())], order[int(row.sum()) :]
        boxes_a, boxes_b = _leaves(at, a), _leaves(at, b)
        names, node = np.unique(rep, return_inverse=True)
        links = np.zeros(len(names), np.int64)
        parent = np.arange(len(names))
        todo = [(0, len(boxes_a), 0, len(boxes_b))]
        while todo:
            i, j, k, m = todo.pop()
            if i >= j or k >= m or _apart(boxes_a[i:j], boxes_b[k:m]) > self.epsilon:
                continue
            if j - i > 1 or m - k > 1:
                if j - i >= m - k:
                    h = (i + j) // 2
                    todo += [(i, h, k, m), (h, j, k, m)]
                else:
                    h = (k + m) // 2
                    todo += [(i, j, k, h), (i, j, h, m)]
                continue
            x, y = a[i * LEAF : (i + 1) * LEAF], b[k * LEAF : (k + 1) * LEAF]
            # The coordinates bound the cosine from above, since the rests have at most their lengths' product.
            may = (at[x] @ at[y].T >= threshold - 1e-6) & (~home[y][None, :] | (rep[x][:, None] < rep[y][None, :]))
            if 8 * np.count_nonzero(may) > may.size:
                hit = may & (unit[x] @ unit[y].T >= threshold)
            else:
                p, q = np.nonzero(may)
                hit = np.zeros_like(may)
                hit[p, q] = (unit[x[p]] * unit[y[q]]).sum(1) >= threshold
            if hit.any():
                links[node[x]] += hit @ n[y]
                links[node[y]] += hit.T @ n[x]
                _unite(parent, node[x], node[y], hit)
        some = np.flatnonzero(links)
        return names[some], names[_roots(parent, some)], links[some]


def _leaves(at: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The box of every LEAF vectors in turn: (leaves, 2, directions)."""
    cut = np.arange(0, len(order), LEAF)
    if not len(cut):
        return np.zeros((0, 2, at.shape[1]))
    return np.stack([np.minimum.reduceat(at[order], cut), np.maximum.reduceat(at[order], cut)], 1)


def _apart(a: np.ndarray, b: np.ndarray) -> float:
    """The least distance between the boxes around two runs of boxes."""
    gap = np.maximum(a[:, 0].min(0) - b[:, 1].max(0), b[:, 0].min(0) - a[:, 1].max(0))
    return float(np.sqrt((np.maximum(gap, 0) ** 2).sum()))


def _roots(parent: np.ndarray, of: np.ndarray) -> np.ndarray:
    root = parent[of]
    while (parent[root] != root).any():
        root = parent[root]
    return root


def _unite(parent: np.ndarray, x: np.ndarray, y: np.ndarray, hit: np.ndarray) -> None:
    rx, ry = _roots(parent, x), _roots(parent, y)
    different = hit & (rx[:, None] != ry[None, :])
    i, j = np.nonzero(different)
    if not len(i):
        return
    for u, v in np.unique(np.stack([rx[i], ry[j]], 1), axis=0).tolist():
        while parent[u] != u:
            u = parent[u]
        while parent[v] != v:
            v = parent[v]
        if u != v:
            parent[max(u, v)] = min(u, v)
    everyone = np.concatenate([x, y])
    parent[everyone] = _roots(parent, everyone)


class _Tree:
    """Boxes of the blocks in order, joined into ever longer intervals of the sequence."""

    def __init__(self, boxes: list[tuple], epsilon: float):
        self.epsilon = epsilon
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.size = {(b[0], b[1]): b[2] for b in boxes}
        self.visitors: dict[tuple[int, int], int] = {}
        for dim in {b[0] for b in boxes}:
            mine = [b for b in boxes if b[0] == dim]
            at = np.array([b[3:] for b in mine], float).reshape(len(mine), 2, DIRECTIONS + 1)
            self.of[dim] = (np.array([b[1] for b in mine], np.int64), at)

    def possible(self) -> int:
        """Visits if no block were skipped: each vector's to all later blocks."""
        later = {d: sorted((b, n) for (e, b), n in self.size.items() if e == d) for d in self.of}
        return sum(n * (len(x) - 1 - i) for x in later.values() for i, (_, n) in enumerate(x))

    def visits(self, dim: int, at: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which vectors may have one within epsilon in which later blocks."""
        names, boxes = self.of[dim]
        who, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        todo = [(0, len(names), np.arange(len(at)))]
        while todo:
            i, j, some = todo.pop()
            some = some[block[some] < names[j - 1]]
            low, high = boxes[i:j, 0].min(0), boxes[i:j, 1].max(0)
            gap = np.maximum(np.maximum(low - at[some], at[some] - high), 0)
            some = some[(gap * gap).sum(1) <= self.epsilon * self.epsilon]
            if not len(some):
                continue
            if j - i == 1:
                who.append(some)
                to.append(np.full(len(some), names[i]))
            else:
                todo += [(i, (i + j) // 2, some), ((i + j) // 2, j, some)]
        return np.concatenate(who), np.concatenate(to)

    def sides(self, batch: pa.RecordBatch, reps: np.ndarray) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, ...]]]:
        """For each length: the rows of the batch to send, and (block, i, j, row, home) of each.

        A block of H vectors with V visitors has H / BLOCK parts of rows and (H + V) / BLOCK parts of
        others, and a task for each pair of them.
        """
        dims = batch.column("dim").to_numpy()
        for dim, at, block in _placed(batch):
            rows = np.flatnonzero(dims == dim)
            who, to = self.visits(dim, at, block)
            names, _ = self.of[dim]
            size = np.array([self.size[dim, b] for b in names.tolist()])
            guests = np.array([self.visitors.get((dim, b), 0) for b in names.tolist()])
            parts, others = -(-size // BLOCK), -(-(size + guests) // BLOCK)
            place = mix(reps[rows].astype(U)) >> U(1)
            own = np.searchsorted(names, block)
            out = []
            for side, one, number, home in (
                (True, np.arange(len(rows)), own, True),
                (False, np.arange(len(rows)), own, True),
                (False, who, np.searchsorted(names, to), False),
            ):
                fixed, copies = (parts, others) if side else (others, parts)
                mine = (place[one] % fixed[number].astype(U)).astype(np.int64)
                take = np.repeat(np.arange(len(one)), copies[number])
                step = np.arange(len(take)) - np.repeat(np.cumsum(copies[number]) - copies[number], copies[number])
                i, j = (mine[take], step) if side else (step, mine[take])
                out.append((rows[one[take]], names[number[take]], i, j, np.full(len(take), side), np.full(len(take), home)))
            take, *sides = (np.concatenate(x) for x in zip(*out, strict=True))
            yield dim, take, tuple(sides)


LINKS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
lowest AS (SELECT a, min(b) AS m FROM reach GROUP BY a), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN lowest ON lowest.a = vec_id LEFT JOIN counts ON counts.a = vec_id
"""
