"""SentencePiece encoding and decoding with Gumbel top-k sampling without replacement.

A text's lattice has a node at every byte and an edge for every piece of the vocabulary; characters
without a piece of their own have an edge for each byte. A segmentation's probability is the product
of its pieces' weights, which follow the rank of the piece in the vocabulary by Zipf's law, since a
byte-pair model has ranks but no probabilities.

Sampling is an A* search over perturbed log-probabilities (Maddison et al., 2014; Kool et al., 2019).
A subspace of segmentations is a prefix and the pieces not allowed next; its bound is the largest
perturbed log-probability in it, a Gumbel variable at the logarithm of the subspace's mass, cut off at
its parent's bound. The search opens the subspace of the highest bound, draws the segmentation that
attains it, and divides the rest of the subspace by the first piece that differs. The k
segmentations found first are a sample of k without replacement; the bound of the next one gives
the inclusion probabilities. All random numbers are hashes of the row's key and a position, so
results don't depend on how rows are spread over tasks.

No piece crosses from a character other than a space to a space, or over a line break, so the
lattice falls into segments between such places. Each distinct segment of a batch is built once, with
array operations over all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.textwords import U, Words, loosened, mix, slices, utf8

#: Bytes of text whose lattice is in a worker's memory at once; the samples don't depend on it.
SLICE = 1 << 20
_SPACE = "▁"
_SLOT_BITS = 20
_GOLD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class Vocabulary:
    """The pieces of a SentencePiece model, as bytes with a plain space for the space mark."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.bytes: list[bytes] = [b""] * n
        byte_ids = np.full(256, -1, np.int32)
        pieces: list[int] = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.bytes[i] = bytes([value])
                byte_ids[value] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes[i] = piece.replace(_SPACE, " ").encode()
                pieces.append(i)
                if "\n" in piece or (_SPACE in piece.lstrip(_SPACE)):
                    raise ValueError(f"piece {piece!r} crosses a segment boundary")
        if (byte_ids < 0).any():
            raise ValueError("the model has no byte fallback")
        self.byte_ids = byte_ids
        self.pieces = pa.array(self.bytes, pa.large_binary())
        self.longest = max(len(self.bytes[i]) for i in pieces)
        self.begins = np.zeros((self.longest + 1, 1 << 16), bool)
        for i in pieces:
            if len(self.bytes[i]) > 1:
                self.begins[len(self.bytes[i]), self.bytes[i][0] << 8 | self.bytes[i][1]] = True
        # Zipf's law over the rank; bytes rank after all pieces.
        rank = np.full(n, float(n))
        rank[pieces] = np.arange(1, len(pieces) + 1)
        self.log_weight = -np.log(rank + 1)
        joined = b"".join(self.bytes[i] for i in pieces)
        ends = np.cumsum([len(self.bytes[i]) for i in pieces])
        starts = np.r_[0, ends[:-1]]
        self.hash = np.append(_Substrings(np.frombuffer(joined, np.uint8)).of(starts, ends - starts), U(0))
        self.ids = np.append(np.array(pieces, np.int32), np.int32(-1))
        # A slot names its piece, none (``none``), or that several share it (``none + 1``).
        none = len(pieces)
        self.tables: list[tuple[U, np.ndarray]] = []
        left = np.arange(none)
        for shift in (44, 20, 0, 32):
            slot = (self.hash[left] >> U(shift)) & U((1 << _SLOT_BITS) - 1)
            _, one, seen = np.unique(slot, return_index=True, return_counts=True)
            table = np.full(1 << _SLOT_BITS, none, np.uint16 if none < 65534 else np.int32)
            table[slot[one]] = np.where(seen > 1, none + 1, left[one])
            self.tables.append((U(shift), table))
            left = np.delete(left, one[seen == 1])
            if not len(left):
                break
        else:
            raise ValueError("the vocabulary's hash table is full")

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash; the index past the last where there is none."""
        none = len(self.ids) - 1
        shift, table = self.tables[0]
        found = table[(h >> shift) & U((1 << _SLOT_BITS) - 1)].astype(np.int32)
        shared = np.flatnonzero(found > none)
        for shift, table in self.tables[1:]:
            at = table[(h[shared] >> shift) & U((1 << _SLOT_BITS) - 1)].astype(np.int32)
            found[shared] = at
            shared = shared[at > none]
        found[self.hash[found] != h] = none
        return found

    def joined(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of pieces in a row, and where those of each run of pieces end."""
        made = self.pieces.take(pa.array(ids))
        _, where, what = made.buffers()
        offsets = np.frombuffer(where, np.int64)[made.offset : made.offset + len(made) + 1]
        data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
        return data[offsets[0] :], offsets[ends] - offsets[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the pieces, without the space that encoding puts in front."""
        text = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return text[text[:1] == b" " :].decode("utf-8", "replace")


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


@dataclass
class Lattice:
    """Nodes and edges of distinct segments; edges of a node lie together, longest first."""

    start: np.ndarray  # node where each segment begins; the end node is -1
    first: np.ndarray  # first edge of a node
    last: np.ndarray  # past its last edge
    to: np.ndarray  # node that an edge leads to, -1 at the segment's end
    piece: np.ndarray
    prob: np.ndarray  # of an edge, given its node
    upto: np.ndarray  # running sum of prob inside a node; at least 1 at the last edge
    log_prob: np.ndarray

    def log_rest(self, edges: np.ndarray) -> np.ndarray:
        """Logarithm of what the other edges of each edge's node have together; only edges on a path need it."""
        rest = 1.0 - self.prob[edges]
        rest[rest < 1e-12] = 0.0
        return np.log(rest)


def build_lattice(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocab: Vocabulary, power: float) -> Lattice:
    """The lattice of the byte runs ``data[starts[i]:ends[i]]``."""
    sizes = ends - starts
    n = int(sizes.sum())
    if not n:
        none = np.zeros(0, np.int64)
        return Lattice(none, none, none, none, none, *(np.zeros(0) for _ in range(3)))
    offset = np.cumsum(sizes) - sizes
    left = np.repeat(offset + sizes, sizes) - np.arange(n)  # bytes to the segment's end
    text = data[np.repeat(starts - offset, sizes) + np.arange(n)]
    # Nodes are numbered by their distance from the end, so that later nodes only lead to earlier ones.
    order = np.argsort(left.astype(np.uint16) if len(left) and left.max() < 65536 else left, kind="stable")
    number = np.empty(n, np.int32)
    number[order] = np.arange(n, dtype=np.int32)
    lead = (text & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    found: list[tuple[np.ndarray, int, np.ndarray]] = []
    width = np.ones(n, np.int8)
    width[text >= 0xC0] = 2
    width[text >= 0xE0] = 3
    width[text >= 0xF0] = 4
    covered = np.zeros(n, bool)
    hashes = _Substrings(text)
    pair = text.astype(np.uint16) << 8
    pair[:-1] |= text[1:]
    for length in range(1, vocab.longest + 1):
        at = at[left[at] >= length]
        if not len(at):
            break
        # Only bytes that some piece of this length begins with are looked up.
        may = at if length == 1 else at[vocab.begins[length, pair[at]]]
        hit = vocab.find(hashes.of(may, length))
        known = hit < len(vocab.ids) - 1
        src = may[known]
        found.append((src, length, vocab.ids[hit[known]]))
        if length <= 4:
            covered[src[width[src] == length]] = True
    alone = np.repeat(covered[lead], np.diff(np.append(np.flatnonzero(lead), n))) if n else covered
    src = np.flatnonzero(~alone)
    found.append((src, 1, vocab.byte_ids[text[src]]))
    count = np.zeros(n, np.int64)
    for src, _, _ in found:
        count[number[src]] += 1
    last = np.cumsum(count)
    first = last - count
    # Longer pieces first, as they are the likelier ones as a rule; a length has one edge of a node.
    free = first.copy()
    to = np.empty(int(count.sum()), np.int32)
    piece = np.empty(len(to), np.int32)
    for src, length, ids in reversed(found):
        place = free[number[src]]
        free[number[src]] = place + 1
        piece[place] = ids
        to[place] = np.where(left[src] == length, -1, number[np.minimum(src + length, n - 1)])
    del found, free, hashes
    log_prob = power * vocab.log_weight[piece]  # weights at first; each step puts the logarithms in their place
    beta = np.append(np.zeros(n), 0.0)  # log of the mass from a node to the end; the last is the end's
    distances = left[order]
    cut = np.flatnonzero(np.r_[True, distances[1:] != distances[:-1]]) if n else np.zeros(0, np.int64)
    for a, b in zip(cut, np.append(cut[1:], n), strict=True):
        i, j = first[a], last[b - 1]
        node = a + np.flatnonzero(count[a:b])  # bytes inside a known character have no edge
        if not len(node):
            continue
        w = log_prob[i:j] + beta[to[i:j]]
        at_ = first[node] - i
        top = np.maximum.reduceat(w, at_)
        total = top + np.log(np.add.reduceat(np.exp(w - np.repeat(top, count[node])), at_))
        beta[node] = total
        log_prob[i:j] = w - np.repeat(total, count[node])
    del beta, left, order, distances
    prob = np.exp(log_prob)
    only = first[count == 1]
    prob[only] = 1.0
    log_prob[only] = 0.0
    # Summed node by node, so that a sum doesn't depend on what else is in the batch.
    upto = prob.copy()
    node, place = np.flatnonzero(count > 1), 1
    while len(node):
        edge = first[node] + place
        upto[edge] += upto[edge - 1]
        place += 1
        node = node[count[node] > place]
    upto[last[count > 0] - 1] = 2.0
    return Lattice(number[offset], first, last, to, piece, prob, upto, log_prob)


class _Substrings:
    """Hashes of substrings of one byte array, which every array makes alike.

    Polynomials modulo 2**64 take constant time a substring. Pieces are short, so no two of them
    cancel by their structure, as words of 1,024 letters and more can.
    """

    def __init__(self, data: np.ndarray):
        self.total = np.empty(len(data) + 1, U)
        self.total[0] = 0
        np.cumsum(_BYTES[data] * _powers(_GOLD, len(data))[: len(data)], dtype=U, out=self.total[1:])
        self.back = _powers(_INVERSE, len(data))

    def of(self, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return mix((self.total[at + length] - self.total[at]) * self.back[at] + np.asarray(length).astype(U))


_BYTES = mix(np.arange(1, 257, dtype=U) * U(_GOLD))
_INVERSE = pow(_GOLD, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; at least n of them."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(max(n, 1 << 16), base, U)
        out[0] = 1
        _POWERS[base] = np.cumprod(out, dtype=U)
    return _POWERS[base]


def segments(texts: pa.Array) -> tuple[pa.Array, Words]:
    """The texts with their leading space, and their segments."""
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), _SPACE, " ")
    front = pc.if_else(pc.equal(texts, ""), "", " ").cast(pa.large_string())
    texts = pc.binary_join_element_wise(front, texts, pa.scalar("", pa.large_string()))
    data, offsets = utf8(texts)
    space, line = data == 0x20, data == 0x0A
    begin = np.zeros(len(data), bool)
    if len(data):
        begin[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begin)
    return texts, Words(data, starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets))


def _uniform(keys: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1."""
    return ((mix(keys) >> U(12)).astype(np.float64) + 0.5) / 4503599627370496.0


def _draw(lattice: Lattice, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A segmentation of each segment: its edges, one segment after another, and their numbers."""
    n = len(node)
    who = np.arange(n)
    count = np.zeros(n, np.int64)
    steps = []
    t = 0
    while len(who):
        u = _uniform(key + U((t * _GOLD) & _MASK))
        edge = lattice.first[node].copy()
        more = np.flatnonzero(u >= lattice.upto[edge])
        while len(more):
            edge[more] += 1
            more = more[u[more] >= lattice.upto[edge[more]]]
        steps.append((who, edge))
        count[who] += 1
        node = lattice.to[edge]
        on = node >= 0
        who, node, key = who[on], node[on], key[on]
        t += 1
    begin = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int64)
    for t, (who, edge) in enumerate(steps):
        out[begin[who] + t] = edge
    return out, count


@dataclass
class Sampled:
    """One sampled segmentation."""

    ids: np.ndarray
    log_prob: float
    perturbed: float
    log_inclusion: float


class _Search:
    """The A* search over one text's segmentations."""

    def __init__(self, lattice: Lattice, key: int):
        self.lattice, self.key = lattice, key
        self.paths: list[tuple] = []  # edges, running log-probability, first depth, bounds, barred there

    def numbers(self, n: int) -> np.ndarray:
        base = (self.key + (len(self.paths) + 1) * 0xD6E8FEB86659FD93) & _MASK
        return _uniform(U(base) + np.arange(n, dtype=U) * U(_GOLD))

    def add(self, edges: np.ndarray, depth: int, barred: tuple[int, ...], bound: float) -> None:
        """Take a path whose perturbed value is ``bound``, and divide what is left of its subspace."""
        with np.errstate(divide="ignore"):
            upto = np.cumsum(self.lattice.log_prob[edges])
            mass = self.lattice.log_rest(edges[depth:])
            if barred and len(mass):
                rest = 1.0 - self.lattice.prob[edges[depth]] - self.lattice.prob[list(barred)].sum()
                mass[0] = math.log(rest) if rest >= 1e-12 else -math.inf
            mass[1:] += upto[depth:-1]
            if depth and len(mass):
                mass[0] += upto[depth - 1]
            gap = np.log(-np.log(self.numbers(len(mass)))) - mass
        self.paths.append((edges, upto, depth, -np.logaddexp(-bound, gap), barred, bound))

    def best(self) -> tuple[float, int, int]:
        """The highest bound, its path, and its place among the path's bounds."""
        top = (-math.inf, -1, -1)
        for p, (_, _, _, bounds, _, _) in enumerate(self.paths):
            if len(bounds) and bounds[i := int(bounds.argmax())] > top[0]:
                top = (float(bounds[i]), p, i)
        return top

    def open(self, p: int, i: int) -> tuple[np.ndarray, int, tuple[int, ...]]:
        """Draw the piece that differs: the path up to its segment's end, the depth, the barred edges."""
        edges, _, depth, bounds, barred, _ = self.paths[p]
        bounds[i] = -math.inf
        j = depth + i
        barred = (*(barred if i == 0 else ()), int(edges[j]))
        lat = self.lattice
        node = int(np.searchsorted(lat.first, edges[j], "right")) - 1
        choice = [e for e in range(lat.first[node], lat.last[node]) if e not in barred]
        weight = np.cumsum(lat.prob[choice])
        u = self.numbers(64)
        edge = choice[min(int(np.searchsorted(weight, u[0] * weight[-1], "right")), len(choice) - 1)]
        tail, t = [edge], 1
        while (node := int(lat.to[edge])) >= 0:
            edge = int(lat.first[node])
            x = u[t % 64] if t < 64 else float(_uniform(np.array([mix(U(self.key)) ^ U(t)], U))[0])
            while x >= lat.upto[edge]:
                edge += 1
            tail.append(edge)
            t += 1
        return np.append(edges[:j], tail), j, barred


def sample_texts(texts: pa.Array, keys: np.ndarray, k: int, power: float, vocab: Vocabulary) -> list[list[Sampled]]:
    """Up to k distinct segmentations of each text, most perturbed first."""
    _, seg = segments(texts)
    _, one, which = np.unique(seg.hashes(), return_index=True, return_inverse=True)
    lattice = build_lattice(seg.data, seg.starts[one], seg.ends[one], vocab, power)
    node = lattice.start[which] if len(which) else np.zeros(0, np.int32)
    owner = seg.owner
    rank = np.arange(len(node)) - seg.first[owner]
    base = mix(keys[owner] + mix(rank.astype(U) + U(1))) if len(node) else np.zeros(0, U)
    draws = []
    for s in range(k):
        edges, count = _draw(lattice, node, base + U(((s + 1) * 0xA0761D6478BD642F) & _MASK))
        draws.append((edges, np.r_[0, np.cumsum(count)]))
    out = []
    for d in range(len(keys)):
        a, b = seg.first[d], seg.first[d + 1]
        search = _Search(lattice, int(keys[d]))
        bound = -math.log(-math.log(float(_uniform(np.array([keys[d] ^ U(_GOLD)], U))[0])))
        edges, cut = draws[0]
        search.add(edges[cut[a] : cut[b]], 0, (), bound)
        next_bound = -math.inf
        for s in range(1, k + 1):
            bound, p, i = search.best()
            if p < 0 or s == k:
                next_bound = bound
                break
            head, depth, barred = search.open(p, i)
            ends = np.cumsum(lattice.to[head] < 0)
            edges, cut = draws[s]
            search.add(np.append(head, edges[cut[a + int(ends[-1])] : cut[b]]), depth, barred, bound)
        found = []
        for edges, upto, _, _, _, value in search.paths:
            log_prob = float(upto[-1]) if len(upto) else 0.0
            x = log_prob - next_bound
            inclusion = 0.0 if x > 4 else x if x < -30 else math.log(-math.expm1(-math.exp(x)))
            found.append(Sampled(lattice.piece[edges], log_prob, value, inclusion))
        out.append(found)
    return out


def _encoded(batch: pa.RecordBatch, k: int, power: float, seed: int, together: bool, vocab: Vocabulary) -> pa.RecordBatch:
    """The rows of ``sample_encode`` for a slice; only they are left in memory when it returns."""
    ids = pc.fill_null(batch.column("id"), -(1 << 63)).to_numpy(zero_copy_only=False)
    keys = mix(ids.astype(np.int64).view(U) ^ mix(U(seed + 1)))
    found = sample_texts(batch.column("text"), keys, k, power, vocab)
    said, place = utf8(pc.replace_substring(pc.fill_null(batch.column("text"), ""), _SPACE, " "))
    flat = [x for row in found for x in row]
    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
    sizes = [len(x.ids) for x in flat]
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    every = np.concatenate([x.ids for x in flat]) if flat else np.zeros(0, np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(every, pa.int32()))
    # Pieces give the text back behind the space that encoding puts in front.
    made, cut = vocab.joined(every, ends)
    same = [
        np.array_equal(made[a + (b > a) : b], said[place[r] : place[r + 1]]) and (a == b or made[a] == 0x20)
        for a, b, r in zip(cut[:-1], cut[1:], row, strict=True)
    ]
    column = lambda name: pa.array([getattr(x, name) for x in flat], pa.float64())
    out = pa.RecordBatch.from_arrays(
        [
            batch.column("id").take(pa.array(row)),
            pa.array([i for x in found for i in range(len(x))], pa.int32()),
            lists,
            pa.array(sizes, pa.int64()),
            column("log_prob"),
            column("perturbed"),
            column("log_inclusion"),
            pa.array(same, pa.bool_()),
        ],
        ["id", "sample", "ids", "n_pieces", "log_prob", "perturbed", "log_inclusion", "round_trip"],
    )
    if not together:
        return out
    is_first = pc.equal(out.column("sample"), 0)
    others = out.filter(pc.invert(is_first)).select(out.schema.names[1:]).to_struct_array()
    upto = np.cumsum([0] + [len(x) - 1 for x in found])
    first, more = out.filter(is_first), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), others)
    return pa.RecordBatch.from_arrays([*first.columns, more], [*first.schema.names, "more"])


def sample_encode(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 2,
    power: float = 1.0,
    seed: int = 0,
    together: bool = False,
) -> DataFrame:
    """``(id_col, sample, ids, n_pieces, log_prob, perturbed, log_inclusion, round_trip)``.

    ``together`` gives one row a text: its first sample, and the others in ``more``, an array of
    structs of the columns from ``sample`` on.

    Each row gives its k segmentations by perturbed A* search, or all of them where there are fewer.
    ``log_prob`` is the segmentation's own log-probability, ``log_inclusion`` the logarithm of the
    probability that it is among the k, given the bound of the next one (0 where there is none).
    ``round_trip`` tells whether decoding gives the text back. ``power`` sharpens the distribution.

    Defined results: null and empty texts have one empty segmentation; rows with the same id, null
    included, use the same random numbers, so repeated rows get equal samples; the space mark of the
    model in a text counts as a space; a text of any length is encoded whole, in one task; an empty
    table gives an empty result; other columns are ignored, so their names can't clash.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    kind = "ids array<int>, n_pieces long, log_prob double, perturbed double, log_inclusion double, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                yield _encoded(batch, k, power, seed, together, vocab)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if together:
        kind += f", more array<struct<{', '.join(c.replace(' ', ': ') for c in f'sample int, {kind}'.split(', '))}>>"
    return source.mapInArrow(run, f"id long, sample int, {kind}").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with a column ``text_col``: the text of the pieces.

    Defined results: a null list, and one with a null or a number that the model doesn't have, gives
    a null text; an empty list an empty text; lists of any length are read whole; repeated rows stay;
    an empty table stays empty; a column of that name is replaced, whatever its case.
    """
    names = [c for c in encoded.columns if c.lower() != text_col.lower()]
    carried = encoded.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(ids_col).alias("ids"))

    def text(ids: list | None, vocab: Vocabulary) -> str | None:
        if ids is None or not all(x is not None and 0 <= x < len(vocab.bytes) for x in ids):
            return None
        return vocab.decode(np.array(ids, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path)
        for batch in batches:
            texts = [text(x, vocab) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([loosened(batch.column("row")), pa.array(texts, pa.string())], ["row", "text"])

    kind = carried.schema["row"].dataType.simpleString()
    out = carried.mapInArrow(run, f"row {kind}, text string")
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in names), F.col("text").alias(text_col))
