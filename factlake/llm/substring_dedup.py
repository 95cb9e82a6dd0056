"""Substring dedup by relative Lempel-Ziv parsing.

A document is parsed against all documents with smaller ids, its reference. The reference is indexed
by its phrases of ``window`` words: for each phrase the document with the smallest id that has it,
and the first place there. The index is cut by hash into blocks that each fit a task, and every
document is looked up in every block: a batch of documents sends each block the phrases that the
block owns, and gets back the reference position of those that an earlier document has.

Words in a row whose phrases all have an earlier place are a stretch; nothing beyond it can be copied
with it. Stretches are parsed greedily, from left to right: a factor is the longest run of words from
its begin that stands in a reference document, found by walking that document's suffix automaton. Where
it ends, the phrases that reach across its end are still to be covered, so the next factor begins
``window`` - 1 words before. A factor is at least ``window`` words long, so all of them are duplicate
spans, and no phrase is lost at a boundary. The reference documents of a stretch are those in which its
phrases come first; as the parse goes on, those of the phrases that the factor so far holds are tried.
Where all phrases of a stretch stand in a row in one document, that is the longest factor already. For
the others the batch asks for the texts of the reference documents, each once.

Hashes only find factors. Those of one document in a row are confirmed by a digest of their words,
which that document compares with its own; all others are found on the words themselves.

Before the index is made, a first round exchanges only minimizers, the smallest hash of the short
phrases in each window; equal windows have equal minimizers, so a window whose minimizer no other
document has can't be duplicate. A frequent phrase costs one entry for each batch, whatever the
number of its copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.llm.periodic_runs import SuffixAutomaton
from factlake.llm.textwords import U, Words, inside, loosened, mix, release, rolling, split_words

#: Bytes of text that a batch of documents should have.
BATCH_BYTES = 4 << 20
#: Entries that a block of the index should have.
BLOCK_ENTRIES = 1 << 20
_ENTRIES = "block int, batch long, packed binary"
_MESSAGES = "batch long, kind int, packed binary"
#: Kinds of messages: runs of a text's phrases, claims of words, texts wanted, texts sent.
_OWN, _CLAIMED, _WANT, _SERVED = range(4)
#: Phrases with their hash, a second one, and where they stand: in which document, at which word.
_PHRASE = (("hash", "<u8"), ("check", "<u4"), ("id", "<i8"), ("at", "<i4"))
_KNOWN = (*_PHRASE, ("batch", "<i4"))
_STEP, _CHECK = U(0xD1342543DE82EF95), U(0xA24BAED4963EE407)
_FACTOR = np.dtype([("start", "<i4"), ("length", "<i4"), ("id", "<i8"), ("at", "<i4")])
_ASKED = np.dtype([("id", "<i8"), ("to", "<i8")])
_CLAIM = np.dtype([("id", "<i8"), ("at", "<i4"), ("length", "<i4"), ("digest", "V16")])


#: Words of reference documents whose automata are kept at a time.
_AUTOMATA_WORDS = 400_000


class HashCollision(RuntimeError):
    """Phrases of different words have the same hashes; another ``salt`` tells them apart."""


def remove_repeated_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 13,
    seed: int = 6,
    carry: list[str] | None = None,
    salt: int = 0,
) -> DataFrame:
    """Per row of ``docs``: ``(id, text, n_words, n_removed, spans, factors, carried)``.

    ``text`` has the words left, joined by one space; ``factors`` the (start, length) of each factor of
    the parse, and the ``source`` id and ``source_start`` it was copied from; they overlap by less than
    a window;
    ``spans`` the (start, length) of the removed runs, the union of the factors; ``carried`` a struct
    of the columns named in ``carry``. A word goes if it lies in a window of ``window`` words that
    also starts in a row with a smaller id; windows are judged on the input. Words are runs of
    anything but ASCII white space, unchanged.

    Defined results: null and wordless texts have no words and become empty; a text shorter than
    the window stays whole; a text of any length is parsed whole, in one task; rows with equal ids
    don't remove anything from each other, and are read by one task; a row with a null id keeps all
    its words and is no reference for others; repeats inside one text stay; an empty table gives an
    empty result. Columns that aren't carried are ignored. Should two different phrases have the
    same hashes, 96 bits in all, the query fails with :class:`HashCollision` instead of removing a
    word too many; another ``salt`` then gives the result.
    """
    if not 0 < seed <= window:
        raise ValueError("seed must be between 1 and window")
    source = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), _carried(carry or [])
    )
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, -(-size // BATCH_BYTES))
    mark = F.xxhash64("text")
    batch = F.pmod(F.xxhash64(F.coalesce("id", mark), F.lit(1)), F.lit(batches))
    texts = source.select(batch.alias("batch"), mark.alias("mark"), "id", "text", "carried")
    words = size / 6
    seed_bits = _bits(words * 2 / (window - seed + 2))
    window_bits = _bits(words)

    def seeds(table: pa.Table) -> pa.Table:
        group = _Group(table, window, salt)
        return _rows(group.batch, {"hash": np.unique(group.minimizers(seed))}, seed_bits)

    def index(left: pa.Table, right: pa.Table) -> pa.Table:
        group = _Group(left, window, salt)
        m = group.minimizers(seed)
        order = np.argsort(m)
        first, last = _runs(m[order])
        rank = group.rank[order]
        low, high = (f.reduceat(rank, first) if len(first) else rank for f in (np.minimum, np.maximum))
        shared = np.zeros(len(m), bool)
        shared[order] = np.repeat(low != high, last - first)
        shared |= np.isin(m, _unpacked(right, (("hash", "<u8"),))["hash"])
        some = np.flatnonzero(shared)
        some = some[np.sort(_first_of(group.hash[some], group.check[some])[0])]
        return _rows(group.batch, {k: v[some] for k, v in group.entries().items()}, window_bits)

    def factors(left: pa.Table, right: pa.Table) -> pa.Table:
        group = _Group(left, window, salt)
        return _messages(group, group.factors(_unpacked(right, _KNOWN)))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        return _cut(_Sorted(left), right, window)

    grouped = texts.groupBy("batch")
    shared = grouped.applyInArrow(seeds, _ENTRIES).groupBy("block").applyInArrow(_repeated, _ENTRIES)
    entries = grouped.cogroup(shared.groupBy("batch")).applyInArrow(index, _ENTRIES)
    known = entries.groupBy("block").applyInArrow(_earlier, _ENTRIES)
    said = grouped.cogroup(known.groupBy("batch")).applyInArrow(factors, _MESSAGES).distinct()
    # Not a filter, which would go below the distinct and have the factors made twice.
    wanted = said.mapInArrow(lambda batches: (b.filter(pc.equal(b.column("kind"), _WANT)) for b in batches), _MESSAGES)
    served = grouped.cogroup(wanted.groupBy("batch")).applyInArrow(_serve, "id long, text string, to array<long>")
    served = served.select(F.explode("to").alias("batch"), F.lit(_SERVED).alias("kind"), F.encode(F.concat_ws(" ", "id", "text"), "UTF-8").alias("packed"))
    said = said.unionByName(served)
    carried = texts.schema["carried"].dataType.simpleString()
    out = (
        "id long, text string, n_words long, n_removed long, spans array<struct<start:int,length:int>>, "
        f"factors array<struct<start:int,length:int,source:bigint,source_start:int>>, carried {carried}"
    )
    return grouped.cogroup(said.groupBy("batch")).applyInArrow(cut, out)


def _carried(names: list[str]) -> Column:
    return F.struct(*(F.col(n) for n in names)).alias("carried") if names else F.struct(F.lit(None).cast("int").alias("none")).alias("carried")


def _bits(entries: float) -> int:
    """Bits of the hash that name the block; at least 128 blocks, so that small inputs spread too."""
    return max(7, min(30, int(np.ceil(np.log2(max(1.0, entries / BLOCK_ENTRIES))))))


class _Sorted:
    """The texts of a batch in order of id, null ids last, and their words."""

    def __init__(self, table: pa.Table):
        release()
        if table.num_rows:
            table = table.take(pc.sort_indices(table, [("id", "ascending"), ("mark", "ascending")]))
        self.table = table
        self.words: Words = split_words(table.column("text"))
        self.has_id = table.column("id").is_valid().to_numpy(zero_copy_only=False)
        self.ids = pc.fill_null(table.column("id"), 0).to_numpy()
        self.marks = table.column("mark").to_numpy()
        self.raw = self.words.data.tobytes()

    def said(self, d: int) -> list[bytes]:
        """The words of text d."""
        i, j = self.words.first[d], self.words.first[d + 1]
        return self.raw[self.words.starts[i] : self.words.ends[j - 1]].split() if i < j else []


class _Group(_Sorted):
    """The phrases of a batch of texts that have an id."""

    def __init__(self, table: pa.Table, window: int, salt: int):
        super().__init__(table)
        self.window = window
        self.batch = table.column("batch")[0].as_py() if table.num_rows else None
        self.hashes = self.words.hashes(salt)
        place = inside(self.words.first, window)
        owner = self.words.owner[place]
        if not self.has_id.all():
            place, owner = place[self.has_id[owner]], owner[self.has_id[owner]]
        self.place, self.owner = place, owner
        self.at = place - self.words.first[owner]
        changes = np.r_[False, self.ids[1:] != self.ids[:-1]] if len(self.ids) else np.zeros(0, bool)
        self.rank = np.cumsum(changes)[owner]

    def _rolled(self, k: int, step: np.uint64) -> np.ndarray:
        return mix(rolling(self.hashes, k, step)) if len(self.place) else np.zeros(0, U)

    @cached_property
    def hash(self) -> np.ndarray:
        return self._rolled(self.window, _STEP)[self.place]

    @cached_property
    def check(self) -> np.ndarray:
        return (self._rolled(self.window, _CHECK)[self.place] >> U(32)).astype(np.uint32)

    def minimizers(self, seed: int) -> np.ndarray:
        """The smallest hash of ``seed`` words in each window, by doubling the span of the minimum."""
        low, span, want = self._rolled(seed, _STEP), 1, self.window - seed + 1
        while span < want:
            more = min(span, want - span)
            low = np.minimum(low[: max(0, len(low) - more)], low[more:])
            span += more
        return low[self.place]

    def entries(self) -> dict[str, np.ndarray]:
        return {"hash": self.hash, "check": self.check, "id": self.ids[self.owner], "at": self.at}

    def factors(self, known: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        """Greedy factors: (text, start, length, id, at, batch) of each, in order of their place.

        ``known`` has the reference position of phrases that other batches have earlier; it comes
        before any place in this batch.
        """
        n = len(self.hash)
        first, run = _first_of(self.hash, self.check)
        source = first[run]
        have = self.rank > self.rank[source]
        sid, sat, sbatch = self.ids[self.owner[source]], self.at[source], np.full(n, self.batch if n else 0, np.int64)
        if len(known["hash"]):
            order = np.lexsort((known["check"], known["hash"]))
            known = {k: v[order] for k, v in known.items()}
            place = np.searchsorted(known["hash"], self.hash)
            while len(place) and (more := (place < len(order)) & self._same(known["hash"], place) & ~self._same(known["check"], place)).any():
                place = place + more
            hit = (place < len(order)) & self._same(known["hash"], place) if n else np.zeros(0, bool)
            where = place[hit]
            have[hit] = True
            sid[hit], sat[hit], sbatch[hit] = known["id"][where], known["at"][where], known["batch"][where]
        some = np.flatnonzero(have)
        owner, at, sid, sat, sbatch = self.owner[some], self.at[some], sid[some], sat[some], sbatch[some]
        grows = (owner[1:] == owner[:-1]) & (at[1:] == at[:-1] + 1) & (sid[1:] == sid[:-1]) & (sat[1:] == sat[:-1] + 1)
        begin = np.flatnonzero(np.r_[True, ~grows]) if len(some) else np.zeros(0, np.int64)
        length = np.diff(np.append(begin, len(some))) + self.window - 1
        return owner[begin], at[begin], length, sid[begin], sat[begin], sbatch[begin]

    def _same(self, values: np.ndarray, place: np.ndarray) -> np.ndarray:
        mine = self.hash if values.dtype == self.hash.dtype else self.check
        return values[np.minimum(place, len(values) - 1)] == mine


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values begin and end."""
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
    return first, np.append(first[1:], len(ordered)).astype(np.int64) if len(first) else first


def _first_of(hash_: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct phrase, in order of hash, and which of them each place has."""
    order = np.argsort(hash_)
    h, c = hash_[order], check[order]
    if ((h[1:] == h[:-1]) & (c[1:] != c[:-1])).any():
        order = np.lexsort((check, hash_))
        h, c = hash_[order], check[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])] if len(h) else np.zeros(0, bool)
    run = np.empty(len(h), np.int64)
    run[order] = np.cumsum(new) - 1
    return np.minimum.reduceat(order, np.flatnonzero(new)) if len(h) else order, run


def _rows(batch: int | None, values: dict[str, np.ndarray], bits: int) -> pa.Table:
    """One row for each block that owns some of the phrases, in the order given, which packs ids well."""
    block = (values["hash"] >> U(64 - bits)).astype(np.int32)
    order = np.argsort(block, kind="stable")
    first, last = _runs(block[order])
    return _packed(block[order[first]], np.full(len(first), batch or 0), [(values, order[i:j]) for i, j in zip(first, last, strict=True)])


def _packed(block: np.ndarray, batch: np.ndarray, parts: list[tuple[dict[str, np.ndarray], np.ndarray]]) -> pa.Table:
    kinds = dict(_KNOWN)
    blobs = [b"".join(v[part].astype(kinds[k]).tobytes() for k, v in values.items()) for values, part in parts]
    return pa.table(
        {"block": pa.array(block, pa.int32()), "batch": pa.array(batch, pa.int64()), "packed": pa.array(blobs, pa.binary())}
    )


def _unpacked(table: pa.Table, kinds: tuple[tuple[str, str], ...], batch: bool = False) -> dict[str, np.ndarray]:
    """The columns of all rows' phrases; with ``batch`` also that of each row."""
    width = sum(np.dtype(t).itemsize for _, t in kinds)
    parts: dict[str, list] = {k: [np.zeros(0, t)] for k, t in kinds}
    sizes = []
    for blob in table.column("packed").to_pylist():
        n = len(blob) // width
        sizes.append(n)
        begin = 0
        for k, t in kinds:
            parts[k].append(np.frombuffer(blob, t, n, begin))
            begin += n * np.dtype(t).itemsize
    out = {k: np.concatenate(v) for k, v in parts.items()}
    if batch:
        out["batch"] = np.repeat(table.column("batch").to_numpy(), sizes).astype(np.int64)
    return out


def _repeated(table: pa.Table) -> pa.Table:
    """For a block of the first round: each batch's hashes that another batch has too."""
    got = _unpacked(table, (("hash", "<u8"),), batch=True)
    order = np.argsort(got["hash"])
    h = got["hash"][order]
    same = h[1:] == h[:-1]
    hit = order[np.r_[False, same] | np.r_[same, False]] if len(h) else order
    return _answers(table, {"hash": got["hash"][hit]}, got["batch"][hit])


def _earlier(table: pa.Table) -> pa.Table:
    """For a block of the index: the reference position of each batch's phrases that have an earlier one."""
    got = _unpacked(table, _PHRASE, batch=True)
    order = np.lexsort((got["at"], got["id"], got["check"], got["hash"]))
    h, c = got["hash"][order], got["check"][order]
    new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])] if len(h) else np.zeros(0, bool)
    source = np.flatnonzero(new)[np.cumsum(new) - 1]
    ids = got["id"][order]
    hit = np.flatnonzero(ids > ids[source])
    hit = hit[np.lexsort((got["at"][order[source[hit]]], ids[source[hit]]))]
    found = {k: got[k][order[source[hit]]] for k in ("hash", "check", "id", "at", "batch")}
    return _answers(table, found, got["batch"][order[hit]])


def _answers(table: pa.Table, values: dict[str, np.ndarray], to: np.ndarray) -> pa.Table:
    """One row for each batch that some values go to."""
    order = np.argsort(to, kind="stable")
    first, last = _runs(to[order])
    block = np.full(len(first), table.column("block")[0].as_py() if table.num_rows else 0)
    return _packed(block, to[order[first]], [(values, order[i:j]) for i, j in zip(first, last, strict=True)])


def _stretches(start: np.ndarray, length: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Runs (first, last) of the runs of one text whose phrases follow each other without a gap."""
    gap = np.flatnonzero(start[1:] > (start + length - window + 1)[:-1]) + 1
    edges = [0, *gap.tolist(), len(start)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _messages(group: _Group, factors: tuple[np.ndarray, ...]) -> pa.Table:
    """Runs of phrases for the own batch, one row a text; claims of their words, or wishes for texts, for those of their sources."""
    text, start, length, sid, sat, sbatch = factors
    rows: list[tuple[int, int, bytes]] = []
    first, last = _runs(text)
    for i, j in zip(first, last, strict=True):
        d = int(text[i])
        mine = np.zeros(j - i, _FACTOR)
        for name, values in zip(("start", "length", "id", "at"), (start, length, sid, sat), strict=True):
            mine[name] = values[i:j]
        rows.append((group.batch, _OWN, np.array([group.ids[d], group.marks[d]], "<i8").tobytes() + mine.tobytes()))
        words = group.said(d)
        for a, b in _stretches(start[i:j], length[i:j], group.window):
            if b == a + 1:
                k = i + a
                digest = _digest(words, start[k], length[k])
                rows.append((int(sbatch[k]), _CLAIMED, np.array([(sid[k], sat[k], length[k], digest)], _CLAIM).tobytes()))
            else:
                rows += [(int(sbatch[k]), _WANT, np.array([(sid[k], group.batch)], _ASKED).tobytes()) for k in range(i + a, i + b)]
    batch, kind, packed = zip(*dict.fromkeys(rows), strict=True) if rows else ((), (), ())
    return pa.table({"batch": pa.array(batch, pa.int64()), "kind": pa.array(kind, pa.int32()), "packed": pa.array(packed, pa.binary())})


def _serve(texts: pa.Table, wanted: pa.Table) -> pa.Table:
    """The texts of a batch that others want, with the batches that do; rows of one id are all sent."""
    asked = np.unique(np.frombuffer(b"".join(wanted.column("packed").to_pylist()), _ASKED))
    chosen = texts.filter(pc.is_in(texts.column("id"), pa.array(np.unique(asked["id"])))).select(["id", "text"])
    to = {int(asked["id"][i]): asked["to"][i:j] for i, j in zip(*_runs(asked["id"]), strict=True)}
    lists = pa.array([to[x] for x in chosen.column("id").to_pylist()], pa.list_(pa.int64()))
    return pa.table({"id": chosen.column("id").combine_chunks(), "text": chosen.column("text").combine_chunks(), "to": lists})


class _Reference:
    """The texts of the documents that stretches are parsed against, with their automata."""

    def __init__(self, packed: list[bytes]):
        self.texts: dict[int, list[list[bytes]]] = {}
        for x in packed:
            id_, _, text = x.partition(b" ")
            self.texts.setdefault(int(id_), []).append(text.split())
        self.ready: dict[int, list[tuple[SuffixAutomaton, dict[bytes, int]]]] = {}
        self.words = 0

    def automata(self, id_: int) -> list[tuple[SuffixAutomaton, dict[bytes, int]]]:
        """The automata of an id's texts; others are given up where they take too much memory together."""
        if id_ not in self.ready:
            size = sum(map(len, self.texts.get(id_, ())))
            if self.words + size > _AUTOMATA_WORDS:
                self.ready, self.words = {}, 0
            self.words += size
            out = []
            for words in self.texts.get(id_, ()):
                number: dict[bytes, int] = {}
                out.append((SuffixAutomaton([number.setdefault(w, len(number)) for w in words]), number))
            self.ready[id_] = out
        return self.ready[id_]

    def longest(self, words: list[bytes], j: int, id_: int) -> tuple[int, int]:
        """How far the words from j on stand in an id's texts in a row, and where they begin there."""
        best, place = j, 0
        for automaton, number in self.automata(id_):
            state, k = 0, j
            while k < len(words) and (follows := automaton.step(state, number.get(words[k], -2))):
                state, k = follows, k + 1
            if k > best:
                best, place = k, automaton.first_end[state] - (k - j) + 1
        return best, place


def parse_stretch(words: list[bytes], runs: np.ndarray, reference: _Reference, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, length, id, place) of a stretch, from the runs of its phrases and their first places."""
    out, j, skip = [], int(runs["start"][0]), 0
    stop = int(runs["start"][-1] + runs["length"][-1])
    ends = runs["start"] + runs["length"] - window  # the last phrase of each run
    while True:
        while ends[skip] < j:
            skip += 1
        k, best, tried = skip, (j, 0, 0), set()
        while k < len(runs) and runs["start"][k] <= max(j, best[0] - window + 1):
            id_ = int(runs["id"][k])
            if id_ not in tried:
                tried.add(id_)
                end, place = reference.longest(words, j, id_)
                if end > best[0]:
                    best = (end, id_, place)
            k += 1
        if best[0] - j < window:
            raise HashCollision(f"hashes of different phrases agree in {int(runs['id'][skip])}: use another salt")
        out.append((j, best[0] - j, best[1], best[2]))
        if best[0] >= stop:
            return out
        j = best[0] - window + 1


def _digest(words: list[bytes], start: int, length: int) -> bytes:
    return blake2b(b" ".join(words[start : start + length]), digest_size=16).digest()


def _confirm(group: _Sorted, claims: Iterator[bytes]) -> None:
    """Raise unless the words at each claimed place are those that the factor has."""
    of: dict[int, list[int]] = {}
    for d in np.flatnonzero(group.has_id):
        of.setdefault(int(group.ids[d]), []).append(int(d))
    got = np.frombuffer(b"".join(claims), _CLAIM)
    got = got[np.argsort(got["id"], kind="stable")]
    said: tuple[int | None, list[list[bytes]]] = (None, [])
    for id_, at, length, digest in got:
        if said[0] != id_:
            said = (id_, [group.said(d) for d in of.get(int(id_), [])])
        if not any(_digest(words, at, length) == digest.tobytes() for words in said[1]):
            raise HashCollision(f"hashes of different phrases agree in {id_}: use another salt")


def _cut(group: _Sorted, messages: pa.Table, window: int) -> pa.Table:
    """The texts of a batch without the words of their factors."""
    kind = messages.column("kind").to_numpy()
    packed = messages.column("packed").to_pylist()
    of = lambda k: (packed[i] for i in np.flatnonzero(kind == k))
    _confirm(group, of(_CLAIMED))
    reference = _Reference(list(of(_SERVED)))
    mine = {x[:16]: np.frombuffer(x[16:], _FACTOR) for x in of(_OWN)}
    texts, spans, removed, factors = [], [], [], []
    for d in range(len(group.ids)):
        words = group.said(d)
        runs = mine.get(np.array([group.ids[d], group.marks[d]], "<i8").tobytes()) if group.has_id[d] else None
        gone: list[tuple[int, int]] = []
        found = None
        if runs is not None:
            parts = []
            for a, b in _stretches(runs["start"], runs["length"], window):
                parts += [tuple(runs[a])] if b == a + 1 else parse_stretch(words, runs[a:b], reference, window)
            found = np.array(parts, _FACTOR)
            step = np.zeros(len(words) + 1, np.int64)
            np.add.at(step, found["start"], 1)
            np.add.at(step, found["start"] + found["length"], -1)
            edges = np.flatnonzero(np.diff(np.r_[False, np.cumsum(step[:-1]) > 0, False]))
            gone = [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
            keep = np.r_[0, edges, len(words)]
            words = [w for a, b in zip(keep[::2], keep[1::2], strict=True) for w in words[a:b]]
        texts.append(b" ".join(words).decode())
        removed.append(sum(n for _, n in gone))
        spans.append([{"start": a, "length": n} for a, n in gone])
        factors.append([dict(zip(("start", "length", "source", "source_start"), map(int, f), strict=True)) for f in found] if found is not None else [])
    span = [("start", pa.int32()), ("length", pa.int32())]
    factor = [*span, ("source", pa.int64()), ("source_start", pa.int32())]
    return pa.table(
        {
            "id": group.table.column("id"),
            "text": pa.array(texts, pa.string()),
            "n_words": pa.array(group.words.counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct(span))),
            "factors": pa.array(factors, pa.list_(pa.struct(factor))),
            "carried": loosened(group.table.column("carried")),
        }
    )


SPANS_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS words FROM documents),
grams AS (SELECT doc_id, i, array_to_string(words[i + 1:i + 13], ' ') AS gram FROM (SELECT *, unnest(range(len(words) - 12)) AS i FROM w)),
sources AS (SELECT gram, min(doc_id) AS source FROM grams GROUP BY gram),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM grams JOIN sources USING (gram) WHERE source < doc_id)),
said AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS j FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text FROM said ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
