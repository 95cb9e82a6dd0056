"""Maximal runs of words, after Kolpakov and Kucherov (1999).

A run is a stretch of words with a smallest period that it holds several times over, and that no
neighbouring word extends. All runs of a text are found in time linear in it:

1. The text is cut into Lempel-Ziv factors, each the longest stretch that also begins earlier, by
   walking a suffix automaton that knows where each of its states ends first.
2. Runs that touch a factor's first word or the word before it are found by Main's algorithm: for each
   period, how far words agree at that distance to the right and to the left of the boundary. How far
   back such a run can begin is bounded by the lengths of two factors.
3. A run strictly inside a factor also lies inside the factor's earlier occurrence, and is copied.

Before that, texts are cut where no run can pass. A run holds its period ``exponent`` times, so each of
its words occurs that often in it; a word that occurs less often between two cuts is a cut itself. The
cuts are made for a whole batch at once, until nothing changes, and what is left of ordinary prose is
little. As the words at a cut are in no run, neither runs nor their ends are changed by it.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.llm.importance import CRC_SQL, crc_sql
from factlake.llm.textwords import Words, slices, split_words

Run = tuple[int, int, int]  # begin, end (exclusive), period
_ROUNDS = 16


class SuffixAutomaton:
    """All stretches of a sequence: a state is a set of stretches with the same ends.

    A state's first way on is kept in arrays; only states with more of them have a dictionary, so a
    long periodic sequence needs some forty bytes a word.
    """

    def __init__(self, letters: list[int]):
        size = 2 * len(letters) + 2
        self.length, self.link = array("i", bytes(4 * size)), array("i", bytes(4 * size))
        self.first_end = array("i", bytes(4 * size))
        self.letter, self.target = array("i", [-1]) * size, array("i", bytes(4 * size))
        self.more: dict[int, dict[int, int]] = {}
        self.link[0] = -1
        self.states, last = 1, 0
        for end, c in enumerate(letters):
            last = self._extend(last, end, c)

    def step(self, state: int, c: int) -> int:
        """The state behind one more letter, 0 if there is none."""
        if self.letter[state] == c:
            return self.target[state]
        more = self.more.get(state)
        return more.get(c, 0) if more else 0

    def _go(self, state: int, c: int, target: int) -> None:
        if self.letter[state] in (-1, c):
            self.letter[state], self.target[state] = c, target
        else:
            self.more.setdefault(state, {})[c] = target

    def _extend(self, last: int, end: int, c: int) -> int:
        new = self.states
        self.states += 1
        self.length[new], self.first_end[new] = self.length[last] + 1, end
        p = last
        while p != -1 and not self.step(p, c):
            self._go(p, c, new)
            p = self.link[p]
        if p == -1:
            return new
        q = self.step(p, c)
        if self.length[q] == self.length[p] + 1:
            self.link[new] = q
            return new
        clone = self.states
        self.states += 1
        self.length[clone], self.link[clone], self.first_end[clone] = self.length[p] + 1, self.link[q], self.first_end[q]
        self.letter[clone], self.target[clone] = self.letter[q], self.target[q]
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        while p != -1 and self.step(p, c) == q:
            self._go(p, c, clone)
            p = self.link[p]
        self.link[q] = self.link[new] = clone
        return new


def factorise(letters: list[int]) -> list[tuple[int, int, int]]:
    """Lempel-Ziv factors: (begin, end, where it also begins earlier, or -1 for a letter that is new)."""
    automaton = SuffixAutomaton(letters)
    step, first_end, n = automaton.step, automaton.first_end, len(letters)
    out, i = [], 0
    while i < n:
        state, j, earlier = 0, i, -1
        while j < n:
            state = step(state, letters[j])
            if first_end[state] >= j:
                break
            earlier = first_end[state]
            j += 1
        if j == i:
            out.append((i, i + 1, -1))
            i += 1
        else:
            out.append((i, j, earlier - (j - i) + 1))
            i = j
    return out


def own_agreement(letters: list[int]) -> list[int]:
    """For each place, how many letters from there on agree with the start."""
    n, z, left, right = len(letters), [0] * len(letters), 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and letters[k] == letters[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def agreement(pattern: list[int], text: list[int]) -> list[int]:
    """For each place of ``text``, how many letters from there on agree with the start of ``pattern``."""
    return own_agreement([*pattern, -1, *text])[len(pattern) + 1 :]


def runs_at_boundary(letters: list[int], boundary: int, begin: int, end: int, exponent: int, shortest: int) -> Iterator[Run]:
    """Runs between ``begin`` and ``end`` that hold the letter before or behind ``boundary``, by Main's algorithm.

    A stretch that goes on beyond ``begin`` or ``end`` is not given.
    """
    left, right = letters[begin:boundary], letters[boundary:end]
    back, most = left[::-1], (end - begin) // exponent
    n_ahead, n_across = min(most, len(left)), min(most, len(right))
    # To the right of the boundary: agreement of its letters with those q further on, and of those q before with them.
    behind, ahead = own_agreement(right), agreement(right, [*left[len(left) - n_ahead :], *right])
    # To the left of it, the same backwards.
    before, across = own_agreement(back), agreement(back, [*right[:n_across][::-1], *back])
    n = len(letters)
    for q in range(1, most + 1):
        need = max(shortest, exponent * q)
        if q <= len(right):  # the run holds the q letters behind the boundary
            i = boundary - across[n_across - q]
            j = boundary + q + (behind[q] if q < len(right) else 0)
            if j - i >= need and (i == 0 or letters[i - 1] != letters[i - 1 + q]) and (j == n or letters[j] != letters[j - q]):
                yield i, j, q
        if q <= len(left):  # the run holds the q letters before the boundary
            i = boundary - q - (before[q] if q < len(left) else 0)
            j = boundary + ahead[n_ahead - q]
            if j - i >= need and (i == 0 or letters[i - 1] != letters[i - 1 + q]) and (j == n or letters[j] != letters[j - q]):
                yield i, j, q


def maximal_runs(letters: list[int], exponent: int = 4, shortest: int = 6) -> list[Run]:
    """All runs of a sequence, by begin and period; ``exponent`` is 2 at least."""
    factors = factorise(letters)
    found: dict[tuple[int, int], int] = {}
    n = len(letters)
    for k in range(1, len(factors) + 1):
        before, at, _ = factors[k - 1]
        end = factors[k][1] if k < len(factors) else n
        # A run that reaches into the factor begins less than a period before the factor in front of it, and
        # its period fits ``exponent`` times into what lies between; one that ends at the boundary lies inside that factor.
        begin = max(0, before - (end - before) // (exponent - 1) - 1)
        if end - begin >= shortest:
            for i, j, q in runs_at_boundary(letters, at, begin, end, exponent, shortest):
                if q < found.get((i, j), n):
                    found[i, j] = q
    at_begin: dict[int, list[tuple[int, int]]] = {}
    for (i, j), q in sorted(found.items()):
        at_begin.setdefault(i, []).append((j, q))
    if at_begin:
        for begin, end, earlier in factors:
            if end - begin > shortest:
                shift = begin - earlier
                for i in range(earlier + 1, end - shift - shortest):
                    for j, q in at_begin.get(i, ()):
                        if j + shift >= end:
                            break
                        insort(at_begin.setdefault(i + shift, []), (j + shift, q))
    return sorted(((i, j, q) for i, ends in at_begin.items() for j, q in ends), key=lambda r: (r[0], r[2]))


def dense_parts(word: np.ndarray, owner: np.ndarray, times: int, shortest: int) -> Iterator[tuple[int, int]]:
    """Stretches (begin, end) of the words of a batch of texts that hold all of their runs.

    Between two cuts nearly every word occurs ``times`` times at least, and there are ``shortest`` words.
    Cutting ends after ``_ROUNDS`` rounds at the latest, since a round may find a single cut; what is left
    uncut then is searched all the same.
    """
    at, part = np.arange(len(word)), owner.astype(np.int64)
    for _ in range(_ROUNDS):
        if not len(at):
            break
        pair = part * (int(word.max()) + 1) + word[at]
        _, which, count = np.unique(pair, return_inverse=True, return_counts=True)
        often = count[which] >= times
        at, old = at[often], part[often]
        new = np.r_[True, (np.diff(at) > 1) | (np.diff(old) > 0)] if len(at) else np.zeros(0, bool)
        part = np.cumsum(new) - 1
        size = np.bincount(part) if len(at) else np.zeros(0, np.int64)
        long = (size >= shortest)[part] if len(at) else np.zeros(0, bool)
        done = bool(often.all()) and bool(long.all())
        at, part = at[long], part[long]
        if done:
            break
    edge = np.flatnonzero(np.r_[True, np.diff(part) > 0, True]) if len(at) else np.zeros(0, np.int64)
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(at[i]), int(at[j - 1]) + 1


def text_runs(words: Words, exponent: int, shortest: int) -> dict[int, list[Run]]:
    """The runs of each text of a batch that has any; places are word numbers of the text."""
    ids = _word_ids(words)
    out: dict[int, list[Run]] = {}
    for begin, end in dense_parts(ids, words.owner, exponent, shortest):
        part = ids[begin:end]
        d = int(np.searchsorted(words.first, begin, "right")) - 1
        offset = begin - int(words.first[d])
        small = np.unique(part, return_inverse=True)[1].tolist()
        found = [(i + offset, j + offset, q) for i, j, q in maximal_runs(small, exponent, shortest)]
        if found:
            out.setdefault(d, []).extend(found)
    return out


def _word_ids(words: Words) -> np.ndarray:
    """A number for each distinct word, the same wherever it stands."""
    size = words.ends - words.starts
    where = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=where[1:])
    step = np.zeros(len(words.data) + 1, np.int8)
    step[words.starts] = 1
    np.add.at(step, words.ends, -1)
    inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    column = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(where), pa.py_buffer(words.data[inside])])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, shortest: int = 6) -> DataFrame:
    """Per row of ``docs``: ``(id, n_words, runs, collapsed)``.

    ``runs`` is an array of (start, length, period), by start and period, of all maximal runs of at least
    ``shortest`` words that hold their smallest period ``exponent`` times; ``collapsed`` has the words
    that no run holds behind its first period, joined by one space. Words are runs of anything but
    ASCII white space.

    Defined results: null and wordless texts have no runs and collapse to the empty text; a text of any
    length is read whole, in one task, in time linear in it; repeated rows and ids, null ids too, are
    read alike; an empty table gives an empty result; other columns are ignored, so their names can't
    clash.
    """
    if exponent < 2 or shortest < 2:
        raise ValueError("a run holds its period twice at least")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = split_words(batch.column("text"))
                found = text_runs(words, exponent, shortest)
                raw = words.data.tobytes()
                texts, runs = [], []
                for d in range(batch.num_rows):
                    i, j = int(words.first[d]), int(words.first[d + 1])
                    said = raw[words.starts[i] : words.ends[j - 1]].split() if i < j else []
                    for a, b, q in found.get(d, ()):
                        said[a + q : b] = [None] * (b - a - q)
                    texts.append(b" ".join(w for w in said if w is not None).decode() if d in found else b" ".join(said).decode())
                    runs.append([{"start": a, "length": b - a, "period": q} for a, b, q in found.get(d, ())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(words.counts, pa.int64()), pa.array(runs, pa.list_(run_type)), pa.array(texts, pa.string())],
                    ["id", "n_words", "runs", "collapsed"],
                )

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def plant_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as ``(id, text)``, the tail of about one text in ten being a repeated stretch of it.

    With h the CRC-32 of the id's decimal digits and g = h // 10, a text of n > 0 words whose h % 10 is 0
    has, from word a = g % n on, word a + (i - a) % p in place of word i, p being 1 + (n - a) // (3 + g % 8).
    Rows with a null id, null texts and texts without words stay as they are.
    """
    word = r"[^\x20\x09-\x0D]+"
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    own = own.withColumn("h", F.crc32(F.col("id").cast("string").cast("binary")))
    chosen = (F.col("h") % 10 == 0) & F.col("text").rlike(word)
    own = own.withColumn("words", F.when(chosen, F.regexp_extract_all("text", F.lit(word), 0)))
    own = own.withColumn("g", F.floor(F.col("h") / 10)).withColumn("n", F.size("words").cast("long"))
    own = own.withColumn("a", F.when(chosen, F.col("g") % F.col("n")))
    own = own.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    every = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)))
    planted = F.transform(every, lambda i: F.get("words", place(i).cast("int")))
    return own.select("id", F.when(chosen, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The number of runs, the longest one, and digests of all runs and of the collapsed text."""
    runs = F.col("runs")
    order = F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    longest = F.array_min(order)
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = found.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), longest.alias("m"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    length: Column = -F.col("m.l")
    return out.select(
        "doc_id", "n_runs", F.col("m.s").alias("start"), length.alias("length"), F.col("m.p").alias("period"),
        F.floor(length * 1000 / F.col("m.p")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


RUNS_SQL = rf"""
WITH {CRC_SQL},
w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS words, {crc_sql("hex(doc_id::VARCHAR)")} AS h FROM documents, crc_table),
g AS (SELECT doc_id, words, len(words) AS n, h % 10 = 0 AND len(words) > 0 AS planted, h // 10 AS g FROM w),
a AS (SELECT *, CASE WHEN planted THEN g % n ELSE n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
said AS (SELECT doc_id, n, i, words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM p)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM said x JOIN said y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM said ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) AS k FROM runs) WHERE k = 1),
lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM runs GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN lines USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
