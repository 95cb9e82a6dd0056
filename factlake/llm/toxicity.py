"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are hashes of single words, of pairs of neighbours and of pairs with one or two words
between them, each counted once a text. Training follows per-coordinate FTRL-proximal (McMahan et
al., 2013): every coordinate has its own learning rate, and the L1 term holds rare and uninformative
coordinates at exactly zero, so the weights left are few and can be broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.llm.textwords import LOWER, U, Words, loosened, mix, slices, utf8

#: Bytes that words are made of: letters, digits and everything beyond ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Settings:
    """FTRL-proximal and feature parameters; ``most_rows`` bounds the labelled rows that train.

    Step size, L1 weight and epochs are those of the least ``cross_validated`` loss among 24 settings,
    over 12,000 training rows in four folds.
    """

    bits: int = 22
    gaps: tuple[int, ...] = (1, 2, 3)
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.01
    epochs: int = 6
    most_rows: int = 16_000


@dataclass(frozen=True)
class Model:
    """The coordinates that are not zero, sorted, their weights, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    settings: Settings


def letter_words(texts: pa.Array) -> Words:
    """Words of letters and digits only, A-Z lower-cased."""
    data, offsets = utf8(texts)
    inside = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (~np.r_[False, inside[:-1]][: len(data)] | edge[:-1]))
    ends = np.flatnonzero(inside & (~np.r_[inside[1:], False][: len(data)] | edge[1:])) + 1
    return Words(LOWER[data], starts, ends, np.searchsorted(starts, offsets))


def features(texts: pa.Array, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of gram: the coordinate and the text of every occurrence."""
    words = letter_words(texts)
    h, owner = words.hashes(), words.owner
    keep = U((1 << settings.bits) - 1)
    yield (mix(h ^ U(1)) & keep).astype(np.int64), owner
    for gap in settings.gaps:
        same = owner[gap:] == owner[:-gap]
        pair = mix(h[:-gap] * U(3) + mix(h[gap:] + U(gap)))
        yield (pair[same] & keep).astype(np.int64), owner[gap:][same]


def train(rows: Iterator[tuple[np.ndarray, int]] | list, settings: Settings) -> Model:
    """Weights from (distinct coordinates, label) rows, in the order given, over all epochs."""
    size = 1 << settings.bits
    z, n = np.zeros(size), np.zeros(size)
    bias_z = bias_n = 0.0
    rate = lambda a: (settings.beta + np.sqrt(a)) / settings.alpha

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) > settings.l1, -(zi - np.sign(zi) * settings.l1) / (rate(ni) + settings.l2), 0.0)

    for _ in range(settings.epochs):
        for index, label in rows:
            zi, ni = z[index], n[index]
            w = weights(zi, ni)
            bias = -bias_z / (rate(bias_n) + settings.l2)
            error = _squash(float(w.sum()) + bias) - label
            sigma = (np.sqrt(ni + error * error) - np.sqrt(ni)) / settings.alpha
            z[index] = zi + error - sigma * w
            n[index] = ni + error * error
            step = (math.sqrt(bias_n + error * error) - math.sqrt(bias_n)) / settings.alpha
            bias_z += error - step * bias
            bias_n += error * error
    w = weights(z, n)
    index = np.flatnonzero(w)
    return Model(index, w[index], float(-bias_z / (rate(bias_n) + settings.l2)), settings)


def _squash(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x))))


def cross_validated(rows: list[tuple[np.ndarray, int, int]], settings: Settings) -> float:
    """Mean log loss over (distinct coordinates, label, fold) rows, each fold scored by a model of the others.

    Settings are compared by this on training rows alone; no other row takes part in their choice.
    """
    loss = []
    for fold in sorted({f for _, _, f in rows}):
        model = train([(i, y) for i, y, f in rows if f != fold], settings)
        weight = np.zeros(1 << settings.bits)
        weight[model.index] = model.weight
        for index, label, f in rows:
            if f == fold:
                p = _squash(float(weight[index].sum()) + model.bias)
                loss.append(-math.log(p if label else 1 - p))
    return float(np.mean(loss)) if loss else math.inf


def fit(texts: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, settings: Settings) -> Model:
    """Train on at most ``settings.most_rows`` labelled texts, those whose id hashes lowest.

    Coordinates are made on the executors; one task then trains, as FTRL takes one row after
    another, and only weights that aren't zero reach the driver. Rows without a text, an id or a
    label of 0 or 1 don't train; with no rows left the model scores everything 0.5.
    """
    chosen = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    chosen = chosen.filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(settings.most_rows)
    source = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    source = source.filter("text is not null").join(F.broadcast(chosen), "id")  # at most most_rows

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                index, owner = (np.concatenate(x) for x in zip(*features(batch.column("text"), settings), strict=True))
                order = np.argsort(owner, kind="stable")
                cut = np.searchsorted(owner[order], np.arange(batch.num_rows + 1))
                blobs = [
                    np.unique(index[order[i:j]]).astype(np.int32).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("label"), pa.array(blobs, pa.binary())], ["id", "label", "grams"]
                )

    def learn(table: pa.Table) -> pa.Table:
        ids, labels_ = table.column("id").to_numpy(), table.column("label").to_numpy()
        grams = [np.frombuffer(x, np.int32) for x in table.column("grams").to_pylist()]
        order = np.lexsort((ids, mix(ids.astype(U))))
        model = train([(grams[i], int(labels_[i])) for i in order], settings)
        index = np.append(model.index, -1)
        return pa.table({"index": index.astype(np.int64), "weight": np.append(model.weight, model.bias)})

    made = source.mapInArrow(rows, "id long, label int, grams binary")
    learnt = made.groupBy(F.lit(0).alias("one")).applyInArrow(learn, "index long, weight double")
    got = sorted((r["index"], r["weight"]) for r in learnt.collect())
    bias = got.pop(0)[1] if got else 0.0
    return Model(np.array([i for i, _ in got], np.int64), np.array([w for _, w in got]), bias, settings)


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    """Probability of label 1 for each text."""
    n = len(texts)
    total = np.full(n, model.bias)
    if len(model.index):
        found, owners = [], []
        table = np.zeros(1 << model.settings.bits, bool)
        table[model.index] = True
        for index, owner in features(texts, model.settings):
            hit = table[index]
            found.append(index[hit])
            owners.append(owner[hit])
        pairs = np.unique(np.concatenate(owners) * (1 << model.settings.bits) + np.concatenate(found))
        owner, index = pairs >> model.settings.bits, pairs & ((1 << model.settings.bits) - 1)
        total += np.bincount(owner, model.weight[np.searchsorted(model.index, index)], n)
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column ``score_col``: the probability of label 1, from the whole text.

    Defined results: null and empty texts score what the bias gives; a text of any length is scored
    whole, by one task; repeated rows score alike; an empty table stays empty; a column of that name
    is replaced, whatever its case, and any other names may occur.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)
    names = [c for c in docs.columns if c.lower() != score_col.lower()]
    carried = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                scores = pa.array(score_texts(batch.column("text"), shared.value))
                yield pa.RecordBatch.from_arrays([loosened(batch.column("row")), scores], ["row", "score"])

    kind = carried.schema["row"].dataType.simpleString()
    out = carried.mapInArrow(run, f"row {kind}, score double")
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in names), F.col("score").alias(score_col))


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether the CRC-32 of the id's text leaves no remainder: such rows never train. A null id's text is empty, so it is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0
