from __future__ import annotations

import functools
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import base_metrics, decision_list, ftrl, grams, targets, words
from pyspark.sql import functions as F

import corpus_pipeline
from factlake.llm import mixing, quality_rules, toxicity
from factlake.llm.queries import MODEL
from factlake.llm.sentencepiece_sampling import build_lattice, decode, sample_encode, sample_texts, segments, vocabulary
from factlake.llm.textwords import split_words

TEXTS = [None, "", " ", "a", "The quick brown fox.\nIt jumps  over", "ünï çødé 漢字 🙂 \t x", " lead", "trail  ", "▁mark ▁", "a" * 3000, "\n\n", "x\x00y"]


def _frame(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame(list(enumerate(texts)), schema)


# --- SentencePiece sampling


def _segmentations(text, vocab, power):
    """Every segmentation of a short text with its probability, by recursion over the bytes."""
    data = (" " + text).encode() if text else b""
    pieces = {vocab.bytes[i]: i for i in vocab.ids[:-1]}

    def walk(at):
        if at == len(data):
            yield [], 0.0
            return
        char = next(n for n in range(1, 5) if at + n == len(data) or data[at + n] & 0xC0 != 0x80)
        steps = [(n, [pieces[data[at : at + n]]]) for n in range(1, len(data) - at + 1) if data[at : at + n] in pieces]
        if data[at : at + char] not in pieces:
            steps.append((char, [int(vocab.byte_ids[b]) for b in data[at : at + char]]))
        for n, ids in steps:
            for rest, weight in walk(at + n):
                yield ids + rest, weight + power * sum(vocab.log_weight[i] for i in ids)

    found = [(tuple(ids), w) for ids, w in walk(0)]
    top = max(w for _, w in found)
    total = top + math.log(sum(math.exp(w - top) for _, w in found))
    return {ids: w - total for ids, w in found}


@pytest.mark.parametrize("text", ["the cat", "é漢\n a", "  ab", "over\nit"])
def test_segmentations_have_their_probabilities(text):
    vocab = vocabulary(MODEL)
    exact = _segmentations(text, vocab, 0.3)
    for key in range(40):
        found = sample_texts(pa.array([text]), np.array([key], np.uint64), 4, 0.3, vocab)[0]
        assert len({tuple(x.ids.tolist()) for x in found}) == len(found) == min(4, len(exact))
        assert all(abs(x.log_prob - exact[tuple(x.ids.tolist())]) < 1e-9 for x in found)
        assert [x.perturbed for x in found] == sorted((x.perturbed for x in found), reverse=True)


def test_sampling_follows_the_distribution_without_replacement():
    vocab, n = vocabulary(MODEL), 4000
    exact = _segmentations("on it", vocab, 0.5)
    keys = np.arange(n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    found = sample_texts(pa.array(["on it"] * n), keys, 3, 0.5, vocab)
    first = Counter(tuple(x[0].ids.tolist()) for x in found)
    second = Counter(tuple(x[1].ids.tolist()) for x in found)
    for ids, log_p in exact.items():
        p = math.exp(log_p)
        assert abs(first[ids] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-3
        q = sum(math.exp(o) * p / (1 - math.exp(o)) for i, o in exact.items() if i != ids)
        assert abs(second[ids] / n - q) < 4 * math.sqrt(q * (1 - q) / n) + 1e-3
    # Weights by inclusion probabilities add up to one on average.
    weights = [sum(math.exp(x.log_prob - x.log_inclusion) for x in row) for row in found]
    assert abs(np.mean(weights) - 1) < 0.05


def test_every_segmentation_is_found_when_there_are_few():
    vocab = vocabulary(MODEL)
    exact = _segmentations("a", vocab, 1.0)
    found = sample_texts(pa.array(["a"]), np.array([3], np.uint64), 50, 1.0, vocab)[0]
    assert {tuple(x.ids.tolist()) for x in found} == set(exact)
    assert all(x.log_inclusion == 0 for x in found)


def test_round_trips_and_defined_cases(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    frame = _frame(spark, TEXTS).withColumn("ids", F.lit("clash")).unionByName(
        spark.createDataFrame([(None, "x y", "c"), (4, TEXTS[4], "c")], "doc_id long, text string, ids string")
    )
    rows = sample_encode(frame, MODEL, k=2).collect()
    assert all(r["round_trip"] for r in rows)
    for r in rows:
        want = ("x y" if r["doc_id"] is None else TEXTS[r["doc_id"]] or "").replace("▁", " ")
        assert model.decode(list(r["ids"])) == want
    same = [sorted((r["sample"], tuple(r["ids"])) for r in rows if r["doc_id"] == 4)][0]
    assert len(same) == 4 and same[0] == same[1] and same[2] == same[3]
    assert [len(r["ids"]) for r in rows if r["doc_id"] in (0, 1)] == [0, 0]
    again = decode(sample_encode(frame, MODEL, k=1), MODEL).filter("doc_id = 5").collect()
    assert [r["text"] for r in again] == [TEXTS[5]]
    assert sample_encode(frame.limit(0), MODEL).count() == 0


def test_decoding_of_odd_lists(spark):
    rows = [(1, [], "c"), (2, None, "c"), (3, [300, None], None), (4, [10**9], None), (5, [-1], None), (6, [300], None), (6, [300], None)]
    out = decode(spark.createDataFrame(rows, "id int, ids array<int>, Text string"), MODEL).collect()
    piece = vocabulary(MODEL).decode(np.array([300]))
    assert [r["text"] for r in out] == ["", None, None, None, None, piece, piece] and out[0].asDict().keys() == {"id", "ids", "text"}


def test_a_very_long_text_is_sampled_whole(spark):
    text = " ".join(f"word{i % 701}" for i in range(40_000))
    rows = sample_encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), MODEL).collect()
    assert len(rows) == 2 and all(r["round_trip"] and r["n_pieces"] > 40_000 for r in rows)


def test_batches_of_empty_texts():
    vocab = vocabulary(MODEL)
    for texts in ([], [None], ["", None, ""]):
        found = sample_texts(pa.array(texts, pa.string()), np.zeros(len(texts), np.uint64), 2, 1.0, vocab)
        assert [[len(x.ids) for x in row] for row in found] == [[0]] * len(texts)


def test_samples_do_not_depend_on_partitions(spark):
    frame = _frame(spark, [f"some text number {i} with words" for i in range(50)])
    a = sorted((r["doc_id"], r["sample"], tuple(r["ids"])) for r in sample_encode(frame.repartition(7), MODEL).collect())
    b = sorted((r["doc_id"], r["sample"], tuple(r["ids"])) for r in sample_encode(frame.coalesce(1), MODEL).collect())
    assert a == b


def test_lattice_probabilities_add_up():
    vocab = vocabulary(MODEL)
    _, seg = segments(pa.array(["the ünknown 漢 word"]))
    lattice = build_lattice(seg.data, seg.starts, seg.ends, vocab, 1.0)
    used = lattice.last > lattice.first
    sums = np.add.reduceat(lattice.prob, lattice.first[used])
    assert np.allclose(sums, 1)


def test_sums_of_a_lattice_do_not_depend_on_its_other_segments():
    vocab, r = vocabulary(MODEL), random.Random(4)
    many = " ".join("".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(20_000))
    _, seg = segments(pa.array([many]))
    both = build_lattice(seg.data, seg.starts, seg.ends, vocab, 1.0)
    for s in range(0, len(seg.starts), 997):
        alone = build_lattice(seg.data, seg.starts[s : s + 1], seg.ends[s : s + 1], vocab, 1.0)
        a, b = int(both.start[s]), int(alone.start[0])
        assert both.upto[both.first[a] : both.last[a]].tolist() == alone.upto[alone.first[b] : alone.last[b]].tolist()


def test_sampling_keeps_little_in_memory(spark):
    """Of texts with few repeated words, whose lattices are the largest."""

    class Documents:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.run = run
            return self

        def withColumnRenamed(self, *_):
            return self

    r = random.Random(5)
    texts = [" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(500)) for _ in range(800)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "text"])
    run = sample_encode(Documents(), MODEL, k=2, together=True).run
    list(run(iter([batch.slice(0, 1)])))
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == len(texts) and peak < 250e6


# --- Quality rules


def test_base_metrics_match_brute_force(spark):
    r = random.Random(1)
    texts = [*TEXTS, "a b c a b c", "a a a a", "x y\nx y\n\n x y", "#*$%&|<> ok", "\x0b\x0c q"]
    texts += [" ".join(r.choice("abcde") for _ in range(n)) + "\n" + " ".join(r.choice("abcdefghij") for _ in range(60)) for n in (10, 50, 200)]
    texts += [" ".join(f"t{i % 5000}" for i in range(20_000))]
    rows = quality_rules.apply_rules(quality_rules.text_statistics(_frame(spark, texts)), []).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in rows} == {i: base_metrics(t) for i, t in enumerate(texts)}


def test_rules_are_learned_and_applied(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        w = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(80)]
        kind = i % 9
        if kind == 0:
            w = [x + "$$$" for x in w]
        if kind == 1:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if kind < 2 else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    stats = quality_rules.text_statistics(docs)
    gold = spark.createDataFrame(labels + [(None, 0), (5000, None), (3, 1)], "doc_id long, quality int")
    rules = quality_rules.learn_rules(stats, gold, "doc_id", "quality", quality_rules.Settings())
    assert 1 <= len(rules) <= 4 and all(str(c) for rule in rules for c in rule)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(stats, rules).collect()}
    assert sum(kept[i] == bool(y) for i, y in labels) >= 890
    none = quality_rules.learn_rules(stats, gold.limit(0), "doc_id", "quality", quality_rules.Settings())
    assert none == []
    assert quality_rules.text_statistics(docs.limit(0)).count() == 0


def test_decision_list_by_hand():
    settings = quality_rules.Settings(support=1)
    rows = [(i, 0 if i % 4 == 0 else 1, float(i % 4 == 0) + i / 1e4, 0.0) for i in range(120)]
    rules = quality_rules.cover(rows, ["symbol_share", "bar_share"], settings)
    assert len(rules) == 1 and rules[0][0].feature == "symbol_share" and rules[0][0].above


@pytest.mark.parametrize("seed", range(6))
def test_decision_lists_match_a_plain_one(seed):
    r = random.Random(seed)
    names = ["symbol_share", "bar_share", "mean_word"]
    rows, noise = [], 0.03 if seed < 2 else 0.0
    for _ in range(600 if seed >= 2 else r.choice([30, 200])):
        x = {n: round(r.random(), r.choice([1, 3])) for n in names}
        bad = (x["symbol_share"] > 0.7 and x["bar_share"] < 0.6) or x["mean_word"] < 0.1
        rows.append((x, int(not bad) if r.random() >= noise else r.randrange(2)))
    got = quality_rules.cover([(i, y, *x.values()) for i, (x, y) in enumerate(rows)], names, quality_rules.Settings())
    assert [[(c.feature, c.above, c.threshold) for c in rule] for rule in got] == decision_list(rows) and (got or noise)


# --- Toxicity


def test_training_matches_a_plain_one():
    r = random.Random(5)
    s = toxicity.Settings(l1=0.7, epochs=3)
    texts = [" ".join(r.choice("Vile you there alpha béta 漢字 x1".split()) for _ in range(r.choice([0, 1, 3, 12]))) for _ in range(80)] + [None, "é-é!"]
    made = [np.unique(np.concatenate([i for i, _ in toxicity.features(pa.array([t], pa.string()), s)])) for t in texts]
    assert [set(m.tolist()) for m in made] == [grams(t, _word_hash) for t in texts]
    rows = [(m, int("Vile" in (t or ""))) for m, t in zip(made, texts, strict=True)]
    model = toxicity.train(rows, s)
    want = ftrl([(m.tolist(), y) for m, y in rows], s.alpha, s.beta, s.l1, s.l2, s.epochs)
    assert model.bias == pytest.approx(want.pop(None)) and {i for i, w in want.items() if w} == set(model.index.tolist())
    assert dict(zip(model.index.tolist(), model.weight, strict=True)) == pytest.approx({i: w for i, w in want.items() if w})
    folds = [(m, y, i % 4) for i, (m, y) in enumerate(rows)]
    assert 0 < toxicity.cross_validated(folds, s) < toxicity.cross_validated(folds, toxicity.Settings(l1=1e9)) < math.inf


@functools.cache
def _word_hash(word):
    return int(split_words(pa.array([word])).hashes()[0])


def test_toxicity_learns_words_and_skip_grams(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(1200):
        w = [r.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(r.choice([5, 40]))]
        bad = i % 3 == 0
        if bad:
            at = r.randrange(len(w))
            w[at:at] = ["Vile!"] if i % 2 else ["you", r.choice(w), "there"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([(*x, 0.5) for x in rows] + [(9000, None, 1.0), (9001, "", 1.0), (None, "vile", 1.0)], "doc_id long, text string, Score double")
    gold = spark.createDataFrame(labels + [(None, 1), (77777, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, gold.filter(~toxicity.held_out()), "doc_id", "text", "toxic", toxicity.Settings())
    assert 0 < len(model.index) < 400
    scored = toxicity.score(docs, model).collect()
    by = {r["doc_id"]: r["score"] for r in scored}
    test = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(by[i] >= 0.5) == bool(y) for i, y in test]) > 0.97
    assert by[9000] == by[9001] and 0 < by[9000] < 0.5 < by[None]
    assert toxicity.score(docs.limit(0), model).count() == 0
    empty = toxicity.fit(docs.limit(0), gold, "doc_id", "text", "toxic", toxicity.Settings())
    assert {r["score"] for r in toxicity.score(docs, empty).collect()} == {0.5}


def test_held_out_is_the_checksum_of_the_id(spark):
    got = spark.range(-5, 300).select("id", toxicity.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


def test_scores_do_not_depend_on_the_batch():
    settings = toxicity.Settings()
    texts = ["you vile thing", "a b c", None, "vile " * 50]
    model = toxicity.train([(np.unique(np.concatenate([i for i, _ in toxicity.features(pa.array([t]), settings)])), y) for t, y in zip(texts, (1, 0, 0, 1), strict=True)] * 8, settings)
    together = toxicity.score_texts(pa.array(texts), model)
    assert np.allclose(together, [toxicity.score_texts(pa.array([t], pa.string()), model)[0] for t in texts])


def test_a_very_long_text_is_scored_whole(spark):
    settings = toxicity.Settings(l1=0.1)
    grams = lambda t: np.unique(np.concatenate([i for i, _ in toxicity.features(pa.array([t]), settings)]))
    model = toxicity.train([(grams("vile"), 1), (grams("fine"), 0)] * 20, settings)
    long = "fine " * 300_000
    docs = spark.createDataFrame([(1, long), (2, long + "vile"), (3, "fine"), (4, "fine vile")], "doc_id long, text string")
    by = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert by[1] < by[2] and by[3] < by[4]


# --- Mixing


def _mixed(frame, **more):
    documents, pieces = mixing.mix_sources(frame, **more)
    return mixing.mixed_words(documents, pieces).collect(), pieces.collect()


@pytest.mark.parametrize("block", [3, 50, 4096])
def test_mixing_meets_its_targets(spark, block):
    r = random.Random(4)
    rows = []
    for i in range(300):
        source = r.choice(["a", "b", "c", "é", "z", None, "hot", "hot", "hot"])
        rows.append((i, " ".join(["w"] * r.choice([0, 1, 10, 200])), source))
    rows += [(400, None, "a"), (401, "only five words are here", "tiny"), (402, None, "none"), (7, "again again", "hot"), (7, "again again", "hot"), (None, "no id", "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).repartition(5)
    out, pieces = _mixed(frame, block_words=block)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = targets(dict(sizes))
    taken = Counter()
    for x in out:
        taken[x["source"]] += x["taken"]
        assert x["source_size"] == sizes[x["source"]] and abs(x["target"] - want[x["source"]]) < 1e-6
        assert 0 <= x["taken"] <= 3 * x["size"]
    assert len(out) == len(rows)
    assert all(taken[s] == math.floor(want[s] + 1e-9) for s in sizes)
    assert sum(p["n_words"] for p in pieces) == sum(taken.values()) and all(0 < p["n_words"] <= block for p in pieces)
    key = lambda rows_: sorted(((x["id"], x["size"], x["taken"]) for x in rows_), key=str)
    assert key(out) == key(_mixed(frame.repartition(3), block_words=block)[0])


def test_every_prefix_of_the_schedule_is_near_the_targets(spark):
    t = spark.createDataFrame([(1, 0.1 * 1000), (2, 0.25 * 1000), (3, 0.65 * 1000)], "s int, target double")
    slots = sorted((r["slot"], r["s"], r["k"]) for r in mixing.slot_schedule(t, 3000).collect())
    assert [x[0] for x in slots] == list(range(3000))
    seen = Counter()
    for n, (_, s, k) in enumerate(slots, 1):
        assert k == seen[s]
        seen[s] += 1
        assert all(abs(seen[i] - n * p) < 6 for i, p in ((1, 0.1), (2, 0.25), (3, 0.65)))


def test_slots_select_the_blocks(spark, monkeypatch):
    rows = [(i, " ".join(["w"] * 20), "abc"[i % 3]) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    schedule = mixing.slot_schedule
    slots = {r["slot"] for r in schedule(spark.createDataFrame([(1, 5.0), (2, 2.0), (3, 1.0)], "s int, target double"), 600).collect()}
    _, pieces = _mixed(frame, block_words=10)
    assert sum(p["slot"] in slots for p in pieces) >= 0.95 * len(pieces)
    monkeypatch.setattr(mixing, "slot_schedule", lambda targets, n: schedule(targets, n // 2))
    with pytest.raises(RuntimeError):
        _mixed(frame, block_words=10)


def test_the_mix_stage_keeps_the_order(spark):
    rows = [(i, " ".join([f"w{i}"] * 4096), "en", "abc"[i // 100], 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen, out = Counter(), corpus_pipeline.mix(spark, docs, "").collect()
    for n, r in enumerate(out, 1):
        seen[r["source"]] += 1
        assert all(abs(seen[s] - n * p) < 7 for s, p in (("a", 5 / 8), ("b", 2 / 8), ("c", 1 / 8)))
    assert len(out) > 290


def test_a_very_long_text_is_mixed_whole(spark):
    rows = [(1, "w " * 150_000, "a"), (2, "w " * 50, "b")]
    out, pieces = _mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {x["id"]: x["size"] for x in out} == {1: 150_000, 2: 50} and max(p["first_word"] for p in pieces) > 140_000


def test_mixing_of_an_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, source string")
    assert _mixed(frame) == ([], [])
    wordless = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    out, pieces = _mixed(wordless)
    assert [x["taken"] for x in out] == [0, 0] and pieces == []
