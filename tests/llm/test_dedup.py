from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import factors, near, substring, words
from pyspark.sql import functions as F

from factlake.llm import near_dedup, substring_dedup
from factlake.llm.embedding_dedup import embedding_links
from factlake.llm.near_dedup import near_duplicates
from factlake.llm.substring_dedup import remove_repeated_spans

WORDS = [f"w{i}" for i in range(400)]


def _corpus(seed=1, n=60):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        base = [r.choice(WORDS) for _ in range(r.choice([3, 8, 40, 120]))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(r.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2, 3])):
                copy[r.randrange(len(copy))] = r.choice(WORDS)
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "One two"), (1004, "one  TWO"), (1005, "É é")]
    return rows


def _near(df):
    rows = ((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())
    return sorted(rows, key=lambda x: (x[0] is None, x))


def test_near_duplicates_match_brute_force(spark):
    rows = _corpus()
    sizes, labels = near(rows)
    out = _near(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out == sorted((i, sizes[i], labels[i], labels[i] == i) for i, _ in rows)


def test_near_duplicates_with_large_groups_of_copies(spark):
    r = random.Random(3)
    base = [r.choice(WORDS) for _ in range(60)]
    rows = [(i, " ".join(base)) for i in range(300)]
    for i in range(300, 500):
        copy = list(base)
        for _ in range(r.choice([1, 2, 3])):
            copy[r.randrange(60)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    sizes, labels = near(rows)
    out = _near(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out == sorted((i, sizes[i], labels[i], labels[i] == i) for i, _ in rows)


def test_block_pairs_find_every_component(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rows = _corpus(5, 40)
    sizes, labels = near(rows)
    out = _near(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [x[2] for x in out] == [labels[i] for i, _ in sorted(rows)]


def test_near_duplicates_defined_cases(spark):
    schema = "doc_id long, text string, key string, id int, rep string, n_shingles string"
    text = "a b c d e f g h"
    rows = [(7, text, "x", 1, None, None), (7, text, None, 1, None, None), (None, text, None, None, None, None), (9, text + " i", None, 2, None, None)]
    out = sorted(_near(near_duplicates(spark.createDataFrame(rows, schema))), key=str)
    assert out == sorted([(7, 4, 7, True), (7, 4, 7, True), (None, 4, None, True), (9, 5, 7, False)], key=str)
    long = " ".join(f"v{i % 7919}" for i in range(60_000))
    twice = [(1, long), (2, long + " more"), (3, "other " + long[:1000]), (5, "a b c"), (5, "d e f"), (6, "d e f")]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(twice, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 5: 5, 6: 5}
    assert _near(near_duplicates(spark.createDataFrame([], schema))) == []


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 1 << 63, 4000).astype(np.uint64))
    b = np.unique(np.r_[a[:3000], r.integers(0, 1 << 63, 1000).astype(np.uint64)])
    x, y, z = near_dedup.sketch_sets([a, b, np.union1d(a, b)], 256)
    assert (near_dedup.merge_sketches(x, y) == z).all()
    got = near_dedup.estimate_similarity(x[None], y[None], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(got - 0.6) < 0.12


def _thue_morse(n):
    """Two different words of 2**n letters on which polynomial hashes modulo 2**64 agree from n = 10 on."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_near_duplicates_tell_words_apart(spark):
    a, b = _thue_morse(11)
    rows = [(1, a), (2, b), (3, a.upper()), (4, f"x y z u v {a}"), (5, f"x y z u v {b}")]
    sizes, labels = near(rows)
    out = _near(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out == sorted((i, sizes[i], labels[i], labels[i] == i) for i, _ in rows) and labels[2] == 2


def test_links_are_confirmed_on_words():
    linked = lambda a, b: near_dedup._linked(a.split(), b.split(), 5, 75)
    assert linked("a b c d e f", "a b c d e f") and not linked("a b c d e f g h", "a b c d e x g h")
    assert linked("a b", "a b") and not linked("a b", "b a")
    assert linked("a b c d e f g h", "a b c d e f g h i") and not linked("a b c d e f", "a b c d e f g")


def test_strays_of_a_bucket_meet_every_block(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 300)
    r = random.Random(11)
    base = [r.choice(WORDS) for _ in range(40)]
    rows = []
    for i in range(160):  # chains of steps, so that a bucket's pivot is far from many of its members
        if i % 8 == 0:
            copy = list(base)
        copy[r.randrange(40)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    sizes, labels = near(rows)
    out = _near(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out == sorted((i, sizes[i], labels[i], labels[i] == i) for i, _ in rows)


def test_pairs_at_the_threshold_share_a_band():
    """Of random pairs of similarity 0.75, all agree in a band and pass the estimate."""
    r = np.random.default_rng(7)
    missed = 0
    for union in (4, 8, 20, 60, 320):
        sets = []
        for _ in range(120):
            x = np.unique(r.integers(0, 1 << 63, 2 * union).astype(np.uint64))[:union]
            r.shuffle(x)
            cut = union // 8
            sets += [np.sort(x[: union - cut]), np.sort(np.r_[x[: union - union // 4], x[union - cut :]])]
        regs = near_dedup.sketch_sets(sets, 256)
        a, b = regs[::2], regs[1::2]
        bands = (a == b)[:, :255].reshape(len(a), 51, 5).all(2).any(1)
        sizes = np.array([len(x) for x in sets])
        estimate = near_dedup.estimate_similarity(a, b, sizes[::2], sizes[1::2])
        missed += int((~bands).sum() + (estimate < near_dedup._floor(0.75, 256)).sum())
    assert missed == 0


def _spans(df):
    out = df.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return sorted(tuple(r) for r in out.collect())


def _passages():
    r = random.Random(2)
    shared = [" ".join(r.choice(WORDS) for _ in range(n)) for n in (13, 14, 30, 60)]
    rows = []
    for i in range(80):
        parts = [" ".join(r.choice(WORDS) for _ in range(r.choice([0, 5, 20]))) for _ in range(3)]
        rows.append((i, f" {parts[0]}\n{r.choice(shared)} {parts[1]} {r.choice(shared)}  {parts[2]}"))
    return rows + [(200, None), (201, ""), (202, " "), (203, "zz " * 40), (204, "zz " * 20)]


@pytest.mark.parametrize("batch", [200, 1 << 20])
def test_substring_dedup_matches_brute_force(spark, monkeypatch, batch):
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", batch)
    rows = _passages()
    out = remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    assert _spans(out) == substring(rows)


@pytest.mark.parametrize("batch", [200, 1 << 20])
def test_factors_are_those_of_a_plain_parser(spark, monkeypatch, batch):
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", batch)
    rows = _passages()
    out = remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r["id"]: [tuple(f) for f in r["factors"]] for r in out}
    want = factors(rows)
    assert {i: [f[:2] for f in fs] for i, fs in got.items()} == {i: [f[:2] for f in fs] for i, fs in want.items()}
    assert all(f[2:] in x[2] for i, fs in got.items() for f, x in zip(fs, want[i], strict=True)) and sum(map(len, want.values())) > 100
    said = {i: words(t) for i, t in rows}
    assert all(said[i][a : a + n] == said[s][b : b + n] and s < i for i, fs in got.items() for a, n, s, b in fs)


@pytest.mark.parametrize("batch", [100, 1 << 20])
def test_a_longer_copy_isnt_cut_by_an_older_one_of_its_middle(spark, monkeypatch, batch):
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", batch)
    w = [f"w{i}" for i in range(40)]
    edited = w[:20] + ["other"] + w[21:]
    rows = [(0, " ".join(["x", *w[10:23], "y"])), (1, " ".join(w)), (2, " ".join(w)), (3, " ".join(edited)), (4, " ".join(["z", *w, *edited])), (4, "no copy"), (5, " ".join(w * 30))]
    out = remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = {r["id"]: [tuple(f) for f in r["factors"]] for r in out if r["n_words"] > 2}
    assert got[2] == [(0, 40, 1, 0)] and got[1] == [(10, 13, 0, 1)] and got[3] == [(0, 20, 1, 0), (21, 19, 1, 21)]
    assert got[4] == [(1, 40, 1, 0), (41, 40, 3, 0)]
    assert got[5][:3] == [(0, 60, 4, 1), (48, 52, 4, 9), (88, 52, 4, 9)]
    assert _spans(spark.createDataFrame([tuple(r) for r in rows[:4]], "doc_id long, text string").transform(remove_repeated_spans)) == substring(rows[:4])


def test_phrases_of_different_words_are_kept(spark):
    a, b = _thue_morse(10)
    start = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{start} {a}"), (2, f"{start} {b}"), (3, f"{start} {a}")]
    out = remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    assert _spans(out) == substring(rows) and {r["id"]: r["n_removed"] for r in out.collect()} == {1: 0, 2: 0, 3: 13}


def test_colliding_hashes_are_noticed():
    """A claim of other words than those at the place fails, whatever the hashes."""
    table = pa.table({"batch": [0, 0], "mark": [1, 2], "id": pa.array([1, 2]), "text": ["a b c", "d e f"]})
    group = substring_dedup._Sorted(table)
    claim = lambda id_, at, said: np.array(
        [(id_, at, len(said), substring_dedup._digest(said, 0, len(said)))], substring_dedup._CLAIM
    ).tobytes()
    substring_dedup._confirm(group, iter([claim(1, 1, [b"b", b"c"]), claim(2, 0, [b"d"])]))
    for wrong in (claim(1, 0, [b"b", b"c"]), claim(2, 0, [b"x"]), claim(3, 0, [b"a"])):
        with pytest.raises(substring_dedup.HashCollision):
            substring_dedup._confirm(group, iter([wrong]))


def test_substring_dedup_defined_cases(spark):
    text = " ".join(f"v{i}" for i in range(20))
    rows = [(5, text, "a", None), (5, text, "b", None), (None, text, "c", 1), (6, text + " end", None, 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, batch string, hashes int")
    out = remove_repeated_spans(frame, carry=["batch", "hashes"]).collect()
    got = sorted(((r["id"], r["n_removed"], r["carried"]["batch"]) for r in out), key=str)
    assert got == sorted([(5, 0, "a"), (5, 0, "b"), (None, 0, "c"), (6, 20, None)], key=str)
    spans = next(r["spans"] for r in out if r["id"] == 6)
    assert [(s["start"], s["length"]) for s in spans] == [(0, 20)]
    assert remove_repeated_spans(frame.limit(0)).count() == 0


def test_substring_dedup_of_a_very_long_text(spark):
    long = " ".join(f"q{i % 9973}" for i in range(60_000))
    out = remove_repeated_spans(spark.createDataFrame([(1, long), (2, long)], "doc_id long, text string"))
    assert {r["id"]: r["n_removed"] for r in out.collect()} == {1: 0, 2: 60_000}


def _links(rows, threshold=0.95):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float) / max(map(abs, v))
            good[i] = x / np.sqrt((x * x).sum())
    from brute import components

    ids = sorted(good)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold]
    label = components([i for i, _ in rows if i is not None], links)
    count = {i: sum(i in p for p in links) for i in label}
    return sorted((i, count[i], label[i], label[i] == i) for i in label)


def test_embedding_links_match_brute_force(spark, monkeypatch):
    from factlake.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    monkeypatch.setattr(embedding_dedup, "LEAF", 8)
    r = np.random.default_rng(4)
    base = r.normal(size=(60, 12))
    rows = []
    for i in range(400):
        v = base[r.integers(60)] + r.normal(size=12) * r.choice([0.0, 0.05, 0.2, 0.5])
        rows.append((i, [float(np.float32(x)) for x in v]))
    rows += [(500, None), (501, []), (502, [0.0] * 12), (503, [float("nan")] * 12), (504, [None, 1.0]), (505, [1.0, 2.0]), (506, [2.0, 4.0])]
    rows += [(507, [float("inf")] + [0.0] * 11), (508, [1e-200] * 12), (509, [1e200] * 12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = sorted((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in embedding_links(frame).collect())
    assert out == _links(rows)


@pytest.mark.parametrize(("block", "most"), [(16, 1 << 16), (16, 3)])
def test_far_blocks_are_skipped(spark, monkeypatch, caplog, block, most):
    """Clusters in 64 dimensions: exact, few visits, and tasks of bounded size where blocks are few."""
    from factlake.llm import embedding_dedup

    for name, value in (("BLOCK", block), ("LEAF", 8), ("MOST_BLOCKS", most)):
        monkeypatch.setattr(embedding_dedup, name, value)
    r = np.random.default_rng(9)
    centres = r.normal(size=(12, 64))
    rows = [(i, [float(x) for x in centres[i % 12] + r.normal(size=64) * r.choice([0.02, 0.15])]) for i in range(360)]
    with caplog.at_level("INFO", logger="factlake.llm.embedding_dedup"):
        got = embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in got) == _links(rows)
    _, blocks, made, possible = caplog.records[-1].args
    assert blocks <= most and 4 * made < possible


def test_embedding_links_defined_cases(spark):
    rows = [(1, [1.0, 0.0], "a", 1, None, 0), (1, [1.0, 0.0], "b", 1, None, 0), (None, [1.0, 0.0], None, 1, None, 0), (3, [0.0, 1.0], None, 1, None, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep string, key int, unit binary, block int")
    out = sorted(((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in embedding_links(frame).collect()), key=str)
    assert out == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True), (3, 0, 3, True)], key=str)
    assert embedding_links(frame.limit(0)).count() == 0
