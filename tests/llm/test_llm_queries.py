from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import corpus_pipeline as pipeline
import duckdb
import numpy as np
import oracle
import pyarrow as pa
import pytest
from brute import base_metrics, caught, components, decision_list, ftrl, grams, mix64, near, quality_features, sigmoid, substring, targets, words
from pyspark.sql import functions as F

from factlake.llm import licenses, toxicity
from factlake.llm.queries import MODEL, ORACLE_SQL, QUERIES
from factlake.llm.sentencepiece_sampling import sample_encode
from factlake.llm.textwords import split_words

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def texts():
    return [tuple(r) for r in oracle.database().execute("SELECT doc_id, text FROM documents").fetchall()]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    oracle.same(spark, oracle.database(), QUERIES[name], ORACLE_SQL[name])


def test_near_dedup_query(spark, texts):
    sizes, label = near(texts)
    rows = QUERIES["op4_minhash_near_dedup"](spark, oracle.FOLDER).collect()
    assert sorted(tuple(r) for r in rows) == sorted((i, sizes[i], label[i], label[i] == i) for i, _ in texts)


def test_substring_query(spark, texts):
    rows = QUERIES["op6_substring_dedup"](spark, oracle.FOLDER).collect()
    assert sorted(tuple(r) for r in rows) == substring(texts)


def test_quality_query(spark, texts):
    rows = QUERIES["op2_quality_rules"](spark, oracle.FOLDER).collect()
    assert {r["doc_id"]: tuple(r)[1:7] for r in rows} == {i: base_metrics(t) for i, t in texts}
    label = {}
    for i, y in oracle.database().execute("SELECT doc_id, quality FROM labels WHERE quality IN (0, 1)").fetchall():
        label[i] = max(y, label.get(i, 0))
    order = {r["id"]: r["h"] for r in spark.createDataFrame([(i,) for i in label], "id long").select("id", F.xxhash64("id").alias("h")).collect()}
    text = dict(texts)
    learnt = [(quality_features(text[i]), label[i]) for i in sorted(label, key=order.get) if i in text and not base_metrics(text[i])[5]]
    rules = decision_list(learnt)
    assert {r["doc_id"]: r["kept"] for r in rows} == {i: not base_metrics(t)[5] and not caught(rules, quality_features(t)) for i, t in texts}


def test_embedding_query(spark):
    vectors = oracle.database().execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    unit = np.array([v for _, v in vectors], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.95, 1))
    ids = [i for i, _ in vectors]
    label = components(ids, [(ids[i], ids[j]) for i, j in zip(a, b, strict=True)])
    count = Counter([ids[i] for i in a] + [ids[j] for j in b])
    rows = QUERIES["op5_embedding_near_dedup"](spark, oracle.FOLDER).collect()
    assert sorted(tuple(r) for r in rows) == sorted((i, count[i], label[i], label[i] == i) for i in ids)


def test_toxicity_query(spark, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op10_toxicity"](spark, oracle.FOLDER).collect()}
    assert set(rows) == {i for i, _ in texts}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    s, cache = toxicity.Settings(), {}

    def word_hash(word):
        if word not in cache:
            cache[word] = int(split_words(pa.array([word])).hashes()[0])
        return cache[word]

    label = {}
    for i, y in oracle.database().execute("SELECT doc_id, toxic FROM labels WHERE toxic IN (0, 1)").fetchall():
        if zlib.crc32(str(i).encode()) % 5:
            label[i] = max(y, label.get(i, 0))
    text = dict(texts)
    order = sorted((i for i in label if text.get(i) is not None), key=lambda i: mix64(i))
    weight = ftrl([(sorted(grams(text[i], word_hash)), label[i]) for i in order], s.alpha, s.beta, s.l1, s.l2, s.epochs)
    bias = weight.pop(None)
    want = {i: sigmoid(bias + sum(weight.get(g, 0.0) for g in grams(t, word_hash))) for i, t in texts}
    assert {i: r["score"] for i, r in rows.items()} == pytest.approx(want, abs=1e-9)
    assert {i: r["held_out"] for i, r in rows.items()} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in texts}


def test_sampling_query(spark, texts):
    rows = QUERIES["op1_sentencepiece_sampling"](spark, oracle.FOLDER).collect()
    assert all(r["round_trip"] for r in rows)
    assert Counter(r["doc_id"] for r in rows) == Counter({i: 2 for i, t in texts if t})


def _corpus():
    r = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "ba de fi go lu".split() for b in "n r s t".split()] + [f"w{i}" for i in range(500)]
    shared = " ".join(r.choice(vocabulary) for _ in range(55))
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(vocabulary) for _ in range(r.choice([20, 60]))]
        toxic = i % 6 == 0
        if toxic:
            w[5] = "vilest"
        if i % 10 == 1:
            w[10:10] = shared.split()
        rows.append((i, " ".join(w), "en", r.choice(["a", "b", "c", None]), 0))
        labels.append((i, 1, int(toxic)))
    for i in range(600, 640):
        w = rows[i - 599][1].split()
        w[3] = "changed" if i % 2 else w[3]
        rows.append((i, " ".join(w), "en", "a", 0))
    rows += [(700, None, None, None, None), (701, "", "en", "a", 0), (702, "\n", "en", None, 1)]
    rows += [(703, " ".join(f"{vocabulary[i * i % 487]}{i % 701}" for i in range(20_000)), "fr", "b", 5)]
    return rows, labels


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    rows, labels = _corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near duplicates", "substring dedup", "mixing", "sentencepiece"]
    kept: list = [docs]
    for i, (name, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path / f"stage{i}")
        stage(spark, kept[-1], str(tmp_path)).write.parquet(path)
        kept.append(spark.read.parquet(path))
        if i < 4:
            assert sorted(kept[-1].columns) == sorted(docs.columns), name
    texts = [[(r["doc_id"], r["text"]) for r in k.collect()] for k in kept[:5]]
    # Toxic documents go, the others stay.
    assert {i for i, _ in texts[1]} == {i for i, t in texts[0] if "vilest" not in (t or "")}
    _, label = near(texts[1])
    assert sorted(texts[2], key=str) == sorted(((i, t) for i, t in texts[1] if label[i] == i), key=str)
    digest = lambda t: hashlib.sha256(" ".join(words(t)).encode()).hexdigest()
    assert sorted((i, len(words(t)), digest(t)) for i, t in texts[3]) == sorted((i, n - k, h) for i, n, k, h in substring(texts[2]))
    source = {r["doc_id"]: r["source"] for r in kept[3].collect()}
    size, taken, parts = Counter(), Counter(), dict(texts[3])
    for i, t in texts[3]:
        size[source[i]] += len(words(t))
    for i, t in texts[4]:
        taken[source[i]] += len(words(t))
        assert words(parts[i])[: len(words(t))] == words(t)
    want = targets(dict(size))
    assert all(taken[s] == int(want[s] + 1e-9) for s in size)
    assert max(Counter(i for i, _ in texts[4]).values()) <= 3
    last = kept[5].collect()
    assert all(r["round_trip"] for r in last) and Counter(r["doc_id"] for r in last) == Counter(i for i, _ in texts[4])
    again = pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in again.collect()) == sorted((r["doc_id"], tuple(r["ids"])) for r in last)


def test_the_pipeline_samples_without_replacement(spark):
    texts = ["a longer text with some words", "two of them\nin lines", "", None, "x"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, "the same id again")], "doc_id long, text string")
    rows = sorted(pipeline.encode(spark, docs, "").collect(), key=lambda r: (r["doc_id"], r["n_pieces"]))
    flat = sorted((r["doc_id"], *x) for r in rows for x in (r[1:8], *r["more"]))
    assert len(rows) == 6 and flat == sorted(tuple(r) for r in sample_encode(docs, MODEL, k=2).collect())
    assert all(len(r["more"]) == 1 and r["more"][0]["ids"] != r["ids"] and r["more"][0]["round_trip"] for r in rows if r["doc_id"] < 2)


def test_stages_ignore_other_columns(spark, tmp_path):
    rows, labels = _corpus()
    docs = spark.createDataFrame(rows[:200], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    clash = docs
    for c in ("id", "score", "kept", "row", "batch", "mark", "slot", "carried", "size", "taken", "ids", "key", "rep", "epoch", "whole"):
        clash = clash.withColumn(c, F.lit("clash"))
    for name, stage in pipeline.STAGES:
        plain, other = (sorted(map(str, stage(spark, d, str(tmp_path)).collect())) for d in (docs, clash))
        assert plain == other, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert pipeline.reject_toxic(spark, docs, str(tmp_path / "none")).count() == docs.count()


def test_license_query_finds_planted_texts(spark, tmp_path):
    mit, zlib_ = dict(licenses.TEXTS)["MIT"], dict(licenses.TEXTS)["Zlib"]
    texts = [mit, "Copyright (c) 2020 X\n" + mit.upper(), zlib_.replace("acknowledgment", "acknowledgement"), "LICENCED under CC-BY NC 4.0!", mit + " x", None, "", "..."]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: (r["digest"], r["license"]) for r in QUERIES["op7_license_scan"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {i: (d, n) for i, d, n in con.execute("SELECT doc_id, digest, license FROM (" + ORACLE_SQL["op7_license_scan"] + ")").fetchall()} == rows
    assert [rows[i][1] for i in range(8)] == ["MIT", "MIT", "Zlib", "CC-BY-NC-4.0 notice", None, None, None, None]


def test_license_query_and_sql_know_every_text(spark, tmp_path):
    known = [*licenses.TEXTS, *licenses.more_texts()]
    texts = [t if i % 2 else f"Copyright (c) 2001 Y\n{t.upper()}" for i, (_, t) in enumerate(known)] + [t + " more" for _, t in known]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: (r["digest"], r["license"]) for r in QUERIES["op7_license_scan"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {i: (d, n) for i, d, n in con.execute("SELECT doc_id, digest, license FROM (" + ORACLE_SQL["op7_license_scan"] + ")").fetchall()} == rows
    assert [rows[i][1] for i in range(len(known))] == [n for n, _ in known] and all(rows[i][1] is None for i in range(len(known), len(texts)))


def test_each_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert toxicity.Settings().most_rows == 16_000
