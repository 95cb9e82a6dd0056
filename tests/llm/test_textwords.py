from __future__ import annotations

import numpy as np
import pyarrow as pa
from brute import words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factlake.llm import chat, textwords
from factlake.llm.near_dedup import shingle_sets

TEXT = st.text(alphabet=st.sampled_from("ab \t\n\x0b\x0c\r\x1fé  漢🙂A"), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    found = textwords.split_words(pa.array(texts, pa.string()))
    raw = found.data.tobytes()
    got = [[raw[found.starts[i] : found.ends[i]].decode() for i in range(a, b)] for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
    assert got == [words(t) for t in texts]
    every = [w for row in got for w in row]
    h = found.hashes().tolist()
    assert all((x == y) == (a == b) for x, a in zip(every, h, strict=True) for y, b in zip(every, h, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5), st.integers(1, 4))
def test_phrases_stay_in_their_text(texts, k):
    found = textwords.split_words(pa.array(texts))
    hashes, at = textwords.phrases(found.hashes(), found.first, k)
    want = [tuple(words(t)[i : i + k]) for t in texts for i in range(len(words(t)) - k + 1)]
    assert len(hashes) == len(want) == len(at)
    assert len(set(hashes.tolist())) == len(set(want))


def test_hashes_do_not_depend_on_the_place():
    said = ["", "a", "abcdefgh", "abcdefghi", "é" * 32, "x" * 64, "x" * 65, "x" * 100, "\0", "\0" * 8, "\0" * 9, "y" * 5000]
    texts = pa.array([" ".join(said), None, " ".join(reversed(said)), *said])
    found = textwords.split_words(texts)
    raw, h = found.data.tobytes(), found.hashes().tolist()
    every = [raw[a:b] for a, b in zip(found.starts, found.ends, strict=True)]
    assert len(set(zip(every, h, strict=True))) == len(set(every)) == len(set(h)) == len(said) - 1
    assert (textwords.split_words(texts.slice(2)).hashes() == h[len(said) - 1 :]).all()


def test_hashes_are_not_linear():
    a, b = "a", "b"
    for _ in range(11):  # words on which polynomial hashes modulo 2**64 agree
        a, b = a + b, b + a
        assert len(set(textwords.split_words(pa.array([a, b])).hashes().tolist())) == 2


def test_shingle_sets():
    a, b, c, d, e = shingle_sets(pa.array(["A b c d e f", "a B c d e  f\n", "a b", None, "b a"]), 5)
    assert (a == b).all() and len(a) == 2 and len(c) == 1 and len(d) == 0 and c[0] != e[0]


def test_slices_cover_all_rows():
    batch = pa.record_batch({"text": pa.array(["a" * 10, None, "b" * 100, "", "c"]), "n": pa.array(range(5))})
    parts = list(textwords.slices(batch, "text", 12))
    assert [x for p in parts for x in p.column("n").to_pylist()] == list(range(5)) and len(parts) == 3
    assert list(textwords.slices(batch.slice(0, 0), "text")) == []


def test_escapes_are_reversible(spark):
    r = np.random.default_rng(2)
    texts = ["".join(r.choice(list("<|\\\n>ai"), r.integers(0, 14))) for _ in range(3000)] + [chat.PROBE, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"),
        chat.escape_role(F.col("t")).alias("r"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("v"),
    )
    for x in rows.collect():
        assert x["u"] == x["t"] == x["v"] and "<|" not in x["e"] and "<|" not in x["r"] and "\n" not in x["r"]
