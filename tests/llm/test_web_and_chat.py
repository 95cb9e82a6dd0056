from __future__ import annotations

import datetime
import hashlib
import pathlib

import pytest
from pyspark.sql import functions as F

from factlake.llm import chat, licenses, urls

DAY = datetime.date


# --- URL filters


def _filtered(spark, captures, entries):
    c = spark.createDataFrame(captures, "id int, link string, at date, entry string, key string")
    e = spark.createDataFrame(entries, "kind string, pattern string, action string, day date")
    out = urls.filter_captures(c, e, "link", "at")
    assert sorted(out.columns) == sorted(["id", "link", "at", "key", "host", "entry", "action", "blocked"])
    return sorted((r["id"], r["host"], r["entry"], r["action"], r["blocked"]) for r in out.collect())


ENTRIES = [
    ("domain", "Bad.org", "block", DAY(2024, 1, 10)),
    ("domain", "bad.org", "remove", DAY(2024, 2, 1)),
    ("domain", "bad.org", "block", DAY(2024, 3, 1)),
    ("host", "ok.bad.org", "allow", DAY(2024, 1, 15)),
    ("domain", "org", "block", DAY(2024, 3, 10)),
    (None, "x.com", "block", DAY(2024, 1, 1)),
    ("host", None, "block", DAY(2024, 1, 1)),
    ("host", "x.com", "block", None),
    ("host", "x.com", "ban", DAY(2024, 1, 1)),
    ("host", "tie.com", "allow", DAY(2024, 1, 1)),
    ("host", "tie.com", "block", DAY(2024, 1, 1)),
]


@pytest.mark.parametrize("most", [0, 100])
def test_entries_hold_from_their_day_to_the_next(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "MOST_BROADCAST", most)
    rows = [
        (1, "http://bad.org/x", DAY(2024, 1, 9)),
        (2, "HTTP://u:p@Sub.BAD.org:80/x", DAY(2024, 1, 10)),
        (3, "http://bad.org", DAY(2024, 2, 1)),
        (4, "http://bad.org.?q", DAY(2024, 3, 5)),
        (5, "https://ok.bad.org/", DAY(2024, 3, 20)),
        (6, "https://a.ok.bad.org/", DAY(2024, 3, 20)),
        (7, "https://other.org/", DAY(2024, 3, 20)),
        (8, None, DAY(2024, 3, 20)),
        (9, "no url", DAY(2024, 3, 20)),
        (10, "http://bad.org/", None),
        (11, "http://x.com/", DAY(2024, 3, 20)),
        (12, "http://tie.com/", DAY(2024, 3, 20)),
        (12, "http://tie.com/", DAY(2024, 3, 20)),
        (13, "http://notbad.orgs/", DAY(2024, 3, 20)),
    ]
    out = _filtered(spark, [(*r, "clash", None) for r in rows], ENTRIES)
    assert [x[4] for x in out] == [False, True, False, True, False, True, True, False, False, False, False, True, True, False]
    assert [x[2] for x in out][3:7] == ["bad.org", "ok.bad.org", "bad.org", "org"]


def test_empty_lists_and_captures(spark):
    row = [(1, "http://bad.org", DAY(2024, 3, 5), None, None)]
    assert _filtered(spark, row, []) == [(1, "bad.org", None, None, False)]
    assert _filtered(spark, [], ENTRIES) == []


def test_any_names_and_long_urls(spark):
    url = "http://bad.org/" + "x" * 500_000
    names = ("__host", "__at", "at", "row", "key", "a.b", "host", "Entry")
    rows = [(1, url, DAY(2024, 3, 5), *"abcdefgh"), (2, url, None, *"abcdefgh"), (3, None, DAY(2024, 3, 5), *[None] * 8)]
    c = spark.createDataFrame(rows, ["id", "link", "when", *names])
    e = spark.createDataFrame(ENTRIES, "kind string, pattern string, action string, day date")
    out = urls.filter_captures(c, e, "link", "when")
    assert out.columns == ["id", "link", "when", "__host", "__at", "at", "row", "key", "a.b", "host", "entry", "action", "blocked"]
    got = sorted((r["id"], r["__host"], r["a.b"], r["link"] == url, r["blocked"]) for r in out.collect())
    assert got == [(1, "a", "f", True, True), (2, "a", "f", True, False), (3, None, None, False, False)]


def test_hosts_of_any_number_of_labels(spark):
    deep = "a." * 200_000
    day = DAY(2024, 3, 20)
    rows = [(1, f"http://{deep}bad.org/"), (2, f"http://{deep}ok.bad.org"), (3, "http://" + "b" * 400_000 + ".org"), (4, f"http://{deep}x.net/" + "." * 100_000), (5, "http://org")]
    more = [("domain", "z.x.net", "block", DAY(2024, 1, 1)), ("domain", "very.deep.a.a.a.bad.org", "block", DAY(2024, 1, 1)), ("domain", "", "block", DAY(2024, 1, 1))]
    out = _filtered(spark, [(i, u, day, "clash", None) for i, u in rows], ENTRIES + more)
    assert [x[2:] for x in out] == [("bad.org", "block", True)] * 2 + [("org", "block", True), (None, None, False), ("org", "block", True)]
    assert urls.label_counts(urls.validity(spark.createDataFrame(ENTRIES + more, "kind string, pattern string, action string, day date"))) == [1, 2, 3, 7]


# --- Licenses


def test_canonical_texts_are_equal(spark):
    mit = dict(licenses.TEXTS)["MIT"]
    variants = [
        mit,
        "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace("\n", "  \r\n "),
        "  © 1999 X\nAll rights reserved.\n" + mit.replace('"', "“").replace(",", " ,"),
        mit.replace("sublicense", "sublicence"),
        mit.replace("hereby", "herby"),
        mit + " And more.",
        None,
        "",
        "...",
        "LICENCED under the Apache Licence, version 2.0",
    ]
    docs = spark.createDataFrame(list(enumerate(variants)), "doc_id long, text string").withColumn("digest", F.lit("clash"))
    docs = docs.unionByName(docs.filter("doc_id = 0"))
    out = {}
    rows = licenses.scan(docs, licenses.known_texts(spark)).collect()
    for r in rows:
        out[r["doc_id"]] = (r["license"], r["digest"])
    assert len(rows) == len(variants) + 1
    assert [out[i][0] for i in range(10)] == ["MIT"] * 4 + [None] * 5 + ["Apache-2.0 notice"]
    assert out[6][1] is None and out[7][1] == out[8][1] == hashlib.sha256(b"").hexdigest()


def test_common_licenses_with_their_headings(spark):
    mit, folder = dict(licenses.TEXTS)["MIT"], pathlib.Path(licenses.__file__).parent / "license_texts"
    whole = {p.stem: p.read_text(encoding="utf-8") for p in folder.glob("*.txt")}
    apache = whole["Apache-2.0"]
    texts = [
        ("MIT", "MIT License\n\nCopyright (c) 2021 Some One\n\n" + mit),
        ("MIT", "The MIT License (MIT)\n\n" + mit),
        ("ISC", "ISC License\n\nCopyright (c) 2021, Some One\n\n" + dict(licenses.TEXTS)["ISC"]),
        ("MIT notice", "Released under the MIT License."),
        *whole.items(),
        ("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "2020 Some One")),
        ("Apache-2.0", apache[: apache.index("APPENDIX")]),
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, Some One\nAll rights reserved.\n\n" + licenses._BSD2 + licenses._BSD3 + licenses._BSD_END),
        ("BSD-2-Clause", licenses._BSD2 + licenses._BSD_END),
        (None, "MIT License"),
        (None, apache + " And more."),
    ]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["license"] for r in licenses.scan(docs, licenses.known_texts(spark)).collect()}
    assert len(whole) == 6 and [found[i] for i in range(len(texts))] == [n for n, _ in texts]


def test_a_license_in_a_very_long_text(spark):
    mit = dict(licenses.TEXTS)["MIT"]
    docs = spark.createDataFrame([(1, mit + " ," * 300_000, "c"), (2, mit + " word" * 100_000, "c")], "doc_id long, text string, license string")
    assert {r["doc_id"]: r["license"] for r in licenses.scan(docs, licenses.known_texts(spark)).collect()} == {1: "MIT", 2: None}


def test_license_tables_may_be_empty_or_repeat(spark):
    docs = spark.createDataFrame([(1, "A b"), (None, "A b")], "doc_id long, text string")
    known = spark.createDataFrame([("z", "a B!"), ("y", "a-b"), (None, "a b"), ("e", " "), ("n", None)], "license string, text string")
    assert [r["license"] for r in licenses.scan(docs, known).collect()] == ["y", "y"]
    assert [r["license"] for r in licenses.scan(docs, known.limit(0)).collect()] == [None, None]
    assert licenses.scan(docs.limit(0), known).count() == 0


# --- Chat


def _messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("clash"))


def test_conversations_round_trip(spark):
    rows = [
        (1, 0, "system", "be <|im_end|> nice"),
        (1, 1, "user", None),
        (1, 2, "assistant", "<\\|im_start|> \\ <\\\\|x"),
        (1, 3, "assistant", "🙂é\n"),
        (2, 5, "we\\n\nird<|", "t"),
        (2, None, None, ""),
        (3, 1, "assistant", "same"),
        (3, 1, "assistant", "same"),
        (None, 0, "user", "null id"),
        (4, 0, "assistant", "x" * 200_000),
    ]
    paths = chat.best_paths(chat.linear_tree(_messages(spark, rows)))
    made = chat.format_paths(paths)
    read = {r["conv_id"]: r["t"] for r in made.select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    by: dict = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)):
        by.setdefault(c, []).append((role or "", text or ""))
    assert {c: [(x["role"], x["text"]) for x in t] for c, t in read.items()} == by
    for r in chat.digests(made).collect():
        turns = by[r["conv_id"]]
        learnt = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(learnt)
        assert r["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()


def test_control_strings_only_mark_turns(spark):
    made = chat.format_paths(chat.best_paths(chat.linear_tree(chat.with_probe(_messages(spark, [])))))
    row = made.collect()[0]
    assert row["conv_id"] == -1 and row["formatted"].count(chat.START) == 2 == row["formatted"].count(chat.END)
    assert len(row["loss"]) == 1


def _best(tree, most):
    """Paths by walking up from every leaf."""
    nodes: dict = {}
    for c, n, p, _, _, s in tree:
        nodes.setdefault(c, {})[n] = (p, s or 0.0)
    out = []
    for c, own in nodes.items():
        parents = {p for p, _ in own.values()}
        found = []
        for n in own:
            if n in parents:
                continue
            path, at, total = [], n, 0.0
            while at in own and at not in path:
                path.append(at)
                total += own[at][1]
                at = own[at][0]
            if at not in path:
                found.append((-total, n, path))
        for rank, (_, _, path) in enumerate(sorted(found)[:most], 1):
            out += [(c, rank, i, str(n)) for i, n in enumerate(path)]
    return sorted(out)


@pytest.mark.parametrize("most", [1, 3])
def test_best_paths_of_trees(spark, most):
    import random

    r = random.Random(6)
    tree = []
    for c in range(12):
        for n in range(r.choice([1, 5, 40])):
            parent = None if n == 0 else r.choice([n - 1, n - 1, r.randrange(n)])
            tree.append((c, n, parent, "user", str(n), r.choice([None, 0.0, 1.0, 2.5])))
    tree += [(20, 1, 99, "user", "1", 1.0), (21, 1, 2, "user", "1", 1.0), (21, 2, 1, "user", "2", 1.0), (21, 3, 2, "user", "3", 1.0)]
    frame = spark.createDataFrame(tree, "conv_id long, node long, parent long, role string, text string, score double")
    got = chat.best_paths(frame.withColumn("total", F.lit("clash")), most).collect()
    assert sorted((x["conv_id"], x["path"], x["above"], x["text"]) for x in got) == _best(tree, most)
    assert chat.best_paths(frame.limit(0)).count() == 0


def test_a_long_chain_takes_few_rounds(spark):
    rows = [(1, i, "user", str(i)) for i in range(700)]
    out = chat.best_paths(chat.linear_tree(_messages(spark, rows)))
    assert sorted(r["above"] for r in out.collect()) == list(range(700))
