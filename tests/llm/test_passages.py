"""Substring dedup against brute force over all windows."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from conftest import rows

from sparkloom.llm import passages, queries
from sparkloom.llm.passages import Automaton


def plain(table, window=50):
    """(id, n_words, n_removed, kept) of each row; an id that is null is larger than all others."""
    rank = lambda i: (i is None, i or 0)
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in table]
    first: dict[tuple, tuple] = {}
    for i, words in split:
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            first[key] = min(first.get(key, rank(i)), rank(i))
    out = []
    for i, words in split:
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < rank(i):
                gone[k : k + window] = [True] * window
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((i, len(words), sum(gone), " ".join(kept)))
    return sorted(out, key=repr)


def odd_texts(rng):
    word = lambda: rng.choice(["a", "bé", "ccc", "Dd", "e.", "漢字", "x y", " z"]) + str(rng.randrange(60))
    words = lambda n: [word() for _ in range(n)]
    space = lambda ws: "".join(w + rng.choice([" ", "\n", "\t ", "\x0b"]) for w in ws)
    shared = [words(n) for n in (49, 50, 51, 74, 75, 120, 400)]
    texts = [space(words(rng.randint(0, 150)) + rng.choice(shared) + words(rng.randint(0, 60)) + rng.choice(shared)[: rng.randint(1, 400)]) for _ in range(60)]
    long = words(700)
    for _ in range(12):  # near copies
        near = list(long)
        near[rng.randrange(700)] = word()
        texts.append(" ".join(near))
    return [*texts, *texts[:6], None, "", " \n\t", "one", " ".join(["w"] * 300), " ".join(["w"] * 49), " ".join(["w"] * 120), "word " * 30_000]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = odd_texts(rng)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    table = list(zip(ids, texts)) + [(None, texts[0]), (None, texts[1] + " more"), (ids[2], texts[3]), (ids[4], texts[4])]
    df = spark.createDataFrame([(i, t, 7, "x", "y", 1) for i, t in table], "doc_id long, text string, id long, t1 string, kept string, `a.b` int").repartition(3)
    got = passages.without_repeats(df)
    assert got.columns == ["doc_id", "n_words", "n_removed", "text"]
    assert rows(got) == plain(table)


def test_small_windows_and_many_shards(spark, monkeypatch):
    """Every passage in a shard of few windows, each dealt to several tasks."""
    monkeypatch.setattr(passages, "SHARD", 40)
    monkeypatch.setattr(passages, "STREAM", 300)
    rng = random.Random(4)
    table = list(enumerate(odd_texts(rng)))
    for window in (2, 7, 33):
        df = spark.createDataFrame(table, "doc_id long, text string")
        assert rows(passages.without_repeats(df, window=window)) == plain(table, window)


def test_a_passage_that_most_documents_hold(spark):
    rng = random.Random(8)
    hot = " ".join(f"hot{k}" for k in range(60))
    table = [(i, f"{' '.join(str(rng.random()) for _ in range(20))} {hot} end{i}") for i in range(300)]
    assert rows(passages.without_repeats(spark.createDataFrame(table, "doc_id long, text string"))) == plain(table)


def test_string_ids_and_nothing(spark):
    text = " ".join(map(str, range(80)))
    df = spark.createDataFrame([("b", text), ("a", text + " x"), ("c", None)], "name string, body string")
    got = {r["name"]: (r["n_words"], r["n_removed"], r["text"]) for r in passages.without_repeats(df, id_col="name", text_col="body").collect()}
    assert got == {"a": (81, 0, text + " x"), "b": (80, 80, ""), "c": (0, 0, "")}
    assert rows(passages.without_repeats(df.limit(0), id_col="name", text_col="body")) == []


def test_automaton_compares_words_not_hashes():
    automaton = Automaton(4)
    automaton.add("a b c d e f", 1)
    automaton.compile()
    assert automaton.spans("x a b c d e y", 2) == [(1, 6)] and automaton.spans("a b c d", 1) == [] and automaton.spans("a b c x d", 2) == []
    automaton.words[2] = "other"  # as if another window had the same hash
    assert automaton.spans("a b c d e f", 2) == []


def test_query_equals_brute_force(spark, sf):
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted(((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in plain(table)), key=repr)
    got = rows(queries.op11_substring_dedup(spark, sf))
    assert got == want and sum(r[2] for r in got) > 1000
