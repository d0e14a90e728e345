"""Near copies at a Jaccard similarity of 0.8 against brute force, and the pipeline's stage that drops them."""

from __future__ import annotations

import random
import tracemalloc

import corpus_pipeline
import numpy as np
import pytest

from sparkloom.llm import bloom, nearcopies


def plain_set(text):
    found = (text or "").encode().lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def plain_components(docs):
    sets, root = [plain_set(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i, (name, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(name)
    return {name: min(groups[find(i)]) for i, (name, _) in enumerate(docs)}


@pytest.fixture(scope="module")
def edited():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", " \n", "one", "ONE", "a b c d e", "a b c d e f"]
    for k in range(20):
        base = [word() for _ in range(rng.choice([12, 40, 150, 400]))]
        texts.append(" ".join(base) + (f" {passage}" if k % 2 else ""))
        for _ in range(6):  # around the threshold on both sides
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 20))):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own) + (f" {passage}" if k % 2 else ""))
    base = [word() for _ in range(200)]
    for _ in range(60):  # a large group of near copies of one text
        own = list(base)
        for _ in range(rng.randint(1, 7)):
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join(own))
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts))


def test_near_copies_equal_brute_force(spark, edited):
    docs = spark.createDataFrame(edited, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()}
    assert got == plain_components(edited)


def test_the_stage_drops_edited_copies(spark, sf, edited):
    docs = spark.createDataFrame(edited, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    assert kept == set(plain_components(edited).values())


def test_near_copies_of_odd_tables(spark):
    assert nearcopies.near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = nearcopies.near_copies(spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "A b c"), (None, "z")], "doc_id long, text string"))
    assert sorted(map(repr, map(tuple, got.collect()))) == ["(1, 1)", "(1, 1)", "(None, 1)", "(None, None)"]


def template_texts(n, shared=200, words=320, seed=5):
    """Texts of one template, about 0.44 alike: ``shared`` words of all, the rest of their own."""
    rng = random.Random(seed)
    base = [f"t{k}" for k in range(shared)]
    return [(i, " ".join(base + [f"p{rng.randrange(10**9)}" for _ in range(words - shared)])) for i in range(n)]


def test_texts_of_a_template_are_not_paired(spark, monkeypatch):
    """Compared pairs follow the number of texts, not its square; near copies within the crowd are still linked."""
    compared = []
    verified = nearcopies._verified
    monkeypatch.setattr(nearcopies, "_verified", lambda pairs, sets: compared.append(pairs.count()) or verified(pairs, sets))
    for n in (300, 1200):
        del compared[:]
        texts = template_texts(n)
        edited = [(n + i, t.rsplit(" ", 6)[0] + f" x{i} y{i}") for i, t in texts[::30]]
        docs = spark.createDataFrame(texts + edited, "doc_id long, text string").repartition(4)
        got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()}
        assert got == {i: i - n if i >= n else i for i in got} and len(got) == n + len(edited)
        assert sum(compared) <= n, (n, compared)


@pytest.mark.parametrize("seed", range(3))
def test_crowds_equal_brute_force(spark, seed):
    """Templates of every likeness around 0.8, short texts and passages of many, with copies in other cases."""
    rng = random.Random(seed)
    texts = []
    for size, own in ((60, 2), (60, 6), (60, 12), (12, 1), (200, 18)):
        base = [f"b{size}.{own}.{k}" for k in range(size)]
        for _ in range(30):
            one = list(base)
            for _ in range(rng.randint(0, own)):
                one[rng.randrange(size)] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(one if rng.random() < 0.8 else [w.upper() for w in one]))
    passage = " ".join(f"s{k}" for k in range(80))
    texts += [passage + " " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(rng.choice([5, 15, 25, 60]))) for _ in range(40)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == plain_components(rows)


@pytest.mark.parametrize("numbers", [0, 30])
def test_nothing_large_is_broadcast(spark, edited, monkeypatch, numbers):
    """Tables beyond ``NUMBERS`` aren't sent to the driver, filters stand for them: what is found and what stays is the same."""
    sent, broadcast = [], nearcopies.F.broadcast
    monkeypatch.setattr(nearcopies.F, "broadcast", lambda table: sent.append(table.count() * len(table.columns)) or broadcast(table))
    monkeypatch.setattr(nearcopies, "NUMBERS", numbers, raising=False)
    rows = edited + template_texts(60) + [(None, "x y"), (None, "x y"), (7, "twice"), (7, "twice"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = sorted(map(repr, map(tuple, nearcopies.without_copies(docs).collect())))
    assert max(sent, default=0) <= numbers
    monkeypatch.undo()
    assert kept == sorted(map(repr, map(tuple, nearcopies.without_copies(docs).collect()))) and 0 < len(kept) < len(rows)
    docs = spark.createDataFrame(edited, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(nearcopies, "NUMBERS", numbers, raising=False)
    assert {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()} == plain_components(edited)


def test_a_filter_reaches_the_driver_without_a_row_for_each_word(spark):
    """Of a filter of 2 MB the driver's Python allocates little more than that; some 500 bytes for each of its 262,144 words before."""
    hashes = spark.range(200_000).selectExpr("xxhash64(id) AS hash")
    bloom.of_hashes(hashes.limit(10), 10, 24)  # whatever is imported for it
    tracemalloc.start()
    try:
        made = bloom.of_hashes(hashes, 200_000, 24)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(made) == 1 << 18 and peak < 3 * made.nbytes, peak
    held, other = (np.array([r[0] for r in spark.range(k, k + 5000).selectExpr("xxhash64(id)").collect()], np.int64).view(np.uint64) for k in (0, 200_000))
    assert bloom.holds(made, held).all() and bloom.holds(made, other).mean() < 0.01
