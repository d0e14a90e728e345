"""Greedy string tiling against a search for the longest match, and leaks against brute force."""

from __future__ import annotations

import random

import numpy as np
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import decontaminate
from sparkloom.llm import words as W


def plain_tiles(pattern, text, least):
    """Mark the longest common run of unmarked tokens, the first by place, until none is long enough."""
    used_p, used_t, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for p in range(len(pattern)):
            for t in range(len(text)):
                n = 0
                while p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n] and p + n not in used_p and t + n not in used_t:
                    n += 1
                best = max(best, (n, -p, -t))
        n, p, t = best[0], -best[1], -best[2]
        if n < least:
            return tiles
        tiles.append((p, t, n))
        used_p |= set(range(p, p + n))
        used_t |= set(range(t, t + n))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=25), st.lists(st.one_of(st.none(), st.integers(1, 4)), max_size=30), st.integers(2, 4))
def test_tiles_equal_plain_search(pattern, text, least):
    assert decontaminate.tile(pattern, text, least) == plain_tiles(pattern, text, least)


def tokens(text):
    own = W.split([text])
    return [own.bytes(k) for k in range(len(own.begin))]


def plain_leaks(docs, items, coverage=0.6, least=5):
    out = []
    for i, text in docs:
        for k, item in items:
            a, b = tokens(item), tokens(text)
            found = plain_tiles(a, b, least) if a else []
            if found and sum(t[2] for t in found) >= coverage * len(a):
                out.append((i, k, sum(t[2] for t in found)))
    return sorted(out)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    say = lambda n: rng.choices(vocabulary, k=n)
    items = [(k, " ".join(say(rng.randint(8, 30)))) for k in range(12)] + [(50, None), (51, ""), (52, "too short"), (3, "the same id as another item has here")]
    docs = []
    for i in range(60):
        words = say(rng.randint(0, 60))
        if i % 3 == 0:  # a passage of an item, whole or with its halves exchanged
            part = items[i % 12][1].split()
            half = len(part) // 2
            part = part if i % 2 else part[half:] + ["between"] + part[:half]
            words[5:5] = part
        docs.append((i, ", ".join(words).upper() if i % 4 == 0 else " ".join(words)))
    docs += [(900, None), (901, ""), (902, "word " * 50_000 + items[0][1]), (0, docs[0][1])]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, id int, item_id string")
    bench = spark.createDataFrame([(k, t) for k, t in items], "item_id long, text string")
    found = decontaminate.find_leaks(frame, bench, block_chars=500)  # several blocks
    assert found.columns == ["doc_id", "item_id", "n_items", "item_words", "matched_words", "longest_tile", "tiles", "coverage"]
    small = [d for d in docs if d[0] != 902]
    assert [r for r in rows(found.where("doc_id <> 902").select("doc_id", "item_id", "matched_words"))] == sorted(plain_leaks(small, [x for x in items if x[1]]), key=repr)
    assert 0 in {r["item_id"] for r in found.where("doc_id = 902").collect()}


def test_blocks_behind_the_filter_find_the_same(spark):
    rng = random.Random(8)
    say = lambda n: rng.choices([f"w{k}" for k in range(300)], k=n)
    items = [(k, " ".join(say(20))) for k in range(30)]
    docs = [(i, " ".join(say(40) + (items[i % 30][1].split() if i % 5 == 0 else []) + say(9))) for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = ["doc_id", "item_id", "coverage"]
    one, many = (decontaminate.find_leaks(frame, bench, block_chars=n).select(key) for n in (10_000_000, 200))
    assert rows(one) == rows(many) and {r[0] for r in rows(one)} == set(range(0, 200, 5))
    left = [decontaminate.without_leaks(frame, bench, block_chars=n) for n in (10_000_000, 200)]
    assert [rows(x) for x in left] == [sorted((d for d in docs if d[0] % 5), key=repr)] * 2


def test_items_of_equal_words_are_one_and_short_ones_are_whole_lines(spark):
    long = "one two three four five six"
    bench = spark.createDataFrame([(7, long), (3, long.upper()), (9, long + "!"), (4, "yes, indeed"), (5, "Yes indeed."), (6, "?"), (None, "no")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"a {long} b"), (1, f"a {long} b"), (2, "so\nYES INDEED\nno"), (3, "yes indeed not"), (4, None), (5, "")], "doc_id long, text string")
    got = rows(decontaminate.find_leaks(docs, bench).select("doc_id", "item_id", "n_items", "matched_words", "tiles"))
    assert got == sorted([(1, 3, 3, 6, [1, 0, 6])] * 2 + [(2, 4, 2, 2, [1, 0, 2]), (2, None, 1, 1, [3, 0, 1])], key=repr)
    classes = dict(rows(decontaminate.item_classes(bench).select("item_id", "class_hash").where("item_id IS NOT NULL")))
    assert classes[7] == classes[3] == classes[9] != classes[4] == classes[5] and classes[6] is None


def test_the_rows_without_leaks(spark):
    long = "one two three four five six"
    docs = spark.createDataFrame([(1, long, 5), (1, "clean", 6), (None, f"x {long}", 7), (None, None, 8), (2, "clean", 9), (2, "clean", 9)], "doc_id long, text string, uid int")
    bench = spark.createDataFrame([(1, long)], "item_id long, text string")
    got = decontaminate.without_leaks(docs, bench)
    assert got.columns == docs.columns
    assert rows(got) == sorted([(1, "clean", 6), (None, None, 8), (2, "clean", 9), (2, "clean", 9)], key=repr)
    assert rows(decontaminate.without_leaks(docs, bench.limit(0))) == rows(docs) and rows(decontaminate.without_leaks(docs.limit(0), bench)) == []


def test_tiles_say_where_words_stand(spark):
    docs = spark.createDataFrame([(1, "x y z one two three four five six q")], "doc_id long, text string")
    bench = spark.createDataFrame([("b", "one two three four five six")], "item_id string, text string")
    (row,) = decontaminate.find_leaks(docs, bench).collect()
    assert (row["item_id"], row["coverage"], row["longest_tile"], row["tiles"]) == ("b", 1.0, 6, [3, 0, 6])


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert rows(decontaminate.find_leaks(empty, bench)) == []
    docs = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    assert rows(decontaminate.find_leaks(docs, bench.limit(0))) == []
    assert len(rows(decontaminate.find_leaks(docs.union(docs), bench))) == 2


def test_words_hash_alike_wherever_they_stand():
    a, b = W.split(["Many words, of which some REPEAT", "", None, "repeat — some «words»"]), W.split(["some repeat words"])
    named = {a.bytes(k): a.hash[k] for k in range(len(a.begin))}
    assert all(named[b.bytes(k)] == b.hash[k] for k in range(3))
    assert a.text.tolist() == [0] * 6 + [3] * 3
    at, grams = W.grams(a.hash, a.text, 2)
    assert len(at) == 7 and len(np.unique(grams)) == 7


def test_any_number_of_blocks_is_two_passes(spark):
    """Rows are read once through the filter and once to leave leaks out; short items stay behind the filter."""
    rng = random.Random(4)
    say = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    items = [(k, " ".join(say(20))) for k in range(24)] + [(90, "short one"), (91, "Short  one!")]
    docs = [(i, " ".join(say(30) + (items[i % 24][1].split() if i % 6 == 0 else []))) for i in range(180)]
    docs += [(500, "here\nSHORT one.\nthere"), (501, "a short one here"), (502, None), (503, ""), (0, docs[0][1])]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def clean(block_chars):
        frame = spark.createDataFrame(docs, "doc_id long, text string").mapInArrow(count, "doc_id long, text string")
        before = seen.value
        left = rows(decontaminate.without_leaks(frame, spark.createDataFrame(items, "item_id long, text string"), block_chars=block_chars))
        return left, seen.value - before

    one, few, many = clean(10_000_000), clean(1000), clean(60)
    assert one[0] == few[0] == many[0] == sorted((d for d in docs if d[0] != 500 and (d[0] % 6 or d[0] >= 500)), key=repr)
    assert one[1] == len(docs) and few[1] == many[1] == 2 * len(docs)
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    pairs = [rows(decontaminate.find_leaks(frame, bench, block_chars=n).select("doc_id", "item_id", "matched_words")) for n in (10_000_000, 60)]
    assert pairs[0] == pairs[1] and any(p[0] == 500 for p in pairs[0])
