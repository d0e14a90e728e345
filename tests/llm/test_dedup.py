"""SimHash near-dedup and line dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from conftest import rows

from sparkloom.llm import linededup, simhash

DOCS = "doc_id long, text string, id long, fp string, c0 int, gone string"  # the last four clash with names inside


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 7, "x", 1, "y") for i, t in zip(ids or range(len(texts)), texts)], DOCS)


# -- SimHash ---------------------------------------------------------------------------------------------------------


def plain_fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints: list[int], ids: list[int]) -> list[int]:
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min(groups[find(i)]) for i in range(len(prints))]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choices("alpha beta Gamma δelta e f g h".split(), k=rng.randint(1, 400))) for _ in range(25)]
    texts = [*base, *base[:5], None, "", " \t\n", "ONE", "one", "one two", "x y", "word " * 30_000]
    for t in base[:12]:  # near copies of long texts
        words = t.split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    ids = rng.sample(range(1000), len(texts))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(frame(spark, texts, ids)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert got == {i: (f"{p:016x}", c) for i, p, c in zip(ids, prints, plain_components(prints, ids))}


def test_links_connect_all_pairs_within_the_radius(spark):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.int64)
    prints = {int(c) for c in centre}
    for c in centre:
        for _ in range(30):
            prints.add(int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)))
    prints |= {-1, -2, 0, 1}
    prints = sorted(prints)
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    roots = {r["node"]: r["root"] for r in simhash.components(found).collect()}
    names = plain_components([p & (2**64 - 1) for p in prints], prints)
    assert [roots.get(p, p) for p in prints] == names


def test_near_duplicates_of_odd_tables(spark):
    assert rows(simhash.near_duplicates(frame(spark, []))) == []
    repeated = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "quite another text here"), (None, "a b c"), (None, "z")], "doc_id long, text string")
    got = simhash.near_duplicates(repeated).collect()
    assert len(got) == 5
    assert {r["component_id"] for r in got if r["fingerprint"] == f"{plain_fingerprint('a b c'):016x}"} == {1}
    with pytest.raises(ValueError):
        simhash.links(frame(spark, []), 3)


# -- line dedup ------------------------------------------------------------------------------------------------------


def plain_line_dedup(docs: list[tuple], min_chars=20, min_docs=3) -> list[tuple]:
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line))

    holders = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and i < max(holders[key(x)]))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def line_docs():
    rng = random.Random(5)
    pool = [f"A line that several documents hold, number {k}" for k in range(30)] + ["ÄÖ the umlauts ÄÖ stay as they are", "short", "", "nineteen characters", "exactly twenty chars"]
    docs = []
    for i in range(80):
        lines = [rng.choice(["", "  ", "\t\r"]) + rng.choice([str.upper, str.lower, str])(rng.choice(pool)) + rng.choice(["", " \x0b"]) for _ in range(rng.randint(0, 12))]
        docs.append((i * 3, "\n".join(lines)))
    hot = "The line of which every document has two copies"
    docs = [(i, f"{t}\n{hot}\n{hot.upper()}") for i, t in docs]
    return [*docs, (900, None), (901, ""), (902, "\n"), (903, "\n\n" + "x" * 100_000 + "\n")]


def frame_of(spark, docs):
    return frame(spark, [t for _, t in docs], [i for i, _ in docs])


def test_line_dedup_equals_brute_force(spark, line_docs):
    got = linededup.dedup_lines(frame_of(spark, line_docs), carry=["gone", "id"])
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped", "gone", "id"]
    assert rows(got.drop("gone", "id")) == plain_line_dedup(line_docs)


def test_insertions_and_deletions_are_reversible(spark, line_docs):
    frames = [frame_of(spark, line_docs[k::3]) for k in range(3)]
    index = linededup.empty_index(frames[0], shards=3)
    for f in frames:
        index = linededup.insert(index, f)
    everything = rows(linededup.thin(index, frame_of(spark, line_docs)))
    assert everything == plain_line_dedup(line_docs)
    less = linededup.delete(index, frames[1].select("doc_id"))
    rest = line_docs[0::3] + line_docs[2::3]
    assert rows(linededup.thin(less, frame_of(spark, rest))) == plain_line_dedup(rest)
    assert rows(less.counts) == rows(linededup._count(less.holders))
    again = linededup.insert(linededup.insert(less, frames[1]), frames[1])  # the second time nothing is new
    assert rows(linededup.thin(again, frame_of(spark, line_docs))) == everything


def test_cuckoo_filters_hold_what_was_put_in():
    rng = np.random.default_rng(2)
    h1, h2 = rng.integers(-(1 << 63), 1 << 63, (2, 5000), dtype=np.int64)
    none = (h1[:0], h2[:0])
    levels = linededup.update_levels([], (h1[:3000], h2[:3000]), none)
    levels = linededup.update_levels(levels, (h1[3000:], h2[3000:]), none)
    probe = lambda a, b: np.any([linededup.filter_probe(s, a, b) for s in levels], axis=0)
    assert probe(h1, h2).all()
    other = rng.integers(-(1 << 63), 1 << 63, (2, 20000), dtype=np.int64)
    assert probe(*other).mean() < 0.01
    levels = linededup.update_levels(levels, none, (h1[::2], h2[::2]))
    assert probe(h1[1::2], h2[1::2]).all()
    assert probe(h1[::2], h2[::2]).mean() < 0.01


def test_line_dedup_of_odd_tables(spark):
    assert rows(linededup.dedup_lines(frame(spark, []))) == []
    line = "a line of at least twenty characters"
    docs = spark.createDataFrame([(1, line), (1, line), (2, line), (None, line)], "doc_id long, text string")
    got = rows(linededup.dedup_lines(docs).select("doc_id", "n_dropped"))
    assert got == sorted([(1, 1), (1, 1), (2, 0), (None, 0)], key=repr)  # ids 1, 2 and null are three documents


def test_line_keys_do_not_copy_the_text_for_each_line(spark):
    lines = [f"{i} is a line of its own in a long text" for i in range(20_000)]
    text = "\n".join(lines)  # 0.9 MB: 18 GB, if each key came with it
    found = linededup.line_keys(frame_of(spark, [(1, text), (2, lines[7])]))
    assert found.groupBy("id").count().orderBy("id").collect() == [(1, 20_000), (2, 1)]
    out = linededup.dedup_lines(frame_of(spark, [(1, text), (2, lines[7]), (3, lines[7])]))
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in out.collect()) == [(1, 20_000, 1), (2, 1, 1), (3, 1, 0)]


def test_an_empty_index_needs_no_python_workers(spark):
    index = linededup.empty_index(frame_of(spark, []))
    for table in (index.holders, index.counts, index.filters):
        assert table.count() == 0 and "ExistingRDD" not in table._jdf.queryExecution().toString()
    assert index.counts.dtypes == [("h1", "bigint"), ("h2", "bigint"), ("n_docs", "bigint"), ("last_id", "bigint")]
    assert index.filters.dtypes == [("shard", "int"), ("level", "int"), ("slots", "binary")]


def test_query_equals_hash_of_kept_text(spark, sf):
    from sparkloom.llm import queries

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, k in plain_line_dedup(docs)}
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op6_line_dedup(spark, sf).collect()} == want
