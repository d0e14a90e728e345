"""Language ID and toxicity: held-out accuracy, and odd tables."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F

from sparkloom.llm import langid, queries, toxicity


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")


# -- language ID -----------------------------------------------------------------------------------------------------


def test_languages_of_held_out_documents(spark, docs):
    got = queries.op3_language_id(spark, f"{DATA}/sf0.01")
    right = F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))
    share = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(right).first()[0]
    assert share > 0.95
    assert got.count() == docs.count() and got.where("score < 0 OR score > 1 OR score IS NULL").isEmpty()


def test_language_id_looks_at_texts_only(spark, docs):
    model = langid.fit(docs)
    one = langid.identify(docs.limit(20), model)
    other = langid.identify(docs.limit(20).withColumns({"lang": F.lit("xx"), "source": F.lit("yy")}), model)
    assert rows(one) == rows(other)


def test_odd_texts_have_no_language(spark, docs):
    model = langid.fit(docs)
    texts = [None, "", " 123 ?!\n", "²³", "a", "word " * 200_000, "中文" * 400, "zzqx 0x9f"]
    odd = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, id int")
    got = sorted(rows(langid.identify(odd, model)))
    assert [r[1:] for r in got[:4]] == [("und", 0.0, False)] * 4
    assert all(r[1] in model.languages for r in got[4:])
    assert not got[6][3], "a script that was never learned is rejected"
    assert rows(langid.identify(odd.limit(0), model)) == []


def test_without_training_rows_everything_is_unknown(spark, docs):
    model = langid.fit(docs.limit(0))
    assert {r[1:] for r in rows(langid.identify(docs.limit(5), model))} == {("und", 0.0, False)}
    nulls = langid.fit(docs.limit(5).withColumn("lang", F.lit(None).cast("string")))
    assert not nulls.languages


def test_clusters_are_unit_vectors_near_their_points():
    rng = np.random.default_rng(3)
    centres = np.eye(4, 8)
    points = np.repeat(centres, 20, axis=0) + 0.01 * rng.random((80, 8))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    made, own = langid.cluster(points.astype(np.float32), 4)
    assert np.allclose(np.linalg.norm(made, axis=1), 1, atol=1e-5)
    assert ((points * made[own]).sum(axis=1) > 0.99).all()


def test_term_counts_equal_plain_counts():
    text = "Ab  1cé"
    folded = b" ab c\xc3\xa9 "
    grams = [folded[i : i + n] for n in langid.ORDERS for i in range(len(folded) - n + 1)]
    assert langid.term_counts([text, "", text]).sum(axis=1).tolist() == [len(grams), 0, len(grams)]


# -- toxicity --------------------------------------------------------------------------------------------------------


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(docs, labels.where("doc_id % 3 <> 0"), ("quality", "toxic"))
    got = toxicity.score(docs.where("doc_id % 3 = 0"), chain).join(labels, "doc_id")
    hit, said, held = got.agg(F.count(F.when(F.col("is_toxic") & (F.col("toxic") == 1), 1)), F.count(F.when(F.col("is_toxic"), 1)), F.sum("toxic")).first()
    assert held > 50 and 2 * hit / (said + held) > 0.9


def test_later_models_get_earlier_probabilities(spark):
    texts = [f"{'bad words here' if k % 3 == 0 else 'kind words here'} {'shout' if k % 2 else 'calm'} n{k}" for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), int(k % 3 == 0 and k % 2 == 1)) for k in range(200)], "doc_id long, rude int, harsh int")
    chain = toxicity.fit(docs, labels, ("rude", "harsh"))
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1
    assert chain.weights[1][-2] > 0  # what is rude is more likely to be harsh
    got = toxicity.score(docs, chain).join(labels, "doc_id")
    assert got.where("is_rude <> (rude = 1)").isEmpty()


def test_newton_steps_find_the_least_loss():
    rng = np.random.default_rng(5)
    lists = [np.flatnonzero(rng.random(30) < 0.2) for _ in range(400)]
    dense = np.hstack([rng.random((400, 2)), np.ones((400, 1))])
    y = np.array([float(3 in x) if rng.random() < 0.9 else 1.0 for x in lists])
    rows_ = toxicity._Rows(lists, 30, dense)
    full = np.zeros((400, 30))
    for i, x in enumerate(lists):
        full[i, x] = 1
    full = np.hstack([full, dense])
    w = rng.random(33)
    assert np.allclose(rows_.times(w), full @ w) and np.allclose(rows_.back(y), full.T @ y)
    made = toxicity._train(rows_, y, np.ones(400, bool))
    gradient = full.T @ (1 / (1 + np.exp(-full @ made)) - y)
    gradient[:-1] += 1.0 * made[:-1]
    assert np.abs(gradient).max() < 0.05


def test_categories_may_have_any_names_and_ids_may_repeat(spark, docs):
    some = docs.limit(60).select("doc_id", "text")
    twice = some.union(some.withColumn("text", F.concat("text", F.lit(" ~")))).withColumns({"n": F.lit(1), "words": F.lit("x")})
    labels = some.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("n"), (F.col("doc_id") % 3 == 0).cast("int").alias("words"))
    chains = [toxicity.fit(d, labels, ("n", "words")) for d in (twice, twice.repartition(3), some)]
    assert chains[0].categories == ("n", "words")
    assert all(np.array_equal(chains[0].hashes, c.hashes) and np.allclose(chains[0].weights[1], c.weights[1]) for c in chains[1:])
    got = toxicity.score(twice, chains[0])
    assert got.columns == ["doc_id", "p_n", "is_n", "p_words", "is_words"] and got.count() == 120


def test_odd_tables(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    chain = toxicity.fit(docs, labels, ("toxic",))
    assert toxicity.score(docs.limit(5), chain).where("p_toxic > 0.01 OR is_toxic").isEmpty()
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    chain = toxicity.fit(docs, labels, ("toxic",))
    odd = spark.createDataFrame([(1, None, 1), (1, "", 2), (None, "word " * 100_000, 3)], "doc_id long, text string, p_toxic int")
    assert toxicity.score(odd, chain).count() == 3
    assert rows(toxicity.score(odd.limit(0), chain)) == []


def test_the_query_equals_brute_force(spark, sf):
    """Every document scored by itself: sets of words and beginnings, three shares, one model after the other."""
    from sparkloom.llm import words as W

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(docs, labels, ("quality", "toxic"))
    got = {r["doc_id"]: r for r in queries.op8_toxicity(spark, sf).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        text = r["text"] or ""
        own = W.split([text])
        words = [own.bytes(k) for k in range(len(own.begin))]
        long = [k for k, w in enumerate(words) if len(w) > toxicity.BEGINNING]
        assert W.beginnings(own, toxicity.BEGINNING)[0].tolist() == long
        terms = set(own.hash.tolist()) | set(W.beginnings(own, toxicity.BEGINNING)[1].tolist())
        has = [float(h in terms) for h in chain.hashes.tolist()]
        letters = [c for c in text if c.isascii() and c.isalpha()]
        signs = sum(33 <= ord(c) < 127 and not c.isalnum() for c in text)
        dense = [sum(c.isupper() for c in letters) / max(1, len(letters)), signs / max(1, len(text.encode())), 1 - len(set(words)) / max(1, len(words))]
        for c, w in zip(("quality", "toxic"), chain.weights):
            p = 1 / (1 + np.exp(-float(np.dot(has + dense + [1.0], w))))
            assert abs(got[r["doc_id"]][f"p_{c}"] - p) < 1e-6
            dense.append(p)
        assert got[r["doc_id"]]["toxic_pred"] == (dense[-1] >= chain.cuts[1])
