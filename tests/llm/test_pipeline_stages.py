"""The corpus pipeline: every stage on its predecessor's rows, against brute force where it filters."""

from __future__ import annotations

import corpus_pipeline
import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_decontaminate import plain_leaks
from test_dedup import plain_line_dedup
from test_nearcopies import plain_components


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Each stage's result, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        made.append(docs)
    return made


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.orderBy("doc_id").collect()]


def test_stages_keep_the_columns_of_documents(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for df in stages[1:5]:
        assert df.columns == stages[0].columns


def test_language_id_keeps_clean_documents(stages):
    kept = {i for i, _ in texts(stages[1])}
    lost = [t for i, t in texts(stages[0]) if i not in kept]
    assert len(lost) <= 0.05 * stages[0].count()


def test_line_dedup_equals_brute_force(stages):
    assert texts(stages[2]) == sorted((i, t) for i, t, _, _ in plain_line_dedup(texts(stages[1])))


def test_near_dedup_equals_brute_force(stages):
    """Five words and a similarity of 0.8, every document against every other."""
    docs = texts(stages[2])
    names = plain_components(docs)
    assert texts(stages[3]) == [d for d in docs if d[0] == names[d[0]]]


def test_decontamination_equals_brute_force(spark, sf, stages):
    """Both ways: what holds an item goes, and nothing else does."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [d for d in texts(stages[3]) if len(d[1].split()) < 120][:60]
    left = {i for i, _ in texts(stages[4])}
    clean = [(i, t) for i, t in docs if i in left]
    assert not plain_leaks(clean, items[:8])
    gone = [d for d in texts(stages[3]) if d[0] not in left]
    assert gone and all(plain_leaks([d], items) for d in gone if len(d[1].split()) < 400)


ODD = [
    (1, None, "en"), (2, "", "en"), (None, " \n ", None), (3, "123 ?!", "en"), (4, "Der Hund und die Katze sind heute im Garten", None),
    (5, "The same line that is long enough\n" * 3, "en"), (5, "The same line that is long enough\n" * 3, "en"), (6, "The same line that is long enough", "en"),
    (7, "the same line that is long enough \nanother line", "en"), (8, "word " * 30_000, "en"), (None, "The same line that is long enough", "en"),
]
CLASHES = ["accepted", "score", "lang_pred", "n_lines", "n_dropped", "fp", "uid", "id", "row", "length", "piece", "sequence_id", "t1", "column_0", "c0"]


@pytest.fixture(scope="module")
def odd(spark):
    rows_ = [(*r, "x", len(r[1] or ""), *range(len(CLASHES))) for r in ODD]
    return spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHES))


@pytest.mark.parametrize("k", range(4))
def test_stages_take_odd_rows_and_clashing_columns(spark, sf, odd, k):
    stage = corpus_pipeline.STAGES[k][1]
    got = stage(spark, odd, sf)
    assert got.columns == odd.columns and got.schema.simpleString() == odd.schema.simpleString()
    ids = sorted((r["doc_id"] for r in got.collect()), key=repr)
    if k == 1 or k == 3:  # no row goes; rows of one id are one document
        assert ids == sorted((r[0] for r in ODD), key=repr)
    if k == 1:
        lines = {(r["doc_id"], r["text"]) for r in got.collect()}
        assert (6, "") in lines and (7, "the same line that is long enough \nanother line") in lines and (2, "") in lines
        assert (None, "The same line that is long enough") in lines
    if k == 2:  # empty texts are one group, the rows of id 5 another, 6 and the null id a third
        assert ids == sorted([1, 3, 4, 5, 6, 7, 8], key=repr)
    assert got.where(F.col("score") != 1).isEmpty()
    assert rows(stage(spark, odd.limit(0), sf)) == []


def test_packing_takes_odd_rows(spark, sf, odd):
    got = corpus_pipeline.best_fit_packing(spark, odd, sf)
    assert got.select("doc_id", "piece", "start").distinct().count() <= got.count()
    assert got.where("piece = 0").count() == len(ODD)
    assert rows(corpus_pipeline.best_fit_packing(spark, odd.limit(0), sf)) == []


def test_packing_takes_every_document(spark, sf, stages):
    packed = {r["doc_id"] for r in stages[5].select("doc_id").distinct().collect()}
    assert packed == {i for i, _ in texts(stages[4])}
    whole = corpus_pipeline.run(spark, sf)
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, stages[5].select(key).collect()))
