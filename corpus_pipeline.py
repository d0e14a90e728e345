"""The corpus pipeline: stages over ``documents``, each calling one operator of ``sparkloom.llm``.

Every stage takes all rows that its predecessor kept and, but for the last, returns the columns of ``documents``, whatever
they are called (columns are renamed while an operator works). Decisions are made for rows, not ids: of rows that are
alike in every way one stays after near-dedup, and a row whose id another row shares stands for itself. Null ids are
allowed; null and empty texts have no language and go in the first stage. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, langid, linededup, nearcopies, packing
from sparkloom.llm.queries import table, tokenizer_path
from sparkloom.session import remove, scope, written


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The columns under names that no operator uses, and those names."""
    names = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an accepted language go (among them those without any letter)."""
    plain, names = _plain(docs)
    own = {"id_col": names["doc_id"], "text_col": names["text"]}
    model = langid.fit(plain, text_col=names["text"], lang_col=names["lang"])
    named = langid.identify(plain, model, carry=[c for c in plain.columns if c != names["doc_id"]], **own)
    return named.where("accepted").select(*plain.columns).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold go from all but one; texts and their lengths change, no document goes."""
    plain, names = _plain(docs)
    rest = [c for c in plain.columns if c not in (names["doc_id"], names["text"])]
    thinned = linededup.dedup_lines(plain, id_col=names["doc_id"], text_col=names["text"], carry=rest)
    thinned = thinned.withColumn(names["n_chars"], F.length("text").cast("long")).withColumnRenamed("text", names["text"])
    return thinned.select(*plain.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 or more of their five-word shingles shared, Jaccard) the document with the smallest id stays."""
    return nearcopies.without_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: No single SQL statement expresses these stages; ``tests/llm`` compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: each result is written once and read again, and goes when the next one is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scope() as keep:
            after = keep(written(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        remove(docs)
        docs = after
    return docs
