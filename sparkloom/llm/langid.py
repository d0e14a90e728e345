"""Language identification by nearest centroids of TF-IDF vectors.

Features are hashed byte n-grams (2 to 4 bytes) of the lower-cased UTF-8 text, in which every run of anything but
letters counts as one space; weights are log(1 + count) times inverse document frequency, vectors have length 1.
Document frequencies come from all training rows. Centroids (several for each language: bisections along the principal
axis, then spherical k-means, none with less than ``LEAST`` of the points) come from a bounded sample: at most
``sample`` distinct texts of each language, chosen by the texts' hashes. A text gets the language of the centroid with
the highest cosine, which is its score; ties go to the language that sorts first. Cosines are sums of whole numbers, so
equal texts have equal scores whatever else is in the table.

A text that is null or has no letter is ``und`` with score 0 and not accepted. Any other text gets a learned language;
it is accepted if both its cosine and its lead over the best centroid of another language reach ``reject`` times what
nearly all sampled texts of that centroid and about that length have: the ``LOW`` quantile, taken for each power of two
of n-grams over the sampled texts and their beginnings (of the whole language, where a centroid has few), and less where
few texts were sampled. Languages that weren't learned but are related to one that was are turned away by what strangers
reach: were a text's own language not learned, the next one would be named, with its lead over the third. Of such leads
towards a language, the ``STRANGE`` quantile and ``APART`` of the way from there to the median of the language's own texts
has to be reached too, as far as nearly all own texts reach it (where three languages or more were learned).

At most ``languages`` distinct languages are learned; more are an error, as centroids of each go through the driver.
Without training rows everything is ``und``. Texts are read whole; repeated rows have rows of their own, with equal
results. A carried column that is called like a result gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm._common import field, keyed_text, map_texts, text_chunks, written

BUCKETS = 4096
ORDERS = (2, 3, 4)
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")  # letters, and numbers such as ² that ``isalpha`` tells apart
#: ASCII bytes that aren't letters become spaces; bytes of characters beyond ASCII stay.
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)
_AT_ONCE = 64  # texts in a block of dense vectors
LOW = 0.01
CUTS = (8, 16, 32, 64, 128, 256, 512, 1024, 2048)  # characters of the beginnings that floors are taken from
SIZES = 40  # powers of two of n-grams
LEAST = 0.05  # of a language's points, in each of its clusters
STRANGE = 0.95
APART = 0.15
OWN = 50  # sampled texts of one size from which on a centroid has floors of its own
_WHOLE = float(1 << 24)  # parts of vectors are whole multiples of its inverse
_LOGS = np.log1p(np.arange(1 << 16)).astype(np.float32)


class Model(NamedTuple):
    idf: np.ndarray
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # in whole multiples
    floors: np.ndarray  # for each centroid and size: the cosine that nearly all its sampled texts reach
    leads: np.ndarray  # the same of the lead over other languages
    apart: np.ndarray  # the lead that keeps related languages out


def term_counts(texts: list[str | None]) -> np.ndarray:
    """Dense n-gram counts, a row for each text."""
    parts = [b" " + (t or "").lower().encode() + b" " for t in texts]
    data = _FOLD[np.frombuffer(b"".join(parts), np.uint8)]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32) | (owner[1:] != owner[:-1])
    data, owner = data[keep].astype(np.uint32), owner[keep]
    counts = np.zeros(len(parts) * BUCKETS, np.int64)
    code = data
    for n in range(2, max(ORDERS) + 1):
        code = code[:-1] << np.uint32(8) | data[n - 1 :]
        if n in ORDERS:
            bucket = ((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(20)
            same = owner[: len(code)] == owner[n - 1 :]
            counts += np.bincount((owner[: len(code)] * BUCKETS + bucket)[same], minlength=len(counts))
    return counts.reshape(-1, BUCKETS)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    logs = _LOGS[np.minimum(counts, len(_LOGS) - 1)]
    beyond = counts >= len(_LOGS)
    if beyond.any():
        logs[beyond] = np.log1p(counts[beyond])
    weighted = logs * idf
    norm = np.sqrt((weighted * weighted).sum(axis=1, keepdims=True))
    return weighted / np.where(norm > 0, norm, 1)


def _whole(points: np.ndarray) -> np.ndarray:
    """Whole numbers whose products a float64 sums up exactly, in any order."""
    return np.rint(points.astype(np.float64) * _WHOLE)


def vectors(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    return _weighted(term_counts(texts), idf)


def _compared(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each text the cosine with every centroid, and the size."""
    counts = term_counts(texts)
    cosines = _whole(_weighted(counts, model.idf)) @ model.centroids.T / (_WHOLE * _WHOLE)
    return cosines, np.log2(np.maximum(counts.sum(axis=1), 1)).astype(np.int64)


def _lead(cosines: np.ndarray, languages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its nearest centroid, the cosine and the lead over other languages (1 if there are none)."""
    best = np.argmax(cosines, axis=1)
    score = np.clip(cosines[np.arange(len(best)), best], 0, 1)
    names = np.unique(languages, return_inverse=True)[1]
    other = np.where(names[best][:, None] == names[None, :], -1, cosines).max(axis=1)
    return best, score, np.where(other < 0, 1.0, score - other)


def nearest(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text its nearest centroid, the cosine, the lead over other languages (1 if there are none) and the size."""
    cosines, size = _compared(texts, model)
    return *_lead(cosines, model.languages), size


def _measured(texts: list[str | None], model: Model) -> tuple[np.ndarray, ...]:
    """``nearest``, and the centroid that would be nearest without the text's language, with its lead then."""
    cosines, size = _compared(texts, model)
    best, score, lead = _lead(cosines, model.languages)
    names = np.unique(model.languages, return_inverse=True)[1]
    second, _, ahead = _lead(np.where(names[best][:, None] == names[None, :], -1, cosines), model.languages)
    return best, score, lead, size, second, ahead


def _blocks(texts: list) -> Iterator[list]:
    for k in range(0, len(texts), _AT_ONCE):
        yield texts[k : k + _AT_ONCE]


def document_frequencies(train: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many of all training rows each bucket occurs, and how many rows there are. Each task sends one vector."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)  # the last one counts rows
        for _, texts in text_chunks(batches, 1 << 18):
            for block in _blocks(texts):
                total[:-1] += (term_counts(block) > 0).sum(axis=0)
                total[-1] += len(block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(total)], names=["bucket", "n"])

    found = keyed_text(train.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), "id", "text").mapInArrow(count, "bucket long, n long")
    rows = found.groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:
        total[r["bucket"]] = r["n"]
    return total[:-1], int(total[-1])


def _sample(train: DataFrame, text_col: str, lang_col: str, sample: int) -> DataFrame:
    """At most ``sample`` distinct texts of each language: those whose hashes come first."""
    hashed = train.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    sizes = hashed.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n"))  # copies don't count
    part = F.least(F.lit(1.0), F.lit(2.0 * sample) / F.col("n"))
    near = hashed.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "lang").where(F.pmod("h", F.lit(1_000_003)) < part * 1_000_003)
    once = near.groupBy("lang", "h").agg(F.first("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1_000_003)), "h"))
    return once.withColumn("nth", nth).where(F.col("nth") <= sample).select("lang", "text")


def _unit(points: np.ndarray, own: np.ndarray) -> np.ndarray:
    sums = np.stack([points[own == c].sum(axis=0) for c in range(own.max() + 1)])
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return sums / np.where(norm > 0, norm, 1)


def cluster(points: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Up to k centroids of length 1 and each point's centroid, none with less than ``LEAST`` of the points.

    The largest cluster is cut in two along its principal axis until there are k; rounds of k-means follow as long as
    no cluster becomes too small.
    """
    least = max(1, int(np.ceil(LEAST * len(points))))
    own = np.zeros(len(points), np.int64)
    while own.max() + 1 < k:
        at = np.flatnonzero(own == np.argmax(np.bincount(own)))
        if len(at) < 2 * least:
            break
        centred = points[at] - points[at].mean(axis=0)
        along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0]
        cut = int(np.clip((along < 0).sum(), least, len(at) - least))
        own[at[np.argsort(along, kind="stable")[cut:]]] = own.max() + 1
    made = _unit(points, own)
    for _ in range(rounds):
        near = np.argmax(points @ made.T, axis=1)
        if np.bincount(near, minlength=len(made)).min() < least:
            break
        own, made = near, _unit(points, near)
    return made, own


def _floors(sampled: DataFrame, model: Model) -> Model:
    """Add the floors: low quantiles of the sampled texts and their beginnings that get their own language."""
    sent = sampled.sparkSession.sparkContext.broadcast(model)

    def make():
        def measure(texts: list[str]) -> dict:
            cuts = [(i, t[:n]) for i, t in enumerate(texts) for n in (*[c for c in CUTS if c < len(t)], len(t))]
            found = [_measured([t for _, t in block], sent.value) for block in _blocks(cuts)]
            best, score, lead, size, second, ahead = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 6
            named = lambda at: [sent.value.languages[k] for k in at.tolist()]
            made = {"pred": named(best), "centroid": best.astype(np.int64), "score": score, "lead": lead, "size": size.astype(np.int64), "next": named(second), "ahead": ahead}
            return {"row": [i for i, _ in cuts], **made}

        return measure

    fields = [field("pred", "string"), field("centroid", "bigint"), field("score", "double"), field("lead", "double"), field("size", "bigint"), field("next", "string"), field("ahead", "double")]
    own = written(map_texts(sampled, "lang", "text", fields, make, 1 << 18).where("lang = pred"), "measured")
    lows = [F.count("*").alias("n"), *[F.expr(f"percentile({c}, {q})").alias(a) for c, q, a in (("score", LOW, "score"), ("lead", LOW, "lead"), ("lead", 0.5, "middle"))]]
    low = own.rollup("lang", "size", "centroid").agg(*lows).where("size IS NOT NULL")
    both = np.zeros((len(model.languages), 3, SIZES))
    for r in low.orderBy("size", F.col("centroid").asc_nulls_first(), "lang").collect():  # a language before its centroids
        trust = r["n"] / (r["n"] + 20)  # few texts are nearer to centroids of their own than others will be
        for k, name in enumerate(model.languages):
            if name == r["lang"] and (r["centroid"] is None or r["centroid"] == k and r["n"] >= OWN):
                both[k, :, r["size"] :] = np.array([[r["score"]], [r["lead"]], [r["middle"]]]) * trust
    strange = np.zeros((len(model.languages), SIZES))
    if len(set(model.languages)) > 2:
        high = own.groupBy("next", "size").agg(F.count("*").alias("n"), F.expr(f"percentile(ahead, {STRANGE})").alias("ahead"))
        for r in high.orderBy("size", "next").collect():
            strange[[name == r["next"] for name in model.languages], r["size"] :] = r["ahead"] * r["n"] / (r["n"] + 20)
    apart = np.minimum(both[:, 1], strange + APART * (both[:, 2] - strange)) * (strange > 0)
    return model._replace(floors=both[:, 0], leads=both[:, 1], apart=apart)


def fit(train: DataFrame, *, text_col: str = "text", lang_col: str = "lang", per_language: int = 4, sample: int = 500, languages: int = 1000) -> Model:
    """Learn from the rows of ``train`` whose text and language aren't null."""
    rows = train.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    if rows.select(lang_col).distinct().limit(languages + 1).count() > languages:
        raise ValueError(f"{lang_col} has more than {languages} distinct values")
    df, n = document_frequencies(rows, text_col)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    sampled = written(_sample(rows, text_col, lang_col, sample), "sampled")
    with_vectors = map_texts(sampled, "lang", "text", [field("vector", "binary")], lambda: lambda texts: {"vector": [v.astype(np.float16).tobytes() for b in _blocks(texts) for v in vectors(b, idf)]})

    def centroids(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        points = np.stack([np.frombuffer(v, np.float16) for v in sorted(rows.vector)]).astype(np.float32)
        points = points[np.linalg.norm(points, axis=1) > 0]
        if not len(points):
            return pd.DataFrame({"lang": [], "centroid": []})
        made, _ = cluster(points, per_language)
        return pd.DataFrame({"lang": [key[0]] * len(made), "centroid": [c.astype(np.float32).tobytes() for c in made]})

    found = sorted(with_vectors.groupBy("lang").applyInPandas(centroids, "lang string, centroid binary").collect(), key=lambda r: (r["lang"], r["centroid"]))
    made = _whole(np.stack([np.frombuffer(r["centroid"], np.float32) for r in found])) if found else np.zeros((0, BUCKETS))
    model = Model(idf, [r["lang"] for r in found], made, *np.zeros((3, len(found), SIZES)))
    return _floors(sampled, model) if found else model


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", reject: float = 0.45, carry: Sequence[str] = ()) -> DataFrame:
    """Return id, lang_pred, score, accepted and the columns in ``carry``, one row for each row of ``docs``; only texts are looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own: Model = sent.value

        def name(texts: list[str | None]) -> dict:
            languages, scores, accepted = [], [], []
            for block in _blocks(texts):
                best, cosine, lead, size = nearest(block, own) if own.languages else np.zeros((4, len(block)), np.int64)
                for text, k, score, ahead, n in zip(block, best.tolist(), cosine.tolist(), lead.tolist(), size.tolist()):
                    known = bool(own.languages) and bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))
                    languages.append(own.languages[k] if known else UNKNOWN)
                    scores.append(score if known else 0.0)
                    accepted.append(known and score >= reject * own.floors[k, n] and ahead >= max(reject * own.leads[k, n], own.apart[k, n]))
            return {"lang_pred": languages, "score": scores, "accepted": accepted}

        return name

    return map_texts(docs, id_col, text_col, [field("lang_pred", "string"), field("score", "double"), field("accepted", "boolean")], make, 1 << 18, carry)


def held_out(id_col: Column) -> Column:
    """The third of documents that nothing is learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))
